"""JSON settings laid over defaults."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Crawl settings used when a stored configuration does not name them.
DEFAULTS = {
    "max_depth": 3,
    "max_concurrent_requests": 10,
    "delay_per_domain": 1.0,
    "max_retries": 3,
    "max_requests_per_minute": 60,
    "db_batch_size": 1000,
    "save_to_db": True,
    "save_to_json": True,
    "ssl_verify": True,
}


def overlay(stored: Column, defaults: dict | None = None) -> Column:
    """``map<string,string>`` of the stored JSON object laid over the defaults, key by key.

    The overlay is shallow: a nested object in the stored value replaces the whole default.
    A value that is not a JSON object leaves the defaults as they are.
    """
    base = F.from_json(F.lit(json.dumps(defaults if defaults is not None else DEFAULTS)), "map<string,string>")
    over = F.coalesce(F.from_json(stored, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def setting(config: Column, key: str, kind: str) -> Column:
    """One typed setting of an overlaid configuration."""
    return F.element_at(config, F.lit(key)).cast(kind)
