"""Score columns of the composite page rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the composite score and the bonus per kind of address.
WEIGHT_RANK = 0.7
WEIGHT_FRESHNESS = 0.1
WEIGHT_QUALITY = 0.1
WEIGHT_READABILITY = 0.05
WEIGHT_DOMAIN = 0.05
DOMAIN_BONUS = [(".gov", 1.0), (".edu", 0.8), (".org", 0.5)]
SECONDS_PER_YEAR = 86400.0 * 365.0
DEFAULT_RANK_SCORE = 1.0


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def freshness(crawled_at: Column, as_of: Column) -> Column:
    """1 for a page crawled at ``as_of``, falling to 0 over a year; unknown age counts as 0."""
    age = epoch_seconds(as_of) - epoch_seconds(F.coalesce(crawled_at, as_of))
    return F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(SECONDS_PER_YEAR))


def quality(text_length: Column) -> Column:
    return F.when(text_length > 0, F.log10(text_length.cast("double"))).otherwise(F.lit(0.0))


def domain_authority(url: Column) -> Column:
    """Bonus for public-interest addresses, looked for anywhere in the URL, best first."""
    bonus = None
    for part, value in DOMAIN_BONUS:
        test = F.contains(url, F.lit(part))
        bonus = F.when(test, F.lit(value)) if bonus is None else bonus.when(test, F.lit(value))
    return bonus.otherwise(F.lit(0.0))


def composite(rank: Column, fresh: Column, qual: Column, readability: Column, domain: Column) -> Column:
    """Weighted sum; ``readability`` is a reading ease on its 0 to 100 scale."""
    return (
        rank * WEIGHT_RANK
        + fresh * WEIGHT_FRESHNESS
        + qual * WEIGHT_QUALITY
        + F.coalesce(readability, F.lit(0.0)) / 100.0 * WEIGHT_READABILITY
        + domain * WEIGHT_DOMAIN
    )
