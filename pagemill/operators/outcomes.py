"""Jobs over the fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: failures of one url that are followed by another try.
MAX_RETRIES = 3

CRAWLED, SKIPPED, ERROR, DROPPED = "crawled", "skipped", "error", "dropped"


def fetch_outcome(allowed: Column, status: Column, content_type: Column) -> Column:
    """Class of one fetch; no status means the request itself failed."""
    return (
        F.when(~allowed, SKIPPED)
        .when(status.isNull() | (status >= 500), ERROR)
        .when((status == 200) & F.contains(F.coalesce(content_type, F.lit("")), F.lit("text/html")), CRAWLED)
        .otherwise(DROPPED)
    )


def domain_stats(log: DataFrame) -> DataFrame:
    """Crawled, skipped and failed fetches per domain; needs ``domain`` and ``outcome``."""
    is_a = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return log.groupBy("domain").agg(
        is_a(CRAWLED).alias("crawled"), is_a(SKIPPED).alias("skipped"), is_a(ERROR).alias("errors")
    )


def crawl_counters(log: DataFrame) -> DataFrame:
    """Totals of the fetch log in one row."""
    is_a = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return log.agg(
        is_a(CRAWLED).alias("total_crawled"), is_a(SKIPPED).alias("total_skipped"), is_a(ERROR).alias("total_errors")
    )


def link_counters(outlinks: DataFrame) -> DataFrame:
    """Links recorded (duplicates count) and distinct links; one row of ``outlinks`` per page."""
    return outlinks.agg(
        F.coalesce(F.sum(F.size("targets")), F.lit(0)).alias("links_recorded"),
        F.coalesce(F.sum(F.size(F.array_distinct("targets"))), F.lit(0)).alias("links_distinct"),
    )


def failure_counts(log: DataFrame) -> DataFrame:
    """Failed fetches per url."""
    return log.groupBy("url").agg(F.count_if(F.col("outcome") == ERROR).alias("failures"))


def retry_decision(failures: Column, max_retries: int = MAX_RETRIES) -> Column:
    """What the latest failure of a url leads to; a success does not reset the count."""
    return F.when(failures == 0, "none").when(failures <= max_retries, "requeue").otherwise("failed")


def retry_state(log: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """``(url, failures, decision)``; works on a batch log and, with update mode, on a stream."""
    return failure_counts(log).withColumn("decision", retry_decision(F.col("failures"), max_retries))
