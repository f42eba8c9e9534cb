"""Crawl permission rules: read robots.txt texts as tables and apply them to urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.binding import let
from pagemill.session import cut_lineage

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _unquote(text: Column) -> Column:
    """Decode percent escapes; a plus sign is a plus sign; broken escapes leave the text alone."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _quote(text: Column) -> Column:
    """Percent-encode everything but letters, digits and ``/ _ . - ~``."""
    encoded = F.url_encode(text)
    for found, wanted in [("%2F", "/"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")]:
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def parse_rules(files: DataFrame) -> DataFrame:
    """Rules of ``(base_url, robots_txt)`` rows: one row per group and rule.

    A group is a run of user-agent lines and the rules under them. A blank line ends it,
    and rules that follow no user-agent line are ignored. Every group also gets a last
    row that allows everything, which is its answer when no rule matches.
    """
    lines = files.select("base_url", F.posexplode(F.split("robots_txt", LINE_BREAK)).alias("line_no", "raw"))
    text = F.trim(F.regexp_replace("raw", r"#.*$", ""))
    key = F.lower(F.trim(F.substring_index(text, ":", 1)))
    known = ["user-agent", "allow", "disallow", "crawl-delay", "request-rate"]
    kind = F.when(F.col("raw") == "", "blank").when(F.contains(text, F.lit(":")) & key.isin(known), key)
    value = _unquote(F.trim(F.regexp_replace(text, r"^[^:]*:", "")))
    events = lines.select("base_url", "line_no", kind.alias("kind"), value.alias("value")).filter("kind is not null")

    # One robots file is one small group.
    file = Window.partitionBy("base_url").orderBy("line_no")
    last_agent = F.max(F.when(F.col("kind") == "user-agent", F.col("line_no"))).over(file)
    last_blank = F.max(F.when(F.col("kind") == "blank", F.col("line_no"))).over(file)
    active = (
        events.withColumn("open", last_agent > F.coalesce(last_blank, F.lit(-1)))
        .filter((F.col("kind").isin("user-agent", "blank")) | F.col("open"))
        .withColumn("starts", (F.col("kind") == "user-agent")
                    & (F.coalesce(F.lag("kind").over(file), F.lit("blank")) != "user-agent"))
        .withColumn("group_no", F.sum(F.col("starts").cast("int")).over(file))
        .filter("kind != 'blank'")
    )
    is_agent = F.col("kind") == "user-agent"
    rule = F.struct(
        F.col("line_no").alias("rule_no"),
        _quote(F.col("value")).alias("path"),
        ((F.col("kind") == "allow") | (F.col("value") == "")).alias("allow"),
    )
    return (
        active.groupBy("base_url", "group_no").agg(
            F.collect_list(F.when(is_agent, F.lower("value"))).alias("agents"),
            F.array_sort(F.collect_list(F.when(F.col("kind").isin("allow", "disallow"), rule))).alias("rules"),
            F.count_if(~is_agent).alias("n"),
        )
        .filter("n > 0").drop("n")
    )


def rules_for_agent(rules: DataFrame, agent: str) -> DataFrame:
    """The one group per host that binds ``agent``, as ``(base_url, rules)``.

    The first group that names a part of the agent's name wins; the name ends at the first
    slash. The ``*`` group counts only when no other group matches, wherever it stands.
    """
    name = F.lit(agent.split("/")[0].lower())
    catch_all = F.array_contains("agents", "*")
    named = F.exists("agents", lambda a: F.contains(name, a))
    order = F.struct(catch_all.alias("fallback"), F.col("group_no"))
    return rules.filter(catch_all | named).groupBy("base_url").agg(F.min_by("rules", order).alias("rules"))


def allowed(candidates: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``candidates`` with a column ``allowed`` for their ``url``.

    Each host has one row of rules, and the rows are stored first: a host with very many urls
    is then a join of two shuffled tables, whose large partition adaptive execution splits. The first rule in file order whose path starts the
    url's path decides; a host without rules allows everything.
    """
    rest = F.regexp_replace(_unquote(F.col("url")), r"^[^:/?#]*://[^/?#]*", "")
    path = let(rest, lambda r: F.when(r == "", F.lit("/")).otherwise(_quote(r)))
    matching = F.filter("rules", lambda r: (r["path"] == "*") | F.startswith("path", r["path"]))
    return (
        candidates.withColumn("base_url", urls.base_url(F.col("url"))).withColumn("path", path)
        .join(cut_lineage(rules_for_agent(rules, agent)), "base_url", "left")
        .withColumn("allowed", F.coalesce(F.get(matching, F.lit(0))["allow"], F.lit(True)))
        .drop("base_url", "path", "rules")
    )
