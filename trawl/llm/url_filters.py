"""URL filters that change over time, as a temporal join.

List entries are dated: each sets the verdict of a rule from its day on, until the rule's next
entry. Per rule the entries become validity intervals that do not overlap. Intervals are cut at
the borders of periods of fixed length, so that captures meet them by equality of rule and period
and one comparison of times. A capture asks for its URL's host, all parent domains
and all path prefixes; the longest rule that is active at fetch time decides.
"""

from pyspark.sql import DataFrame, Window, functions as F

OPEN_END = 9_999_999_999  # seconds; entries without a successor stay valid

# Fixed pattern: scheme, user, host, port, path, in a URL's usual form.
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)?"


def host(url):
    """Host in lower case without a closing dot; empty for what is not a URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def path_parts(url):
    path = F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def rule_keys(host_col, parts_col):
    """Every rule that covers a URL: parent domains, then the host's path prefixes.

    A key is ``domain`` or ``host/first/second``; a longer one is more specific, and
    any path rule is more specific than any domain rule.
    """
    labels = F.split(host_col, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, n - i + 1, i), ".")
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(parts_col)),
        lambda i: F.concat(host_col, F.lit("/"), F.array_join(F.slice(parts_col, F.lit(1), i), "/")),
    )
    prefixes = F.slice(prefixes, F.lit(2), F.size(parts_col))
    return F.when(host_col == "", F.array().cast("array<string>")).otherwise(F.concat(domains, prefixes))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """rule, verdict, valid_from, valid_to of (rule, since, verdict) entries.

    ``since`` is in seconds. Of entries for one rule and second, the first verdict in
    alphabetical order holds. Entries without rule or time are void; a null verdict ends a rule.
    """
    entries = entries.filter("rule is not null and since is not null").groupBy("rule", "since").agg(
        F.min("verdict").alias("verdict")
    )
    following = F.lead("since").over(Window.partitionBy("rule").orderBy("since"))
    return entries.select(
        "rule", "verdict", F.col("since").alias("valid_from"),
        F.coalesce(following, F.lit(OPEN_END)).alias("valid_to"),
    ).filter("verdict is not null")


def filter_urls(
    captures: DataFrame, entries: DataFrame, horizon, id_col="page_id", url_col="url",
    time_col="fetched", period=90 * 86_400,
) -> DataFrame:
    """One row per row of ``captures``: id, fetched, host, rule, verdict, since, n_active.

    ``fetched`` is in seconds; ``horizon`` is the latest one that can occur, and bounds the
    periods of intervals that never end; later captures are set against the state there. A
    capture without active rule has a null rule and the verdict ``allow``; so have captures with null or malformed
    URL or no time. Repeated captures are rows like any others; null ids are allowed.
    Empty tables on either side are fine.
    """
    ask = captures.select(
        F.col(id_col).alias("id"), F.col(time_col).cast("long").alias("fetched"),
        host(F.col(url_col)).alias("host"), path_parts(F.col(url_col)).alias("parts"),
    )
    # rows that agree in all of this get the same answer, so they are asked once
    ask = ask.select("id", "fetched", "host", F.concat_ws("/", "host", F.array_join("parts", "/")).alias("place"), "parts")
    keyed = ask.groupBy("fetched", "host", "place").agg(F.first("parts").alias("parts")).select(
        "fetched", "host", "place", F.explode_outer(rule_keys(F.col("host"), F.col("parts"))).alias("rule")
    ).filter("rule is not null and fetched is not null")
    at = F.least("fetched", F.lit(horizon))
    keyed = keyed.withColumn("at", at).withColumn("period", F.floor(F.col("at") / period))
    spans = validity_intervals(entries).filter(F.col("valid_from") <= horizon).withColumn(
        "period",
        F.explode(F.sequence(
            F.floor(F.col("valid_from") / period),
            F.floor((F.least("valid_to", F.lit(horizon + 1)) - 1) / period),
        )),
    )
    active = keyed.join(spans, ["rule", "period"]).filter("valid_from <= at and at < valid_to")
    order = F.struct(
        F.col("rule").contains("/").alias("is_path"), F.length("rule").alias("long"), "rule",
        "verdict", "valid_from",
    )
    decided = active.groupBy("fetched", "place").agg(
        F.max(order).alias("best"), F.count("*").alias("n_active")
    )
    return ask.join(decided, ["fetched", "place"], "left").select(
        F.col("id").alias(id_col),
        "fetched",
        "host",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.col("best.valid_from").alias("since"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
    )
