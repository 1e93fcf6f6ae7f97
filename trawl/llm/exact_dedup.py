"""Exact duplicates by a tree merge of digest runs.

Every document gives a digest of its normalised text. Rows are dealt to runs by
a hash of their id; a run is the sorted set of its digests, each with its
smallest id and its count. In each round the ``fan_in`` runs of one parent are
exchanged by digest and merged, until one run is left. The answers then go down
the same tree: a parent's entry meets at most ``fan_in`` entries of its
children, and a run's entry only the rows of that run, so that a digest held by
a third of all rows never meets in one place.

A digest counts as verified when SHA-256, a second 64-bit hash and the length
all agree; all three are the key at every level.
"""

from pyspark.sql import DataFrame, functions as F

from trawl.session import written

KEY = ["digest", "check", "length"]


def deal(column, runs):
    return F.pmod(F.xxhash64(column), F.lit(runs)).cast("int")


def normalised(text):
    """Each run of space or 0x09-0x0D as one space; null as empty."""
    # a lone space already is what it should become
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


def tree_merge(rows: DataFrame, key, runs=256, fan_in=16) -> DataFrame:
    """Adds keep_id (smallest id of the rows that agree in ``key``) and group_size.

    ``rows`` (id, key columns, others) should be a written table, as it is read twice.
    """
    dealt = rows.withColumn("run", deal("id", runs))
    level = dealt.groupBy(*key, "run").agg(
        F.min("id").alias("keep_id"), F.count("*").alias("group_size")
    )
    parent = F.floor(F.col("run") / fan_in).cast("int")
    levels, left = [level], runs
    while left > 1:
        left = -(-left // fan_in)
        level = level.withColumn("run", parent).groupBy(*key, "run").agg(
            F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        )
        levels.append(level)
    verdict = levels.pop()
    while levels:
        child = levels.pop().select(*key, "run", parent.alias("up"))
        verdict = child.join(verdict.withColumnRenamed("run", "up"), [*key, "up"]).drop("up")
    return dealt.join(verdict, [*key, "run"]).drop("run")


def exact_dedup(docs: DataFrame, id_col="doc_id", text_col="text", runs=256, fan_in=16) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id is kept. Null text counts as
    empty. Rows without an id count in ``group_size`` and are kept only in a group
    that has no id at all; rows that repeat one id with one text are the same document and share
    one verdict. An empty table gives an empty result. Other columns are not read.
    """
    text = F.col("text")
    slim = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).select(
        "id",
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.length(text).cast("long").alias("length"),
    )
    slim = tree_merge(written(slim, "digests"), KEY, runs, fan_in)
    return slim.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
