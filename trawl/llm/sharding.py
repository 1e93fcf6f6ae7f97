"""A uniform shuffle into shards of exact sizes, planned by a communication matrix.

Rows are dealt to source partitions by a hash. How many rows each partition
sends to each shard is drawn exactly, from the hypergeometric law that a uniform
random assignment would follow. Each partition puts its rows in random order and cuts them by its
row of the matrix, the shards exchange, and each shard is put in random order again.
"""

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from trawl.session import written


def hypergeometric(rng, good, bad, draws):
    """How many of ``draws`` rows without replacement are good.

    Inverse of the distribution function; weights follow from the mode by exact ratios, and
    beyond 12 standard deviations they are below double precision.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = math.sqrt(draws * (good / total) * (bad / total) * max(total - draws, 1) / max(total - 1, 1))
    reach = int(12 * spread) + 30
    first, last = max(low, mode - reach), min(high, mode + reach)
    up = np.arange(mode, last, dtype=np.float64)
    right = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    down = np.arange(mode, first, -1, dtype=np.float64)
    left = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([left[::-1], [1.0], right])
    sums = np.cumsum(weights)
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def communication_matrix(counts, sizes, seed):
    """Rows each partition sends to each shard; rows sum to ``counts``, columns to ``sizes``."""
    rng = np.random.default_rng(seed)
    left, rest = [int(s) for s in sizes], sum(int(s) for s in sizes)
    matrix = []
    for count in counts:
        row, draws, pool = [], int(count), rest
        for size in left:
            sent = hypergeometric(rng, size, pool - size, draws)
            row.append(sent)
            draws, pool = draws - sent, pool - size
        left = [a - b for a, b in zip(left, row)]
        rest -= int(count)
        matrix.append(row)
    return matrix


def random_key(seed, step):
    """A row's place in a random order; equal rows take each other's places."""
    return F.xxhash64(F.lit(f"{seed}:{step}"), "id", "text_crc32", "size")


def shard_rows(
    docs: DataFrame, shards=8, seed=7, id_col="doc_id", text_col="text", partition_rows=50_000
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard sizes differ by one at most. ``slot`` counts from 0
    in each shard without gaps. Null text has no bytes and CRC 0. Null or repeated ids
    are rows like any others; identical rows are interchangeable. An empty table gives an
    empty result. The draw depends on the seed and the rows, not on how they are stored.
    The matrix has one row per ``partition_rows`` rows of input.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    slim = written(slim, "sizes")
    n = slim.count()
    parts = max(1, -(-n // partition_rows))
    slim = slim.withColumn("part", F.pmod(random_key(seed, "deal"), F.lit(parts)).cast("int"))
    counted = {r["part"]: r["n"] for r in slim.groupBy("part").agg(F.count("*").alias("n")).collect()}
    counts = [counted.get(p, 0) for p in range(parts)]
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication_matrix(counts, sizes, seed)
    cuts = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(row)]) for p, row in enumerate(matrix)],
        "part int, cuts array<long>",
    )
    order = ["key", "id", "text_crc32", "size"]
    local = Window.partitionBy("part").orderBy(*order)
    sent = (
        slim.withColumn("key", random_key(seed, "send"))
        .withColumn("place", F.row_number().over(local))
        .join(cuts, "part")
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("place"))))
        .select("id", "size", "text_crc32", "shard")
    )
    # a shard's random order, in stretches of the key so that no task holds a shard
    sent = sent.withColumn("key", random_key(seed, "place")).withColumn(
        "stretch", F.floor((F.col("key") / 2.0**64 + 0.5) * parts).cast("int")
    )
    ahead = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        sent.groupBy("shard", "stretch").agg(F.count("*").alias("n"))
        .withColumn("begin", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .drop("n")
    )
    within = Window.partitionBy("shard", "stretch").orderBy(*order)
    return (
        sent.withColumn("place", F.row_number().over(within))
        .join(begins, ["shard", "stretch"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("begin") + F.col("place") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
