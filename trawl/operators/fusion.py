"""Combining ranked lists of the same questions."""

from pyspark.sql import DataFrame, Window, functions as F

from trawl.operators.ranking import DIGITS, top_k


def join_lanes(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Full outer join of the two lanes; a null rank means the lane missed it.

    ``dense``: query_id, rank, id, similarity. ``sparse``: query_id, bm25_rank,
    id, bm25_score. A document only the sparse lane found has similarity 0.
    """
    both = dense.withColumnRenamed("rank", "dense_rank").join(sparse, ["query_id", "id"], "full")
    return both.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def rrf_score(rrf_k):
    """Reciprocal rank fusion over 0-based positions."""

    def part(rank):
        return F.coalesce(1.0 / (rrf_k + F.col(rank) - 1), F.lit(0.0))

    return part("dense_rank") + part("bm25_rank")


def fuse(lanes: DataFrame, k: int, mode: str, rrf_k: int) -> DataFrame:
    """Top k of joined lanes by consensus ("rrf") or by turns ("interleave").

    Equal RRF scores go to the better dense rank, then the better sparse one.
    """
    scored = lanes.withColumn("rrf_score", rrf_score(rrf_k)).withColumn("fusion", F.lit(mode))
    if mode == "rrf":
        order = [
            F.desc(F.round("rrf_score", 12)),
            F.asc_nulls_last("dense_rank"),
            F.asc_nulls_last("bm25_rank"),
        ]
    else:
        turn = F.least(2 * (F.col("dense_rank") - 1), 2 * (F.col("bm25_rank") - 1) + 1)
        order = [F.asc(turn)]
    return top_k(scored, k, order)


def round_robin(lists: DataFrame, k: int) -> DataFrame:
    """Merge lists by turns: first of each, second of each, and so on.

    ``lists`` has query_id, list_no, rank, id and columns to carry; the lists
    of a question take turns in list_no order, and an id keeps its first place.
    """
    place = Window.partitionBy("query_id", "id").orderBy("rank", "list_no")
    first = lists.withColumn("_seen", F.row_number().over(place)).filter(F.col("_seen") == 1)
    merged = top_k(first, k, [F.asc("rank"), F.asc("list_no")], "_place")
    return merged.withColumn("rank", F.col("_place")).drop("_seen", "_place", "list_no")


def pool_union(sources: list, depth_order="rank") -> DataFrame:
    """Ordered union without repeats: all of the first source, then what only
    later ones found. Gives query_id, id, pool_rank."""
    tagged = [
        s.select("query_id", "id", F.struct(F.lit(i).alias("source"), depth_order).alias("place"))
        for i, s in enumerate(sources)
    ]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    first = rows.groupBy("query_id", "id").agg(F.min("place").alias("place"))
    order = Window.partitionBy("query_id").orderBy("place")
    return first.select("query_id", "id", F.row_number().over(order).alias("pool_rank"))


def rerank(pool: DataFrame, score, k: int) -> DataFrame:
    """Re-order a pool by ``score``, a column over question and text.

    Equal scores keep the pool's order. Adds rerank_score.
    """
    scored = pool.withColumn("rerank_score", score(F.col("question"), F.col("text")))
    best = scored.withColumnRenamed("rank", "_pool_rank")
    order = [F.desc(F.round("rerank_score", DIGITS)), F.asc("_pool_rank")]
    return top_k(best, k, order).drop("_pool_rank", "question", "text")
