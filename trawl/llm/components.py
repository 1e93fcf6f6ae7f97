"""Connected components of links, in rounds of joins with no graph in one place."""

from pyspark.sql import DataFrame, functions as F

from trawl.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step that moves every link nearer to the smallest id it can see."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.filter("b < a")
    low = seen.groupBy("a").agg(F.min("b").alias("low"))
    low = low.withColumn("low", F.least("low", "a"))
    moved = seen.join(low, "a")
    if large:
        return moved.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    own = low.select("a", F.col("low").alias("b"))
    return (
        moved.filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        .unionByName(own).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """id, component for every id in ``edges`` (a, b); the smallest id names its component.

    Alternates the two star steps until the links stop changing; each round is a written
    table, so a lost executor costs a round at most.
    """
    edges = written(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    state = edges.select(mark.alias("m")).first()["m"]
    while True:
        edges = written(_star(_star(edges, True), False), "edges")
        now = edges.select(mark.alias("m")).first()["m"]
        if now == state:
            break
        state = now
    found = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
