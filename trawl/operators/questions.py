"""A batch of questions, and how far it may be trusted to be small.

A ranking operator scans the corpus once per block of questions, so only a
block, whose size is checked here, ever travels to the tasks. Larger batches
take more scans and give the same rows.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from trawl.session import written

LOCAL_ROWS = 20_000
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(stored: DataFrame) -> DataFrame:
    """Hint a broadcast of a stored table after counting its rows."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


@dataclass(frozen=True)
class Questions:
    df: DataFrame
    n: int

    @classmethod
    def of(cls, df: DataFrame) -> "Questions":
        """Normalise the filter's case and pin down a small batch.

        A batch of up to ``LOCAL_ROWS`` becomes a local relation: its size is
        then known to the optimizer and its own plan never runs again. A larger
        one is written to the shared folder, to be read once per block.
        """
        if "company" not in df.columns:
            df = df.withColumn("company", F.lit(None).cast("string"))
        df = df.select("query_id", "question", F.upper("company").alias("company"))
        head = df.limit(LOCAL_ROWS + 1).toArrow()
        if head.num_rows <= LOCAL_ROWS:
            return cls(df.sparkSession.createDataFrame(head, df.schema), head.num_rows)
        df = written(df, "questions")
        return cls(df, df.count())

    def blocks(self, extra: dict, rows: int):
        """The batch as Arrow tables of about ``rows`` questions each.

        ``extra`` names further columns to compute for the scan.
        """
        if self.n == 0:
            return
        wanted = self.df.select("query_id", "company", *[c.alias(n) for n, c in extra.items()])
        if self.n <= rows:
            yield wanted.toArrow()
            return
        count = -(-self.n // rows)
        block = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(count))
        for i in range(count):
            yield wanted.filter(block == i).toArrow()

    def union(self, parts: list, schema) -> DataFrame:
        """All per-block results, or an empty table for an empty batch."""
        if not parts:
            return self.df.sparkSession.createDataFrame([], schema)
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def small(self, ranked: DataFrame, per_question: int) -> DataFrame:
        """Hint a broadcast where the row bound n * per_question proves it safe;
        beyond that leave the join strategy to the optimizer."""
        if self.n * per_question <= BROADCAST_ROWS:
            return F.broadcast(ranked)
        return ranked
