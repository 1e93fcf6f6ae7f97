"""Keeping the best k per question, inside a task and across tasks."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

# Scores are compared at this precision, so that engines and batch shapes that
# add floats in another order still agree on ties.
DIGITS = 9
SALTS = 64


def top_k(hits: DataFrame, k: int, order: list, rank="rank") -> DataFrame:
    """Number each question's rows by ``order`` and keep the first k."""
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn(rank, ranked).filter(F.col(rank) <= k)


def merge_top_k(hits: DataFrame, k: int, order: list, rank="rank") -> DataFrame:
    """``top_k`` over per-task winners.

    Every task may hold k rows for the same question, so the winners are first
    cut down within salted groups: no reducer sees more than a share of them.
    """
    salted = hits.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    within = Window.partitionBy("query_id", "_salt").orderBy(*order)
    cut = salted.withColumn("_in_salt", F.row_number().over(within)).filter(
        F.col("_in_salt") <= k
    )
    return top_k(cut.drop("_salt", "_in_salt"), k, order, rank)


class Best:
    """Running best k hits per question of one task.

    Orders by score (high first), then tie, then id. Ties at the edge are kept
    until they can be ordered, so the result does not depend on batching.
    """

    def __init__(self, questions: int, k: int, spill_rows: int = 200_000):
        self.k = k
        self.floor = np.full(questions, -np.inf)
        self.held = []
        self.rows = 0
        self.limit = max(spill_rows, 2 * questions * k)

    def offer(self, ids, scores, ties=None):
        """Scores is (rows, questions); -inf means the row is no candidate. ``ties`` gives the ties of
        hits at (rows, questions), and is asked for those that may stay only."""
        scores = np.round(scores, DIGITS)
        edge = self.floor
        if len(scores) > self.k:
            kth = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            edge = np.maximum(edge, kth)
        row, question = np.nonzero((scores >= edge) & (scores > -np.inf))
        if not len(row):
            return
        tie = ties(row, question) if ties is not None else 0
        self.held.append(
            pd.DataFrame(
                {"q": question, "id": ids[row], "score": scores[row, question], "tie": tie}
            )
        )
        self.rows += len(row)
        if self.rows > self.limit:
            self.result()

    def result(self) -> pd.DataFrame:
        if not self.held:
            return pd.DataFrame({"q": [], "id": [], "score": [], "tie": []})
        hits = pd.concat(self.held, ignore_index=True)
        hits = hits.sort_values(["q", "score", "tie", "id"], ascending=[True, False, True, True])
        hits = hits[hits.groupby("q").cumcount() < self.k]
        full = hits.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy(dtype=int)] = full["min"].to_numpy()
        self.held, self.rows = [hits], len(hits)
        return hits


def slices(pdf: pd.DataFrame, questions: int, cells: int = 250_000):
    """Cut a batch so that a (rows, questions) score matrix stays small."""
    step = max(1, cells // max(1, questions))
    for start in range(0, len(pdf), step):
        yield pdf.iloc[start : start + step]


def wrong_company(tickers, companies) -> np.ndarray:
    """(rows, questions) mask of rows that a question's filter shuts out."""
    wanted = np.array([c if c is not None else "" for c in companies], dtype=object)
    rows = np.asarray(tickers, dtype=object)
    return (wanted[None, :] != "") & (rows[:, None] != wanted[None, :])
