"""Exact cosine top-k for a batch of questions, and diversity re-selection."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from trawl.operators.questions import Questions
from trawl.operators.ranking import Best, merge_top_k, slices, wrong_company

BLOCK = 2048


def dense_top_k(vectors: DataFrame, questions: Questions, k: int, query_vector) -> DataFrame:
    """Rank ``vectors`` (id, ticker, embedding) by cosine for every question.

    One scan per question block: each task multiplies Arrow batches by the
    block's matrix and emits only its k best per question, so the shuffle
    carries tasks * questions * k small rows and never a pair per document.

    ``query_vector`` is a column over the questions (an embedder's
    ``questions(col)``, or an array column). Returns query_id, rank, id,
    similarity; equal scores rank by id.
    """
    schema = T.StructType(
        [
            T.StructField("query_id", questions.df.schema["query_id"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    blocks = questions.blocks({"vector": query_vector}, BLOCK)
    hits = questions.union([_scan(vectors, block, k, schema) for block in blocks], schema)
    order = [F.desc("similarity"), F.asc("id")]
    return merge_top_k(hits, k, order).select("query_id", "rank", "id", "similarity")


def _scan(vectors, block, k, schema):
    query_ids = np.array(block["query_id"].to_pylist(), dtype=object)
    companies = block["company"].to_pylist()
    matrix = np.array(block["vector"].to_pylist(), dtype=np.float64).T
    wanted = sorted({c for c in companies if c is not None})
    if companies and None not in companies:
        vectors = vectors.filter(F.col("ticker").isin(wanted))

    def scan(batches):
        best = Best(len(query_ids), k)
        for batch in batches:
            for pdf in slices(batch, len(query_ids)):
                scores = np.stack(pdf["embedding"].to_numpy()).astype(np.float64) @ matrix
                if wanted:
                    scores[wrong_company(pdf["ticker"], companies)] = -np.inf
                best.offer(pdf["id"].to_numpy(), scores)
        hits = best.result()
        yield pd.DataFrame(
            {
                "query_id": query_ids[hits["q"].to_numpy(dtype=int)],
                "id": hits["id"].astype(object),
                "similarity": hits["score"],
            }
        )

    return vectors.select("id", "ticker", "embedding").mapInPandas(scan, schema)


def mmr_select(pool: DataFrame, k: int, trade_off: float) -> DataFrame:
    """Greedy relevance-versus-redundancy pick of k rows from each pool.

    ``pool`` has query_id, rank, id, similarity, embedding with a bounded
    number of rows per question. A pool of at most k keeps its order. Equal
    scores go to the better pool rank. Adds mmr_rank.
    """
    kept = [f for f in pool.schema.fields if f.name != "embedding"]
    schema = T.StructType(kept + [T.StructField("mmr_rank", T.IntegerType())])

    def select(pdf):
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        if len(pdf) > k:
            vectors = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            relevance = pdf["similarity"].to_numpy()
            closest = np.full(len(pdf), -np.inf)
            open_rows = np.ones(len(pdf), dtype=bool)
            picks = [int(np.argmax(relevance))]
            while len(picks) < k:
                open_rows[picks[-1]] = False
                closest = np.maximum(closest, vectors @ vectors[picks[-1]])
                value = trade_off * relevance - (1.0 - trade_off) * closest
                value = np.where(open_rows, np.round(value, 9), -np.inf)
                picks.append(int(np.argmax(value)))
            pdf = pdf.iloc[picks]
        out = pdf.drop(columns="embedding")
        return out.assign(mmr_rank=np.arange(1, len(out) + 1, dtype=np.int32))

    return pool.groupBy("query_id").applyInPandas(select, schema)
