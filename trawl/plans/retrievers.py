"""Retrievers: a batch of questions in, one ranked table out.

All share ``retrieve(questions, k)`` and return query_id, rank, id, similarity
plus what they know about each row, so they nest in any order. Each wrapper
only builds a plan: a question that it leaves alone travels the same plan as a
single list, with no second branch.
"""

from typing import Protocol

from pyspark.sql import DataFrame, Window, functions as F

from trawl.functions.automaton import named_companies
from trawl.functions.text import tokens
from trawl.operators.dense import dense_top_k, mmr_select
from trawl.operators.fusion import fuse, join_lanes, rerank, round_robin
from trawl.operators.questions import Questions
from trawl.session import written
from trawl.sources.collection import id_bucket


class Retriever(Protocol):
    def retrieve(self, questions: Questions, k: int) -> DataFrame: ...


class DenseRetriever:
    """Exact cosine search. ``corpus``: id, ticker, text, embedding."""

    prefix_of_deeper = True

    def __init__(self, corpus: DataFrame, embedder, buckets=None):
        self.corpus, self.embedder, self.buckets = corpus, embedder, buckets

    @classmethod
    def over(cls, collection, embedder):
        return cls(collection.read(), embedder, collection.buckets)

    def retrieve(self, questions, k, include_embeddings=False):
        vector = self.embedder.questions(F.col("question"))
        ranked = dense_top_k(self.corpus, questions, k, vector)
        if include_embeddings:
            return self.attach(ranked, questions, k, "embedding")
        return ranked

    def attach(self, ranked, questions, per_question, *columns):
        """Add corpus columns to ranked rows. The rows are few and bounded, so
        they are what moves; the corpus is only scanned for its column, and of
        a stored collection only the folders that the ids fall into."""
        keys = ["id"]
        if self.buckets:
            keys = ["bucket", "id"]
            ranked = ranked.withColumn("bucket", id_bucket(self.buckets))
        rows = self.corpus.select(*keys, *columns)
        return rows.join(questions.small(ranked, per_question), keys).drop("bucket")


class MMRRetriever:
    def __init__(self, base: DenseRetriever, settings):
        self.base, self.settings = base, settings

    def retrieve(self, questions, k):
        pool = self.base.retrieve(questions, self.settings.pool, include_embeddings=True)
        picked = mmr_select(pool, k, self.settings.mmr_lambda)
        return picked.withColumn("rank", F.col("mmr_rank"))


class HybridRetriever:
    """Dense and BM25 lanes, fused. With ``gated``, a question without a token
    rare in the corpus keeps the plain dense ranking."""

    def __init__(self, base, index, settings, fusion=None, gated=False):
        self.base, self.index, self.settings = base, index, settings
        self.fusion, self.gated = fusion or settings.fusion, gated

    def retrieve(self, questions, k):
        pool = self.settings.pool
        if not self.gated:
            return self._fused(questions, self.base.retrieve(questions, pool), k)
        gate = written(self.index.looks_lexical(questions), "gate")  # read three times below
        opaque = F.col("opaque")
        lexical = self._subset(questions, gate.filter(opaque))
        gate = questions.small(gate, 1)
        if not getattr(self.base, "prefix_of_deeper", False):
            plain = self._subset(questions, gate.filter(~opaque))
            fused = self._fused(lexical, self.base.retrieve(lexical, pool), k)
            return fused.unionByName(
                self.base.retrieve(plain, k).withColumn("fusion", F.lit("dense-passthrough")),
                allowMissingColumns=True,
            )
        # The best k of a deeper dense list are the list at k, and fusing a dense
        # list with nothing keeps its order: one scan serves gated and passed alike.
        deep = self.base.retrieve(questions, max(pool, k)).join(gate, "query_id")
        dense = deep.filter(F.col("rank") <= F.when(opaque, pool).otherwise(k))
        fused = self._fused(lexical, dense.drop("opaque"), k).join(gate, "query_id")
        lane_columns = ["dense_rank", "bm25_rank", "bm25_score", "rrf_score"]
        return fused.withColumns(
            {
                "fusion": F.when(opaque, F.col("fusion")).otherwise("dense-passthrough"),
                **{c: F.when(opaque, F.col(c)) for c in lane_columns},
            }
        ).drop("opaque")

    @staticmethod
    def _subset(questions, kept):
        return Questions.of(questions.df.join(kept, "query_id", "left_semi"))

    def _fused(self, questions, dense, k):
        lanes = join_lanes(dense, self.index.search(questions, self.settings.pool))
        return fuse(lanes, k, self.fusion, self.settings.rrf_k)


class RerankRetriever:
    """Retrieve wide, then re-order by a scorer: a function of the question
    and text columns giving a column (built-in expressions or a pandas UDF)."""

    def __init__(self, base, dense: DenseRetriever, scorer, settings):
        self.base, self.dense, self.scorer, self.settings = base, dense, scorer, settings

    def retrieve(self, questions, k):
        pool = self.settings.pool
        ranked = self.base.retrieve(questions, pool)
        with_text = self.dense.attach(ranked, questions, pool, "text")
        asked = questions.df.select("query_id", "question")
        return rerank(with_text.join(asked, "query_id"), self.scorer, k)


def token_overlap(question, text):
    """A scorer without a model: Jaccard similarity of the token sets."""
    a, b = tokens(question), tokens(text)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def cross_encoder(settings):
    """A scorer backed by a cross-encoder, loaded once per Python worker."""
    import pandas as pd

    name, loaded = settings.rerank_model, {}

    def score(question: pd.Series, text: pd.Series) -> pd.Series:
        if name not in loaded:
            from sentence_transformers import CrossEncoder

            loaded[name] = CrossEncoder(name)
        return pd.Series(loaded[name].predict(list(zip(question, text))), dtype="float64")

    return F.pandas_udf(score, "double")


def fan_out(base, questions: Questions, subs: DataFrame, k: int) -> DataFrame:
    """Retrieve sub-questions and merge them back by turns.

    ``subs``: query_id, sub_key, question, company. The lists of a question
    take turns in sub_key order, equal keys collapse, and a question with one
    list keeps that list.
    """
    order = Window.partitionBy("query_id").orderBy("sub_key")
    numbered = subs.dropDuplicates(["query_id", "sub_key"]).select(
        "*",
        F.row_number().over(order).alias("list_no"),
    )
    batch = Questions.of(
        numbered.select(
            F.to_json(F.struct("query_id", "list_no")).alias("query_id"), "question", "company"
        )
    )
    kind = questions.df.schema["query_id"].dataType.simpleString()
    lists = base.retrieve(batch, k).withColumn(
        "_of", F.from_json("query_id", f"query_id {kind}, list_no int")
    )
    return round_robin(
        lists.withColumn("query_id", F.col("_of.query_id"))
        .withColumn("list_no", F.col("_of.list_no"))
        .drop("_of"),
        k,
    )


class CompanyDecomposition:
    """One filtered retrieval per company for unfiltered questions that name
    at least two."""

    def __init__(self, base, companies: dict):
        self.base, self.companies = base, companies

    def subquestions(self, questions):
        named = named_companies(F.col("question"), self.companies)
        split = F.col("company").isNull() & (F.size("named") >= 2)
        one = F.array(F.lit(None).cast("string"))
        return (
            questions.df.withColumn("named", named)
            .withColumn("each", F.explode(F.when(split, F.col("named")).otherwise(one)))
            .select(
                "query_id",
                F.coalesce("each", F.lit("")).alias("sub_key"),
                "question",
                F.coalesce("each", "company").alias("company"),
            )
        )

    def retrieve(self, questions, k):
        return fan_out(self.base, questions, self.subquestions(questions), k)


class RewriteRetriever:
    """Retrieve recorded sub-questions of each question and merge by turns.

    ``rewrites`` has question, rewrite. A question with fewer than two rewrites
    is retrieved as asked. With ``companies``, an unfiltered rewrite that names
    exactly one of them is filtered to it. Serves both query splitting and
    aspect expansion, which differ only in where the rewrites come from.
    """

    def __init__(self, base, rewrites: DataFrame, companies: dict | None = None):
        self.base, self.rewrites, self.companies = base, rewrites, companies

    def subquestions(self, questions):
        counted = self.rewrites.select(
            "question",
            "rewrite",
            F.count("*").over(Window.partitionBy("question")).alias("parts"),
        ).filter(F.col("parts") > 1)
        joined = questions.df.join(counted, "question", "left")
        company = F.col("company")
        if self.companies:
            named = named_companies(F.col("rewrite"), self.companies)
            company = F.coalesce(company, F.when(F.size(named) == 1, F.get(named, F.lit(0))))
        return joined.select(
            "query_id",
            F.coalesce("rewrite", F.lit("")).alias("sub_key"),
            F.coalesce("rewrite", "question").alias("question"),
            company.alias("company"),
        )

    def retrieve(self, questions, k):
        return fan_out(self.base, questions, self.subquestions(questions), k)


def full_stack(dense, index, aspects, settings, companies=None):
    """The shipped composition: expand(decompose(gated interleaved hybrid))."""
    hybrid = HybridRetriever(dense, index, settings, fusion="interleave", gated=True)
    split = CompanyDecomposition(hybrid, companies or settings.companies)
    return RewriteRetriever(split, aspects)


def compare_arms(retriever, questions: Questions, k: int) -> DataFrame:
    """Each filtered question with and without its filter, one row per id."""
    open_batch = Questions.of(questions.df.drop("company"))
    kept = ["query_id", "id", "rank", "similarity"]
    with_filter = retriever.retrieve(questions, k).select(*kept)
    without = retriever.retrieve(open_batch, k).select(*kept)
    return (
        with_filter.withColumnsRenamed({"rank": "filtered_rank", "similarity": "filtered_sim"})
        .join(
            without.withColumnsRenamed({"rank": "open_rank", "similarity": "open_sim"}),
            ["query_id", "id"],
            "full",
        )
    )
