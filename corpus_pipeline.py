"""Training text from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept and
returns a DataFrame, which ``run`` writes to the shared folder and reads again.
"""

from pyspark.sql import DataFrame, functions as F

from trawl.llm import packing
from trawl.llm.line_dedup import dedup_lines
from trawl.llm.mixing import mix_sources
from trawl.llm.ngram_join import ngram_join
from trawl.llm.queries import quality_weights, toxicity_model
from trawl.llm.toxicity import score_toxicity
from trawl.session import written
from trawl.sources.tables import table

# No stage but mixing and exact line runs can be put in SQL: models and tokenizers decide.
ORACLE_SQL = None


def per_id(found: DataFrame, *columns) -> DataFrame:
    """One row per id, under names that clash with none of a document's."""
    best = [F.max(c).alias(f"{c} found") for c in columns]
    return found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id found")).agg(*best)


def with_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    return docs.join(found, F.col("doc_id") == F.col("id found"), "left")


def clean_of_toxicity(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Drops documents with a score of 0.5 or more. The score is a text's own, so it is found again by the
    text's digest: rows without id are judged too, and rows of one id each by their text."""
    model = toxicity_model(spark, sf_dir, docs)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    scored = score_toxicity(docs.select(digest.alias("doc_id"), "text"), model)
    toxic = scored.filter("score >= 0.5").select(F.col("doc_id").alias("digest found")).distinct()
    return docs.join(toxic, digest == F.col("digest found"), "left_anti").select(*docs.columns)


def without_repeated_lines(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Cuts later repeated runs of 50 words or more; a document that loses all of its text goes."""
    done = dedup_lines(docs)
    left = F.length(F.trim(F.coalesce("text", F.lit(""))))
    kept = done.filter((F.col("lines_removed") == 0) | (left > 0))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_duplicates(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Keeps the smallest id of each group of similar documents (five words, 0.8)."""
    found = ngram_join(docs.select("doc_id", "text"), n=5, num=80, den=100)
    others = per_id(found.filter("component_id < doc_id"), "component_id")
    return with_found(docs, others).filter("`component_id found` is null").select(*docs.columns)


def mixed(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Every document as many times as the mix takes it, which may be none. A row without id is a document of
    its own, by its text; rows that share an id are taken as often as the most taken of them."""
    own = docs.columns
    docs = docs.withColumn("doc_id found", F.col("doc_id"))
    by_text = -1 - F.shiftrightunsigned(F.xxhash64("text"), 1)
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", by_text))
    taken = mix_sources(docs, quality_weights(spark, sf_dir))
    times = taken.filter("taken > 0").withColumn("times", F.round(F.col("taken") / F.col("size")).cast("int"))
    chosen = per_id(times, "times").filter("`times found` > 0")
    joined = docs.join(chosen, F.col("doc_id") == F.col("id found"))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times found"))))
    return joined.withColumn("doc_id", F.col("doc_id found")).select(*own)


def packed(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """The pieces of all documents, copies too, with their places in sequences; rows without id are packed like others."""
    return packing.pack_sequences(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing", mixed),
    ("best-fit packing", packed),
]


def run(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
