"""The operators of this package as queries over the given tables."""

from pyspark.sql import functions as F

from trawl.llm import packing, toxicity as tox
from trawl.llm.exact_dedup import exact_dedup
from trawl.llm.fill_middle import fill_in_middle, restore
from trawl.llm.line_dedup import dedup_lines
from trawl.llm.mixing import mix_sources
from trawl.llm.ngram_join import ngram_join
from trawl.llm.pii import find_personal_data, fit as fit_field
from trawl.llm.secrets import scan_secrets
from trawl.llm.sharding import shard_rows
from trawl.llm.spelling import spelling_variants, word_counts
from trawl.llm.topk import top_k
from trawl.llm.url_filters import filter_urls, host
from trawl.sources.tables import table

REGISTRY = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def quality_weights(spark, d):
    """Documents labelled good weigh 2, labelled bad 0.5; the rest weigh 1."""
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight")
    )


def toxicity_model(spark, d, docs):
    labels = table(spark, d, "labels").filter(~tox.held_out())
    return tox.fit(tox.training_rows(docs, labels))


@query
def op1_top_k(spark, d):
    docs = table(spark, d, "documents")
    asked = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return top_k(docs, asked)


@query
def op2_line_dedup(spark, d):
    done = dedup_lines(table(spark, d, "documents"))
    return done.select(
        "doc_id", "lines_before", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


@query
def op3_ngram_join(spark, d):
    return ngram_join(table(spark, d, "documents"), n=3, num=90, den=100)


@query
def op4_shard_rows(spark, d):
    return shard_rows(table(spark, d, "documents"))


@query
def op5_scan_secrets(spark, d):
    return scan_secrets(table(spark, d, "documents"))


@query
def op6_exact_dedup(spark, d):
    return exact_dedup(table(spark, d, "documents"))


@query
def op7_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = tox.score_toxicity(docs, toxicity_model(spark, d, docs))
    return scored.select(
        "doc_id", tox.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


YEAR = 365 * 86_400
START = 1_704_067_200  # 2024-01-01


def number(column, most):
    """A number below ``most`` that SQL can repeat."""
    return F.conv(F.substring(F.md5(column.cast("string")), 1, 7), 16, 10).cast("long") % most


def captures(spark, d):
    """Pages with a fetch time in 2024, taken from the id."""
    return table(spark, d, "pages").select(
        "page_id", "url", (F.lit(START) + number(F.concat(F.lit("t"), F.col("page_id")), YEAR)).alias("fetched")
    )


def list_entries(spark, d):
    """A dated list about the hosts that occur: of three in ten a block and its later end, of
    one in five a path rule, and rules for whole domains."""
    hosts = table(spark, d, "pages").select(host(F.col("url")).alias("host")).filter("host != ''").distinct()
    roll = hosts.withColumn("roll", number(F.col("host"), 100))
    day = lambda tag, most: F.lit(START) + number(F.concat(F.lit(tag), F.col("host")), most)
    blocks = roll.filter("roll < 30").select(F.col("host").alias("rule"), day("b", YEAR // 2).alias("since"), F.lit("block").alias("verdict"))
    ends = roll.filter("roll < 20").select(F.col("host").alias("rule"), (day("b", YEAR // 2) + 5_000_000).alias("since"), F.lit(None).cast("string").alias("verdict"))
    paths = roll.filter("roll >= 80").select(F.concat("host", F.lit("/en")).alias("rule"), day("p", YEAR).alias("since"), F.lit("review").alias("verdict"))
    domains = roll.filter("roll % 10 = 5").select(
        F.regexp_replace("host", r"^[^.]+\.", "").alias("rule"), day("d", YEAR).alias("since"),
        F.when(F.col("roll") < 50, "warn").otherwise("allow").alias("verdict"),
    )
    return blocks.unionByName(ends).unionByName(paths).unionByName(domains)


@query
def op8_url_filters(spark, d):
    return filter_urls(captures(spark, d), list_entries(spark, d), horizon=START + YEAR)


@query
def op9_pack_sequences(spark, d):
    return packing.pack_sequences(table(spark, d, "documents"))


@query
def op10_mix_sources(spark, d):
    return mix_sources(table(spark, d, "documents"), quality_weights(spark, d))


@query
def op11_spelling_variants(spark, d):
    return spelling_variants(word_counts(table(spark, d, "documents")))


@query
def op12_fill_in_middle(spark, d):
    rows = restore(fill_in_middle(table(spark, d, "documents")))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


@query
def op13_personal_data(spark, d):
    docs = table(spark, d, "documents")
    return find_personal_data(docs, fit_field(docs))
