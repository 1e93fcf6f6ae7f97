"""The engine's operators as queries over the given tables.

Here ``documents`` is the corpus (language as ticker, source as section),
``benchmark`` the question set, ``embeddings`` a vector store filtered by
label, ``labels`` the relevance verdicts and ``pages`` raw web pages.
"""

import dataclasses

from pyspark.sql import DataFrame, Window, functions as F

from trawl.config import Settings
from trawl.functions import automaton, text as tx
from trawl.functions.vectors import HashedTokens, l2_norm
from trawl.operators import chunking, grounding, judge, lexical, metrics
from trawl.operators.dense import dense_top_k, mmr_select
from trawl.operators.fusion import pool_union, round_robin
from trawl.operators.html import html_to_text, item_slices, target_sections
from trawl.operators.impact import ImpactIndex, write_impact_index
from trawl.operators.lexical import LexicalIndex
from trawl.operators.questions import Questions
from trawl.plans.retrievers import (
    CompanyDecomposition, DenseRetriever, HybridRetriever, RerankRetriever, RewriteRetriever,
    compare_arms, full_stack, token_overlap,
)
from trawl.session import scratch_path, written
from trawl.sources import adapters, filings, readers
from trawl.sources.collection import Collection, ticker_counts, upserted, with_total
from trawl.sources.segments import SegmentedIndex
from trawl.sources.tables import spread, table
from trawl.streaming.ingest import follow_chunks, take_batch

COMPANIES = {"DE": ("der",), "EN": ("the",), "ES": ("los",), "FR": ("les",)}
SETTINGS = Settings(tickers=("DE", "EN", "ES", "FR", "IT"), companies=COMPANIES)
# a ceiling of one document, so that the gate tells these questions apart
STRICT = dataclasses.replace(SETTINGS, rare_fraction=0.0)
EMBEDDER = HashedTokens(64)

REGISTRY = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def corpus(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.upper("lang").alias("ticker"),
        F.col("source").alias("section"),
        "text",
    )


def embedded(spark, d) -> DataFrame:
    return corpus(spark, d).withColumn("embedding", EMBEDDER.documents(F.col("text")))


def asked(spark, d, company=None) -> Questions:
    return Questions.of(
        table(spark, d, "benchmark").select(
            F.col("item_id").alias("query_id"),
            F.col("text").alias("question"),
            F.lit(company).cast("string").alias("company"),
        )
    )


def dense(spark, d) -> DenseRetriever:
    return DenseRetriever(embedded(spark, d), EMBEDDER)


def index(spark, d, settings=SETTINGS) -> LexicalIndex:
    return LexicalIndex.from_text(corpus(spark, d), settings)


def sentence_rewrites(spark, d) -> DataFrame:
    """All of each question's sentences, standing in for recorded rewrites."""
    parts = F.transform(F.split("text", r"[.\n]"), tx.strip)
    recorded = table(spark, d, "benchmark").select(
        F.lit("recorded").alias("model"),
        F.col("text").alias("question"),
        adapters.clean_list(parts).alias("rewrites"),
    )
    return adapters.each_rewrite(recorded, "recorded")


def containing(docs, items) -> DataFrame:
    """query_id, id of the documents whose text contains an item's."""
    questions = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return automaton.containing(docs, Questions.of(questions))


def golden(spark, d):
    """(questions, key): documents that contain a question word for word.

    Found in one scan of the texts with an automaton of the questions. Written down, as an
    answer key is a table that every score reads.
    """
    items = table(spark, d, "benchmark")
    key = written(containing(corpus(spark, d), items), "key")
    counted = key.groupBy("query_id").agg(F.count("*").alias("hits"))
    questions = items.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    ).join(counted, "query_id", "left")
    return (
        questions.select(
            "query_id",
            "question",
            F.when(F.col("hits").isNull(), "control")
            .when(F.col("hits") == 1, "single")
            .otherwise("multi")
            .alias("category"),
            (F.length("question") >= 240).alias("recall_reliable"),
        ),
        key,
    )


def joined(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


def r6(name):
    return F.round(name, 6).alias(name)


# --- text ---------------------------------------------------------------


@query
def tokenize_documents(spark, d):
    toks = corpus(spark, d).select("id", tx.tokens("text").alias("toks"))
    return toks.select(
        "id",
        F.size("toks").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("toks")).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join("toks", " ")).alias("digest"),
    )


@query
def query_terms(spark, d):
    return asked(spark, d).df.select(
        "query_id", F.array_join(tx.lexical_tokens(F.col("question")), " ").alias("bm25_query")
    )


@query
def document_previews(spark, d):
    return corpus(spark, d).select(
        "id",
        tx.preview(F.col("text")).alias("preview"),
        tx.excerpt(F.col("text"), 320).alias("excerpt"),
        tx.one_line(F.substring("text", 1, 140), " | ").alias("head"),
    )


@query
def company_detection(spark, d):
    said = table(spark, d, "conversations")
    named = automaton.named_companies(F.col("text"), COMPANIES)
    return said.select(
        "conv_id",
        "turn",
        F.array_join(named, ",").alias("companies"),
        tx.filter_mismatch(F.lit("fr"), named).alias("mismatch"),
    )


@query
def many_companies(spark, d):
    """Every longer word of the questions as a company's name; who says them."""
    said = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("name")
    names = [r["name"] for r in table(spark, d, "benchmark").select(said).distinct().collect()]  # a dictionary, held by every task
    named = automaton.named_companies(F.col("text"), {name.upper(): (name,) for name in names})
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(named, ",").alias("companies"))


@query
def id_companies(spark, d):
    ids = table(spark, d, "documents").select(
        F.format_string("%s-%s-%04d", F.upper("lang"), F.lit("2024-01-01"), "doc_id").alias("chunk_id")
    )
    names = {"DE": ("German",), "FR": ("French",)}
    return ids.select(
        "chunk_id",
        tx.id_company(F.col("chunk_id"), names).alias("company"),
        tx.short_id(F.col("chunk_id")).alias("short_id"),
    )


# --- web pages, sections, chunks ------------------------------------------


@query
def page_text(spark, d):
    pages = spread(table(spark, d, "pages"), "page_id")
    return pages.select("page_id", html_to_text(F.col("html")).alias("clean"))


@query
def page_text_entities(spark, d):
    """Every page with a paragraph of references of all forms at its end."""
    forms = "&eacute;t&eacute &notit; &#00000065; &#x1F600; &#150; &#xD800; &bogus; &amp;lt; &copy2024 &hearts;"
    pages = spread(table(spark, d, "pages"), "page_id").withColumn("html", F.concat("html", F.lit(f"<p>{forms}</p>")))
    return pages.select("page_id", html_to_text(F.col("html")).alias("clean"))


def reports(spark, d) -> DataFrame:
    """Documents laid out as annual reports: contents, items, a back-reference."""
    body = F.col("text")
    clean = F.concat(
        F.lit("Item 1. Business\nItem 1A. Risk Factors\nItem 7. Overview\nItem 1. Business\n"),
        body,
        F.lit("\nas discussed in\nItem 7 of our report.\nITEM 1A. Risk Factors\n"),
        F.replace(body, F.lit(". "), F.lit(".\n")),
        F.lit("\nItem\u00a07. [Reserved]\n"),
        F.replace(body, F.lit(" "), F.lit("  ")),
        F.lit("\nItem 9. Other\n"),
        body,
    )
    return corpus(spark, d).select("id", "ticker", clean.alias("clean"))


@query
def item_sections(spark, d):
    found = (
        reports(spark, d)
        .withColumn("slices", item_slices(F.col("clean")))
        .withColumn("s", target_sections(F.col("slices"), SETTINGS.section_min_chars))
        .select("id", F.posexplode_outer("s").alias("position", "s"))
        .filter(F.col("s").isNotNull())
    )
    return found.select(
        "id",
        F.col("position").cast("bigint").alias("position"),
        "s.section",
        F.length("s.text").cast("bigint").alias("chars"),
        F.md5("s.text").alias("digest"),
    )


def document_chunks(spark, d) -> DataFrame:
    filed = corpus(spark, d).select(
        F.concat("ticker", F.col("id").cast("string")).alias("ticker"),
        F.lit("2024-01-01").alias("filing_date"),
        F.array(F.struct("section", "text")).alias("sections"),
    )
    return chunking.chunk_filings(filed, SETTINGS)


@query
def chunk_documents(spark, d):
    return document_chunks(spark, d).select(
        "chunk_id",
        "section",
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("char_start").cast("bigint").alias("char_start"),
        F.col("char_end").cast("bigint").alias("char_end"),
        F.md5("text").alias("digest"),
    )


@query
def chunk_length_stats(spark, d):
    stats = chunking.chunk_stats(document_chunks(spark, d), "section")
    return stats.select("section", *[F.col(c).cast("bigint").alias(c) for c in stats.columns[1:]])


@query
def chunk_samples(spark, d):
    chunks = document_chunks(spark, d)
    sizes = chunks.groupBy("ticker", "filing_date").agg(F.count("*").alias("n"))
    return chunking.sample_chunks(chunks, sizes).select(
        "chunk_id", F.col("length").cast("bigint").alias("length"), "head", "tail"
    )


@query
def document_length_stats(spark, d):
    stats = chunking.chunk_stats(corpus(spark, d), "section")
    return stats.select("section", *[F.col(c).cast("bigint").alias(c) for c in stats.columns[1:]])


# --- lexical ----------------------------------------------------------------


@query
def inverted_index(spark, d):
    rows = lexical.postings(index(spark, d).docs)
    return rows.select(
        "term", "id", F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl")
    )


@query
def term_stats(spark, d):
    return lexical.term_stats(index(spark, d).docs).select("term", "df", F.round("idf", 9).alias("idf"))


@query
def corpus_stats(spark, d):
    return lexical.corpus_stats(index(spark, d).docs).select("n", F.round("avgdl", 6).alias("avgdl"))


@query
def token_document_frequency(spark, d):
    found = index(spark, d).document_frequencies(asked(spark, d))
    return found.select("query_id", F.col("position").cast("bigint").alias("position"), "term", "df")


@query
def rare_token_gate(spark, d):
    return index(spark, d, STRICT).looks_lexical(asked(spark, d))


def bm25_rows(hits):
    return hits.select(
        "query_id", F.col("bm25_rank").cast("bigint").alias("bm25_rank"), "id", r6("bm25_score")
    )


@query
def bm25_topk(spark, d):
    return bm25_rows(index(spark, d).search(asked(spark, d), 10))


@query
def bm25_filtered(spark, d):
    return bm25_rows(index(spark, d).search(asked(spark, d, "de"), 10))


@query
def bm25_stored_index(spark, d):
    path = scratch_path(spark, "index")
    lexical.write_index(index(spark, d).docs, path, buckets=8)
    return bm25_rows(lexical.StoredIndex(spark, path, SETTINGS).search(asked(spark, d), 10))


@query
def stored_bm25_pruned(spark, d):
    path = scratch_path(spark, "impact")
    write_impact_index(index(spark, d).docs, path, SETTINGS, buckets=8)
    return bm25_rows(ImpactIndex(spark, path).search(asked(spark, d), 10))


@query
def stored_bm25_pruned_filtered(spark, d):
    path = scratch_path(spark, "impact")
    write_impact_index(index(spark, d).docs, path, SETTINGS, buckets=8)
    return bm25_rows(ImpactIndex(spark, path).search(asked(spark, d, "de"), 10))


@query
def chunk_bm25(spark, d):
    """Chunk, index and search in one go."""
    chunks = document_chunks(spark, d).select(
        F.col("chunk_id").alias("id"), F.substring("ticker", 1, 2).alias("ticker"), "text"
    )
    return bm25_rows(LexicalIndex.from_text(chunks, SETTINGS).search(asked(spark, d), 10))


# --- vectors ------------------------------------------------------------------


@query
def vector_stats(spark, d):
    v = F.col("embedding")
    return spread(table(spark, d, "embeddings"), "vec_id").select(
        "vec_id",
        F.size(v).cast("bigint").alias("dim"),
        F.round(l2_norm(v), 6).alias("norm"),
        F.array_join(
            F.transform(F.slice(v, 1, 8), lambda x: F.bround(x.cast("double") * 10000).cast("bigint").cast("string")), ","
        ).alias("first8"),
    )


@query
def hashed_embeddings(spark, d):
    units = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("bigint").cast("string"))
    return embedded(spark, d).select("id", F.array_join(units, ",").alias("micro_units"))


def vector_store(spark, d):
    return spread(table(spark, d, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("ticker"), "embedding"
    )


def centroids(spark, d, filtered):
    """One question per label: the mean of its vectors, at length one."""
    means = (
        table(spark, d, "embeddings")
        .select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).getField("x").alias("m"))
    )
    unit = F.transform("m", lambda x: x / l2_norm(F.col("m")))
    label = F.col("label").cast("string")
    return Questions.of(
        means.select(
            F.col("label").alias("query_id"),
            F.to_json(unit).alias("question"),
            (label if filtered else F.lit(None).cast("string")).alias("company"),
        )
    )


def centroid():
    return F.from_json("question", "array<double>")


def dense_rows(ranked):
    return ranked.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id", r6("similarity")
    )


@query
def dense_topk(spark, d):
    return dense_rows(
        dense_top_k(vector_store(spark, d), centroids(spark, d, False), 10, centroid())
    )


@query
def dense_topk_filtered(spark, d):
    return dense_rows(
        dense_top_k(vector_store(spark, d), centroids(spark, d, True), 10, centroid())
    )


@query
def dense_text_topk(spark, d):
    ranked = dense(spark, d).retrieve(asked(spark, d), 10)
    labelled = ranked.withColumn("band", tx.confidence_label(F.col("similarity"))).withColumn(
        "bar", tx.similarity_bar(F.col("similarity"))
    )
    return dense_rows(ranked).join(labelled.select("query_id", "id", "band", "bar"), ["query_id", "id"])


@query
def mmr(spark, d):
    asked_for = centroids(spark, d, False)
    store = vector_store(spark, d)
    pool = dense_top_k(store, asked_for, SETTINGS.pool, centroid())
    pool = store.select("id", "embedding").join(asked_for.small(pool, SETTINGS.pool), "id")
    picked = mmr_select(pool.select("query_id", "rank", "id", "similarity", "embedding"), 10, 0.3)
    return dense_rows(picked).join(
        picked.select("query_id", "id", F.col("mmr_rank").cast("bigint").alias("mmr_rank")),
        ["query_id", "id"],
    )


# --- fusion and composition -----------------------------------------------


def fused_rows(ranked):
    whole = ["rank", "dense_rank", "bm25_rank"]
    return ranked.select(
        "query_id",
        "id",
        *[F.col(c).cast("bigint").alias(c) for c in whole],
        r6("similarity"),
        r6("bm25_score"),
        F.round("rrf_score", 9).alias("rrf_score"),
        "fusion",
    )


@query
def hybrid_rrf(spark, d):
    r = HybridRetriever(dense(spark, d), index(spark, d), SETTINGS, fusion="rrf")
    return fused_rows(r.retrieve(asked(spark, d), 10))


@query
def hybrid_interleave(spark, d):
    r = HybridRetriever(dense(spark, d), index(spark, d), SETTINGS, fusion="interleave")
    return fused_rows(r.retrieve(asked(spark, d), 10))


@query
def hybrid_gated(spark, d):
    r = HybridRetriever(
        dense(spark, d), index(spark, d, STRICT), STRICT, fusion="interleave", gated=True
    )
    return fused_rows(r.retrieve(asked(spark, d), 10))


@query
def round_robin_sources(spark, d):
    """Per language, its sources' documents longest first, dealt out by turns."""
    place = Window.partitionBy("ticker", "section").orderBy(F.desc("n"), "id")
    ranked = (
        corpus(spark, d)
        .select("ticker", "section", "id", F.length("text").alias("n"))
        .withColumn("rank", F.row_number().over(place))
        .filter(F.col("rank") <= 20)
    )
    lists = ranked.select(
        F.col("ticker").alias("query_id"), F.col("section").alias("list_no"), "rank", "id"
    )
    return round_robin(lists, 20).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id"
    )


@query
def company_decomposition(spark, d):
    r = CompanyDecomposition(dense(spark, d), COMPANIES)
    return dense_rows(r.retrieve(asked(spark, d), 10))


@query
def query_split(spark, d):
    r = RewriteRetriever(dense(spark, d), sentence_rewrites(spark, d))
    return dense_rows(r.retrieve(asked(spark, d), 10))


@query
def query_split_filtered(spark, d):
    splits = sentence_rewrites(spark, d)
    r = RewriteRetriever(dense(spark, d), splits, companies=COMPANIES)
    return dense_rows(r.retrieve(asked(spark, d), 10))


@query
def aspect_expansion(spark, d):
    hybrid = HybridRetriever(dense(spark, d), index(spark, d), SETTINGS, fusion="interleave")
    r = RewriteRetriever(hybrid, sentence_rewrites(spark, d))
    return dense_rows(r.retrieve(asked(spark, d), 10))


@query
def full_stack_topk(spark, d):
    aspects = sentence_rewrites(spark, d)
    r = full_stack(dense(spark, d), index(spark, d, STRICT), aspects, STRICT, COMPANIES)
    return dense_rows(r.retrieve(asked(spark, d), 5))


@query
def rerank_topk(spark, d):
    base = dense(spark, d)
    r = RerankRetriever(base, base, token_overlap, SETTINGS)
    ranked = r.retrieve(asked(spark, d), 10)
    return dense_rows(ranked).join(
        ranked.select("query_id", "id", F.round("rerank_score", 9).alias("rerank_score")),
        ["query_id", "id"],
    )


@query
def compare_filter_arms(spark, d):
    arms = compare_arms(dense(spark, d), asked(spark, d, "fr"), 5)
    return arms.select(
        "query_id",
        "id",
        *[F.col(c).cast("bigint").alias(c) for c in ("filtered_rank", "open_rank")],
        r6("filtered_sim"),
        r6("open_sim"),
    )


@query
def result_ticker_breakdown(spark, d):
    base = dense(spark, d)
    batch = asked(spark, d)
    ranked = base.attach(base.retrieve(batch, 10), batch, 10, "ticker")
    return ranked.groupBy("query_id", "ticker").agg(F.count("*").alias("n"))


def pooled(spark, d, depth=20):
    base = dense(spark, d)
    hybrid = HybridRetriever(base, index(spark, d), SETTINGS, fusion="interleave")
    batch = asked(spark, d)
    pool = pool_union([base.retrieve(batch, depth), hybrid.retrieve(batch, depth)])
    return written(pool, "pool")


@query
def candidate_pool(spark, d):
    return pooled(spark, d).select(
        "query_id", "id", F.col("pool_rank").cast("bigint").alias("pool_rank")
    )


# --- evaluation and judging ----------------------------------------------------


@query
def golden_answer_key(spark, d):
    return golden(spark, d)[1]


@query
def short_question_key(spark, d):
    """The first nine characters of each question, down to the last document that holds them."""
    items = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 9).alias("text"))
    return containing(corpus(spark, d), items)


def score_rows(scores):
    return scores.select(
        "query_id",
        "category",
        r6("top1"),
        "control",
        "recall_reliable",
        "n_relevant",
        F.col("hit5").cast("bigint").alias("hit5"),
        r6("recall5"),
        r6("recall_pool"),
        r6("mrr"),
        joined("missed5").alias("missed5"),
    )


def mean_rows(means):
    return means.select(
        "category", "n", "n_rel", r6("hit5"), r6("mrr"), r6("recall5"), r6("recall_pool")
    )


def dense_scores(spark, d):
    questions, key = golden(spark, d)
    return metrics.evaluate(dense(spark, d).retrieve(asked(spark, d), 10), questions, key, 10)


def hybrid_scores(spark, d):
    questions, key = golden(spark, d)
    r = HybridRetriever(dense(spark, d), index(spark, d), SETTINGS, fusion="interleave")
    return metrics.evaluate(r.retrieve(asked(spark, d), 10), questions, key, 10)


@query
def eval_dense(spark, d):
    return score_rows(dense_scores(spark, d))


@query
def eval_hybrid(spark, d):
    return score_rows(hybrid_scores(spark, d))


@query
def eval_dense_means(spark, d):
    return mean_rows(metrics.aggregate(dense_scores(spark, d)))


@query
def eval_hybrid_means(spark, d):
    return mean_rows(metrics.aggregate(hybrid_scores(spark, d)))


@query
def eval_report(spark, d):
    scores = dense_scores(spark, d)
    lines = metrics.report_lines(scores, 10).select(F.col("query_id").cast("string").alias("label"), "line")
    totals = metrics.summary_lines(mean_rows(metrics.aggregate(scores)), 10)
    return lines.unionByName(
        totals.select(F.coalesce("category", F.lit("overall")).alias("label"), "line")
    )


@query
def negative_controls(spark, d):
    return metrics.control_note(dense_scores(spark, d)).select("query_id", r6("top1"), "note")


@query
def relevant_placements(spark, d):
    base = dense(spark, d)
    r = RerankRetriever(base, base, token_overlap, SETTINGS)
    ranked = r.retrieve(asked(spark, d), SETTINGS.pool)
    return metrics.rank_lookup(ranked, golden(spark, d)[1])


def quality_verdicts(spark, d, pool):
    """Every pooled or keyed pair judged by its document's quality label."""
    labels = table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("relevant")
    )
    pairs = pool.select("query_id", "id").unionByName(golden(spark, d)[1]).distinct()
    return pairs.join(labels, "id")


@query
def judge_validation(spark, d):
    questions, key = golden(spark, d)
    pool = pooled(spark, d)
    rows = judge.validate(questions, key, pool, quality_verdicts(spark, d, pool), SETTINGS)
    return rows.select(
        "query_id", "category", "n_right", "n_recovered", joined("missed").alias("missed"),
        "n_neg", joined(F.coalesce("false_accepts", F.array().cast("array<bigint>"))).alias("false_accepts"),
    )


@query
def judge_verdict(spark, d):
    questions, key = golden(spark, d)
    pool = pooled(spark, d)
    rows = judge.validate(questions, key, pool, quality_verdicts(spark, d, pool), SETTINGS)
    return judge.verdict(rows, SETTINGS).select(
        "tot_right", "tot_recovered", "tot_wrong", "tot_false_acc",
        r6("recovery"), r6("false_rate"), "passed",
    )


def completed_keys(spark, d):
    questions, key = golden(spark, d)
    pool = pooled(spark, d)
    return judge.complete_key(questions, key, pool, quality_verdicts(spark, d, pool)), pool


@query
def key_completion(spark, d):
    completed, pool = completed_keys(spark, d)
    rows = judge.sidecar(completed, pool, golden(spark, d)[0])
    names = ["hand_key", "judged_relevant", "new_key", "added"]
    return rows.select("query_id", "pool_size", *[joined(n).alias(n) for n in names])


@query
def key_overlay_means(spark, d):
    questions, key = golden(spark, d)
    completed, _ = completed_keys(spark, d)
    questions, key = judge.overlay(questions, key, completed)
    ranked = dense(spark, d).retrieve(asked(spark, d), 10)
    return mean_rows(metrics.aggregate(metrics.evaluate(ranked, questions, key, 10)))


# --- grounding ---------------------------------------------------------------


def evidence(spark, d, k=5):
    base, batch = dense(spark, d), asked(spark, d)
    ranked = base.attach(base.retrieve(batch, k), batch, k, "ticker", "section", "text")
    return ranked, batch.df


@query
def prompt_assembly(spark, d):
    made = grounding.prompts(*evidence(spark, d), SETTINGS)
    return made.select("query_id", r6("top_sim"), "band", joined("provided").alias("provided"), "turn")


@query
def grounded_answers(spark, d):
    """Answers that quote a question and cite its number and two documents."""
    made = grounding.prompts(*evidence(spark, d), SETTINGS)
    answers = made.select(
        "query_id",
        F.concat(
            F.lit("  "), "question", F.lit(" ["), F.get("provided", F.lit(0)), F.lit("]["),
            F.get("provided", F.lit(2)), F.lit("] [n-"), F.col("query_id").cast("string"), F.lit("]\n"),
        ).alias("answer"),
    )
    return grounding.grounded_answers(made, answers, SETTINGS).select(
        "query_id", "answer", "refused", joined("citations").alias("citations"),
        joined("unknown_citations").alias("unknown_citations"), r6("top_sim"), "model", "hard_gated",
    )


@query
def citation_audit(spark, d):
    """Assistant turns that cite turns of their conversation, one of them unknown."""
    said = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    cite = F.format_string(
        "%s [c%d-%d] see [c%d-%d][Reserved]", "text", "conv_id", "turn", "conv_id", F.col("turn") + 100
    )
    provided = F.transform(
        F.sequence(F.lit(0), F.lit(9)), lambda i: F.format_string("c%d-%d", F.col("conv_id"), i)
    )
    checked = said.select("conv_id", "turn", grounding.audit(cite, provided).alias("a"))
    return checked.select(
        "conv_id", "turn", joined("a.citations").alias("citations"),
        joined("a.unknown_citations").alias("unknown_citations"), "a.refused",
    )


@query
def seed_prompts(spark, d):
    ranked, questions = evidence(spark, d, SETTINGS.seed_pool)
    return grounding.seed_prompts(ranked, questions, SETTINGS).select("query_id", "turn")


@query
def judge_prompts(spark, d):
    ranked, questions = evidence(spark, d)
    turn = grounding.judge_turn(F.col("question"), F.col("ticker"), F.col("text"), SETTINGS)
    return ranked.join(questions.select("query_id", "question"), "query_id").select(
        "query_id", "id", turn.alias("turn")
    )


# --- sources and the collection --------------------------------------------------


@query
def resolve_tickers(spark, d):
    """Customers as the ticker file (segment as ticker, so repeats occur)."""
    entries = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("k"),
        F.struct(
            F.col("c_custkey").alias("cik_str"),
            F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("ticker"),
            F.col("c_name").alias("title"),
        ).alias("v"),
    )
    lines = entries.select(F.to_json(F.map_from_arrays(F.array("k"), F.array("v"))).alias("value"))
    mapping = filings.ticker_map(lines)
    wanted = mapping.select(F.lower("ticker").alias("ticker")).distinct()
    return filings.resolve_tickers(wanted, mapping)


@query
def latest_annual_reports(spark, d):
    """Customers as companies, their orders as filings, newest first."""
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    filed = table(spark, d, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        F.row_number().over(newest).alias("position"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "10-K")
        .when(F.col("o_orderpriority") == "2-HIGH", "10-K/A")
        .otherwise("8-K")
        .alias("form"),
        F.format_string("%010d-%s-%06d", F.lit(1), F.date_format("o_orderdate", "yy"), "o_orderkey")
        .alias("accession_number"),
        F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primary_doc"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"),
    )
    annual = filed.filter(F.col("form") == "10-K").select("cik").distinct()
    companies = (
        table(spark, d, "customer")
        .select(
            F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
            F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"),
            F.col("c_name").alias("company_name"),
        )
        .join(annual, "cik", "left_semi")
    )
    return filings.latest_annual_report(companies, filed)


def page_chunks(spark, d):
    return spread(table(spark, d, "pages"), "page_id").select(
        (F.col("page_id") * 2).alias("id"),
        F.upper(F.regexp_extract("url", "/([a-z]{2})/", 1)).alias("ticker"),
        F.lit("web").alias("section"),
        F.col("url").alias("text"),
    )


@query
def upsert_rows(spark, d):
    """Web pages put into the collection over documents of the same number."""
    rows = upserted(corpus(spark, d), page_chunks(spark, d))
    return rows.select("id", "ticker", "section", F.md5("text").alias("digest"))


@query
def upsert_pruned(spark, d):
    rows = upserted(corpus(spark, d), page_chunks(spark, d), prune_within="ticker")
    return rows.select("id", "ticker", "section", F.md5("text").alias("digest"))


@query
def stored_collection(spark, d):
    """Written, upserted and read back; documents first, then some pages."""
    store = Collection(spark, scratch_path(spark, "collection"), buckets=4)
    store.upsert(corpus(spark, d))
    again = corpus(spark, d).select("id", "ticker", "section", F.concat("text", F.lit("!")).alias("text"))
    store.upsert(again.filter(F.col("section") == "src1"))
    return store.read().select("id", "ticker", "section", F.md5("text").alias("digest"))


@query
def collection_counts(spark, d):
    counts = ticker_counts(corpus(spark, d), SETTINGS.tickers)
    return counts.select(F.coalesce("ticker", F.lit("(all)")).alias("ticker"), "chunks")


@query
def collection_sample(spark, d):
    sample = corpus(spark, d).orderBy("id").limit(3)
    return sample.select("id", "ticker", F.length("text").cast("bigint").alias("chars"))


@query
def chunk_files(spark, d):
    """Chunks written as JSON lines and read back."""
    path = scratch_path(spark, "chunks")
    readers.write_chunks(document_chunks(spark, d), path)
    return readers.read_chunks(spark, path).select(
        "id", "section", F.col("char_start").cast("bigint").alias("char_start"), F.md5("text").alias("digest")
    )


@query
def rewrite_cache(spark, d):
    """A rewrite cache per question written as JSON text and read back."""
    path = scratch_path(spark, "rewrites")
    lists = table(spark, d, "benchmark").select(
        F.map_from_arrays(
            F.array(F.lit("recorded")),
            F.array(F.map_from_arrays(F.array("text"), F.array(F.split("text", r"\. ")))),
        ).alias("m")
    )
    lists.select(F.to_json("m").alias("value")).repartition(4).write.text(path)
    found = spark.read.text(path)
    rewrites = adapters.each_rewrite(readers.parse_rewrites(found), "recorded")
    return rewrites.select("question", F.col("position").cast("bigint").alias("position"), "rewrite")


@query
def streamed_collection(spark, d):
    """Chunk files followed as a stream into a collection."""
    inbox = scratch_path(spark, "inbox")
    by_language = document_chunks(spark, d).withColumn("ticker", F.substring("ticker", 1, 2))
    readers.write_chunks(by_language, inbox)
    store = Collection(spark, scratch_path(spark, "collection"), buckets=2)
    store_path = scratch_path(spark, "progress")
    follow_chunks(spark, inbox, store, store_path).awaitTermination()
    return store.read().select("id", "section", F.md5("text").alias("digest"))


# --- a collection that grows, and its index ------------------------------------------


def grown_collection(spark, d, embedder=None) -> Collection:
    """All documents; then those of one source cut to their first half; then the French ones under a new
    ticker. Compacted after each step, so that parts of all ages are there."""
    store = Collection(spark, scratch_path(spark, "collection"), buckets=4)
    docs = corpus(spark, d)
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    store.upsert(docs, embedder)
    store.upsert(docs.filter("section = 'src1'").withColumn("text", half), embedder)
    store.compact(fan=2)
    french = store.read("FR").drop("embedding", "bucket").withColumn("ticker", F.lit("XX"))
    store.upsert(french, embedder)
    store.compact(fan=3)
    return store


def segmented(spark, store, settings=SETTINGS) -> SegmentedIndex:
    index = SegmentedIndex(store, scratch_path(spark, "segments"), settings, buckets=8)
    index.refresh()
    return index


@query
def upsert_new_ticker(spark, d):
    """Ids that come in under another ticker are nowhere else."""
    rows = grown_collection(spark, d).read()
    return rows.select("id", "ticker", "section", F.md5("text").alias("digest"))


@query
def compacted_collection(spark, d):
    """Language by language in parts; the English ones again, of them only the longer half; then
    merged and the old versions dropped."""
    store = Collection(spark, scratch_path(spark, "collection"), buckets=4)
    docs = corpus(spark, d)
    for language in ("DE", "EN", "ES", "FR"):
        store.upsert(docs.filter(F.col("ticker") == language))
    longer = docs.filter("ticker = 'EN' and length(text) >= 1000").withColumn("text", F.concat("text", F.lit("!")))
    store.upsert(longer, prune=True)
    store.compact(fan=2)
    store.vacuum()
    return store.read().select("id", "ticker", "section", F.md5("text").alias("digest"))


@query
def stored_counts(spark, d):
    """Counts of the grown collection, from its log."""
    counts = with_total(grown_collection(spark, d).counts(), (*SETTINGS.tickers, "XX"))
    return counts.select(F.coalesce("ticker", F.lit("(all)")).alias("ticker"), "chunks")


@query
def collection_version(spark, d):
    """The first version, read after two more upserts."""
    rows = grown_collection(spark, d).read(version=1)
    return rows.select("id", "ticker", "section", F.md5("text").alias("digest"))


@query
def segmented_term_stats(spark, d):
    """df of all terms after an index followed three upserts and the merging of its parts, one by one."""
    store = Collection(spark, scratch_path(spark, "collection"), buckets=4)
    index = SegmentedIndex(store, scratch_path(spark, "segments"), SETTINGS, buckets=8)
    docs = corpus(spark, d)
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    french = docs.filter("ticker = 'FR'").withColumn("ticker", F.lit("XX"))
    french = french.withColumn("text", F.when(F.col("section") == "src1", half).otherwise(F.col("text")))
    for rows in (docs, docs.filter("section = 'src1'").withColumn("text", half), french):
        store.upsert(rows)
        index.refresh()
        store.compact(fan=2)
        index.refresh()
    return index.frequencies()


@query
def segmented_bm25(spark, d):
    store = grown_collection(spark, d)
    return bm25_rows(segmented(spark, store).search(asked(spark, d), 10))


@query
def segmented_bm25_filtered(spark, d):
    store = grown_collection(spark, d)
    return bm25_rows(segmented(spark, store).search(asked(spark, d, "xx"), 10))


@query
def stored_dense_topk(spark, d):
    """Nearest vectors, read back from a collection."""
    store = Collection(spark, scratch_path(spark, "collection"), buckets=4)
    store.upsert(vector_store(spark, d))
    return dense_rows(dense_top_k(store.read(), centroids(spark, d, False), 10, centroid()))


@query
def stored_hybrid_gated(spark, d):
    """Gated hybrid over stored vectors and a stored index."""
    store = Collection(spark, scratch_path(spark, "collection"), buckets=4)
    store.upsert(corpus(spark, d), EMBEDDER)
    r = HybridRetriever(
        DenseRetriever.over(store, EMBEDDER), segmented(spark, store, STRICT), STRICT,
        fusion="interleave", gated=True,
    )
    return fused_rows(r.retrieve(asked(spark, d), 10))


@query
def replayed_batches(spark, d):
    """Two batches of a stream, the first one sent again after the second."""
    store = Collection(spark, scratch_path(spark, "collection"), buckets=2)
    docs = corpus(spark, d).withColumn("file_time", F.lit(1)).withColumn("file_name", F.col("section"))
    later = docs.filter("section = 'src3'").withColumn("text", F.concat("text", F.lit("?")))
    for rows, number in ((docs, 0), (later, 1), (docs, 0)):
        take_batch(store, rows, number, "stream")
    return store.read().select("id", "ticker", "section", F.md5("text").alias("digest"))


# --- files of the stages ----------------------------------------------------------------


@query
def collection_peek(spark, d):
    """A sample of the grown collection."""
    sample = grown_collection(spark, d).peek(3)
    return sample.select("id", "ticker", F.length("text").cast("bigint").alias("chars"))


@query
def golden_file(spark, d):
    """A golden set as a file of JSON lines, read back with its defaults."""
    path = scratch_path(spark, "golden")
    items = table(spark, d, "benchmark")
    key = containing(corpus(spark, d), items).groupBy("query_id").agg(F.collect_list(F.col("id").cast("string")).alias("relevant_ids"))
    lines = items.withColumnRenamed("item_id", "id").join(key.withColumnRenamed("query_id", "id"), "id", "left").select(
        F.col("id").cast("int").alias("id"), F.col("text").alias("question"),
        F.lit("found").alias("category"), F.coalesce("relevant_ids", F.array().cast("array<string>")).alias("relevant_ids"),
        F.when(F.col("id") % 3 == 0, F.lit(False)).alias("recall_reliable"),
    )
    lines.write.json(path)
    golden_set = readers.read_golden(spark, path)
    keyed = metrics.golden_key(golden_set).groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return metrics.golden_questions(golden_set).join(keyed, "query_id", "left").select(
        F.col("query_id").cast("bigint").alias("query_id"), "question", "recall_reliable", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant")
    )


@query
def filing_files(spark, d):
    """Reports cut into items, written as filings by ticker and read back."""
    path = scratch_path(spark, "filings")
    cut = target_sections(F.col("slices"), SETTINGS.section_min_chars)
    filed = reports(spark, d).withColumn("slices", item_slices(F.col("clean"))).select(
        "ticker", F.col("id").cast("string").alias("accession_number"), cut.alias("sections")
    )
    readers.write_filings(filed, path)
    read = readers.read_filings(spark, path).select("ticker", "accession_number", F.explode("sections").alias("s"))
    return read.select(
        "ticker", F.col("accession_number").cast("bigint").alias("id"), "s.section", F.md5("s.text").alias("digest")
    )


@query
def sidecar_file(spark, d):
    """Completed keys written as a sidecar and read back, a row for each id."""
    path = scratch_path(spark, "sidecar")
    completed, pool = completed_keys(spark, d)
    readers.write_sidecar(judge.sidecar(completed, pool, golden(spark, d)[0]), path, "recorded", 20)
    return readers.read_sidecar(spark, path).select(
        F.col("query_id").cast("bigint").alias("query_id"), F.col("id").cast("bigint").alias("id")
    )
