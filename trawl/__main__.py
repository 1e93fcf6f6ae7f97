"""Command line: python -m trawl COMMAND ...

Everything lives under --data: tickers.json, submissions/, pages/, clean/,
chunks/, collection/, golden.jsonl, caches and the judge's sidecar.
"""

import argparse
import dataclasses
import json
import os

from pyspark.sql import functions as F

from trawl.config import REFUSAL_TEXT, Settings, model_name
from trawl.functions import text as tx
from trawl.functions.automaton import named_companies
from trawl.functions.vectors import HashedTokens, SentenceModel, dot, l2_norm
from trawl.operators import chunking, grounding, judge as judging, metrics
from trawl.operators.fusion import pool_union
from trawl.operators.questions import Questions, broadcast_if_small
from trawl.plans.retrievers import (
    CompanyDecomposition, DenseRetriever, HybridRetriever, MMRRetriever, RerankRetriever,
    RewriteRetriever, compare_arms, cross_encoder, token_overlap,
)
from trawl.session import build_session, written
from trawl.sources import adapters, clients, filings, readers
from trawl.sources.collection import Collection, with_total
from trawl.sources.segments import SegmentedIndex

ALL_ROWS = 1 << 30  # a report is shown whole


class Workspace:
    def __init__(self, args):
        self.args = args
        self.root = args.data.rstrip("/")
        self.spark = build_session()
        self.settings = Settings(user_agent=os.environ.get("SEC_USER_AGENT", "").strip())
        hashed = args.embedder == "hashed"
        self.embedder = HashedTokens() if hashed else SentenceModel(self.settings)
        self.collection = Collection(self.spark, f"{self.root}/collection")

    def path(self, *parts):
        return "/".join((self.root, *parts))

    def questions(self, question, company=None):
        row = [(1, question, company)]
        return Questions.of(
            self.spark.createDataFrame(row, "query_id int, question string, company string")
        )

    def dense(self):
        return DenseRetriever.over(self.collection, self.embedder)

    def index(self):
        """The stored index, brought up to what the collection holds."""
        index = SegmentedIndex(self.collection, f"{self.root}/index", self.settings)
        index.refresh()
        return index

    def rewrites(self, name, model, prompts, limit, call):
        """Recorded rewrites, completed by calls under --live."""
        table = self.path(f"{name}_calls")
        known = readers.read_rewrites(self.spark, self.path(f"{name}_cache.json"))

        def recorded():
            return known.unionByName(adapters.saved(self.spark, table, adapters.REWRITES))

        if self.args.live:
            adapters.record_rewrites(prompts, recorded(), model, limit, call(model), table)
        return adapters.each_rewrite(recorded(), model)

    def aspects(self, base, questions, model):
        """Aspects per question; a live call sees the question's seed chunks."""
        s = self.settings
        prompts = None
        if self.args.live:
            seeds = base.retrieve(questions, s.seed_pool).select("query_id", "rank", "id")
            seeds = self.dense().attach(seeds, questions, s.seed_pool, "text")
            prompts = grounding.seed_prompts(seeds, questions.df, s).select("question", "turn")
        return self.rewrites("expand", model, prompts, s.max_aspects, clients.aspect_call)

    def splits(self, questions, model):
        turn = F.concat(F.lit("Question: "), "question").alias("turn")
        prompts = questions.df.select("question", turn)
        return self.rewrites(
            "decomp", model, prompts, self.settings.max_subqueries, clients.split_call
        )

    def stack(self, questions):
        base, s = self.dense(), self.settings
        inner = CompanyDecomposition(
            HybridRetriever(base, self.index(), s, fusion="interleave", gated=True), s.companies
        )
        return RewriteRetriever(inner, self.aspects(inner, questions, s.rewrite_model))

    def described(self, ranked, questions, k):
        """Ranked rows with what a reader wants to see of each chunk."""
        whole = self.dense().attach(ranked, questions, k, "ticker", "section", "text")
        return whole.select(
            "query_id", "rank", "id", F.round("similarity", 4).alias("similarity"), "ticker",
            "section", tx.preview(F.col("text")).alias("preview"),
        ).orderBy("query_id", "rank")


def ingest(ws):
    spark, s = ws.spark, ws.settings
    wanted = spark.createDataFrame([(ws.args.ticker,)], ["ticker"])
    mapping = filings.ticker_map(spark.read.text(ws.path("tickers.json"), wholetext=True))
    companies = filings.resolve_tickers(wanted, mapping)
    files = spark.read.text(ws.path("submissions"), wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"(\d{10})", 1).alias("cik"), "value"
    )
    report = filings.latest_annual_report(companies, filings.submissions(files))
    pages = readers.read_pages(spark, ws.path("pages"))
    missing = filings.cache_misses(report, pages)
    if missing.limit(1).count():
        filings.fetch_pages(missing, s).write.mode("append").parquet(ws.path("pages"))
        pages = readers.read_pages(spark, ws.path("pages"))
    pages = pages.select("accession_number", "html")
    parsed = filings.parse_filings(report.join(pages, "accession_number"), s)
    parsed.write.mode("overwrite").json(ws.path("clean", ws.args.ticker.upper()))
    parsed.select(
        "ticker", "company_name", "filing_date", F.explode("sections").alias("s")
    ).select("ticker", "company_name", "filing_date", "s.section", F.length("s.text").alias("chars")).show(
        truncate=False
    )


def chunk(ws):
    ticker = ws.args.ticker.upper()
    filed = readers.read_filings(ws.spark, ws.path("clean", ticker))
    chunks = chunking.chunk_filings(filed, ws.settings)
    readers.write_chunks(chunks, ws.path("chunks", f"ticker={ticker}"))
    made = written(chunks, "chunks")
    chunking.chunk_stats(made, "ticker").show(ALL_ROWS)
    chunking.chunk_stats(made, "section").show(ALL_ROWS, False)
    sizes = made.groupBy("ticker", "filing_date").agg(F.count("*").alias("n"))
    chunking.sample_chunks(made, sizes).show(vertical=True, truncate=False)


def embed(ws):
    texts = ws.spark.createDataFrame(list(enumerate(ws.args.text)), "n int, text string")
    query = ws.embedder.questions(F.col("text"))
    if len(ws.args.text) == 1:
        v = texts.select(query.alias("v"))
        v.select(
            F.size("v").alias("dim"), F.slice("v", 1, 8).alias("first8"), l2_norm("v").alias("norm")
        ).show(truncate=False)
        return
    first = F.lit(texts.filter("n = 0").select(query).first()[0])
    sims = texts.filter("n > 0").select(
        "text", dot(ws.embedder.documents(F.col("text")), first).alias("similarity")
    )
    sims.select(
        F.round("similarity", 4).alias("similarity"), tx.similarity_bar(F.col("similarity")).alias("bar"), "text"
    ).orderBy(F.desc("similarity")).show(len(ws.args.text), truncate=False)


def build(ws, ticker=None):
    path = ws.path("chunks", f"ticker={ticker}") if ticker else ws.path("chunks", "*")
    n = ws.collection.upsert(readers.read_chunks(ws.spark, path), ws.embedder)
    ws.collection.compact()
    ws.index()
    print(f"upserted {n} chunks; the collection holds {ws.collection.count()}")


def store(ws):
    build(ws, ws.args.ticker.upper())


def inspect(ws):
    with_total(ws.collection.counts(), ws.settings.tickers).show(ALL_ROWS)
    ws.collection.peek(1).drop("embedding").show(vertical=True, truncate=140)


def retrieve(ws):
    a, s = ws.args, ws.settings
    questions = ws.questions(a.question, a.company)
    named = named_companies(F.col("question"), s.companies)
    if questions.df.filter(tx.filter_mismatch(F.col("company"), named)).count():
        print(f"WARNING: the question names other companies than {a.company}; the filter wins.")
    if a.compare:
        if not a.company:
            raise SystemExit("--compare needs --company")
        compare_arms(ws.dense(), questions, a.k).orderBy("filtered_rank", "open_rank").show(2 * a.k, False)
        return
    ranked = written(ws.dense().retrieve(questions, a.k), "ranked")
    ranked.filter("rank = 1").select(
        F.round("similarity", 4).alias("top1"), tx.confidence_label(F.col("similarity")).alias("band")
    ).show(truncate=False)
    ws.described(ranked, questions, a.k).show(a.k, False)


def ask(ws):
    a, s = ws.args, ws.settings
    k = a.k or s.top_k
    questions = ws.questions(a.question, a.company)
    ranked = written(ws.stack(questions).retrieve(questions, k), "ranked")
    evidence = ws.dense().attach(
        ranked.select("query_id", "rank", "id", "similarity"), questions, k, "ticker", "section", "text"
    )
    prompted = written(grounding.prompts(evidence, questions.df, s), "prompts")
    if not a.live:
        prompted.select("band", "top_sim", "turn").show(vertical=True, truncate=False)
        return
    rules = clients.ANSWER_RULES.format(refusal=REFUSAL_TEXT)
    call = clients.text_call(s.answer_model, rules)
    answers = written(adapters.answers(prompted, call), "answers")
    grounding.grounded_answers(prompted, answers, s).show(vertical=True, truncate=False)


def golden_set(ws):
    golden = readers.read_golden(ws.spark, ws.path("golden.jsonl"))
    return metrics.golden_questions(golden), metrics.golden_key(golden)


def evaluate(ws):
    a = ws.args
    s = dataclasses.replace(
        ws.settings,
        pool=ws.settings.pool if a.candidates is None else a.candidates,
        rrf_k=ws.settings.rrf_k if a.rrf_k is None else a.rrf_k,
        fusion=a.fusion or ws.settings.fusion,
        mmr_lambda=ws.settings.mmr_lambda if a.mmr_lambda is None else a.mmr_lambda,
        rerank_model=model_name(a.reranker),
    )
    depth = s.eval_depth if a.depth is None else a.depth
    questions, key = golden_set(ws)
    if a.judge_key:
        completed = readers.read_sidecar(ws.spark, ws.path("judge_keys"))
        questions, key = judging.overlay(questions, key, completed)
    batch = Questions.of(questions)
    base = dense = ws.dense()
    if a.mmr:
        base = MMRRetriever(dense, s)
    if a.rerank:
        scorer = token_overlap if a.reranker == "overlap" else cross_encoder(s)
        base = RerankRetriever(base, dense, scorer, s)
    if a.hybrid:
        base = HybridRetriever(base, ws.index(), s, gated=a.hybrid_gate)
    if a.decompose:
        base = CompanyDecomposition(base, s.companies)
    if a.llm_decompose:
        splits = ws.splits(batch, model_name(a.decomposer or "haiku"))
        base = RewriteRetriever(base, splits, s.companies if a.sub_filter else None)
    if a.expand:
        base = RewriteRetriever(base, ws.aspects(base, batch, model_name(a.expander or "haiku")))
    scores = written(metrics.evaluate(base.retrieve(batch, depth), questions, key, depth), "scores")
    metrics.report_lines(scores, depth).orderBy("query_id").show(ALL_ROWS, False)
    metrics.summary_lines(metrics.aggregate(scores), depth).orderBy("category").show(ALL_ROWS, False)
    metrics.control_note(scores).show(ALL_ROWS, False)


def judge(ws):
    a, s = ws.args, ws.settings
    s = dataclasses.replace(
        s,
        judge_pool=a.pool or s.judge_pool,
        judge_negatives=a.neg_sample or s.judge_negatives,
    )
    model = model_name(a.judge_model or "haiku")
    questions, key = golden_set(ws)
    batch = Questions.of(questions)
    lists = [r.retrieve(batch, s.judge_pool) for r in (ws.dense(), ws.stack(batch))]
    pool = written(pool_union(lists), "pool")
    pairs = written(pool.select("query_id", "id").unionByName(key).distinct(), "pairs")
    texts = ws.collection.read().select("id", "text").join(broadcast_if_small(pairs), "id")
    prompts = texts.join(questions, "query_id").select(
        "query_id",
        "question",
        "id",
        grounding.judge_turn(
            F.col("question"), tx.id_company(F.col("id"), s.companies), F.col("text"), s
        ).alias("turn"),
    )
    space, table = adapters.namespace(model, s.rubric_version), ws.path("judge_calls")
    known = readers.read_verdicts(ws.spark, ws.path("judge_cache.json"))

    def recorded():
        return known.unionByName(adapters.saved(ws.spark, table, adapters.VERDICTS))

    if a.live:
        call = clients.relevance_call(model)
        adapters.record_verdicts(prompts, recorded(), space, call, table)
    found = adapters.each_verdict(recorded(), space)
    verdicts = written(
        prompts.select("query_id", "question", "id").join(found, ["question", "id"]), "verdicts"
    )
    rows = written(judging.validate(questions, key, pool, verdicts, s), "validation")
    judging.validation_lines(rows).orderBy("query_id").show(ALL_ROWS, False)
    result = judging.verdict(rows, s).first()
    print(json.dumps(result.asDict(), indent=2))
    if not a.build_key:
        return
    if not result["passed"] and not a.force:
        raise SystemExit("the check failed; --force builds the keys all the same")
    completed = judging.complete_key(questions, key, pool, verdicts)
    sidecar = written(judging.sidecar(completed, pool, questions), "sidecar")
    readers.write_sidecar(sidecar, ws.path("judge_keys"), model, s.judge_pool)
    judging.key_lines(sidecar).orderBy("query_id").show(ALL_ROWS, False)


def build_parser():
    p = argparse.ArgumentParser(prog="trawl")
    p.add_argument("--data", default="data", help="folder shared by driver and executors")
    p.add_argument("--embedder", default="model", choices=["model", "hashed"])
    p.add_argument("--live", action="store_true", help="call hosted models for what is not recorded")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        return c

    for name, run in (("ingest", ingest), ("chunk", chunk), ("store", store)):
        command(name, run).add_argument("--ticker", required=True)
    command("build", build)
    command("inspect", inspect)
    command("embed", embed).add_argument("--text", action="append", required=True)
    c = command("retrieve", retrieve)
    c.add_argument("--question", required=True)
    c.add_argument("--company")
    c.add_argument("--k", type=int, default=5)
    c.add_argument("--compare", action="store_true")
    c = command("ask", ask)
    c.add_argument("--question", required=True)
    c.add_argument("--company")
    c.add_argument("--k", type=int)
    c = command("eval", evaluate)
    for flag in ("rerank", "mmr", "hybrid", "hybrid-gate", "decompose", "llm-decompose",
                 "sub-filter", "expand", "judge-key"):
        c.add_argument(f"--{flag}", action="store_true")
    for flag in ("depth", "candidates", "rrf-k"):
        c.add_argument(f"--{flag}", type=int)
    c.add_argument("--mmr-lambda", type=float)
    c.add_argument("--fusion", choices=["rrf", "interleave"])
    c.add_argument("--reranker", default="minilm")
    c.add_argument("--decomposer")
    c.add_argument("--expander")
    c = command("judge", judge)
    c.add_argument("--judge-model")
    c.add_argument("--pool", type=int)
    c.add_argument("--neg-sample", type=int)
    c.add_argument("--build-key", action="store_true")
    c.add_argument("--force", action="store_true")
    return p


def main(argv=None):
    args = build_parser().parse_args(argv)
    args.run(Workspace(args))


if __name__ == "__main__":
    main()
