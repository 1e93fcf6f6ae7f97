from pyspark.sql import functions as F
import pytest

from trawl.config import Settings
from trawl.functions.vectors import HashedTokens
from trawl.operators.lexical import LexicalIndex
from trawl.operators.questions import Questions
from trawl.plans.retrievers import (
    CompanyDecomposition, DenseRetriever, HybridRetriever, MMRRetriever, RerankRetriever,
    RewriteRetriever, compare_arms, full_stack, token_overlap,
)
from support import rows

S = Settings()
E = HashedTokens(32)
DOCS = [
    (f"{t}-2026-01-01-{i:04d}", t, f"{name} {topic} item {i} {'fddei' if i == 7 and t == 'NVDA' else ''}")
    for t, name in (("TSLA", "tesla"), ("AAPL", "apple"), ("NVDA", "nvidia"))
    for i, topic in enumerate(["tax risk", "gaming", "supply chain", "cars"] * 3)
]
ASKED = [
    (1, "compare Tesla and NVIDIA on supply chain", None), (2, "apple tax risk", None),
    (3, "fddei", None), (4, "supply chain of tesla and apple", "nvda"),
]


@pytest.fixture(scope="module")
def base(spark):
    df = spark.createDataFrame(DOCS, "id string, ticker string, text string")
    return DenseRetriever(df.withColumn("embedding", E.documents(F.col("text"))), E)


@pytest.fixture(scope="module")
def index(base):
    return LexicalIndex.from_text(base.corpus, S)


@pytest.fixture(scope="module")
def batch(spark):
    return Questions.of(spark.createDataFrame(ASKED, "query_id int, question string, company string"))


def ranking(df):
    out = {}
    for q, r, i in sorted(rows(df.select("query_id", "rank", "id"))):
        out.setdefault(q, []).append(i)
    return out


def test_decomposition_balances_and_passes_the_rest_through(base, batch):
    plain = ranking(base.retrieve(batch, 6))
    got = ranking(CompanyDecomposition(base, S.companies).retrieve(batch, 6))
    assert [i[:4] for i in got[1]] == ["NVDA", "TSLA"] * 3
    assert {q: got[q] for q in (2, 3, 4)} == {q: plain[q] for q in (2, 3, 4)}
    assert {i[:4] for i in got[4]} == {"NVDA"}


def test_rewrites_take_turns_in_alphabetical_order(spark, base, batch):
    q = ASKED[1][1]
    data = [(q, "tesla cars"), (q, "apple gaming"), (q, "tesla cars"), (ASKED[2][1], "only one")]
    rewrites = spark.createDataFrame(data, "question string, rewrite string")
    got = ranking(RewriteRetriever(base, rewrites).retrieve(batch, 4))
    single = Questions.of(
        spark.createDataFrame([(1, "apple gaming"), (2, "tesla cars")], "query_id int, question string")
    )
    parts = ranking(base.retrieve(single, 4))
    assert got[2][:2] == [parts[1][0], parts[2][0]]
    plain = ranking(base.retrieve(batch, 4))
    assert {q: got[q] for q in (1, 3, 4)} == {q: plain[q] for q in (1, 3, 4)}


def test_rewrites_that_name_one_company_can_be_filtered(spark, base, batch):
    q = ASKED[0][1]
    rewrites = spark.createDataFrame([(q, "tesla tax"), (q, "nvidia and apple"), (ASKED[3][1], "tesla a"), (ASKED[3][1], "tesla b")], "question string, rewrite string")
    r = RewriteRetriever(base, rewrites, S.companies)
    subs = {(s["query_id"], s["sub_key"]): s["company"] for s in r.subquestions(batch).collect()}
    assert subs[(1, "tesla tax")] == "TSLA" and subs[(1, "nvidia and apple")] is None
    assert subs[(4, "tesla a")] == "NVDA"  # the caller's filter wins
    assert {i[:4] for i in ranking(r.retrieve(batch, 4))[4]} == {"NVDA"}


def test_gate_leaves_plain_questions_dense(base, index, batch):
    got = HybridRetriever(base, index, S, "interleave", gated=True).retrieve(batch, 5)
    kinds = dict(rows(got.select("query_id", "fusion").distinct()))
    assert kinds == {1: "dense-passthrough", 2: "dense-passthrough", 3: "interleave", 4: "dense-passthrough"}
    plain = ranking(base.retrieve(batch, 5))
    mixed = ranking(got)
    assert {q: mixed[q] for q in (1, 2, 4)} == {q: plain[q] for q in (1, 2, 4)}
    assert "NVDA-2026-01-01-0007" in mixed[3][:2]


def test_gate_asks_other_bases_at_their_own_depth(base, index, batch):
    mmr = MMRRetriever(base, Settings(pool=10, mmr_lambda=0.2))
    got = ranking(HybridRetriever(mmr, index, Settings(pool=10), gated=True).retrieve(batch, 3))
    alone = ranking(mmr.retrieve(batch, 3))
    assert {q: got[q] for q in (1, 2, 4)} == {q: alone[q] for q in (1, 2, 4)}


def test_rerank_orders_a_pool_by_its_scorer(base, batch):
    s = Settings(pool=8)
    got = RerankRetriever(base, base, token_overlap, s).retrieve(batch, 4)
    scores = [r["rerank_score"] for r in got.filter("query_id = 2").orderBy("rank").collect()]
    assert scores == sorted(scores, reverse=True)
    pool = ranking(base.retrieve(batch, 8))
    for q, ids in ranking(got).items():
        assert set(ids) <= set(pool[q])


def test_a_scorer_gives_a_pair_the_same_score_in_any_batch(base, batch, spark):
    pairs = base.corpus.select("id", "text").crossJoin(batch.df.select("query_id", "question"))
    score = token_overlap(F.col("question"), F.col("text"))
    together = dict(((i, q), s) for i, q, s in rows(pairs.select("id", "query_id", score)))
    alone = pairs.filter("query_id = 2").repartition(9).select("id", "query_id", score)
    assert all(together[(i, q)] == s for i, q, s in rows(alone))


def test_compare_arms_keeps_both_sides(base, batch):
    one = Questions.of(batch.df.filter("query_id = 4"))
    arms = compare_arms(base, one, 5).collect()
    assert sum(r["filtered_rank"] is not None for r in arms) == 5
    assert sum(r["open_rank"] is not None for r in arms) == 5


def test_full_stack_runs_every_question(spark, base, index, batch):
    none = spark.createDataFrame([], "question string, rewrite string")
    got = ranking(full_stack(base, index, none, S).retrieve(batch, 5))
    assert {q: len(i) for q, i in got.items()} == {1: 5, 2: 5, 3: 5, 4: 5}
