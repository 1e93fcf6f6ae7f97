"""BM25, dense search, MMR and fusion against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.config import Settings
from trawl.functions.vectors import HashedTokens
from trawl.functions.text import QUERY_STOP_WORDS
from trawl.operators import dense as dense_ops, impact, lexical, questions as question_ops
from trawl.operators.dense import dense_top_k, mmr_select
from trawl.operators.fusion import fuse, join_lanes, pool_union, round_robin
from trawl.operators.impact import ImpactIndex, write_impact_index
from trawl.operators.lexical import LexicalIndex, StoredIndex, write_index
from trawl.operators.questions import Questions
from trawl.session import scratch_path

from support import rows

S = Settings()


def toks(t):
    return re.findall("[a-z0-9]+", t.lower())


def make_corpus(seed=3, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(n):
        # one hot word in most documents, many exact copies
        text = " ".join(["hot"] * rng.randint(0, 3) + rng.choices(words, k=rng.randint(0, 12)))
        docs.append((i, rng.choice(["AA", "BB"]), text))
    return docs + [(n + j, "AA", docs[5][2]) for j in range(30)]


QUESTIONS = [
    (1, "hot w1 w2", None), (2, "w3 w3 w4", "aa"), (3, "What does it say about w5?", None),
    (4, "what is it", None), (5, "unknown", None), (6, "w7 hot", "zz"), (7, "", None),
]


def brute_bm25(docs, question, company, k):
    q = [t for t in toks(question) if t not in QUERY_STOP_WORDS] or toks(question)
    bags = {d: toks(t) for d, _, t in docs}
    n, avg = len(docs), sum(map(len, bags.values())) / len(docs)
    scored = []
    for d, ticker, _ in docs:
        if company and ticker != company.upper():
            continue
        score, first = 0.0, None
        for pos, t in enumerate(q):
            f = bags[d].count(t)
            if f:
                df = sum(t in b for b in bags.values())
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                score += idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(bags[d]) / avg))
                first = pos if first is None else first
        if first is not None:
            scored.append((-round(score, 9), first, d))
    return [d for _, _, d in sorted(scored)[:k]]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = make_corpus()
    return docs, spark.createDataFrame(docs, "id int, ticker string, text string").repartition(5)


@pytest.fixture(scope="module")
def batch(spark):
    return Questions.of(spark.createDataFrame(QUESTIONS, "query_id int, question string, company string"))


def by_question(df, rank):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r[rank])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_bm25_equals_brute_force(corpus, batch):
    docs, df = corpus
    got = by_question(LexicalIndex.from_text(df, S).search(batch, 7), "bm25_rank")
    for qid, text, company in QUESTIONS:
        assert got.get(qid, []) == brute_bm25(docs, text, company, 7), text


def test_bm25_does_not_depend_on_blocks_or_batches(spark, corpus, batch, monkeypatch):
    _, df = corpus
    whole = sorted(rows(LexicalIndex.from_text(df, S).search(batch, 7)))
    monkeypatch.setattr(lexical, "BLOCK", 2)
    monkeypatch.setattr(question_ops, "LOCAL_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        large = Questions.of(batch.df)
        again = sorted(rows(LexicalIndex.from_text(df.repartition(3), S).search(large, 7)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == again


def test_stored_index_gives_the_same(spark, corpus, batch):
    _, df = corpus
    index = LexicalIndex.from_text(df, S)
    path = scratch_path(spark, "index")
    write_index(index.docs, path, buckets=4)
    stored = StoredIndex(spark, path, S)
    assert sorted(rows(stored.search(batch, 7))) == sorted(rows(index.search(batch, 7)))
    assert sorted(rows(stored.looks_lexical(batch))) == sorted(rows(index.looks_lexical(batch)))
    none = Questions.of(batch.df.filter("query_id = 7"))
    assert rows(StoredIndex(spark, path, S).search(none, 7)) == []


@pytest.mark.parametrize("block, few", [(4, True), (1000, False)])
def test_postings_by_impact_give_the_same(spark, corpus, batch, monkeypatch, block, few):
    _, df = corpus
    index = LexicalIndex.from_text(df, S)
    path = scratch_path(spark, "impact")
    write_impact_index(index.docs, path, S, buckets=3, block=block)
    if not few:
        monkeypatch.setattr(impact, "BROADCAST_ROWS", 0)
    stored = ImpactIndex(spark, path)
    for k in (1, 7):
        assert sorted(rows(stored.search(batch, k))) == sorted(rows(index.search(batch, k)))
    none = Questions.of(batch.df.filter("query_id = 7"))
    assert rows(stored.search(none, 7)) == []


def test_few_postings_of_common_words_are_scored(spark):
    """One rare word decides; the common ones' lists stay shut, and only its documents are completed."""
    texts = [f"alpha beta gamma w{i}" for i in range(400)]
    for i in (3, 5, 8):
        texts[i] = "alpha beta gamma needle"
    docs = spark.createDataFrame([(i, "A", t) for i, t in enumerate(texts)], "id long, ticker string, text string")
    path = scratch_path(spark, "impact")
    write_impact_index(LexicalIndex.from_text(docs, S).docs, path, S, buckets=2)
    asked = Questions.of(spark.createDataFrame([(1, "alpha beta gamma needle")], "query_id int, question string"))
    assert [r["id"] for r in ImpactIndex(spark, path).search(asked, 3).orderBy("bm25_rank").collect()] == [3, 5, 8]
    assert ImpactIndex(spark, path).share_scored(asked, 3) == pytest.approx(12 / 1203)


def test_impact_index_in_small_pieces(spark, corpus, batch, monkeypatch):
    """A document is one row however many words it has, blocks are cut where it is read, and questions go in blocks."""
    for name, value in (("POSTINGS", 20), ("PAIRS", 5), ("ASKED_ROWS", 30), ("SHORT", 1)):
        monkeypatch.setattr(impact, name, value)
    docs, df = corpus
    index = LexicalIndex.from_text(df, S)
    path = scratch_path(spark, "impact")
    write_impact_index(index.docs, path, S, buckets=3, block=4)
    stored = ImpactIndex(spark, path)
    assert stored.rows.count() == df.count()
    held = [len(r["held"]) for r in stored.blocks.select("held").collect()]
    assert sum(held) == lexical.postings(index.docs).count() and max(held) <= 4
    assert sorted(rows(stored.search(batch, 7))) == sorted(rows(index.search(batch, 7)))


def test_words_are_dealt_to_buckets_in_pieces(spark, monkeypatch):
    """Pieces of one row or of many give the same; terms are where a search looks for them."""
    monkeypatch.setattr(lexical, "PIECE", 2)
    data = [(1, "A", ["b", "a", "b"], 7), (2, None, [], 8), (3, "B", ["c", "c"], 9), (4, "A", ["a", "d", "e"], 7)]
    docs = spark.createDataFrame(data, "id int, ticker string, tokens array<string>, part int")
    got = lexical.bucketed(docs, 3, "part").collect()
    found = {(r["id"], r["ticker"], r["dl"], r["part"], t["term"], t["tf"]) for r in got for t in r["held"]}
    assert found == {(i, k, len(w), p, t, w.count(t)) for i, k, w, p in data for t in w}
    assert sorted(r["id"] for r in got if r["lead"]) == [1, 2, 3, 4]
    assert [(r["dl"], r["bucket"], r["held"]) for r in got if r["id"] == 2] == [(0, 0, [])]
    places = {t["term"]: r["bucket"] for r in got for t in r["held"]}
    asked = lexical.term_table(spark, "abcde").select("term", lexical.word_bucket(3).alias("bucket"))
    assert {r["term"]: r["bucket"] for r in asked.collect()} == places
    held = {r["id"]: sorted(map(tuple, r["held"])) for r in lexical.counted(docs).collect()}
    assert held == {i: sorted((t, w.count(t)) for t in set(w)) for i, _, w, _ in data}


def test_postings_count_terms(spark):
    docs = spark.createDataFrame([(1, "A", ["b", "a", "b"]), (2, "A", [])], "id int, ticker string, tokens array<string>")
    assert sorted(rows(lexical.postings(docs))) == [(1, "A", 3, "a", 1), (1, "A", 3, "b", 2)]
    assert rows(lexical.corpus_stats(docs)) == [(2, 1.5)]
    assert rows(lexical.corpus_stats(docs.limit(0))) == [(0, 0.0)]


def test_empty_corpus_and_empty_batch(corpus, batch):
    _, df = corpus
    assert rows(LexicalIndex.from_text(df.limit(0), S).search(batch, 5)) == []
    none = Questions.of(batch.df.limit(0))
    assert rows(LexicalIndex.from_text(df, S).search(none, 5)) == []
    vectors = df.withColumn("embedding", HashedTokens(8).documents(F.col("text")))
    assert rows(dense_top_k(vectors, none, 5, HashedTokens(8).questions(F.col("question")))) == []


def test_rare_ceiling_rounds_half_to_even(spark):
    for n, ceiling in ((10, 1), (250, 2), (350, 4)):
        docs = spark.range(n).select("id", F.lit("A").alias("ticker"), F.array(F.lit("a")).alias("tokens"))
        assert LexicalIndex(docs, S).rare_ceiling() == ceiling


def test_gate_wants_a_rare_known_token(spark):
    docs = spark.range(300).select(
        "id", F.lit("A").alias("ticker"),
        F.when(F.col("id") == 5, F.array(F.lit("fddei"))).otherwise(F.array(F.lit("tax"))).alias("tokens"),
    )
    asked = Questions.of(
        spark.createDataFrame(
            [(1, "What is FDDEI?"), (2, "tax"), (3, "absent"), (4, "what is it")], "query_id int, question string"
        )
    )
    got = dict(rows(LexicalIndex(docs, S).looks_lexical(asked)))
    assert got == {1: True, 2: False, 3: False, 4: False}


def brute_dense(matrix, ids, tickers, q, company, k):
    sims = np.round(matrix @ q, 9)
    order = sorted(
        (-s, i) for s, i, t in zip(sims, ids, tickers) if not company or t == company.upper()
    )
    return [i for _, i in order[:k]]


def test_dense_equals_brute_force(spark, corpus, batch, monkeypatch):
    docs, df = corpus
    e = HashedTokens(16)
    vectors = df.withColumn("embedding", e.documents(F.col("text")))
    ask = e.questions(F.col("question"))
    got = by_question(dense_top_k(vectors, batch, 6, ask), "rank")
    m = e.encode([t for _, _, t in docs]).astype(np.float32).astype(float)
    ids, tickers = [d[0] for d in docs], [d[1] for d in docs]
    for qid, text, company in QUESTIONS:
        q = e.encode([text]).astype(np.float32).astype(float)[0]
        assert got.get(qid, []) == brute_dense(m, ids, tickers, q, company, 6), text
    monkeypatch.setattr(dense_ops, "BLOCK", 2)
    assert by_question(dense_top_k(vectors, batch, 6, ask), "rank") == got


def test_filter_in_lower_case_is_normalised(spark, corpus):
    _, df = corpus
    vectors = df.withColumn("embedding", HashedTokens(8).documents(F.col("text")))
    one = Questions.of(spark.createDataFrame([(1, "hot", "bb")], "query_id int, question string, company string"))
    found = dense_top_k(vectors, one, 5, HashedTokens(8).questions(F.col("question")))
    assert {r["ticker"] for r in found.join(df, "id").collect()} == {"BB"}


def brute_mmr(sims, vectors, k, lam):
    if len(sims) <= k:
        return list(range(len(sims)))
    picked = [max(range(len(sims)), key=lambda i: sims[i])]
    while len(picked) < k:
        left = [i for i in range(len(sims)) if i not in picked]
        value = {
            i: round(lam * sims[i] - (1 - lam) * max(float(vectors[i] @ vectors[j]) for j in picked), 9)
            for i in left
        }
        picked.append(max(left, key=lambda i: value[i]))
    return picked


@pytest.mark.parametrize("size,k", [(30, 8), (5, 8), (6, 6)])
def test_mmr_equals_brute_force(spark, size, k):
    rng = np.random.default_rng(1)
    data, want = [], {}
    for qid in (1, 2):
        v = rng.normal(size=(size, 6)).astype(np.float32)
        v[3] = v[1]
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        sims = np.sort(rng.random(size))[::-1]
        want[qid] = brute_mmr(sims, v.astype(float), k, 0.5)
        data += [(qid, i + 1, i, float(sims[i]), v[i].tolist()) for i in range(size)]
    pool = spark.createDataFrame(data, "query_id int, rank int, id int, similarity double, embedding array<float>")
    assert by_question(mmr_select(pool, k, 0.5), "mmr_rank") == want


LANES = [(["a", "b", "c"], ["c", "d"]), ([], ["x", "y"]), (["p"], []), (["m", "n"], ["n", "m", "o", "q"])]


def lanes(spark):
    d = [(q, i, x, 0.5) for q, (a, _) in enumerate(LANES) for i, x in enumerate(a, 1)]
    s = [(q, i, x, 2.0) for q, (_, b) in enumerate(LANES) for i, x in enumerate(b, 1)]
    return join_lanes(
        spark.createDataFrame(d, "query_id int, rank int, id string, similarity double"),
        spark.createDataFrame(s, "query_id int, bm25_rank int, id string, bm25_score double"),
    )


def test_fusion_orders(spark):
    def rrf(a, b):
        score = {}
        for lane in (a, b):
            for i, x in enumerate(lane):
                score[x] = score.get(x, 0) + 1 / (60 + i)
        return sorted(score, key=lambda x: -score[x])

    def turns(a, b):
        out = []
        for i in range(max(len(a), len(b))):
            out += [x for x in a[i : i + 1] + b[i : i + 1] if x not in out]
        return out

    for mode, order in (("rrf", rrf), ("interleave", turns)):
        got = by_question(fuse(lanes(spark), 3, mode, 60), "rank")
        assert got == {q: order(a, b)[:3] for q, (a, b) in enumerate(LANES)}


def test_sparse_only_rows_have_similarity_zero(spark):
    found = {r["id"]: r for r in fuse(lanes(spark), 9, "interleave", 60).filter("query_id = 0").collect()}
    assert found["d"]["similarity"] == 0.0 and found["d"]["dense_rank"] is None
    assert found["c"]["similarity"] == 0.5 and found["c"]["bm25_rank"] == 1


def test_round_robin_and_pool(spark):
    lists = [("A", ["x", "y", "z"]), ("B", ["x", "w"]), ("C", [])]
    data = [(1, name, i, x) for name, ids in lists for i, x in enumerate(ids, 1)]
    df = spark.createDataFrame(data, "query_id int, list_no string, rank int, id string")
    assert by_question(round_robin(df, 10), "rank") == {1: ["x", "y", "w", "z"]}
    assert by_question(round_robin(df, 2), "rank") == {1: ["x", "y"]}
    a = df.filter("list_no = 'A'")
    b = df.filter("list_no = 'B'")
    assert by_question(pool_union([b, a]), "pool_rank") == {1: ["x", "w", "y", "z"]}


def test_scores_do_not_depend_on_stretches():
    asks = lexical.Asks([[0, 2, 0], [], [1]], 3)
    row, term, gain = np.array([0, 0, 1, 3, 3]), np.array([0, 1, 2, 1, 2]), np.array([1.0, 2.0, 4.0, 8.0, 16.0])
    want = np.array([[2, 0, 2], [4, 0, 0], [0, 0, 0], [16, 0, 8]], dtype=float)
    for cells in (1, 4, 100):
        got, first = np.zeros((4, 3)), {}
        for a, b, scores, ties in asks.scored(4, row, term, gain, cells):
            got[a:b] = np.where(scores > 0, scores, 0)
            r, q = np.nonzero(scores > 0)
            first |= {(a + i, j): p for i, j, p in zip(r.tolist(), q.tolist(), ties(r, q).tolist())} if len(r) else {}
        assert (got == want).all()
        assert first == {(0, 0): 0, (0, 2): 0, (1, 0): 1, (3, 0): 1, (3, 2): 0}


def test_gate_and_search_share_one_pass(corpus, batch):
    index = LexicalIndex.from_text(corpus[1], S)
    index.looks_lexical(batch)
    held = index._lately[0]
    some = Questions.of(batch.df.filter("query_id < 4"))
    assert sorted(rows(index.search(some, 7))) == sorted(rows(LexicalIndex.from_text(corpus[1], S).search(some, 7)))
    assert index._lately == [held]


def test_texts_are_embedded_a_piece_at_a_time(spark):
    from trawl.functions.vectors import PIECE, Embedder

    class Counting(Embedder):
        dim = 2

        def encode(self, texts):
            return np.array([[len(texts), len(t)] for t in texts])

    df = spark.range(0, 3 * PIECE + 5, 1, 1).selectExpr("id", "if(id % 7 = 0, null, repeat('x', int(id % 9))) text")
    got = df.select("id", "text", Counting().documents(F.col("text")).alias("e")).collect()
    assert len(got) == 3 * PIECE + 5 and all(r["e"][1] == len(r["text"] or "") for r in got)
    assert {r["e"][0] for r in got} == {PIECE, 5}
