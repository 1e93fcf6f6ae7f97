"""Similarity join and line dedup against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import joined_components, lines_removed

from trawl.llm import ngram_join as nj
from trawl.llm.line_dedup import dedup_lines

DOCS = "doc_id long, text string"


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def edited(seed, copies=40):
    """A base text with copies that differ in a few words, chains of edits and short texts."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(400))
    rows, texts = [], []
    for _ in range(4):
        base = [word() for _ in range(rng.choice([6, 30, 90, 160]))]
        texts.append(base)
        for _ in range(copies // 4):
            copy = list(rng.choice(texts[-4:]))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [word()], [word(), copy[at]]])
            texts.append(copy or ["x"])
    texts += [["a"], ["A"], ["a", "b"], ["a", "b", "c"], [], ["b", "c"]]
    rng.shuffle(texts)
    for i, t in enumerate(texts):
        rows.append((i * 3, rng.choice([" ", "\t", " \n"]).join(t)))
    return [*rows, (100_001, None)]


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
@pytest.mark.parametrize("long_list", [16, 2, 0])
def test_join_of_edited_texts(spark, monkeypatch, n, num, den, long_list):
    monkeypatch.setattr(nj, "LONG_LIST", long_list)
    rows = edited(n)
    found = result(nj.ngram_join(spark.createDataFrame(rows, DOCS), n, num, den))
    assert found == joined_components(rows, n, num, den)


def test_join_of_documents(spark, documents, texts):
    assert result(nj.ngram_join(documents)) == joined_components(texts, 3, 90, 100)


def test_near_pass_finds_what_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(nj, "LONG_LIST", 0)
    monkeypatch.setattr(nj, "hub_pairs", lambda shared: shared.filter("false").selectExpr("id a", "id b"))
    rows = edited(9)
    found = result(nj.ngram_join(spark.createDataFrame(rows, DOCS), 3, 90, 100))
    assert found == joined_components(rows, 3, 90, 100)


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_variants_just_under_the_threshold(spark, monkeypatch, n, num, den):
    """One text with many variants, some of which share edits; all lists are long."""
    monkeypatch.setattr(nj, "LONG_LIST", 4)
    rng = random.Random(n)
    base = [f"w{i}" for i in range(120)]
    edits = [(rng.randrange(120), f"e{i}") for i in range(40)]
    rows = []
    for i in range(90):
        copy = list(base)
        for at, word in rng.sample(edits, rng.randrange(1, 9)) if i % 3 else [(rng.randrange(120), f"x{i}{j}") for j in range(6)]:
            copy[at] = word
        rows.append((i, " ".join(copy)))
    found = result(nj.ngram_join(spark.createDataFrame(rows, DOCS), n, num, den))
    assert found == joined_components(rows, n, num, den)
    assert 1 < len({c for _, c in found.values()}) < 90


def test_join_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t"), (None, "x y z"), (5, long), (6, long + " end"), (7, "q"), (7, "q"), (None, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "text as component_id", "doc_id as id")
    got = nj.ngram_join(df).collect()
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got}
    assert len(got) == len(rows)
    assert {(5, 29_998, 5), (6, 29_999, 5), (1, 0, 1), (2, 0, 2), (7, 1, 7), (None, 0, None)} <= found
    assert nj.ngram_join(df.limit(0)).count() == 0


def test_join_puts_out_bounded_pieces(monkeypatch):
    """However many rows an Arrow batch has, what is made of it comes in pieces."""
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), pa.array(texts)], ["id", "text"])
    bands = nj.Bands(80, 100)
    near = list(nj.near_signatures(5, bands)([batch]))
    assert len(near) > 1 and set(np.concatenate([b.column(1).to_numpy() for b in near])) == set(range(1200))
    monkeypatch.setattr(nj, "PIECE", 1000)
    packed = list(nj.exact_signatures(5, bands)([batch]))
    monkeypatch.setattr(nj.runs_of, "__defaults__", (1000,))
    parts = list(nj.unpacked(packed))
    assert len(parts) > len(packed) and max(b.num_rows for b in parts) <= 2000
    sigs = [np.frombuffer(v.as_buffer(), np.int64) for b in packed for v in b.column(1)]
    assert np.array_equal(np.concatenate([b.column(0).to_numpy() for b in parts]), np.concatenate(sigs))


def small_pairs(seed, num, den, most=20):
    """Texts two by two: a set of 1 to ``most`` words and one as far from it as links allow."""
    rng = random.Random(seed)
    word = lambda: f"s{seed}x{rng.randrange(1 << 40)}"
    texts = []
    for size in range(1, most + 1):
        for gone in range(size):
            for more in range(size + 1):
                if den * (size - gone) >= num * (size + more):
                    x = [word() for _ in range(size)]
                    texts += [" ".join(x), " ".join(x[gone:] + [word() for _ in range(more)])]
    return texts


@pytest.mark.parametrize("num,den,seeds", [(90, 100, 30), (80, 100, 15), (50, 100, 1)])
def test_small_similar_sets_share_a_signature(num, den, seeds):
    bands = nj.Bands(num, den)
    for seed in range(seeds):
        texts = small_pairs(seed, num, den)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
        whole, near = [[set() for _ in texts] for _ in range(2)]
        for part in nj.unpacked(nj.exact_signatures(1, bands)([batch])):
            for sig, i in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                whole[i].add(sig)
        for part in nj.near_signatures(1, bands)([batch]):
            for sig, i, gone in zip(*(part.column(k).to_pylist() for k in (0, 1, 4))):
                near[i].add((sig, gone))
        for a in range(0, len(texts), 2):
            assert whole[a] & whole[a + 1]
            assert any((s, g) in near[a] for s, lost in near[a + 1] for g in range(2 - lost))


@pytest.mark.parametrize("long_list", [16, 0])
def test_join_of_small_sets(spark, monkeypatch, long_list):
    """Also where all elements of two sets fall into one segment."""
    monkeypatch.setattr(nj, "LONG_LIST", long_list)
    words = np.random.default_rng(5).integers(0, 1 << 40, (1500, 9))
    texts = [" ".join(f"w{w}" for w in row[:m]) for row in words for m in (8, 9)]
    rows = list(enumerate(texts))
    found = result(nj.ngram_join(spark.createDataFrame(rows, DOCS), 5, 80, 100))
    assert found == joined_components(rows, 5, 80, 100)


def with_runs(seed):
    rng = random.Random(seed)
    line = lambda w: " ".join("v" + str(rng.randrange(50)) for _ in range(w))
    pool = [[line(rng.choice([0, 1, 3, 8, 20])) for _ in range(rng.choice([1, 2, 4]))] for _ in range(8)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            lines += rng.choice(pool) if rng.random() < 0.6 else [line(rng.choice([0, 2, 12]))]
        rows.append((i * 2, "\n".join(lines)))
    return [*rows, (1000, None), (1001, "")]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("least", [10, 25])
def test_line_runs(spark, seed, least):
    rows = with_runs(seed)
    found = {r["doc_id"]: r["text"] or "" for r in dedup_lines(spark.createDataFrame(rows, DOCS), least).collect()}
    assert found == lines_removed(rows, least)


def test_line_runs_of_documents(documents, texts):
    found = {r["doc_id"]: r["text"] for r in dedup_lines(documents, 50).collect()}
    assert found == lines_removed(texts, 50)


@pytest.mark.parametrize("other", ["short", None, "", "new lines here\nthat are nowhere else\nat all"])
def test_line_runs_where_an_id_repeats(spark, other):
    """Each text is cut by its own lines, whatever else goes by its id."""
    run = "\n".join(f"line {i} " + "word " * 20 for i in range(4))
    long_text = "\n".join(f"own {i}" for i in range(10)) + "\n" + run
    rows = [(1, run), (5, long_text), (5, other), (5, other)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as `cut`", "2 as `cut lines`", "3 as `cut id`")
    got = sorted((r["doc_id"], r["text"] or "", r["lines_removed"]) for r in dedup_lines(docs).collect())
    kept = "\n".join(f"own {i}" for i in range(10))
    assert got == sorted([(1, run, 0), (5, kept, 4), (5, other or "", 0), (5, other or "", 0)])
    twice = spark.createDataFrame([(1, run), (5, run), (5, "a\n" + run), (5, "b\nc\nd")], DOCS)
    assert sorted((r["doc_id"], r["text"]) for r in dedup_lines(twice).collect()) == [(1, run), (5, ""), (5, "a"), (5, "b\nc\nd")]


@pytest.mark.parametrize("salts", [1, 16])
def test_line_runs_behind_a_common_line(spark, monkeypatch, salts):
    """A run is found though an earlier, unlike text has each of its lines, among others."""
    monkeypatch.setattr("trawl.llm.line_dedup.SALTS", salts)
    runs = [[f"r{r} line {i} " + "word " * 20 for i in range(4)] for r in range(5)]
    alone = [line + f"\nfiller {i} " + "other " * 60 for i, line in enumerate(sum(runs, []))]
    texts = ["\n".join(alone), *["\n".join([f"head {i}", *run, f"tail {i}"]) for run in runs for i in range(3)]]
    rows = list(enumerate(texts))
    found = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == lines_removed(rows, 50)
    assert sum(t.count("\n") == 1 for t in found.values()) == 10


def test_line_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, passage), (1, passage), (2, "head\n" + passage.upper() + "\ntail"), (3, None), (3, ""), (4, "short")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id as id", "text as cut", "1 as lines_removed")
    got = sorted(((r["doc_id"] or 0), r["text"] or "", r["lines_removed"]) for r in dedup_lines(df).collect())
    assert got == [(0, passage, 0), (1, passage, 0), (2, "head\ntail", 1), (3, "", 0), (3, "", 0), (4, "short", 0)]
    assert dedup_lines(df.limit(0)).count() == 0
