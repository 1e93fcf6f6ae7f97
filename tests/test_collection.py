"""The collection's parts, versions and index against plain rows in memory."""

import random

import pytest
from pyspark.sql import functions as F

from support import rows
from trawl.config import Settings
from trawl.functions.vectors import HashedTokens
from trawl.operators.lexical import LexicalIndex, corpus_stats, term_stats
from trawl.operators.questions import Questions
from trawl.session import scratch_path
from trawl.sources.collection import Collection, with_total
from trawl.sources.commits import CommitLog, Conflict
from trawl.sources.segments import SegmentedIndex
from trawl.streaming.ingest import take_batch

CHUNK = "id string, ticker string, text string"
S = Settings()


def chunks(spark, made):
    return spark.createDataFrame(made, CHUNK)


def held(store, **at):
    return sorted(rows(store.read(**at).select("id", "ticker", "text")))


@pytest.fixture
def store(spark):
    return Collection(spark, scratch_path(spark, "collection"), buckets=4)


def test_one_writer_makes_a_version(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.latest() is None
    log.commit(1, {"a": "ü"})
    with pytest.raises(Conflict):
        log.commit(1, {"a": 2})
    log.commit(2, {})
    assert log.versions() == [1, 2] and log.read(1)["a"] == "ü" and log.latest()["version"] == 2


def test_random_upserts_and_compactions(spark, store):
    draw, want, ever = random.Random(4), {}, []
    index = SegmentedIndex(store, scratch_path(spark, "index"), S, buckets=3)
    for step in range(7):
        batch = {f"i{draw.randrange(30)}": (draw.choice("AB"), " ".join(draw.choices("u v w x y z".split(), k=draw.randrange(5)))) for _ in range(12)}
        made = [(i, t, x if x else None) for i, (t, x) in batch.items()]
        assert store.upsert(chunks(spark, made)) == len(made)
        want.update({i: (t, x) for i, t, x in made})
        ever.append(dict(want))
        if step in (3, 5, 6):
            store.compact(fan=2)
        if step in (1, 3, 4, 6):
            index.refresh()
            same_as_rebuilt(spark, index, store)
        assert held(store) == sorted(((i, t, x) for i, (t, x) in want.items()), key=lambda r: r[0])
        assert dict(rows(store.counts())) == {t: n for t in "AB" if (n := sum(v[0] == t for v in want.values()))}
        assert store.count() == len(want)
    assert len(store.snapshot()["parts"]) < 7
    assert held(store, version=2) == sorted(((i, t, x) for i, (t, x) in ever[1].items()), key=lambda r: r[0])
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert {i for i, *_ in held(store)} == set(want)
    assert not index.refresh() or same_as_rebuilt(spark, index, store) is None


def same_as_rebuilt(spark, index, store):
    fresh = LexicalIndex.from_text(store.read(), S)
    n, avgdl = corpus_stats(fresh.docs).first()
    assert index._n == n and index._avgdl == pytest.approx(avgdl)
    assert sorted(rows(index.frequencies())) == sorted(rows(term_stats(fresh.docs).select("term", "df")))
    asked = Questions.of(spark.createDataFrame([(1, "u w w", None), (2, "x nothing", "A"), (3, "z y", None)], "query_id int, question string, company string"))
    assert sorted(rows(index.search(asked, 5))) == sorted(rows(fresh.search(asked, 5)))


def test_an_id_leaves_its_old_ticker(spark, store):
    store.upsert(chunks(spark, [("1", "A", "a"), ("2", "A", "b")]))
    store.upsert(chunks(spark, [("1", "B", "c")]))
    assert held(store) == [("1", "B", "c"), ("2", "A", "b")]
    assert rows(with_total(store.counts(), ["A", "B", "C"]).orderBy("ticker")) == [(None, 2), ("A", 1), ("B", 1), ("C", 0)]


def test_pruning_drops_what_the_tickers_no_longer_have(spark, store):
    store.upsert(chunks(spark, [("1", "A", "a"), ("2", "A", "b"), ("3", "B", "c")]))
    assert store.upsert(chunks(spark, [("2", "A", "d"), ("4", "A", "e")]), prune=True) == 2
    assert held(store) == [("2", "A", "d"), ("3", "B", "c"), ("4", "A", "e")]
    assert store.count() == 3 and store.count("a") == 2


def test_an_upsert_writes_its_rows_only_and_runs_its_plan_once(spark, store):
    store.upsert(chunks(spark, [(str(i), "A", "a") for i in range(100)]))
    first = set(store.snapshot()["parts"])
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    source = chunks(spark, [("5", "A", "n"), ("200", "A", "m"), ("200", "A", "k")]).repartition(1).mapInPandas(seen, CHUNK)
    assert store.upsert(source) == 2 and ran.value == 3
    (new,) = set(store.snapshot()["parts"]) - first
    assert store.stored(store.snapshot(), [new]).count() == 3 and first < set(store.snapshot()["parts"])
    assert store.read().filter("id = '200'").first()["text"] == "k"


def test_latest_of_repeated_ids(spark, store):
    made = spark.createDataFrame([("1", "A", "old", 1), ("1", "B", "new", 3), ("1", "A", "mid", 2)], CHUNK + ", at int")
    assert store.upsert(made, latest=("at",)) == 1
    assert held(store) == [("1", "B", "new")]


def test_vectors_and_types_are_kept(spark, store):
    e = HashedTokens(4)
    store.upsert(chunks(spark, [("1", "A", "a")]), e)
    with pytest.raises(ValueError, match="vectors"):
        store.upsert(chunks(spark, [("1", "A", "b")]))
    with pytest.raises(ValueError, match="stored as"):
        store.upsert(spark.createDataFrame([("1", "A", 7)], "id string, ticker string, text int"), e)
    wider = chunks(spark, [("2", "A", "b")]).withColumn("section", F.lit("s"))
    store.upsert(wider, e)
    assert sorted(rows(store.read().select("id", "section"))) == [("1", None), ("2", "s")]
    assert held(store) == [("1", "A", "a"), ("2", "A", "b")]


def test_writers_that_meet(spark, store):
    """Both wrote their rows over the same version; the second sees the first one's and supersedes them."""
    store.upsert(chunks(spark, [("0", "A", "z")]))
    other = Collection(spark, store.path, buckets=4)
    commit, met = store.log.commit, []

    def slow(version, content):
        if not met:
            met.append(other.upsert(chunks(spark, [("1", "A", "first"), ("2", "A", "x")])))
        commit(version, content)

    store.log.commit = slow
    assert store.upsert(chunks(spark, [("1", "B", "second")])) == 1
    assert held(store) == [("0", "A", "z"), ("1", "B", "second"), ("2", "A", "x")] and store.count() == 3
    met.clear()
    assert store.compact(fan=2) == 2  # while it ran another upsert came in
    assert store.count() == 3 and len(store.snapshot()["parts"]) == 3
    assert held(store) == [("0", "A", "z"), ("1", "A", "first"), ("2", "A", "x")]


def test_a_batch_counts_once(spark, store):
    def arriving(made):
        return spark.createDataFrame(made, CHUNK + ", file_time long, file_name string")

    assert take_batch(store, arriving([("1", "A", "a", 1, "f"), ("1", "A", "b", 2, "g")]), 0, "s") == 1
    assert take_batch(store, arriving([("1", "A", "c", 3, "h")]), 1, "s") == 1
    assert take_batch(store, arriving([("1", "A", "a", 1, "f")]), 0, "s") == 0
    assert take_batch(store, arriving([]), 2, "s") == 0 and store.snapshot()["batches"] == {"s": 2}
    assert held(store) == [("1", "A", "c")]
    assert take_batch(store, arriving([("1", "A", "d", 1, "f")]), 0, "another") == 1


def test_nothing_stored_yet(spark, store):
    assert not store.exists() and store.count() == 0 and store.counts().count() == 0 and store.compact() == 0
    with pytest.raises(ValueError):
        store.read()
    index = SegmentedIndex(store, scratch_path(spark, "index"), S)
    asked = Questions.of(spark.createDataFrame([(1, "u")], "query_id int, question string"))
    assert not index.refresh() and rows(index.search(asked, 3)) == []
    store.upsert(chunks(spark, [("1", "A", None), ("2", "B", "")]))
    assert index.refresh() and index._n == 2 and rows(index.search(asked, 3)) == []
