import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trawl.config import Settings
from trawl.functions.vectors import HashedTokens
from trawl.operators.dense import dense_top_k
from trawl.operators.questions import Questions
from trawl.plans.retrievers import DenseRetriever
from trawl.session import scratch_path, written
from trawl.sources import adapters, filings, readers
from trawl.sources.collection import Collection, ticker_counts, upserted
from trawl.streaming.ingest import follow_chunks
from support import rows

CHUNK = "id string, ticker string, text string"


def text_file(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_ticker_lookup_pads_and_takes_the_last_entry(spark):
    entries = {
        "0": {"cik_str": 1318605, "ticker": "TSLA", "title": "Old"},
        "10": {"cik_str": 1318605, "ticker": "TSLA", "title": "Tesla, Inc."},
        "2": {"cik_str": 12345678901, "ticker": "LONG", "title": "L"},
    }
    mapping = filings.ticker_map(spark.createDataFrame([(json.dumps(entries),)], ["value"]))
    wanted = spark.createDataFrame([("tsla",), ("LONG",)], ["ticker"])
    assert sorted(rows(filings.resolve_tickers(wanted, mapping))) == [
        ("LONG", "12345678901", "L"), ("TSLA", "0001318605", "Tesla, Inc."),
    ]
    with pytest.raises(PySparkException, match="unknown ticker"):
        filings.resolve_tickers(spark.createDataFrame([("NOPE",)], ["ticker"]), mapping).collect()


def test_first_exact_annual_report(spark):
    recent = {
        "form": ["8-K", "10-K/A", "10-K", "10-K"], "accessionNumber": ["a-1", "a-2", "0001-25-3", "a-4"],
        "primaryDocument": ["1", "2", "r.htm", "4"], "filingDate": ["2026", "2026", "2025-01-30", "2024"],
    }
    files = spark.createDataFrame([("0000000042", json.dumps({"filings": {"recent": recent}}))], ["cik", "value"])
    companies = spark.createDataFrame([("T", "0000000042", "Co")], ["ticker", "cik", "company_name"])
    report = filings.latest_annual_report(companies, filings.submissions(files)).first()
    assert report["accession_number"] == "0001-25-3" and report["filing_date"] == "2025-01-30"
    assert report["source_url"] == "https://www.sec.gov/Archives/edgar/data/42/0001253/r.htm"
    none = filings.submissions(files).filter("form = '8-K'")
    with pytest.raises(PySparkException, match="no 10-K"):
        filings.latest_annual_report(companies, none).collect()


def test_fetching_wants_a_named_agent(spark):
    missing = spark.createDataFrame([("a", "u")], ["accession_number", "source_url"])
    for agent in ("", "Your Name your_email@example.com"):
        with pytest.raises(ValueError):
            filings.fetch_pages(missing, Settings(user_agent=agent))
    cached = spark.createDataFrame([("a",)], ["accession_number"])
    assert filings.cache_misses(missing, cached).count() == 0


def test_filings_are_parsed_and_carried(spark):
    html = "<p>Item 1. Business</p><p>" + "word " * 200 + "</p><p>Item 2. Properties</p>"
    page = spark.createDataFrame([("T", html)], ["ticker", "html"])
    found = filings.parse_filings(page, Settings()).first()
    assert found["ticker"] == "T" and [s["section"] for s in found["sections"]] == ["Item 1. Business"]


def test_chunk_and_golden_files(spark, tmp_path):
    line = {"chunk_id": "T-1", "text": "x", "metadata": {"ticker": "T", "section": "s", "chunk_index": 0}}
    path = text_file(spark, tmp_path, "T.jsonl", json.dumps(line) + "\n\n")
    got = readers.read_chunks(spark, path).first()
    assert (got["id"], got["ticker"], got["chunk_index"], got["cik"]) == ("T-1", "T", 0, None)
    golden = text_file(spark, tmp_path, "g.jsonl", '{"id": 1, "question": "q", "company": null, "relevant_ids": []}\n\n')
    assert readers.read_golden(spark, golden).first()["company"] is None


def test_rewrite_caches(spark, tmp_path):
    good = json.dumps({"m": {"q": ["a", "b"], "e": []}, "n": {"q": ["c"]}}, indent=2)
    path = text_file(spark, tmp_path, "c.json", good)
    recorded = readers.read_rewrites(spark, path)
    assert rows(adapters.each_rewrite(recorded, "m")) == [("q", 0, "a"), ("q", 1, "b")]
    assert recorded.filter("model = 'm'").count() == 2
    flat = text_file(spark, tmp_path, "f.json", json.dumps({"__model__": "m", "q": ["z"]}))
    assert rows(adapters.each_rewrite(readers.read_rewrites(spark, flat), "m")) == [("q", 0, "z")]
    for bad in ("not json", "[1, 2]", ""):
        assert readers.read_rewrites(spark, text_file(spark, tmp_path, "b.json", bad)).count() == 0
    assert readers.read_rewrites(spark, str(tmp_path / "none.json")).count() == 0


def test_verdict_cache_and_sidecar(spark, tmp_path):
    cache = text_file(spark, tmp_path, "v.json", json.dumps({"m#v2": {"q": {"i": True, "j": False}}, "m#v1": {"q": {"i": False}}}))
    found = adapters.each_verdict(readers.read_verdicts(spark, cache), adapters.namespace("m", 2))
    assert sorted(rows(found)) == [("q", "i", True), ("q", "j", False)]
    old = spark.createDataFrame([(json.dumps({"model": "m", "questions": {"3": {"new_key": ["a", "b"]}, "4": {"new_key": []}}}),)], ["value"])
    assert rows(readers.parse_sidecar(old)) == [(3, "a"), (3, "b")]
    made = spark.createDataFrame([(3, "q", ["a"], ["b"], ["a", "b"], ["b"], 5)], "query_id int, question string, hand_key array<string>, judged_relevant array<string>, new_key array<string>, added array<string>, pool_size bigint")
    readers.write_sidecar(made, str(tmp_path / "keys"), "m", 20)
    assert rows(readers.read_sidecar(spark, str(tmp_path / "keys"))) == [(3, "a"), (3, "b")]


def test_calls_fill_gaps_and_failures_are_not_recorded(spark, tmp_path):
    table = str(tmp_path / "calls")
    recorded = spark.createDataFrame([("m", "known", ["x"])], adapters.REWRITES)
    prompts = spark.createDataFrame([("known", "?"), ("new", "new"), ("bad", "bad"), ("none", "none")], ["question", "turn"])

    def call(turn):
        return {"new": [" a ", "", "b", "c"], "none": []}[turn]

    adapters.record_rewrites(prompts, recorded, "m", 2, call, table)
    saved = adapters.saved(spark, table, adapters.REWRITES)
    assert sorted(rows(saved)) == [("m", "new", ["a", "b"]), ("m", "none", [])]
    adapters.record_rewrites(prompts, recorded.unionByName(saved), "m", 2, lambda t: ["late"], table)
    again = adapters.saved(spark, table, adapters.REWRITES)
    assert sorted(rows(again))[0] == ("m", "bad", ["late"]) and again.count() == 3


def test_verdict_calls(spark, tmp_path):
    table = str(tmp_path / "verdicts")
    space = adapters.namespace("m", 2)
    recorded = spark.createDataFrame([("m#v1", "q", "i", True)], adapters.VERDICTS)
    prompts = spark.createDataFrame([("q", "i", "yes"), ("q", "j", "fail")], ["question", "id", "turn"])
    adapters.record_verdicts(prompts, recorded, space, lambda t: {"yes": True}[t], table)
    found = adapters.saved(spark, table, adapters.VERDICTS)
    assert rows(adapters.each_verdict(found, space)) == [("q", "i", True)]


def test_refused_prompts_are_not_sent(spark):
    prompts = spark.createDataFrame([(1, "t"), (2, None)], "query_id int, turn string")
    assert rows(adapters.answers(prompts, lambda t: t + " ")) == [(1, "t")]


def test_upsert_replaces_adds_and_keeps(spark):
    old = spark.createDataFrame([("a", "X", "1"), ("b", "X", "2"), ("c", "Y", "3")], CHUNK)
    new = spark.createDataFrame([("b", "X", "20"), ("d", "X", "4")], CHUNK)
    assert sorted(rows(upserted(old, new).select("id", "text"))) == [("a", "1"), ("b", "20"), ("c", "3"), ("d", "4")]
    pruned = upserted(old, new, prune_within="ticker")
    assert sorted(rows(pruned.select("id", "text"))) == [("b", "20"), ("c", "3"), ("d", "4")]


def test_collection_upserts_only_what_changes(spark):
    store = Collection(spark, scratch_path(spark, "collection"), buckets=4)
    e = HashedTokens(8)
    first = spark.createDataFrame([(f"A-{i}", "A", f"text {i}") for i in range(40)] + [("B-1", "B", "b")], CHUNK)
    assert store.upsert(first.limit(0), e) == 0
    assert store.upsert(first, e) == 41
    assert store.upsert(first, e) == 41 and store.count() == 41
    assert store.upsert(spark.createDataFrame([("A-3", "A", "new"), ("A-99", "A", "more")], CHUNK), e) == 2
    assert store.count() == 42 and store.count("a") == 41 and store.count("B") == 1
    assert store.read().filter("id = 'A-3'").first()["text"] == "new"
    assert [r["id"] for r in store.peek(2).collect()] == ["A-0", "A-1"]
    assert dict(rows(ticker_counts(store.read(), ["A", "Z"]))) == {"A": 41, "Z": 0, None: 42}


def test_tickers_stay_text(spark):
    store = Collection(spark, scratch_path(spark, "collection"), buckets=2)
    store.upsert(spark.createDataFrame([("0700-1", "0700", "x")], CHUNK))
    store.upsert(spark.createDataFrame([("0700-1", "0700", "y"), ("0700-2", "0700", "z")], CHUNK))
    assert store.count("0700") == 2 and store.read().filter("text = 'y'").first()["ticker"] == "0700"


def test_lookups_in_a_stored_collection_are_pruned(spark):
    store = Collection(spark, scratch_path(spark, "collection"), buckets=4)
    e = HashedTokens(8)
    docs = spark.createDataFrame([(f"A-{i}", "A", f"w{i} w{i % 7}") for i in range(60)], CHUNK)
    store.upsert(docs, e)
    batch = Questions.of(spark.createDataFrame([(1, "w3"), (2, "w40 w5")], "query_id int, question string"))
    stored = DenseRetriever.over(store, e)
    ranked = stored.retrieve(batch, 3)
    ask = e.questions(F.col("question"))
    plain = dense_top_k(docs.withColumn("embedding", e.documents(F.col("text"))), batch, 3, ask)
    assert sorted(rows(ranked)) == sorted(rows(plain))
    found = stored.attach(ranked, batch, 3, "text")
    assert found.count() == 6 and "bucket" not in found.columns
    assert "dynamicpruning" in found._jdf.queryExecution().toString()


def test_stream_follows_chunk_files(spark, tmp_path):
    inbox, store = tmp_path / "in", Collection(spark, scratch_path(spark, "collection"), buckets=2)
    inbox.mkdir()

    def drop(name, chunks):
        lines = [{"chunk_id": i, "text": t, "metadata": {"ticker": "T"}} for i, t in chunks]
        (inbox / name).write_text("\n".join(map(json.dumps, lines)))

    def run():
        follow_chunks(spark, str(inbox), store, str(tmp_path / "progress"), HashedTokens(4)).awaitTermination()
        return dict(rows(store.read().select("id", "text")))

    drop("1.jsonl", [("T-1", "a"), ("T-2", "b")])
    assert run() == {"T-1": "a", "T-2": "b"}
    drop("2.jsonl", [("T-2", "c"), ("T-3", "d")])
    assert run() == {"T-1": "a", "T-2": "c", "T-3": "d"}


def test_written_tables_lie_in_the_shared_folder(spark):
    assert rows(written(spark.range(3), "t").selectExpr("sum(id)")) == [(3,)]


def test_upsert_keeps_one_row_per_id(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "store"), buckets=2)
    rows = [("B-1", "B", "s", "t2"), ("B-1", "B", "s", "t1"), ("B-2", "B", "s", "t3")]
    assert store.upsert(spark.createDataFrame(rows, "id string, ticker string, section string, text string")) == 2
    assert sorted(r["text"] for r in store.read().collect()) == ["t1", "t3"]


def test_filings_of_one_line_and_of_many(spark, tmp_path):
    filings = [{"ticker": "T", "cik": str(i), "sections": [{"section": "s", "text": "x"}]} for i in range(3)]
    made = spark.createDataFrame([json.dumps(f) for f in filings], "string").select(F.from_json("value", readers.FILING_SCHEMA).alias("f")).select("f.*")
    readers.write_filings(made.coalesce(1), str(tmp_path / "lines"))
    assert {r["cik"] for r in readers.read_filings(spark, str(tmp_path / "lines")).collect()} == {"0", "1", "2"}
    (tmp_path / "pretty").mkdir()
    for i, f in enumerate(filings):
        (tmp_path / "pretty" / f"{i}.json").write_text(json.dumps(f, indent=2))
    assert {r["cik"] for r in readers.read_filings(spark, str(tmp_path / "pretty"), pretty=True).collect()} == {"0", "1", "2"}
