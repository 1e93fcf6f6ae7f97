"""Chunking: worked examples, and properties that hold for any text."""

import random

from trawl.config import Settings
from trawl.operators.chunking import chunk_filings, chunk_stats

SMALL = Settings(chunk_size=60, chunk_overlap=20, chunk_min_size=15)
FILING = "ticker string, filing_date string, sections array<struct<section:string,text:string>>"


def texts():
    rng = random.Random(7)
    made = ["", "  \n ", "short", "x" * 200, "a" * 14, "head\n" + "b" * 59 + "\n" + "tail " * 9]
    alphabet = ["a", "bb", "ccc", " ", " ", ". ", "? ", "! ", "\n", "\n\n", "é", " ", "w" * 30]
    for _ in range(150):
        made.append("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 160))))
    return made


def chunks_of(spark, cases):
    filings = spark.createDataFrame([(f"T{i}", "2026-01-01", t) for i, t in enumerate(cases)], FILING)
    found = {f"T{i}": [] for i in range(len(cases))}
    for r in chunk_filings(filings, SMALL).orderBy("chunk_id").collect():
        found[r["ticker"]].append(r)
    return list(found.values())


def test_worked_examples(spark):
    sentences = "aaaa bbbb cccc dddd. eeee ffff gggg hhhh. iiii jjjj kkkk llll."
    examples = {
        "": [],
        "short": [],
        "just long enough": ["just long enough"],
        # no separator: hard cuts; an overlap that does not fit is left out
        "x" * 200: ["x" * 60] * 3 + ["x" * 20 + "\n" + "x" * 20],
        # whole sentences, and an overlap that begins at a word
        sentences: ["aaaa bbbb cccc dddd. eeee ffff gggg hhhh", "eeee ffff gggg hhhh\niiii jjjj kkkk llll."],
        # a header below the minimum joins what follows, beyond the size
        "head\n" + "b" * 59: ["head\n" + "b" * 59],
    }
    found = chunks_of(spark, [[("A", t)] for t in examples])
    assert [[r["text"] for r in rows] for rows in found] == list(examples.values())


def test_properties_of_any_text(spark):
    cases = texts()
    found = chunks_of(spark, [[("A", t), ("B", t[: len(t) // 2])] for t in cases])
    for i, (text, rows) in enumerate(zip(cases, found)):
        # numbered through the filing, and from 0 in each section
        assert [r["chunk_id"] for r in rows] == [f"T{i}-2026-01-01-{n:04d}" for n in range(len(rows))]
        for section, body in (("A", text), ("B", text[: len(text) // 2])):
            own = [r for r in rows if r["section"] == section]
            assert [r["chunk_index"] for r in own] == list(range(len(own)))
            assert bool(own) or len(body.strip()) < 60
            for r in own:
                chunk = r["text"]
                assert SMALL.chunk_min_size <= len(chunk) <= SMALL.chunk_size + SMALL.chunk_min_size
                assert chunk.rsplit("\n", 1)[-1] in body
                if chunk in body:
                    assert body[r["char_start"] : r["char_end"]] == chunk
                elif r["char_start"] >= 0:
                    assert body[: r["char_end"]].endswith(chunk[-min(80, len(chunk)) :])
                else:
                    assert r["char_end"] == -1


def test_other_columns_are_carried(spark):
    filings = spark.createDataFrame(
        [("T", "2026-01-01", "0001", [("A", "word " * 100)])],
        "ticker string, filing_date string, cik string, sections array<struct<section:string,text:string>>",
    )
    found = chunk_filings(filings, SMALL)
    assert found.select("cik").distinct().collect()[0][0] == "0001"
    assert all(len(r["text"]) <= 60 + 15 for r in found.collect())


def test_stats_take_positions_not_means(spark):
    lengths = [3, 9, 1, 7, 5, 5, 2, 8]
    rows = spark.createDataFrame([("s", "x" * n) for n in lengths], "section string, text string")
    r = chunk_stats(rows, "section").first()
    ordered, n = sorted(lengths), len(lengths)
    assert tuple(r)[1:] == (n, 1, ordered[n // 2], ordered[min(n - 1, int(n * 0.95))], 9)
