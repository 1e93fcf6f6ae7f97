"""The pipeline's stages, each on what the one before it kept, against plain versions."""

from collections import Counter

from pyspark.sql import functions as F

from helpers import WORD, joined_components, lines_removed

import corpus_pipeline as cp
from trawl.llm.packing import tokenizer_path


def test_stages(spark, small, documents):
    from tokenizers import Tokenizer

    docs, columns = documents, documents.columns
    for name, stage in cp.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        done = cp.written(stage(spark, docs, small), "stage")
        if name != "best-fit packing":
            assert done.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in done.collect())
        out = [(r["doc_id"], r["text"]) for r in done.collect()] if "text" in done.columns else None
        if name == "toxicity":
            assert set(out) <= set(rows) and len(out) > 0.8 * len(rows)
        elif name == "line dedup":
            kept = lines_removed(rows, 50)
            assert dict(out) == {i: t for i, t in kept.items() if t.strip(" ") or t == dict(rows)[i]}
        elif name == "n-gram Jaccard join":
            want = {i for i, (_, c) in joined_components(rows, 5, 80, 100).items() if i == c}
            assert sorted(i for i, _ in out) == sorted(want)
        elif name.startswith("mixing"):
            assert set(out) <= set(rows) and max(Counter(out).values()) <= 3
            words = lambda rs: sum(len(WORD.findall(t)) for _, t in rs)
            assert abs(words(out) - words(rows)) < 0.25 * words(rows)
        else:
            ids = Tokenizer.from_file(tokenizer_path())
            total = sum(len(ids.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
            assert sum(r["length"] for r in done.collect()) == total
        docs = done


def test_rows_without_id_and_of_one_id(spark, small, monkeypatch):
    row = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda made: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], row)
    kept = cp.mixed(spark, make([(None, "three words here"), (1, "one two"), (None, "four more words here")]), small)
    assert {r["text"] for r in kept.collect()} == {"three words here", "one two", "four more words here"}
    assert {r["doc_id"] for r in kept.collect()} == {None, 1}
    rude = F.contains("text", F.lit("rude")).cast("double").alias("score")
    monkeypatch.setattr(cp, "toxicity_model", lambda *_: None)
    monkeypatch.setattr(cp, "score_toxicity", lambda docs, _: docs.select("doc_id", rude))
    docs = make([(None, "rude"), (None, "calm"), (7, "rude"), (7, "calm"), (8, "rude")])
    left = [(r["doc_id"], r["text"]) for r in cp.clean_of_toxicity(spark, docs, small).collect()]
    assert sorted(left, key=str) == [(7, "calm"), (None, "calm")]


def test_odd_documents(spark, small):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "x", None, "s", 1), (2, None, "en", "s", None), (2, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            df = cp.written(stage(spark, df, small), "stage")
        assert df.columns[0] == "doc_id"
