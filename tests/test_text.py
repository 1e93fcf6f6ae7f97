from pyspark.sql import functions as F

from trawl.config import Settings, model_name
from trawl.functions import text as tx
from trawl.functions.automaton import automaton, found_in, named_companies, whole_words
from trawl.functions.vectors import dot, l2_norm

import random
import re

import pytest


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], list(inputs)) if inputs else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_tokens_keep_order_repeats_and_digits(spark):
    got = value(spark, tx.tokens(F.col("t")), t="The (FDDEI) rule, Section 232; the RULE")
    assert got == ["the", "fddei", "rule", "section", "232", "the", "rule"]


def test_question_of_stop_words_keeps_its_tokens(spark):
    q = tx.lexical_tokens(F.col("q"))
    assert value(spark, q, q="What does it say about GDPR GDPR?") == ["gdpr", "gdpr"]
    assert value(spark, q, q="What is it?") == ["what", "is", "it"]


def test_strip_matches_python(spark):
    for text in ("   a b  \x1c", "  \n", "x", "\ta　"):
        assert value(spark, tx.strip(F.col("t")), t=text) == text.strip()


def test_preview_cuts_at_a_late_space_only(spark):
    p = tx.preview(F.col("t"))
    assert value(spark, p, t="a" * 300) == "a" * 200
    early = "ab " + "c" * 300
    assert value(spark, p, t=early) == early[:200]
    late = "a" * 170 + " " + "b" * 100
    assert value(spark, p, t=late) == "a" * 170
    assert value(spark, p, t="one\ntwo") == "one | two"


def test_companies_are_whole_words_in_any_case(spark):
    names = Settings().companies
    found = named_companies(F.col("q"), names)
    assert value(spark, found, q="compare tesla's and NVDA") == ["NVDA", "TSLA"]
    assert value(spark, found, q="pineapple, Teslas") == []


def test_names_follow_word_boundaries(spark):
    """Against one regular expression for each name."""
    names = ["a", "ab", "a b", "ab.", ".a", "é", "ab-a", "_a", "a1"]
    draw = random.Random(2)
    texts = ["".join(draw.choice("aab é.-_1") for _ in range(draw.randint(0, 12))) for _ in range(300)]
    machine = automaton((n, n) for n in names)
    for text in texts:
        want = {n for n in names if re.search(rf"\b{re.escape(n)}\b", text)}
        assert whole_words(machine, text) == want, text
        got = sorted((a, b) for a, b, _ in found_in(machine, text))
        assert got == sorted((i, i + len(n)) for n in names for i in range(len(text)) if text.startswith(n, i))


def test_the_plan_does_not_grow_with_the_names(spark):
    frame = spark.createDataFrame([("c7 and Name 4242, nAME 1",), (None,)], ["q"])
    sizes = []
    for n in (3, 10_000):
        companies = {f"C{i}": (f"name {i}",) for i in range(n)}
        found = frame.select(named_companies(F.col("q"), companies).alias("n"))
        sizes.append(len(found._jdf.queryExecution().toString()))
    assert [r["n"] for r in found.collect()] == [["C1", "C4242", "C7"], []]
    assert abs(sizes[1] - sizes[0]) < 100


def test_filter_mismatch(spark):
    named = F.split("q", " ")
    assert value(spark, tx.filter_mismatch(F.lit("tsla"), named), q="AAPL NVDA") is True
    assert value(spark, tx.filter_mismatch(F.lit("aapl"), named), q="AAPL NVDA") is False
    assert value(spark, tx.filter_mismatch(F.lit(None).cast("string"), named), q="AAPL") is False


def test_citations_take_any_bracketed_id(spark):
    got = value(spark, tx.citations(F.col("a")), a="x [B-1] y [A.2_c] [B-1] [1] [Reserved] [-x] [a b]")
    assert got == ["1", "A.2_c", "B-1", "Reserved"]


@pytest.mark.parametrize(
    "similarity,label,band",
    [(0.75, "very high", "answer"), (0.58, "moderate", "answer"), (0.52, "low", "weak"), (0.51, "very low", "refuse")],
)
def test_bands(spark, similarity, label, band):
    s = F.lit(similarity)
    assert value(spark, tx.confidence_label(s)).startswith(label)
    assert value(spark, tx.refusal_band(s, Settings())) == band


def test_bar_rounds_halves_to_even(spark):
    assert value(spark, tx.similarity_bar(F.lit(0.0125))) == ""
    assert value(spark, tx.similarity_bar(F.lit(0.0375))) == "##"


def test_id_company_falls_back_to_the_ticker(spark):
    name = tx.id_company(F.col("i"), Settings().companies)
    assert value(spark, name, i="NVDA-2026-02-25-0001") == "NVIDIA"
    assert value(spark, name, i="IBM-2026-02-25-0001") == "IBM"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.5])], "a array<float>, b array<float>")
    assert df.select(dot("a", "b"), l2_norm("a")).first()[:] == (5.0, 5.0)


def test_settings():
    assert model_name("haiku") == "claude-haiku-4-5" and model_name("my/model") == "my/model"
    with pytest.raises(ValueError):
        Settings(top_k=0)
    with pytest.raises(ValueError):
        Settings(fusion="sum")
