"""Spelling variants, fill-in-the-middle and personal data against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trawl.llm import fill_middle as fim, pii
from trawl.llm.spelling import spelling_variants, word_counts

DOCS = "doc_id long, text string"
ODD = [(None, "Straße straße STRASSE straßen"), (1, None), (2, ""), (3, "abcdefgh " * 3), (3, "abcdefgh " * 3), (4, "x" * 200_000), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    clash = ["doc_id", "text", "text as word", "doc_id as n", "1 as id", "'s' as form", "2 as output", "3 as spans"]
    return spark.createDataFrame(ODD, DOCS).selectExpr(*clash)


# --- spelling ---------------------------------------------------------------


def plain_counts(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain_variants(counts):
    near, holes = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            hole = w[:k] + w[k + 1 :]
            holes[k, hole].add(w)
            if hole in counts:
                near[w].add(hole)
                near[hole].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(((-counts[x], x) for x in near[w]), default=(0, None))
        form[w] = best[1] if best[1] is not None and -best[0] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def found_variants(counts):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(counts).collect()}


def test_words_and_variants_of_documents(documents, texts):
    counts = word_counts(documents)
    want = plain_counts(texts)
    assert {r["word"]: r["n"] for r in counts.collect()} == want
    assert found_variants(counts) == plain_variants(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_of_runs_and_long_words(spark, seed):
    draw = random.Random(seed)
    words = {"".join(draw.choice("aabé") for _ in range(draw.randint(1, 6))) for _ in range(500)}
    words |= {"a" * k for k in range(1, 30)} | {"xyz" * 700, "xyz" * 700 + "q", "q" + "xyz" * 700, "xyz" * 350 + "y" + "xyz" * 350}
    counts = {w: draw.randint(1, 2000) for w in words}
    assert found_variants(spark.createDataFrame(list(counts.items()), "word string, n long")) == plain_variants(counts)


def test_variants_of_odd_rows(spark, odd):
    got = found_variants(word_counts(odd))
    assert got == plain_variants(plain_counts(ODD)) and "abcdefgh" in got
    assert found_variants(word_counts(odd.limit(0))) == {}
    counts = spark.createDataFrame([(None, 9), ("abcdefg", 1)], "word string, n long").selectExpr("*", "1 as id", "2 as node")
    assert found_variants(counts) == {"abcdefg": (None, "abcdefg", 1, 0, None)}
    with pytest.raises(ValueError):
        spelling_variants(counts, ratio=1)


def test_chains_of_forms_end_at_the_root(spark):
    chain = [("a" * k + "bbbbbbb", 3 * 10**k) for k in range(12)]
    got = found_variants(spark.createDataFrame(chain, "word string, n long"))
    assert {root for _, root, *_ in got.values()} == {"a" * 11 + "bbbbbbb"}


# --- fill in the middle ---------------------------------------------------------


def test_fill_in_middle(documents, texts):
    rows = {r["doc_id"]: r for r in fim.restore(fim.fill_in_middle(documents)).collect()}
    forms = Counter()
    for i, text in texts:
        row, n = rows[i], len(text)
        digest = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "<P>" + text[:low], "<M>" + text[low:high], "<S>" + text[high:]
        form = "plain" if not n or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        want = {"plain": text, "psm": p + s + m, "spm": s + p + m}[form]
        sizes = (None, None) if form == "plain" else (low, high - low)
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"]) == (n, form, *sizes)
        assert row["output"] == want and row["restored"] == text
        forms[form] += 1
    assert len(forms) == 3


def test_fill_in_middle_of_odd_rows(spark, odd):
    rows = fim.restore(fim.fill_in_middle(odd))
    assert sorted((r["doc_id"] or -1, r["restored"]) for r in rows.collect()) == sorted((i or -1, t or "") for i, t in ODD)
    assert rows.limit(0).collect() == [] == fim.fill_in_middle(odd.limit(0)).collect()
    marked = [(i, t) for i in range(20) for t in ("a <S> b", "<P>", "<M>", "<<S", "S>é\U0001f600<")]
    got = fim.restore(fim.fill_in_middle(spark.createDataFrame(marked, DOCS), plain_percent=0)).collect()
    assert Counter((r["doc_id"], r["restored"]) for r in got) == Counter(marked)
    assert {r["form"] for r in got if r["restored"] in ("a <S> b", "<P>", "<M>")} == {"plain"}
    assert {r["form"] for r in got if r["restored"] == "<<S"} == {"psm", "spm"}


def test_every_cut_comes_back():
    text = "aé\U0001f600b<S"
    for low, high in itertools.combinations_with_replacement(range(len(text) + 1), 2):
        for form in (fim.PSM, fim.SPM):
            assert fim.restored(fim.transformed(text, low, high, form), form) == text
    long_text = "wörd " * 400_000
    assert fim.restored(fim.transformed(long_text, 3, 1_999_999, fim.SPM), fim.SPM) == long_text
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("abc", "b", "x"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.check_sentinels(bad)


# --- personal data -----------------------------------------------------------------


def plain_luhn(said):
    digits = [int(c) for c in said if c.isdigit()][::-1]
    return sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])


def plain_base(text):
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= sum(c.isdigit() for c in m) <= 19 and plain_luhn(m) % 10 == 0),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (rule, holds) in enumerate(rules) for m in re.finditer(rule, text) if holds(m.group()))


@pytest.fixture(scope="module")
def field(documents):
    return pii.fit(documents)


def test_rules_of_personal_data():
    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice(["@", ".", "1", "25", "4111111111111111", "+", "-", " ", "a", "b.c", "(", ")", "é", "300", "01"]) for _ in range(draw.randint(1, 25)))
        assert pii.base_spans(text) == plain_base(text), text


def test_base_spans_of_documents(documents, texts, field):
    rows = {r["doc_id"]: r for r in pii.find_personal_data(documents, field).collect()}
    for i, text in texts:
        base = plain_base(text)
        row, said = rows[i], ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [row[f"n_{kind}"] for kind in pii.KINDS] == [sum(b[1] == k for b in base) for k in range(4)]
        assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) <= set(row["spans"].split(","))


FILLER = " lorem ipsum dolor sit amet" * 40
AGAIN = [  # said in full, and far from there in another form
    ("+1 (376) 555-1700", "(376) 555-1700", "phone"), ("+1 (376) 555-1700", "376.555.1700", "phone"),
    ("+44 20 7946 0958", "020 7946 0958", "phone"), ("4111111111111111", "4111.1111.1111.1111", "card"),
    ("5500 0000 0000 0004", "5500/0000/0000/0004", "card"), ("15.174.185.166", "15 174 185 166", "ip"),
    ("abc.63@mail5.example.com", "abc.63 (at) mail5.example.com", "email"), ("abc.63@mail5.example.com", "abc.63@mail5", "email"),
]


def test_links_carry_labels_to_other_forms(spark, field):
    rows = [(i, f"see {full}{FILLER} or {form}, then") for i, (full, form, _) in enumerate(AGAIN)]
    found = {r["doc_id"]: r["spans"].split(",") for r in pii.find_personal_data(spark.createDataFrame(rows, DOCS), field).collect()}
    caught = 0
    for (i, text), (full, form, kind) in zip(rows, AGAIN):
        at = text.rindex(form)
        assert len(found[i]) <= 2
        caught += f"{kind}:{at}:{at + len(form)}" in found[i]
    assert caught / len(AGAIN) >= 0.9


def test_other_numbers_stay_out(spark, field):
    draw = random.Random(9)
    rows = [(i, f"made {draw.randint(10**8, 10**9)} of 1{FILLER} and {draw.randint(10**6, 10**7)} in 2019-2024") for i in range(50)]
    rows += [(100, "no 4111111111111112, again 4111111111111112"), (101, "token = 0123456789abcdef")]
    assert [r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, DOCS), field).collect() if r["spans"]] == []


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(3)
    alone = rng.normal(size=(6, 3))
    ends = np.array([(0, 1), (1, 2), (1, 3), (3, 4), (3, 5)])
    tables = rng.normal(size=(5, 3, 3))
    want = np.zeros((6, 3))
    for labels in itertools.product(range(3), repeat=6):
        weight = np.exp(sum(alone[i, a] for i, a in enumerate(labels)) + sum(t[labels[i], labels[j]] for (i, j), t in zip(ends, tables)))
        want[range(6), labels] += weight
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(pii.belief_propagation(alone, ends, tables), want, atol=1e-6)
    none = np.zeros((0, 2), dtype=int), np.zeros((0, 3, 3))
    assert np.allclose(pii.belief_propagation(alone, *none), np.exp(alone) / np.exp(alone).sum(axis=1, keepdims=True))


def test_links_grow_with_the_mentions():
    text = "+1 (376) 555-1700, " + "(376) 555-1700, " * 500
    graph = pii.Graph()
    graph.add(0, text)
    assert len(graph.label) == 501 and len(graph.skip) <= 2 * 501
    likely = pii.Field(np.zeros((len(pii.FEATURES), 5)), np.zeros((5, 5)), np.array([4.0, 3.0])).marginals(graph)
    assert (likely.argmax(axis=1) == 4).all()


def test_personal_data_of_odd_rows(spark, field, odd):
    rows = pii.find_personal_data(odd, field)
    assert rows.count() == len(ODD) and {r["spans"] for r in rows.collect()} == {""}
    assert pii.find_personal_data(odd.limit(0), field).collect() == []
    hard = [(1, "x" * 300_000 + "@"), (2, "1 " * 100_000), (3, "9" * 200_000), (4, "+1" + "(" * 100_000), (5, "a@b@" * 50_000), (6, "1." * 100_000)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(hard, DOCS), field).collect()}
    assert [got[i]["n_email"] for i in (1, 5)] == [0, 0]
    assert got[6]["n_ip"] == 25_000
    untrained = pii.fit(odd.limit(0))
    assert pii.find_personal_data(odd, untrained).count() == len(ODD)
