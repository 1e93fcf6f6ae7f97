"""Toxicity by compression distance.

Two zstandard dictionaries are trained: an ordinary one on windows of ordinary
text, and a toxic one on what is peculiar to toxic text, which extends the ordinary
one. A window of a few words is compressed with each; the bytes that the toxic dictionary
saves are its evidence. A text's evidence is summed up over all its windows
and turned into a score by a logistic curve, calibrated on labelled texts that the
dictionaries were not trained on.
"""

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, functions as F

WINDOW = 8  # words
GRAM = 5  # characters
STEPS = (1, 2, 3, 4, 5, 6, 8)  # saved bytes at which windows are counted


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple


def words_of(text):
    return text.lower().split()


def windows(text, size=WINDOW):
    """All of a text in stretches of ``size`` words; none for a text without words."""
    words = words_of(text)
    return [" ".join(words[i : i + size]).encode() for i in range(0, len(words), size)]


def grams(word, size=GRAM):
    """The stretches of ``size`` characters of a word and the space before it."""
    word = f" {word}"
    return {word[i : i + size] for i in range(len(word) - size + 1)}


def peculiar_part(word, peculiar, size=GRAM):
    """What of a word peculiar grams cover."""
    word = f" {word}"
    held = [False] * len(word)
    for i in range(len(word) - size + 1):
        if word[i : i + size] in peculiar:
            held[i : i + size] = [True] * size
    return "".join(c for c, h in zip(word, held) if h)


class Compressors:
    def __init__(self, ordinary, toxic):
        options = zs.ZstdCompressionParameters(
            window_log=18, chain_log=16, hash_log=17, search_log=4, min_match=4, target_length=8,
            strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_checksum=False,
            write_dict_id=False,
        )

        def compressor(data):
            kept = zs.ZstdCompressionDict(data, dict_type=zs.DICT_TYPE_RAWCONTENT)
            return zs.ZstdCompressor(compression_params=options, dict_data=kept).compress

        self.plain, self.rich = compressor(ordinary), compressor(toxic + ordinary)

    def features(self, text):
        """Evidence of a whole text; zeros without words."""
        plain, rich = self.plain, self.rich
        saved = np.array([len(plain(w)) - len(rich(w)) for w in windows(text)], dtype=np.int64)
        out = np.zeros(len(STEPS) + 4)
        if len(saved):
            top = np.sort(saved)[::-1]
            out[: len(STEPS)] = [np.log1p(np.count_nonzero(saved >= s)) for s in STEPS]
            out[-4:] = [np.log1p(len(saved)), top[0] / 4, top[:3].clip(0).sum() / 8, saved[saved >= 3].sum() / len(saved)]
        return out


def logistic(features, labels, ridge=1.0, rounds=60):
    """Weights of a logistic curve, the last one constant, by Newton's method."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w, y = np.zeros(x.shape[1]), np.asarray(labels, dtype=np.float64)
    hold = np.full(len(w), ridge)
    hold[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + hold * w
        curve = (x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(hold)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def trained(samples, size, fallback):
    """A dictionary; the samples themselves where they are too few to train one."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b" ".join(samples)[-size:] or fallback


def fit(rows, ordinary_bytes=100_000, toxic_bytes=1280, seen=8, ratio=15.0):
    """A model from (id, text, label) rows held in memory.

    A third of the rows calibrate, the others train. The toxic dictionary is trained on those
    parts of words that occur in at least ``seen`` toxic texts and ``ratio`` times as often
    in them as in ordinary ones.
    """
    first = {}
    for i, text, label in rows:  # copies would count as evidence several times
        first.setdefault(text or "", (i, text or "", int(label)))
    rows = list(first.values())
    part = [zlib.crc32(f"part {i}".encode()) % 3 for i, _, _ in rows]
    train = [r for r, p in zip(rows, part) if p]
    check = [r for r, p in zip(rows, part) if not p]
    toxic = [words_of(t) for _, t, y in train if y]
    plain = [t for _, t, y in train if not y]
    often, rare = Counter(), Counter()
    for words in toxic:
        often.update(set().union(*map(grams, set(words))))
    for text in plain:
        rare.update(set().union(*map(grams, set(words_of(text)))))
    peculiar = {
        g for g, n in often.items()
        if n >= min(seen, max(2, len(toxic) // 20))
        and n / len(toxic) >= ratio * (rare[g] + 0.5) / max(len(plain), 1)
    }
    evidence = ["".join(peculiar_part(w, peculiar) for w in words).encode() for words in toxic]
    ordinary = trained([w for t in plain[:2000] for w in windows(t)], ordinary_bytes, b" ")
    model = Compressors(ordinary, dictionary := trained(evidence, toxic_bytes, b" "))
    labels = [y for _, _, y in check]
    if len(set(labels)) < 2:  # nothing to calibrate on: the share of toxic rows for all
        share = (sum(y for _, _, y in rows) + 0.5) / (len(rows) + 1)
        weights = (*[0.0] * (len(STEPS) + 4), float(np.log(share / (1 - share))))
    else:
        weights = logistic(np.array([model.features(t) for _, t, _ in check]), labels)
    return ToxicityModel(ordinary, dictionary, weights)


def training_rows(
    docs: DataFrame, labels: DataFrame, toxic_rows=2500, ordinary_rows=6000, max_chars=20_000,
    id_col="doc_id", text_col="text", label_col="toxic",
):
    """A bounded sample of labelled rows: at most ``toxic_rows`` and ``ordinary_rows``
    ids in the order of a hash, of texts up to ``max_chars`` long.

    Rows without id or label are left out; an id labelled twice counts as toxic if
    one label says so.
    """
    labels = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    labels = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    dealt = labels.select("id", "label", F.xxhash64(F.lit("sample"), "id").alias("order"))
    chosen = None
    for label, most in ((1, toxic_rows), (0, ordinary_rows)):
        part = dealt.filter(F.col("label") == label).orderBy("order", "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(
        F.length("text") <= max_chars
    )
    # the sample's bound is the two parameters, so it may be sent to every task
    rows = texts.join(F.broadcast(chosen.select("id", "label")), "id").collect()
    return sorted({(r["id"], r["text"], r["label"]) for r in rows})


def held_out(id_col="doc_id"):
    """Rows whose labels are never learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: id, score. Only the text makes the score.

    Null and empty texts have no windows and get the score of no evidence. Ids may be null or repeat.
    An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]

    def scored(batches):
        compressors, weights = Compressors(model.ordinary, model.toxic), np.array(model.weights)
        for batch in batches:
            features = [compressors.features(t.as_py() or "") for t in batch.column(1)]
            x = np.array(features).reshape(len(features), len(weights) - 1)
            score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scored, f"id {kind}, score double").withColumnRenamed("id", id_col)
