"""Inverted index and Okapi BM25 over a corpus of (id, ticker, tokens)."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from trawl.functions.text import informative_tokens, lexical_tokens, tokens
from trawl.operators.questions import Questions
from trawl.operators.ranking import Best, merge_top_k, slices, wrong_company
from trawl.session import written

BLOCK = 1024
ROWS = 512  # documents whose words are worked out at a time
PIECE = 1_000_000  # words that a task counts at a time
KEPT = 8  # question blocks whose words in the corpus stay at hand


def postings(docs: DataFrame, *carried) -> DataFrame:
    """One row per (document, term): id, ticker, dl, term, tf and the ``carried`` columns. No shuffle.

    Equal tokens sit together once sorted, so a run's length is its count.
    Arrays are unrolled with the outer generators throughout: the plain ones
    add a non-empty filter that computes the array a second time.
    """
    tok, starts = F.col("tok"), F.col("starts")
    run_start = F.transform(
        tok, lambda t, i: F.when((i == 0) | (F.get(tok, i - 1) != t), i)
    )
    run_end = F.coalesce(F.get(starts, F.col("pos") + 1), F.size(tok))
    return (
        docs.select("id", "ticker", *carried, F.sort_array("tokens").alias("tok"))
        .withColumn("starts", F.array_compact(run_start))
        .select("id", "ticker", *carried, "tok", "starts", F.posexplode_outer("starts").alias("pos", "at"))
        .filter(F.col("at").isNotNull())
        .select(
            "id",
            "ticker",
            F.size("tok").alias("dl"),
            F.get("tok", F.col("at")).alias("term"),
            (run_end - F.col("at")).alias("tf"),
            *carried,
        )
    )


def pieces(batch, column, most):
    """The batch in stretches of rows whose lists in ``column`` hold about ``most`` entries together."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy())
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def unrolled(lists):
    """(row of each entry, entries) of a column of lists."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.repeat(np.arange(len(lengths)), lengths), lists.flatten()


def starts(*sorted_keys):
    """Where a run of equal keys begins."""
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return np.flatnonzero(new)


def word_counts(lists):
    """(row, word, tf, words): how often a row's list has which of the distinct words, by row."""
    row, words = unrolled(lists)
    words = words.dictionary_encode()
    many = max(1, len(words.dictionary))
    cell, tf = np.unique(row * many + words.indices.to_numpy(), return_counts=True)
    return *np.divmod(cell, many), tf, words.dictionary


def held_lists(words, word, tf, edges):
    """Lists of (term, tf) that begin and end at ``edges``."""
    entries = [words.take(pa.array(word)), pa.array(tf.astype(np.int32))]
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays(entries, ["term", "tf"]))


def lengths(lists):
    return pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())


def counted(docs: DataFrame) -> DataFrame:
    """One row per document: id, ticker, dl, held (term, tf), by term. No shuffle."""
    tok, begin = F.col("tok"), F.col("begin")
    run_start = F.transform(tok, lambda t, i: F.when((i == 0) | (F.get(tok, i - 1) != t), i))
    held = F.transform(
        begin, lambda s, j: F.struct(F.get(tok, s).alias("term"), (F.coalesce(F.get(begin, j + 1), F.size(tok)) - s).alias("tf"))
    )
    return (
        docs.select("id", "ticker", F.sort_array("tokens").alias("tok"))
        .withColumn("begin", F.array_compact(run_start))
        .select("id", "ticker", F.size("tok").alias("dl"), held.alias("held"))
    )


def word_bucket(buckets, term="term"):
    """The bucket of a term in ``bucketed``, which finds it outside the JVM."""
    return (F.crc32(term) % buckets).cast("int")


def bucketed(docs: DataFrame, buckets: int, *carried) -> DataFrame:
    """One row per document and term bucket that it has words in: id, ticker, dl, lead, held (term, tf), the
    ``carried`` columns and bucket. No shuffle.

    ``lead`` marks one row of each document; a document without words has that row alone, with nothing held.
    """

    def rows(batches):
        for piece in (p for batch in batches for p in pieces(batch, "tokens", PIECE)):
            row, word, tf, words = word_counts(piece.column("tokens"))
            dealt = np.array([zlib.crc32(t) % buckets for t in words.cast(pa.binary()).to_pylist()], dtype=np.int64)
            key = row * buckets + dealt[word]
            order = np.argsort(key, kind="stable")
            first = starts(key[order])
            own, bucket = np.divmod(key[order][first], buckets)
            lead = np.zeros(len(own), dtype=bool)
            lead[starts(own)] = True
            empty = np.setdiff1d(np.arange(piece.num_rows), own)
            edges = np.concatenate([first, np.full(len(empty) + 1, len(key))])
            taken = pa.array(np.concatenate([own, empty]))
            columns = {
                "id": piece.column("id").take(taken), "ticker": piece.column("ticker").take(taken),
                "dl": lengths(piece.column("tokens")).take(taken),
                "lead": pa.array(np.concatenate([lead, np.ones(len(empty), dtype=bool)])),
                "held": held_lists(words, word[order], tf[order], edges),
                **{c: piece.column(c).take(taken) for c in carried},
                "bucket": pa.array(np.concatenate([bucket, np.zeros(len(empty), dtype=np.int64)]).astype(np.int32)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(
        [f"`{c}` {types[c]}" for c in ("id", "ticker")] + ["dl int, lead boolean, held array<struct<term:string,tf:int>>"]
        + [f"`{c}` {types[c]}" for c in carried] + ["bucket int"]
    )
    return docs.select("id", "ticker", "tokens", *carried).mapInArrow(rows, schema)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n and avgdl. Documents without tokens count in both."""
    return docs.agg(
        F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl")
    )


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_stats(docs: DataFrame) -> DataFrame:
    """df and smoothed idf per term. Each document sends each term once."""
    n = docs.agg(F.count("*").alias("n")).scalar()
    counted = (
        docs.select(F.explode_outer(F.array_distinct("tokens")).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    return counted.withColumn("idf", idf(n, F.col("df")))


class Asks:
    """Which questions ask for a term, how often, and at which place first."""

    def __init__(self, asked, terms):
        self.questions, self.terms = len(asked), terms
        places = np.full((len(asked), max([1, *map(len, asked)])), -1, dtype=np.int64)
        for q, row in enumerate(asked):
            places[q, : len(row)] = row
        self.places = places
        question, position = np.nonzero(places >= 0)
        pair, times = np.unique(places[question, position] * max(1, len(asked)) + question, return_counts=True)
        term, self.question = np.divmod(pair, max(1, len(asked)))
        self.times = times.astype(float)
        self.start = np.searchsorted(term, np.arange(terms + 1))

    def scored(self, rows, row, term, gain, cells=250_000):
        """Scores of stretches of rows as (first, last, matrix, ties); -inf where nothing matches.

        One addition for each word of a row and question that asks for it. A stretch ends before
        its matrix or its additions outgrow ``cells``.
        """
        width = self.start[term + 1] - self.start[term]
        work = np.cumsum(np.bincount(row, weights=width, minlength=rows))
        most = max(1, cells // max(1, self.questions))
        first = 0
        while first < rows:
            before = work[first - 1] if first else 0
            last = max(first + 1, min(first + most, rows, int(np.searchsorted(work, before + cells, "right"))))
            part = slice(*np.searchsorted(row, [first, last]))
            wide = width[part]
            at = np.arange(wide.sum()) + np.repeat(self.start[term[part]] - np.cumsum(wide) + wide, wide)
            cell = np.repeat((row[part] - first) * self.questions, wide) + self.question[at]
            added = np.repeat(gain[part], wide) * self.times[at]
            scores = np.bincount(cell, weights=added, minlength=(last - first) * self.questions).astype(float)
            scores[scores <= 0] = -np.inf
            held = (row[part] - first) * self.terms + term[part]
            yield first, last, scores.reshape(last - first, self.questions), self.first_place(held)
            first = last

    def first_place(self, held):
        """A function of rows and questions: the first place of a word that the row holds."""

        def ties(row, question):
            places = self.places[question]
            key = np.where(places < 0, -1, row[:, None] * self.terms + places)
            at = np.minimum(np.searchsorted(held, key), len(held) - 1)
            return np.argmax(held[at] == key, axis=1)

        return ties


class LexicalIndex:
    """BM25 over a corpus; idf and average length are always corpus-wide.

    ``docs`` holds id, ticker and tokens: computed on the fly or read from a
    table that ``from_text(...).docs`` was written to.
    """

    def __init__(self, docs: DataFrame, settings):
        self.docs = docs
        self.settings = settings
        self._n = None
        self._avgdl = None
        self._df = {}
        self._lately = []

    @classmethod
    def from_text(cls, corpus: DataFrame, settings) -> "LexicalIndex":
        """A null text counts as a document without words."""
        words = tokens(F.coalesce("text", F.lit(""))).alias("tokens")
        return cls(corpus.select("id", "ticker", words), settings)

    @property
    def n(self):
        if self._n is None:
            self._n = self.docs.count()
        return self._n

    def rare_ceiling(self):
        return max(1, round(self.settings.rare_fraction * self.n))

    def term_frequencies(self, questions: Questions) -> DataFrame:
        """term, df of the questions' words that the corpus holds."""
        words = questions.df.select(F.explode(lexical_tokens(F.col("question"))).alias("term")).distinct()
        found = [self._held(known)[0] for _, _, known in self._vocabularies(questions)]
        if not found:
            return words.withColumn("df", F.lit(0).cast("long"))
        counts = found[0]
        for more in found[1:]:
            counts = counts.unionByName(more)
        counts = counts.groupBy("hash").agg(F.max("df").alias("df"))
        return words.withColumn("hash", F.xxhash64("term")).join(counts, "hash").select("term", "df")

    def document_frequencies(self, questions: Questions) -> DataFrame:
        """query_id, position, term, df of every informative question token."""
        terms = questions.df.select(
            "query_id", F.posexplode(informative_tokens(F.col("question"))).alias("position", "term")
        )
        # of a stored table of terms only the asked ones go on to the outer join
        found = self.term_frequencies(questions).join(terms.select("term").distinct(), "term", "left_semi")
        return terms.join(found, "term", "left").select(
            "query_id", "position", "term", F.coalesce("df", F.lit(0)).alias("df")
        )

    def looks_lexical(self, questions: Questions) -> DataFrame:
        """query_id, opaque: does the question hold a token rare in the corpus?"""
        rare = F.col("df").between(1, self.rare_ceiling())
        flagged = (
            self.document_frequencies(questions)
            .groupBy("query_id")
            .agg(F.max(rare).alias("opaque"))
        )
        return questions.df.join(flagged, "query_id", "left").select(
            "query_id", F.coalesce("opaque", F.lit(False)).alias("opaque")
        )

    def search(self, questions: Questions, k: int) -> DataFrame:
        """query_id, bm25_rank, id, bm25_score for documents with a hit.

        A task scores whole documents in Arrow batches and emits its k best
        per question, so no (question, document) pair is shuffled. Ties go to
        the earliest matching question token, then to document order.
        """
        schema = T.StructType(
            [
                T.StructField("query_id", questions.df.schema["query_id"].dataType),
                T.StructField("id", self.docs.schema["id"].dataType),
                T.StructField("bm25_score", T.DoubleType()),
                T.StructField("tie", T.IntegerType()),
            ]
        )
        blocks = self._vocabularies(questions)
        hits = questions.union([self._scan(*block, k, schema) for block in blocks], schema)
        order = [F.desc("bm25_score"), F.asc("tie"), F.asc("id")]
        return merge_top_k(hits, k, order, "bm25_rank").select(
            "query_id", "bm25_rank", "id", "bm25_score"
        )

    def _vocabularies(self, questions):
        """Blocks of questions with each one's words, and {word: hash} of the block."""
        terms = lexical_tokens(F.col("question"))
        for block in questions.blocks({"terms": terms, "hashes": F.transform(terms, lambda t: F.xxhash64(t))}, BLOCK):
            asked, hashes = block["terms"].to_pylist(), block["hashes"].to_pylist()
            known = dict(zip((t for row in asked for t in row), (h for row in hashes for h in row)))
            if len(set(known.values())) < len(known):
                raise ValueError("two terms of a question block have one hash; search them in two batches")
            yield block, asked, known

    def _scan(self, block, asked, known, k, schema):
        query_ids = np.array(block["query_id"].to_pylist(), dtype=object)
        companies = block["company"].to_pylist()
        vocabulary = sorted(known, key=known.get)
        hashes = np.array([known[t] for t in vocabulary], dtype=np.int64)
        wanted = sorted({c for c in companies if c is not None})
        only = wanted if companies and None not in companies else None
        rows = self._holding(known, vocabulary, only)
        df = np.array([self._df[t] for t in vocabulary], dtype=float)
        weight = np.log(1 + (self._n - df + 0.5) / (df + 0.5))
        avgdl, k1, b = self._avgdl, self.settings.bm25_k1, self.settings.bm25_b
        number = {t: i for i, t in enumerate(vocabulary)}
        asks = Asks([[number[t] for t in row] for row in asked], len(vocabulary))

        def gains(pdf):
            """Row, term and gain of every word that a row holds, by row and term."""
            row = np.repeat(np.arange(len(pdf)), [len(h) for h in pdf["hashes"]])
            words = np.concatenate([hashes[:0], *pdf["hashes"]])
            times = np.concatenate([np.zeros(0), *pdf["tfs"]]) if "tfs" in pdf else np.ones(len(row))
            asked_for = np.isin(words, hashes)
            row, times, term = row[asked_for], times[asked_for], np.searchsorted(hashes, words[asked_for])
            cell, at = np.unique(row * len(hashes) + term, return_inverse=True)
            tf = np.bincount(at, weights=times, minlength=len(cell))
            row, term = np.divmod(cell, max(1, len(hashes)))
            length = pdf["dl"].to_numpy(dtype=float)[row] / avgdl
            return row, term, weight[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))

        def scan(batches):
            best = Best(len(query_ids), k)
            for pdf in (part for batch in batches for part in slices(batch, 1, ROWS)):
                ids = pdf["id"].to_numpy()
                shut = wrong_company(pdf["ticker"], companies) if wanted else None
                for first, last, scores, ties in asks.scored(len(pdf), *gains(pdf)):
                    if wanted:
                        scores[shut[first:last]] = -np.inf
                    best.offer(ids[first:last], scores, ties)
            hits = best.result()
            yield pd.DataFrame(
                {
                    "query_id": query_ids[hits["q"].to_numpy(dtype=int)],
                    "id": hits["id"].astype(object),
                    "bm25_score": hits["score"],
                    "tie": hits["tie"],
                }
            )

        return rows.mapInPandas(scan, schema)

    def _held(self, known):
        """(hash and df, documents with their asked words), of these words or more.

        The corpus is tokenised once for a block: what it holds of the block's words is written down as
        hashes. The gate counts there, and a search for the same words, or some of them, reads it again. A
        null hash for each document carries n and the length.
        """
        for held in self._lately:
            if held[2] >= known.keys():
                return held
        rows = written(self._asked_terms(sorted(known), None), "asked-words")
        null = F.array(F.lit(None).cast("long"))
        counts = (
            rows.select("dl", F.explode_outer(F.concat(F.array_distinct("hashes"), null)).alias("hash"))
            .groupBy("hash")
            .agg(F.count("*").alias("df"), F.sum("dl").alias("length"))
        )
        held = (written(counts, "asked-counts"), rows.filter(F.size("hashes") > 0), known.keys())
        self._lately = [held, *self._lately[:KEPT - 1]]
        return held

    def _holding(self, known, vocabulary, tickers):
        """Documents that hold an asked word, once n, average length and the words' frequencies are known."""
        counts, rows, _ = self._held(known)
        found = {r["hash"]: r for r in counts.collect()}  # at most as many as a block has words
        total = found.pop(None, None)
        self._n = total["df"] if total else 0
        self._avgdl = total["length"] / total["df"] if total else 0.0
        self._df = {t: found[h]["df"] if h in found else 0 for t, h in known.items()}
        # companies alone: their documents are read again, through a filter that reaches the scan
        return self._asked_terms(sorted(known), tickers) if tickers else rows

    def _asked_terms(self, vocabulary, tickers):
        """id, ticker, dl and the hashes of a document's occurrences of the vocabulary.

        Words are looked up here, in a set that the optimizer makes of the list; a list in
        SQL text (words are letters and digits) spares an expression object per word.
        """
        docs = self.docs.filter(F.col("ticker").isin(tickers)) if tickers else self.docs
        listed = ", ".join(f"'{t}'" for t in vocabulary) or "null"
        return docs.select(
            "id",
            "ticker",
            F.size("tokens").alias("dl"),
            F.expr(f"transform(filter(tokens, t -> t in ({listed})), t -> xxhash64(t))").alias("hashes"),
        )


def term_table(spark, terms):
    return spark.createDataFrame(
        pa.table({"term": list(terms)}, schema=pa.schema([("term", pa.string())]))
    )


TERM_BUCKETS = 64


def term_bucket(buckets, term="term"):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, buckets: int = TERM_BUCKETS) -> None:
    """Persist postings, term and corpus statistics under ``path``.

    Postings are laid out by term bucket, so that a search reads only the
    buckets of its own terms. Rebalancing lets the engine split the bucket of
    a very common term over several tasks and files; sorting by term within
    them lets row groups be skipped.
    """
    (
        postings(docs)
        .withColumn("bucket", term_bucket(buckets))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{path}/postings")
    )
    stored = docs.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(
        f"{path}/terms"
    )
    stats = corpus_stats(docs).withColumn("buckets", F.lit(buckets))
    stats.write.mode("overwrite").parquet(f"{path}/corpus")


class StoredIndex(LexicalIndex):
    """The same searches over an index that ``write_index`` left under a path.

    Only the buckets of the asked terms are read. Postings of asked terms move
    once, to sit together by document, and are then scored like any corpus.
    """

    def __init__(self, spark, path: str, settings):
        super().__init__(spark.read.parquet(f"{path}/postings"), settings)
        self.terms = spark.read.parquet(f"{path}/terms")
        self._n, self._avgdl, self.buckets = spark.read.parquet(f"{path}/corpus").first()

    def _learn(self, vocabulary):
        unseen = sorted(set(vocabulary) - self._df.keys())
        if unseen:
            asked = term_table(self.docs.sparkSession, unseen)
            found = dict(tuple(r) for r in self.terms.join(asked, "term").collect())
            self._df.update({t: found.get(t, 0) for t in unseen})

    def term_frequencies(self, questions):
        return self.terms

    def _holding(self, known, vocabulary, tickers):
        self._learn(vocabulary)
        return self._asked_terms(vocabulary, tickers)

    def _asked_terms(self, vocabulary, tickers):
        """As above, with each term once and its count in ``tfs``."""
        asked = term_table(self.docs.sparkSession, vocabulary)
        asked = asked.withColumn("bucket", term_bucket(self.buckets))
        # at most as many rows as the index has buckets
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
        rows = self.docs.filter(F.col("bucket").isin(touched))
        if tickers:
            rows = rows.filter(F.col("ticker").isin(tickers))
        held = F.collect_list(F.struct(F.xxhash64("term").alias("hash"), "tf"))
        return (
            rows.join(asked, ["bucket", "term"])
            .groupBy("id", "ticker", "dl")
            .agg(held.alias("held"))
            .select("id", "ticker", "dl", F.col("held.hash").alias("hashes"), F.col("held.tf").alias("tfs"))
        )
