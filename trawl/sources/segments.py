"""An inverted index that follows a collection part by part.

Every part of the collection has a segment: its postings and its documents' lengths, under the keys that rows keep
for good. Postings lie as one row for each document and term bucket, with the terms that the document has there. ``refresh`` indexes the text of rows that no segment holds, moves the postings of merged parts without
looking at text again, and takes out of the statistics what rows that are gone had put in. So n, lengths and
document frequencies are always those of a rebuild, while the work grows with what changed.
"""

import uuid

from pyspark.sql import DataFrame, functions as F

from trawl.functions.text import tokens
from trawl.operators.lexical import TERM_BUCKETS, LexicalIndex, bucketed, term_table, word_bucket
from trawl.operators.questions import BROADCAST_ROWS
from trawl.sources.collection import KEY, Collection
from trawl.sources.commits import CommitLog, Conflict

DOCS = "_origin string, _row long, dl int, run string, part string"
GONE = "_origin string, _row long, part string"
TERMS = "term string, df long"
FOLD = 8  # sets of frequency changes that are added up into one
HELD = "held array<struct<term:string,tf:int>>"
POSTINGS = f"id string, ticker string, dl int, lead boolean, {HELD}, _origin string, _row long, run string, part string, bucket int"
DEALT = "crc32"  # how terms are dealt to buckets
EMPTY = {"version": 0, "collection": 0, "segments": {}, "postings": POSTINGS, "gone": {}, "terms": [], "n": 0, "length": 0}


def few(rows: DataFrame, n: int) -> DataFrame:
    """Hint a broadcast of ``n`` rows where they are few."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def document_frequencies(held: DataFrame) -> DataFrame:
    """term, n: in how many documents of ``held`` a term is."""
    return held.select(F.explode_outer("held.term").alias("term")).filter(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("n"))


class SegmentedIndex(LexicalIndex):
    """BM25 over ``collection``, stored under ``path``; searches see the version of the last refresh."""

    def __init__(self, collection: Collection, path: str, settings, buckets: int = TERM_BUCKETS):
        self.spark, self.collection, self.path, self.buckets = collection.spark, collection, path, buckets
        self.log = CommitLog(self.spark, f"{path}/log")
        super().__init__(None, settings)
        self._load()

    def _load(self):
        self.state = self.log.latest() or EMPTY
        if "held" not in self.state["postings"] or self.state.get("dealt") != DEALT:  # an older layout is built anew
            self.state = {**EMPTY, "version": self.state["version"]}
        self.buckets = self.state.get("buckets", self.buckets)
        self._n, self._df = self.state["n"], {}
        self._avgdl = self.state["length"] / self._n if self._n else 0.0
        self.docs = self.postings(self.state["segments"])

    # --- stored tables ------------------------------------------------------------

    def postings(self, segments) -> DataFrame:
        """Postings of segments {part: run that wrote it}."""
        return self._segments("postings", self.state["postings"], segments)

    def lengths(self, segments) -> DataFrame:
        return self._segments("docs", DOCS, segments).drop("run")

    def _segments(self, kind, schema, segments):
        if not segments:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}")
        return rows.parquet(*[f"{self.path}/{kind}/run={run}/part={part}" for part, run in segments.items()])

    def gone(self, state) -> DataFrame:
        """Keys of documents that segments still hold and that no longer count."""
        if not state["gone"]:
            return self.spark.createDataFrame([], GONE)
        return self.spark.read.schema(GONE).parquet(*[f"{self.path}/gone/{g}" for g in state["gone"]])

    def frequencies(self) -> DataFrame:
        """term, df of the whole collection: the sum of all changes."""
        if not self.state["terms"]:
            return self.spark.createDataFrame([], TERMS)
        changes = self.spark.read.schema(TERMS).parquet(*[f"{self.path}/terms/{t}" for t in self.state["terms"]])
        return changes.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    # --- following the collection ----------------------------------------------------

    def refresh(self) -> bool:
        """Take in what changed since the last time; False where nothing did."""
        while True:
            self._load()
            now = self.collection.snapshot()
            if now["version"] == self.state["collection"]:
                return False
            try:
                self.log.commit(self.state["version"] + 1, self._changed(now))
            except Conflict:  # another refresh came first; its result may be all there is to do
                continue
            self._load()
            return True

    def _changed(self, now) -> dict:
        name = uuid.uuid4().hex
        held = self.state["segments"]
        new = {p: name for p in now["parts"] if p not in held}
        left = {p: run for p, run in held.items() if p not in now["parts"]}
        kept = {p: run for p, run in held.items() if p in now["parts"]}
        already = self.gone(self.state)
        left_docs = self.lengths(left).drop("part").join(already.select(*KEY), KEY, "left_anti")
        deltas = []
        schema = self.state["postings"]
        if new:
            rows = self.collection.live(now, list(new)).select("id", "ticker", "text", "part", *KEY)
            moved = left_docs.select(*KEY).join(rows.select(*KEY, "part"), KEY)
            fresh = rows.join(left_docs.select(*KEY), KEY, "left_anti") if left else rows
            words = tokens(F.coalesce("text", F.lit(""))).alias("tokens")
            made = bucketed(fresh.select("id", "ticker", "part", *KEY, words), self.buckets, "part", *KEY)
            if left:
                made = made.unionByName(self.postings(left).drop("run", "part").join(moved, KEY))
            schema = ", ".join(
                f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema if f.name not in ("part", "bucket")
            ) + ", run string, part string, bucket int"
            (
                made.hint("rebalance", "part", "bucket").sortWithinPartitions("part", "bucket")
                .write.partitionBy("part", "bucket").parquet(f"{self.path}/postings/run={name}")
            )
            self._folders(new, "postings")
            # every document has one row that leads
            sizes = self._segments("postings", schema, new).filter("lead").select(*KEY, "dl", "part")
            sizes.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/docs/run={name}")
            self._folders(new, "docs")
        before = {**self.state, "postings": schema}
        added = self.lengths(new)
        lost = left_docs
        if new:
            lost = left_docs.join(added.select(*KEY), KEY, "left_anti")
            if left:
                added = added.join(self.lengths(left).select(*KEY), KEY, "left_anti")
        gone = already.filter(F.col("part").isin(list(kept)))
        if kept and now["marks"]:
            marked = self.collection.marks(now["marks"]).select(*KEY).join(self.lengths(kept), KEY)
            marked = marked.join(already.select(*KEY), KEY, "left_anti")
            lost = lost.select(*KEY, "dl").unionByName(marked.select(*KEY, "dl"))
            gone = gone.unionByName(marked.select("_origin", "_row", "part"))
        counted = self._write(gone, "gone", name)
        sums = [F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")]
        plus, minus = added.agg(*sums).first(), lost.agg(*sums).first()
        self.state = before  # the postings' columns are known from here on
        if plus["n"]:
            come = self.postings(new)
            if left:
                come = come.join(few(added.select(*KEY), plus["n"]), KEY, "left_semi")
            deltas.append(document_frequencies(come).select("term", F.col("n").alias("df")))
        if minus["n"]:
            out = self.postings({**left, **kept}).join(few(lost.select(*KEY), minus["n"]), KEY, "left_semi")
            if self.state["gone"]:
                out = out.join(few(already.select(*KEY), sum(self.state["gone"].values())), KEY, "left_anti")
            deltas.append(document_frequencies(out).select("term", (-F.col("n")).alias("df")))
        terms = list(self.state["terms"])
        if deltas:
            change = deltas[0] if len(deltas) == 1 else deltas[0].unionByName(deltas[1]).groupBy("term").agg(F.sum("df").alias("df"))
            if len(terms) + 1 >= FOLD:
                change = self.frequencies().unionByName(change).groupBy("term").agg(F.sum("df").alias("df"))
                terms = []
            self._write(change.filter("df != 0"), "terms", name)
            terms.append(name)
        return {
            "collection": now["version"], "segments": {**kept, **new}, "postings": schema, "terms": terms,
            "gone": {name: counted} if counted else {}, "buckets": self.buckets, "dealt": DEALT,
            "n": self.state["n"] + plus["n"] - minus["n"],
            "length": self.state["length"] + plus["length"] - minus["length"],
        }

    def _folders(self, segments, kind):
        """A part without rows leaves no folder; give it an empty one."""
        for part, run in segments.items():
            self.log.make_folder(f"{self.path}/{kind}/run={run}/part={part}")

    def _write(self, rows, kind, name):
        path = f"{self.path}/{kind}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).count()

    # --- searching --------------------------------------------------------------------

    def _learn(self, vocabulary):
        unseen = sorted(set(vocabulary) - self._df.keys())
        if unseen:
            found = dict(tuple(r) for r in self.frequencies().join(term_table(self.spark, unseen), "term").collect())
            self._df.update({t: found.get(t, 0) for t in unseen})

    def term_frequencies(self, questions):
        return self.frequencies()

    def _holding(self, known, vocabulary, tickers):
        self._learn(vocabulary)
        return self._asked_terms(vocabulary, tickers)

    def _asked_terms(self, vocabulary, tickers):
        """id, ticker, dl, hashes, tfs: only the asked terms' buckets are read, less what is gone.

        What a document has in a bucket is cut down to the asked terms before it moves.
        """
        asked = term_table(self.spark, vocabulary).select(word_bucket(self.buckets).alias("bucket"))
        # at most as many rows as the index has buckets
        touched = [r["bucket"] for r in asked.distinct().collect()]
        rows = self.docs.filter(F.col("bucket").isin(touched))
        if tickers:
            rows = rows.filter(F.col("ticker").isin(tickers))
        if self.state["gone"]:
            rows = rows.join(few(self.gone(self.state).select(*KEY), sum(self.state["gone"].values())), KEY, "left_anti")
        listed = ", ".join(f"'{t}'" for t in vocabulary) or "null"
        found = F.expr(f"transform(filter(held, h -> h.term in ({listed})), h -> struct(xxhash64(h.term) as hash, h.tf as tf))")
        return (
            rows.select("id", "ticker", "dl", found.alias("held")).filter(F.size("held") > 0)
            .groupBy("id", "ticker", "dl")
            .agg(F.flatten(F.collect_list("held")).alias("held"))
            .select("id", "ticker", "dl", F.col("held.hash").alias("hashes"), F.col("held.tf").alias("tfs"))
        )
