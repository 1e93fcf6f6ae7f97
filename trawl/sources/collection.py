"""The stored collection: chunks and their vectors in parts that are only ever added.

An upsert writes its rows as one new part, marks the rows that it supersedes, and
appends a version to the log. A version lists the live parts, the sets of marks and
the counts; a reader takes one version and sees it whole, whatever is written meanwhile.
Parts of like size are merged by ``compact``; ``vacuum`` drops what no kept version names.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trawl.operators.questions import BROADCAST_ROWS
from trawl.sources.commits import CommitLog, Conflict

ID_BUCKETS = 64
FAN = 4  # parts of one size that make a larger one
KEY = ["_origin", "_row"]  # a row's part and place when it was first written; merging keeps them
MARKS = "_origin string, _row long, part string, ticker string"
COUNTS = "ticker string, chunks long"
EMPTY = {"version": 0, "schema": None, "parts": {}, "marks": {}, "counts": [], "batches": {}, "rows": 0}


def id_bucket(buckets):
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def upserted(target: DataFrame, source: DataFrame, prune_within=None) -> DataFrame:
    """Target with source rows put in, by id. Rows only the target has stay,
    unless ``prune_within`` names a column (a ticker, say): then those that
    share its value with a source row go. A column that one side lacks is null there."""
    kept = target.join(source.select("id"), "id", "left_anti")
    if prune_within:
        kept = kept.join(source.select(prune_within).distinct(), prune_within, "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def merged_schema(stored, new: T.StructType) -> T.StructType:
    """Fields of both; a field that changed its type is refused."""
    if stored is None:
        return new
    known = {f.name: f for f in stored}
    for f in new:
        if f.name in known and known[f.name].dataType != f.dataType:
            raise ValueError(f"{f.name} is stored as {known[f.name].dataType.simpleString()}")
    return T.StructType([*stored, *[f for f in new if f.name not in known]])


class Collection:
    """Chunks under ``path``: parts laid out by ticker and id bucket, so that a filter
    by ticker and a look-up by id read only their folders."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = ID_BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.log = CommitLog(spark, f"{path}/log")

    def snapshot(self, version=None) -> dict:
        """What a version holds: the newest one, or one that is not vacuumed yet."""
        return (self.log.latest() if version is None else self.log.read(version)) or EMPTY

    def exists(self):
        return bool(self.log.versions())

    def read(self, ticker=None, version=None) -> DataFrame:
        """All rows, or a ticker's, of the newest or a given version. The bucket column lets a look-up by id
        read only the folders of the ids it wants."""
        state = self.snapshot(version)
        if state["schema"] is None:
            raise ValueError(f"nothing was stored in {self.path} yet")
        rows = self.live(state)
        rows = rows.filter(F.col("ticker") == ticker.upper()) if ticker else rows
        return rows.drop("part", *KEY)

    def live(self, state, parts=None) -> DataFrame:
        """Rows of a version, or of some of its parts, less the marked ones, with their keys and part."""
        rows = self.stored(state, state["parts"] if parts is None else parts)
        if not state["marks"]:
            return rows
        gone = self.marks(state["marks"]).select(*KEY)
        if sum(state["marks"].values()) <= BROADCAST_ROWS:
            gone = F.broadcast(gone)
        return rows.join(gone, KEY, "left_anti")

    def stored(self, state, parts) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        if not parts:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/parts/part={p}" for p in parts]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/parts").parquet(*folders)

    def marks(self, sets) -> DataFrame:
        return self.spark.read.schema(MARKS).parquet(*[f"{self.path}/marks/{m}" for m in sets])

    # --- writing ---------------------------------------------------------------

    def upsert(self, chunks: DataFrame, embedder=None, latest=(), prune=False, batch=None) -> int:
        """Write chunks (id, ticker, text, ...), embedding them if asked to; returns the rows that now stand.

        Of rows that repeat an id in one call the one of largest ``latest`` (columns) stays, else
        the first by ticker and text. The stored row of an id goes, under whatever ticker it was; with ``prune``
        so do all other rows of the tickers that come in. A column that the rows lack is null in them, except
        the embedding: a collection with vectors takes no rows without. ``batch`` (stream, number)
        makes a call that was made before do nothing. The plan of ``chunks`` runs once.
        """
        state = self.snapshot()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return 0
        if embedder:
            chunks = chunks.withColumn("embedding", embedder.documents(F.col("text")))
        if state["schema"] and "embedding" not in chunks.columns:
            if "embedding" in T.StructType.fromJson(state["schema"]).names:
                raise ValueError("the collection holds vectors: give an embedder or an embedding column")
        part = uuid.uuid4().hex
        schema = self._write_part(chunks.drop(*KEY, "part").withColumn("bucket", id_bucket(self.buckets)), part, state)
        own = {**EMPTY, "schema": schema.jsonValue(), "parts": {part: 0}}
        per_ticker = self.live(own).groupBy("ticker").agg(F.count("*").alias("chunks"))
        written_rows = self._keep(per_ticker, "counts", part)
        if not written_rows[1]:
            self.log.remove(f"{self.path}/parts/part={part}", f"{self.path}/counts/{part}")
            if batch:
                self._note_batch(batch)
            return 0
        repeated = self._repeated(own, part, tuple(latest))
        while True:
            try:
                return self._commit_upsert(state, own, part, written_rows[1], repeated, prune, batch)
            except Conflict:
                state = self.snapshot()
                if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                    return 0

    def _write_part(self, rows, part, state):
        """Rebalancing splits a hot folder over several tasks and joins small ones. Rows get their numbers in
        the tasks that write them, so that they hold."""
        fields = [f for f in rows.schema if f.name not in ("ticker", "bucket")]
        fields += [T.StructField("_origin", T.StringType()), T.StructField("_row", T.LongType())]
        folders = [T.StructField("part", T.StringType()), T.StructField("ticker", T.StringType()), T.StructField("bucket", T.IntegerType())]
        new = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + folders)
        schema = merged_schema(T.StructType.fromJson(state["schema"]) if state["schema"] else None, new)
        (
            rows.hint("rebalance", "ticker", "bucket")
            .sortWithinPartitions("ticker", "bucket", "id")
            .withColumn("_origin", F.lit(part))
            .withColumn("_row", F.monotonically_increasing_id())
            .write.partitionBy("ticker", "bucket")
            .parquet(f"{self.path}/parts/part={part}")
        )
        return schema

    def _keep(self, rows, kind, name, add_up=True):
        """Write a small table of the log and return (name, sum of its numbers)."""
        path = f"{self.path}/{kind}/{name}"
        rows.write.mode("overwrite").parquet(path)
        if not add_up:
            return name, None
        stored = self.spark.read.schema(COUNTS if kind == "counts" else MARKS).parquet(path)
        total = F.sum("chunks") if kind == "counts" else F.count("*")
        return name, stored.agg(F.coalesce(total, F.lit(0))).first()[0]

    def _repeated(self, own, part, latest):
        """Marks for all but one of the part's rows with one id, or None. Only repeated ids are looked at again."""
        ids = self.live(own).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
        if ids.isEmpty():
            return None
        rows = self.live(own).join(ids, "id", "left_semi")
        if latest:
            best = F.max_by("_row", F.struct(*latest, (-F.col("_row")).alias("_r")))
        else:
            best = F.min_by("_row", F.struct("ticker", "text", "_row"))
        winners = rows.groupBy("id").agg(best.alias("best"))
        return rows.join(winners, "id").filter("_row != best").select("_origin", "_row", F.lit(part).alias("part"), "ticker")

    def _commit_upsert(self, state, own, part, n_written, repeated, prune, batch):
        name = uuid.uuid4().hex
        marked = [] if repeated is None else [repeated]
        columns = [*KEY, "part", "ticker"]
        if state["parts"]:
            new = self.live(own)
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
            old = self.live(state)
            ids = new.select("bucket", "id").distinct()
            same = old.filter(F.col("bucket").isin(touched)).join(ids, ["bucket", "id"], "left_semi")
            marked.append(same.select(*columns))
            if prune:
                others = old.join(new.select("ticker").distinct(), "ticker", "left_semi")
                marked.append(others.join(ids, ["bucket", "id"], "left_anti").select(*columns))
        marks, counts, rows = dict(state["marks"]), [*state["counts"], part], state["rows"] + n_written
        standing = n_written
        if marked:
            gone = marked[0]
            for more in marked[1:]:
                gone = gone.unionByName(more)
            _, n = self._keep(gone, "marks", name)
            if n:
                marks[name] = n
                less = self.marks([name]).groupBy("ticker").agg((-F.count("*")).alias("chunks"))
                self._keep(less, "counts", name, add_up=False)
                counts.append(name)
                rows -= n
        if repeated is not None:
            standing -= self.marks([name]).filter(F.col("part") == part).count()
        batches = {**state["batches"], **({batch[0]: batch[1]} if batch else {})}
        schema = merged_schema(T.StructType.fromJson(state["schema"]) if state["schema"] else None, T.StructType.fromJson(own["schema"]))
        content = {
            "schema": schema.jsonValue(), "parts": {**state["parts"], part: n_written}, "marks": marks,
            "counts": counts, "batches": batches, "rows": rows,
        }
        self.log.commit(state["version"] + 1, content)
        return standing

    def _note_batch(self, batch):
        """An empty batch is taken in by its number alone."""
        while True:
            state = self.snapshot()
            if state["batches"].get(batch[0], -1) >= batch[1]:
                return
            try:
                self.log.commit(state["version"] + 1, {**state, "batches": {**state["batches"], batch[0]: batch[1]}})
                return
            except Conflict:
                continue

    def compact(self, fan: int = FAN) -> int:
        """Merge parts of one size, where there are ``fan`` of them; returns how many went into larger ones.

        Sizes go by powers of ``fan``, so a row is rewritten once for each of them at most. Marked rows
        are left out and their marks go; the other rows keep their keys. Upserts that come in
        meanwhile stand; should two compactions meet, the later one gives up.
        """
        state = self.snapshot()
        tiers = {}
        for part, n in state["parts"].items():
            tier = 0
            while n >= fan ** (tier + 1):
                tier += 1
            tiers.setdefault(tier, []).append(part)
        chosen = [p for parts in tiers.values() if len(parts) >= fan for p in parts]
        if not chosen:
            return 0
        part = uuid.uuid4().hex
        rows = self.live(state, chosen).drop("part")
        (
            rows.hint("rebalance", "ticker", "bucket").sortWithinPartitions("ticker", "bucket", "id")
            .write.partitionBy("ticker", "bucket").parquet(f"{self.path}/parts/part={part}")
        )
        size = self.stored(state, [part]).count()
        marks = {}
        if state["marks"]:
            name, n = self._keep(self.marks(state["marks"]).filter(~F.col("part").isin(chosen)), "marks", part)
            marks = {name: n} if n else {}
        counts = self.spark.read.schema(COUNTS).parquet(*[f"{self.path}/counts/{c}" for c in state["counts"]])
        folded = counts.groupBy("ticker").agg(F.sum("chunks").alias("chunks")).filter("chunks != 0")
        self._keep(folded, "counts", part, add_up=False)
        while True:
            now = self.snapshot()
            if not set(chosen) <= set(now["parts"]):
                self.log.remove(f"{self.path}/parts/part={part}")
                return 0
            since = {m: n for m, n in now["marks"].items() if m not in state["marks"]}
            content = {
                **now,
                "parts": {**{p: n for p, n in now["parts"].items() if p not in chosen}, part: size},
                "marks": {**marks, **since},
                "counts": [part, *[c for c in now["counts"] if c not in state["counts"]]],
            }
            try:
                self.log.commit(now["version"] + 1, content)
                return len(chosen)
            except Conflict:
                continue

    def vacuum(self, keep: int = 1) -> int:
        """Drop all but the last ``keep`` versions and what only the dropped ones name; returns the folders removed."""
        if keep < 1:
            raise ValueError("the newest version stays")
        versions = self.log.versions()
        old, kept = versions[:-keep], [self.log.read(v) for v in versions[-keep:]]

        def named(states):
            return (
                {f"parts/part={p}" for s in states for p in s["parts"]}
                | {f"marks/{m}" for s in states for m in s["marks"]} | {f"counts/{c}" for s in states for c in s["counts"]}
            )

        unused = named([self.log.read(v) for v in old]) - named(kept)
        self.log.remove(*[f"{self.path}/{u}" for u in sorted(unused)])
        for v in old:
            self.log.forget(v)
        return len(unused)

    # --- counts and samples -------------------------------------------------------

    def counts(self) -> DataFrame:
        """ticker, chunks from the log alone: no part is read."""
        state = self.snapshot()
        if not state["counts"]:
            return self.spark.createDataFrame([], COUNTS)
        kept = self.spark.read.schema(COUNTS).parquet(*[f"{self.path}/counts/{c}" for c in state["counts"]])
        return kept.groupBy("ticker").agg(F.sum("chunks").alias("chunks")).filter("chunks > 0")

    def count(self, ticker=None) -> int:
        if not ticker:
            return self.snapshot()["rows"]
        found = self.counts().filter(F.col("ticker") == ticker.upper()).first()
        return found["chunks"] if found else 0

    def peek(self, n: int) -> DataFrame:
        return self.read().orderBy("id").limit(n)


def with_total(counted: DataFrame, tickers) -> DataFrame:
    """Counts (ticker, chunks) of the configured tickers, zero included, and the total of all (null)."""
    wanted = counted.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    per_ticker = wanted.join(counted, "ticker", "left").na.fill(0, ["chunks"])
    total = counted.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    return per_ticker.unionByName(total.withColumn("ticker", F.lit(None).cast("string")))


def ticker_counts(rows: DataFrame, tickers) -> DataFrame:
    """Rows per configured ticker, zero included, and the total (null)."""
    return with_total(rows.groupBy("ticker").agg(F.count("*").alias("chunks")), tickers)
