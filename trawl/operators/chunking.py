"""Structure-aware chunking with overlap, per row and without a shuffle.

Each step is a left fold over an array held in one row, so a filing is cut
where it lies and nothing moves between executors.
"""

from pyspark.sql import DataFrame, Window, functions as F

from trawl.functions.text import let, one_line, strip

# Where text may be cut, coarse to fine, and where overlap starts.
SEPARATORS = ["\n", ". ", " "]
OVERLAP_MARKERS = [". ", "? ", "! ", "\n"]
LOCATE_TAIL = 80


def _fold(items, step):
    """Left fold with state (out, buf): finished strings and the open one."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def flush(state):
        return F.concat(state["out"], _some(state["buf"]))

    return F.aggregate(items, start, step, flush)


def _some(text):
    return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def atomize(text, max_size, level=0):
    """Pieces of at most max_size characters, re-joined as far as they fit."""
    text = strip(text)
    if level == len(SEPARATORS):
        cuts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / max_size).cast("int"))
        pieces = F.transform(cuts, lambda i: F.substring(text, i * max_size + 1, F.lit(max_size)))
    else:
        separator = SEPARATORS[level]

        def step(state, part):
            out, buf = state["out"], state["buf"]
            oversize = F.length(part) > max_size
            fits = F.length(buf) + len(separator) + F.length(part) <= max_size
            joined = F.concat(buf, F.lit(separator), part)
            return F.struct(
                F.when(
                    oversize,
                    F.concat(out, _some(buf), atomize(part, max_size, level + 1)),
                )
                .when((buf == "") | fits, out)
                .otherwise(F.concat(out, F.array(buf)))
                .alias("out"),
                F.when(oversize, "").when(buf == "", part).when(fits, joined).otherwise(part)
                .alias("buf"),
            )

        pieces = _fold(F.split(text, separator.replace(".", r"\.")), step)
    return F.when(F.length(text) <= max_size, _some(text)).otherwise(pieces)


def tail_overlap(text, overlap):
    """The last characters of a chunk, begun at the best boundary inside them."""
    if overlap <= 0:
        return F.lit("")
    tail = F.right(text, F.lit(overlap))

    def after(marker):
        return F.substring(
            tail, F.position(F.lit(marker), tail) + len(marker), F.lit(overlap)
        )

    result = F.when(F.length(text) <= overlap, text)
    for marker in OVERLAP_MARKERS + [" "]:
        result = result.when(F.contains(tail, F.lit(marker)), after(marker))
    return result.otherwise(tail)


def pack(atoms, settings):
    """Join atoms into chunks, seeding each with the overlap of the one before.

    A buffer still under the minimum absorbs the next atom even when that
    overshoots; overlap is left out where it would not fit.
    """
    size, least = settings.chunk_size, settings.chunk_min_size

    def step(state, atom):
        out, buf = state["out"], state["buf"]
        absorb = (F.length(buf) + 1 + F.length(atom) <= size) | (F.length(buf) < least)
        seed = tail_overlap(buf, settings.chunk_overlap)
        seeded = (seed != "") & (F.length(seed) + 1 + F.length(atom) <= size)
        return F.struct(
            F.when((buf == "") | absorb, out).otherwise(F.concat(out, F.array(buf))).alias("out"),
            F.when(buf == "", atom)
            .when(absorb, F.concat(buf, F.lit("\n"), atom))
            .when(seeded, F.concat(seed, F.lit("\n"), atom))
            .otherwise(atom)
            .alias("buf"),
        )

    return _fold(atoms, step)


def drop_scrap(chunks, least):
    """Leave out a last chunk below the minimum."""
    last = F.get(chunks, F.size(chunks) - 1)
    return F.when(F.length(last) < least, F.slice(chunks, 1, F.size(chunks) - 1)).otherwise(chunks)


def locate(text, chunks):
    """(start, end) of each chunk in text, searching on from the one before.

    A chunk that overlap changed is found by its last characters; -1 if not.
    """

    def find(piece, cursor):
        """1-based position at or after the cursor, else anywhere, else 0."""
        onward = F.position(piece, text, cursor + 1)
        return let(onward, lambda p: F.when(p > 0, p).otherwise(F.position(piece, text)))

    def span(start, end):
        return F.struct(start.alias("start"), end.alias("end"))

    def place(chunk, cursor):
        size, tail = F.length(chunk), F.right(chunk, F.lit(LOCATE_TAIL))

        def by_tail(p):
            end = p - 1 + F.length(tail)
            found = span(F.greatest(F.lit(0), end - size), end)
            return F.when(p > 0, found).otherwise(span(F.lit(-1), F.lit(-1)))

        return let(
            find(chunk, cursor),
            lambda p: F.when(p > 0, span(p - 1, p - 1 + size)).otherwise(
                let(find(tail, cursor), by_tail)
            ),
        )

    def step(state, chunk):
        cursor = state["cursor"]
        return let(
            place(chunk, cursor),
            lambda at: F.struct(
                F.when(at["start"] >= 0, at["start"] + 1).otherwise(cursor).alias("cursor"),
                F.concat(state["at"], F.array(at)).alias("at"),
            ),
        )

    start = F.struct(
        F.lit(0).alias("cursor"),
        F.array().cast("array<struct<start:int,end:int>>").alias("at"),
    )
    return F.aggregate(chunks, start, step, lambda state: state["at"])


def chunk_filings(filings: DataFrame, settings) -> DataFrame:
    """Chunks of every section, numbered through each filing.

    ``filings`` has ticker, filing_date, sections array<struct<section, text>>
    and any further columns, which are carried along. Every step is a column
    of its own, so no array is worked out twice.
    """
    carried = [c for c in filings.columns if c != "sections"]
    per_section = (
        filings.withColumn(
            "atoms",
            F.transform("sections", lambda s: atomize(s["text"], settings.chunk_size)),
        )
        .withColumn("packed", F.transform("atoms", lambda a: pack(a, settings)))
        .withColumn(
            "chunks",
            F.transform("packed", lambda c: drop_scrap(c, settings.chunk_min_size)),
        )
        .withColumn(
            "at",
            F.zip_with("sections", "chunks", lambda s, c: locate(s["text"], c)),
        )
    )
    def numbered(section, k):
        spans = F.get("at", k)
        return F.transform(
            F.get("chunks", k),
            lambda chunk, i: F.struct(
                section["section"].alias("section"),
                i.alias("chunk_index"),
                chunk.alias("text"),
                F.get(spans, i)["start"].alias("char_start"),
                F.get(spans, i)["end"].alias("char_end"),
            ),
        )

    joined = F.transform("sections", numbered)
    rows = per_section.select(*carried, F.flatten(joined).alias("all")).select(
        *carried, F.posexplode_outer("all").alias("number", "chunk")
    )
    return rows.filter(F.col("chunk").isNotNull()).select(
        F.format_string("%s-%s-%04d", "ticker", "filing_date", "number").alias("chunk_id"),
        *carried,
        "chunk.*",
    )


def chunk_stats(chunks: DataFrame, by: str) -> DataFrame:
    """Count, min, upper median, 95th percentile and max of chunk length.

    Percentiles are positions in the sorted lengths. A length histogram is
    enough to find them, so a group is never gathered: there are only as many
    rows per group as there are different lengths.
    """
    lengths = (
        chunks.select(by, F.length("text").alias("length"))
        .groupBy(by, "length")
        .agg(F.count("*").alias("times"))
    )
    running = Window.partitionBy(by).orderBy("length").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(by)
    seen = lengths.select(
        by,
        "length",
        F.sum("times").over(running).alias("upto"),
        F.sum("times").over(whole).alias("n"),
    )
    middle = F.floor(F.col("n") / 2)
    high = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))

    def at(position):
        return F.min(F.when(F.col("upto") > position, F.col("length")))

    return seen.groupBy(by).agg(
        F.max("n").alias("chunks"),
        F.min("length").alias("min_length"),
        at(middle).alias("median_length"),
        at(high).alias("p95_length"),
        F.max("length").alias("max_length"),
    )


def sample_chunks(chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    """The second and the middle chunk of every filing, for a look by eye.

    ``sizes`` has ticker, filing_date, n.
    """
    number = F.element_at(F.split("chunk_id", "-"), -1).cast("int")
    picked = chunks.join(sizes, ["ticker", "filing_date"]).filter(
        (number == F.least(F.lit(1), F.col("n") - 1))
        | (number == F.floor(F.col("n") / 2))
    )
    return picked.select(
        "chunk_id",
        F.length("text").alias("length"),
        one_line(F.substring("text", 1, 200), " | ").alias("head"),
        one_line(F.right("text", F.lit(160)), " | ").alias("tail"),
    )
