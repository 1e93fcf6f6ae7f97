"""Repeated runs of lines, found by winnowing.

A text's lines are hashed. A window is a shortest stretch of whole lines with at least
``least_words`` words, from every first line on and to every last line back. Of every window the smallest line
hash, the last one of equals, is selected; a text keeps only the selected positions. Two texts that share a run
of that many words share a window, and with it a selected position (the guarantee of winnowing).

Positions are joined on the selected line hash alone, each with the earliest one only. A match is then
extended both ways, by hashes of the lines up to each edge of the position's windows, and covers the windows as far as both
sides agree. The earliest position may be in a text that shares little more than the line: windows that it does not cover
look for their earliest equal among each other, by the hash of all their lines. None of these can equal
a covered window, so nothing is missed, and a line or window held by n texts makes n matches.
Every run that has occurred before, in the order of ids and lines, is deleted.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from trawl.llm.texts import BASE, mix, slices, span_hashes, word_spans
from trawl.session import written

LEAST_WORDS = 50
SALTS = 16


def lines_of(data):
    """(start, end) of every line of one text's bytes."""
    cuts = np.flatnonzero(data == 10)
    return np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])


def windows(hashes, words, least):
    """(first line, line after the last) of all windows, without repeats."""
    total = np.concatenate([[0], np.cumsum(words)])
    if total[-1] < least:
        return np.zeros((0, 2), dtype=np.int64)
    n = len(hashes)
    front = np.searchsorted(total, total[:-1] + least)  # the end that first holds enough
    back = np.searchsorted(total, total[1:] - least, "right") - 1
    a = np.stack([np.arange(n), front], axis=1)[front <= n]
    b = np.stack([back, np.arange(1, n + 1)], axis=1)[total[1:] >= least]
    return np.unique(np.concatenate([a, b]), axis=0)


def selected(hashes, words, least):
    """Windows in the order of the line selected in each: (selected line, first line, end, hash of
    the lines from the first to the selected one, hash of those from there to the end)."""
    spans = windows(hashes, words, least)
    first, end = spans[:, 0], spans[:, 1]
    if not len(spans):
        return first, first, end, hashes[:0], hashes[:0]
    # places in the order of hashes, later lines before earlier equal ones
    order = np.lexsort((-np.arange(len(hashes)), hashes))
    rank = np.empty(len(hashes), dtype=np.int64)
    rank[order] = np.arange(len(hashes))
    # least place of each stretch from a table of minima over powers of two
    minima, width = [rank], 1
    while 2 * width <= int((end - first).max()):
        low = minima[-1]
        minima.append(np.minimum(low[:-width], low[width:]))
        width *= 2
    level = np.floor(np.log2(end - first)).astype(np.int64)
    at = np.empty(len(first), dtype=np.int64)
    for k in range(len(minima)):
        of = level == k
        at[of] = order[np.minimum(minima[k][first[of]], minima[k][end[of] - (1 << k)])]
    power = np.full(len(hashes) + 1, BASE, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(len(hashes) + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * power[:-1])])

    def digest(a, b):
        return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))

    by = np.argsort(at, kind="stable")
    at, first, end = at[by], first[by], end[by]
    return at, first, end, digest(first, at + 1), digest(at, end)


def fingerprint_rows(least):
    """A row for each selected position: its line hash and, for each of its windows, the span (first
    line and end in one number) and the hashes to both sides."""

    def rows(batches):
        for batch in batches:
            keys, held, counts = [[], [], [], []], [[], [], []], []
            ids, bodies = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for row, data, offsets in slices(batch.column(2)):
                for i in range(len(offsets) - 1):
                    text = data[offsets[i] : offsets[i + 1]]
                    starts, ends = lines_of(text)
                    spots, _, _ = word_spans(text, np.array([0, len(text)]))
                    words = np.diff(np.searchsorted(spots, np.append(starts, len(text))))
                    if words.sum() < least:
                        continue
                    hashes = span_hashes_of_lines(text, starts, ends)
                    at, first, end, left, right = selected(hashes, words, least)
                    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    counts.append(np.diff(np.append(begin, len(at))))
                    own = np.full(len(begin), ids[row + i]), np.full(len(begin), bodies[row + i])
                    for values, part in zip(keys, (*own, at[begin], hashes[at[begin]].view(np.int64))):
                        values.append(part)
                    for values, part in zip(held, (first << 32 | end, left.view(np.int64), right.view(np.int64))):
                        values.append(part)
            if counts:
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32))
                columns = [pa.array(np.concatenate(v).astype(np.int64)) for v in keys]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v))) for v in held]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *lists], ["id", "body", "line", "fingerprint", "spans", "lefts", "rights"]
                )

    return rows


def with_earliest(rows: DataFrame, key, order, carried=()) -> DataFrame:
    """The rows whose ``key`` others have too, with the earliest of them (``origin``). Rows of one
    key are dealt to ``SALTS`` groups, so that a key that a third of all rows hold is split."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", "body"), F.lit(SALTS)))
    groups = dealt.groupBy(key, "salt").agg(
        F.min(F.struct(*order, *carried)).alias("origin"), F.count("*").alias("n")
    )
    earliest = groups.groupBy(key).agg(
        F.min("origin").alias("origin"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")
    )
    return dealt.join(
        earliest.filter("n > 1").select(key, "origin", F.explode("salts").alias("salt")), [key, "salt"]
    )


def extended(batches):
    """Of every position's windows, those that the match with the earliest one covers and that do
    not overlap it (``cut``), and those that it does not cover, with the hash of all their lines."""

    def flat(column):
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), lengths)

    def agree(mine, theirs):
        (a, of), (b, by) = flat(mine), flat(theirs)
        return np.isin(mix(a.view(np.uint64) ^ tag[of]), mix(b.view(np.uint64) ^ tag[by]))

    for batch in batches:
        tag = mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(BASE))
        ids, bodies, line, id0, body0, line0 = (c.to_numpy() for c in batch.columns[:6])
        spans, of = flat(batch.column(6))
        covered = agree(batch.column(7), batch.column(9)) & agree(batch.column(8), batch.column(10))
        lines = (spans & 0xFFFFFFFF) - (spans >> 32)
        apart = (ids != id0) | (bodies != body0)
        cut = covered & (apart[of] | (lines <= (line - line0)[of]))
        left, right = (flat(batch.column(c))[0].view(np.uint64) for c in (7, 8))
        window = mix(left ^ mix(right)).view(np.int64)
        keep = cut | ~covered
        columns = (ids[of][keep], bodies[of][keep], spans[keep], window[keep], cut[keep])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "body", "span", "window", "cut"])


def span_hashes_of_lines(data, starts, ends):
    """Line hashes; bytes are taken as they are but for A-Z, in two seeds made one."""
    return mix(span_hashes(data, starts, ends, 1) ^ span_hashes(data, starts, ends, 2) * np.uint64(BASE))


def repeated_lines(docs: DataFrame, least_words=LEAST_WORDS, id_col="doc_id", text_col="text") -> DataFrame:
    """id, body (hash of the text) and ``cut``, the stretches of lines to delete, in order."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("body"), text_col
    )
    marks = written(
        rows.mapInArrow(
            fingerprint_rows(least_words),
            "id long, body long, line long, fingerprint long, spans array<long>, lefts array<long>, rights array<long>",
        ),
        "fingerprints",
    )
    place = ["id", "body", "line"]
    met = with_earliest(marks, "fingerprint", place, ["lefts", "rights"]).select(
        *place, *[F.col(f"origin.{c}").alias(f"{c}0") for c in place],
        "spans", "lefts", "rights", F.col("origin.lefts").alias("lefts0"), F.col("origin.rights").alias("rights0"),
    )
    found = written(met.mapInArrow(extended, "id long, body long, span long, window long, cut boolean"), "extended")
    later = with_earliest(found.filter("not cut"), "window", ["id", "body", "span"]).filter(
        "id > origin.id or (id = origin.id and (body > origin.body or"
        " (body = origin.body and shiftright(span, 32) >= (origin.span & 4294967295))))"
    )
    cut = found.filter("cut").select("id", "body", "span").unionByName(later.select("id", "body", "span"))
    return cut.groupBy("id", "body").agg(F.array_sort(F.collect_set("span")).alias("cut"))


def without(text, cut):
    """The text without the lines in the stretches, how many those are and how many it had."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, dtype=np.int64)
    for span in cut:
        gone[span >> 32] += 1
        gone[span & 0xFFFFFFFF] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    kept = [line for line, g in zip(lines, gone.tolist()) if not g]
    return "\n".join(kept), int(gone.sum()), len(lines)


def dedup_lines(docs: DataFrame, least_words=LEAST_WORDS, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with the text's later repeated runs of lines deleted.

    Adds ``lines_before`` and ``lines_removed`` (replacing columns of those names). A run has at least ``least_words`` words; the
    earliest occurrence, by id and line, stays whole, and one that overlaps it stays too. Lines are
    equal if their bytes are, A-Z taken as a-z. Null and empty texts stay as they are, as do
    rows without id. Rows that repeat an id with other texts are documents of their own, in the order of the texts' hashes; those
    that repeat id and text are one document listed again, and all of its listings are cut alike. Texts of any
    length are read whole. An empty table gives an empty result.
    """
    docs = docs.drop("lines_before", "lines_removed")
    names = docs.columns
    mark = "cut"
    while any(mark in n for n in names):
        mark += "_"
    cuts = repeated_lines(docs, least_words, id_col, text_col).toDF(f"{mark}1", f"{mark}2", mark)
    same = (F.col(id_col) == F.col(f"{mark}1")) & (F.xxhash64(text_col) == F.col(f"{mark}2"))
    joined = docs.join(cuts, same, "left")

    def applied(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, removed, before = [], [], []
            for text, cut in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                text, cut = text.as_py(), cut.as_py()
                if cut:
                    text, gone, n = without(text or "", cut)
                else:
                    gone, n = 0, text.count("\n") + 1 if text is not None else 0
                texts.append(text)
                removed.append(gone)
                before.append(n)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(before, pa.int64()), pa.array(removed, pa.int64())],
                [*batch.schema.names[:-1], "lines_before", "lines_removed"],
            )

    schema = T.StructType(
        [*docs.schema.fields, T.StructField("lines_before", T.LongType()), T.StructField("lines_removed", T.LongType())]
    )
    return joined.select(*[F.col(f"`{n}`") for n in names], mark).mapInArrow(applied, schema)
