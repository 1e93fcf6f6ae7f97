"""Fill-in-the-middle texts by rotating blocks in place.

A text is cut at two code points into prefix, middle and suffix. Its bytes stand in one
bytearray, the sentinels are put in at the cuts, and neighbouring blocks change places by
three reversals: each block, then both together. The same rotations in reverse order, and
sentinels taken out, give the text back byte for byte.

Every row is worked on where it is read: no shuffle, and no more memory than a batch of rows.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
PLAIN, PSM, SPM = "plain", "psm", "spm"


def rotate(buffer, a, b, c):
    """Blocks [a, b) and [b, c) of a bytearray change places."""
    for low, high in ((a, b), (b, c), (a, c)):
        part = buffer[low:high]
        part.reverse()
        buffer[low:high] = part


def transformed(text, low, high, form, sentinels=SENTINELS):
    """The text cut at code points ``low`` <= ``high`` in the layout ``form``."""
    if form == PLAIN:
        return text
    before, after, middle = (s.encode() for s in sentinels)
    buffer = bytearray(text, "utf-8")
    first = len(text[:low].encode())
    second = first + len(text[low:high].encode())
    buffer[second:second] = after
    buffer[first:first] = middle
    buffer[0:0] = before
    cut = len(before) + first  # prefix block, middle block and suffix block lie in text order now
    end = cut + len(middle) + second - first
    if form == PSM:
        rotate(buffer, cut, end, len(buffer))
    else:
        rotate(buffer, 0, end, len(buffer))
    return buffer.decode()


def restored(output, form, sentinels=SENTINELS):
    """The text that ``transformed`` was given, from its output and form alone."""
    if form == PLAIN:
        return output
    before, after, middle = (s.encode() for s in sentinels)
    buffer = bytearray(output, "utf-8")
    if form == PSM:
        cut, end = buffer.find(after), buffer.find(middle)
        rotate(buffer, cut, end, len(buffer))  # suffix block behind middle block again
        end = cut + len(buffer) - end
    else:
        rotate(buffer, 0, buffer.find(before), len(buffer))
        cut, end = buffer.find(middle), buffer.rfind(after)
    del buffer[end : end + len(after)]
    del buffer[cut : cut + len(middle)]
    del buffer[: len(before)]
    return buffer.decode()


def check_sentinels(sentinels):
    """No sentinel may begin or lie where another one ends, or marks could not be told apart."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            ends = any(b.startswith(a[-size:]) for size in range(1, len(a)))
            if not a or ends or (i != j and a in b):
                raise ValueError("sentinels must be distinct and must not overlap")


def drawn(key, n, plain_percent, spm_percent):
    """(form, end of prefix, end of middle) for a text of ``n`` code points, from its key."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or h3 % 100 >= 100 - plain_percent:
        return PLAIN, low, high
    return (SPM if h4 % 100 < spm_percent else PSM), low, high


def fill_in_middle(
    docs: DataFrame, id_col="doc_id", text_col="text", seed=1, plain_percent=10, spm_percent=20, sentinels=SENTINELS
) -> DataFrame:
    """One row per row of ``docs``: id, n, form, prefix_chars, middle_chars, output.

    Cuts and form are drawn from the seed and the id, so reruns agree and rows that repeat an id
    are cut at the same draws. Form is plain (the text as it is), psm (prefix, suffix, middle)
    or spm (suffix, prefix, middle); texts that are empty or hold a sentinel stay plain, and
    the two lengths, in code points, are null there. Null text counts as empty; a null id
    draws like an empty one. Texts of any length are cut whole, one at a time. Other columns of ``docs`` play no
    part, so their names cannot clash. An empty table gives an empty result.
    """
    check_sentinels(sentinels)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                form, low, high = drawn(key, len(text), plain_percent, spm_percent)
                if any(s in text for s in sentinels):
                    form = PLAIN
                sizes = (None, None) if form == PLAIN else (low, high - low)
                row = (len(text), form, *sizes, transformed(text, low, high, form, sentinels))
                for values, value in zip(out, row):
                    values.append(value)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, t) for v, t in zip(out, types)]],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restore(rows: DataFrame, output_col="output", form_col="form", sentinels=SENTINELS) -> DataFrame:
    """``rows`` with a column ``restored``: the text behind each output.

    Null output or form gives null. A column named ``restored`` is replaced.
    """
    check_sentinels(sentinels)
    rows = rows.drop("restored")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for batch in batches:
            outputs, forms = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (output_col, form_col))
            texts = [
                None if o is None or f is None else restored(o, f, sentinels) for o, f in zip(outputs, forms)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "restored"])

    return rows.mapInArrow(run, f"{fields}, restored string")
