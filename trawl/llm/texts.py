"""Words of whole texts as 64-bit hashes, straight from Arrow buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. UTF-8
never uses those bytes inside a character. Null texts count as empty.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
_powers = {}


def mix(x):
    """A bijective scrambling of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base, n):
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[: n + 1]


def slices(column, limit=1 << 21):
    """(first row, bytes, offsets) for stretches of rows of about ``limit`` bytes.

    One longer text makes a stretch of its own, so texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        part = offsets[first : last + 1]
        yield first, data[part[0] : part[-1]], part - part[0]
        first = last


def word_spans(data, offsets, separators=_SPACE):
    """Start and end of every word, and where each text's words begin in them."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    solid = ~separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data, starts, ends, seed=0):
    """A hash of the bytes of each span, the same wherever the span lies."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    base = (BASE + 2 * seed * 0x632BE59BD9B4E019) & MASK | 1
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * powers(base, len(data))[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse, len(data))[starts]
               + (ends - starts).astype(np.uint64))


def word_hashes(data, offsets):
    """Hashes of all words and where each text's words begin."""
    starts, ends, bounds = word_spans(data, offsets)
    return span_hashes(data, starts, ends), bounds


def shingle_hashes(words, n):
    """The distinct n-word shingles of one text, sorted.

    Fewer words than ``n`` make one shingle of the whole sequence; no words, none.
    """
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64)
    m = min(n, len(words))
    total = np.full(len(words) - m + 1, m, dtype=np.uint64)
    for i in range(m):
        total = mix(total * np.uint64(BASE) + words[i : len(words) - m + 1 + i])
    return np.unique(total)
