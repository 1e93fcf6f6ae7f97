"""Secret scans over a trigram inverted index.

Every rule is a regular expression. From its syntax tree follows a Boolean query over
trigrams that any match must contain, in lower case. Each stretch of documents gets an inverted index
of the trigrams that the queries name; postings are intersected and united
as the queries say, and only the candidates are searched with the expression itself. A
rule without mandatory trigrams searches every document.

The index is built where the stretch is read and dropped with it, so texts never
move between executors.
"""

import hashlib
import re
from re import _constants as sre, _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trawl.llm.texts import slices

# The base kinds, in their order.
BASE = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is a whole run
)
ADDED = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9+/_.=~-]+)", 1, 16),
)
RULES = BASE + ADDED
KINDS = tuple(r[0] for r in RULES)
MOST_STRINGS = 64  # alternatives a query tells apart before it settles for less


def trigrams(strings):
    """The query for text that contains one of ``strings``: any of alls, or None for no condition."""
    alls = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in alls else frozenset(alls)


def both(a, b):
    if a is None or b is None:
        return b if a is None else a
    joined = frozenset(x | y for x in a for y in b)
    return joined if len(joined) <= MOST_STRINGS else min(a, b, key=len)


def either(queries):
    return None if any(q is None for q in queries) else frozenset().union(*queries)


def single(kind, value):
    """As ``derived``, of one node; (None, None) says that anything may stand there."""
    if kind is sre.LITERAL:
        return {chr(value).lower()}, None
    if kind is sre.IN and all(k is sre.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}, None
    if kind is sre.SUBPATTERN:
        return derived(value[-1])
    if kind is sre.BRANCH:
        parts = [derived(p) for p in value[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*[s for s, _ in parts]), None
        return None, either([q if s is None else trigrams(s) for s, q in parts])
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = value
        strings, query = derived(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, None
        if low:
            return None, query if strings is None else trigrams(strings)
    return None, None


def derived(nodes):
    """(all strings the nodes can match, None), or (None, what any match must contain)."""
    run, exact, query = {""}, True, None
    for kind, value in nodes:
        strings, inner = single(kind, value)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query = both(both(query, trigrams(run)), inner if strings is None else trigrams(strings))
        run, exact = {""}, False
    return (run, None) if exact else (None, both(query, trigrams(run)))


def trigram_query(pattern):
    """Sets of trigrams, one of which every match contains whole; None where none is mandatory.

    Trigrams are ASCII and in lower case, as the index is.
    """
    strings, query = derived(parser.parse(pattern))
    query = query if strings is None else trigrams(strings)
    return query if query is None or all(t.isascii() for q in query for t in q) else None


def code(trigram):
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class TrigramIndex:
    """Postings of the wanted trigrams over one stretch of texts."""

    def __init__(self, wanted):
        self.codes = np.array(sorted({code(t) for t in wanted}), dtype=np.int64)
        self.table = np.zeros(1 << 24, dtype=bool)
        self.table[self.codes] = True
        self.lower = np.arange(256, dtype=np.int32)
        self.lower[65:91] += 32

    def build(self, data, offsets):
        none = np.zeros(0, dtype=np.int64)
        self.postings = dict.fromkeys(self.codes.tolist(), none)
        if len(data) >= 3:
            low = self.lower[data]
            grams = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
            at = np.flatnonzero(self.table[grams])
            text = np.searchsorted(offsets, at, "right") - 1
            inside = at + 3 <= offsets[text + 1]
            pairs = np.unique(grams[at[inside]].astype(np.int64) << 32 | text[inside])
            kinds, first = np.unique(pairs >> 32, return_index=True)
            for gram, rows in zip(kinds.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:])):
                self.postings[gram] = rows
        return self

    def candidates(self, query):
        """Texts that hold all trigrams of at least one of the query's sets."""
        found = np.zeros(0, dtype=np.int64)
        for grams in query:
            lists = sorted((self.postings[code(g)] for g in grams), key=len)
            rows = lists[0]
            for other in lists[1:]:
                rows = np.intersect1d(rows, other, assume_unique=True)
            found = np.union1d(found, rows)
        return found.tolist()


def matches(pattern, group, least, text):
    """Leftmost non-overlapping matches whose group has ``least`` characters."""
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col="doc_id", text_col="text", rules=RULES) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, the end exclusive, of whole matches, by start and
    then by the order of the rules. Null text counts as empty and has none. Null and
    repeated ids are rows like any others. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]

    def scanned(batches):
        compiled = [(re.compile(p, re.ASCII), group, least) for _, p, group, least in rules]
        queries = [trigram_query(p) for _, p, _, _ in rules]
        index = TrigramIndex({t for q in queries if q for grams in q for t in grams})
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            found = [[] for _ in range(len(texts))]
            for first, data, offsets in slices(texts):
                index.build(data, offsets)
                every = range(len(offsets) - 1)
                texts_here = {}
                for k, (query, rule) in enumerate(zip(queries, compiled)):
                    for row in every if query is None else index.candidates(query):
                        text = texts_here.get(row)
                        if text is None:
                            text = texts_here[row] = texts[first + row].as_py()
                        found[first + row] += [(a, k, b) for a, b in matches(*rule, text)]
            out = [[], [], [], [], []]
            for spans in found:
                spans.sort()
                base = [s for s in spans if s[1] < len(BASE)]
                for k in range(3):
                    out[k].append(sum(s[1] == k for s in base))
                out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[4].append(joined(spans))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, t) for v, t in zip(out, types)]],
                ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scanned, schema).withColumnRenamed("id", id_col)
