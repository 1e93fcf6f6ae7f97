"""Personal data by plain rules and a skip-chain conditional random field.

The rules find e-mail addresses, IP addresses, card and phone numbers in their usual form. A document also
repeats them in other forms: a phone number without its country, a card number grouped by dots, an
address with (at). Every stretch that could be such a mention is a variable of the document's random
field, labelled other, email, ip, card or phone. What the rules found is observed. Neighbours in the
text share a potential, and so do mentions however far apart that have the same digits or
address, or like ones. Loopy message passing carries labels along these links, so that mentions of one
thing get one label; those that come out as personal data are added to the rules' spans.

The field is trained here by pseudo-likelihood on a bounded sample of documents, with the rules' own
finds as labels. Every document is a graph of its own and is worked on where it is read.
"""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
OTHER = 0

# The forms of the base kinds.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().+/:_ -]{0,3}[0-9])*+")
AT = re.compile(r"@|\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20", re.IGNORECASE)
DOT = r"(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)"
ADDRESS = re.compile(rf"[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*+", re.IGNORECASE)
DOTS = re.compile(DOT, re.IGNORECASE)
LEAST_DIGITS, SAME_DIGITS = 7, 9

FEATURES = (
    "any", "at sign", "at word", "dotted name", "plain name", "plus", "bracket", "space", "hyphen", "three points", "other points",
    "colon or slash",
    "four small parts", "luhn", "not luhn", "7 digits", "8 or 9 digits", "10 or 11 digits", "12 to 15 digits",
    "16 digits", "17 to 19 digits", "more digits", "letter beside it",
)
MARKS = ("at sign", "plus", "four small parts", "luhn", "not luhn")  # what the rules go by
FEATURE = {name: i for i, name in enumerate(FEATURES)}
SAME, ALIKE = 0, 1
ROUNDS = 25


def digits_of(text):
    return "".join(c for c in text if "0" <= c <= "9")


def passes_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small(part):
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def emails(text):
    """Leftmost matches, each found from its @: a longest local part before it, a dotted name behind it."""
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        end = domain.end() if domain else at + 1  # no later local part holds this @
        if domain:
            yield start, end
        at = text.find("@", end)


def base_spans(text):
    """(start, kind, end) of what the rules find, sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def possible_mentions(text):
    """(start, end) of stretches that could be personal data in any form."""
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= LEAST_DIGITS and len(digits_of(m.group())) >= LEAST_DIGITS:
            yield m.span()
    end = 0
    for m in AT.finditer(text):
        before = text[end : m.start()]
        start = end + len(before.rstrip(LOCAL))
        name = ADDRESS.match(text, m.end()) if start < m.start() else None
        end = max(end, m.end())
        if name and (m.group() != " at " or DOTS.search(name.group())):
            end = name.end()
            yield start, end


def features_of(text, start, end):
    """The numbers of the features that hold for a stretch."""
    said = text[start:end]
    held = {"any"}
    sign = AT.search(said)
    if sign:
        name = said[sign.end() :]
        held |= {"at sign" if sign.group() == "@" else "at word", "dotted name" if DOTS.search(name) else "plain name"}
        return [FEATURE[f] for f in held]
    digits = digits_of(said)
    size = len(digits)
    held.add(
        "7 digits" if size <= 7 else "8 or 9 digits" if size <= 9 else "10 or 11 digits" if size <= 11
        else "12 to 15 digits" if size <= 15 else "16 digits" if size == 16
        else "17 to 19 digits" if size <= 19 else "more digits"
    )
    for name, signs in (("plus", "+"), ("bracket", "()"), ("space", "  "), ("hyphen", "-"), ("colon or slash", ":/_")):
        if any(c in said for c in signs):
            held.add(name)
    parts = said.split(".")
    if len(parts) > 1:
        held.add("three points" if len(parts) == 4 else "other points")
    if len(parts) == 4 and all(p and digits_of(p) == p and small(p) for p in parts):
        held.add("four small parts")
    if 12 <= size <= 19:
        held.add("luhn" if passes_luhn(digits) else "not luhn")
    if text[start - 1 : start].isalpha() or text[end : end + 1].isalpha():
        held.add("letter beside it")
    return [FEATURE[f] for f in held]


def likeness(text, start, end):
    """(key of equal things, keys of looser likeness) of a stretch.

    Numbers are equal that end in the same nine digits, so a country's number may be left out.
    """
    said = text[start:end]
    sign = AT.search(said)
    if sign:
        local = said[: sign.start()].lower()
        name = DOTS.sub(".", said[sign.end() :]).lower()
        return f"{local}@{name}", [f"{local}@"]
    digits = digits_of(said)
    return digits[-SAME_DIGITS:], [digits[-LEAST_DIGITS:]]


def mentions(text):
    """All variables of a text in order: (start, end, kind or None where no rule saw it)."""
    base = base_spans(text)
    found = [(a, b, k) for a, k, b in base]
    taken = sorted((a, b) for a, _, b in base)
    i, reach = 0, 0
    for a, b in sorted(possible_mentions(text)):
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if a >= reach:
            found.append((a, b, None))
            reach = b
    return sorted(found, key=lambda f: (f[0], f[1], -1 if f[2] is None else f[2]))


def skip_links(text, found):
    """(i, j, SAME or ALIKE) between variables of one likeness, as many as there are variables.

    Every member links to the first member of each kind that a rule saw; where none was seen, to the one before it.
    """
    links = {}
    classes = (defaultdict(list), defaultdict(list))
    for i, (a, b, _) in enumerate(found):
        exact, loose = likeness(text, a, b)
        classes[SAME][exact].append(i)
        for key in loose:
            classes[ALIKE][key].append(i)
    for degree, groups in enumerate(classes):
        for members in groups.values():
            hubs = {}
            for i in members:
                if found[i][2] is not None:
                    hubs.setdefault(found[i][2], i)
            pairs = [(h, i) for h in hubs.values() for i in members if i != h] or list(zip(members, members[1:]))
            for i, j in pairs:
                links.setdefault((min(i, j), max(i, j)), degree)
    return [(i, j, degree) for (i, j), degree in sorted(links.items())]


class Graph:
    """Variables and links of any number of texts, laid end to end."""

    def __init__(self):
        self.held, self.label, self.chain, self.skip, self.where = [], [], [], [], []

    def add(self, row, text):
        found = mentions(text)
        first = len(self.label)
        for a, b, kind in found:
            self.held.append(features_of(text, a, b))
            self.label.append(-1 if kind is None else kind + 1)
            self.where.append((row, a, b))
        self.chain += [(first + i, first + i + 1) for i in range(len(found) - 1)]
        self.skip += [(first + i, first + j, degree) for i, j, degree in skip_links(text, found)]

    def features(self):
        x = np.zeros((len(self.held), len(FEATURES)))
        for row, held in zip(x, self.held):
            row[held] = 1
        return x


class Field:
    """Weights: unary (features x labels), chain (labels x labels), skip (one per degree of likeness)."""

    def __init__(self, unary, chain, skip):
        self.unary, self.chain, self.skip = unary, chain, skip

    def potentials(self, graph):
        """Log potentials of variables and of links, and the links as (from, to)."""
        alone = graph.features() @ self.unary
        label = np.array(graph.label, dtype=int)
        seen = label >= 0
        alone[seen] = -60.0
        alone[np.flatnonzero(seen), label[seen]] = 0.0
        ends = np.array([(i, j) for i, j in graph.chain] + [(i, j) for i, j, _ in graph.skip], dtype=int).reshape(-1, 2)
        same = np.eye(len(LABELS))
        tables = [self.chain] * len(graph.chain) + [self.skip[d] * same for _, _, d in graph.skip]
        return alone, ends, np.array(tables).reshape(-1, len(LABELS), len(LABELS))

    def marginals(self, graph):
        return belief_propagation(*self.potentials(graph))


def belief_propagation(alone, ends, tables, rounds=ROUNDS, kept=0.3):
    """Marginals after ``rounds`` of messages over all links at once, each keeping a share of the last.

    Exact on trees of at most that depth. A fixed number of rounds makes each text's
    result independent of the texts beside it.
    """
    source = np.concatenate([ends[:, 0], ends[:, 1]])
    target = np.concatenate([ends[:, 1], ends[:, 0]])
    table = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.roll(np.arange(len(source)), len(ends))
    message = np.zeros((len(source), alone.shape[1]))

    def beliefs():
        total = alone.copy()
        np.add.at(total, target, message)
        return total

    for r in range(rounds if len(source) else 0):
        sent = (beliefs()[source] - message[back])[:, :, None] + table
        top = sent.max(axis=1, keepdims=True)
        new = np.log(np.exp(sent - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        message = new if r == 0 else kept * message + (1 - kept) * new
    total = beliefs()
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def train(graph, steps=400, rate=0.05, spread=2.0, skip_means=(4.0, 3.0)):
    """The field of largest pseudo-likelihood, pulled to its prior.

    A variable that no rule saw counts as other; one that a rule saw and that has links also counts a second
    time without what the rule goes by, so that links must tell. The prior of the links' weights has the stated means, as few
    documents say the same thing twice; all other weights have mean 0.
    """
    size = len(LABELS)
    x = graph.features()
    label = np.maximum(np.array(graph.label, dtype=int), OTHER)
    around = np.zeros((len(label), 2, size))  # linked labels, by degree
    for i, j, degree in graph.skip:
        around[i, degree, label[j]] += 1
        around[j, degree, label[i]] += 1
    beside = np.zeros((len(label), size))
    for i, j in graph.chain:
        beside[i, label[j]] += 1
        beside[j, label[i]] += 1
    again = np.flatnonzero((label != OTHER) & (around.sum(axis=(1, 2)) > 0))
    bare = x[again].copy()
    bare[:, [FEATURE[m] for m in MARKS]] = 0
    x, label = np.concatenate([x, bare]), np.concatenate([label, label[again]])
    around, beside = np.concatenate([around, around[again]]), np.concatenate([beside, beside[again]])
    aim = np.eye(size)[label]
    means = [np.zeros((len(FEATURES), size)), np.zeros((size, size)), np.array(skip_means)]
    weights = [m.copy() for m in means]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        unary, chain, skip = weights
        score = x @ unary + beside @ chain + (around * skip[None, :, None]).sum(axis=1)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = p - aim
        pull = beside.T @ off
        slopes = [x.T @ off, (pull + pull.T) / 2, (around * off[:, None, :]).sum(axis=(0, 2))]
        for k in range(3):
            slope = slopes[k] + (weights[k] - means[k]) / spread**2
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            fit = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
            weights[k] = weights[k] - rate * fit[0] / (np.sqrt(fit[1]) + 1e-9)
    return Field(*weights)


def fit(docs: DataFrame, id_col="doc_id", text_col="text", most_docs=2000) -> Field:
    """A field trained on at most ``most_docs`` documents with a digit or an @.

    They are those of the smallest hash of id and text, whatever the order of the table.
    """
    marked = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    drawn = marked.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(most_docs)
    sample = marked.join(F.broadcast(drawn), F.xxhash64("text") == F.col("h"), "left_semi")
    numbers = "held array<int>, label int, chain int, skip array<struct<j:int,degree:int>>"

    def graphs(batches):
        """The variables of each text as rows, links as steps back to earlier rows of that text."""
        for batch in batches:
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = Graph()
                g.add(0, text)
                back = defaultdict(list)
                for i, j, degree in g.skip:
                    back[j].append({"j": i, "degree": degree})
                rows = [
                    {"h": h, "held": held, "label": label, "chain": i, "skip": back[i]}
                    for i, (held, label) in enumerate(zip(g.held, g.label))
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=row_type)

    link = pa.list_(pa.struct([("j", pa.int32()), ("degree", pa.int32())]))
    row_type = pa.schema(
        [("h", pa.int64()), ("held", pa.list_(pa.int32())), ("label", pa.int32()), ("chain", pa.int32()), ("skip", link)]
    )
    once = sample.select("text", F.xxhash64("text").alias("h")).dropDuplicates(["h"])
    graph, first = Graph(), 0
    # at most the stated number of documents; of each only its variables
    for row in once.mapInArrow(graphs, f"h long, {numbers}").orderBy("h", "chain").toLocalIterator():
        at = len(graph.label)
        if row["chain"] == 0:
            first = at
        else:
            graph.chain.append((at - 1, at))
        graph.held.append(row["held"])
        graph.label.append(row["label"])
        graph.skip += [(first + s["j"], at, s["degree"]) for s in row["skip"]]
    return train(graph)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, field: Field, id_col="doc_id", text_col="text", least=0.5) -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, the end exclusive, by start and then by kind: the rules' spans, which
    the counts and the hash are of, and those whose label the field gives a marginal of ``least`` or more. Null
    text counts as empty and has none. Null and repeated ids are rows like any others; other columns of ``docs`` play
    no part. Texts are searched whole in time that grows with their length; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    weights = field.unary, field.chain, field.skip

    def run(batches):
        model = Field(*weights)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            graph = Graph()
            for row in range(len(texts)):
                graph.add(row, texts[row].as_py())
            spans = [[] for _ in range(len(texts))]
            base = [[] for _ in range(len(texts))]
            likely = model.marginals(graph) if graph.label else None
            for i, ((row, a, b), seen) in enumerate(zip(graph.where, graph.label)):
                label = seen if seen >= 0 else int(likely[i].argmax())
                if seen > OTHER:
                    base[row].append((a, seen - 1, b))
                if label != OTHER and (seen >= 0 or likely[i, label] >= least):
                    spans[row].append((a, label - 1, b))
            out = [[sum(s[1] == k for s in found) for found in base] for k in range(len(KINDS))]
            out.append([hashlib.sha256(joined(sorted(found)).encode()).hexdigest() for found in base])
            out.append([joined(sorted(found)) for found in spans])
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, t) for v, t in zip(out, types)]],
                ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"id {kind}, {counts}, base_sha256 string, spans string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
