"""Best-fit packing of token sequences by a configuration linear program.

The lengths of all pieces make a histogram of at most ``capacity`` numbers, whatever
the number of documents. Near lengths form a class, so that demands are large enough to be rounded.
A configuration is a multiset of classes whose mean lengths fit one
sequence. Multiplicative weights solve the covering program over configurations:
each round prices classes by how far they lag behind, a knapsack over the capacity
finds the configuration of highest price, and classes that it covers lose weight.
The mean of the rounds is rounded down to whole sequences. Each takes lengths of its
classes that fill it but for ``SLACK`` tokens at most. The program is solved again for what is left as long
as it places some; then pieces left over go to the sequence they fit best. Ranks within a length, taken from distributed
counts, then lead every piece to its sequence and offset.
"""

import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trawl.session import written

TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 1_200_000
CLASSES = 64  # of near lengths, at most
UNIT = 8  # tokens to a step of the knapsack
SLACK = 1  # tokens that a sequence of the program may leave empty
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name=TOKENIZER):
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """The tokenizer's ids of a text, as little-endian uint32 bytes.

    The tokenizer lower-cases, drops white space and never joins over it, so a text's
    ids are those of its words in turn; words seen before come from a bounded cache.
    Texts for which that could fail go through the tokenizer whole: those with characters
    that only Python takes for white space, with the text of a special token, with a
    letter whose lower case depends on its neighbours, or whose lower case composes anew.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.odd = [*special, *"\x1c\x1d\x1e\x1f\u03a3"]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.points = {c: self.encoded(c).tobytes() for c in ".,;:!?"}
        self.known = {}

    def whole(self, text):
        return self.encoded(text).tobytes()

    def encoded(self, text):
        return np.array(
            self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"
        )

    def learn(self, words):
        """Ids of new words. Purely alphabetic ones take one call: the tokenizer sees each as
        one unit, and ids that end a unit are known by their suffix in the vocabulary."""
        plain = [w if w.isalpha() else w[:-1] for w in words]
        stems = list({p for p in plain if p not in self.known and p.isalpha()})
        if stems:
            ids = self.encoded(" ".join(stems))
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            data = ids.tobytes()
            learned = {w: data[a:b] for w, a, b in zip(stems, cuts, cuts[1:])}
        else:
            learned = {}
        odd = []
        for word, stem in zip(words, plain):
            if word not in learned:
                ids = learned.get(stem) or (self.known.get(stem) if stem.isalpha() else None)
                end = self.points.get(word[-1])
                if ids and end:
                    learned[word] = ids + end
                else:
                    odd.append(word)
        if odd:
            found = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
            learned |= {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(odd, found)}
        return learned

    def words(self, text):
        """The words of a text, or None where they do not tell its ids."""
        if any(s in text for s in self.odd):
            return None
        low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        return low.split() if unicodedata.is_normalized("NFC", low) else None

    def __call__(self, texts):
        """Ids of each text; the new words of all are learned in one call."""
        lists = [self.words(t) for t in texts]
        fresh = list(set().union(*filter(None, lists)).difference(self.known))
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = list(set().union(*filter(None, lists)))
        if fresh:
            self.known.update(self.learn(fresh))
        for text, words in zip(texts, lists):
            yield self.whole(text) if words is None else b"".join(map(self.known.__getitem__, words))


_word_ids = {}


def word_ids(path):
    """One per worker, so that later tasks find the words of earlier ones."""
    if path not in _word_ids:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def all_ids(ids_of, column, limit=1 << 16):
    """The ids of a column's texts, in groups of about ``limit`` characters."""
    group, held = [], 0
    for text in column:
        text = text.as_py() or ""
        group.append(text)
        held += len(text)
        if held >= limit:
            yield from ids_of(group)
            group, held = [], 0
    if group:
        yield from ids_of(group)


def tokenized(docs: DataFrame, path, end_id=1, capacity=4096, id_col="doc_id", text_col="text"):
    """The pieces of every document: its ids and ``end_id``, cut only beyond ``capacity``."""

    def pieces(batches):
        ids_of = word_ids(path)
        last = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = ([], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), all_ids(ids_of, batch.column(1))):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    for values, value in zip(out, row):
                        values.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pieces, PIECES)


def best_configuration(prices, sizes, counts, capacity):
    """The multiset of classes of highest total price that fits, as {class: times}.

    Dynamic program over the capacity; a class is used no oftener than it has pieces.
    """
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1, dtype=np.int64)
    for room in range(int(sizes[0]), capacity + 1):
        n = int(np.searchsorted(sizes, room, "right"))
        value = prices[:n] + best[room - sizes[:n]]
        at = int(np.argmax(value))
        best[room] = max(value[at], best[room - 1])
        taken[room] = at if value[at] > best[room - 1] else -1
    chosen, room = {}, capacity
    while room > 0:
        at = int(taken[room])
        if at < 0:
            room -= 1
            continue
        chosen[at] = chosen.get(at, 0) + 1
        room -= int(sizes[at])
    return {a: min(k, int(counts[a])) for a, k in chosen.items()}


def configuration_program(sizes, demand, capacity, rounds, rate=0.5):
    """Fractional numbers of sequences by configuration, from multiplicative weights, and the
    share of its demand that each class gets.

    Every round the configuration that pricing finds is repeated as often as its scarcest class
    allows, and the weights of the classes it serves fall by how much of their demand it meets.
    """
    used, met = {}, np.zeros(len(sizes))
    # a price begins as the share of a sequence, a little more for what is hard to place
    weights = demand * sizes * (1 + 0.1 * sizes / capacity)
    for _ in range(rounds):
        chosen = best_configuration(weights / demand, sizes, demand, capacity)
        at = np.array(list(chosen))
        times = np.array(list(chosen.values()), dtype=np.float64)
        width = float(np.min(demand[at] / times))  # copies that meet one demand in full
        met[at] += times * width / demand[at]
        weights[at] *= np.exp(-rate * times * width / demand[at])
        weights /= weights.max()
        key = tuple(sorted(chosen.items(), reverse=True))
        used[key] = used.get(key, 0.0) + width
    return used, met


def classes_of(left):
    """Neighbouring lengths in classes of about equal numbers of tokens: arrays of lengths."""
    lengths = np.array(sorted(left), dtype=np.int64)
    tokens = np.array([a * left[a] for a in lengths.tolist()], dtype=np.float64)
    most = max(1, min(CLASSES, int(sum(left.values()) ** 0.5)))
    part = ((np.cumsum(tokens) - tokens / 2) * most / tokens.sum()).astype(np.int64)
    return np.split(lengths, np.flatnonzero(part[1:] != part[:-1]) + 1)


def filled(members, means, left, capacity):
    """Lengths for one sequence, one of each class in ``members``: the first ones keep to the
    classes' means, the last two fill what room there is best. None if they leave more than ``SLACK``."""
    free = dict.fromkeys(a for m in members for a in m.tolist() if left.get(a))
    free = {a: left[a] for a in free}
    chosen, ahead = [], 0.0
    for lengths, mean in zip(members[:-2], means):
        lengths = [a for a in lengths.tolist() if free.get(a)]
        if not lengths:
            return None
        a = min(lengths, key=lambda x: (abs(x - mean + ahead), x))
        ahead += a - mean
        free[a] -= 1
        chosen.append(a)
    room = capacity - sum(chosen)
    last = [np.array([a for a in m.tolist() if free.get(a)], dtype=np.int64) for m in members[-2:]]
    if not all(map(len, last)):
        return None
    if len(last) == 1:
        last.append(np.zeros(1, dtype=np.int64))
    sums = last[0][:, None] + last[1][None, :]
    twice = (last[0][:, None] == last[1][None, :]) & (np.array([free.get(a, 0) for a in last[0].tolist()])[:, None] < 2)
    sums = np.where(twice | (sums > room), -1, sums)
    i, j = np.unravel_index(int(np.argmax(sums)), sums.shape)
    if sums[i, j] < 0 or room - sums[i, j] > SLACK:
        return None
    return chosen + [int(last[0][i])] + [int(b) for b in [last[1][j]] if b]


def program_part(left, capacity, rounds):
    """[(configuration, copies)] that the program's rounded solution places; takes them from ``left``."""
    classes = classes_of(left)
    number = np.array([sum(left[a] for a in c.tolist()) for c in classes], dtype=np.float64)
    mean = np.array([sum(a * left[a] for a in c.tolist()) for c in classes]) / number
    sizes = np.maximum(1, np.round(mean / UNIT)).astype(np.int64)
    used, met = configuration_program(sizes, number, capacity // UNIT, rounds)
    scale = len(met) / float(met.sum())
    packed = []
    for key, amount in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        members = [classes[c] for c, k in key for _ in range(k)]
        means = [float(mean[c]) for c, k in key for _ in range(k)]
        copies = int(amount * scale)
        while copies:
            chosen = filled(members, means, left, capacity)
            if chosen is None:
                break
            times = {a: chosen.count(a) for a in chosen}
            same = min([copies, *(left[a] // k for a, k in times.items())])
            packed.append((tuple(sorted(times.items(), reverse=True)), same))
            copies -= same
            for a, k in times.items():
                left[a] -= same * k
                if not left[a]:
                    del left[a]
    return packed


def pack_histogram(counts, capacity=4096, rounds=60):
    """[(configuration, copies)] that holds exactly ``counts`` pieces of each length, and how many pieces
    the program placed, full sequences of one piece aside."""
    left = {int(a): int(n) for a, n in counts.items() if n}
    packed, placed = [], 0
    if capacity in left:
        packed.append((((capacity, 1),), left.pop(capacity)))
    now = sum(left.values())
    while left and 20 * now >= sum(left.values()):
        part = program_part(left, capacity, rounds)
        packed += part
        now = sum(k * copies for key, copies in part for _, k in key)
        placed += now
    return packed + best_fit(left, capacity), placed


def best_fit(left, capacity):
    """What rounding leaves: the longest piece opens a sequence, and the set of pieces
    that fills it best joins, as often as the pieces allow."""
    left, packed = dict(left), []
    while left:
        longest = max(left)
        chosen, room = {longest: 1}, capacity - longest
        lengths = np.array(sorted(a for a in left if a <= room), dtype=np.int64)
        if len(lengths):
            rest = {a: left[a] - (a == longest) for a in lengths.tolist()}
            lengths = np.array([a for a in lengths.tolist() if rest[a]], dtype=np.int64)
            # whole lengths first, so that long pieces go before they become scarce
            while room and len(lengths):
                n = int(np.searchsorted(lengths, room, "right"))
                if not n:
                    break
                a = int(lengths[n - 1])
                pair = room - a
                for b in lengths[:n][::-1][:64].tolist():  # a pair may fill the room better
                    m = int(np.searchsorted(lengths, room - b, "right"))
                    rest_of = room - b - (int(lengths[m - 1]) if m else 0)
                    if rest_of < pair:
                        a, pair = b, rest_of
                chosen[a] = chosen.get(a, 0) + 1
                room -= a
                rest[a] -= 1
                if not rest[a]:
                    lengths = lengths[lengths != a]
        copies = min(left[a] // k for a, k in chosen.items())
        packed.append((tuple(sorted(chosen.items(), reverse=True)), copies))
        for a, k in chosen.items():
            left[a] -= copies * k
            if not left[a]:
                del left[a]
    return packed


def placement(packed):
    """(length, rank, sequence, offset) at which stretches of ranks begin, sorted.

    From there on, each next rank of that length lies in the next sequence at the same offset.
    """
    rows, used, sequence = [], {}, 0
    for key, copies in packed:
        offset = 0
        for length, times in key:
            for _ in range(times):
                rank = used.get(length, 0)
                rows.append((length, rank, sequence, offset))
                used[length] = rank + copies
                offset += length
        sequence += copies
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack_sequences(
    docs: DataFrame, tokenizer=None, capacity=4096, end_id=1, rounds=60,
    id_col="doc_id", text_col="text", stretch_rows=10_000,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Documents are packed row by row, so null or
    repeated ids are rows like any others, and rows that agree in all columns are
    interchangeable. An empty table gives an empty result. The plan that travels to the tasks
    has a few numbers for each configuration and length, whatever the number of rows.
    """
    pieces = written(
        tokenized(docs, tokenizer or tokenizer_path(), end_id, capacity, id_col, text_col), "pieces"
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = placement(pack_histogram(counts, capacity, rounds)[0])
    stretches = max(1, -(-sum(counts.values()) // stretch_rows))
    dealt = pieces.withColumn(
        "stretch", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(stretches)).cast("int")
    )
    ahead = Window.partitionBy("length").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        dealt.groupBy("length", "stretch").agg(F.count("*").alias("n"))
        .withColumn("begin", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    )
    within = Window.partitionBy("length", "stretch").orderBy("id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("place", F.row_number().over(within))
        .join(begins, ["length", "stretch"])
        .select("id", "piece", "start", "length", "ids_crc32",
                (F.col("begin") + F.col("place") - 1).alias("rank"))
    )
    firsts = np.searchsorted(plan[:, 0], np.arange(capacity + 2))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(rank), dtype=np.int64)
            for a in np.unique(length):
                of = length == a
                own = plan[firsts[a] : firsts[a + 1], 1]
                at[of] = firsts[a] + np.searchsorted(own, rank[of], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long").withColumnRenamed(
        "id", id_col
    )
