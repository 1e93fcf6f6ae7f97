"""Spelling variants by walking words through a trie that is a table.

The trie of all words is a relation of edges. Only nodes where words part are kept, so an edge
carries a label of one or more letters and leads to the next such node or to a word's end.
A state (word, position, node, edits) says that the word, read up to a position with so many edits, has reached a
node. States join the edges level by level: each level reads one label, and a state whose word goes on
otherwise is dropped. States that reach an end with one edit name a neighbour.

Two words one edit apart agree in a first or in a last half. Words are therefore read in both
directions, each time with the edit in the second half only: the levels near the root, where a node has
many children, are never walked. An edit can start only where words part, for elsewhere
the only letter to go on with is the word's own.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trawl.llm.texts import BASE, MASK, mix, powers
from trawl.session import written

LETTERS = r"[a-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\n"  # closes every word in the trie
STRETCH = 1 << 20  # letters hashed at once


def word_counts(docs: DataFrame, id_col="doc_id", text_col="text", every=31, least=7, times=2) -> DataFrame:
    """word, n of the letter runs of whole texts that have ``least`` letters and occur ``times`` times.

    Only A-Z is lower-cased. A run whose crc32 with its document's id is a multiple of ``every`` loses one letter
    (0: none does), a stated rate of slips to find again. Null texts have no words, a null id counts as
    an empty one, repeated rows count again. No other column plays a part.
    """
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = F.regexp_extract_all(
        F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0)
    )  # a run of fewer letters gives no word
    found = docs.select(id_text.alias("id"), F.explode_outer(runs).alias("run")).filter("run is not null")
    word = F.col("run")
    if every:
        mark = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (F.col("mark") % F.length("run")).cast("int")
        slip = F.concat(F.expr("left(run, at)"), F.expr("substr(run, at + 2)"))
        found = found.withColumn("mark", mark).withColumn("at", at)
        word = F.when(F.col("mark") % every == 0, slip).otherwise(F.col("run"))
    words = found.select(word.alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def prefix_rows(words: DataFrame) -> DataFrame:
    """way, node, depth, next, after: a word's places in the trie from its half on.

    ``words`` has way (a word in one direction) and path (its letters and END). A node is the hash of the letters
    so far and the direction; ``next`` and ``after`` are the two code points that follow.
    """

    def run(batches):
        for batch in batches:
            ways = batch.column(0).to_numpy()
            paths = batch.column(1).to_pylist()
            sizes = np.array([len(p) for p in paths], dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            first = 0
            while first < len(paths):
                last = int(np.searchsorted(bounds, bounds[first] + STRETCH, "right")) - 1
                last = max(last, first + 1)
                yield from places(ways[first:last], paths[first:last], sizes[first:last])
                first = last

    def places(ways, paths, sizes):
        codes = np.frombuffer("".join(paths).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        base = BASE | 1
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)) * powers(base, len(codes))[:-1], out=sums[1:])
        half = (sizes - 1 + (ways & 1)) // 2
        count = sizes - half  # the last place has END next
        word = np.repeat(np.arange(len(paths)), count)
        depth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + half[word]
        at = starts[word] + depth
        inverse = powers(pow(base, -1, 1 << 64), len(codes))
        node = mix((sums[at] - sums[starts[word]]) * inverse[starts[word]] + depth.astype(np.uint64))
        node = mix(node * np.uint64(BASE) + (ways[word] & 1).astype(np.uint64))
        after = np.where(at + 1 < starts[word] + sizes[word], np.append(codes, 0)[at + 1], 0)
        arrays = [ways[word], node.view(np.int64), depth.astype(np.int32), codes[at].astype(np.int32), after.astype(np.int32)]
        for i in range(0, len(word), STRETCH):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[i : i + STRETCH]) for a in arrays], ["way", "node", "depth", "next", "after"]
            )

    return words.select("way", "path").mapInArrow(run, "way long, node long, depth int, next int, after int")


def trie(words: DataFrame):
    """(places, edges) of the words' trie.

    Places are the words' own ways through nodes where words part: way, path, node, depth, next, after. Edges are
    node, first (code point), label, to (node or null at an end), leaf (way that ends there, else null).
    """
    rows = prefix_rows(words)
    parting = (
        rows.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"))
        .filter("low < high").select("node")
    )
    own = Window.partitionBy("way").orderBy("depth")
    places = rows.join(parting, "node").withColumns(
        {"to": F.lead("node").over(own), "until": F.lead("depth").over(own)}
    )
    places = written(places.join(words, "way"), "places")
    # all words that leave a node by one letter go together up to the next node
    way = F.min_by(F.struct("to", "until", "depth", "path", "way"), F.col("way")).alias("e")
    size = F.coalesce(F.col("e.until"), F.length("e.path")) - F.col("e.depth")
    edges = places.groupBy("node", F.col("next").alias("first")).agg(way).select(
        "node",
        "first",
        F.substring(F.col("e.path"), F.col("e.depth") + 1, size).alias("label"),
        F.col("e.to").alias("to"),
        F.when(F.col("e.to").isNull(), F.col("e.way")).alias("leaf"),
    )
    return places, written(edges, "edges")


def read_label(states: DataFrame, edges: DataFrame, skipped: int) -> DataFrame:
    """States a label further: way, node, rest, leaf. The first ``skipped`` letters of a label are the edit's."""
    label = F.substring(F.col("label"), skipped + 1, F.length("label")) if skipped else F.col("label")
    on = (states["node"] == edges["node"]) & (states["wanted"] == edges["first"])
    if skipped:  # another letter in place of the word's own; of the two words the one with the smaller letter asks
        on = (states["node"] == edges["node"]) & (states["wanted"] < edges["first"])
    joined = states.join(edges, on)
    return joined.filter(F.col("rest").startswith(label)).select(
        "way",
        F.col("to").alias("node"),
        F.substring(F.col("rest"), F.length(label) + 1, F.length("rest")).alias("rest"),
        "leaf",
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: ids of all words one inserted, deleted or replaced letter apart, each pair once.

    ``words`` is a stored table of id and word, both without repeats.
    """
    path = F.concat("word", F.lit(END))
    back = F.concat(F.reverse("word"), F.lit(END))
    ways = words.select((F.col("id") * 2).alias("way"), path.alias("path")).unionByName(
        words.select((F.col("id") * 2 + 1).alias("way"), back.alias("path"))
    )
    places, edges = trie(ways)
    end = ord(END)
    rest = F.substring(F.col("path"), F.col("depth") + 2, F.length("path"))
    started = places.filter(F.col("next") != end)
    replaced = started.select("way", "node", F.col("next").alias("wanted"), rest.alias("rest"))
    # of equal letters in a row the last one is the deleted one
    deleted = started.filter("after != next").select("way", "node", F.col("after").alias("wanted"), rest.alias("rest"))
    states = written(read_label(replaced, edges, 1).unionByName(read_label(deleted, edges, 0)), "states")
    ends = []
    while True:
        ends.append(states.filter("node is null and rest = ''").select("way", "leaf"))
        going = states.filter("node is not null and rest != ''").drop("leaf")
        if going.isEmpty():
            break
        states = written(read_label(going.withColumn("wanted", F.ascii("rest")), edges, 0), "states")
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    a, b = F.shiftright("way", 1), F.shiftright("leaf", 1)
    return found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def spelling_variants(counts: DataFrame, ratio=10) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them, 0 if there are
    none. A word's form is its near word of largest n, of equal ones the smallest in code-point order, where that
    n is ``ratio`` (above 1) times its own or more; root is the end of the forms that follow from the word.

    Null words go; words hold no line breaks. Words of any length are read whole. An empty table gives an empty result. Other
    columns of ``counts`` play no part.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or forms would go round in circles")
    numbered = counts.filter("word is not null").select(F.monotonically_increasing_id().alias("id"), "word", "n")
    words = written(numbered, "words")  # the numbers hold once they are written
    pairs = written(near_pairs(words.select("id", "word")), "pairs")
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("other"))
    )
    other = words.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other_word", "other")).alias("best")
    seen = both.join(other, "other").groupBy("id").agg(F.count("*").alias("n_near"), best)
    known = words.join(seen, "id", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    known = written(
        known.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(formed, F.col("best.other")).alias("form_id"),
            F.when(formed, F.col("best.other_word")).alias("form"),
            F.when(formed, -F.col("best.less")).alias("form_n"),
        ),
        "known",
    )
    # a form is ratio times as frequent, so chains are short; pointers double
    steps = known.filter("form is not null").select("id", F.col("form_id").alias("to"), F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("next_root"))
        moved = steps.join(onward, "to", "left")
        steps = written(
            moved.select(
                "id", F.coalesce("next", "to").alias("to"), F.coalesce("next_root", "root").alias("root"),
                F.col("next").isNotNull().alias("moved"),
            ),
            "roots",
        )
        if steps.filter("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return known.join(steps.select("id", "root"), "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
