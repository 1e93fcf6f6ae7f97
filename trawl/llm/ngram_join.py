"""Similarity join of word n-gram sets, exact, by partitioning the universe.

Sets are banded by size. In a band two sets that are similar enough differ in at most H
elements, so if a set has elements in more than H segments of the universe, at least one of these
parts is the same in both (pigeonhole). Every set indexes its part of each segment. A set with elements in too
few of them is also indexed by its first elements in an order of all, as many as it can differ in
and one more: if both sets are such, the first element that they share is among these of both. A set
with more segments than it needs may leave out as many as the surplus: those whose lists are
longest, and empty ones. Where too many lists are long, a segment that counts twice makes up for one left
out: there, sets that differ by one element meet too, over the neighbourhoods that deleting one
element gives. All candidates are verified on the whole sets.

Equal sets are one from the start. In every list the members are first set against its hub, the
member that shares most lists with others, then against a drawn member; what
links becomes one component, and only members of different components are paired after that, since
a link inside one changes nothing. So a group of copies costs few pairs beyond its size.

Lists that stay long hold variants of one text that miss the threshold with each other. Their
members are seen from a common hub: two sets differ in just those elements in which their
differences from the hub differ. A set that does not link to the hub is far from it, so a link
needs differences with much in common, and these are joined by their rarest elements.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trawl.llm.components import components
from trawl.llm.exact_dedup import tree_merge
from trawl.llm.texts import BASE, mix, shingle_hashes, slices, word_hashes
from trawl.session import written

LONG_LIST = 16  # members beyond which a list is not paired directly
BAND_RATIO = 1.4
PIECE = 1 << 18  # values that a task puts out at a time
DRAWS = 1  # rounds that set members against a drawn one before all are paired


class Bands:
    """Size bands and their numbers of segments for J >= num / den."""

    def __init__(self, num, den, largest=1 << 40):
        self.num, self.den = num, den
        lows = [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, int(lows[-1] * BAND_RATIO)))
        self.lows = lows

    def band(self, n):
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def of(self, n):
        """Bands in which a set of ``n`` elements can meet a smaller or equal partner."""
        return range(self.band(max(1, -(-self.num * n // self.den))), self.band(n) + 1)

    def differing(self, band):
        """The most elements in which two similar sets can differ, the smaller in the band."""
        small = self.lows[band + 1] - 1
        return (self.den - self.num) * (small + self.den * small // self.num) // (self.den + self.num)

    def apart(self, n, band):
        """The most elements in which a set of ``n`` can differ from a similar one, the smaller in the band."""
        most = (self.den - self.num) * (n + self.den * n // self.num) // (self.den + self.num)
        return min(self.differing(band), most)

    def first_elements(self, n):
        """So many of a set's ``n`` elements, in an order of all, that a similar set has one of them
        among its own first ones: all but those that must be shared, and one."""
        return n - -(-self.num * n // self.den) + 1

    def segments(self, band):
        least = self.differing(band) + 1
        return least + max(1, least // 8)


def segmented(shingles, band, count):
    """The distinct segments of a set, their element sums and sizes, and each element's segment."""
    place = (mix(shingles ^ np.uint64((band + 1) * BASE & ((1 << 64) - 1))) % np.uint64(count)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, values = place[order], mix(shingles[order] + np.uint64(BASE))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    sums = np.add.reduceat(values, first)
    sizes = np.diff(np.append(first, len(place)))
    return place[first], sums, sizes, values, np.repeat(np.arange(len(first)), sizes)


def signature(band, segment, total):
    tag = (segment.astype(np.uint64) << np.uint64(8)) + np.uint64(band)
    return mix(mix(tag + np.uint64(BASE)) ^ total).view(np.int64)


def element_signatures(shingles, band, count):
    """Of the ``count`` first elements of a set, in the order of their hashes."""
    order = np.sort(mix(shingles ^ np.uint64(BASE)))[:count]
    return mix(order + np.uint64((band + 1) * BASE & ((1 << 64) - 1))).view(np.int64)


def each_set(batches, n, text=1):
    """Batches in pieces of about 2 MB of text, so that what is made of a piece is bounded
    too, each with the (row in piece, shingles) of its texts."""
    for batch in batches:
        for row, data, offsets in slices(batch.column(text)):
            words, bounds = word_hashes(data, offsets)
            sets = (
                (i, shingle_hashes(words[bounds[i] : bounds[i + 1]], n)) for i in range(len(bounds) - 1)
            )
            yield batch.slice(row, len(offsets) - 1), sets


def runs_of(sizes, limit=PIECE):
    """(first, last) of runs of rows of about ``limit`` values together; one larger row is a run."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, last
        first = last


def set_keys(n):
    def keys(batches):
        for batch, sets in each_set(batches, n):
            size, k1, k2 = [], [], []
            for _, s in sets:
                size.append(len(s))
                k1.append(int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                k2.append(int(np.add.reduce(mix(s ^ np.uint64(BASE))).view(np.int64)) if len(s) else 0)
            columns = [batch.column(0), *[pa.array(v, pa.int64()) for v in (size, k1, k2)]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "k1", "k2"])

    return keys


def packed(parts, kind):
    return pa.array([p.astype(kind).tobytes() for p in parts], pa.binary())


def exact_signatures(n, bands):
    """Per set, packed: segment signatures, and tags that say how many of them may be left
    out (``spare``, above; below 0 if there are too few) and their band (in the low byte)."""

    def rows(batches):
        for batch, sets in each_set(batches, n):
            sigs, tags = [], []
            for _, s in sets:
                sig, tag = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for band in bands.of(len(s)) if len(s) else ():
                    segment, total, *_ = segmented(s, band, bands.segments(band))
                    sig.append(signature(band, segment, total))
                    if len(segment) <= bands.apart(len(s), band):
                        sig.append(element_signatures(s, band, bands.first_elements(len(s))))
                    spare = len(segment) - bands.differing(band) - 1
                    tag.append(np.full(sum(map(len, sig)) - sum(map(len, tag)), spare * 256 + band))
                sigs.append(np.concatenate(sig))
                tags.append(np.concatenate(tag))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), packed(sigs, np.int64), packed(tags, np.int32)], ["id", "sigs", "tags"]
            )

    return rows


def unpacked(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        sigs = [np.frombuffer(v.as_buffer(), dtype=np.int64) for v in batch.column(1)]
        tags = [np.frombuffer(v.as_buffer(), dtype=np.int32) for v in batch.column(2)]
        sizes = np.array([len(v) for v in sigs], dtype=np.int64)
        for i, j in runs_of(sizes):
            own = np.repeat(ids[i:j].astype(np.int64), sizes[i:j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sigs[i:j])), pa.array(own), pa.array(np.concatenate(tags[i:j]))],
                ["sig", "id", "tag"],
            )


def near_signatures(n, bands):
    """All segments of a set whole (gone 0) and with one element deleted (gone 1).

    A segment met in either form allows one difference and so counts twice, but one of a single
    element, which the other set may lack, once; of these
    segments ``spare`` may be left out. If they count too little, first elements follow as segments of their own.
    """

    def rows(batches):
        for batch, sets in each_set(batches, n):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out = ([], [], [], [], [])
            for row, s in sets:
                for band in bands.of(len(s)) if len(s) else ():
                    count = bands.segments(band)
                    segment, total, sizes, values, of = segmented(s, band, count)
                    whole = signature(band, segment, total)
                    less = signature(band, segment[of], total[of] - values)
                    weight = int(np.minimum(sizes, 2).sum())
                    first = np.zeros(0, np.int64)
                    if weight <= bands.apart(len(s), band):
                        first = element_signatures(s, band, bands.first_elements(len(s)))
                    m = len(whole) + len(less) + len(first)
                    out[0].append(np.concatenate([whole, less, first]))
                    out[1].append(np.full(m, ids[row]))
                    out[2].append(np.full(m, max(0, weight - bands.differing(band) - 1) // 2 * 256 + band))
                    out[3].append(np.concatenate([segment, segment[of], count + np.arange(len(first))]))
                    out[4].append(np.repeat([0, 1, 0], [len(whole), len(less), len(first)]))
            if out[0]:
                kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
                columns = [pa.array(np.concatenate(v).astype(k)) for v, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["sig", "id", "tag", "segment", "gone"])

    return rows


def shared_only(batches):
    """Of rows sorted by signature, those whose signature another row has too."""
    held = None  # the last row, undecided; and whether the one before it was alike
    alike = False
    schema = None
    for batch in batches:
        schema = batch.schema
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if len(columns[0]) == 0:
            continue
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        same = columns[0][1:] == columns[0][:-1]
        keep = np.concatenate([[alike and held is not None], same])
        keep[:-1] |= same
        held = [c[-1:] for c in columns]
        alike = bool(keep[-1])
        out = [pa.array(c[:-1][keep[:-1]], f.type) for c, f in zip(columns, schema)]
        yield pa.RecordBatch.from_arrays(out, schema=schema)
    if held is not None and alike:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema)], schema=schema)


def packed_sets(n):
    def rows(batches):
        for batch, sets in each_set(batches, n):
            data = [s.tobytes() for _, s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.large_binary()).cast(pa.binary())], ["id", "elements"])

    return rows


def verified(num, den):
    """Pairs (a, b) whose sets reach num / den."""

    def rows(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    continue
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int(np.count_nonzero(y[at] == x))
                keep[i] = den * common >= num * (len(x) + len(y) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return rows


def links(pairs: DataFrame, sets: DataFrame, num, den) -> DataFrame:
    # numbers of elements settle most pairs before any set moves
    size = F.length("elements")
    sizes = sets.select("id", size.alias("n"))
    pairs = (
        pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
        .filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b")
    )
    both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(verified(num, den), "a long, b long")


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def best_hubs(shared: DataFrame) -> DataFrame:
    """Each member's hub (id, hub): of the hubs of its lists, the one it shares most of them with."""
    lists = shared.groupBy("sig").agg(F.count("*").alias("members"))
    rank = shared.join(lists, "sig").groupBy("id").agg(F.sum("members").alias("degree"))
    ranked = shared.select("sig", "id").join(rank, "id")
    hubs = ranked.groupBy("sig").agg(F.max(F.struct("degree", (-F.col("id")).alias("hub"))).alias("top"))
    hubs = hubs.select("sig", (-F.col("top.hub")).alias("hub"))
    met = shared.join(hubs, "sig").filter("id != hub").groupBy("id", "hub").agg(F.count("*").alias("lists"))
    best = met.groupBy("id").agg(F.max(F.struct("lists", (-F.col("hub")).alias("hub"))).alias("top"))
    return best.select("id", (-F.col("top.hub")).alias("hub"))


def hub_pairs(hubs: DataFrame) -> DataFrame:
    return hubs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def drawn_pairs(open_rows: DataFrame, step) -> DataFrame:
    """In every list, one drawn member with each member of another component."""
    draw = F.struct(F.xxhash64(F.lit(step), "sig", "id").alias("draw"), F.col("id").alias("b"), F.col("component").alias("other"))
    drawn = open_rows.groupBy("sig").agg(F.min(draw).alias("d"))
    met = open_rows.join(drawn, "sig").filter(F.col("component") != F.col("d.other"))
    return met.select(F.least("id", "d.b").alias("a"), F.greatest("id", "d.b").alias("b")).distinct()


def open_lists(shared: DataFrame) -> DataFrame:
    """The rows of lists with members of several components, and the number of members."""
    several = shared.groupBy("sig", "component").agg(F.count("*").alias("own")).groupBy("sig").agg(
        F.sum("own").alias("members"), F.count("*").alias("components")
    ).filter("components > 1").drop("components")
    return written(shared.join(several, "sig"), "open")


def allocated(open_rows: DataFrame) -> DataFrame:
    """The rows whose lists a set must look through: all but its ``spare`` costliest ones."""
    tagged = open_rows.withColumn("band", F.col("tag") % 256).withColumn("spare", F.shiftright("tag", 8))
    costly = Window.partitionBy("id", "band").orderBy(F.desc("members"), "sig")
    chosen = tagged.withColumn("place", F.row_number().over(costly)).filter("place > spare")
    return written(
        chosen.select("sig", "id", "component", (F.col("members") > LONG_LIST).alias("long")), "probes"
    )


def near_allocated(open_rows: DataFrame) -> DataFrame:
    tagged = open_rows.withColumn("band", F.col("tag") % 256).withColumn("spare", F.shiftright("tag", 8))
    cost = tagged.groupBy("id", "band", "spare", "segment").agg(F.sum("members").alias("cost"))
    costly = Window.partitionBy("id", "band").orderBy(F.desc("cost"), "segment")
    chosen = cost.withColumn("place", F.row_number().over(costly)).filter("place > spare")
    return tagged.join(chosen.select("id", "band", "segment"), ["id", "band", "segment"]).select(
        "sig", "id", "component", "gone"
    )


def cross_pairs(probes: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of members of different components, at most one of which has lost an element."""
    other = rows.select("sig", F.col("id").alias("b"), F.col("component").alias("other"), F.col("gone").alias("lost"))
    met = probes.join(other, "sig").filter("component != other and gone + lost < 2")
    return met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def ngram_join(
    docs: DataFrame, n=3, num=90, den=100, id_col="doc_id", text_col="text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, copies_of.

    ``n_shingles`` counts the distinct word n-grams of the whole text; fewer words make one. Two
    rows link if den * common >= num * united. ``component_id`` is the smallest
    id that links reach, ``copies_of`` the smallest id with an equal set. Null and empty texts
    have no shingles and link with nothing; rows without id share in no component of others and have a
    null one unless an equal set has an id. Rows that repeat an id are equal to whatever
    rows of it link to. An empty table gives an empty result.
    """
    bands = Bands(num, den)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = written(texts.mapInArrow(set_keys(n), "id long, n_shingles long, k1 long, k2 long"), "keys")
    # empty ones equal nothing
    own = F.when(F.col("n_shingles") == 0, F.coalesce("id", F.lit(-1))).otherwise(0)
    rows = written(tree_merge(keys.withColumn("own", own), ["k1", "k2", "n_shingles", "own"]), "rows")
    firsts = rows.filter("id = keep_id and n_shingles > 0").select("id").distinct()

    # rows of one id are one element of the join; texts differ only if the id repeats
    signed = texts.filter("id is not null").mapInArrow(
        exact_signatures(n, bands), "id long, sigs binary, tags binary"
    )
    held = signed.join(firsts, "id", "left_semi").mapInArrow(unpacked, "sig long, id long, tag int")
    shared = written(
        held.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(
            shared_only, "sig long, id long, tag int"
        ),
        "shared",
    )
    wanted = shared.select("id").distinct()
    sets = written(
        texts.join(wanted, "id", "left_semi").mapInArrow(packed_sets(n), "id long, elements binary"), "sets"
    )
    hubs = written(best_hubs(shared), "hubs")
    edges = written(links(hub_pairs(hubs), sets, num, den), "links")
    open_rows = open_lists(labelled(shared, components(edges)))
    for step in range(DRAWS):
        drawn = links(drawn_pairs(open_rows, step), sets, num, den)
        edges = written(edges.unionByName(drawn), "links")
        relabelled = labelled(open_rows.drop("component", "members"), components(edges))
        open_rows = open_lists(relabelled)
    probes = allocated(open_rows)
    whole = F.lit(0).alias("gone")
    pairs = cross_pairs(probes.filter("not long").select("*", whole), open_rows.select("*", whole))
    edges = written(edges.unionByName(links(pairs, sets, num, den)), "links")
    short = probes.filter("long").select("id").distinct()
    if not short.isEmpty():
        near, seen = second_pass(texts, short, components(edges), n, bands, hubs, sets)
        edges = edges.unionByName(links(near, sets, num, den)).unionByName(seen)
        edges = written(edges, "links")
    found = components(edges)
    return (
        rows.join(found.toDF("keep_id", "component"), "keep_id", "left")
        .select(
            F.col("id").alias(id_col), "n_shingles",
            F.coalesce("component", "keep_id", "id").alias("component_id"),
            F.col("keep_id").alias("copies_of"),
        )
    )


def second_pass(texts, short, found, n, bands, hubs, sets):
    """Pairs among the sets whose lists are too long, over one-deletion neighbourhoods, and the
    links to hubs met on the way. Lists that are long even here are seen from their hubs."""
    schema = "sig long, id long, tag int, segment int, gone int"
    rows = texts.join(short, "id", "left_semi").mapInArrow(near_signatures(n, bands), schema)
    shared = rows.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(shared_only, schema)
    open_rows = open_lists(labelled(written(shared, "near"), found))
    probes = written(near_allocated(open_rows), "probes")
    brief = open_rows.filter(F.col("members") <= LONG_LIST)
    pairs = cross_pairs(probes, brief)
    seen = hub_views(open_rows.filter(F.col("members") > LONG_LIST), hubs, sets, bands.num, bands.den)
    linked = seen.filter("linked").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    return pairs.unionByName(view_pairs(seen, bands.num, bands.den)).distinct(), linked.distinct()


def differences(num, den):
    """Every element in which a set differs from its hub, and whether the two link.

    With r = (den - num) / (den + num), sets x and y link if they differ in at most
    r (|x| + |y|) elements. Seen from a hub h with differences Ex and Ey they have
    (|Ex| + |Ey| - differing) / 2 of these in common. If x does not link to h, |Ex| > r (|x| + |h|), which
    leaves more than |Ey| (1 - r) / 2 in common, and if y does not either, more than
    (|Ex| + r (|h| - |x|)) / 2; never less than |Ex| less the most that x may differ in. So
    some common one is among the first ``|Ex| - least in common + 1`` of Ex in any order:
    ``lone`` counts these for partners that do not link to h, ``tied`` for the others.
    """
    a, b = den - num, den + num

    def rows(batches):
        names = ["hub", "id", "component", "n", "apart", "lone", "tied", "element"]
        for batch in batches:
            out, held = [[] for _ in names], 0
            for hub, own, component, x, h in zip(*batch.columns):
                x, h = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, h))
                apart = np.setxor1d(x, h, assume_unique=True).view(np.int64)
                m, n = len(apart), len(x)
                linked = b * m <= a * (n + len(h))
                if linked:  # only partners that do not link to the hub matter
                    lone, tied = m - (m * num // b + 1) + 1, 0
                else:
                    far = m - a * (n + den * n // num) // b
                    tied = m - max(1, far) + 1
                    lone = m - max(1, far, (b * m + a * (len(h) - n)) // (2 * b) + 1) + 1
                values = (hub.as_py(), own.as_py(), component.as_py(), n, m, lone, tied)
                for o, v in zip(out, values):
                    o.append(np.full(m, v, dtype=np.int64))
                out[7].append(apart)
                held += m
                if held >= PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names)
                    out, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names)

    return rows


def hub_views(long_rows: DataFrame, hubs, sets, num, den) -> DataFrame:
    """The differences of each list's members from the hub that most of them have."""
    home = long_rows.select("sig", "id", "component").join(hubs, "id", "left").withColumn("hub", F.coalesce("hub", "id"))
    most = home.groupBy("sig", "hub").agg(F.count("*").alias("members")).groupBy("sig").agg(
        F.max(F.struct("members", (-F.col("hub")).alias("hub"))).alias("top")
    )
    of_hub = (
        home.drop("hub").join(most.select("sig", (-F.col("top.hub")).alias("hub")), "sig")
        .select("hub", "id", "component").distinct().filter("hub != id")
    )
    both = of_hub.join(sets.toDF("id", "x"), "id").join(sets.toDF("hub", "h"), "hub")
    schema = "hub long, id long, component long, n long, apart long, lone long, tied long, element long"
    seen = both.select("hub", "id", "component", "x", "h").mapInArrow(differences(num, den), schema)
    return written(seen.withColumn("linked", F.col("tied") == 0), "views")


def view_pairs(seen: DataFrame, num, den) -> DataFrame:
    """Pairs of different components, not both linked to the hub, that share one of the rarest
    elements of their differences and can have enough in common after it."""
    counts = seen.groupBy("hub", "element").agg(F.count("*").alias("held")).filter("held > 1")
    own = Window.partitionBy("hub", "id")
    shared = seen.join(counts, ["hub", "element"])
    rare = F.row_number().over(own.orderBy("held", "element"))
    # elements that no other set has come first and need no row
    ranked = shared.withColumn("place", F.col("apart") - F.count("*").over(own) + rare)
    ranked = written(ranked.filter(F.col("place") <= F.greatest("lone", "tied")), "ranked")
    one = ranked.filter("not linked")
    two = ranked.filter("place <= lone").select(
        "hub", "element", *[F.col(c).alias(f"{c}2") for c in ("id", "component", "n", "apart", "place", "linked")]
    )
    most = 1 + F.least(F.col("apart") - F.col("place"), F.col("apart2") - F.col("place2"))
    enough = (F.col("apart") + F.col("apart2") - 2 * most) * (den + num) <= (F.col("n") + F.col("n2")) * (den - num)
    once = F.col("linked2") & (F.col("place") <= F.col("tied")) | ~F.col("linked2") & (F.col("place") <= F.col("lone")) & (F.col("id") < F.col("id2"))
    met = one.join(two, ["hub", "element"]).filter((F.col("component") != F.col("component2")) & once & enough)
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
