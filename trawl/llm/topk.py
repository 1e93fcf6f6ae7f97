"""Exact top-k search by BM25 with block-max WAND over shards.

Document frequencies, the number of documents and their mean length are counted over all
documents first, so that every shard scores alike. Queries go out in blocks of bounded size, by their
number and by that of their terms. One
document in ``FIRST`` is searched first; the k best of these are known to all tasks that search the others. Like
queries are brought together, by centres of the terms asked for most. A
task takes its documents shard by shard, brings like ones together in blocks, builds the
inverted index for the terms that the block of queries asks for, and keeps each query's k best. For
a group of queries the lists of rarer terms are added up first. Terms that many of these queries and the documents
have stand in a matrix for each block of documents; their block maxima, or all that a document of the block has of them, and the best
sum of the rarer ones bound what a
block can reach, and blocks that cannot reach a query's k-th best, those of the first and of
earlier documents of the task counted, are skipped. These sums are in single precision; what may be among the k best is added up again in double
precision: no hit is lost. Shards' lists are merged in two levels.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from trawl.llm.texts import slices, span_hashes, word_spans
from trawl.session import written

K1, B = 1.2, 0.75
BLOCK = 64  # neighbouring documents that share an upper bound
STRETCH = 64 * BLOCK  # documents scored at a time
GROUP = 256  # queries scored at a time
GROUPS = 8  # so many of them share a matrix
POSTINGS = 1 << 21  # postings added up at a time
COMMON = 1 / 200  # a term that this share of the pairs of a query and a document have that share the most common one goes into a matrix
MATRIX_TERMS = 2048
ROW, ADDED = 8, 1 << 13  # postings of other terms in a row, and rows added up at a time
TIERS = (64, 256, 512)  # terms of a matrix are bounded together from one of these to the next
MARKS, CENTRES = 512, 8  # terms and centres by which like texts are brought together
FIRST = 16  # one document in so many is searched first
SLACK = 1e-3  # more than sums of a matrix's terms in single precision can be off, as a share
SHARD_BYTES = 32 << 20
SLICE, ROWS = 1 << 18, 1000  # bytes and rows of texts split into terms at a time
BLOCK_QUERIES = 40_000
BLOCK_TERMS = 8_000_000  # terms of all queries of a block

_MARKS = np.ones(256, dtype=bool)
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_hashes(data, offsets):
    """Hashes of all terms, and where each text's begin.

    A term is a run of ASCII letters, digits and other characters, A-Z as a-z.
    """
    starts, ends, bounds = word_spans(data, offsets, _MARKS)
    return span_hashes(data, starts, ends).view(np.int64), bounds


def counted_terms(terms, bounds):
    """(text, term, times) of the distinct terms of each text, by text."""
    terms, edges = terms.copy(), bounds.tolist()
    for i, j in zip(edges[:-1], edges[1:]):
        terms[i:j].sort()
    new = np.ones(len(terms), dtype=bool)
    new[1:] = terms[1:] != terms[:-1]
    new[bounds[:-1][bounds[:-1] < len(terms)]] = True
    first = np.flatnonzero(new)
    return np.searchsorted(bounds, first, "right") - 1, terms[first], np.diff(np.append(first, len(terms)))


def frequencies(batches):
    """Per batch: each term's documents; and, without a term, documents and words."""
    for batch in batches:
        found, words = [], 0
        for _, data, offsets in slices(batch.column(0), SLICE):
            terms, bounds = term_hashes(data, offsets)
            found.append(counted_terms(terms, bounds)[1])
            words += len(terms)
        terms, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(terms, pa.int64()), pa.nulls(1, pa.int64())]),
             pa.array(np.append(n, batch.num_rows).astype(np.int64)), pa.array(np.append(np.zeros(len(n), np.int64), words))],
            ["term", "docs", "words"],
        )


def query_terms(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for row, data, offsets in slices(batch.column(1), SLICE):
            text, term, times = counted_terms(*term_hashes(data, offsets))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row + text].astype(np.int64)), pa.array(term), pa.array(times.astype(np.int64))],
                ["query", "term", "times"],
            )


def ranges(starts, ends):
    """The numbers of every range, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Shard:
    """The inverted index of one shard for a sorted vocabulary."""

    def __init__(self, vocabulary, weights, mean, centres=None):
        self.vocabulary, self.weights, self.mean, self.centres = vocabulary, weights, mean, centres
        self.bits = np.uint64(64 - max(1, len(vocabulary) - 1).bit_length() - 1)
        held = np.bincount(self.slot(vocabulary), minlength=1 << (64 - int(self.bits)))
        self.first, self.depth = np.append(0, np.cumsum(held)).astype(np.int32), int(held.max(initial=0))
        self.ids, self.texts, self.terms, self.times, self.lengths = [], [], [], [], []
        self.n = self.bytes = 0

    def slot(self, terms):
        """The upper bits of a term, in the order of terms."""
        return ((terms.view(np.uint64) ^ np.uint64(1 << 63)) >> self.bits).astype(np.int64)

    def found(self, terms):
        """Which terms are in the vocabulary, and their places there."""
        slot = self.slot(terms)
        at, end = self.first[slot], self.first[slot + 1]
        near = np.flatnonzero(at < end)
        at, end, hash_ = at[near], end[near], terms[near]
        place = np.full(len(near), -1, dtype=np.int32)
        open_ = np.arange(len(near))
        for _ in range(self.depth):
            same = self.vocabulary[at[open_]] == hash_[open_]
            place[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        hit = place >= 0
        return near[hit], place[hit]

    def add(self, ids, data, offsets):
        terms, bounds = term_hashes(data, offsets)
        text, terms, times = counted_terms(terms, bounds)
        near, at = self.found(terms)
        self.terms.append(at)
        self.texts.append((text[near] + self.n).astype(np.int32))
        self.times.append(times[near].astype(np.int32))
        self.lengths.append(np.diff(bounds))
        self.ids.append(ids)
        self.n += len(ids)
        self.bytes += len(data)

    def close(self):
        """Postings by document, and documents in an order that brings like ones together: by the centre that they are
        nearest to or else the term that they have most often, which part languages, then by length."""
        term, doc, times = (np.concatenate(v) for v in (self.terms, self.texts, self.times))
        length, ids = np.concatenate(self.lengths), np.concatenate(self.ids)
        norm = K1 * (1 - B + B * length[doc] / self.mean)
        self.post_terms, self.post_scores = term, self.weights[term] * times * (K1 + 1) / (times + norm)
        self.post_docs, self.post_at = doc, np.searchsorted(doc, np.arange(self.n + 1))
        if self.centres is not None:
            near = nearest(*self.centres, term, self.post_at, len(self.vocabulary))
        else:
            near = np.zeros(self.n, dtype=np.int64)
            some = np.flatnonzero(np.diff(self.post_at))
            if len(some):
                near[some] = np.maximum.reduceat(times.astype(np.int64) << 32 | term, self.post_at[some]) & 0xFFFFFFFF
        self.order = np.lexsort((length, near))
        self.doc_ids = ids
        self.terms = self.texts = self.times = self.lengths = self.ids = None
        return self

    def exact(self, docs, wanted):
        """The scores of documents for the terms marked in ``wanted``, added up in the order of the terms."""
        scores = np.zeros(len(docs))
        for i, d in enumerate(docs.tolist()):
            own = slice(self.post_at[d], self.post_at[d + 1])
            hit = self.post_scores[own][wanted[self.post_terms[own]]]
            if len(hit):
                scores[i] = np.add.accumulate(hit)[-1]
        return scores


class Stretch:
    """Some documents of a shard in blocks: postings by term; common terms as a matrix with their block maxima."""

    def __init__(self, shard, docs, number=None):
        self.docs, self.blocks = docs, -(-len(docs) // BLOCK)
        post = ranges(shard.post_at[docs], shard.post_at[docs + 1])
        post = post[np.argsort(shard.post_terms[post], kind="stable")]
        term = shard.post_terms[post]
        self.sizes = np.bincount(term, minlength=len(shard.vocabulary))
        # rows of a few postings of a term, filled up with zeros, are added up faster than single ones
        self.row_at = np.append(0, np.cumsum(-(-self.sizes // ROW)))
        place = np.arange(len(term)) + (self.row_at[:-1] * ROW - np.cumsum(self.sizes) + self.sizes)[term]
        self.row_docs = np.zeros((self.row_at[-1], ROW), dtype=np.int32)
        self.row_scores = np.zeros((self.row_at[-1], ROW), dtype=np.float32)
        self.row_scores.reshape(-1)[place] = shard.post_scores[post]
        where = np.empty(shard.n, dtype=np.int32)
        where[docs] = np.arange(len(docs))
        self.row_docs.reshape(-1)[place] = where[shard.post_docs[post]]
        self.matrix = None
        if number is not None:
            self.hold(np.argsort(number, kind="stable")[np.count_nonzero(number < 0) :])

    def hold(self, common):
        """Puts the postings of the terms ``common`` into the matrix."""
        starts, ends = self.row_at[common], self.row_at[common + 1]
        rows = ranges(starts, ends)
        doc, scores = np.take(self.row_docs, rows, axis=0).reshape(-1), np.take(self.row_scores, rows, axis=0).reshape(-1)
        real = np.flatnonzero(scores)
        doc, scores = doc[real], scores[real]
        column = np.repeat(np.arange(len(common)), ends - starts)[real // ROW]
        self.matrix = None  # two of them are never held
        self.matrix = np.zeros((self.blocks, len(common), BLOCK), dtype=np.float32)
        self.matrix.reshape(-1)[(doc // BLOCK * len(common) + column) * BLOCK + doc % BLOCK] = scores
        self.most = np.ascontiguousarray(self.matrix.max(axis=2).T)
        # more than a document of a block has in all of a tier of terms
        self.tiers = []
        for first, last in tiers(len(common)):
            own = (column >= first) & (column < last)
            sums = np.bincount(doc[own], scores[own], self.blocks * BLOCK).reshape(self.blocks, BLOCK).max(axis=1)
            self.tiers.append((first, last, (sums * (1 + SLACK)).astype(np.float32)))

    def reaching(self, asks, query, lists, least):
        """Blocks that can reach the ``least`` of some queries: the block, these queries, and the scores, but for rounding, of its documents.

        ``asks`` marks each query's common terms, ``query`` and ``lists`` give its other ones. The latter are added up; with the common
        terms' block maxima, or all that a document of the block has of them, they bound a block.
        """
        n, width = len(asks), self.blocks * BLOCK
        starts, sizes = self.row_at[lists], self.row_at[lists + 1] - self.row_at[lists]
        rows = ranges(starts, starts + sizes)
        place = np.repeat(query * width, sizes)
        found = np.zeros(n * width, dtype=np.float32)
        for i in range(0, len(rows), ADDED):
            own = rows[i : i + ADDED]
            at = np.take(self.row_docs, own, axis=0) + place[i : i + ADDED, None]
            np.add.at(found, at.reshape(-1), np.take(self.row_scores, own, axis=0).reshape(-1))
        bound = np.maximum.reduceat(found, np.arange(0, n * width, BLOCK)).reshape(n, self.blocks)
        found = found.reshape(n, self.blocks, BLOCK)
        for first, last, sums in self.tiers:
            rest = np.minimum(asks[:, first:last] @ self.most[first:last], sums)
            bound += rest
        visit = (bound > 0) & (bound >= least[:, None])
        first = self.tiers[-1][0]
        for b in np.flatnonzero(visit.any(axis=0)):
            rows = np.flatnonzero(visit[:, b])
            own = asks if len(rows) == n else asks[rows]
            scores = own[:, :first] @ self.matrix[b, :first]
            scores += found[:, b] if len(rows) == n else found[rows, b]
            if first:  # the last tier only where it can help
                near = np.flatnonzero(scores.max(axis=1) + rest[rows, b] >= least[rows])
                if not len(near):
                    continue
                if len(near) < len(rows):
                    rows, own, scores = rows[near], own[near], scores[near]
            scores += own[:, first:] @ self.matrix[b, first:]
            yield b, rows, scores

    def scores(self, asks, query, lists, least):
        """Scores, but for rounding, of documents of blocks that can reach a query's ``least``; 0 for others."""
        found = np.zeros((len(asks), self.blocks, BLOCK), dtype=np.float32)
        for b, rows, scores in self.reaching(asks, query, lists, least):
            found[rows, b] = scores
        return found.reshape(len(asks), -1)


def tiers(n):
    """Terms of a matrix, the most common first, in tiers."""
    edges = [0, *(e for e in TIERS if e < n), n]
    return list(zip(edges[:-1], edges[1:]))


def marked(marks, terms, starts, size):
    """For every text, which of the terms ``marks`` it has."""
    column = np.full(size, -1, dtype=np.int32)
    column[marks] = np.arange(len(marks))
    column = column[terms]
    rows = np.zeros((len(starts) - 1, len(marks)), dtype=np.float32)
    hit = np.flatnonzero(column >= 0)
    rows[np.searchsorted(starts, hit, "right") - 1, column[hit]] = 1
    return rows


def nearest(marks, centres, terms, starts, size):
    """The number of the centre that each text is nearest to, by the terms ``marks``."""
    out = np.zeros(len(starts) - 1, dtype=np.int64)
    for i in range(0, len(out), STRETCH):
        own = starts[i : i + STRETCH + 1]
        out[i : i + STRETCH] = (marked(marks, terms[own[0] : own[-1]], own - own[0], size) @ centres.T).argmax(axis=1)
    return out


def middle(terms, starts, size):
    """Terms that are asked for most, and centres of groups of queries that have like ones of them.

    They only set the order in which queries and documents are searched.
    """
    marks = np.argsort(-np.bincount(terms, minlength=size), kind="stable")[:MARKS]
    some = np.arange(0, len(starts) - 1, -(-(len(starts) - 1) // STRETCH))
    own = ranges(starts[some], starts[some + 1])
    rows = marked(marks, terms[own], np.append(0, np.cumsum(starts[some + 1] - starts[some])), size)
    held = np.sqrt(rows.sum(axis=1))
    rows = rows[held >= np.median(held)] / np.maximum(held[held >= np.median(held)], 1)[:, None]
    centres = rows[:1]
    while len(centres) < min(CENTRES, len(rows)):
        centres = np.concatenate([centres, rows[[(rows @ centres.T).max(axis=1).argmin()]]])
    for _ in range(5):
        near = (rows @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                mean = rows[near == c].sum(axis=0)
                centres[c] = mean / max(np.sqrt((mean * mean).sum()), 1e-9)
    return marks, centres


def arranged(terms, starts, size):
    """The order of queries that brings like ones together, and the centres by which it does."""
    centres = middle(terms, starts, size)
    return np.lexsort((np.diff(starts), nearest(*centres, terms, starts, size))), centres


def search_shards(queries, terms, starts, vocabulary, weights, mean, k, shard_bytes, seeds, centres=None):
    def rows(batches):
        held = {}  # query: its best so far in this task
        least = seeds.min(axis=1)  # the k-th score so far
        slack = (np.diff(starts) + 8) * 2.0**-23  # more than sums in single precision can be off, as a share
        wanted = np.zeros(len(vocabulary), dtype=bool)
        dense = np.full(len(vocabulary), -1, dtype=np.int32)

        def take(shard, docs, q):
            wanted[terms[starts[q] : starts[q + 1]]] = True
            scores = np.round(shard.exact(docs, wanted), 9)
            wanted[terms[starts[q] : starts[q + 1]]] = False
            keep = scores >= least[q]
            if keep.any():
                own = held.setdefault(q, [])
                own += zip((-scores[keep]).tolist(), shard.doc_ids[docs[keep]].tolist())
                own.sort()
                del own[k:]
                least[q] = sorted([*seeds[q].tolist(), *(-s for s, _ in own)])[-k]

        def search(shard, part, lo, hi):
            """The queries from ``lo`` to ``hi``, whose common terms are one matrix."""
            asked = terms[starts[lo] : starts[hi]]
            lists = part.sizes[asked]
            pairs = np.bincount(asked, lists, minlength=len(vocabulary))  # of a query and a document that share the term
            common = np.flatnonzero(pairs >= max(COMMON * pairs.max(initial=0), 1))
            common = common[np.argsort(-pairs[common], kind="stable")[:MATRIX_TERMS]]
            part.hold(common)
            dense[common] = np.arange(len(common))
            column = dense[asked]
            dense[common] = -1
            lists[column >= 0] = 0
            of = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
            at = starts[lo : hi + 1] - starts[lo]
            work = np.append(0, np.cumsum(lists))[at]
            hit, rare = np.flatnonzero(column >= 0), np.flatnonzero(lists)
            cell, hit_at = of[hit] * len(common) + column[hit], np.searchsorted(hit, at)
            query, asked, rare_at = of[rare], asked[rare], np.searchsorted(rare, at)
            i = 0
            while i < hi - lo:
                j = int(np.searchsorted(work, work[i] + POSTINGS, "right")) - 1
                j = min(max(j, i + 1), i + GROUP, hi - lo)
                asks = np.zeros((j - i, len(common)), dtype=np.float32)
                asks.reshape(-1)[cell[hit_at[i] : hit_at[j]] - i * len(common)] = 1
                own = slice(rare_at[i], rare_at[j])
                known = least[lo + i : lo + j]
                floor = (known * (1 - slack[lo + i : lo + j]) - 1e-8).astype(np.float32)
                some = asks, query[own] - i, asked[own], floor
                if known.all():
                    rows, docs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                    for b, r, scores in part.reaching(*some):
                        hit = np.flatnonzero((scores >= floor[r, None]).reshape(-1))
                        if len(hit):
                            rows.append(r[hit // BLOCK])
                            docs.append(hit % BLOCK + b * BLOCK)
                    rows, docs = np.concatenate(rows), np.concatenate(docs)
                    order = np.argsort(rows, kind="stable")
                    rows, docs = rows[order], docs[order]
                else:  # of some k are not known yet
                    found = part.scores(*some)
                    for r in np.flatnonzero(known == 0):
                        if found.shape[1] > k:
                            floor[r] = np.partition(found[r], -k)[-k] * (1 - 2 * slack[lo + i + r]) - 1e-8
                    hit = np.flatnonzero((found >= np.maximum(floor, np.float32(1e-30))[:, None]).reshape(-1))
                    rows, docs = hit // found.shape[1], hit % found.shape[1]
                bounds = np.searchsorted(rows, np.arange(j - i + 1))
                for r in np.flatnonzero(np.diff(bounds)):
                    take(shard, part.docs[docs[bounds[r] : bounds[r + 1]]], lo + i + r)
                i = j

        def finish(shard):
            shard.close()
            for first in range(0, shard.n, STRETCH):
                part = Stretch(shard, shard.order[first : first + STRETCH])
                for lo in range(0, len(queries), GROUPS * GROUP):
                    search(shard, part, lo, min(lo + GROUPS * GROUP, len(queries)))

        shard = Shard(vocabulary, weights, mean, centres)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                ids = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for row, data, offsets in slices(some.column(1), SLICE):
                    shard.add(ids[row : row + len(offsets) - 1], data, offsets)
                    if shard.bytes >= shard_bytes:
                        finish(shard)
                        shard = Shard(vocabulary, weights, mean, centres)
        if shard.n:
            finish(shard)
        if held:
            hits = [h for v in held.values() for h in v]
            hits = pa.StructArray.from_arrays(
                [pa.array([s for s, _ in hits], pa.float64()), pa.array([d for _, d in hits], pa.int64())], ["score", "doc"]
            )
            ends = np.cumsum([0, *map(len, held.values())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(queries[list(held)]), pa.ListArray.from_arrays(ends, hits)], ["query", "hits"])

    return rows


def top_k(
    docs: DataFrame, queries: DataFrame, k=10, terms_per_query=None, id_col="doc_id", text_col="text",
    shard_bytes=SHARD_BYTES, block_queries=BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, doc_id, score of each query's k best of ``docs``.

    ``queries`` (query_id, text): a query asks for every distinct term of its whole text, or, if
    ``terms_per_query`` is given, for so many of them with the highest product of frequency there and
    rarity in ``docs``, ties by hash. Only documents with at least one of them are hits. Scores are compared at nine decimals,
    ties go to the smaller id. Null texts are empty; rows without id count in the statistics but are no hits or
    queries; rows that repeat an id are hits of their own, and queries that do are one query. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    stats = written(
        docs.select(text_col).mapInArrow(frequencies, "term long, docs long, words long")
        .groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")),
        "terms",
    )
    total = stats.filter("term is null").first()
    schema = "query_id long, rank int, doc_id long, score double"
    if total is None or not total["words"]:
        return spark.createDataFrame([], schema)
    n, mean = total["docs"], total["words"] / total["docs"]
    asked = queries.filter("query_id is not null").select(F.col("query_id").cast("long"), "text")
    rarity = F.log(1 + (n - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
    chosen = (
        asked.mapInArrow(query_terms, "query long, term long, times long")
        .groupBy("query", "term").agg(F.sum("times").alias("times"))
        .join(stats.filter("term is not null"), "term")
        .withColumn("idf", rarity)
    )
    if terms_per_query is not None:
        telling = Window.partitionBy("query").orderBy(F.desc(F.round(F.col("times") * F.col("idf"), 9)), "term")
        chosen = chosen.withColumn("place", F.row_number().over(telling)).filter(F.col("place") <= terms_per_query)
    chosen = written(
        chosen.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("terms")), "queries"
    )
    size = chosen.agg(F.count("*").alias("queries"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    if not size["queries"]:
        return spark.createDataFrame([], schema)
    blocks = max(1, -(-size["queries"] // block_queries), -(-size["terms"] // BLOCK_TERMS))
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col)
    draw = F.pmod(F.xxhash64(id_col), F.lit(FIRST))
    some = texts.filter(draw == 0).repartition(max(1, min(8, n // (4 * STRETCH)), n // (2 * FIRST * STRETCH)))
    others = texts.filter(draw != 0)

    def merged(rows, *by):
        return rows.groupBy(*by).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits")
        )

    found = None
    for i in range(blocks):
        block = chosen.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        words = block.select(F.explode("terms").alias("t")).select("t.*").distinct().toArrow().sort_by("term")
        vocabulary, weights = (c.to_numpy() for c in words.columns)
        lists = block.select("query", F.col("terms.term").alias("terms")).toArrow().sort_by("query").combine_chunks()
        names, lists = lists.column(0).to_numpy(), lists.column(1)
        if not len(names):
            continue
        starts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64)))
        place = np.searchsorted(vocabulary, pc.list_flatten(lists).to_numpy()).astype(np.int32)
        order, centres = arranged(place, starts, len(vocabulary))
        place = place[ranges(starts[order], starts[order + 1])]
        starts = np.append(0, np.cumsum(np.diff(starts)[order]))

        def searched(some, seeds):
            return some.mapInArrow(
                search_shards(names[order], place, starts, vocabulary, weights, mean, k, shard_bytes, seeds[order], centres),
                "query long, hits array<struct<score: double, doc: long>>",
            )

        # the k best of a few documents are what all others have to reach
        seeds = np.zeros((len(names), k))
        ahead = written(merged(searched(some, seeds), "query"), "seeds")
        known = ahead.select("query", F.posexplode("hits.score")).toArrow()
        seeds[np.searchsorted(names, known.column(0).to_numpy()), known.column(1).to_numpy()] = -known.column(2).to_numpy()
        part = ahead.unionByName(searched(others, seeds))
        found = part if found is None else found.unionByName(part)

    near = merged(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))), "query", "part")
    hits = merged(near, "query").select("query", F.posexplode("hits").alias("at", "hit"))
    return hits.select(
        F.col("query").alias("query_id"), (F.col("at") + 1).alias("rank"),
        F.col("hit.doc").alias("doc_id"), (-F.col("hit.score")).alias("score"),
    )
