"""Retrieval for a table of queries: exact nearest neighbours, lexical overlap, reranking, context."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalise, query_tokens
from ..sources.scratch import written
from .embed import PLAIN, dense_vectors, matrix, plain, sliced

#: Weights and thresholds. Fixed values.
SIMILARITY, LEXICAL, LEXICAL_ONLY = 0.75, 0.20, 0.90
ENTITY_BOOST, TYPE_BOOST, KEYWORD_BOOST = 0.10, 0.12, 0.05
ENOUGH_VECTOR, ENOUGH_LEXICAL = 0.35, 0.10
FETCHED, FINAL = 30, 6
METRIC_KEYWORDS = ("expense ratio", "exit load", "nav", "sip", "aum", "lock-in", "lock in", "holding", "holdings", "sector", "allocation", "portfolio", "top holdings")


def top_k(pairs: DataFrame, by: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First k rows of each ``by`` in an order, with their rank; Spark prunes to k a task before the shuffle."""
    return pairs.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


#: So many queries at most are broadcast, with so many values or characters in all; more are dealt out with the corpus.
BROADCAST_QUERIES, BROADCAST_VALUES = 4096, 1 << 22
#: So many rows of slim candidates (ids and numbers) at most are broadcast.
BROADCAST_ROWS = 200_000
#: Rows of the blocks that are multiplied, and of a group of queries or corpus that a cell holds, with so many values or characters.
QUERY_BLOCK, CORPUS_BLOCK = 256, 4096
GROUP_ROWS, GROUP_VALUES = 1 << 15, 1 << 21


def held_values(rows: DataFrame, column: str) -> tuple[int, int]:
    """Number of rows, and of the numbers or characters in a column of vectors, tokens or texts."""
    kind = dict(rows.dtypes)[column]
    values = F.length(column) if kind == "string" else F.length(F.array_join(column, " ")) if "string" in kind else F.size(column)
    return tuple(rows.agg(F.count("*"), F.coalesce(F.sum(values), F.lit(0))).first())


def celled(queries: DataFrame, corpus: DataFrame, pair: Callable[[pa.Table, pa.Table], pa.Table], kinds: str, most: tuple[int, int] = (GROUP_ROWS, GROUP_ROWS)) -> DataFrame:
    """``pair`` of every group of queries (q0, q1) and every group of the corpus (d0, d1), both dealt out by a hash of the key.

    A cell is the pair of two groups and is one group of a cogroup. Groups are bounded in rows and values, so a task's
    memory does not grow with the tables; each row is sent once for every group of the other side."""

    def groups(rows: DataFrame, column: str, size: int) -> int:
        n, values = held_values(rows, column)
        spread = min(-(-n // CORPUS_BLOCK), math.isqrt(3 * rows.sparkSession.sparkContext.defaultParallelism) + 1)
        return max(1, -(-n // size), -(-values // GROUP_VALUES), spread)

    of = {"q": groups(queries, "q1", most[0]), "d": groups(corpus, "d1", most[1])}
    number = lambda side: F.pmod(F.xxhash64(f"{side}0"), F.lit(of[side])).alias(f"{side}_group")
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of[side] - 1).cast("long"))).alias(f"{side}_group")
    q = queries.select("q0", "q1", number("q"), every("d")).groupBy("q_group", "d_group")
    return q.cogroup(corpus.select("d0", "d1", every("q"), number("d")).groupBy("q_group", "d_group")).applyInArrow(pair, kinds)


def first_of(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least finite values of each row, by id among equals: a partition finds the k-th value, and only
    what is not above it is sorted."""
    if distance.shape[1] > k:
        bound = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
        x, y = np.nonzero((distance <= bound) & np.isfinite(distance))
    else:
        x, y = np.nonzero(np.isfinite(distance))
    order = np.lexsort((ids[y], distance[x, y], x))
    x, y = x[order], y[order]
    place = np.arange(len(x)) - np.searchsorted(x, x, "left")
    return x[place < k], y[place < k]


def _unit(values: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix of rows of unit length."""
    if not len(values):
        return np.zeros((0, 0))
    return _scaled(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(values), -1))


def _scaled(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=1)
    return v / np.where(length == 0, 1, length)[:, None]


class Nearest:
    """The k nearest rows of each query among those that were added, by id among equals.

    Distances are compared as they are given, in six digits. Once a query has k rows, only products that may reach the k-th
    are looked at, so most of a block costs its product and one comparison."""

    def __init__(self, q: np.ndarray, k: int, overlapping: bool):
        self.q, self.k, self.overlapping = q, k, overlapping
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(q), QUERY_BLOCK)]
        self.last, self.last_id = np.full(len(q), np.inf), np.full(len(q), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, d: np.ndarray) -> None:
        for n, start in enumerate(range(0, len(self.q), QUERY_BLOCK)):
            block = slice(start, start + QUERY_BLOCK)
            last, last_id = self.last[block], self.last_id[block]
            similarity = self.q[block] @ d.T
            least = 1 - last - 1.5e-6  # one unit of the sixth digit, and more
            at = np.flatnonzero(similarity >= (np.maximum(least, 0) if self.overlapping else least)[:, None])
            if len(at) <= 8 * self.k * len(last):
                x, y = np.divmod(at, similarity.shape[1])
                product = similarity[x, y]
                distance = np.round(1 - product, 6) + 0.0  # no negative zero
                good = (distance < last[x]) | ((distance == last[x]) & (ids[y] < last_id[x]))
                if self.overlapping:
                    good &= product > 0
                x, y, distance = x[good], y[good], distance[good]
            else:  # the first rows, or many at one distance
                whole = np.round(1 - similarity, 6) + 0.0
                good = (whole < last[:, None]) | ((whole == last[:, None]) & (ids < last_id[:, None]))
                if self.overlapping:
                    good &= similarity > 0
                whole[~good] = np.inf
                x, y = first_of(whole, ids, self.k)
                distance = whole[x, y]
            if len(x):
                self._keep(n, block, x, ids[y], distance)

    def _keep(self, n: int, block: slice, *new: np.ndarray) -> None:
        x, ids, distance = (np.concatenate(p) for p in zip(self.held[n], new, strict=True))
        order = np.lexsort((ids, distance, x))
        x, ids, distance = x[order], ids[order], distance[order]
        place = np.arange(len(x)) - np.searchsorted(x, x, "left")
        full, keep = place == self.k - 1, place < self.k
        self.last[block][x[full]], self.last_id[block][x[full]] = distance[full], ids[full]
        self.held[n] = x[keep], ids[keep], distance[keep]

    def rows(self, query_ids: np.ndarray) -> list[pa.Array]:
        """Columns query_id, doc_id and distance."""
        parts = [(query_ids[i * QUERY_BLOCK + x], ids, distance) for i, (x, ids, distance) in enumerate(self.held)] or [(query_ids[:0], query_ids[:0], np.zeros(0))]
        return [pa.array(np.concatenate(p)) for p in zip(*parts, strict=True)]


NEAR = ["query_id", "doc_id", "distance"]
_NEAR = "query_id long, doc_id long, distance double"


def _searched_blocks(found: Nearest, query_ids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> list[pa.Array]:
    """Rows of the nearest in batches of d0 and d1, which holds vectors, or texts that get theirs here."""
    for batch in batches:
        at, texts = 0, pa.types.is_string(batch.column("d1").type) or pa.types.is_large_string(batch.column("d1").type)
        for part in sliced(batch.column("d1")) if texts else (batch.column("d1").slice(i, CORPUS_BLOCK) for i in range(0, batch.num_rows, CORPUS_BLOCK)):
            found.add(batch.column("d0").slice(at, len(part)).to_numpy(), _scaled(matrix(part)) if texts else _unit(part))
            at += len(part)
    return found.rows(query_ids)


def _nearest(q: DataFrame, d: DataFrame, k: int, overlapping: bool) -> DataFrame:
    """``nearest_dense`` of few queries (q0, q1), which are broadcast: each task yields at most k rows a query."""
    some = q.toArrow()
    sent = q.sparkSession.sparkContext.broadcast((some.column("q0").to_numpy(), _unit(some.column("q1").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = sent.value
        yield pa.RecordBatch.from_arrays(_searched_blocks(Nearest(vectors, k, overlapping), query_ids, batches), NEAR)

    return top_k(d.mapInArrow(run, _NEAR), "query_id", k, F.col("distance"), F.col("doc_id"))


def few(q: DataFrame) -> bool:
    """Whether queries (q0, q1) are broadcast."""
    n, values = held_values(q, "q1")
    return n <= BROADCAST_QUERIES and values <= BROADCAST_VALUES


def _keyed(rows: DataFrame, key: str, held: str, side: str) -> DataFrame:
    return rows.where(F.col(held).isNotNull()).select(F.col(key).cast("long").alias(f"{side}0"), F.col(held).alias(f"{side}1"))


def nearest_dense(queries: DataFrame, corpus: DataFrame, k: int = 10, overlapping: bool = False) -> DataFrame:
    """Exact nearest neighbours of dense vectors of one length: (query_id, embedding) against (doc_id, embedding), as
    (query_id, doc_id, distance, rank); ``overlapping`` leaves out pairs whose product is not positive.

    Up to ``BROADCAST_QUERIES`` queries of ``BROADCAST_VALUES`` numbers are broadcast; more meet the corpus in cells. Each
    task or cell yields at most k rows a query, and the rest is a top-k. Null vectors are left out."""
    q, d = _keyed(queries, "query_id", "embedding", "q"), _keyed(corpus, "doc_id", "embedding", "d")
    if few(q):
        return _nearest(q, d, k, overlapping)

    def cell(q: pa.Table, d: pa.Table) -> pa.Table:
        found = Nearest(_unit(q.column("q1").combine_chunks()), k, overlapping)
        return pa.Table.from_arrays(_searched_blocks(found, q.column("q0").to_numpy(), d.combine_chunks().to_batches()), NEAR)

    return top_k(celled(q, d, cell, _NEAR), "query_id", k, F.col("distance"), F.col("doc_id"))


def nearest_texts(queries: DataFrame, corpus: DataFrame, k: int = 10, overlapping: bool = False) -> DataFrame:
    """``nearest_dense`` of the hashed vectors of (query_id, text) and (doc_id, text). Where the queries are broadcast, the
    corpus' vectors are made in the task that multiplies them, slice by slice, and stand in no row."""
    asked = dense_vectors(queries, "query_id", "text")
    q = _keyed(asked, "query_id", "embedding", "q")
    if few(q):
        return _nearest(q, _keyed(corpus, "doc_id", "text", "d"), k, overlapping)
    return nearest_dense(asked, dense_vectors(corpus, "doc_id", "text"), k, overlapping)


PIVOTS = 256
BANDS = 16
#: (block, ids, vectors: rows of unit length one after the other, pivot: its number, low and high: angles of the rows to the
#: pivot, most and least: largest and smallest value in each dimension)
INDEX = "block long, ids array<long>, vectors array<double>, pivot int, low double, high double, most array<double>, least array<double>"
SLACK = 1e-7  # of angles and products, whose last digits depend on the order of sums


def _angle(product: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(product, -1, 1))


def pivots_of(corpus: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """Unit vectors of the n rows of least key hash: a bounded sample, the same at each run."""
    some = corpus.where("embedding is not null").select(F.col("embedding").cast("array<double>").alias("v"), F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(n).select("v").toArrow()
    return np.concatenate([_unit(b.column("v")) for b in some.to_batches()]) if some.num_rows else np.zeros((0, 0))


def vector_index(corpus: DataFrame, pivots: np.ndarray, size: int = 1024) -> DataFrame:
    """INDEX of (doc_id, embedding): every vector stands in one block. A block's rows are nearest to one pivot, lie in one band of
    angles to it, and are about ``size`` at most: the rows of a full band are dealt to several blocks by a hash of the key.

    Write it with the collection; searches then read blocks that are in order, whole or not at all."""
    spark = corpus.sparkSession
    sent = spark.sparkContext.broadcast(pivots)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(batch.column("v"))
            products = v @ sent.value.T
            pivot = products.argmax(axis=1)
            angle = _angle(products[np.arange(len(v)), pivot])
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), vectors, pa.array(pivot, pa.int32()), pa.array(np.minimum(angle / np.pi * 2 * BANDS, 2 * BANDS - 1).astype(np.int32)), pa.array(angle)], ["id", "v", "pivot", "band", "angle"])

    rows = corpus.where("embedding is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    placed = rows.mapInArrow(assigned, "id long, v array<double>, pivot int, band int, angle double")
    sizes = placed.groupBy("pivot", "band").count()  # at most pivots times bands rows
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / size))
    dealt_out = placed.join(F.broadcast(sizes), ["pivot", "band"]).select("id", "v", "pivot", "angle", F.xxhash64("pivot", "band", part).alias("block"))
    held = dealt_out.groupBy("block").agg(F.collect_list(F.struct("id", "v", "angle")).alias("r"), F.first("pivot").alias("pivot"))
    flat = held.select("block", F.col("r.id").alias("ids"), F.flatten("r.v").alias("vectors"), "pivot", F.array_min("r.angle").alias("low"), F.array_max("r.angle").alias("high"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most, least = [], []
            for i in range(batch.num_rows):
                v = batch.column("vectors")[i].values.to_numpy().reshape(len(batch.column("ids")[i].values), -1)
                most.append(v.max(axis=0))
                least.append(v.min(axis=0))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(most, kind), pa.array(least, kind)], [*batch.schema.names, "most", "least"])

    return flat.mapInArrow(bounded, INDEX)


def nearest_indexed(queries: DataFrame, index: DataFrame, pivots: np.ndarray, k: int = 10, overlapping: bool = False, seen: tuple | None = None) -> DataFrame:
    """The rows of ``nearest_dense``, from an index: a query skips the blocks that cannot hold one of its k nearest.

    A block's best product with a query is bounded twice: by the angles of query and rows to the block's pivot, and by the
    largest and smallest values in each dimension. The k-th product so far starts with that among the pivots, which are rows
    themselves, and rises in each task. Queries go to the tasks in groups of up to BROADCAST_QUERIES with BROADCAST_VALUES
    numbers; each group reads the index once. ``seen``: two accumulators, for pairs of query and block, and for skipped ones."""
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    n, size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    groups = max(1, -(-n // max(1, min(BROADCAST_QUERIES, BROADCAST_VALUES // max(size, 1)))))
    found = None
    for g in range(groups):
        some = (asked if groups == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g)).toArrow().combine_chunks()
        one = _searched(some, index, pivots, k, overlapping, seen)
        found = one if found is None else found.union(one)
    return top_k(found, "query_id", k, F.col("distance"), F.col("doc_id"))


def _searched(some: pa.Table, index: DataFrame, pivots: np.ndarray, k: int, overlapping: bool, seen: tuple | None) -> DataFrame:
    ids = some.column("id").to_numpy()
    q = np.concatenate([_unit(b.column("v")) for b in some.to_batches()]) if some.num_rows else np.zeros((0, pivots.shape[1]))
    products = q @ pivots.T if len(pivots) else np.zeros((len(q), 0))
    # Distances are compared as they are given, in six digits, so the k-th product is lowered by one unit of them.
    kth = np.partition(products, -k, axis=1)[:, -k] - 1.5e-6 if products.shape[1] >= k else np.full(len(q), -np.inf)
    sent = index.sparkSession.sparkContext.broadcast((ids, q, _angle(products), kth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q, angles, kth = sent.value
        least_product, held = kth.copy(), None
        for batch in batches:
            for i in range(batch.num_rows):
                low, high = batch.column("low")[i].as_py() - SLACK, batch.column("high")[i].as_py() + SLACK
                to_pivot = angles[:, batch.column("pivot")[i].as_py()]
                most, least = (batch.column(c)[i].values.to_numpy() for c in ("most", "least"))
                by_angle = np.cos(np.clip(np.maximum(to_pivot - high, low - to_pivot), 0, np.pi))
                by_value = np.maximum(q, 0) @ most + np.minimum(q, 0) @ least
                live = np.flatnonzero(np.minimum(by_angle, by_value) + SLACK >= (np.maximum(least_product, 0) if overlapping else least_product))
                if seen:
                    seen[0].add(len(q))
                    seen[1].add(len(q) - len(live))
                if not len(live):
                    continue
                b = batch.column("ids")[i].values.to_numpy()
                similarity = q[live] @ batch.column("vectors")[i].values.to_numpy().reshape(len(b), -1).T
                distance = np.round(1 - similarity, 6) + 0.0  # no negative zero
                if overlapping:
                    distance[similarity <= 0] = np.inf
                x, y = first_of(distance, b, k)
                new = (live[x], b[y], distance[x, y])
                held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new, strict=True))
                if len(held[0]) > 4 * k * max(1, len(q)) or len(live) * 4 > len(q):
                    held, least_product = _kept(held, least_product, k)
        held = held or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held, _ = _kept(held, least_product, k)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "doc_id", "distance"])

    return index.select("ids", "vectors", "pivot", "low", "high", "most", "least").mapInArrow(run, "query_id long, doc_id long, distance double")


def _kept(held: tuple, least_product: np.ndarray, k: int) -> tuple[tuple, np.ndarray]:
    """The k nearest of each query so far, and the products that a better one must reach."""
    x, ids, distance = held
    order = np.lexsort((ids, distance, x))
    x, ids, distance = x[order], ids[order], distance[order]
    place = np.arange(len(x)) - np.searchsorted(x, x, "left")
    last = place == k - 1
    out = least_product.copy()
    out[x[last]] = np.maximum(out[x[last]], 1 - distance[last] - 1.5e-6)
    keep = place < k
    return (x[keep], ids[keep], distance[keep]), out


def fetched(candidates: DataFrame, corpus: DataFrame, most_rows: int) -> DataFrame:
    """Slim candidates with their rows of the corpus, by doc_id. ``most_rows`` is a bound on the candidates: within
    ``BROADCAST_ROWS`` they are broadcast and the corpus stays where it is."""
    return corpus.join(F.broadcast(candidates) if most_rows <= BROADCAST_ROWS else candidates, "doc_id")


#: Bytes as ``functions.text.query_tokens`` sees them.
_KEPT = PLAIN.copy()
_KEPT[list(b"%.-")] = list(b"%.-")
#: So many pairs of query and document, and of their common tokens, are counted at once.
COUNTED, COMMON = 1 << 18, 1 << 20


class Postings:
    """For each token of the queries the queries that hold it."""

    def __init__(self, query_ids: np.ndarray, tokens: pa.ListArray):
        flat = tokens.flatten()
        self.ids, self.sizes = query_ids, tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = pc.unique(flat)
        code = pc.index_in(flat, self.words).to_numpy(zero_copy_only=False)
        self.of = np.repeat(np.arange(len(tokens)), self.sizes)[np.argsort(code, kind="stable")]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(self.words))))).astype(np.int64)

    def shared(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """First row, and how many tokens each query and some rows from there share: (rows, queries)."""
        tokens = pc.ascii_split_whitespace(plain(texts, _KEPT))
        code = pc.index_in(tokens.flatten(), self.words)
        known = np.asarray(code.is_valid())
        row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))[known]
        width = max(1, len(self.words))
        row, code = np.divmod(np.unique(row * width + code.drop_null().to_numpy().astype(np.int64)), width)
        rows = max(1, COUNTED // len(self.ids))
        for i in range(0, len(tokens), rows):
            held = slice(*np.searchsorted(row, (i, i + rows)))
            yield i, self._counts(row[held] - i, code[held], min(rows, len(tokens) - i))

    def _counts(self, row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
        n = len(self.ids)
        total = np.zeros(rows * n, np.int64)
        often = self.start[code + 1] - self.start[code]
        ends = np.cumsum(often)
        at = 0
        while at < len(code):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMMON, "right")))
            much = often[at:to]
            inner = np.arange(much.sum()) - np.repeat(np.cumsum(much) - much, much)
            total += np.bincount(np.repeat(row[at:to] * n, much) + self.of[np.repeat(self.start[code[at:to]], much) + inner], minlength=rows * n)
            at = to
        return total.reshape(rows, n)


def lexical_overlap(queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, overlap): share of the query's distinct tokens that the document holds, over 0; all pairs, or the k
    largest of each query, by doc_id among equals.

    Queries are broadcast or meet the documents in cells, as dense vectors do, as postings of their tokens; documents are read
    in slices, so no frequent token is a join key and a task holds the counts of some rows only."""
    q = queries.where("text is not null").select(F.col("query_id").cast("long").alias("q0"), F.array_distinct(query_tokens(F.col("text"))).alias("q1"))
    q = q.where(F.size("q1") > 0)
    d = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("d0"), F.col("text").alias("d1"))
    names = ["query_id", "doc_id", "shared", "n"]

    def searched(postings: Postings, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in sliced(batch.column("d1")):
                for first, shared in postings.shared(texts) if len(postings.ids) else ():
                    b = batch.column("d0").slice(at + first, len(shared)).to_numpy()
                    if k is None:
                        y, x = np.nonzero(shared)
                    else:
                        x, y = first_of(np.where(shared > 0, -shared.astype(float), np.inf).T, b, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (postings.ids[x], b[y], shared[y, x], postings.sizes[x])], names)
                at += len(texts)

    kinds = "query_id long, doc_id long, shared long, n long"
    kind = pa.schema([(c, pa.int64()) for c in names])

    def cell(q: pa.Table, d: pa.Table) -> pa.Table:
        return pa.Table.from_batches(searched(Postings(q.column("q0").to_numpy(), q.column("q1").combine_chunks()), d.to_batches()), kind)

    if few(q):
        some = q.toArrow()
        sent = q.sparkSession.sparkContext.broadcast((some.column("q0").to_numpy(), some.column("q1").combine_chunks()))
        pairs = d.mapInArrow(lambda batches: searched(Postings(*sent.value), batches), kinds)
    else:
        pairs = celled(q, d, cell, kinds, (1024, 2048))
    found = pairs.select("query_id", "doc_id", F.round(F.col("shared") / F.col("n"), 6).alias("overlap"))
    return found if k is None else top_k(found, "query_id", k, F.desc("overlap"), F.col("doc_id")).drop("rank")


def token_index(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens): the distinct query tokens of each document of (doc_id, text). Write it with the collection."""
    return docs.where("text is not null").select("doc_id", F.array_distinct(query_tokens(F.col("text"))).alias("tokens"))


def _shared(pairs: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, doc_id, shared, n) of pairs, written: how many tokens of the query the document holds."""
    pairs = written(pairs, "lexical-pairs")
    held = fetched(pairs, index, pairs.count()).join(asked, "query_id")
    return written(held.select("query_id", "doc_id", F.size(F.array_intersect("asked", "tokens")).alias("shared"), F.size("asked").alias("n")), "lexical-shared")


def lexical_top(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The rows of ``lexical_overlap`` with a k, from a ``token_index`` that is a written table.

    Postings are kept for the tokens that are asked. A query reads those of its rarest tokens until they list k rows, counts
    what these documents share with it, and takes the k-th count s. A document that shares s of the query's m known tokens
    holds one of its m - s + 1 rarest, so the postings of these are read as well and no others: what is frequent is left out
    by the counts, and the result is exact."""
    asked = queries.where("text is not null").select("query_id", F.array_distinct(query_tokens(F.col("text"))).alias("asked"))
    wanted = asked.select("query_id", F.explode("asked").alias("token"))
    postings = written(index.select("doc_id", F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi"), "postings")
    often = postings.groupBy("token").agg(F.count("*").alias("often"))
    known = wanted.join(often, "token").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("known"))  # as long as a query
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(0).alias("p"))
    first = F.aggregate("known", start, lambda a, x: F.when(a["rows"] >= k, a).otherwise(F.struct((a["rows"] + x["often"]).alias("rows"), (a["p"] + 1).alias("p"))), lambda a: a["p"])
    known = written(known.withColumn("first", first), "known-tokens")
    listed = lambda table, tokens: table.select("query_id", F.explode(tokens).alias("x")).select("query_id", "x.token").join(postings, "token").select("query_id", "doc_id").distinct()
    some = _shared(listed(known, F.slice("known", F.lit(1), F.col("first"))), index, asked)
    kth = top_k(some, "query_id", k, F.desc("shared"), F.col("doc_id")).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("shared")).otherwise(F.lit(1)).alias("kth"))
    more = known.join(kth, "query_id").withColumn("upto", F.size("known") - F.col("kth") + 1).where("upto > first")
    rest = listed(more, F.slice("known", F.col("first") + 1, F.col("upto") - F.col("first"))).join(some.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = some.union(_shared(rest, index, asked))
    found = both.select("query_id", "doc_id", F.round(F.col("shared") / F.col("n"), 6).alias("overlap"))
    return top_k(found, "query_id", k, F.desc("overlap"), F.col("doc_id")).drop("rank")


def keep_matching(candidates: DataFrame, by: str, match: Column) -> DataFrame:
    """Rows that match, for queries with any match; all rows of the others."""
    flagged = candidates.withColumn("_match", F.coalesce(match, F.lit(False)))
    return flagged.withColumn("_any", F.max("_match").over(W.partitionBy(by))).where(F.col("_match") | ~F.col("_any")).drop("_match", "_any")


def boost(same_entity: Column, same_type: Column, preferred: Column, query: Column, document: Column, keywords: tuple[str, ...] = METRIC_KEYWORDS) -> Column:
    """Entity, type and, for metric questions, one shared keyword."""
    shared = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(normalise(query), k) & F.contains(F.lower(document), k))
    part = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    return part(same_entity, ENTITY_BOOST) + part(same_type, TYPE_BOOST) + part((preferred == "metric") & shared, KEYWORD_BOOST)


def hybrid_score(distance: Column, overlap: Column, boosted: Column) -> Column:
    """0.75 similarity + 0.20 overlap + boost; without a distance 0.90 overlap + boost. Six decimals, halves up."""
    lexical = F.coalesce(overlap, F.lit(0.0))
    score = F.when(distance.isNull(), lexical * LEXICAL_ONLY + boosted).otherwise(F.greatest(F.lit(0.0), 1 - distance) * SIMILARITY + lexical * LEXICAL + boosted)
    return F.round(score + 1e-9, 6)


def sufficient(best: Column, by_vector: Column) -> Column:
    return F.when(by_vector, best >= ENOUGH_VECTOR).otherwise(best >= ENOUGH_LEXICAL)


def context(rank: Column, document: Column, k: int = FINAL) -> Column:
    """Aggregate: ``- document`` lines of a query's first k non-empty documents. For rows that a top-k has bounded."""
    held = F.collect_list(F.when(F.length(F.trim(document)) > 0, F.struct(rank.alias("rank"), document.alias("document"))))
    return F.array_join(F.transform(F.slice(F.array_sort(held), 1, k), lambda r: F.concat(F.lit("- "), r["document"])), "\n")


def prompt(question: Column, block: Column) -> Column:
    return F.concat(F.lit("Context:\n"), F.coalesce(block, F.lit("")), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer in at most three sentences."))


def source_url(top: Column, any_of_query: Column, of_entity: Column, default: str) -> Column:
    return F.coalesce(F.nullif(top, F.lit("")), F.nullif(any_of_query, F.lit("")), of_entity, F.lit(default))
