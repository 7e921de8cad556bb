"""Alignment of two tokenizers over a corpus: which tokens of A stand where tokens of B stand, and how common each pair is.

A text (with a blank put before it, as B does by itself) is encoded by both. The byte offsets where an A token and a B
token both end cut it into groups; every A token of a group is linked with every B token of it. A pair's count is the
number of documents that hold it linked.

Method: minimal perfect hashing of the distinct pairs.

0. ``encoded``: documents are encoded once; their token ids, two bytes a token, are a written table that the passes read.
1. ``partial_counts``: tasks align their documents and count, for each pair, the documents that hold it.
2. ``perfect_hash``: the distinct pairs, in buckets, get a minimal perfect hash: on each level a pair takes the bit that
   its hash names if no other pair wants it, the others go to the next level; a pair's number is the number of set bits
   before its own.
3. ``pair_counts``: tasks add their counts to dense vectors indexed by this number, and the vectors are summed in a tree
   of FAN_IN slices at a time. Keys stand beside the counts, so a looked-up pair is verified.
4. ``aligned_documents``: a second pass aligns the documents again and looks the counts up.

The hash and the vectors of at most BLOCK_PAIRS pairs are sent to tasks. More pairs are dealt to blocks by hash, each with
a hash, vectors and second pass of its own; a document's figures are sums over the blocks.

Defined cases: a null or empty text, or one whose joined token bytes differ from blank + text in either tokenizer, has no
tokens: zeros and an empty groups string; control strings in texts are plain text; repeated rows are documents of their own
and count as such; an empty table gives an empty table; other columns are not read. Very long texts are aligned whole, the
links of a group by its distinct tokens, so a group of m and k tokens takes its distinct pairs and not m * k.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .pieces import DEFAULT_MODEL
from .scratch import written
from .tokencounts import DEFAULT_RANKS, encoding

BLOCK_PAIRS = 4 << 20
BUCKET_PAIRS = 1 << 15
SLICE = 1 << 16
FAN_IN = 16
#: Links that are listed at once.
LINKS = 1 << 21


@dataclass
class Sides:
    a: object
    a_lengths: np.ndarray
    b: object
    b_bytes: list[bytes]
    b_lengths: np.ndarray


@functools.cache
def sides(ranks_path: str, model_path: str) -> Sides:
    import sentencepiece

    a, a_lengths = encoding(ranks_path)
    b = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    if len(a_lengths) * len(pieces) >= 1 << 32:
        raise ValueError("pairs of tokens have to fit in 32 bits")
    return Sides(a, a_lengths, b, pieces, np.array([len(p) for p in pieces], np.int64))


def width(vocabulary: int) -> np.dtype:
    """The type of stored token ids."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def encoded(rows: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """(row, key, a, b) of (key, text), as a written table: a number of the row, and the ids of both tokenizers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(ranks_path, model_path)
        kinds = width(len(both.a_lengths)), width(len(both.b_bytes))
        for batch in batches:
            for part in ta.chunks(batch, "text"):
                found: tuple[list[bytes], list[bytes]] = ([], [])
                for text in part.column("text").to_pylist():
                    a = b = ()
                    if text:
                        expected = b" " + text.encode()
                        a, b = both.a.encode_ordinary(" " + text), both.b.encode(text, num_threads=1)
                        if both.a.decode_bytes(a) != expected or b"".join(map(both.b_bytes.__getitem__, b)) != expected:
                            a = b = ()
                    for ids, kind, side in zip((a, b), kinds, found, strict=True):
                        side.append(np.array(ids, kind).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(x, pa.binary()) for x in found)], ["key", "a", "b"])

    tokens = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, a binary, b binary")
    return written(tokens.select(F.monotonically_increasing_id().alias("row"), "key", "a", "b"), "tokens", "zstd")


@dataclass
class Aligned:
    """Documents of one chunk: token ids one document after the other, the group of each token (rising), the document of each group."""

    part: pa.RecordBatch
    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    document: np.ndarray
    b_vocabulary: int

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair (a * vocabulary of B + b) and number of links, once for each pair of a document, in this order."""
        n = len(self.document)
        na, nb = np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)
        a_open, b_open = np.cumsum(na) - na, np.cumsum(nb) - nb
        keys, counts = [], []
        large = na * nb > LINKS
        for g in np.flatnonzero(large):
            x, nx = np.unique(self.a[a_open[g] : a_open[g] + na[g]], return_counts=True)
            y, ny = np.unique(self.b[b_open[g] : b_open[g] + nb[g]], return_counts=True)
            keys.append((self.document[g] << 32) + (x[:, None] * self.b_vocabulary + y).ravel())
            counts.append((nx[:, None] * ny).ravel())
        tokens = np.flatnonzero(~large[self.a_group])
        each = nb[self.a_group[tokens]]
        upto = np.cumsum(each)
        i = 0
        while i < len(tokens):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] - each[i] + LINKS, "right")))
            group, many = self.a_group[tokens[i:j]], each[i:j]
            first = np.repeat(b_open[group] - (np.cumsum(many) - many), many)
            key = np.repeat((self.document[group] << 32) + self.a[tokens[i:j]] * self.b_vocabulary, many) + self.b[first + np.arange(len(first))]
            key.sort()
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            keys.append(key[new])
            counts.append(np.diff(np.append(new, len(key))))
            i = j
        key, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, counts))
        if len(keys) > 1:  # a document's pairs may stand in several of the lists
            key, of = np.unique(key, return_inverse=True)
            count = np.bincount(of, weights=count).astype(np.int64)
        return key >> 32, key & 0xFFFFFFFF, count

    def groups_sha256(self) -> list[str]:
        """Digest of ``a1,a2|b1;a3|b2,b3`` for each document; empty without tokens."""
        n = len(self.document)
        na, nb = np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (self.a_group, self.b_group))
        said, size = np.empty(len(self.a) + len(self.b), np.uint64), np.empty(len(self.a) + len(self.b), np.int64)
        for ids, last, close, place in ((self.a, last_a, "|", (np.cumsum(nb) - nb)[self.a_group]), (self.b, last_b, ";", np.cumsum(na)[self.b_group])):
            at = np.arange(len(ids)) + place
            said[at], size[at] = decimals(ids, np.where(last, ord(close), ord(",")))
        text = said.view(np.uint8)
        text = text[text != 0].data
        end = np.cumsum(size)
        tokens = np.cumsum(np.bincount(self.document, weights=na + nb, minlength=self.part.num_rows).astype(np.int64))
        out, at, done = [], 0, 0
        for t in tokens.tolist():
            if t == done:
                out.append("")
                continue
            stop = int(end[t - 1])
            out.append(hashlib.sha256(text[at : stop - 1]).hexdigest())  # without the last semicolon
            at, done = stop, t
        return out


@functools.cache
def _decimal_table(n: int) -> np.ndarray:
    """Decimal digits of 0 to n - 1 as the first bytes of a little-endian number, and where the byte behind them is."""
    ids = np.arange(n, dtype=np.uint64)
    size = np.ones(n, np.uint64)
    out = np.zeros(n, np.uint64)
    for d in range(1, 7):
        size += ids >= 10**d
    for d in range(7):
        inside = size > d
        digit = ids // 10 ** np.where(inside, size - 1 - d, 0).astype(np.uint64) % 10 + 48
        out |= np.where(inside, digit << np.uint64(8 * d), 0)
    return np.stack([out, size * np.uint64(8)], axis=1)


def decimals(ids: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal with a closing character, in the bytes of one number, zeros behind; and how many bytes. Ids have at most 7 digits."""
    table = _decimal_table(1 << max(1, int(ids.max(initial=0))).bit_length())
    return table[ids, 0] | closing.astype(np.uint64) << table[ids, 1], (table[ids, 1] >> np.uint64(3)).astype(np.int64) + 1


def aligned(batches: Iterator[pa.RecordBatch], both: Sides) -> Iterator[Aligned]:
    """Aligns the documents (columns a and b) of the batches chunk by chunk."""
    a_kind, b_kind = width(len(both.a_lengths)), width(len(both.b_bytes))
    for batch in batches:
        for part in ta.chunks(batch, "a"):
            a_buffer, a_offsets = ta.buffers(part.column("a"))
            a, b = a_buffer.view(a_kind).astype(np.int64), ta.buffers(part.column("b"))[0].view(b_kind).astype(np.int64)
            a_ends, b_ends = np.cumsum(both.a_lengths[a]), np.cumsum(both.b_lengths[b])
            shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
            closes = np.concatenate(([0], a_ends))[a_offsets[1:] // a_kind.itemsize]  # bytes up to each document's end
            yield Aligned(part, a, b, np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends), np.searchsorted(closes, shared, "left"), len(both.b_bytes))


COUNTED = "pair long, docs long"


def partial_counts(tokens: DataFrame, ranks_path: str, model_path: str, at_most: int = 1 << 21) -> DataFrame:
    """(pair, docs) of the encoded documents: each task adds up the documents that hold a pair, and lets go of the sums when they are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(ranks_path, model_path)
        keys, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            new, counts = np.unique(np.concatenate(waiting), return_counts=True)
            all_keys, of = np.unique(np.concatenate((keys, new)), return_inverse=True)
            return all_keys, np.bincount(of, weights=np.concatenate((docs, counts))).astype(np.int64)

        for chunk in aligned(batches, both):
            waiting.append(chunk.pairs()[1])
            size += len(waiting[-1])
            if size > at_most:
                (keys, docs), waiting, size = added(), [], 0
                if len(keys) > at_most:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs)], ["pair", "docs"])
                    keys = docs = np.zeros(0, np.int64)
        if waiting:
            keys, docs = added()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs)], ["pair", "docs"])

    return tokens.select("a", "b").mapInArrow(run, COUNTED)


def hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    return ta.mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + 1) % 2**64))


@dataclass
class PerfectHash:
    """Numbers 0 to n - 1 for n keys; a key that is not among them gets any number or -1."""

    opens: np.ndarray  # by bucket and level: the first bit; no bits behind a bucket's last level
    sizes: np.ndarray
    bits: np.ndarray  # 64 a word
    before: np.ndarray  # set bits before each word

    @property
    def n(self) -> int:
        return int(self.before[-1])

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        bucket = (hashed(keys, 0) % np.uint64(len(self.opens))).astype(np.int64)
        live = np.arange(len(keys))
        for level in range(self.opens.shape[1]):
            size = self.sizes[bucket[live], level]
            live, size = live[size > 0], size[size > 0]
            if not len(live):
                break
            bit = self.opens[bucket[live], level] + (hashed(keys[live], level + 1) % size.astype(np.uint64)).astype(np.int64)
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            found = self.bits[word] >> shift & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << shift) - np.uint64(1)))
            out[live[found]] = (self.before[word] + below)[found]
            live = live[~found]
        return out


def levels_of(keys: np.ndarray) -> list[np.ndarray]:
    """Bits (64 a word) of each level for the distinct keys of a bucket."""
    levels = []
    while len(keys):
        size = -(-2 * len(keys) // 64) * 64
        bit = (hashed(keys, len(levels) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(bit, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        keys = keys[~alone[bit]]
    return levels


def perfect_hash(pairs: DataFrame, n: int) -> PerfectHash:
    """A minimal perfect hash of the n distinct ``pair``; buckets are hashed in tasks, some bits a pair come to the driver."""
    buckets = max(1, -(-n // BUCKET_PAIRS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch.column("pair").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((hashed(pair, 0) % np.uint64(buckets)).astype(np.int32)), batch.column("pair")], ["bucket", "pair"])

    def build(table: pa.Table) -> pa.Table:
        levels = levels_of(table.column("pair").to_numpy())
        return pa.table({"bucket": table.column("bucket")[:1], "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary()))})

    dealt = pairs.select("pair").mapInArrow(run, "bucket int, pair long")
    found = dealt.groupBy("bucket").applyInArrow(build, "bucket int, levels array<binary>").toArrow()
    by = dict(zip(found.column("bucket").to_pylist(), found.column("levels").to_pylist(), strict=True))
    most = max(map(len, by.values()), default=1)
    opens, sizes, words, at = np.zeros((buckets, most), np.int64), np.zeros((buckets, most), np.int64), [], 0
    for b in range(buckets):
        for level, bits in enumerate(by.get(b, [])):
            opens[b, level], sizes[b, level] = at, 8 * len(bits)
            words.append(np.frombuffer(bits, np.uint64))
            at += 8 * len(bits)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return PerfectHash(opens, sizes, flat, np.concatenate(([0], np.cumsum(np.bitwise_count(flat).astype(np.int64)))))


VECTOR = "slice int, node long, counts binary"


def _sliced(values: np.ndarray, node: int, size: int) -> pa.RecordBatch:
    """The vector in slices of ``size``; those without a count are left out."""
    found = [(s, values[s * size : (s + 1) * size]) for s in range(-(-len(values) // size))]
    found = [(s, v) for s, v in found if v.any()]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([node] * len(found), pa.int64()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["slice", "node", "counts"])


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = functools.reduce(np.add, (np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()))
    return pa.table({"slice": table.column("slice")[:1], "node": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def tree_summed(partials: DataFrame, hash_: PerfectHash) -> DataFrame:
    """VECTOR, one row a slice: the counts of all partial tables by the pairs' numbers. Level by level FAN_IN vectors become one."""
    sent, size = partials.sparkSession.sparkContext.broadcast(hash_), SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(sent.value.n, np.int64)
        for batch in batches:
            np.add.at(total, sent.value.numbers(batch.column("pair").to_numpy()), batch.column("docs").to_numpy())
        yield _sliced(total, TaskContext.get().partitionId(), size)

    # As many dense vectors as the partial tables fill, not one for each of many small ones.
    entries = partials.count()
    most = max(partials.sparkSession.sparkContext.defaultParallelism, entries // max(1, hash_.n))
    vectors = written(partials.select("pair", "docs").coalesce(most).mapInArrow(run, VECTOR), "count-vectors")
    nodes = most
    while nodes > 1:
        vectors = vectors.groupBy("slice", F.floor(F.col("node") / FAN_IN).alias("parent")).applyInArrow(_summed, VECTOR)
        nodes = -(-nodes // FAN_IN)
    return vectors


def pair_counts(partials: DataFrame, pairs: DataFrame, n: int, b_vocabulary: int) -> tuple[PerfectHash, DataFrame]:
    """The hash of n distinct pairs, and (number, pair, a, b, docs, best): best if no pair of the same A token has more documents."""
    hash_ = perfect_hash(pairs, n)
    if hash_.n != n:
        raise ValueError("the pairs are not distinct")
    sent = pairs.sparkSession.sparkContext.broadcast(hash_)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = sent.value.numbers(batch.column("pair").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((number // SLICE).astype(np.int32)), pa.array((number % SLICE).astype(np.int32)), batch.column("pair")], ["slice", "place", "pair"])

    def beside(keys: pa.Table, vectors: pa.Table) -> pa.Table:
        counts = np.frombuffer(vectors.column("counts")[0].as_py(), np.int64)
        place, key = keys.column("place").to_numpy(), keys.column("pair").to_numpy()
        number = keys.column("slice").to_numpy().astype(np.int64) * SLICE + place
        return pa.table({"number": number, "pair": key, "a": key // b_vocabulary, "b": key % b_vocabulary, "docs": counts[place]})

    keyed = pairs.select("pair").mapInArrow(numbered, "slice int, place int, pair long")
    vectors = tree_summed(partials, hash_)
    table = written(keyed.groupBy("slice").cogroup(vectors.groupBy("slice")).applyInArrow(beside, "number long, pair long, a long, b long, docs long"), "pair-counts")
    return hash_, table


@dataclass
class Lookup:
    """Counts by number; ``keys`` verify that the number is the pair's own."""

    hash: PerfectHash
    keys: np.ndarray
    docs: np.ndarray
    best: np.ndarray

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of each pair (0 for a pair of another block) and whether it is the best of its A token."""
        number = self.hash.numbers(pairs)
        own = number >= 0
        own[own] = self.keys[number[own]] == pairs[own]
        number = np.where(own, number, 0)
        return np.where(own, self.docs[number], 0), own & self.best[number]


FIGURES = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def looked_up(tokens: DataFrame, lookup: Lookup, ranks_path: str, model_path: str) -> DataFrame:
    """(key, FIGURES) of (key, a, b); n_best and count_sum over the pairs that are in ``lookup``."""
    sent = tokens.sparkSession.sparkContext.broadcast(lookup)
    names = ["key", *(x.split()[0] for x in FIGURES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in aligned(batches, sides(ranks_path, model_path)):
            n = chunk.part.num_rows
            document, pair, links = chunk.pairs()
            docs, best = sent.value.of(pair) if len(pair) else (links, links > 0)
            by = lambda of, weights=None: pa.array(np.bincount(of, weights=weights, minlength=n).astype(np.int64))
            total = np.zeros(n, np.int64)
            np.add.at(total, document, docs * links)
            figures = [by(chunk.document[chunk.a_group]), by(chunk.document[chunk.b_group]), by(chunk.document), by(document, links), by(document, links * best), pa.array(total), pa.array(chunk.groups_sha256(), pa.string())]
            yield pa.RecordBatch.from_arrays([chunk.part.column("key"), *figures], names)

    return tokens.select("key", "a", "b").mapInArrow(run, f"key {tokens.schema['key'].dataType.simpleString()}, {FIGURES}")


def _with_best(table: DataFrame) -> DataFrame:
    most = table.groupBy("a").agg(F.max("docs").alias("most"))
    return table.join(most, "a").withColumn("best", F.col("docs") == F.col("most")).drop("most")


def token_pairs(docs: DataFrame, text_col: str = "text", ranks_path: str = DEFAULT_RANKS, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """One row a pair: a, b, docs, best."""
    tokens = encoded(docs.select(F.lit(None).cast("int").alias("key"), docs[text_col].alias("text")), ranks_path, model_path)
    return _with_best(_blocks(tokens, ranks_path, model_path)[1]).select("a", "b", "docs", "best")


def _blocks(tokens: DataFrame, ranks_path: str, model_path: str) -> tuple[list[tuple[PerfectHash, DataFrame]], DataFrame]:
    """The hash and counts of each block of pairs, and the counts of all."""
    b_vocabulary = len(sides(ranks_path, model_path).b_bytes)
    partials = written(partial_counts(tokens, ranks_path, model_path), "partial-counts")
    pairs = written(partials.select("pair").distinct(), "pairs")
    blocks = max(1, math.ceil(pairs.count() / BLOCK_PAIRS))
    found, whole = [], None
    for k in range(blocks):
        mine = F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k
        some = pairs.where(mine)
        one = pair_counts(partials.where(mine), some, some.count(), b_vocabulary)
        found.append(one)
        whole = one[1] if whole is None else whole.union(one[1])
    return found, whole


def aligned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """One row a document: id and FIGURES."""
    tokens = encoded(docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")), ranks_path, model_path)
    blocks, whole = _blocks(tokens, ranks_path, model_path)
    if len(blocks) == 1:
        return looked_up(tokens, _lookup(*blocks[0], _with_best(blocks[0][1])), ranks_path, model_path).withColumnRenamed("key", id_col)
    marked = written(_with_best(whole), "marked-pairs")
    numbered = tokens.select(F.struct("row", F.col("key").alias("id")).alias("key"), "a", "b")
    found = None
    for hash_, table in blocks:
        one = looked_up(numbered, _lookup(hash_, table, marked.join(table.select("pair"), "pair", "left_semi")), ranks_path, model_path)
        found = one if found is None else found.union(one)
    same = [F.first(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    whole = found.groupBy(F.col("key.row").alias("row")).agg(F.first("key.id").alias(id_col), *same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.first("groups_sha256").alias("groups_sha256"))
    return whole.drop("row")


def _lookup(hash_: PerfectHash, table: DataFrame, marked: DataFrame) -> Lookup:
    """A block's arrays, at most BLOCK_PAIRS entries."""
    found = marked.select("number", "pair", "docs", "best").toArrow()
    order = pc.sort_indices(found.column("number"))
    keys, docs, best = (found.column(c).take(order).to_numpy() for c in ("pair", "docs", "best"))
    return Lookup(hash_, keys, docs, best.astype(bool))
