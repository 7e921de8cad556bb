"""Deterministic hashed bag-of-words vectors, in sparse long form and dense, and their quality.

A text's tokens stand in its row, so counting them, folding them into dimensions and scaling take no shuffle: one Arrow
pass over the texts, with one md5 for each distinct token of a slice. Each row is a text of its own. Slices are bounded in
bytes and rows, so what a task holds follows neither the table nor the rows of a batch.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384


def dimension(token: Column, n: int = DIMENSIONS) -> Column:
    """First 8 hex digits of the token's md5, modulo the dimensions."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % n


#: Each byte as the token rule has it: lower case of A-Z, a-z and 0-9 as they are, a blank for all others.
PLAIN = np.full(256, 0x20, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    PLAIN[[_c, ord(chr(_c).upper())]] = _c


#: So many bytes of text and rows at most are worked on at once; a longer text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1024


def sliced(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch of texts in consecutive slices of bounded size."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        most = (ends[at - 1] if at else 0) + SLICE_BYTES
        to = min(max(at + 1, int(np.searchsorted(ends, most, "right"))), at + SLICE_ROWS)
        yield texts.slice(at, to - at)
        at = to


def by_slices(f: Callable[[pa.Array], pa.Array], kind: str):
    """A column function of texts that hands on each slice's values as soon as they are made."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in sliced(texts):
                yield f(part)

    return run


def plain(texts: pa.Array, table: np.ndarray = PLAIN) -> pa.Array:
    """Texts as ``functions.text.plain_tokens`` sees them, or with bytes by another table. Two characters outside ASCII have an ASCII letter as lower case."""
    for c, low in (("\u0130", "i "), ("\u212a", "k")):
        texts = pc.replace_substring(texts, c, low)
    valid, offsets, data = texts.buffers()
    mapped = pa.py_buffer(table[np.frombuffer(data, np.uint8)]) if data is not None else data
    return pa.Array.from_buffers(texts.type, len(texts), [valid, offsets, mapped], texts.null_count, texts.offset)


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, code and count of each distinct token of each row, by row and code; and the tokens by code."""
    tokens = pc.ascii_split_whitespace(plain(texts))
    flat = tokens.flatten().dictionary_encode()
    code, width = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(flat.dictionary))
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(tokens)), sizes)
    blank = flat.dictionary.index("").as_py()  # before and after the words of some texts
    if blank >= 0:
        row, code = row[code != blank], code[code != blank]
    pairs, n = np.unique(row * width + code, return_counts=True)
    return pairs // width, pairs % width, n, flat.dictionary


def lists(row: np.ndarray, n_rows: int, values: pa.Array, null: pa.Array) -> pa.ListArray:
    """Values by row as one list a row; null where the row is null."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n_rows)))), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=null)


def folded(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and value of the rows' vectors: sums of ln(1 + tf) at each term's dimension, scaled to unit length."""
    row, code, tf, terms = counted(texts)
    dims = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % n for t in terms.to_pylist()], np.int64)
    place, of = np.unique(row * n + dims[code], return_inverse=True)
    weight = np.bincount(of, weights=np.log1p(tf), minlength=len(place))
    row = place // n
    length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(texts)))
    return row, place % n, weight / np.where(length == 0, 1, length)[row]


def matrix(texts: pa.Array, n: int = DIMENSIONS) -> np.ndarray:
    """The rows' vectors."""
    row, dim, value = folded(texts, n)
    whole = np.zeros((len(texts), n))
    whole[row, dim] = value
    return whole


@functools.cache
def _term_counts():
    def term_counts(texts: pa.Array) -> pa.Array:
        row, code, tf, terms = counted(texts)
        pairs = pa.StructArray.from_arrays([terms.take(pa.array(code)), pa.array(tf.astype(np.int64))], ["term", "tf"])
        return lists(row, len(texts), pairs, texts.is_null())

    return by_slices(term_counts, "array<struct<term:string,tf:bigint>>")


@functools.cache
def _sparse(n: int):
    def sparse(texts: pa.Array) -> pa.Array:
        row, dim, value = folded(texts, n)
        return lists(row, len(texts), pa.StructArray.from_arrays([pa.array(dim), pa.array(value)], ["dim", "value"]), texts.is_null())

    return by_slices(sparse, "array<struct<dim:bigint,value:double>>")


@functools.cache
def _dense(n: int):
    def dense(texts: pa.Array) -> pa.Array:
        return lists(np.repeat(np.arange(len(texts)), n), len(texts), pa.array(matrix(texts, n).ravel()), texts.is_null())

    return by_slices(dense, "array<double>")


def sparse_vector(text: Column, n: int = DIMENSIONS) -> Column:
    """Array of (dim, value) by dimension; empty for a text without tokens, null for a null text."""
    return _sparse(n)(text)


def dense_vector(text: Column, n: int = DIMENSIONS) -> Column:
    """Array of n values; all 0 for a text without tokens, null for a null text."""
    return _dense(n)(text)


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of each row."""
    return docs.select(key, F.explode(_term_counts()(F.col(text))).alias("t")).select(key, "t.term", "t.tf")


def sparse_vectors(docs: DataFrame, key: str, text: str, n: int = DIMENSIONS) -> DataFrame:
    """(key, dim, value) of each row's vector."""
    return docs.select(key, F.explode(sparse_vector(F.col(text), n)).alias("v")).select(key, "v.dim", "v.value")


def dense_vectors(docs: DataFrame, key: str, text: str, n: int = DIMENSIONS) -> DataFrame:
    """(key, embedding array<double>) of each row."""
    return docs.select(key, dense_vector(F.col(text), n).alias("embedding"))


def norm(vector: Column) -> Column:
    """Length of a dense vector, 1 for the zero vector."""
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n == 0, 1.0).otherwise(n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm_statistics(vectors: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation and quality band (85, 70, 50) of the vectors' lengths; dimensions found."""
    n = norm(F.col(column))
    stats = vectors.agg(F.avg(n).alias("m"), F.stddev_pop(n).alias("s"), F.count("*").alias("vectors"), F.array_join(F.sort_array(F.collect_set(F.size(column))), ",").alias("dimensions"))
    band = F.when(F.col("m").between(0.5, 2.0) & (F.col("s") <= 0.5), 85.0).when(F.col("m").between(0.3, 3.0) & (F.col("s") <= 1.0), 70.0).otherwise(50.0)
    return stats.select("vectors", "dimensions", F.round("m", 6).alias("norm_mean"), F.round("s", 6).alias("norm_std"), band.alias("quality"))
