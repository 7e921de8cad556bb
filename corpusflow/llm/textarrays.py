"""Numpy views of Arrow string columns: words, lines and their hashes without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, that is ``[^\\x20\\x09-\\x0D]+``.
Hashes are 64-bit prefix polynomials with a random value per byte; equal strings have equal hashes, and
different ones differ but for a chance of about 2**-64 a pair. They are taken slice by slice, so a very long text needs
some bytes of work a byte and not a hundred.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
#: Bytes that are hashed at once.
SLICE_BYTES = 1 << 20


@functools.cache
def powers(n: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of the base and of its inverse."""
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    tables = []
    for base in (_BASE, inverse):
        table = np.full(n + 1, base, np.uint64)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    return tables[0], tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts add up to about ``limit`` bytes; a longer text comes alone."""
    _, offs = buffers(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many True each text has."""
    if len(offs) == 2:
        return np.array([np.count_nonzero(mask[offs[0] : offs[1]])], np.int64)
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges that follow one another; ``values`` are bytes, or 64-bit hashes of longer units."""
    out = np.zeros(len(starts), np.uint64)
    power, inverse = powers()
    for a in range(0, len(values), SLICE_BYTES):
        part = values[a : a + SLICE_BYTES]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_BYTE[part] if part.dtype == np.uint8 else part) * power[: len(part)], out=prefix[1:])
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, a + len(part), "left")
        if i == j:
            continue
        low, high = np.maximum(starts[i:j] - a, 0), np.minimum(ends[i:j] - a, len(part))
        h = (prefix[high] - prefix[low]) * inverse[low]
        if starts[i] < a:  # goes on from the slice before
            h[:1] *= np.uint64(pow(int(_BASE), int(a - starts[i]), 2**64))
        out[i:j] += h
    return mix(out ^ (ends - starts).astype(np.uint64))


def words(buf: np.ndarray, offs: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word, a maximal run of bytes that are no ``breaks``."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~breaks[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without the line feed) and text number of each line of a split at line feeds."""
    n = len(offs) - 1
    feeds = np.flatnonzero(buf == 10)
    of = np.searchsorted(offs, feeds, "right") - 1
    text = np.concatenate((np.arange(n), of))
    starts, ends = np.concatenate((offs[:-1], feeds + 1)), np.concatenate((offs[1:], feeds))
    a, b = np.lexsort((starts, text)), np.lexsort((ends, text))
    return starts[a], ends[b], text[a]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags: an equal key stands anywhere else."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
