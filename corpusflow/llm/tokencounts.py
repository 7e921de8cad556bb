"""Token counts by section: each document is encoded once, and its token spans are joined with its sections' spans.

Sections of a document are its lines, the line feed belonging to the line that it ends. A token's span comes from the
byte length of its piece, so the spans tile the text. A token inside one section counts there. A token that crosses
a boundary is allocated by ``rule``:

* ``largest`` (default): to the section that holds most of its bytes, the earliest one on a tie;
* ``first``: to the section of its first byte.

Sections have a kind: ``heading`` (the first one), ``table`` (holds `` | ``), ``blank`` (no word) or ``body``.

Defined cases: a null or empty text has no tokens and no sections; control strings of a vocabulary are ordinary text;
repeated rows give repeated results; an empty table gives an empty table; a very long text is encoded whole, with some
tens of bytes of work a byte; only the id and the text column are read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textarrays as ta

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut into pieces before merging; a fixed value that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KINDS = ("heading", "table", "blank", "body")


@functools.cache
def encoding(path: str):
    """The encoding and the byte length of each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary has no token for some byte, so tokens would not tile the texts")
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def sections(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and kind number of each section; empty ones are left out."""
    starts, ends, of = ta.lines(buf, offs)
    ends = np.where((ends < offs[1:][of]), ends + 1, ends)
    full = ends > starts
    starts, ends, of = starts[full], ends[full], of[full]
    if not len(buf):
        return starts, ends, of, of
    inked = np.concatenate(([0], np.cumsum(~ta.SPACE[buf])))
    bar = np.zeros(len(buf) + 1, np.int64)
    bar[1:] = np.cumsum(np.concatenate(([False], (buf[:-2] == 32) & (buf[1:-1] == ord("|")) & (buf[2:] == 32), [False]))[: len(buf)])
    kind = np.where(inked[ends] == inked[starts], 2, np.where(bar[ends] > bar[starts], 1, 3))
    kind[(starts == offs[:-1][of]) & (kind != 2)] = 0
    return starts, ends, of, kind


def attribute(token_starts: np.ndarray, token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """Section number of each token, and whether it crosses a boundary. Both lists of spans are sorted and tile one range."""
    first = np.searchsorted(starts, token_starts, "right") - 1
    last = np.searchsorted(starts, token_ends, "left") - 1
    crosses = last > first
    if rule == "largest":
        chosen, tokens = first.copy(), np.flatnonzero(crosses)
        if len(tokens):
            each = (last - first + 1)[tokens]
            opens = np.cumsum(each) - each
            t = np.repeat(tokens, each)
            s = first[t] + np.arange(len(t)) - np.repeat(opens, each)
            share = np.minimum(ends[s], token_ends[t]) - np.maximum(starts[s], token_starts[t])
            best = np.flatnonzero(share == np.repeat(np.maximum.reduceat(share, opens), each))
            at, where = np.unique(t[best], return_index=True)  # the earliest of equal shares
            chosen[at] = s[best][where]
        return chosen, crosses
    if rule == "first":
        return first, crosses
    raise ValueError(f"no such rule: {rule}")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS, rule: str = "largest") -> DataFrame:
    """One row a document: id, n_tokens, n_sections, crossing_tokens, section_tokens (array), and tokens by kind."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    names = ["n_tokens", "n_sections", "crossing_tokens", "section_tokens", *(f"{k}_tokens" for k in KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoding(ranks_path)
        for batch in batches:
            for part in ta.chunks(batch, "text"):
                buf, offs = ta.buffers(part.column("text"))
                n = part.num_rows
                ids = [enc.encode_ordinary(t) if t else [] for t in part.column("text").to_pylist()]
                n_tokens = np.fromiter(map(len, ids), np.int64, n)
                flat = np.concatenate([np.array(x, np.int64) for x in ids]) if n else np.zeros(0, np.int64)
                ends = np.cumsum(lengths[flat])
                s, e, of, kind = sections(buf, offs)
                chosen, crosses = attribute(ends - lengths[flat], ends, s, e, rule)
                by_section = np.bincount(chosen, minlength=len(s))
                n_sections = np.bincount(of, minlength=n)
                crossing = np.bincount(of[chosen[crosses]], minlength=n)
                by_kind = [np.bincount(of, weights=by_section * (kind == k), minlength=n).astype(np.int64) for k in range(len(KINDS))]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_sections))), pa.int32()), pa.array(by_section, pa.int64()))
                columns = [part.column("id"), pa.array(n_tokens), pa.array(n_sections, pa.int64()), pa.array(crossing, pa.int64()), lists, *map(pa.array, by_kind)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, *names])

    longs = ", ".join(f"{k}_tokens long" for k in KINDS)
    return source.mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, n_tokens long, n_sections long, crossing_tokens long, section_tokens array<long>, {longs}")
