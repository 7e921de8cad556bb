"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text becomes characters with spaces as U+2581 and one more U+2581 in front, as the piece model has it. The lattice of
all pieces that spell it is summed forward (log domain), then one segmentation is drawn backward, each arc with its
exact conditional probability. The uniform numbers are a hash of seed, row key, unit and step, so a row gives the same
pieces on every run and machine.

Pieces do not reach over a unit: units start at a U+2581 after another character, and at or after a character that is in
no longer piece. The lattice of a text is therefore the product of its units' lattices, and equal units share one. The
units of a chunk are summed together, level by level. A unit of more than ``LONG_UNIT`` characters, such as an unspaced
blob, is summed alone, block by block: the sums of its nodes are kept, its arcs are only those of one block.

Weights: a merge-rank model scores a piece with minus its rank, which is no log-probability; a piece of rank r gets
``-inverse_temperature * log(r + 2)`` (Zipf's law). Models whose scores are log-probabilities use them
(``zipf=False``). A character that is no piece becomes its UTF-8 byte pieces at ``byte_log_weight`` each, and so do a
U+2581 of the text itself, so decoding gives back every text.

Defined cases: a null text has null pieces; an empty text has none; a null key is a key of its own; repeated rows give
repeated results; an empty table gives an empty table; a text longer than a chunk is cut at units, so work arrays stay
bounded by the chunk and by 8 bytes a character of the longest unit; only the key and the text column are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = 0x2581
_LITERAL_MARK = 0x110000  # a U+2581 that the text itself holds
_ROOM = 1 << 21
CHUNK_BYTES = 1 << 19
#: Characters from which a unit is summed alone, and those of one of its blocks.
LONG_UNIT, UNIT_BLOCK = 2048, 1 << 15


@dataclass
class Lexicon:
    """Trie and byte tables of a piece model."""

    keys: np.ndarray  # node * _ROOM + character, sorted
    child: np.ndarray
    dense: np.ndarray  # child by row of a node and class of a character, for frequent characters
    row: np.ndarray  # of a node; nodes without children share row 0, which is empty
    klass: np.ndarray  # of a character; 0 for those not in dense
    piece: np.ndarray  # of a node, or -1
    root: np.ndarray  # child of the root by character, or 0
    weight: np.ndarray  # of a piece
    byte_ids: np.ndarray
    piece_bytes: np.ndarray
    piece_at: np.ndarray
    alone: np.ndarray  # characters that are in no piece of two or more
    longest: int  # characters of the longest piece
    byte_log_weight: float


@functools.cache
def lexicon(path: str, inverse_temperature: float = 1.0, byte_log_weight: float = -12.0, zipf: bool = True) -> Lexicon:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    nodes: list[dict[int, int]] = [{}]
    piece, weight, spelled = [-1], np.full(n, -np.inf), []
    byte_ids, alone, longest = np.full(256, -1, np.int64), np.ones(0x110002, bool), 1
    for i in range(n):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            b = int(text[3:5], 16)
            byte_ids[b] = i
            spelled.append(bytes([b]))
            continue
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
            continue
        spelled.append(text.replace("▁", " ").encode())
        score = model.get_score(i)
        # Whitespace runs carry a score below every rank; they count as the last ranks.
        weight[i] = inverse_temperature * (-np.log(2 + min(-score, n)) if zipf else score)
        at = 0
        for c in map(ord, text):
            nxt = nodes[at].get(c)
            if nxt is None:
                nxt = nodes[at][c] = len(nodes)
                nodes.append({})
                piece.append(-1)
            at = nxt
            if len(text) > 1:
                alone[c] = False
        piece[at] = i
        longest = max(longest, len(text))
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    pairs = sorted((k * _ROOM + c, child) for k, d in enumerate(nodes) for c, child in d.items())
    root = np.zeros(0x110002, np.int64)
    for c, child in nodes[0].items():
        root[c] = child
    row, inner = np.zeros(len(nodes), np.int64), [k for k, d in enumerate(nodes) if d]
    row[inner] = np.arange(1, len(inner) + 1)
    klass = np.zeros(0x110002, np.int64)
    frequent = [*range(0x21, 0x7F), *range(0xC0, 0x100), SPACE_MARK]
    klass[frequent] = np.arange(1, len(frequent) + 1)
    dense = np.zeros((len(inner) + 1, len(frequent) + 1), np.int32)
    for k in inner:
        for c, child in nodes[k].items():
            if klass[c]:
                dense[row[k], klass[c]] = child
    return Lexicon(
        np.array([k for k, _ in pairs], np.int64), np.array([c for _, c in pairs], np.int64), dense, row, klass, np.array(piece, np.int64), root, weight, byte_ids,
        np.frombuffer(b"".join(spelled), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in spelled]))), alone, longest, byte_log_weight,
    )


def utf8_sizes(chars: np.ndarray) -> np.ndarray:
    return np.where(chars == _LITERAL_MARK, 3, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))


@dataclass
class Lattice:
    """Arcs into each node of the units' lattices, with cumulative probabilities to draw from."""

    first: np.ndarray  # arc of a node
    upto: np.ndarray  # cumulative probability within the node; 1 at its last arc
    source: np.ndarray
    what: np.ndarray  # piece, or -1 - character
    end: np.ndarray  # last node of each unit
    is_start: np.ndarray


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of the given starts and lengths, one after another."""
    upto = np.cumsum(counts)
    return np.repeat(starts - (upto - counts), counts) + np.arange(upto[-1] if len(upto) else 0)


def arcs_of(lex: Lexicon, chars: np.ndarray, unit: np.ndarray, stop: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First arc and number of arcs of each node, and source, weight and what (piece, or -1 - character) of each arc.

    ``unit`` is the number of nodes before a character's own that have no character, ``stop`` where its pieces have to end."""
    n = len(chars)
    klass = lex.klass[chars]
    at, node, length = np.arange(n), lex.root[chars], 1
    single = lex.piece[node] >= 0
    other = np.flatnonzero(~single)
    found = [(other, 1, -1 - chars[other])]
    while True:
        go = node > 0
        at, node = at[go], node[go]
        if not len(at):
            break
        piece = lex.piece[node]
        is_piece = piece >= 0
        found.append((at[is_piece], length, piece[is_piece]))
        go = (at + length < stop[at]) & (lex.row[node] > 0)
        at, node = at[go], node[go]
        k = klass[at + length]
        nxt = lex.dense[lex.row[node], k].astype(np.int64)
        rare = np.flatnonzero(k == 0)
        if len(rare):
            key = node[rare] * _ROOM + chars[at[rare] + length]
            j = np.minimum(np.searchsorted(lex.keys, key), len(lex.keys) - 1)
            nxt[rare] = np.where(lex.keys[j] == key, lex.child[j], 0)
        node = nxt
        length += 1
    # Arcs go next to their target node; no two arcs of one length share a target.
    targets = [a + unit[a] + length for a, length, _ in found]
    counts = np.zeros(n_nodes, np.int64)
    for t in targets:
        counts[t] += 1
    first = np.cumsum(counts) - counts
    source, what, filled = np.empty(int(counts.sum()), np.int64), np.empty(int(counts.sum()), np.int64), first.copy()
    for (_, length, w), t in zip(found, targets, strict=True):
        source[filled[t]], what[filled[t]] = t - length, w
        filled[t] += 1
    weight = np.where(what >= 0, lex.weight[np.maximum(what, 0)], 0.0)
    unknown = np.flatnonzero(what < 0)
    weight[unknown] = lex.byte_log_weight * utf8_sizes(-1 - what[unknown])
    return first, counts, source, weight, what


def within(p: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running sums of p inside each node, whose last digits don't depend on other nodes."""
    upto, k = p.copy(), 1
    while len(rest := np.flatnonzero(counts > k)):
        upto[first[rest] + k] += upto[first[rest] + k - 1]
        k += 1
    return upto


def lattice(lex: Lexicon, chars: np.ndarray, offs: np.ndarray) -> Lattice:
    """Of units given as characters and offsets. A unit has one node more than characters."""
    n, units = len(chars), len(offs) - 1
    size = np.diff(offs)
    unit = np.repeat(np.arange(units), size)
    n_nodes = n + units
    first, counts, source, weight, what = arcs_of(lex, chars, unit, offs[1:][unit], n_nodes)

    level = np.arange(n_nodes) - np.repeat(offs[:-1] + np.arange(units), size + 1)
    most = int(level.max()) if n_nodes else 0
    by_level = np.argsort(level.astype(np.uint16) if most < 65536 else level, kind="stable")
    level_at = np.concatenate(([0], np.cumsum(np.bincount(level, minlength=most + 1))))
    arcs = spans(first[by_level], counts[by_level])
    arc_at = np.concatenate(([0], np.cumsum(counts[by_level])))
    log_sum, value = np.zeros(n_nodes), np.empty(len(arcs))
    w, src = weight[arcs], source[arcs]
    for lv in range(1, most + 1):
        i, j = level_at[lv], level_at[lv + 1]
        a, b = arc_at[i], arc_at[j]
        own, each = arc_at[i:j] - a, counts[by_level[i:j]]
        v = log_sum[src[a:b]] + w[a:b]
        top = np.maximum.reduceat(v, own)
        total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, each)), own))
        log_sum[by_level[i:j]] = total
        value[a:b] = v - np.repeat(total, each)
    p = np.empty(len(arcs))
    p[arcs] = np.exp(value)
    upto = within(p, first, counts)
    upto[(first + counts - 1)[counts > 0]] = 2.0  # whatever is left after rounding goes to the last arc
    is_start = np.zeros(n_nodes, bool)
    is_start[offs[:-1] + np.arange(units)] = True
    return Lattice(first, upto, source, what, offs[1:] + np.arange(units), is_start)


_GOLDEN = 0x9E3779B97F4A7C15


def uniforms(key: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """In [0, 1), by keys for one step or by steps of one key."""
    turn = (np.atleast_1d(np.asarray(step, np.uint64)) + np.uint64(1)) * np.uint64(_GOLDEN)
    return (ta.mix(key + turn) >> np.uint64(11)).astype(np.float64) / 2**53


def draw_long(lex: Lexicon, chars: np.ndarray, seed: np.uint64) -> np.ndarray:
    """What one long unit is drawn as: pieces, or -1 - character, in order."""
    n = len(chars)

    def block(a: int, b: int) -> tuple:
        """Arcs into the nodes a + 1 to b, by their numbers within the block; ``back`` characters before it are looked at."""
        back = min(a, lex.longest)
        some = chars[a - back : b]
        zeros = np.zeros(len(some), np.int64)
        first, counts, source, weight, what = arcs_of(lex, some, zeros, zeros + len(some), len(some) + 1)
        return a - back, first, counts, source, weight, what

    log_sum = np.zeros(n + 1)
    for a in range(0, n, UNIT_BLOCK):
        b = min(n, a + UNIT_BLOCK)
        base, first, counts, source, weight, _ = block(a, b)
        sums, first, counts, source, weight = log_sum[base : b + 1].tolist(), first.tolist(), counts.tolist(), source.tolist(), weight.tolist()
        for j in range(a + 1 - base, b + 1 - base):
            v = [sums[source[k]] + weight[k] for k in range(first[j], first[j] + counts[j])]
            top = max(v)
            sums[j] = top + math.log(sum([math.exp(x - top) for x in v]))
        log_sum[a + 1 : b + 1] = sums[a + 1 - base :]
    drawn, at, step = [], n, 0
    for b in range(n, 0, -UNIT_BLOCK):
        a = max(0, b - UNIT_BLOCK)
        base, first, counts, source, weight, what = block(a, b)
        p = np.exp(log_sum[base + source] + weight - np.repeat(log_sum[base : b + 1], counts))
        upto = within(p, first, counts).tolist()
        first, counts, source, what = first.tolist(), counts.tolist(), source.tolist(), what.tolist()
        u = uniforms(seed, np.arange(step, step + b - a)).tolist()
        began = step
        while at > a:
            j = at - base
            k, last = first[j], first[j] + counts[j] - 1
            while k < last and upto[k] <= u[step - began]:
                k += 1
            drawn.append(what[k])
            at, step = base + source[k], step + 1
    return np.array(drawn[::-1], np.int64)


def characters(buf: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes, with spaces as the model has them."""
    chars = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    chars = np.where(chars == SPACE_MARK, _LITERAL_MARK, chars)
    chars[chars == 32] = SPACE_MARK
    return chars


def unit_starts(lex: Lexicon, chars: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Where units start; ``opens`` are the first characters of texts."""
    alone = lex.alone[chars]
    starts = np.zeros(len(chars), bool)
    starts[opens] = True
    starts |= alone
    starts[1:] |= alone[:-1] | ((chars[1:] == SPACE_MARK) & (chars[:-1] != SPACE_MARK))
    return np.flatnonzero(starts)


def draw(lex: Lexicon, chars: np.ndarray, first: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of units that start at ``first``, and how many each unit has. seed: of each unit."""
    stop = np.concatenate((first[1:], [len(chars)]))
    lone = np.flatnonzero(stop - first > LONG_UNIT)
    many = np.flatnonzero(stop - first <= LONG_UNIT)
    counts = np.zeros(len(first), np.int64)
    drawn, which, lat = [], np.zeros(0, np.int64), None
    if len(many):
        spelling = ta.hashes(ta.mix(chars.astype(np.uint64) + np.uint64(1)), first[many], stop[many])
        _, where, which = np.unique(spelling, return_index=True, return_inverse=True)
        a, size = first[many][where], (stop - first)[many][where]
        offs = np.concatenate(([0], np.cumsum(size)))
        lat = lattice(lex, chars[spans(a, size)], offs)
        who, node, step = many, lat.end[which], 0
        while len(who):
            arc, u = lat.first[node], uniforms(seed[who], step)
            look = np.flatnonzero(lat.upto[arc] <= u)
            while len(look):
                arc[look] += 1
                look = look[lat.upto[arc[look]] <= u[look]]
            drawn.append((who, lat.what[arc]))
            counts[who] += 1
            node = lat.source[arc]
            more = ~lat.is_start[node]
            who, node, step = who[more], node[more], step + 1
    alone = {int(i): draw_long(lex, chars[first[i] : stop[i]], seed[i]) for i in lone}
    for i, what in alone.items():
        counts[i] = len(what)
    last = np.cumsum(counts) - 1  # a unit's draws come last piece first
    what = np.empty(int(counts.sum()), np.int64)
    for k, (who, drew) in enumerate(drawn):
        what[last[who] - k] = drew
    for i, drew in alone.items():
        what[last[i] + 1 - len(drew) : last[i] + 1] = drew
    spelled = np.where(what >= 0, 1, utf8_sizes(-1 - what))
    ids = np.repeat(what, spelled)
    unknown = what < 0
    if unknown.any():
        c = -1 - what[unknown]
        raw = np.frombuffer("".join(map(chr, np.where(c == _LITERAL_MARK, SPACE_MARK, c).tolist())).encode(), np.uint8)
        ids[np.repeat(unknown, spelled)] = lex.byte_ids[raw]
    return ids, np.bincount(np.repeat(np.arange(len(first)), counts), weights=spelled, minlength=len(first)).astype(np.int64)


def unit_seeds(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Seed of a text's unit from the text's key and the unit's number in it."""
    return ta.mix(key + ta.mix(number.astype(np.uint64)))


def encode(lex: Lexicon, column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in a row, and offsets. keys: a 64-bit seed for each text."""
    buf, offs = ta.buffers(column)
    n = len(offs) - 1
    if n == 1 and len(buf) > CHUNK_BYTES:
        ids = encode_long(lex, buf, keys[0])
        return ids, np.array([0, len(ids)])
    full = np.diff(offs) > 0
    count = ta.per_text((buf & 0xC0) != 0x80, offs)
    at = np.concatenate(([0], np.cumsum(count + full)))
    chars = np.full(at[-1], SPACE_MARK, np.int64)
    filled = np.ones(at[-1], bool)
    filled[at[:-1][full]] = False
    chars[filled] = characters(buf)
    if not len(chars):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    first = unit_starts(lex, chars, at[:-1][full])
    of = np.searchsorted(at, first, "right") - 1
    number = np.arange(len(first)) - np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))[of]
    ids, spelled = draw(lex, chars, first, unit_seeds(keys[of], number))
    per = np.bincount(of, weights=spelled, minlength=n).astype(np.int64)
    return ids, np.concatenate(([0], np.cumsum(per)))


def encode_long(lex: Lexicon, buf: np.ndarray, key: np.uint64) -> np.ndarray:
    """Piece ids of one text, whose units are drawn as soon as a slice of it holds them whole."""
    rest, number, out, a = [np.array([SPACE_MARK])], 0, [], 0
    while a < len(buf):
        b = min(len(buf), a + CHUNK_BYTES)
        while b < len(buf) and buf[b] & 0xC0 == 0x80:
            b += 1
        new = characters(buf[a:b])
        before = rest[-1]
        # Only new characters can start a unit; the one before decides with them.
        starts = unit_starts(lex, np.concatenate((before[-1:], new)), np.zeros(0, np.int64))
        starts = starts[starts > 0] - 1
        if b == len(buf):
            starts = np.concatenate((starts, [len(new)]))
        if len(starts):
            held = np.concatenate(rest)
            chars = np.concatenate((held, new[: starts[-1]]))
            first = np.unique(np.concatenate(([0], len(held) + starts[:-1])))
            ids, _ = draw(lex, chars, first, unit_seeds(np.full(len(first), key, np.uint64), number + np.arange(len(first))))
            out.append(ids.astype(np.int32))
            number += len(first)
            rest = [new[starts[-1] :]]
        else:
            rest.append(new)
        a = b
    return np.concatenate(out)


def decode(lex: Lexicon, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that the pieces spell; the one space in front is taken off."""
    sizes = np.diff(lex.piece_at)
    upto = np.concatenate(([0], np.cumsum(sizes[ids])))
    parts = []
    for a in range(0, len(ids), CHUNK_BYTES):
        some = ids[a : a + CHUNK_BYTES]
        parts.append(lex.piece_bytes[spans(lex.piece_at[:-1][some], sizes[some])])
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    bounds = upto[offs]
    keep = np.ones(len(out), bool)
    keep[bounds[:-1][np.diff(bounds) > 0]] = False
    return out[keep], bounds - np.concatenate(([0], np.cumsum(np.diff(bounds) > 0)))


def decoded_texts(pieces: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model_path: str = DEFAULT_MODEL, text_col: str = "text") -> DataFrame:
    """(id, text) of piece arrays, as ``sample_pieces`` makes them; null arrays give null texts."""
    source = pieces.select(pieces[id_col].alias("id"), pieces[pieces_col].cast("array<int>").alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(model_path)
        for batch in batches:
            texts = []
            for ids in batch.column("pieces"):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                own = np.asarray(ids.values, np.int64)
                texts.append(decode(lex, own, np.array([0, len(own)]))[0].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], [id_col, text_col])

    return source.mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, `{text_col}` string")


def sample_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL, seed: int = 1, inverse_temperature: float = 1.0, byte_log_weight: float = -12.0, zipf: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row a document: id, the columns in ``keep``, n_pieces, pieces (array of ids), lossless (they decode to the text)."""
    source = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate((id_col, *keep))), docs[text_col].alias("text"), F.xxhash64(docs[id_col].cast("string"), F.lit(seed)).alias("row_key"))
    names = [id_col, *keep, "n_pieces", "pieces", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(model_path, inverse_temperature, byte_log_weight, zipf)
        for batch in batches:
            for part in ta.chunks(batch, "text", CHUNK_BYTES):
                texts = part.column("text")
                null = np.asarray(texts.is_null())
                buf, text_offs = ta.buffers(texts)
                ids, offs = encode(lex, texts, part.column("row_key").to_numpy().astype(np.uint64))
                back, back_offs = decode(lex, ids, offs)
                if np.array_equal(back_offs, text_offs) and np.array_equal(back, buf):
                    same = np.ones(len(null), bool)
                else:
                    same = np.array([np.array_equal(back[back_offs[i] : back_offs[i + 1]], buf[text_offs[i] : text_offs[i + 1]]) for i in range(len(null))])
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
                if null.any():
                    lists = pa.array([None if z else x for z, x in zip(null, lists.to_pylist(), strict=True)], pa.list_(pa.int32()))
                columns = [*(part.column(f"k{i}") for i in range(len(keep) + 1)), pa.array(np.diff(offs), pa.int64()), lists, pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names)
            pa.default_memory_pool().release_unused()

    kinds = ", ".join(f"`{c}` {source.schema[f'k{i}'].dataType.simpleString()}" for i, c in enumerate((id_col, *keep)))
    return source.mapInArrow(run, f"{kinds}, n_pieces long, pieces array<int>, lossless boolean")
