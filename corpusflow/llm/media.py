"""Baseline JPEG media columns in numpy: a coefficient writer, a Huffman decoder and DC-only luminance thumbnails.

Scans are decoded in lanes: every restart segment of a group advances by one symbol a step, so the work is done by
whole-array operations. Segments are independent: a long file is written and read in groups of them, so work arrays stay
bounded. Any baseline (SOF0/SOF1) file with 8-bit samples and up to four components, in one scan or in several, is read;
others get a status and null features.

Bytes are stored losslessly as quantised coefficients, the unit of the format: 64 bytes make one block, byte ``b`` at
zigzag place ``k`` is coefficient ``k`` with the value of ``b`` as a signed byte, and all quantiser steps are 1.

Defined cases: a null or empty text is the empty payload, 64 zero bytes; equal texts give equal files; repeated rows
give repeated results; an empty table gives an empty table; a very long text is one file (up to 4 GB), whose coefficients
take 2 bytes a byte while it is read; only the id and the text column are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textarrays as ta

UNIT = 64
#: Blocks to a row of an image, and to a restart segment.
ROW_BLOCKS, RESTART_BLOCKS = 32, 4
LARGEST_SIDE = 65535
#: Payload bytes that are coded at once, a multiple of 8 restart segments, and scan bytes that are decoded at once.
RUN_BYTES, SCAN_BYTES = 1 << 19, 1 << 20

# Code lengths of our files' Huffman tables, symbol by symbol. DC symbols are sizes 0-8 (differences of signed bytes);
# AC symbols are run * 16 + size. Letters are values of size 6 and 7, so these get the short codes.
_DC_LENGTHS = {7: 2, 6: 2, 5: 3, 0: 3, 4: 4, 8: 4, 3: 5, 2: 6, 1: 7}
_AC_LENGTHS = {0x07: 1, 0x06: 2, 0x05: 4, 0x00: 5, 0xF0: 8} | {s: 7 for s in (1, 2, 3, 4, 8)} | {r * 16 + s: 12 for r in range(1, 16) for s in range(1, 9)}


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """DHT counts by length, symbols in code order, and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        counts[last - 1] += 1
        code += 1
    assert code < 1 << last, "the code of all ones must stay free"
    return counts, order, codes


_DC_COUNTS, _DC_ORDER, _DC_CODES = canonical(_DC_LENGTHS)
_AC_COUNTS, _AC_ORDER, _AC_CODES = canonical(_AC_LENGTHS)


def _code_arrays(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], length[s] = c, n
    return code, length


_DC, _AC = _code_arrays(_DC_CODES), _code_arrays(_AC_CODES)
_SIZE = np.array([int(abs(v)).bit_length() for v in range(-256, 257)], np.int64)


def _size_and_bits(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = _SIZE[v + 256]
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64))
_HUFFMAN = _segment(0xC4, bytes([0x00, *_DC_COUNTS, *_DC_ORDER])) + _segment(0xC4, bytes([0x10, *_AC_COUNTS, *_AC_ORDER]))
_SCAN = _segment(0xDD, struct.pack(">H", RESTART_BLOCKS)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
_COMMENT = b"payload"


def padded_sizes(n_bytes: np.ndarray) -> np.ndarray:
    """Sizes after zero bytes are appended up to a positive multiple of 64."""
    return np.maximum(1, -(-n_bytes // UNIT)) * UNIT


def encode(buf: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """One JPEG file for each byte string."""
    n_bytes = np.diff(offs)
    payload = padded_sizes(n_bytes)
    used = payload // UNIT
    wide = np.minimum(used, np.maximum(ROW_BLOCKS, -(-used // (LARGEST_SIDE // 8))))
    high = -(-used // wide)
    if len(high) and max(wide.max(), high.max()) * 8 > LARGEST_SIDE:
        raise ValueError("a payload of more than 4 GB does not fit one baseline image")
    blocks = wide * high
    if len(n_bytes) == 1:
        runs, per = [], RUN_BYTES // UNIT
        for a in range(0, int(blocks[0]), per):
            some = buf[a * UNIT : (a + per) * UNIT]
            runs += scans(some, np.array([0, len(some)]), np.array([min(per, int(blocks[0]) - a)]))
        bodies = [b"\xff\xd7".join(runs)]
    else:
        bodies = scans(buf, offs, blocks)
    files = []
    for i, body in enumerate(bodies):
        comment = _segment(0xFE, _COMMENT + struct.pack(">QQ", int(n_bytes[i]), int(payload[i])))
        frame = _segment(0xC0, struct.pack(">BHHB", 8, int(high[i]) * 8, int(wide[i]) * 8, 1) + bytes([1, 0x11, 0]))
        files.append(b"".join((b"\xff\xd8", comment, _TABLES, frame, _HUFFMAN, _SCAN, body, b"\xff\xd9")))
    return files


def scans(buf: np.ndarray, offs: np.ndarray, blocks: np.ndarray) -> list[bytes]:
    """Entropy-coded data of images of so many blocks, whose first coefficients are the bytes."""
    n_bytes = np.diff(offs)
    first = np.concatenate(([0], np.cumsum(blocks)))
    coef = np.zeros(first[-1] * UNIT, np.int8)
    coef[np.repeat(first[:-1] * UNIT - offs[:-1], n_bytes) + np.arange(len(buf))] = buf.view(np.int8)
    coef = coef.reshape(-1, UNIT).astype(np.int64)
    nb = len(coef)
    within = np.arange(nb) - np.repeat(first[:-1], blocks)
    opens = within % RESTART_BLOCKS == 0

    diff = coef[:, 0].copy()
    diff[1:] -= np.where(opens[1:], 0, coef[:-1, 0])
    dc_size, dc_bits = _size_and_bits(diff)

    block, k = np.nonzero(coef[:, 1:])
    k += 1
    value = coef[block, k]
    head = np.ones(len(block), bool)
    head[1:] = block[1:] != block[:-1]
    run = k - 1
    run[~head] = (k[1:] - k[:-1] - 1)[~head[1:]]
    long_runs = run >> 4
    size, bits = _size_and_bits(value)
    symbol = (run & 15) * 16 + size

    last = np.zeros(nb, np.int64)
    np.maximum.at(last, block, k) if len(block) else None
    ends_early = last < 63
    own = np.cumsum(long_runs + 1)
    through = np.zeros(nb + 1, np.int64)
    through[1:] = np.cumsum(np.bincount(block, weights=long_runs + 1, minlength=nb).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(1 + np.diff(through) + ends_early)))
    opened = np.flatnonzero(opens)
    closing = np.concatenate((opened[1:], [nb])) if nb else opened
    pads = np.cumsum(opens) - 1  # one more entry ends each segment
    total = at[-1] + len(opened)
    code, length = np.zeros(total, np.int64), np.zeros(total, np.int64)
    spot = at[:-1] + pads
    code[spot], length[spot] = (_DC[0][dc_size] << dc_size) | dc_bits, _DC[1][dc_size] + dc_size
    place = spot[block] + own - through[block]
    code[place], length[place] = (_AC[0][symbol] << size) | bits, _AC[1][symbol] + size
    for z in range(1, 4):
        some = place[long_runs >= z] - z
        code[some], length[some] = _AC_CODES[0xF0]
    done = (spot + 1 + np.diff(through))[ends_early]
    code[done], length[done] = _AC_CODES[0x00]
    pad = at[closing] + np.arange(len(opened))
    bits_so_far = np.concatenate(([0], np.cumsum(length)))
    in_segment = np.diff(np.concatenate(([0], bits_so_far[pad])))
    length[pad] = -in_segment % 8
    code[pad] = (1 << length[pad]) - 1
    position = np.concatenate(([0], np.cumsum(length)))
    size_bytes = int(position[-1]) >> 3
    position, byte = position[:-1], position[:-1] >> 3
    field32 = code << (32 - (position & 7) - length)
    scan = np.zeros(size_bytes + 4, np.int64)
    for shift in range(4):
        scan += np.bincount(byte + shift, weights=(field32 >> (24 - 8 * shift)) & 255, minlength=size_bytes + 4).astype(np.int64)
    scan = scan[:size_bytes].astype(np.uint8)

    segment_end = (np.concatenate((position, [size_bytes * 8]))[np.concatenate((spot[opened[1:]], [total]))] >> 3) if nb else np.zeros(0, np.int64)
    stuffed = scan == 0xFF
    cut = np.zeros(size_bytes + 1, np.int64)  # bytes put in before each byte
    cut[1:] += stuffed
    closes_image = np.zeros(len(opened), bool)
    closes_image[np.searchsorted(opened, first[1:], "left") - 1] = True
    np.add.at(cut, segment_end[~closes_image], 2)
    moved = np.cumsum(cut)
    out = np.zeros(size_bytes + int(moved[-1]), np.uint8)
    out[np.arange(size_bytes) + moved[:-1]] = scan
    inner = segment_end[~closes_image]
    number = within[opened[1:]][~closes_image[:-1]] // RESTART_BLOCKS - 1 if nb else inner
    out[inner + moved[inner] - 2] = 0xFF
    out[inner + moved[inner] - 1] = 0xD0 + (number & 7)
    image_end = segment_end[closes_image]
    stop = image_end + moved[np.minimum(image_end, size_bytes)]
    start = np.concatenate(([0], stop[:-1]))
    return [out[a:b].tobytes() for a, b in zip(start, stop, strict=True)]


@dataclass
class Scan:
    """One scan: where its data lie, which components it interleaves, and the tables in force."""

    at: tuple[int, int]
    order: list[tuple[int, int, int]]  # component, DC table, AC table of each block of a unit
    tables: dict[int, bytes]
    restart: int
    across: int  # units
    down: int


@dataclass
class Image:
    """What the markers of one file say, and its decoded blocks."""

    status: str = "ok"
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, list[int]] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    n_bytes: int | None = None
    payload_bytes: int | None = None
    coefficients: list[np.ndarray] = field(default_factory=list)  # by component, in scan order
    shapes: list[tuple[int, int, int, int]] = field(default_factory=list)  # by component: units down and across, blocks of a unit down and across

    def units(self, chosen: list[int]) -> tuple[int, int]:
        """Data units of a scan of these components, across and down."""
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(chosen) > 1:
            return -(-self.width // (8 * h)), -(-self.height // (8 * v))
        _, own_h, own_v, _ = self.components[chosen[0]]
        return -(-self.width * own_h // (8 * h)), -(-self.height * own_v // (8 * v))


def scan_end(data: bytes, at: int) -> int:
    """Where the entropy-coded data end: at the next marker that is neither a stuffed byte nor a restart."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
            at += 2
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            return at


def parse(data: bytes) -> Image:
    """Read the markers of a file."""
    im, at, tables, restart = Image(), 2, {}, 0
    if data[:2] != b"\xff\xd8":
        return Image(status="not a JPEG")
    try:
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            if im.scans and data[at + 1] == 0xD9:
                return im
            marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    im.quantisers[body[0] & 15] = list(struct.unpack(">64H" if wide else ">64B", body[1 : 129 if wide else 65]))
                    body = body[129 if wide else 65 :]
            elif marker in (0xC0, 0xC1):
                bits, im.height, im.width, n = struct.unpack(">BHHB", body[:6])
                im.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if bits != 8 or not im.width or not im.height or not 0 < n <= 4 or any(not (c[1] and c[2]) for c in im.components):
                    im.status = "unsupported frame"
                    return im
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                im.status = "not baseline"
                return im
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables = tables | {body[0]: body[1 : 17 + n]}
                    body = body[17 + n :]
            elif marker == 0xDD:
                (restart,) = struct.unpack(">H", body)
            elif marker == 0xFE and body.startswith(_COMMENT) and len(body) == len(_COMMENT) + 16:
                im.n_bytes, im.payload_bytes = struct.unpack_from(">QQ", body, len(_COMMENT))
            elif marker == 0xDA:
                by_id = {c[0]: i for i, c in enumerate(im.components)}
                chosen = [(by_id[body[1 + 2 * i]], body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)) for i in range(body[0])]
                order = []
                for c, dc, ac in chosen:
                    order += [(c, dc, ac)] * (1 if len(chosen) == 1 else im.components[c][1] * im.components[c][2])
                end = scan_end(data, at)
                im.scans.append(Scan((at, end), order, tables, restart, *im.units([c for c, _, _ in chosen])))
                at = end
                if end >= len(data):
                    return im
    except (IndexError, struct.error, KeyError):
        if not im.scans:
            im.status = "truncated"
        return im


_lookups: dict[bytes, np.ndarray] = {}


def lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: code length * 256 + symbol; 0 where no code fits."""
    found = _lookups.get(table)
    if found is None:
        found, code, at = np.zeros(1 << 16, np.int64), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                found[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + table[at]
                code, at = code + 1, at + 1
            code <<= 1
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[table] = found
    return found


@dataclass
class Lanes:
    """Some restart segments of one scan that follow one another."""

    image: Image
    scan: Scan
    raw: np.ndarray  # their bytes
    begins: np.ndarray  # of each, in raw
    counts: np.ndarray  # blocks of each
    into: np.ndarray  # where the coefficients go


def lanes_of(im: Image, scan: Scan, data: bytes) -> Iterator[Lanes]:
    """The scan's segments in groups of about ``SCAN_BYTES``; raises ValueError where restart marks are missing."""
    raw = np.frombuffer(data, np.uint8)[scan.at[0] : scan.at[1]]
    high = np.flatnonzero(raw[:-1] == 0xFF)
    marks = high[(raw[high + 1] >= 0xD0) & (raw[high + 1] <= 0xD7)]
    units, n = scan.across * scan.down, len(scan.order)
    per = scan.restart or units
    segments = -(-units // per)
    if len(marks) != segments - 1:
        raise ValueError("restart marks are missing")
    begins, ends = np.concatenate(([0], marks + 2)), np.concatenate((marks, [len(raw)]))
    counts = np.full(segments, per * n)
    counts[-1] = (units - per * (segments - 1)) * n
    coef = np.zeros((units * n, 64), np.int16)
    of = np.tile(np.array([c for c, _, _ in scan.order]), units)
    for c in {c for c, _, _ in scan.order}:
        im.coefficients[c] = (coef, of == c) if len({*of[:n].tolist()}) > 1 else (coef, None)
    a, done = 0, 0
    while a < segments:
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + SCAN_BYTES, "right")))
        blocks = int(counts[a:b].sum())
        yield Lanes(im, scan, raw[begins[a] : ends[b - 1]], begins[a:b] - begins[a], counts[a:b], coef[done : done + blocks])
        a, done = b, done + blocks


def decode(files: list[bytes]) -> list[Image]:
    """Images with their coefficients (zigzag order, DC absolute), the segments of all scans decoded together in groups."""
    images, group, size = [parse(f) for f in files], [], 0
    for im, data in zip(images, files, strict=True):
        if im.status != "ok":
            continue
        im.coefficients = [None] * len(im.components)
        im.shapes = [(0, 0, 1, 1)] * len(im.components)
        for scan in im.scans:
            chosen = list(dict.fromkeys(c for c, _, _ in scan.order))
            for c in chosen:
                im.shapes[c] = (scan.down, scan.across, 1, 1) if len(chosen) == 1 else (scan.down, scan.across, im.components[c][2], im.components[c][1])
            try:
                for lanes in lanes_of(im, scan, data):
                    group.append(lanes)
                    size += len(lanes.raw)
                    if size >= SCAN_BYTES:
                        decode_lanes(group)
                        group, size = [], 0
            except (ValueError, KeyError):
                im.status = "truncated"
        if any(c is None for c in im.coefficients):
            im.status = "truncated"
    decode_lanes(group)
    for im in images:
        if im.status == "ok":
            im.coefficients = [coef if mask is None else coef[mask] for coef, mask in im.coefficients]
        else:
            im.coefficients = []
    return images


def decode_lanes(group: list[Lanes]) -> None:
    """Decode the segments of a group side by side into their images' coefficients."""
    tables: dict[bytes, int] = {}
    raw, starts, plans, at, plan_at, n_blocks = [], [], [], 0, 0, 0
    some = []
    for lanes in group:
        if lanes.image.status != "ok":
            continue
        held = lanes.scan.tables
        if any(t not in held for _, dc, ac in lanes.scan.order for t in (dc, ac)):
            lanes.image.status = "truncated"
            continue
        plan = [(c, tables.setdefault(held[dc], len(tables)), tables.setdefault(held[ac], len(tables))) for c, dc, ac in lanes.scan.order]
        stuffed = np.zeros(len(lanes.raw), bool)
        stuffed[1:] = (lanes.raw[:-1] == 0xFF) & (lanes.raw[1:] == 0)
        marks = lanes.begins[1:]
        stuffed[marks - 1] = stuffed[marks - 2] = True
        before = np.concatenate(([0], np.cumsum(stuffed)))
        clean = lanes.raw[~stuffed]
        first = np.concatenate(([0], np.cumsum(lanes.counts)))
        n = len(lanes.begins)
        starts.append(np.stack((lanes.begins - before[lanes.begins] + at, n_blocks + first[:-1], lanes.counts, np.full(n, plan_at), np.full(n, len(plan)), np.full(n, len(some)))))
        some.append((lanes, n_blocks))
        raw += [clean, np.zeros(8, np.uint8)]
        plans += plan
        plan_at, at, n_blocks = plan_at + len(plan), at + len(clean) + 8, n_blocks + int(first[-1])
    if not some:
        return
    stream = np.concatenate([*raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(stream) - 5, np.uint64)
    for b in range(5):
        window |= stream[b : len(stream) - 5 + b] << np.uint64(8 * (4 - b))
    window = window.astype(np.int64)
    look = np.concatenate([lookup(t) for t in tables])
    plan_c, plan_dc, plan_ac = (np.array(x, np.int64) for x in zip(*plans, strict=True))
    lane = np.concatenate(starts, axis=1)
    bit, block, left, plan0, plan_n, owner = lane[0] * 8, lane[1].copy(), lane[2].copy(), lane[3], lane[4], lane[5]
    n_lanes, limit = len(bit), (len(window) - 1) * 8
    k, step = np.zeros(n_lanes, np.int64), np.zeros(n_lanes, np.int64)
    coef = np.zeros(n_blocks * 64 + 64, np.int16)
    pred = np.zeros((n_lanes, 4), np.int64)
    bad: set[int] = set()
    alive = np.arange(n_lanes)
    while len(alive):
        is_dc = k == 0
        p = plan0 + step
        which = np.where(is_dc, plan_dc[p], plan_ac[p])
        byte, off = bit >> 3, bit & 7
        w = window[byte]
        entry = look[(which << 16) + ((w >> (24 - off)) & 0xFFFF)]
        symbol, length = entry & 255, entry >> 8
        size = symbol & 15
        value = (w >> (40 - off - length - size)) & ((1 << size) - 1)
        value -= np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), (1 << size) - 1, 0)
        bit = bit + length + size
        d = np.flatnonzero(is_dc)
        if len(d):
            c = plan_c[p[d]]
            pred[d, c] += value[d]
            coef[block[d] * 64] = pred[d, c]
        run = symbol >> 4
        place = np.where(is_dc, 0, k + run)
        put = ~is_dc & (size > 0) & (place < 64)
        coef[(block * 64 + place)[put]] = value[put]
        over = ~is_dc & ((symbol == 0) | (place >= 63))
        k = np.where(over, 0, place + 1)
        block, left = block + over, left - over
        step = np.where(over, (step + 1) % plan_n, step)
        broken = (length == 0) | (bit > limit) | (~is_dc & (place > 63))
        stop = (left == 0) | broken
        if stop.any():
            bad.update(owner[broken].tolist())
            go = ~stop
            alive, bit, block, left, plan0, plan_n, k, step, pred, owner = (x[go] for x in (alive, bit, block, left, plan0, plan_n, k, step, pred, owner))
    for i, (lanes, start) in enumerate(some):
        if i in bad:
            lanes.image.status = "truncated"
        lanes.into[:] = coef[start * 64 : (start + len(lanes.into)) * 64].reshape(-1, 64)


def thumbnail(im: Image) -> np.ndarray:
    """Luminance of each 8x8 block of the first component from its DC coefficient, as uint8 rows."""
    down, across, v, h = im.shapes[0]
    dc = im.coefficients[0][:, 0].astype(np.float64) * im.quantisers[im.components[0][3]][0] / 8 + 128
    dc = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return np.clip(np.rint(dc), 0, 255).astype(np.uint8)


def difference_hash(thumb: np.ndarray) -> str:
    """64 bits as hex: the thumbnail as the means of 8 rows of 9 cells, each cell compared with the next."""
    high, wide = thumb.shape
    total = np.zeros((high + 1, wide + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    (r0, r1), (c0, c1) = (((np.arange(n) * size) // n, np.maximum(-(-(np.arange(n) + 1) * size // n), (np.arange(n) * size) // n + 1)) for n, size in ((8, high), (9, wide)))
    sums = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    cells = sums / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def payload(im: Image) -> bytes:
    """The stored bytes with their zero padding."""
    return im.coefficients[0].astype(np.int8).tobytes()[: im.payload_bytes]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One JPEG file a document: id, media (binary)."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(encode(*ta.buffers(part.column("text"))), pa.binary())], [id_col, "media"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, media binary")


FEATURES = "status string, width int, height int, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(data: bytes | None, im: Image) -> tuple:
    """Values of FEATURES; payload columns are null for files that hold none, all but the media's own for unreadable ones."""
    if data is None:
        return ("null", *[None] * 9)
    own = (len(data), hashlib.sha256(data).hexdigest())
    if im.status != "ok" or im.components[0][3] not in im.quantisers:
        return (im.status if im.status != "ok" else "truncated", None, None, None, None, None, None, *own, None)
    held = (None,) * 4
    if im.payload_bytes is not None:
        body = payload(im)
        held = (im.n_bytes, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-UNIT:]))
    thumb = thumbnail(im)
    return ("ok", im.width, im.height, *held, *own, f"{thumb.shape[1]}x{thumb.shape[0]}:{difference_hash(thumb)}")


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Dimensions, thumbnail hash and payload digests of each file, read back from its bytes."""
    source = media.select(media[id_col].alias("id"), media[media_col].alias("media"))
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    types = [kinds[x.split()[1]] for x in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "media"):
                files = part.column("media").to_pylist()
                rows = [features(f, im) for f, im in zip(files, decode([f or b"" for f in files]), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], [id_col, *names])

    return source.mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, {FEATURES}")
