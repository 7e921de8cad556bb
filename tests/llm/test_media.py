import hashlib
import zlib

import numpy as np
import pytest

from corpusflow.llm import media

from .data import collected, documents, empty, rows


def files_of(blobs):
    return media.encode(np.frombuffer(b"".join(blobs), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in blobs]))).astype(np.int64))


def scalar_decode(data):
    """Coefficients of a one-component file, symbol by symbol."""
    im = media.parse(data)
    (only,) = im.scans
    scan, bits = data[only.at[0] : only.at[1]], []
    segments, now, i = [], bytearray(), 0
    while i < len(scan):
        if scan[i] == 0xFF and scan[i + 1] == 0:
            now.append(0xFF)
            i += 2
        elif scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
            segments.append(bytes(now))
            now = bytearray()
            i += 2
        else:
            now.append(scan[i])
            i += 1
    segments.append(bytes(now))
    codes = {}
    for key, table in only.tables.items():
        code, at, codes[key] = 0, 16, {}
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                codes[key][(length, code)] = table[at]
                code, at = code + 1, at + 1
            code <<= 1
    left, blocks = only.across * only.down, []
    for s in segments:
        bits = "".join(f"{b:08b}" for b in s)
        at, pred = 0, 0

        def take(n):
            nonlocal at
            at += n
            return int(bits[at - n : at] or "0", 2)

        def symbol(table):
            code = 0
            for length in range(1, 17):
                code = code * 2 + take(1)
                if (length, code) in codes[table]:
                    return codes[table][(length, code)]
            raise AssertionError

        def value(size):
            v = take(size)
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(only.restart or left, left)):
            block = [0] * 64
            pred += value(symbol(only.order[0][1]))
            block[0], k = pred, 1
            while k < 64:
                x = symbol(only.order[0][2])
                if x == 0:
                    break
                k += x >> 4
                block[k] = value(x & 15) if x & 15 else 0
                k += 1
            blocks.append(block)
            left -= 1
    assert left == 0
    return blocks


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(2)
    sparse = np.where(rng.random(6400) < 0.02, rng.integers(0, 256, 6400), 0).astype(np.uint8).tobytes()
    return [b"", b"a", bytes(64), b"\xff" * 640, bytes(range(256)) * 5, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), sparse, "é漢🎉 text ".encode() * 40]


def test_round_trip_and_scalar_decoder(blobs):
    for blob, data, im in zip(blobs, files_of(blobs), media.decode(files_of(blobs)), strict=True):
        n = max(1, -(-len(blob) // 64)) * 64
        assert im.status == "ok" and im.n_bytes == len(blob)
        assert media.payload(im) == blob + bytes(n - len(blob))
        assert im.coefficients[0].tolist() == scalar_decode(data)


def test_files_do_not_depend_on_their_neighbours(blobs):
    assert files_of(blobs) == [files_of([b])[0] for b in blobs]


def colour_file(width, height, blocks_by_component, restart=0):
    """A 4:2:0 file whose blocks hold DC values only; blocks_by_component in scan order."""
    lengths = {s: 4 for s in range(12)}
    counts, order, codes = media.canonical(lengths)
    tables = media._segment(0xC4, bytes([0x00, *counts, *order])) + media._segment(0xC4, bytes([0x10, *([1] + [0] * 15), 0]))
    across, down = -(-width // 16), -(-height // 16)
    bits, scan, pred, at = "", b"", [0, 0, 0], [0, 0, 0]

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for m in range(across * down):
        if restart and m and m % restart == 0:
            scan += flush(bits) + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, pred = "", [0, 0, 0]
        for c, n in ((0, 4), (1, 1), (2, 1)):
            for _ in range(n):
                v = blocks_by_component[c][at[c]]
                at[c] += 1
                d, pred[c] = v - pred[c], v
                size = abs(d).bit_length()
                code, length = codes[size]
                bits += f"{code:0{length}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"
    scan += flush(bits)
    frame = media._segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([4] * 64)) + frame + tables
    if restart:
        head += media._segment(0xDD, restart.to_bytes(2, "big"))
    return head + media._segment(0xDA, bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 63, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_colour_thumbnail(restart):
    rng = np.random.default_rng(restart)
    luma, other = rng.integers(-200, 200, 6 * 4), rng.integers(-200, 200, 6)
    (im,) = media.decode([colour_file(40, 30, [luma.tolist(), other.tolist(), other.tolist()], restart)])
    assert im.status == "ok"
    thumb = media.thumbnail(im)
    expected = np.zeros((4, 6))
    for m in range(6):
        y, x = divmod(m, 3)
        expected[2 * y : 2 * y + 2, 2 * x : 2 * x + 2] = luma[4 * m : 4 * m + 4].reshape(2, 2)
    assert np.array_equal(thumb, np.clip(np.rint(expected * 4 / 8 + 128), 0, 255))


def planar_file(width, height, planes, h=2, v=2):
    """A file of three scans, one for each component; planes hold the DC values of the components' own blocks."""
    lengths = {s: 4 for s in range(12)}
    counts, order, codes = media.canonical(lengths)
    tables = media._segment(0xC4, bytes([0x00, *counts, *order])) + media._segment(0xC4, bytes([0x10, *([1] + [0] * 15), 0]))
    out = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([4] * 64))
    out += media._segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, h * 16 + v, 0, 2, 0x11, 0, 3, 0x11, 0])) + tables
    for c, plane in enumerate(planes):
        bits, pred = "", 0
        for value in plane:
            d, pred = value - pred, value
            size = abs(d).bit_length()
            code, length = codes[size]
            bits += f"{code:0{length}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"
        bits += "1" * (-len(bits) % 8)
        scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        out += media._segment(0xDA, bytes([1, c + 1, 0x00, 0, 63, 0])) + scan
    return out + b"\xff\xd9"


def test_one_scan_for_each_component():
    rng = np.random.default_rng(6)
    luma, other = rng.integers(-200, 200, 5 * 4), rng.integers(-200, 200, 3 * 2)
    (im,) = media.decode([planar_file(40, 30, [luma.tolist(), other.tolist(), other.tolist()])])
    assert im.status == "ok" and [c[:, 0].tolist() for c in im.coefficients] == [luma.tolist(), other.tolist(), other.tolist()]
    assert np.array_equal(media.thumbnail(im), np.clip(np.rint(luma.reshape(4, 5) * 4 / 8 + 128), 0, 255))
    (cut,) = media.decode([planar_file(40, 30, [luma.tolist(), other.tolist()])])
    assert cut.status == "truncated"


def test_every_cell_reaches_the_hash():
    thumb = np.full((40, 45), 100, np.uint8)
    flat = media.difference_hash(thumb)
    assert flat == "0" * 16
    for y, x in ((0, 5), (3, 8), (39, 44), (17, 21)):
        other = thumb.copy()
        other[y, x] = 200
        assert media.difference_hash(other) != flat or x < 5
    assert len(media.difference_hash(np.zeros((1, 1), np.uint8))) == 16


@pytest.mark.parametrize("size", [media.RUN_BYTES - 1, media.RUN_BYTES, media.RUN_BYTES + 1, 3 * media.RUN_BYTES + 4097])
def test_long_texts_are_coded_in_runs(monkeypatch, size):
    blob = (b"Some prose, then 12345 and \xc3\xa9. " * (size // 20))[:size]
    (data,) = files_of([blob])
    monkeypatch.setattr(media, "RUN_BYTES", 1 << 40)
    assert files_of([blob]) == [data]
    (im,) = media.decode([data])
    monkeypatch.setattr(media, "SCAN_BYTES", 5000)
    (same,) = media.decode([data])
    assert np.array_equal(im.coefficients[0], same.coefficients[0])
    assert media.payload(im) == blob + bytes(-size % 64)


def test_bad_files_get_a_status():
    good = files_of([b"hello" * 100])[0]
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    for data, status in ((b"", "not a JPEG"), (b"GIF89a", "not a JPEG"), (good[:40], "truncated"), (progressive, "not baseline"), (good[: len(good) // 2], "truncated")):
        (im,) = media.decode([data])
        assert im.status == status
        assert media.features(data, im)[0] == status


def test_query_rows(spark):
    got = collected(media.media_features(media.store(documents(spark))))
    expected = []
    for r in rows():
        b = (r[1] or "").encode()
        p = b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))
        f = files_of([b])[0]
        expected.append((r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest()))
    assert sorted(((r[0], *r[4:10]) for r in got), key=repr) == sorted(expected, key=repr)


def test_empty(spark):
    assert media.media_features(media.store(empty(spark))).count() == 0
