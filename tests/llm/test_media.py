"""The JPEG reader against an independent general writer, and exact round trips of payloads."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyfix.llm import jpeg, media


class Writer:
    """Huffman-codes any coefficients with zero runs, ended blocks and refinement; all codes are 8 bits long."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(s, 9)

    def number(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        self.bits = []
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def table(kind):
    # 256 codes of 9 bits: the code of a symbol is the symbol
    return jpeg._segment(jpeg.DHT, bytes([kind]) + bytes([0] * 8 + [255] + [0] * 7) + bytes(range(255)))


def toward_zero(v, shift):
    return int(np.sign(v)) * (abs(int(v)) >> shift)


def blocks_in_order(c, shape, interleaved, h, v):
    down, across = shape
    if not interleaved:
        return [(y, x) for y in range(down) for x in range(across)]
    return [(my * v + y, mx * h + x) for my in range(down // v) for mx in range(across // h) for y in range(v) for x in range(h)]


def ac_first(w, blocks, low, high, shift):
    ended = 0

    def flush(n):
        while n:
            k = min(n.bit_length() - 1, 14)
            w.symbol(k << 4)
            w.put(min(n, (1 << k + 1) - 1) - (1 << k), k)
            n -= min(n, (1 << k + 1) - 1)

    for block in blocks:
        values = [toward_zero(block[k], shift) for k in range(low, high + 1)]
        last = max((i for i, x in enumerate(values) if x), default=-1)
        if last < 0:
            ended += 1
            continue
        flush(ended)
        ended, run = 0, 0
        for x in values[: last + 1]:
            if not x:
                run += 1
                continue
            while run > 15:
                w.symbol(0xF0)
                run -= 16
            w.symbol(run << 4 | abs(x).bit_length())
            w.number(x)
            run = 0
        if last < len(values) - 1:
            ended = 1
    flush(ended)


def ac_refine(w, blocks, low, high, shift):
    for block in blocks:
        known = [toward_zero(block[k], shift + 1) for k in range(low, high + 1)]
        now = [toward_zero(block[k], shift) for k in range(low, high + 1)]
        fresh = [i for i in range(len(now)) if now[i] and not known[i]]
        last = fresh[-1] if fresh else -1
        run, fixes = 0, []
        for i in range(last + 1):
            if known[i]:
                fixes.append(abs(now[i]) & 1)
            elif now[i]:
                w.symbol(run << 4 | 1)
                w.put(int(now[i] > 0), 1)
                w.bits += fixes
                run, fixes = 0, []
            else:
                run += 1
                if run == 16:
                    w.symbol(0xF0)
                    w.bits += fixes
                    run, fixes = 0, []
                    # a run of sixteen zeros ends at the sixteenth
        rest = [abs(now[i]) & 1 for i in range(last + 1, len(now)) if known[i]]
        if last < len(now) - 1:
            w.symbol(0x00)
            w.bits += fixes + rest


def encode(coefs, width, height, sampling, restart=0):
    """coefs: per component an array (blocks down, across, 64) in zigzag order."""
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(coefs)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    out = [b"\xff\xd8", jpeg._segment(jpeg.DQT, bytes([0, *range(1, 65)])), jpeg._segment(jpeg.SOF2, frame), table(0x00), table(0x10)]
    if restart:
        out.append(jpeg._segment(jpeg.DRI, restart.to_bytes(2, "big")))
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    units = -(-width // (8 * hmax)) * -(-height // (8 * vmax))
    w, ids = Writer(), range(1, len(coefs) + 1)

    def dc(first):
        body, last = b"", dict.fromkeys(ids, 0)
        order = {i: blocks_in_order(c, c.shape[:2], True, *sampling[i - 1]) for i, c in zip(ids, coefs, strict=True)}
        single = len(coefs) == 1
        for u in range(units):
            if restart and u and u % restart == 0:
                body += w.done() + bytes([0xFF, 0xD0 + (u // restart - 1) % 8])
                last = dict.fromkeys(ids, 0)
            for i in ids:
                h, v = sampling[i - 1]
                n = 1 if single else h * v
                for y, x in order[i][u * n : (u + 1) * n]:
                    value = int(coefs[i - 1][y, x, 0])
                    if first:
                        d = (value >> 1) - last[i]
                        last[i] = value >> 1
                        w.symbol(abs(d).bit_length())
                        w.number(d)
                    else:
                        w.put(value & 1, 1)
        return body + w.done()

    out += [jpeg._sos(list(ids), 0, 0, 0, 1), dc(True), jpeg._sos(list(ids), 0, 0, 1, 0), dc(False)]
    for low, high in ((1, 5), (6, 63)):
        for write, before, shift in ((ac_first, 0, 1), (ac_refine, 1, 0)):
            for i, c in zip(ids, coefs, strict=True):
                h, v = sampling[i - 1]
                rows, cols = -(-(-(-height * v // vmax)) // 8), -(-(-(-width * h // hmax)) // 8)
                blocks = [c[y, x] for y in range(rows) for x in range(cols)]
                step, body = restart or len(blocks), b""
                for k in range(0, len(blocks), step):
                    if k:
                        body += bytes([0xFF, 0xD0 + (k // step - 1) % 8])
                    write(w, blocks[k : k + step], low, high, shift)
                    body += w.done()
                out += [jpeg._sos([i], low, high, before, shift), body]
    return b"".join([*out, b"\xff\xd9"])


def random_image(rng, width, height, sampling):
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    coefs = []
    for h, v in sampling:
        c = np.where(rng.random((down * v, across * h, 64)) < 0.15, rng.integers(-60, 60, (down * v, across * h, 64)), 0)
        c[..., 0] = rng.integers(-200, 200, c.shape[:2])
        rows, cols = -(-(-(-height * v // vmax)) // 8), -(-(-(-width * h // hmax)) // 8)
        c[rows:, :, 1:] = 0  # blocks outside the picture have no AC scans
        c[:, cols:, 1:] = 0
        coefs.append(c)
    return coefs


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 2])
def test_coefficients_of_any_progressive_image(sampling, restart):
    rng = np.random.default_rng(1)
    for width, height in ((8, 8), (33, 50), (64, 17)):
        coefs = random_image(rng, width, height, sampling)
        image = jpeg.decode_coefficients(encode(coefs, width, height, sampling, restart))
        for c, wanted in zip(image.components, coefs, strict=True):
            assert (c.coef == wanted).all()


def test_samples_match_the_transform_written_out():
    rng = np.random.default_rng(2)
    sampling = [(2, 2), (1, 1), (1, 1)]
    coefs = random_image(rng, 20, 19, sampling)
    rgb = jpeg.samples(jpeg.decode_coefficients(encode(coefs, 20, 19, sampling)))
    assert rgb.shape == (19, 20, 3)
    # the order of coefficients, walked along the diagonals
    path, y, x = [], 0, 0
    for _ in range(64):
        path.append((y, x))
        if (y + x) % 2 == 0:
            y, x = (y + 1, x) if x == 7 else (y, x + 1) if y == 0 else (y - 1, x + 1)
        else:
            y, x = (y, x + 1) if y == 7 else (y + 1, x) if x == 0 else (y + 1, x - 1)
    for py, px in ((0, 0), (7, 9), (18, 19), (12, 3)):
        ycc = []
        for c, (h, v) in zip(coefs, sampling, strict=True):
            sy, sx = py * v // 2, px * h // 2
            total = 0.0
            for k, (fy, fx) in enumerate(path):
                scale = (np.sqrt(0.125) if fy == 0 else 0.5) * (np.sqrt(0.125) if fx == 0 else 0.5)
                total += scale * c[sy // 8, sx // 8, k] * (k + 1) * np.cos((2 * (sy % 8) + 1) * fy * np.pi / 16) * np.cos((2 * (sx % 8) + 1) * fx * np.pi / 16)
            ycc.append(min(255, max(0, round(total) + 128)))
        lum, cb, cr = ycc[0], ycc[1] - 128, ycc[2] - 128
        wanted = [lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb]
        assert np.abs(rgb[py, px].astype(int) - np.clip(np.rint(wanted), 0, 255)).max() <= 1


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_payload_round_trip(raw):
    payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
    image = jpeg.decode_coefficients(jpeg.encode_payload(payload))
    assert jpeg.read_payload(image) == payload


def test_the_slow_path_reads_what_the_fast_path_reads(monkeypatch):
    stored = jpeg.encode_payload(bytes(range(256)) * 5)
    fast = jpeg.decode_coefficients(stored)
    monkeypatch.setattr(jpeg, "uniform", lambda *a: None)
    slow = jpeg.decode_coefficients(stored)
    for a, b in zip(fast.components, slow.components, strict=True):
        assert (a.coef == b.coef).all()


def test_digest_and_tensors(spark):
    texts = [(1, None), (2, ""), (3, "é" * 400), (4, "x" * 576), (5, "y" * 577), (None, "x" * 576), (6, "long " * 20_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in media.media_digest(media.encode_media(docs)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[4][1:] == got[None][1:]
    stored = media.encode_media(docs)
    tensors = {r.doc_id: r for r in media.rgb_tensors(stored).collect()}
    assert all(len(r.rgb) == r.height * r.width * 3 for r in tensors.values())
    broken = spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, media binary")
    assert all(r.rgb is None for r in media.rgb_tensors(broken).collect())
    assert media.media_digest(media.encode_media(docs.limit(0))).count() == 0
