"""Progressive JPEG: a decoder for any 8-bit Huffman-coded progressive image, and a writer that
stores bytes losslessly in quantised coefficients.

Decoding accumulates every scan (spectral selection and successive approximation) into one array of
coefficients per component. A scan whose codes and extra bits all have one width is read at once
as a matrix of bits; correction bits of a run of ended blocks are read at once too; any other
stream is read symbol by symbol. Then numpy inverse-transforms the blocks, repeats chroma to full
resolution and converts to RGB.

The writer's unit is the AC coefficient: byte b is stored as 256 + b, 63 bytes a block, in 4:2:0
order (luma blocks, then the two chroma planes). A comment segment names the payload's length.
"""

from __future__ import annotations

import re

import numpy as np

_ZIGZAG = sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8))
ZIGZAG = np.array(_ZIGZAG)

SOI, EOI, SOS, DQT, DHT, DRI, COM, SOF2 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xFE, 0xC2


class JpegError(ValueError):
    pass


# ---------------------------------------------------------------- bits


class Bits:
    """A cursor over a 0/1 array; reading past the end gives zeros, as padding."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.at = bits, 0

    def take(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        self.at += n
        return out if len(out) == n else np.concatenate([out, np.zeros(n - len(out), np.uint8)])

    def number(self, n: int) -> int:
        out = 0
        for b in self.take(n).tolist():
            out = out << 1 | b
        return out

    def symbol(self, table: Huffman) -> int:
        code = 0
        for n, b in enumerate(self.take(16).tolist(), 1):
            code = code << 1 | b
            if (s := table.symbols.get((n, code))) is not None:
                self.at -= 16 - n
                return s
        raise JpegError("no such Huffman code")


class Huffman:
    def __init__(self, counts: bytes, values: bytes):
        self.symbols: dict[tuple[int, int], int] = {}
        self.codes: dict[int, tuple[int, int]] = {}
        code, k = 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                self.symbols[n, code] = values[k]
                self.codes[values[k]] = (n, code)
                code, k = code + 1, k + 1
            code <<= 1


#: What was built last, by its parameters (a cache that travels with the code to the workers).
_BUILT: dict = {}


def _built(key: tuple, make):
    if key not in _BUILT:
        if len(_BUILT) > 256:
            _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]


def _huffman(counts: bytes, values: bytes) -> Huffman:
    return _built((counts, values), lambda: Huffman(counts, values))


def extend(v: int, s: int) -> int:
    return v if not s or v >> (s - 1) else v - (1 << s) + 1


def uniform(bits: np.ndarray, table: Huffman, n: int, most_size: int, ac: bool) -> np.ndarray | None:
    """n values, if the stream is n times one and the same symbol (without a zero run) and its extra bits."""
    head = Bits(bits[:16])
    try:
        symbol = head.symbol(table)
    except JpegError:
        return None
    size, width = symbol & 15, head.at
    if symbol >> 4 or size > most_size or ac and not size:
        return None
    stride = width + size
    if not 0 <= len(bits) - n * stride < 8:
        return None
    rows = bits[: n * stride].reshape(n, stride)
    if (rows[:, :width] != rows[0, :width]).any():
        return None
    if not size:
        return np.zeros(n, np.int32)
    v = rows[:, width:] @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32)).astype(np.int32)
    return v if rows[:, width].all() else np.where(rows[:, width] == 1, v, v - (1 << size) + 1)


# ---------------------------------------------------------------- frames and scans


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant


class Image:
    """Headers, then coefficient arrays (blocks down, blocks across, 64 in zigzag order)."""

    def __init__(self):
        self.comment = b""
        self.quant: dict[int, np.ndarray] = {}
        self.components: list[Component] = []
        self.width = self.height = self.restart = 0

    def start(self, body: bytes) -> None:
        if body[0] != 8:
            raise JpegError("8-bit samples only")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        for i in range(body[5]):
            c, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.components.append(Component(c, hv >> 4, hv & 15, q))
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components:
            c.cols, c.rows = -(-(-(-self.width * c.h // self.hmax)) // 8), -(-(-(-self.height * c.v // self.vmax)) // 8)
            c.coef = np.zeros((self.down * c.v, self.across * c.h, 64), np.int32)

    def order(self, parts: list[Component]) -> list[tuple[Component, np.ndarray]]:
        """For each block of a unit, its component and the block's number in every unit."""
        if len(parts) == 1:
            c = parts[0]
            return [(c, _blocks(c.rows, c.cols, 1, 1, 0, 0, self.across * c.h))]
        return [(c, _blocks(self.down, self.across, c.v, c.h, y, x, self.across * c.h)) for c in parts for y in range(c.v) for x in range(c.h)]


def _blocks(down: int, across: int, v: int, h: int, y: int, x: int, full: int) -> np.ndarray:
    make = lambda: ((np.arange(down) * v + y)[:, None] * full + np.arange(across) * h + x).ravel()
    return _built((down, across, v, h, y, x, full), make) if down * across < 10_000 else make()


_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _segments(data: bytes, restart: bool) -> list[np.ndarray]:
    """Bits of each restart interval, without stuffing (a stuffed 255 is never followed by a restart code)."""
    return [np.unpackbits(np.frombuffer(x.replace(b"\xff\x00", b"\xff"), np.uint8)) for x in (_RESTART.split(data) if restart else [data])]


def _entropy_end(data: bytes, at: int) -> int:
    found = _END.search(data, at)
    return found.start() if found else len(data)


def decode_coefficients(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG")
    image, tables, at = Image(), {}, 2
    while at + 3 < len(data):
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at] != 0xFF:
            raise JpegError("marker expected")
        if marker == EOI:
            break
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                image.quant[body[0] & 15] = values.astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == DRI:
            image.restart = int.from_bytes(body[:2], "big")
        elif marker == COM:
            image.comment = body
        elif marker == SOF2:
            image.start(body)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise JpegError("progressive Huffman images only")
        elif marker == SOS:
            end = _entropy_end(data, at)
            _scan(image, tables, body, data[at:end])
            at = end
    if data[at : at + 2] != b"\xff\xd9":
        raise JpegError("the stream is cut")
    return image


def _scan(image: Image, tables: dict[int, Huffman], head: bytes, data: bytes) -> None:
    n = head[0]
    by_id = {c.ident: c for c in image.components}
    parts = [by_id[head[1 + 2 * i]] for i in range(n)]
    of = {id(c): head[2 + 2 * i] for i, c in enumerate(parts)}
    low, high, approx = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n]
    before, shift = approx >> 4, approx & 15
    order = image.order(parts)
    units = len(order[0][1])
    step = image.restart or units
    for i, bits in enumerate(_segments(data, bool(image.restart))):
        first, last = i * step, min(units, (i + 1) * step)
        if first >= last:
            break
        own = [(c, blocks[first:last]) for c, blocks in order]
        if low == 0 and before == 0:
            _dc_first(own, bits, [tables[of[id(c)] >> 4] for c, _ in own], shift)
        elif low == 0:
            _dc_refine(own, bits, shift)
        else:
            c, blocks = own[0]
            flat, table = c.coef.reshape(-1, 64), tables[0x10 | of[id(c)] & 15]
            (_ac_refine if before else _ac_first)(flat, blocks, Bits(bits), table, low, high, shift)


def _dc_first(own, bits: np.ndarray, tables: list[Huffman], shift: int) -> None:
    units, k = len(own[0][1]), len(own)
    diffs = uniform(bits, tables[0], units * k, 11, False) if all(t is tables[0] for t in tables) else None
    if diffs is None:
        cursor = Bits(bits)
        diffs = np.zeros(units * k, np.int64)
        for i in range(units * k):
            size = cursor.symbol(tables[i % k])
            diffs[i] = extend(cursor.number(size), size)
    if not diffs.any():
        return
    diffs = diffs.reshape(units, k)
    for c in {id(c): c for c, _ in own}.values():
        mine = [j for j, (x, _) in enumerate(own) if x is c]
        values = np.cumsum(diffs[:, mine].ravel()).reshape(units, len(mine)) << shift
        for j, m in enumerate(mine):
            c.coef.reshape(-1, 64)[own[m][1], 0] = values[:, j]


def _dc_refine(own, bits: np.ndarray, shift: int) -> None:
    units, k = len(own[0][1]), len(own)
    bit = Bits(bits).take(units * k)
    if not bit.any():
        return
    bit = bit.reshape(units, k).astype(np.int32) << shift
    for j, (c, blocks) in enumerate(own):
        c.coef.reshape(-1, 64)[blocks, 0] |= bit[:, j]


def _ac_first(flat, blocks, cursor: Bits, table: Huffman, low: int, high: int, shift: int) -> None:
    band = high - low + 1
    values = uniform(cursor.bits, table, len(blocks) * band, 10, True)
    if values is not None:
        flat[blocks, low : high + 1] = values.reshape(-1, band) << shift
        return
    ended = 0
    for b in blocks.tolist():
        if ended:
            ended -= 1
            continue
        k = low
        while k <= high:
            symbol = cursor.symbol(table)
            run, size = symbol >> 4, symbol & 15
            if size:
                k += run
                flat[b, k] = extend(cursor.number(size), size) << shift
                k += 1
            elif run == 15:
                k += 16
            else:
                ended = (1 << run) + cursor.number(run) - 1
                break


def _correct(flat, rows, cols: slice, cursor: Bits, shift: int) -> None:
    """One correction bit for every coefficient that is not zero, in order."""
    part = flat[rows, cols]
    if part.size and part.min() > 0:
        flat[rows, cols] = part + (cursor.take(part.size).reshape(part.shape).astype(np.int32) << shift)
        return
    on = part != 0
    bit = np.zeros(part.shape, np.int32)
    bit[on] = cursor.take(int(on.sum()))
    flat[rows, cols] = part + np.where(part > 0, bit, -bit) * (1 << shift)


def _ac_refine(flat, blocks, cursor: Bits, table: Huffman, low: int, high: int, shift: int) -> None:
    i = 0
    while i < len(blocks):
        b, k, ended = int(blocks[i]), low, 0
        while k <= high:
            symbol = cursor.symbol(table)
            run, value = symbol >> 4, 0
            if symbol & 15:
                value = (1 if cursor.number(1) else -1) << shift
            elif run < 15:
                ended = (1 << run) + cursor.number(run)
                break
            while k <= high:
                c = int(flat[b, k])
                if c:
                    flat[b, k] = c + (((1 if c > 0 else -1) << shift) if cursor.number(1) else 0)
                elif run:
                    run -= 1
                else:
                    flat[b, k] = value
                    k += 1
                    break
                k += 1
        if not ended:
            i += 1
            continue
        if k > low:  # the rest of a block that has begun
            _correct(flat, blocks[i : i + 1], slice(k, high + 1), cursor, shift)
            i, ended = i + 1, ended - 1
        if ended:
            _correct(flat, blocks[i : i + ended], slice(low, high + 1), cursor, shift)
            i += ended


# ---------------------------------------------------------------- samples


def _basis() -> np.ndarray:
    """Row k: the samples that zigzag coefficient k adds to a block."""
    x = np.arange(8)
    wave = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    wave[0] /= np.sqrt(2)
    return np.einsum("vy,ux->vuyx", wave, wave).reshape(64, 64)[ZIGZAG]


_BASIS = _basis()
# YCbCr to RGB.
_RED, _GREEN_CB, _GREEN_CR, _BLUE = 1.402, 0.344136, 0.714136, 1.772


def samples(image: Image) -> np.ndarray:
    """Full-resolution RGB (or one grey plane thrice), height by width by 3, uint8."""
    planes = []
    for c in image.components:
        down, across, _ = c.coef.shape
        flat = c.coef.reshape(-1, 64) @ (image.quant[c.quant][:, None] * _BASIS)
        plane = flat.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
        plane = np.rint(plane, out=plane)
        plane += 128
        np.clip(plane, 0, 255, out=plane)
        if (c.v, c.h) != (image.vmax, image.hmax):
            plane = plane.repeat(image.vmax // c.v, axis=0).repeat(image.hmax // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    y = planes[0]
    out = np.empty((*y.shape, 3), np.uint8)
    if len(planes) == 1:
        out[...] = y[..., None]
        return out
    cb, cr = planes[1] - 128, planes[2] - 128
    for k, plane in enumerate((y + _RED * cr, y - _GREEN_CB * cb - _GREEN_CR * cr, y + _BLUE * cb)):
        out[..., k] = np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
    return out


# ---------------------------------------------------------------- writer

_AC = bytes([1, 1, *[0] * 14]), bytes([0x08, 0x00])
_DC = bytes([1, 1, *[0] * 14]), bytes([0, 1])
_ENDS = bytes([0, 0, 0, 15, *[0] * 12]), bytes(n << 4 for n in range(15))
_LONGEST = (1 << 15) - 1


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _entropy(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    if pad:
        bits = np.concatenate([bits, np.ones(pad, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _sos(parts: list[int], low: int, high: int, before: int, shift: int) -> bytes:
    return _segment(SOS, bytes([len(parts), *(x for p in parts for x in (p, 0)), low, high, before << 4 | shift]))


_TABLES = _segment(DQT, bytes([0, *[1] * 64])) + _segment(DHT, bytes([0x00]) + _DC[0] + _DC[1])
_FIRST_AC = _segment(DHT, bytes([0x10]) + _AC[0] + _AC[1])
_LATER_AC = _segment(DHT, bytes([0x10]) + _ENDS[0] + _ENDS[1])
#: Scans of the AC coefficients: component, band.
_BANDS = ((1, 1, 5), (2, 1, 63), (3, 1, 63), (1, 6, 63))


def _value_bits(v: np.ndarray) -> np.ndarray:
    """9 bits for each value of 128..255: the code 0 and 8 extra bits."""
    return np.unpackbits(v.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 7:].ravel()


def _correction_bits(bit: np.ndarray) -> np.ndarray:
    """Runs of ended blocks, each with one correction bit for every coefficient of the band."""
    out = []
    for i in range(0, len(bit), _LONGEST):
        own = bit[i : i + _LONGEST]
        n = len(own).bit_length() - 1
        head = n << n | (len(own) - (1 << n))
        out += [np.array([head >> j & 1 for j in range(3 + n, -1, -1)], np.uint8), own.ravel()]
    return np.concatenate(out)


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 image whose AC coefficients hold the payload."""
    units = max(1, -(-len(payload) // (6 * 63)))
    across = min(4095, int(np.ceil(np.sqrt(units))))
    down = -(-units // across)
    units = across * down
    data = np.full(units * 6 * 63, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, 63)
    planes = {1: data[: 4 * units], 2: data[4 * units : 5 * units], 3: data[5 * units :]}
    frame = bytes([8]) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    zero = _entropy(np.zeros(units * 6, np.uint8))
    out = [b"\xff\xd8", _segment(COM, b"payload %d" % len(payload)), _TABLES, _segment(SOF2, frame), _FIRST_AC, _sos([1, 2, 3], 0, 0, 0, 1), zero]
    for c, low, high in _BANDS:
        out += [_sos([c], low, high, 0, 1), _entropy(_value_bits(128 + (planes[c][:, low - 1 : high] >> 1).ravel()))]
    out += [_sos([1, 2, 3], 0, 0, 1, 0), zero, _LATER_AC]
    for c in (1, 2, 3):
        out += [_sos([c], 1, 63, 1, 0), _entropy(_correction_bits(planes[c] & 1))]
    return b"".join([*out, b"\xff\xd9"])


def read_payload(image: Image) -> bytes:
    n = int(image.comment.split()[1])
    values = np.concatenate([c.coef[:, :, 1:].reshape(-1) for c in image.components])[:n]
    if len(values) != n or ((values < 256) | (values > 511)).any():
        raise JpegError("coefficients hold no payload")
    return (values - 256).astype(np.uint8).tobytes()
