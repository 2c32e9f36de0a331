"""Progressive JPEG columns: decode to coefficient arrays scan by scan, then to full-resolution RGB tensors.

decode_coefficients() accumulates spectral-selection and successive-approximation scans of any Huffman-coded progressive
JPEG (8 bits, any sampling, interleaved or not, restarts) into one array of quantised coefficients per component.
to_rgb() multiplies by the quantiser, inverse-transforms in numpy with an integer basis (exact, so equal everywhere),
upsamples chroma and converts to RGB. encode_image() writes pictures as progressive JPEG.

Bytes are stored losslessly in the format's own unit, the quantised coefficient: 64 bytes are one 8x8 block. A byte b is
the coefficient with b as the extra bits of category 8 (b, or b - 255 below 128; for the first coefficient b - 254), so in
the first scans each coefficient takes one byte and in the refining scans one bit; numpy then codes and decodes a
whole scan at once. Scans that aren't of this kind are decoded symbol by symbol. The blocks fill a 4:2:0 picture, Y, Cb, Cr.

Defined cases: a null or empty text is a payload of 64 zero bytes; rows are independent, so repeated rows give equal
values; a null doc_id is kept; an empty table gives no rows; other columns are ignored. Memory: some 40 bytes for each
byte of the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

#: Zigzag order, from its rule: diagonals of falling and rising direction by turns.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_k = np.arange(8)
_COS = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k == 0, np.sqrt(0.125), 0.5)[:, None]
_SHIFT = 1 << 14
#: Row z: what the coefficient at zigzag place z adds to the 64 samples, in units of 1 / _SHIFT.
_BASIS = np.rint(np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG] * _SHIFT)


@dataclass
class Component:
    h: int
    v: int
    quant: int
    rows: int = 0  # blocks of the whole grid, with what fills the last units
    cols: int = 0
    own_rows: int = 0  # blocks that scans of this component alone have
    own_cols: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Picture:
    width: int
    height: int
    parts: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""


def huffman(counts: list[int], symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, by the canonical rule."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class Bits:
    """A reader of one restart interval (stuffing removed); past its end it gives zeros, as many as one interval can need."""

    def __init__(self, data: np.ndarray):
        self.bits, self.at = np.unpackbits(data).tolist(), 0

    def bit(self) -> int:
        self.at += 1
        if self.at > len(self.bits) + 4096:
            raise ValueError("the scan ends early")
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 0

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")


def extend(v: int, n: int) -> int:
    return v if not n or v >= 1 << (n - 1) else v - (1 << n) + 1


def unstuff(data: np.ndarray) -> np.ndarray:
    ff = np.flatnonzero(data[:-1] == 0xFF)
    return np.delete(data, ff[data[ff + 1] == 0] + 1)


def stuff(data: np.ndarray) -> np.ndarray:
    return np.insert(data, np.flatnonzero(data == 0xFF) + 1, 0)


@dataclass
class Scan:
    parts: list[Component]
    dc: list[dict]
    ac: list[dict]
    first: int
    last: int
    high: int
    low: int
    restart: int


def _fast(scan: Scan, data: np.ndarray) -> bool:
    """Whole-array decoding of scans in which every coefficient takes a fixed place. False: not such a scan."""
    if len(scan.parts) > 1:
        return False
    part = scan.parts[0]
    if (part.own_rows, part.own_cols) != (part.rows, part.cols):
        return False
    n, band = part.rows * part.cols, slice(scan.first, scan.last + 1)
    if not scan.high:
        table = scan.ac[0] if scan.first else scan.dc[0]
        size = table.get((1, 0), 0)
        if size != 7 or len(table) != 1:
            return False
        if scan.first:
            if scan.restart or len(data) != n * (scan.last - scan.first + 1) or (data >= 0x80).any():
                return False
            value = data.reshape(n, -1).astype(np.int32)
        else:
            if scan.restart != 1 or len(data) != 3 * n - 2 or (data[1::3] != 0xFF).any() or (data[2::3] != 0xD0 + np.arange(n - 1) % 8).any() or (data[::3] >= 0x80).any():
                return False
            value = data[::3, None].astype(np.int32)
        value = np.where(value < 64, value - 127, value)
        part.coef[:, band] = value * (1 << scan.low)
        return True
    if scan.restart:
        return False
    if not scan.first:
        bits = np.unpackbits(unstuff(data))
        if len(bits) < n:
            return False
        part.coef[:, 0] |= bits[:n].astype(np.int32) << scan.low
        return True
    had = part.coef[:, band]
    if not had.all():
        return False
    bits = np.unpackbits(unstuff(data))
    at, block, width, more = 0, 0, had.shape[1], np.empty(had.shape, dtype=np.int32)
    while block < n:  # one turn for up to 32767 blocks
        length = code = 0
        while (length, code) not in scan.ac[0]:
            if length == 16 or at >= len(bits):
                return False
            code, length, at = code << 1 | int(bits[at]), length + 1, at + 1
        symbol = scan.ac[0][length, code]
        if symbol & 15 or symbol >> 4 == 15:
            return False
        extra = symbol >> 4
        run = (1 << extra) + int("".join(map(str, bits[at : at + extra])) or "0", 2)
        at += extra
        run = min(run, n - block)
        if at + run * width > len(bits):
            return False
        more[block : block + run] = bits[at : at + run * width].reshape(run, width)
        at, block = at + run * width, block + run
    part.coef[:, band] = had + np.where(had > 0, more, -more) * (1 << scan.low)
    return True


def _block(scan: Scan, k: int, bits: Bits, x: np.ndarray, state: dict) -> None:
    """One block of a scan, symbol by symbol; x: its coefficients."""
    low = 1 << scan.low
    if scan.first == 0:
        if scan.high:
            x[0] |= bits.bit() << scan.low
        else:
            n = bits.symbol(scan.dc[k])
            state["dc"][k] += extend(bits.take(n), n)
            x[0] = state["dc"][k] * low
        return
    at = scan.first
    if not scan.high:
        if state["eob"]:
            state["eob"] -= 1
            return
        while at <= scan.last:
            run, n = divmod(bits.symbol(scan.ac[k]), 16)
            if n:
                at += run
                x[at] = extend(bits.take(n), n) * low
                at += 1
            elif run == 15:
                at += 16
            else:
                state["eob"] = (1 << run) - 1 + bits.take(run)
                return
        return

    def refine(i: int) -> None:
        if bits.bit() and not x[i] & low if x[i] > 0 else bits.bit() and not -x[i] & low:
            x[i] += low if x[i] > 0 else -low

    if not state["eob"]:
        while at <= scan.last:
            run, n = divmod(bits.symbol(scan.ac[k]), 16)
            value = 0
            if n:
                value = low if bits.bit() else -low
            elif run < 15:
                state["eob"] = (1 << run) + bits.take(run)
                break
            while at <= scan.last:
                if x[at]:
                    refine(at)
                elif run:
                    run -= 1
                else:
                    break
                at += 1
            if value and at <= scan.last:
                x[at] = value
            at += 1
    if state["eob"]:
        for i in range(at, scan.last + 1):
            if x[i]:
                refine(i)
        state["eob"] -= 1


def _slow(scan: Scan, data: np.ndarray, units: int, per_row: int) -> None:
    ff = np.flatnonzero(data[:-1] == 0xFF)
    cuts = ff[(data[ff + 1] >= 0xD0) & (data[ff + 1] <= 0xD7)]
    pieces = [unstuff(data[a:b]) for a, b in zip([0, *(cuts + 2)], [*cuts, len(data)], strict=True)]
    alone = len(scan.parts) == 1
    if alone:
        units, per_row = scan.parts[0].own_rows * scan.parts[0].own_cols, scan.parts[0].own_cols
    each = scan.restart or units
    for i, piece in enumerate(pieces):
        bits, state = Bits(piece), {"dc": [0] * len(scan.parts), "eob": 0}
        for unit in range(i * each, min(units, (i + 1) * each)):
            row, col = divmod(unit, per_row)
            for k, p in enumerate(scan.parts):
                if alone:
                    _block(scan, k, bits, p.coef[row * p.cols + col], state)
                    continue
                for y in range(p.v):
                    for x in range(p.h):
                        _block(scan, k, bits, p.coef[(row * p.v + y) * p.cols + col * p.h + x], state)


def decode_coefficients(data: bytes) -> Picture:
    """All scans of a progressive JPEG, accumulated."""
    raw = np.frombuffer(data, dtype=np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    marks = ff[(raw[ff + 1] != 0) & ~((raw[ff + 1] >= 0xD0) & (raw[ff + 1] <= 0xD7))]
    dc, ac, restart, picture, at, by_id, units = {}, {}, 0, Picture(0, 0, [], {}), 2, {}, (0, 0)
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at + 4 <= len(data):
        marker, (length,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        if marker == 0xD9:
            break
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                picture.quants[body[0] & 15] = np.frombuffer(body, dtype=">u2" if wide else "u1", count=64, offset=1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = huffman(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            picture.comment = body
        elif marker == 0xC2:
            picture.height, picture.width = struct.unpack_from(">HH", body, 1)
            picture.parts = [Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            by_id = {body[6 + 3 * i]: p for i, p in enumerate(picture.parts)}
            h, v = max(p.h for p in picture.parts), max(p.v for p in picture.parts)
            units = -(-picture.height // (8 * v)), -(-picture.width // (8 * h))
            for p in picture.parts:
                p.rows, p.cols = units[0] * p.v, units[1] * p.h
                p.own_rows, p.own_cols = -(-(-(-picture.height * p.v // v)) // 8), -(-(-(-picture.width * p.h // h)) // 8)
                p.coef = np.zeros((p.rows * p.cols, 64), dtype=np.int32)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xD0)):
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif marker == 0xDA:
            n = body[0]
            ids = [(by_id[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
            first, last, approx = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            end = int(marks[i]) if (i := int(np.searchsorted(marks, at))) < len(marks) else len(data)
            scan = Scan([p for p, _ in ids], [dc.get(t >> 4, {}) for _, t in ids], [ac.get(t & 15, {}) for _, t in ids], first, last, approx >> 4, approx & 15, restart)
            if not _fast(scan, raw[at:end]):
                _slow(scan, raw[at:end], units[0] * units[1], units[1])
            at = end
    return picture


def to_rgb(picture: Picture) -> np.ndarray:
    """height x width x 3 (grey pictures: three equal planes)."""
    h, v = max(p.h for p in picture.parts), max(p.v for p in picture.parts)
    planes = []
    for p in picture.parts:
        flat = (p.coef * picture.quants[p.quant]).astype(np.float64) @ _BASIS  # sums of whole numbers below 2**53
        flat += 128.5 * _SHIFT
        plane = np.clip(np.floor(flat * (1 / _SHIFT)), 0, 255).astype(np.uint8)
        plane = plane.reshape(p.rows, p.cols, 8, 8).transpose(0, 2, 1, 3).reshape(p.rows * 8, p.cols * 8)
        if (p.h, p.v) != (h, v):
            plane = plane.repeat(v // p.v, axis=0).repeat(h // p.h, axis=1)
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) < 3:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((picture.height, picture.width, 3), dtype=np.uint8)
    for i, x in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
        x += y
        x += 32768
        x >>= 16
        out[:, :, i] = np.clip(x, 0, 255)
    return out


# ---- writing


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def table(kind: int, number: int, length: int, symbols: list[int]) -> bytes:
    """A Huffman table in which all symbols have codes of one length."""
    return segment(0xC4, bytes([kind << 4 | number, *(len(symbols) if i == length else 0 for i in range(1, 17)), *symbols]))


def scan_head(parts: list[int], first: int, last: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([len(parts), *(x for p in parts for x in (p, 0)), first, last, high << 4 | low]))


_HEAD = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, b"\0" + b"\1" * 64)
_TABLES = table(0, 0, 1, [7]) + table(1, 0, 1, [7])
_REFINING = table(1, 0, 4, [16 * i for i in range(15)])
_EVERY, _NEVER = segment(0xDD, b"\0\1"), segment(0xDD, b"\0\0")


def _padded(bits: np.ndarray) -> np.ndarray:
    return stuff(np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))))


def store_bytes(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as a progressive JPEG."""
    blocks = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64)
    units = -(-len(blocks) // 6)
    wide = int(np.ceil(np.sqrt(units)))
    high = -(-units // wide)
    if 16 * max(wide, high) > 65535:
        raise ValueError("longer than a picture can be")
    full = np.zeros((6 * wide * high, 64), dtype=np.uint8)
    full[: len(blocks)] = blocks
    n = wide * high
    parts = {1: full[: 4 * n], 2: full[4 * n : 5 * n], 3: full[5 * n :]}
    out = [_HEAD, segment(0xFE, struct.pack(">Q", len(payload))), segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"\1\x22\0\2\x11\0\3\x11\0"), _TABLES, _EVERY]
    for i, x in parts.items():
        data = np.empty((len(x), 3), dtype=np.uint8)
        data[:, 0], data[:, 1], data[:, 2] = x[:, 0] >> 1, 0xFF, 0xD0 + np.arange(len(x)) % 8
        out += [scan_head([i], 0, 0, 0, 1), data.tobytes()[:-2]]
    out.append(_NEVER)
    for first, last in ((1, 5), (6, 63)):
        for i, x in parts.items():
            out += [scan_head([i], first, last, 0, 1), (x[:, first : last + 1] >> 1).tobytes()]
    for i, x in parts.items():
        out += [scan_head([i], 0, 0, 1, 0), _padded(x[:, 0] & 1).tobytes()]
    out.append(_REFINING)
    for i, x in parts.items():
        ac = x[:, 1:]
        bits = ((ac & 1) ^ (ac < 128)).astype(np.uint8)
        pieces = []
        for at in range(0, len(x), 32767):
            run = min(32767, len(x) - at)
            n = run.bit_length() - 1
            pieces += [np.array([int(c) for c in f"{n:04b}" + (f"{run - (1 << n):0{n}b}" if n else "")], dtype=np.uint8), bits[at : at + run].ravel()]
        out += [scan_head([i], 1, 63, 1, 0), _padded(np.concatenate(pieces)).tobytes()]
    return b"".join((*out, b"\xff\xd9"))


def stored_payload(picture: Picture) -> bytes:
    """What store_bytes() was given."""
    coef = np.concatenate([p.coef for p in picture.parts])
    out = np.where(coef < 0, coef + 255, coef)
    out[:, 0] -= coef[:, 0] < 0
    return out.astype(np.uint8).tobytes()[: struct.unpack(">Q", picture.comment)[0]]


class _Writer:
    def __init__(self) -> None:
        self.symbols: set[int] = set()
        self.items: list[tuple[int | None, int, int]] = []  # symbol or None, value, bits

    def put(self, symbol: int | None, value: int = 0, n: int = 0) -> None:
        if symbol is not None:
            self.symbols.add(symbol)
        self.items.append((symbol, value, n))

    def done(self, kind: int) -> tuple[bytes, bytes]:
        """The table segment and the coded data."""
        names = sorted(self.symbols)
        length = max(1, len(names).bit_length())
        text = []
        for symbol, value, n in self.items:
            if symbol is not None:
                text.append(f"{names.index(symbol):0{length}b}")
            if n:
                text.append(f"{value:0{n}b}")
        bits = np.array([int(c) for c in "".join(text)], dtype=np.uint8)
        return table(kind, 0, length, names) if names else b"", _padded(bits).tobytes()


def _size_bits(v: int) -> tuple[int, int]:
    n = abs(v).bit_length()
    return n, v if v >= 0 else v + (1 << n) - 1


def _code_ac(blocks: np.ndarray, first: int, last: int, high: int, low: int) -> _Writer:
    """Runs, ends of band and, in a refining scan, correction bits."""
    out, eob, held = _Writer(), 0, []

    def flush() -> None:
        nonlocal eob, held
        if eob:
            n = eob.bit_length() - 1
            out.put(n << 4, eob - (1 << n), n)
            eob = 0
        for b in held:
            out.put(None, b, 1)
        held = []

    for x in blocks.tolist():
        size = [abs(v) >> low for v in x]
        if high:
            new = [k for k in range(first, last + 1) if size[k] == 1]
            run, own, end = 0, [], new[-1] if new else 0
            for k in range(first, last + 1):
                if not size[k]:
                    run += 1
                    continue
                while run > 15 and k <= end:
                    flush()
                    out.put(0xF0)
                    for b in own:
                        out.put(None, b, 1)
                    run, own = run - 16, []
                if size[k] > 1:
                    own.append(size[k] & 1)
                    continue
                flush()
                out.put(run << 4 | 1, int(x[k] > 0), 1)
                for b in own:
                    out.put(None, b, 1)
                run, own = 0, []
            if run or own:
                eob += 1
                held += own
                if eob == 32767:
                    flush()
            continue
        run = 0
        for k in range(first, last + 1):
            if not size[k]:
                run += 1
                continue
            flush()
            while run > 15:
                out.put(0xF0)
                run -= 16
            n, bits = _size_bits(size[k] if x[k] > 0 else -size[k])
            out.put(run << 4 | n, bits, n)
            run = 0
        if run:
            eob += 1
            if eob == 32767:
                flush()
    flush()
    return out


def encode_image(rgb: np.ndarray, quant: int = 8) -> tuple[bytes, list[np.ndarray]]:
    """A picture as a 4:2:0 progressive JPEG with interleaved first scan; and its quantised coefficients (whole grid)."""
    height, width = rgb.shape[:2]
    rows, cols = -(-height // 16), -(-width // 16)
    x = np.pad(rgb.astype(np.float64), ((0, rows * 16 - height), (0, cols * 16 - width), (0, 0)), mode="edge")
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    y, cb, cr = 0.299 * r + 0.587 * g + 0.114 * b, 128 + (b - (0.299 * r + 0.587 * g + 0.114 * b)) * 0.564, 128 + (r - (0.299 * r + 0.587 * g + 0.114 * b)) * 0.713
    half = lambda p: p.reshape(rows * 8, 2, cols * 8, 2).mean(axis=(1, 3))
    parts = []
    for p in (y, half(cb), half(cr)):
        grid = (p - 128).reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        parts.append(np.rint((_COS @ grid @ _COS.T).reshape(-1, 64)[:, ZIGZAG] / quant).astype(np.int32))
    out = [b"\xff\xd8", segment(0xDB, b"\0" + bytes([quant]) * 64), segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + b"\1\x22\0\2\x11\0\3\x11\0")]
    w, last = _Writer(), [0, 0, 0]
    for unit in range(rows * cols):
        i, j = divmod(unit, cols)
        for k in range(3):
            for at in ([(2 * i + a) * 2 * cols + 2 * j + c for a in (0, 1) for c in (0, 1)] if k == 0 else [i * cols + j]):
                v = int(parts[k][at, 0]) >> 1
                n, bits = _size_bits(v - last[k])
                w.put(n, bits, n)
                last[k] = v
    dht, data = w.done(0)
    out += [dht, scan_head([1, 2, 3], 0, 0, 0, 1), data]
    own = [(-(-height // 8), -(-width // 8), 2 * cols), (-(-(-(-height // 2)) // 8), -(-(-(-width // 2)) // 8), cols), (-(-(-(-height // 2)) // 8), -(-(-(-width // 2)) // 8), cols)]
    for first, end, high, low in ((1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (1, 63, 1, 0)):
        for k in range(3):
            r_, c_, stride = own[k]
            dht, data = _code_ac(parts[k][(np.arange(r_)[:, None] * stride + np.arange(c_)).ravel()], first, end, high, low).done(1)
            out += [dht, scan_head([k + 1], first, end, high, low), data]
    w = _Writer()
    for unit in range(rows * cols):
        i, j = divmod(unit, cols)
        for k in range(3):
            for at in ([(2 * i + a) * 2 * cols + 2 * j + c for a in (0, 1) for c in (0, 1)] if k == 0 else [i * cols + j]):
                w.put(None, int(parts[k][at, 0]) & 1, 1)
    out += [scan_head([1, 2, 3], 0, 0, 1, 0), w.done(0)[1]]
    return b"".join((*out, b"\xff\xd9")), parts


# ---- DataFrames


def store_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media: each text's bytes, padded with zeros, as a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [b"" if t is None else t for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                media = [store_bytes(t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


TENSORS = "doc_id long, n_bytes long, payload binary, media binary, height int, width int, rgb binary, means string"


def read_tensors(media: DataFrame) -> DataFrame:
    """The stored pictures read back: TENSORS, with `rgb` as height x width x 3 bytes and the mean of each colour in
    thousandths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                rows = []
                for doc, n, data in zip(*(batch.slice(lo, 100).column(i).to_pylist() for i in range(3)), strict=True):
                    picture = decode_coefficients(data)
                    rgb = to_rgb(picture)
                    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (picture.height * picture.width)
                    rows.append((doc, n, stored_payload(picture), data, picture.height, picture.width, rgb.tobytes(), ";".join(map(str, means.tolist()))))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in TENSORS.split(", ")])

    return media.mapInArrow(run, TENSORS)


def digests(tensors: DataFrame) -> DataFrame:
    """Digests of TENSORS; feature: width x height, mean colour and checksum of the tensor."""
    checksum = F.lower(F.lpad(F.hex(F.crc32("rgb")), 8, "0"))
    feature = F.concat_ws(";", F.concat_ws("x", "width", "height"), "means", checksum)
    size = F.octet_length("payload")
    return tensors.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring(F.col("payload"), size - 63, F.lit(64))).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures are a table in the shared folder; what is returned comes of that table, read again."""
    media = written(store_media(read_table(spark, sf_dir, "documents")), "media")
    return digests(read_tensors(media))
