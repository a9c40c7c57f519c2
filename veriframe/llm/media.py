"""Progressive JPEG as a media column.

:func:`decode` reads progressive JPEG files: the spectral-selection and
successive-approximation scans are accumulated into coefficient arrays, blocks
are inverse-transformed in numpy, chroma is upsampled and the result is a
full-resolution RGB tensor.  All files of a batch are decoded together: each
restart interval of each file is a lane, and one numpy step decodes the next
symbol of all lanes.

:func:`store_payload` keeps arbitrary bytes losslessly in such a file.  The unit of
the format is the quantised coefficient: 64 bytes are the 64 coefficients of
a block in zigzag order, six blocks make an MCU with 4:2:0 chroma, and each
coefficient is coded in a first scan (all but its lowest bit) and a refinement.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_blocks

#: Bytes of texts or files that are worked on at once; a longer one is a block of its own.
BLOCK = 1 << 21
UNIT, PER_MCU, MAX_SIDE = 64, 6, 4095  # samples of a block; blocks of an MCU; MCUs that fit in 65,535 lines


@cache
def zigzag() -> np.ndarray:
    """Row-major place of each zigzag position: diagonals in turn, odd ones downwards."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


# ---------------------------------------------------------------- writing


def _values() -> np.ndarray:
    """The coefficient of each byte: -2..-129 below 128, 2..129 from there.  None is 0 once its lowest bit is gone."""
    b = np.arange(256)
    return np.where(b < 128, -(b + 2), b - 126)


VALUES = _values()


def _first_codes() -> np.ndarray:
    """Code of each byte's coefficient in the first AC scans.

    A magnitude of s bits (1 to 7) has the code of s: 7 - s ones and a zero.
    Code and bits together are always 8 bits, and never 0xFF.
    """
    v = np.sign(VALUES) * (np.abs(VALUES) >> 1)
    size = np.array([int(abs(x)).bit_length() for x in v])
    bits = np.where(v > 0, v, v + (1 << size) - 1)
    code = ((1 << (7 - size)) - 1) << 1
    return ((code << size) | bits).astype(np.uint8)


FIRST = _first_codes()
#: Code counts by length 1 to 16, and symbols.  DC sizes 0 to 11 have 4 bits each; first AC scans 7 to 1 bits and an end of block of 8; refinements the end of block alone.
DC_TABLE = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
AC_TABLE = (bytes([1] * 8 + [0] * 8), bytes([7, 6, 5, 4, 3, 2, 1, 0]))
REFINE_TABLE = (bytes([1] + [0] * 15), b"\0")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan_head(parts: Sequence[tuple[int, int]], ss: int, se: int, ah: int, al: int, interval: int) -> bytes:
    return _segment(0xDD, struct.pack(">H", interval)) + _segment(0xDA, bytes([len(parts), *(x for p in parts for x in p), ss, se, ah << 4 | al]))


HEADS = {
    "tables": b"".join(_segment(0xC4, bytes([where]) + bits + symbols) for where, (bits, symbols) in ((0x00, DC_TABLE), (0x10, AC_TABLE), (0x11, REFINE_TABLE))),
    "quant": _segment(0xDB, bytes([0] + [1] * 64)),
    "dc": _scan_head([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, 1),
    "dc+": _scan_head([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, 0),
} | {f"{c}{n}": _scan_head([(c, t)], a, b, h, l, 1) for c in (1, 2, 3) for n, t, a, b, h, l in (("low", 0, 1, 5, 0, 1), ("high", 0, 6, 63, 0, 1), ("+", 1, 1, 63, 1, 0))}


def _stuffed(body: np.ndarray, is_marker: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``body`` with a zero after each 0xFF that starts no marker; where each of its bytes went."""
    extra = (body == 255) & ~is_marker
    to = np.arange(len(body)) + np.cumsum(extra) - extra
    out = np.zeros(len(body) + int(extra.sum()), np.uint8)
    out[to] = body
    return out, to


def _restarted(rows: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Each row followed by the restart marker of its number."""
    marks = np.stack([np.full(len(rows), 255, np.uint8), (0xD0 + number % 8).astype(np.uint8)], 1)
    return np.concatenate([rows, marks], 1)


def store_payload(payloads: Sequence[np.ndarray]) -> list[bytes]:
    """A progressive JPEG file for each payload (bytes, a positive multiple of 64).

    The length is in a comment.  Blocks that fill up the last MCUs are zeros.
    """
    if not payloads:
        return []
    shapes = []
    units = []
    for p in payloads:
        m = -(-len(p) // (UNIT * PER_MCU))
        w = -(-m // MAX_SIDE)
        h = -(-m // w)
        shapes.append((w, h))
        unit = np.zeros(w * h * PER_MCU * UNIT, np.uint8)
        unit[: len(p)] = p
        units.append(unit.reshape(h, w, PER_MCU, UNIT))
    mcus = np.array([w * h for w, h in shapes])
    whole = np.concatenate([u.reshape(-1, PER_MCU, UNIT) for u in units])
    value = VALUES[whole[:, :, 0]]
    # DC: differences within an MCU, as each is a restart interval
    first = value >> 1
    previous = np.zeros_like(first)
    previous[:, 1:4] = first[:, :3]
    diff = first - previous
    size = np.where(diff == 0, 0, np.floor(np.log2(np.maximum(1, np.abs(diff)))).astype(np.int64) + 1)
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = 4 + size
    code = (size << size) | bits
    place = np.arange(12)
    bit = ((code[:, :, None] >> np.maximum(0, length[:, :, None] - 1 - place)) & 1).astype(np.uint8)
    there = place < length[:, :, None]
    n_bits = length.sum(1)
    line = np.ones((len(whole), 72), np.uint8)
    row = np.repeat(np.arange(len(whole)), n_bits)
    line[row, np.arange(len(row)) - np.repeat(np.cumsum(n_bits) - n_bits, n_bits)] = bit[there]
    n_bytes = -(-n_bits // 8)
    number = np.arange(len(whole)) - np.repeat(np.cumsum(mcus) - mcus, mcus)
    packed = _restarted(np.packbits(line, axis=1), number)
    keep = np.arange(11) < n_bytes[:, None]
    keep[:, 9:] = True
    marker = np.zeros_like(keep)
    marker[:, 9:] = True
    dc, dc_at = _stuffed(packed[keep], marker[keep])
    dc_ends = np.concatenate([[0], np.cumsum((n_bytes + 2).reshape(-1))])
    dc_starts = np.append(dc_at, len(dc))[dc_ends[np.concatenate([[0], np.cumsum(mcus)])]]
    out = []
    # AC: blocks of each component in raster order
    turned = [u[:, :, :4].reshape(h, w, 2, 2, UNIT).transpose(0, 2, 1, 3, 4).reshape(-1, UNIT) if w > 1 else u[:, :, :4].reshape(-1, UNIT) for u, (w, h) in zip(units, shapes, strict=True)]
    sets = [(1, np.concatenate(turned), mcus * 4), (2, whole[:, 4], mcus), (3, whole[:, 5], mcus)]
    scans: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for c, block, count in sets:
        number = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        ends = np.concatenate([[0], np.cumsum(count)])
        for name, a, b in (("low", 1, 6), ("high", 6, 64)):
            scans[f"{c}{name}"] = (_restarted(FIRST[block[:, a:b]], number).ravel(), ends * (b - a + 2))
        low = np.zeros((len(block), 64), np.uint8)
        low[:, 1:] = np.abs(VALUES)[block[:, 1:]] & 1
        rows = _restarted(np.packbits(low, axis=1), number)
        marks = np.zeros(rows.shape, bool)
        marks[:, 8:] = True
        body, at = _stuffed(rows.ravel(), marks.ravel())
        scans[f"{c}+"] = (body, np.append(at, len(body))[ends * 10])
    low_bits = (value & 1).astype(np.uint8)
    m0 = 0
    for k, (p, (w, h)) in enumerate(zip(payloads, shapes, strict=True)):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        parts = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(p)), HEADS["quant"], frame, HEADS["tables"], HEADS["dc"], dc[dc_starts[k] : dc_starts[k + 1] - 2].tobytes()]
        for name, (body, ends) in scans.items():
            parts += [HEADS[name], body[ends[k] : ends[k + 1] - 2].tobytes()]
        m1 = m0 + w * h
        tail = np.packbits(np.append(low_bits[m0:m1].ravel(), np.ones(-(m1 - m0) * PER_MCU % 8, np.uint8)))
        parts += [HEADS["dc+"], _stuffed(tail, np.zeros(len(tail), bool))[0].tobytes(), b"\xff\xd9"]
        out.append(b"".join(parts))
        m0 = m1
    return out


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    wide: int = 0  #: blocks that the image covers
    high: int = 0
    stride: int = 0  #: blocks kept, whole MCUs
    rows: int = 0
    base: int = 0  #: place of its first block among those of the batch


@dataclass
class Scan:
    parts: list[int]
    tables: list[tuple[int, int]]
    ss: int
    se: int
    ah: int
    al: int
    interval: int
    start: int
    end: int


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)


@cache
def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """Length << 8 | symbol of each 16-bit window; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint16)
    code = k = 0
    for length, count in enumerate(table[0], 1):
        for _ in range(count):
            a = code << (16 - length)
            out[a : a + (1 << (16 - length))] = length << 8 | table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Tables:
    """The distinct Huffman tables of a batch."""

    def __init__(self) -> None:
        self.number: dict[tuple[bytes, bytes], int] = {}

    def of(self, table: tuple[bytes, bytes]) -> int:
        return self.number.setdefault(table, len(self.number))

    def stack(self) -> np.ndarray:
        return np.concatenate([_lookup(t) for t in self.number]) if self.number else np.zeros(1 << 16, np.uint16)


def _parse(data: bytes, offset: int, marks: np.ndarray, tables: _Tables) -> Image:
    """Headers and the extent of each scan; ``marks`` are the places of markers other than restarts in the batch."""
    image, huff, interval, at = Image(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    while True:
        if at + 2 > len(data):
            raise ValueError("the file ends before its end marker")
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            return image
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            image.comment = body
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = tables.of((body[1:17], body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == 0xC2:
            if body[0] != 8:
                raise ValueError("samples of 8 bits only")
            image.height, image.width, n = struct.unpack(">HHB", body[1:6])
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
            for c in image.components:
                c.wide, c.high = -(-image.width * c.h // (8 * hm)), -(-image.height * c.v // (8 * vm))
                c.stride, c.rows = -(-image.width // (8 * hm)) * c.h, -(-image.height // (8 * vm)) * c.v
        elif kind == 0xDA:
            ids = [c.id for c in image.components]
            n = body[0]
            parts = [ids.index(body[1 + 2 * k]) for k in range(n)]
            picks = [(huff.get(body[2 + 2 * k] >> 4, 0), huff.get(0x10 | body[2 + 2 * k] & 15, 0)) for k in range(n)]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            k = int(np.searchsorted(marks, offset + at))
            end = int(marks[k]) - offset if k < len(marks) else len(data)
            if end > len(data) or se > 63 or ss > se or (ss > 0 and n != 1):
                raise ValueError("a scan that isn't progressive")
            image.scans.append(Scan(parts, picks, ss, se, a >> 4, a & 15, interval, offset + at, offset + end))
            at = end
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman-coded frame")


@cache
def _order(shape: tuple[tuple[int, int, int, int, int, int], ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in coding order (component's number, block in its array) and blocks of an MCU.

    ``shape``: h, v, wide, high, stride, rows of each component.
    """
    if len(shape) == 1:
        _, _, wide, high, stride, _ = shape[0]
        block = (np.arange(high)[:, None] * stride + np.arange(wide)).ravel()
        return np.zeros(len(block), np.int64), block, 1
    across, down = shape[0][4] // shape[0][0], shape[0][5] // shape[0][1]
    part, block = [], []
    y, x = np.divmod(np.arange(across * down), across)
    for k, (h, v, _, _, stride, _) in enumerate(shape):
        for dy in range(v):
            for dx in range(h):
                block.append((y * v + dy) * stride + x * h + dx)
                part.append(np.full(len(y), k))
    return np.stack(part, 1).ravel(), np.stack(block, 1).ravel(), len(part)


class _Bits:
    """Bit windows of the batch's bytes, stuffing removed."""

    def __init__(self, body: np.ndarray) -> None:
        self.n = len(body)
        self.body = np.concatenate([body, np.zeros(16, np.uint8)])
        self.words = np.ndarray((self.n + 8,), ">u8", self.body, strides=(1,))

    def window(self, pos: np.ndarray) -> np.ndarray:
        """The 48 bits or more from each position, at the top of 64."""
        return self.words[np.minimum(pos >> 3, self.n)].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def bit(self, pos: np.ndarray) -> np.ndarray:
        return self.body[np.minimum(pos >> 3, self.n)] >> (7 - (pos & 7)).astype(np.uint8) & 1


def _number(window: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` bits after ``skip`` bits, as an unsigned number."""
    return ((window << skip.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) >> (32 - size)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


class _Lanes:
    """Restart intervals that are decoded side by side: bit position, end, next and last block in ``blocks``."""

    def __init__(self) -> None:
        self.pos, self.end, self.first, self.last = [], [], [], []
        self.blocks, self.part, self.table, self.al = [], [], [], []
        self.band: list[np.ndarray] = []
        self.n = 0


def _symbols(bits: _Bits, luts: np.ndarray, table: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    window = bits.window(pos)
    found = luts[(table << 16) + (window >> np.uint64(48)).astype(np.int64)]
    length = (found >> 8).astype(np.int64)
    if len(length) and not length.min():
        raise ValueError("a code that isn't in its table")
    return window, length, (found & 255).astype(np.int64)


def _dc_first(bits: _Bits, luts: np.ndarray, coef: np.ndarray, pos, at, last, blocks, part, table, al, parts: int) -> None:
    before = np.zeros((len(pos), parts), np.int64)
    lane = np.flatnonzero(at < last)
    while len(lane):
        b = at[lane]
        window, length, size = _symbols(bits, luts, table[b], pos[lane])
        before[lane, part[b]] += _signed(_number(window, length, size), size)
        coef[blocks[b], 0] = before[lane, part[b]] << al[lane]
        pos[lane] += length + size
        at[lane] += 1
        lane = lane[at[lane] < last[lane]]


def _ac_first(bits: _Bits, luts: np.ndarray, coef: np.ndarray, pos, at, last, blocks, table, al, ss, se) -> None:
    k, run = ss.copy(), np.zeros(len(pos), np.int64)
    lane = np.flatnonzero(at < last)
    flat = coef.reshape(-1)
    while len(lane):
        b = at[lane]
        window, length, symbol = _symbols(bits, luts, table[b], pos[lane])
        size, r = symbol & 15, symbol >> 4
        to = k[lane] + r
        if size.min() > 0:
            value = _signed(_number(window, length, size), size)
            if (to > se[lane]).any():
                raise ValueError("a run beyond its band")
            flat[blocks[b] * 64 + to] = value << al[lane]
            k[lane], pos[lane] = to + 1, pos[lane] + length + size
            done = to >= se[lane]
        else:
            some, zrl = size > 0, (size == 0) & (r == 15)
            eob = ~some & ~zrl
            if (to[some] > se[lane][some]).any():
                raise ValueError("a run beyond its band")
            value = _signed(_number(window, length, size), size)[some]
            flat[blocks[b[some]] * 64 + to[some]] = value << al[lane][some]
            more = np.where(eob, r, 0)
            run[lane] = np.where(eob, (1 << more) - 1 + _number(window, length, more), 0)
            pos[lane] += length + size + more
            k[lane] = to + 1
            done = eob | (k[lane] > se[lane])
        if done.any():
            end = lane[done]
            at[end] += 1 + run[end]  # blocks of the run stay zero
            run[end], k[end] = 0, ss[end]
            lane = lane[at[lane] < last[lane]]


def _dc_refine(bits: _Bits, coef: np.ndarray, pos, at, last, blocks, al) -> None:
    n = last - at
    before = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(before, n)
    where = blocks[np.repeat(at, n) + step]
    coef[where, 0] |= bits.bit(np.repeat(pos, n) + step).astype(coef.dtype) << np.repeat(al, n).astype(coef.dtype)


def _ac_refine(bits: _Bits, luts: np.ndarray, coef: np.ndarray, pos, at, last, blocks, table, al, ss, se) -> None:
    k, run = ss.copy(), np.zeros(len(pos), np.int64)
    lane = np.flatnonzero(at < last)
    column = np.arange(64)
    while len(lane):
        fresh = lane[run[lane] == 0]
        want = np.full(len(pos), 64)  # zeros to pass before the step ends
        new = np.zeros(len(pos), np.int64)
        if len(fresh):
            window, length, symbol = _symbols(bits, luts, table[at[fresh]], pos[fresh])
            size, r = symbol & 15, symbol >> 4
            eob = (size == 0) & (r < 15)
            more = np.where(eob, r, size)
            number = _number(window, length, more)
            pos[fresh] += length + more
            run[fresh] = np.where(eob, (1 << r) + np.where(eob, number, 0), 0)
            want[fresh] = np.where(eob, 64, r)
            new[fresh] = np.where(size > 0, np.where(number > 0, 1, -1), 0)
        own = coef[blocks[at[lane]]]
        band = (column >= k[lane][:, None]) & (column <= se[lane][:, None])
        set_before = (own != 0) & band
        if (want[lane] < 64).any():
            zero = band & ~set_before
            passed = np.cumsum(zero, axis=1)
            hit = zero & (passed == want[lane][:, None] + 1)
            stop = np.where(hit.any(1), hit.argmax(1), se[lane] + 1)
            set_before &= column < stop[:, None]
        else:
            stop = se[lane] + 1
        n = set_before.sum(1)
        r, c = np.nonzero(set_before)
        bit = bits.bit(pos[lane][r] + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n))
        add = np.flatnonzero(bit)
        r, c = r[add], c[add]
        own[r, c] += np.sign(own[r, c]) << al[lane][r].astype(own.dtype)
        placed = np.flatnonzero((new[lane] != 0) & (stop <= se[lane]))
        own[placed, stop[placed]] = new[lane][placed] << al[lane][placed]
        coef[blocks[at[lane]]] = own
        pos[lane] += n
        k[lane] = stop + 1
        done = lane[k[lane] > se[lane]]
        at[done] += 1
        k[done] = ss[done]
        run[done] = np.maximum(0, run[done] - 1)
        lane = lane[at[lane] < last[lane]]


def read_coefficients(files: Sequence[bytes]) -> tuple[list[Image], np.ndarray]:
    """Headers of the files, and all their blocks' coefficients in zigzag order."""
    body = np.frombuffer(b"".join(files), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in files])])
    ff = np.flatnonzero(body[:-1] == 255) if len(body) else np.zeros(0, np.int64)
    after = body[ff + 1] if len(ff) else ff
    restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
    marks = ff[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))]
    stuffing = ff[after == 0] + 1
    clean = np.delete(body, stuffing)
    tables = _Tables()
    images = [_parse(f, int(o), marks, tables) for f, o in zip(files, offsets, strict=False)]
    base = 0
    for image in images:
        for c in image.components:
            c.base = base
            base += c.stride * c.rows
    coef = np.zeros((base, 64), np.int32)
    bits, luts = _Bits(clean), tables.stack()
    for turn in range(max((len(i.scans) for i in images), default=0)):
        groups: dict[tuple[bool, bool], list[tuple[Image, Scan]]] = {}
        for image in images:
            if turn < len(image.scans):
                s = image.scans[turn]
                groups.setdefault((s.ss == 0, s.ah == 0), []).append((image, s))
        for (dc, first), found in groups.items():
            pos, at, last, blocks, part, table, al, ss, se = ([] for _ in range(9))
            n = 0
            for image, s in found:
                own = [image.components[p] for p in s.parts]
                number, block, per = _order(tuple((c.h, c.v, c.wide, c.high, c.stride, c.rows) for c in own))
                a, b = np.searchsorted(restarts, (s.start, s.end))
                starts = np.concatenate([[s.start], restarts[a:b] + 2])
                step = s.interval * per or len(block)
                heads = np.arange(0, len(block), step)
                if len(heads) > len(starts):
                    raise ValueError("a restart interval is missing")
                starts = starts[: len(heads)]
                pos.append(8 * (starts - np.searchsorted(stuffing, starts)))
                at.append(n + heads)
                last.append(n + np.minimum(heads + step, len(block)))
                blocks.append(block + (np.array([c.base for c in own])[number] if len(own) > 1 else own[0].base))
                part.append(number)
                table.append(np.array([t[0 if dc else 1] for t in s.tables])[number] if len(own) > 1 else np.full(len(block), s.tables[0][0 if dc else 1]))
                for x, v in ((al, s.al), (ss, s.ss), (se, s.se)):
                    x.append(np.full(len(heads), v))
                n += len(block)
            pos, at, last, blocks, part, table, al, ss, se = (np.concatenate(x) for x in (pos, at, last, blocks, part, table, al, ss, se))
            if dc and first:
                _dc_first(bits, luts, coef, pos, at, last, blocks, part, table, al, int(part.max(initial=0)) + 1)
            elif dc:
                _dc_refine(bits, coef, pos, at, last, blocks, al)
            elif first:
                _ac_first(bits, luts, coef, pos, at, last, blocks, table, al, ss, se)
            else:
                _ac_refine(bits, luts, coef, pos, at, last, blocks, table, al, ss, se)
    return images, coef


@cache
def _inverse() -> np.ndarray:
    """Inverse transform of a block in zigzag order, in units of 2**-16.

    All entries are whole, so that sums of products in float64 are exact and the
    samples don't depend on the order of summation.
    """
    k, x = np.arange(8)[:, None], np.arange(8)
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    whole = np.einsum("uy,vx->uvyx", basis, basis).reshape(64, 64)
    return np.round(whole[zigzag()] * (1 << 16))


def _wider(plane: np.ndarray, times: int, axis: int) -> np.ndarray:
    """Upsampling: by 2 with a triangle filter, else by repetition."""
    if times != 2:
        return np.repeat(plane, times, axis=axis) if times > 1 else plane
    a = np.moveaxis(plane, axis, 0)
    out = np.empty((2 * len(a), *a.shape[1:]), a.dtype)
    out[2::2] = 0.75 * a[1:] + 0.25 * a[:-1]
    out[1:-1:2] = 0.75 * a[:-1] + 0.25 * a[1:]
    out[0], out[-1] = a[0], a[-1]
    return np.moveaxis(out, 0, axis)


def rgb(image: Image, coef: np.ndarray) -> np.ndarray:
    """The full-resolution tensor, height x width x 3.

    One component is gray; three are Y, Cb and Cr.  Chroma is upsampled to the
    size of the image.
    """
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        block = coef[c.base : c.base + c.stride * c.rows] * image.quant[c.quant]
        sample = np.clip(np.floor((block.astype(np.float64) @ _inverse() + (1 << 15)) * 2.0**-16) + 128, 0, 255).astype(np.float32)
        plane = sample.reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)
        plane = plane[: -(-image.height * c.v // vm), : -(-image.width * c.h // hm)]
        planes.append(_wider(_wider(plane, vm // c.v, 0), hm // c.h, 1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for k, v in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, k] = np.clip(np.round(v), 0, 255)
    return out


def decode(files: Sequence[bytes]) -> list[np.ndarray]:
    """RGB tensors of progressive JPEG files."""
    images, coef = read_coefficients(files)
    return [rgb(i, coef) for i in images]


def read_payload(image: Image, coef: np.ndarray) -> np.ndarray:
    """The bytes that :func:`store_payload` kept."""
    n = int(image.comment.removeprefix(b"payload "))
    y, cb, cr = image.components
    across, down = y.stride // 2, y.rows // 2
    blocks = np.empty((down, across, PER_MCU, UNIT), np.int32)
    own = coef[y.base : y.base + y.stride * y.rows].reshape(down, 2, across, 2, UNIT)
    blocks[:, :, :4] = own.transpose(0, 2, 1, 3, 4).reshape(down, across, 4, UNIT)
    for k, c in ((4, cb), (5, cr)):
        blocks[:, :, k] = coef[c.base : c.base + c.stride * c.rows].reshape(down, across, UNIT)
    v = blocks.reshape(-1)[:n]
    return np.where(v < 0, -v - 2, v + 126).astype(np.uint8)


def features(tensor: np.ndarray) -> str:
    """Mean and deviation of each channel, and mean step between neighbours, from exact sums."""
    n = tensor.shape[0] * tensor.shape[1]
    levels = np.arange(256)
    counts = np.stack([np.bincount(tensor[:, :, k].ravel(), minlength=256) for k in range(3)])
    total, squares = counts @ levels, counts @ (levels * levels)
    deviation = np.sqrt(np.maximum(0, n * squares - total * total)) / n
    green = tensor[:, :, 1].astype(np.int16)
    steps = int(np.abs(green[:, 1:] - green[:, :-1]).sum(dtype=np.int64)) / max(1, green.shape[0] * (green.shape[1] - 1))
    return f"{tensor.shape[1]}x{tensor.shape[0]};" + ";".join(f"{c}={m:.3f},{d:.3f}" for c, m, d in zip("rgb", total / n, deviation, strict=True)) + f";step={steps:.3f}"


# ---------------------------------------------------------------- columns


def _decode_column(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            data = batch.column("content")[k].as_py()
            try:
                tensor, error = decode([data])[0] if data else None, None if data else "no content"
            except (ValueError, IndexError, KeyError, struct.error) as e:
                tensor, error = None, str(e) or type(e).__name__
            h, w = tensor.shape[:2] if tensor is not None else (None, None)
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(k, 1), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([tensor.tobytes() if tensor is not None else None], pa.binary()), pa.array([error], pa.string())], names=["key", "height", "width", "rgb", "error"])


def decode_media(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key, height, width, rgb, error`` of a column of progressive JPEG files.

    ``rgb`` is the tensor, row by row, three bytes a pixel.  A null, empty or
    broken file has null values and an ``error``.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS key", f"`{content}` AS content").mapInArrow(_decode_column, f"key {kind}, height int, width int, rgb binary, error string")


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, body, offs in text_blocks(batches, limit=BLOCK):
        payloads = []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            p = np.zeros(max(UNIT, -(-(b - a) // UNIT) * UNIT), np.uint8)
            p[: b - a] = body[a:b]
            payloads.append(p)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offs), pa.int64()), pa.array(store_payload(payloads), pa.binary())], names=["doc_id", "n_bytes", "media"])


def _described(files: list[bytes | None]) -> list[tuple]:
    try:
        images, coef = read_coefficients(files)
        backs = [read_payload(i, coef).tobytes() for i in images]
        return [(len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-UNIT:]), len(f), hashlib.sha256(f).hexdigest(), features(rgb(i, coef))) for i, b, f in zip(images, backs, files, strict=True)]
    except (ValueError, IndexError, KeyError, TypeError, struct.error):
        # one file can't be read: the others are
        return [x for f in files for x in _described([f])] if len(files) > 1 else [(None,) * 6]


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("media")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
            part = batch.slice(at, to - at)
            cols = list(zip(*_described(part.column("media").to_pylist()), strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            at = to


def store_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a media column, a progressive JPEG file.

    The text's UTF-8 bytes (null: none) with zeros up to a positive multiple of
    64 are the payload.  Equal texts have equal files.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_store, f"doc_id {kind}, n_bytes long, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """Digests, sizes and features of what the files of :func:`store_media` hold, by decoding them.  A null or broken file has nulls."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_describe, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Each text kept in a progressive JPEG file, a column of which is read back and described.

    Equal texts have equal values; rows are independent of each other.
    """
    return describe_media(store_media(docs))
