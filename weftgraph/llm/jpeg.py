"""Decoding of JPEG frames: baseline (SOF0, SOF1) and lossless (SOF3), 8 bits, Huffman coded.

The first component's samples come out (luma, or grey); of the others only the
codes are read. Tables may be left out of a frame, as motion-JPEG files do: then
those of an earlier frame hold, or else the standard's typical ones. Progressive
and arithmetic coding are refused with a ValueError, as is damaged data.

Coefficients are read one by one in Python; the transform is done for all blocks
at once.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

# fixed values: the standard's typical Huffman tables, as numbers of codes of each length and the symbols that come first; all other symbols follow in ascending order
TYPICAL = {
    (0, 0): ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), ()),
    (0, 1): ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), ()),
    (1, 0): (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        (0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82),
    ),
    (1, 1): (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        (0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1),
    ),
}


def _zigzag() -> np.ndarray:
    """Place in a block (row * 8 + column) of each coefficient in coded order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.array([8 * r + c for r, c in sorted(cells, key=lambda x: (sum(x), x[0] if sum(x) % 2 else -x[0]))])


ZIGZAG = _zigzag()
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def huffman(counts: bytes | tuple[int, ...], symbols: bytes | list[int]) -> list[int]:
    """By the next 16 bits: the code's length * 256 + its symbol, 0 where there is no code."""
    look, code, k = [0] * 65536, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            low = code << (16 - length)
            if low >= 65536 or k >= len(symbols):
                raise ValueError("a Huffman table is overfull")
            look[low : low + (1 << (16 - length))] = [length << 8 | symbols[k]] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return look


def _typical(kind: int, number: int) -> list[int]:
    counts, first = TYPICAL[kind, number]
    legal = range(12) if kind == 0 else [16 * run + size for run in range(16) for size in range(11) if size or run in (0, 15)]
    return huffman(counts, [*first, *[s for s in legal if s not in first]])


class Tables:
    """Tables that hold until others come."""

    def __init__(self) -> None:
        self.quantisers: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], list[int]] = {}

    def code(self, kind: int, number: int) -> list[int]:
        if (kind, number) not in self.codes:
            if number > 1:
                raise ValueError("a Huffman table is missing")
            self.codes[kind, number] = _typical(kind, number)
        return self.codes[kind, number]


class _Bits:
    """Bits of one restart interval, byte stuffing undone."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.word, self.n = data, 0, 0, 0

    def _need(self, k: int) -> None:
        while self.n < k:
            more = self.data[self.at : self.at + 8]
            self.at += 8
            if not more and self.at > len(self.data) + 64:
                raise ValueError("a frame ends too soon")
            self.word = (self.word & ((1 << self.n) - 1)) << 64 | int.from_bytes(more.ljust(8, b"\xff"), "big")
            self.n += 64

    def symbol(self, look: list[int]) -> int:
        self._need(16)
        entry = look[self.word >> (self.n - 16) & 0xFFFF]
        if not entry:
            raise ValueError("a frame has a code that no table holds")
        self.n -= entry >> 8
        return entry & 255

    def number(self, size: int) -> int:
        """The signed number of a category."""
        if not size:
            return 0
        self._need(size)
        self.n -= size
        value = self.word >> self.n & ((1 << size) - 1)
        return value if value >> (size - 1) else value - (1 << size) + 1


class _Part(NamedTuple):
    number: int
    across: int
    down: int
    quantiser: int


class _Frame(NamedTuple):
    lossless: bool
    height: int
    width: int
    parts: list[_Part]


def _frame(marker: int, body: bytes) -> _Frame:
    if marker not in (0xC0, 0xC1, 0xC3):
        raise ValueError("only baseline and lossless frames are read")
    precision, height, width, n = struct.unpack_from(">BHHB", body)
    if precision != 8 or not height or not width or not n:
        raise ValueError("only frames of 8 bits with a given size are read")
    parts = [_Part(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
    if not all(1 <= p.across <= 4 and 1 <= p.down <= 4 for p in parts):
        raise ValueError("a component has no sampling factor")
    return _Frame(marker == 0xC3, height, width, parts)


def _intervals(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Coded intervals from a place, and where the next marker stands."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:]], len(data)
        follow = data[at + 1]
        if follow == 0 or follow == 0xFF:
            at += 1 + (follow == 0)
        else:
            out.append(data[start:at])
            if not 0xD0 <= follow <= 0xD7:
                return out, at
            at = start = at + 2


def decode_grey(jpeg: bytes, tables: Tables | None = None) -> np.ndarray:
    """The first component of a frame, uint8 [height, width]; tables are updated."""
    tables = tables or Tables()
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, frame, every, planes = 2, None, 0, {}
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = jpeg[at + 1]
        if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD8:  # fill bytes and markers without a body
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            _read_codes(body, tables)
        elif marker == 0xDB:
            _read_quantisers(body, tables)
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            frame = _frame(marker, body)
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan comes before its frame's header")
            intervals, at = _intervals(jpeg, at)
            chosen = [(next(p for p in frame.parts if p.number == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            bits = [_Bits(x.replace(b"\xff\x00", b"\xff")) for x in intervals]
            read = _lossless if frame.lossless else _baseline
            planes |= read(frame, chosen, tables, bits, every, body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15)
    if frame is None or frame.parts[0].number not in planes:
        raise ValueError("a frame has no samples")
    return planes[frame.parts[0].number]


def _read_codes(body: bytes, tables: Tables) -> None:
    at = 0
    while at < len(body):
        n = sum(body[at + 1 : at + 17])
        tables.codes[body[at] >> 4, body[at] & 15] = huffman(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
        at += 17 + n


def _read_quantisers(body: bytes, tables: Tables) -> None:
    at = 0
    while at < len(body):
        wide = body[at] >> 4
        values = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.float64)
        block = np.zeros(64)
        block[ZIGZAG] = values
        tables.quantisers[body[at] & 15] = block
        at += 1 + 64 * (1 + wide)


def _baseline(frame: _Frame, chosen: list, tables: Tables, bits: list[_Bits], every: int, *_: int) -> dict[int, np.ndarray]:
    most_across, most_down = (max(getattr(p, k) for p in frame.parts) for k in ("across", "down"))
    single = len(chosen) == 1  # its units are single blocks, of the component's own size
    units_across, units_down = (-(-size // (8 * most)) for size, most in ((frame.width, most_across), (frame.height, most_down)))
    plans = []
    for part, codes in chosen:
        wide, high = units_across * part.across, units_down * part.down
        plans.append((part, tables.code(0, codes >> 4), tables.code(1, codes & 15), np.zeros((high, wide, 64)), 1 if single else part.across, 1 if single else part.down))
    if single:
        part = chosen[0][0]
        units_across = -(-(-(-frame.width * part.across // most_across)) // 8)
        units_down = -(-(-(-frame.height * part.down // most_down)) // 8)
    last = [0] * len(plans)
    source = iter(bits)
    reader = next(source)
    for unit in range(units_across * units_down):
        if every and unit and unit % every == 0:
            last = [0] * len(plans)
            reader = next(source, None) or _Bits(b"")
        row, column = divmod(unit, units_across)
        for k, (_, dc, ac, blocks, across, down) in enumerate(plans):
            for y in range(down):
                for x in range(across):
                    block = blocks[row * down + y, column * across + x]
                    last[k] += reader.number(reader.symbol(dc))
                    block[0] = last[k]
                    at = 1
                    while at < 64:
                        symbol = reader.symbol(ac)
                        run, size = symbol >> 4, symbol & 15
                        if not size:
                            if run < 15:
                                break
                            at += 16
                            continue
                        at += run
                        if at > 63:
                            raise ValueError("a block has too many coefficients")
                        block[ZIGZAG[at]] = reader.number(size)
                        at += 1
    out = {}
    for part, _, _, blocks, _, _ in plans:
        if part.number != frame.parts[0].number:
            continue
        if part.quantiser not in tables.quantisers:
            raise ValueError("a quantiser is missing")
        values = (blocks * tables.quantisers[part.quantiser]).reshape(*blocks.shape[:2], 8, 8)
        samples = np.clip(np.rint(_COSINES.T @ values @ _COSINES + 128), 0, 255).astype(np.uint8)
        plane = samples.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
        plane = plane.repeat(most_down // part.down, axis=0).repeat(most_across // part.across, axis=1)
        out[part.number] = plane[: frame.height, : frame.width]
    return out


def _lossless(frame: _Frame, chosen: list, tables: Tables, bits: list[_Bits], every: int, predictor: int, shift: int) -> dict[int, np.ndarray]:
    if any(p.across != 1 or p.down != 1 for p in frame.parts) or not 1 <= predictor <= 7 or shift:
        raise ValueError("only whole lossless frames without subsampling are read")
    height, width = frame.height, frame.width
    looks = [tables.code(0, codes >> 4) for _, codes in chosen]
    planes = [[[0] * width for _ in range(height)] for _ in chosen]
    source = iter(bits)
    reader, first = next(source), 0
    for unit in range(height * width):
        if every and unit and unit % every == 0:
            reader, first = next(source, None) or _Bits(b""), unit // width
        y, x = divmod(unit, width)
        for look, plane in zip(looks, planes, strict=True):
            if y == first:
                guess = plane[y][x - 1] if x else 128
            elif not x:
                guess = plane[y - 1][0]
            else:
                a, b, c = plane[y][x - 1], plane[y - 1][x], plane[y - 1][x - 1]
                guess = (a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor - 1]
            plane[y][x] = guess + reader.number(reader.symbol(look)) & 255
    return {part.number: np.array(plane, np.uint8) for (part, _), plane in zip(chosen, planes, strict=True)}
