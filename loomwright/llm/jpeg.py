"""Baseline JPEG, many frames at once.

A scan's restart intervals can be decoded apart from one another, so they are lanes: one step takes the
next Huffman symbol of every lane, by table look-up.  Frames with the same tables and geometry, of one
clip or of many, are decoded together.  Frames without restart markers are one lane each.

The writer puts data into the quantised coefficients (the unit that JPEG keeps without loss): byte b is
the coefficient b + 1, a restart interval is one unit of 8 x 8 pixels in three components, 192 bytes.
Its Huffman code for a value of s bits has 10 - s bits, so each coefficient takes 10 bits and an interval
240 bytes; any baseline decoder reads it.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

UNIT = 192
#: Lanes that are decoded at once.
LANES = 1 << 15


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in the order of the scan."""
    cells = sorted(((i + j, i if (i + j) % 2 else j, i * 8 + j) for i in range(8) for j in range(8)))
    return np.array([c[2] for c in cells])


ZIGZAG = zigzag()


@dataclass
class Frame:
    """What the headers say; scan: the entropy-coded bytes; components: (id, h, v, quantisation, dc, ac)."""

    width: int = 0
    height: int = 0
    components: list[list[int]] = field(default_factory=list)
    quantisation: dict[int, tuple[int, ...]] = field(default_factory=dict)
    huffman: dict[tuple[int, int], tuple[tuple[int, ...], bytes]] = field(default_factory=dict)
    interval: int = 0
    scan: bytes = b""

    def key(self) -> tuple:
        """Frames of one key are decoded together."""
        return self.width, self.height, str(self.components), str(sorted(self.huffman.items())), str(sorted(self.quantisation.items())), self.interval

    def grid(self) -> tuple[int, int]:
        """Units across and down."""
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Frame:
    f, at = Frame(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while at + 4 <= len(data):
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                f.quantisation[which] = struct.unpack(">64H" if wide else "64B", body[1 : 1 + size])
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                total = sum(counts)
                f.huffman[body[0] >> 4, body[0] & 15] = counts, body[17 : 17 + total]
                body = body[17 + total :]
        elif marker == 0xC0 or marker == 0xC1:
            f.height, f.width = struct.unpack_from(">HH", body, 1)
            f.components = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k], 0, 0] for k in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD:
            f.interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            for c in f.components:
                c[4], c[5] = tables[c[0]] >> 4, tables[c[0]] & 15
            end = data.rfind(b"\xff\xd9")
            f.scan = data[at : end if end >= at else len(data)]
            break
    return f


def lookup(counts: tuple[int, ...], symbols: bytes) -> np.ndarray:
    """For each 16 bits: the symbol and, times 256, its length; 0 for no code."""
    table, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - size)
            table[first : first + (1 << (16 - size))] = symbols[k] | size << 8
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _lanes(frames: list[Frame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all scans without stuffing and restart markers, and where each interval begins and
    ends.  Zeros follow, so that looking ahead is safe."""
    raw = np.frombuffer(b"".join(f.scan + b"\xff\xd0" for f in frames), np.uint8)  # an end for the last interval
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    stuffed, marks = ff[after == 0] + 1, ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[stuffed] = False
    keep[marks] = False
    keep[marks + 1] = False
    place = np.cumsum(keep) - keep
    ends = place[marks]
    return np.concatenate([raw[keep], np.zeros(8, np.uint8)]), np.concatenate([[0], ends[:-1]]), ends


def coefficients(frames: list[Frame]) -> list[np.ndarray]:
    """Frames of one key.  For each component: quantised coefficients (frame, block, place in the order of
    the scan); the blocks of a unit follow one another."""
    f = frames[0]
    across, down = f.grid()
    units = across * down
    interval = f.interval or units
    per_frame = -(-units // interval)
    data, starts, ends = _lanes(frames)
    if len(starts) != per_frame * len(frames):
        raise ValueError("restart markers are missing")
    tables = {k: lookup(*t) for k, t in f.huffman.items()}
    blocks = [(c, b) for c, x in enumerate(f.components) for b in range(x[1] * x[2])]
    out = [np.zeros((len(frames) * per_frame, interval, x[1] * x[2], 64), np.int16) for x in f.components]
    for low in range(0, len(starts), LANES):
        lanes = slice(low, min(low + LANES, len(starts)))
        bit = starts[lanes] * 8
        left = np.minimum(interval, units - np.arange(lanes.start, lanes.stop) % per_frame * interval)
        before = np.zeros((len(f.components), len(bit)), np.int32)
        for unit in range(int(left.max())):
            live = np.flatnonzero(left > unit)
            for c, b in blocks:
                _block(data, bit, live, tables[0, f.components[c][4]], tables[1, f.components[c][5]], before[c], out[c][lanes, unit, b])
        if (bit > ends[lanes] * 8 + 7).any():
            raise ValueError("a scan ends too early")
    return [x.reshape(len(frames), per_frame * interval, -1, 64)[:, :units].reshape(len(frames), -1, 64) for x in out]


def _block(data: np.ndarray, bit: np.ndarray, live: np.ndarray, dc: np.ndarray, ac: np.ndarray, before: np.ndarray, out: np.ndarray) -> None:
    """The next block of the live lanes: moves their bit positions and fills out (lane, 64)."""

    def peek(at: np.ndarray) -> np.ndarray:
        """32 bits from there on, in the high end of 40 minus the offset."""
        k = at >> 3
        word = data[k].astype(np.int64) << 32 | data[k + 1].astype(np.int64) << 24 | data[k + 2].astype(np.int64) << 16 | data[k + 3].astype(np.int64) << 8 | data[k + 4]
        return word >> (8 - (at & 7)) & 0xFFFFFFFF

    def value(word: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
        raw = word >> (32 - used - size) & ((1 << size) - 1)
        return np.where((size > 0) & (raw < 1 << np.maximum(size - 1, 0)), raw - (1 << size) + 1, raw)

    at = np.minimum(bit[live], (len(data) - 6) * 8)
    word = peek(at)
    got = dc[word >> 16]
    used, size = (got >> 8).astype(np.int64), (got & 255).astype(np.int64)
    before[live] += value(word, used, size).astype(np.int32)
    out[live, 0] = before[live]
    at = at + used + size
    place = np.zeros(len(live), np.int64)
    todo = np.arange(len(live))
    while len(todo):
        word = peek(np.minimum(at[todo], (len(data) - 6) * 8))
        got = ac[word >> 16]
        if not got.all():
            raise ValueError("no such code")
        used, run, size = (got >> 8).astype(np.int64), (got >> 4 & 15).astype(np.int64), (got & 15).astype(np.int64)
        at[todo] += used + size
        skip = (size == 0) & (run == 15)
        place[todo] += np.where(skip, 16, run + 1)
        has = size > 0
        if (place[todo][has] > 63).any():
            raise ValueError("too many coefficients in a block")
        out[live[todo[has]], place[todo[has]]] = value(word, used, size)[has]
        todo = todo[(has | skip) & (place[todo] < 63)]
    bit[live] = at


def cosines() -> np.ndarray:
    """The matrix of the inverse transform of 8 values."""
    u, x = np.arange(8)[None, :], np.arange(8)[:, None]
    return np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)


def samples(f: Frame, coefs: np.ndarray, component: int = 0) -> np.ndarray:
    """The 8-bit samples of a component's blocks (frame, block, 8, 8), before they are set side by side."""
    table = np.array(f.quantisation[f.components[component][3]], np.float32)
    blocks = np.zeros(coefs.shape, np.float32)
    blocks[..., ZIGZAG] = coefs * table
    m = cosines().astype(np.float32)
    out = m @ blocks.reshape(*coefs.shape[:-1], 8, 8) @ m.T
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _symbols() -> np.ndarray:
    """The 10 bits for each coefficient 1..256."""
    c = np.arange(257)
    size = np.array([int(x).bit_length() for x in c])
    return ((((1 << (9 - size)) - 1) << 1) << size | c).astype(np.uint16)


SYMBOLS = _symbols()


def headers(across: int, down: int) -> bytes:
    code = bytes([1] * 9 + [0] * 7) + bytes(range(9, 0, -1))
    frame = struct.pack(">BHHB", 8, down * 8, across * 8, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    scan = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    return b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC0, frame) + _segment(0xC4, b"\x00" + code + b"\x10" + code) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, scan)


def write_frames(payload: bytes, across: int, down: int) -> list[bytes]:
    """Frames of across x down units whose coefficients hold the payload, a multiple of that size."""
    c = SYMBOLS[np.frombuffer(payload, np.uint8).astype(np.int32) + 1].reshape(-1, 4).astype(np.uint64)
    four = c[:, 0] << np.uint64(30) | c[:, 1] << np.uint64(20) | c[:, 2] << np.uint64(10) | c[:, 3]
    packed = np.stack([four >> np.uint64(s) for s in (32, 24, 16, 8, 0)], axis=1).astype(np.uint8).reshape(-1, UNIT * 10 // 8)
    units = across * down
    n = len(packed) // units
    # each interval, and behind all but a frame's last one a restart marker
    marks = np.zeros((len(packed), 2), np.uint8)
    marks[:, 0], marks[:, 1] = 0xFF, 0xD0 + np.arange(len(packed)) % units % 8
    every = np.concatenate([packed, marks], axis=1).reshape(n, -1)
    marker = np.zeros((len(packed), packed.shape[1] + 2), bool)
    marker[:, -2:] = True
    head, out = headers(across, down), []
    for row, is_mark in zip(every, marker.reshape(n, -1)):
        row, is_mark = row[:-2], is_mark[:-2]
        ff = np.flatnonzero((row == 0xFF) & ~is_mark)
        out.append(head + np.insert(row, ff + 1, 0).tobytes() + b"\xff\xd9")
    return out


def decode(frames: list[bytes]) -> list[tuple[Frame, list[np.ndarray]]]:
    """Each frame's headers and, for each component, its coefficients (block, place)."""
    parsed = [parse(f) for f in frames]
    groups: dict[tuple, list[int]] = defaultdict(list)
    for k, f in enumerate(parsed):
        groups[f.key()].append(k)
    out: list = [None] * len(frames)
    for members in groups.values():
        each = coefficients([parsed[k] for k in members])
        for i, k in enumerate(members):
            out[k] = parsed[k], [c[i] for c in each]
    return out
