"""Motion-JPEG clips in AVI files: index, frames, shots.

A file's RIFF lists are parsed; frames are found by the index (idx1), or by walking the movi list where
there is none.  Every frame is intra-coded, so all are decoded together (see jpeg.py).  A shot ends where
the histograms of two adjacent frames differ by more than the clip's own mean difference and a multiple of
its deviation, and by a least amount; each shot is a clip row with its frames and times.

The query stores each text as such a file and reads it back.  Null texts are empty; an empty text is
stored as one unit of spaces.  In the general operator a null or empty media column gives no clips, and so
does a file that isn't one (with its error in a row, if asked).  Rows with equal ids stay separate; an
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import jpeg
from loomwright.llm.common import released, ship, utf8

FPS, ACROSS, DOWN, BINS = 25, 4, 4, 16
#: A cut needs this histogram difference at least, and the mean plus so many deviations.
LEAST_CUT, DEVIATIONS = 0.1, 1.5
#: Bytes of media that are decoded together.
DECODED = 4 << 20


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, comment: bytes = b"") -> bytes:
    """A file with one video stream of JPEG frames."""
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, -1, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    at = np.cumsum([4] + [len(c) for c in chunks[:-1]]).tolist()
    index = b"".join(b"00dc" + struct.pack("<III", 0x10, a, len(f)) for a, f in zip(at, frames))
    info = _list(b"INFO", _chunk(b"ICMT", comment)) if comment else b""
    return _chunk(b"RIFF", b"AVI " + header + info + _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", index))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, size) of the chunks there."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> dict:
    """width, height, fps, comment and frames (their bytes) of the first video stream."""
    out: dict = {"width": 0, "height": 0, "fps": float(FPS), "comment": b"", "frames": []}
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    stream, video, index, movi, loose = -1, 0, None, [], []

    def walk(at: int, end: int, inside: bytes) -> None:
        nonlocal stream, video, index
        for name, first, size in _chunks(data, at, end):
            if name in (b"LIST", b"RIFF"):
                kind = data[first : first + 4]
                if kind == b"movi":
                    movi.append(first)
                walk(first + 4, first + size, kind)
            elif name == b"avih":
                out["width"], out["height"] = struct.unpack_from("<II", data, first + 32)
                if each := struct.unpack_from("<I", data, first)[0]:
                    out["fps"] = 1e6 / each
            elif name == b"strh":
                stream += 1
                if data[first : first + 4] == b"vids":
                    video = stream
                    scale, rate = struct.unpack_from("<II", data, first + 20)
                    if scale and rate:
                        out["fps"] = rate / scale
            elif name == b"ICMT":
                out["comment"] = data[first : first + size]
            elif name == b"idx1":
                index = first, size
            elif name[2:] in (b"dc", b"db") and name[:2].isdigit():
                loose.append((int(name[:2]), first, size))

    walk(0, len(data), b"")
    if index and movi and len(movi) == 1:
        rows = [struct.unpack_from("<4sIII", data, index[0] + k) for k in range(0, index[1] - 15, 16)]
        rows = [r for r in rows if r[0][2:] in (b"dc", b"db") and r[0][:2].isdigit() and int(r[0][:2]) == video]
        base = movi[0] if rows and rows[0][2] < movi[0] else 0  # offsets count from the list or from the file
        out["frames"] = [data[base + a + 8 : base + a + 8 + n] for _, _, a, n in rows]
    else:
        out["frames"] = [data[a : a + n] for s, a, n in loose if s == video]
    return out


def shots(histograms: np.ndarray, least: float = LEAST_CUT, deviations: float = DEVIATIONS) -> list[tuple[int, int]]:
    """(first frame, end) of each shot; histograms: shares, a row a frame."""
    if not len(histograms):
        return []
    d = np.abs(np.diff(histograms, axis=0)).sum(1) / 2
    cuts = np.flatnonzero(d > max(least, d.mean() + deviations * d.std())) + 1 if len(d) else np.zeros(0, int)
    edges = [0, *cuts.tolist(), len(histograms)]
    return list(zip(edges, edges[1:]))


def decode_clips(files: list[bytes]) -> Iterator[tuple[dict, list, np.ndarray]]:
    """For each file what its headers say, its decoded frames, and their luma histograms; the frames of
    several files are decoded together."""
    at = 0
    while at < len(files):
        end, size = at, 0
        while end < len(files) and (end == at or size + len(files[end]) <= DECODED):
            size += len(files[end])
            end += 1
        parsed = [parse_avi(f) for f in files[at:end]]
        frames = jpeg.decode([f for p in parsed for f in p["frames"]])
        groups: dict[tuple, list[int]] = {}
        for k, (f, c) in enumerate(frames):
            groups.setdefault((f.key(), len(c[0])), []).append(k)
        histograms = np.zeros((len(frames), BINS))
        for members in groups.values():
            luma = jpeg.samples(frames[members[0]][0], np.stack([frames[k][1][0] for k in members])).reshape(len(members), -1)
            places = (luma // (256 // BINS)).astype(np.int64) + np.arange(len(members))[:, None] * BINS
            counts = np.bincount(places.ravel(), minlength=len(members) * BINS).reshape(-1, BINS)
            histograms[members] = counts / luma.shape[1]
        k = 0
        for p in parsed:
            n = len(p["frames"])
            yield p, frames[k : k + n], histograms[k : k + n]
            k += n
        at = end


def clips(df: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """A row for each shot: doc_id, clip, first_frame, end_frame, start_s, end_s, and its mean luma
    histogram."""
    ship(df.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            files = [(i, m) for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if m and m[:4] == b"RIFF" and m[8:12] == b"AVI "]
            for (i, _), (p, _, h) in zip(files, decode_clips([m for _, m in files])):
                out += [(i, k, a, b, a / p["fps"], b / p["fps"], h[a:b].mean(0)) for k, (a, b) in enumerate(shots(h))]
            names = [("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("histogram", pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(names)})

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(media_column).alias("media"))
    return rows.mapInArrow(run, "doc_id long, clip int, first_frame int, end_frame int, start_s double, end_s double, histogram array<double>")


def store(text: bytes) -> bytes:
    """The file that holds a text's payload: the bytes, and spaces up to a positive multiple of 192."""
    payload = text + b" " * (max(1, -(-len(text) // jpeg.UNIT)) * jpeg.UNIT - len(text))
    size = ACROSS * DOWN * jpeg.UNIT
    padded = payload + b" " * (-len(payload) % size)
    return write_avi(jpeg.write_frames(padded, ACROSS, DOWN), ACROSS * 8, DOWN * 8, comment=f"{len(text)} {len(payload)}".encode())


def read_payload(parsed: dict, frames: list) -> tuple[int, bytes]:
    """The text's size and the payload of a file that store() made."""
    n, size = map(int, parsed["comment"].split())
    parts = [np.stack(c, axis=1).reshape(-1) for _, c in frames]  # unit, component, place
    return n, (np.concatenate(parts) - 1).astype(np.uint8).tobytes()[:size]


def media(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and media: each text as a file."""
    ship(df.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, out = batch.column(0), 0, []
            first = 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                out.append(store(text))
                size += len(out[-1])
                if size >= DECODED:
                    yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(first, len(out)), "media": pa.array(out, pa.binary())})
                    first, size, out = k + 1, 0, []
            if out:
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(first), "media": pa.array(out, pa.binary())})

    return df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).mapInArrow(run, "doc_id long, media binary")


def digests(stored: DataFrame) -> DataFrame:
    """What the stored files hold, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and feature (the shots as first-end frames, and the mean difference of
    adjacent histograms in millionths)."""
    ship(stored.sparkSession)
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            files = batch.column(1).to_pylist()
            for i, data, (parsed, frames, h) in zip(batch.column(0).to_pylist(), files, decode_clips(files)):
                n, payload = read_payload(parsed, frames)
                change = round(float(np.abs(np.diff(h, axis=0)).sum(1).mean()) * 5e5) if len(h) > 1 else 0
                feature = ";".join([f"{len(h)} frames", ",".join(f"{a}-{b}" for a, b in shots(h)), str(change)])
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pa.RecordBatch.from_pydict({x: pa.array([r[k] for r in out], t) for k, (x, t) in enumerate(names)})

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
