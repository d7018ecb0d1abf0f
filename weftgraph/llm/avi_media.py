"""Media columns: AVI files of losslessly coded motion-JPEG frames.

Writing: a payload is cut into frames of 16 x 12 grey samples. Each frame is a
lossless (predictive, SOF3) JPEG with left prediction. Its Huffman table gives
category s a code of 9 - s bits, so that code and magnitude bits together are
9 bits for every sample; coding and decoding are table lookups on whole arrays.
Frames go into a RIFF AVI file with an ``idx1`` index.

Reading walks the RIFF chunks and finds the frames through the index (by the
chunks themselves where there is none, and in further RIFF parts). Frames with the
head written here are decoded all at once; any other motion-JPEG frames, baseline
or lossless, go through ``jpeg``, which gives their luma. Shots are cut where the
grey histograms of neighbouring frames differ by more than an adaptive threshold
(mean and spread of the differences around), which yields clip rows with start and
end times.

Scale: narrow, one pass, one document at a time; memory is a small multiple of
the longest document.

Defined results: a null text is an empty one; its payload is one frame of
spaces. Equal texts give equal results. Repeated rows are coded each. A null
media value has no clips. A file without frames has none either; an empty frame
repeats the one before it. Files that are no AVI, are damaged, or have frames of
several sizes raise a ValueError. Other columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .runtime import bounded_batches, only

WIDTH, HEIGHT, RATE = 16, 12, 25
FRAME = WIDTH * HEIGHT
BINS = 16
#: Frames on each side of a cut that set its threshold, and spreads above their mean.
AROUND, SPREADS, FLOOR = 12, 3.0, 0.25


def _coding_tables() -> tuple[np.ndarray, np.ndarray]:
    """9-bit word of each difference (index + 255), and back (-1000: no such word)."""
    words, back = np.zeros(511, np.uint16), np.full(512, -1000, np.int16)
    for difference in range(-255, 256):
        s = abs(difference).bit_length()
        length = 9 - s
        magnitude = difference if difference > 0 else difference + (1 << s) - 1
        words[difference + 255] = ((1 << length) - 2) << s | magnitude
        back[words[difference + 255]] = difference
    return words, back


_WORDS, _BACK = _coding_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Everything of a frame before its coded samples: start, Huffman table, frame and scan headers.
JPEG_HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC3, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0))
    + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
)
JPEG_END = b"\xff\xd9"


def padded(raw: bytes) -> bytes:
    """raw with spaces up to a positive multiple of a frame."""
    return raw + b" " * (-len(raw) % FRAME or (FRAME if not raw else 0))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload (a multiple of FRAME bytes)."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    n = len(frames)
    left = np.empty_like(frames)
    left[:, :, 1:] = frames[:, :, :-1]
    left[:, 1:, 0] = frames[:, :-1, 0]
    left[:, 0, 0] = 128
    v = _WORDS[frames - left + 255].reshape(n, FRAME // 8, 8)
    packed = np.empty((n, FRAME // 8, 9), np.uint8)
    for k in range(9):  # byte k has the last k bits of word k-1 and the first 8-k of word k
        low = v[:, :, k - 1] << (8 - k) if k else 0
        high = v[:, :, k] >> (k + 1) if k < 8 else 0
        packed[:, :, k] = (low | high) & 255
    flat = packed.reshape(-1)
    size = packed.shape[1] * 9
    full = np.flatnonzero(flat == 255)
    stuffed = np.insert(flat, full + 1, 0) if len(full) else flat
    lengths = size + np.bincount(full // size, minlength=n)
    sizes = len(JPEG_HEAD) + lengths + 2
    whole = 8 + sizes + (sizes & 1)
    place = np.concatenate([[0], np.cumsum(whole)])
    movi = np.zeros(place[-1], np.uint8)
    head = np.frombuffer(b"00dc\0\0\0\0" + JPEG_HEAD, np.uint8)
    movi[place[:-1, None] + np.arange(len(head))] = head
    movi[place[:-1, None] + np.arange(4, 8)] = sizes.astype("<u4").view(np.uint8).reshape(n, 4)
    began = np.cumsum(lengths) - lengths
    movi[np.arange(len(stuffed)) + np.repeat(place[:-1] + len(head) - began, lengths)] = stuffed
    ends = place[:-1] + len(head) + lengths
    movi[ends], movi[ends + 1] = 0xFF, 0xD9

    index = np.zeros((n, 4), "<u4")
    index[:, 0] = np.frombuffer(b"00dc", "<u4")[0]
    index[:, 1] = 0x10  # a key frame, as all are
    index[:, 2] = place[:-1] + 4
    index[:, 3] = sizes
    avih = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, n, 0, 1, int(sizes.max()), WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, RATE, 0, n, int(sizes.max()), 0, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"movi" + movi.tobytes()) + _chunk(b"idx1", index.tobytes()))


def riff_chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between two places."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + size > end:
            raise ValueError("a RIFF chunk runs over its list")
        yield name, start + 8, start + 8 + size
        start += 8 + size + (size & 1)


class Avi(NamedTuple):
    width: int
    height: int
    rate: float
    frames: np.ndarray  # uint8 [frames, height, width]


def _listed(data: bytes, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Place and size of the video chunks between two places, those in rec lists too."""
    for name, a, b in riff_chunks(data, start, end):
        if name == b"LIST":
            yield from _listed(data, a + 4, b)
        elif name[2:] in (b"dc", b"db"):
            yield a, b - a


def _places(data: bytes) -> tuple[list[tuple[int, int]], float]:
    """Place and size of every frame, and the frames a second."""
    parts = [(start, end) for name, start, end in riff_chunks(data, 0, len(data)) if name == b"RIFF"]
    if not parts or data[parts[0][0] : parts[0][0] + 4] != b"AVI ":
        raise ValueError("not an AVI file")
    found: list[tuple[int, int]] = []
    rate = 0.0
    for start, end in parts:
        movi, index = None, b""
        for name, a, b in riff_chunks(data, start + 4, end):
            if name == b"LIST" and data[a : a + 4] == b"movi":
                movi = a, b
            elif name == b"idx1":
                index = data[a:b]
            elif name == b"LIST" and data[a : a + 4] == b"hdrl":
                for inner, c, _ in riff_chunks(data, a + 4, b):
                    if inner == b"avih" and (span := struct.unpack_from("<I", data, c)[0]):
                        rate = 1e6 / span
        if movi and index:
            entries = np.frombuffer(index, "<u4", len(index) // 16 * 4).reshape(-1, 4)
            kinds = entries[:, 0] >> 16
            entries = entries[(kinds == int.from_bytes(b"dc", "little")) | (kinds == int.from_bytes(b"db", "little"))]
            if len(entries):  # offsets count from the list's name or from the file's start
                first = int(entries[0, 2])
                base = movi[0] if data[movi[0] + first : movi[0] + first + 4] == entries[0, :1].tobytes() else 0
                found += zip((entries[:, 2].astype(np.int64) + base + 8).tolist(), entries[:, 3].tolist(), strict=True)
        elif movi:
            found += _listed(data, movi[0] + 4, movi[1])
    if any(a + n > len(data) for a, n in found):
        raise ValueError("the index points behind the file")
    return found, rate


def decode_avi(data: bytes) -> Avi:
    """Parse the file and decode the frames that its index lists."""
    found, rate = _places(data)
    if not found:
        return Avi(0, 0, rate, np.zeros((0, 0, 0), np.uint8))
    place, size = (np.array(x, np.int64) for x in zip(*found, strict=True))
    raw, head = np.frombuffer(data, np.uint8), np.frombuffer(JPEG_HEAD, np.uint8)
    if (size > len(head) + 2).all() and (raw[place[:, None] + np.arange(len(head))] == head).all():
        frames = _own_frames(raw, place, size)
    else:
        frames = _any_frames(data, found)
    return Avi(frames.shape[2], frames.shape[1], rate, frames)


def _any_frames(data: bytes, found: list[tuple[int, int]]) -> np.ndarray:
    tables, frames = jpeg.Tables(), []
    for a, n in found:
        if n:
            frames.append(jpeg.decode_grey(data[a : a + n], tables))
        elif frames:
            frames.append(frames[-1])
    if len({f.shape for f in frames}) > 1:
        raise ValueError("frames differ in their size")
    return np.stack(frames) if frames else np.zeros((0, 0, 0), np.uint8)


def _own_frames(raw: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Frames that begin with JPEG_HEAD, all at once."""
    n, head = len(place), len(JPEG_HEAD)
    lengths = size - head - 2
    began = np.cumsum(lengths) - lengths
    scan = raw[np.arange(lengths.sum()) + np.repeat(place + head - began, lengths)]
    keep = np.ones(len(scan), bool)
    keep[1:] = (scan[:-1] != 255) | (scan[1:] != 0)
    if keep.sum() != n * FRAME // 8 * 9:
        raise ValueError("a frame is damaged")
    packed = scan[keep].reshape(n, FRAME // 8, 9).astype(np.uint16)
    words = np.empty((n, FRAME // 8, 8), np.uint16)
    for k in range(8):  # word k has the last 8-k bits of byte k and the first k+1 of byte k+1
        words[:, :, k] = ((packed[:, :, k] << (k + 1)) | (packed[:, :, k + 1] >> (7 - k))) & 511
    frames = _BACK[words].reshape(n, HEIGHT, WIDTH)
    if frames.min() < -255:
        raise ValueError("a frame has a word that no table holds")
    frames = frames.astype(np.int32)
    frames[:, 0, 0] += 128
    frames[:, :, 0] = np.cumsum(frames[:, :, 0], axis=1)
    return (np.cumsum(frames, axis=2) & 255).astype(np.uint8)


def shot_starts(frames: np.ndarray) -> np.ndarray:
    """First frames of the shots, 0 among them."""
    n = len(frames)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    keys = (np.arange(n)[:, None] * BINS + (frames.reshape(n, -1) >> 4)).ravel()
    histograms = np.bincount(keys, minlength=n * BINS).reshape(n, BINS)
    change = np.abs(np.diff(histograms, axis=0)).sum(1) / (2 * frames[0].size)
    run, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (change, change**2))
    low, high = np.maximum(np.arange(n - 1) - AROUND, 0), np.minimum(np.arange(n - 1) + AROUND + 1, n - 1)
    others = np.maximum(high - low - 1, 1)
    mean = (run[high] - run[low] - change) / others
    spread = np.sqrt(np.maximum((squares[high] - squares[low] - change**2) / others - mean**2, 0))
    cut = change > np.maximum(mean + SPREADS * spread, FLOOR) + 1e-9
    return np.concatenate([[0], np.flatnonzero(cut) + 1])


def _rows(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the AVI file of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                raw = [(t or "").encode() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(r) for r in raw], pa.int64()), pa.array([encode_avi(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def timed_clips(avi: Avi) -> list[tuple[int, int, int, float, float]]:
    """Number, first frame, frames, and start and end in seconds of every shot."""
    starts, rate = shot_starts(avi.frames).tolist(), avi.rate or float(RATE)
    return [(k, a, b - a, a / rate, b / rate) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(avi.frames)], strict=False))]


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of the shots of every media file (doc_id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for doc, data in zip(batch["doc_id"].to_pylist(), batch["media"].to_pylist(), strict=True):
                if data is None:
                    continue
                avi = decode_avi(data)
                for k, a, n, start, end in timed_clips(avi):
                    rows.append({"doc_id": doc, "clip": k, "first_frame": a, "n_frames": n, "start_s": start, "end_s": end, "mean_level": float(avi.frames[a : a + n].mean())})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int64()), ("n_frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_level", pa.float64())]))

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, first_frame long, n_frames long, start_s double, end_s double, mean_level double")


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips string"


def media_digests(media: DataFrame) -> DataFrame:
    """Read media files back and describe them: digests, frames, shots, and the clips' times (start-end in seconds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _DIGESTS.split(", ")])
        for batch in batches:
            rows = []
            for doc, n, data in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist(), strict=True):
                avi = decode_avi(data)
                frames, shots = avi.frames, timed_clips(avi)
                payload = frames.tobytes()
                feature = f"frames={len(frames)};shots={len(shots)};starts={','.join(str(a) for _, a, *_ in shots)};mean={frames.mean():.4f}"
                times = ",".join(f"{start:.2f}-{end:.2f}" for *_, start, end in shots)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, times))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return media.mapInArrow(run, _DIGESTS)
