"""Motion-JPEG files of other makers: frames against the JVM's own decoder, and RIFF layouts."""

import struct

import numpy as np
import pytest

from tests.llm.helpers import documents, odd_texts
from weftgraph.llm import avi_media, jpeg


def _jvm_jpeg(spark, pixels):
    """JPEG bytes that the JVM writes, and the samples that it reads back (grey, or rgb)."""
    jvm = spark.sparkContext._jvm
    kind = jvm.java.awt.image.BufferedImage
    colour = pixels.ndim == 3
    image = kind(pixels.shape[1], pixels.shape[0], kind.TYPE_INT_RGB if colour else kind.TYPE_BYTE_GRAY)
    raster = image.getRaster()
    flat = spark.sparkContext._gateway.new_array(jvm.int, int(pixels.size))
    for k, v in enumerate(pixels.reshape(-1).tolist()):
        flat[k] = v
    raster.setPixels(0, 0, pixels.shape[1], pixels.shape[0], flat)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(out.toByteArray())).getRaster()
    values = spark.sparkContext._gateway.new_array(jvm.int, int(pixels.size))
    return data, np.array(list(back.getPixels(0, 0, pixels.shape[1], pixels.shape[0], values))).reshape(pixels.shape)


def _without(data, marker):
    """A frame without the segments of one kind."""
    out, at = [data[:2]], 2
    while data[at + 1] != 0xDA:
        size = 2 + struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] != marker:
            out.append(data[at : at + size])
        at += size
    return b"".join([*out, data[at:]])


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[0:19, 0:29]
    smooth = ((np.sin(x / 5) + np.cos(y / 4)) * 50 + 120 + rng.integers(-9, 9, x.shape)).astype(int)
    return smooth, _jvm_jpeg(spark, smooth), _jvm_jpeg(spark, np.stack([smooth, 255 - smooth, smooth // 2], axis=2))


def test_baseline_frames_equal_the_jvms_decoder(frames):
    _, (grey, seen), (colour, rgb) = frames
    got = jpeg.decode_grey(grey)
    assert got.shape == seen.shape and np.abs(got - seen).max() <= 1
    luma = rgb @ np.array([0.299, 0.587, 0.114])
    assert np.abs(jpeg.decode_grey(colour) - luma).max() <= 6 and np.abs(jpeg.decode_grey(colour) - luma).mean() < 1.5


def test_frames_without_tables_use_the_typical_ones(frames):
    for data, _ in frames[1:]:
        bare = _without(data, 0xC4)
        assert len(bare) < len(data) and (jpeg.decode_grey(bare) == jpeg.decode_grey(data)).all()


def _lossless(pixels, predictor, every=0):
    """A lossless frame with the typical code for differences."""
    counts, _ = jpeg.TYPICAL[0, 0]
    codes, code, symbol = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            codes[symbol] = format(code, f"0{length}b")
            code, symbol = code + 1, symbol + 1
        code <<= 1
    height, width = pixels.shape
    parts, bits, first, p = [], "", 0, pixels.astype(int)
    for unit in range(height * width):
        y, x = divmod(unit, width)
        if every and unit and unit % every == 0:
            parts.append(bits)
            bits, first = "", y
        a, b, c = p[y, x - 1], p[y - 1, x], p[y - 1, x - 1]
        guess = (p[y, x - 1] if x else 128) if y == first else p[y - 1, 0] if not x else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
        d = (int(p[y, x]) - int(guess) + 128) % 256 - 128
        s = abs(d).bit_length()
        bits += codes[s] + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "")
    parts.append(bits)
    seg = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    data = b"\xff\xd8" + seg(0xC4, bytes([0, *counts, *range(12)])) + seg(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
    if every:
        data += seg(0xDD, struct.pack(">H", every))
    data += seg(0xDA, bytes([1, 1, 0, predictor, 0, 0]))
    for k, x in enumerate(parts):
        x += "1" * (-len(x) % 8)
        raw = bytes(int(x[i : i + 8], 2) for i in range(0, len(x), 8)).replace(b"\xff", b"\xff\0")
        data += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + raw
    return data + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_frames_of_all_predictors(predictor):
    pixels = np.random.default_rng(predictor).integers(0, 256, (9, 13))
    assert (jpeg.decode_grey(_lossless(pixels, predictor)) == pixels).all()
    assert (jpeg.decode_grey(_lossless(pixels, predictor, 26)) == pixels).all()


def test_damaged_and_foreign_frames_are_refused(frames):
    data = frames[1][0]
    for bad in (b"", b"\xff\xd8", data[: len(data) // 3], data.replace(b"\xff\xc0", b"\xff\xc2"), _without(data, 0xDB), b"GIF89a" + data):
        with pytest.raises(ValueError):
            jpeg.decode_grey(bad)


def _file(images, index="list", lists=False, extra=b""):
    chunk, body, entries = avi_media._chunk, b"", []
    for k, image in enumerate(images):
        for name, data in ((b"01wb", b"sound"), (b"00dc", image)):
            entries.append((name, 0x10, len(body) + 4, len(data)))
            body += chunk(b"LIST", b"rec " + chunk(name, data)) if lists else chunk(name, data)
    avih = struct.pack("<14I", 40_000, 0, 0, 0x10, len(images), 0, 2, 0, 8, 8, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih))
    base = 12 + len(head) + 8 if index == "file" else 0
    table = b"".join(struct.pack("<4sIII", n, f, at + base, size) for n, f, at, size in entries)
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + body) + (chunk(b"idx1", table) if index else b"")) + extra


def test_files_are_read_by_index_or_by_their_chunks(frames):
    smooth, (grey, _), _ = frames
    pixels = [smooth.astype(np.uint8), np.full(smooth.shape, 9, np.uint8)]
    images = [_lossless(pixels[0], 1), _lossless(pixels[1], 4), b"", _lossless(pixels[0], 7)]
    expected = np.stack([pixels[0], pixels[1], pixels[1], pixels[0]])
    more = avi_media._chunk(b"RIFF", b"AVIX" + avi_media._chunk(b"LIST", b"movi" + avi_media._chunk(b"00dc", images[1])))
    for data, want in ((_file(images), expected), (_file(images, "file"), expected), (_file(images, None), expected), (_file(images, None, True), expected), (_file(images, "list", False, more), np.concatenate([expected, expected[1:2]]))):
        avi = avi_media.decode_avi(data)
        assert avi.rate == 25.0 and avi.frames.shape == want.shape and (avi.frames == want).all()
    assert len(avi_media.decode_avi(_file([])).frames) == 0 and avi_media.timed_clips(avi_media.decode_avi(_file([]))) == []
    with pytest.raises(ValueError, match="size"):
        avi_media.decode_avi(_file([images[0], _lossless(pixels[0][:5], 1)]))


def test_clips_of_other_makers_files_have_times(spark, frames):
    dark, light = _lossless(np.full((8, 8), 10), 1), _lossless(np.full((8, 8), 240), 1)
    media = spark.createDataFrame([(1, bytearray(_file([dark] * 5 + [light] * 5))), (2, None), (3, bytearray(_file([])))], "doc_id long, media binary")
    rows = [(r.doc_id, r.clip, r.first_frame, r.n_frames, round(r.start_s, 3), round(r.end_s, 3), r.mean_level) for r in avi_media.clips(media).collect()]
    assert rows == [(1, 0, 0, 5, 0.0, 0.2, 10.0), (1, 1, 5, 5, 0.2, 0.4, 240.0)]


def test_digests_have_the_clips_times_and_empty_tables_none(spark):
    docs = documents(spark, odd_texts(), extra=True)
    media = avi_media.media_column(docs)
    times = {}
    for r in avi_media.clips(media).orderBy("doc_id", "clip").collect():
        times.setdefault(r.doc_id, []).append(f"{r.start_s:.2f}-{r.end_s:.2f}")
    assert {r.doc_id: r.clips for r in avi_media.media_digests(media).collect()} == {k: ",".join(v) for k, v in times.items()}
    empty = avi_media.media_column(docs.limit(0))
    assert avi_media.media_digests(empty).count() == 0 and avi_media.clips(empty).count() == 0
