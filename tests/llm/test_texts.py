import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, odd_texts, words
from weftgraph.llm import avi_media, best_fit_packing, byte_bpe, doc_stats, wordhash
from weftgraph.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY


def _noise(n, seed):
    rng = random.Random(seed)
    common = [chr(c) for c in range(32, 127)]
    rare = [chr(c) for c in [*range(0, 0x180), 0x300, 0x301, 0x3A3, 0x661, 0x2003, 0x2028, 0x2167, 0x3000, 0xFEFF, 0x1F44D, 0x65E5]]
    return ["".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(60)) for _ in range(n)]


def test_words_match_the_pattern():
    texts = [*odd_texts(), *_noise(300, 1), "ab", "cd"]
    w = wordhash.split_words(pa.array(texts, pa.string()))
    raw = w.data.tobytes()
    for k, text in enumerate(texts):
        assert [raw[a:b].decode() for a, b in zip(w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]])] == words(text)
    hashes = wordhash.word_hashes(w).tolist()
    by_word = {}
    for h, a, b in zip(hashes, w.start, w.end):
        assert by_word.setdefault(raw[a:b], h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_slices_of_arrays_are_read_at_their_offset():
    texts = pa.array(["a b", None, "c", "d e f"])
    assert np.diff(wordhash.split_words(texts.slice(2, 2)).first).tolist() == [1, 3]
    assert len(wordhash.split_words(texts.slice(4)).start) == 0


def _counts(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 2000 else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, covered if covered is None else len(covered)


def test_statistics_match_brute_force():
    texts = [t for t in odd_texts() if not t or len(t) < 4000] + _noise(100, 2)
    s = doc_stats.statistics(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert tuple(int(s[c][k]) for c in doc_stats.COUNTS) == _counts(text)


def test_word_ids_equal_the_tokenizer():
    coder = best_fit_packing.WordIds(WORD_VOCABULARY)
    texts = [*odd_texts(), *_noise(1500, 3), "I'll DON'T 's'S <|endoftext|> ΑΣ İx 가 ᆨ é́"]
    ids, bounds = coder(pa.array(texts, pa.string()))
    for k, expected in enumerate(coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == expected.ids


def test_byte_bpe_equals_tiktoken():
    import tiktoken

    bpe = byte_bpe.ByteBpe(BYTE_VOCABULARY, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_VOCABULARY, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for t in odd_texts()] + _noise(1500, 4)
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids == reference.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_byte_bpe_over_a_table(spark):
    rows = byte_bpe.encode_and_decode(documents(spark, odd_texts(), extra=True), BYTE_VOCABULARY, P.PATTERN).collect()
    by_id = {r.doc_id: r for r in rows}
    for k, text in enumerate(odd_texts()):
        assert bytes(by_id[k].decoded) == (text or "").encode() and by_id[k].n_tokens == len(by_id[k].ids)
    assert byte_bpe.encode_and_decode(documents(spark, []), BYTE_VOCABULARY, P.PATTERN).count() == 0


@pytest.mark.parametrize("open_bins", [1, 4, 10_000])
def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest(open_bins):
    rng = random.Random(open_bins)
    bins, free, order = best_fit_packing.BestFit(64, open_bins), {}, []
    for _ in range(3000):
        n = rng.randrange(1, 65)
        number, offset = bins.place(n)
        fits = [f for f in free.values() if f >= n]
        if fits:
            assert free[number] == min(fits) and offset == 64 - free[number]
        else:
            assert offset == 0 and number not in free
            if len(free) >= open_bins:
                closed = min(free, key=lambda b: (free[b], -order.index(b)))
                lowest = free[closed]
                # any bin of the least free space may be the one that closed
                same = [b for b in free if free[b] == lowest]
                gone = next(b for b in same if b not in {x for stack in bins.stacks for x in stack})
                del free[gone]
            free[number] = 64
        order.append(number)
        free[number] -= n
        if not free[number]:
            del free[number]


def test_packing_covers_every_token_once(spark):
    texts = odd_texts() * 2
    ids = [*range(len(odd_texts())), *range(len(odd_texts()))]
    rows = best_fit_packing.pack_documents(spark, documents(spark, texts, ids, extra=True), WORD_VOCABULARY).collect()
    coder = best_fit_packing.WordIds(WORD_VOCABULARY)
    total = 0
    for k, text in enumerate(odd_texts()):
        coded = np.array([*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == k)
        expected = [(p, s, len(coded[s : s + 2048]), zlib.crc32(coded[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(coded), 2048))]
        assert mine == sorted(expected * 2)
        total += 2 * len(coded)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-total // 2048) + 2
    assert best_fit_packing.pack_documents(spark, documents(spark, []), WORD_VOCABULARY).count() == 0


def test_avi_round_trip_and_headers():
    rng = random.Random(5)
    for n in [0, 1, 191, 192, 193, 4000]:
        raw = bytes(rng.choice([255, 0, 128, rng.randrange(256)]) for _ in range(n))
        payload = avi_media.padded(raw)
        data = avi_media.encode_avi(payload)
        avi = avi_media.decode_avi(data)
        assert avi.frames.tobytes() == payload and payload.startswith(raw) and set(payload[n:]) <= {32}
        assert (avi.width, avi.height, avi.rate) == (16, 12, 25.0) and data[:4] == b"RIFF" and data.count(b"idx1") >= 1
    with pytest.raises(ValueError):
        avi_media.decode_avi(b"RIFF\x04\0\0\0WAVE")


def test_shots_are_cut_where_histograms_jump():
    dark, light = np.full((10, 12, 16), 20, np.uint8), np.full((8, 12, 16), 220, np.uint8)
    assert avi_media.shot_starts(np.concatenate([dark, light, dark])).tolist() == [0, 10, 18]
    assert avi_media.shot_starts(dark).tolist() == [0]


def test_media_columns_and_clips(spark):
    docs = documents(spark, [*odd_texts(), None], [*range(len(odd_texts())), 7], extra=True)
    media = avi_media.media_column(docs)
    rows = avi_media.media_digests(media).collect()
    assert len(rows) == len(odd_texts()) + 1
    for r in rows:
        text = odd_texts()[r.doc_id] if r.n_bytes else ""
        payload = avi_media.padded((text or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    clips = avi_media.clips(media).where("doc_id = 12").orderBy("clip").collect()
    assert clips[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(clips, clips[1:]))
