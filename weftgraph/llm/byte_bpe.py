"""Byte-level BPE through a sentencepiece model made from a rank file.

A rank file lists byte strings by merge rank. The same merges are expressed as
a sentencepiece BPE model without any training: every byte gets one printable
character, a token becomes the string of its bytes' characters, its score is
minus its rank, and the normaliser is the identity. The model is written field
by field in the protobuf wire format. A text is cut by the split pattern, each
pre-token is mapped to characters and encoded by sentencepiece; decoding maps
ids back to their bytes.

Two rules differ between the two libraries and are handled here: a pre-token
that is itself a token is that token, and sentencepiece's ids are ranks plus
one (id 0 is its unknown piece, which cannot occur: all 256 bytes are tokens).

Scale: narrow, one pass, no shuffle; a worker's memory is the model plus a
bounded cache of pre-tokens.

Defined results: a null text counts as empty; no tokens, and the hashes of the
empty string. Repeated rows give repeated results. Texts of any length are
encoded whole. Merges have distinct ranks, so nothing ties. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_batches, only

#: Pre-tokens whose ids an encoding worker remembers, in each of two generations.
CACHED_PRETOKENS = 400_000

#: Letters and numbers up to U+024F by Unicode's tables; a text of these, ASCII and white space is split by ``re``.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_COMMON = re.compile("[\x00-ɏ‐-‧]*")


def byte_characters() -> list[str]:
    """One printable character per byte: U+0100 on for all, none is white space."""
    return [chr(0x100 + b) for b in range(256)]


_CHARACTERS = byte_characters()


def _mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate({b: _CHARACTERS[b] for b in raw})


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from lines of base64 and rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [found[r] for r in range(len(found))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised ModelProto: unknown piece, then all tokens by rank."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    pieces += [_field(1, _field(1, _mapped(t).encode()) + _field(2, float(-rank)) + _field(3, normal)) for rank, t in enumerate(tokens)]
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.ranks = {t: r for r, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.split = regex.compile(pattern).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
        self.plain = re.compile(plain).findall if r"\p" not in plain else None
        self.table = {b: c for b, c in enumerate(_CHARACTERS)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def pretokens(self, text: str) -> list[str]:
        if self.plain and _COMMON.fullmatch(text) and not _ODD.search(text):
            return self.plain(text)
        return self.split(text)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        parts = [self.pretokens(t) for t in texts]
        if len(self.known) > CACHED_PRETOKENS:
            self.older, self.known = self.known, {}
        known, older, todo = self.known, self.older, []
        missing = set().union(*parts).difference(known)
        known.update((w, older[w]) for w in missing.intersection(older))
        for word in missing.difference(older):
            whole = self.ranks.get(raw := word.encode())
            if whole is None:
                todo.append((word, raw.decode("latin-1").translate(self.table)))
            else:
                known[word] = (whole,)
        for at in range(0, len(todo), 20_000):
            part = todo[at : at + 20_000]
            for (word, _), ids in zip(part, self.model.encode([m for _, m in part], num_threads=1), strict=True):
                known[word] = tuple(i - 1 for i in ids)
        for each in parts:
            yield list(chain.from_iterable(map(known.__getitem__, each)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: U+001C-U+001F are white space to ``re`` alone and U+0085 and others need care: such texts take the general splitter.
_ODD = re.compile("[\x1c-\x1f\x85\xa0]")

RESULT_SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded binary"


def _coder(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                counts, first, second = [], [], []
                for ids in bpe.encode([t or "" for t in part["text"].to_pylist()]):
                    counts.append(len(ids))
                    decoded = bpe.decode(ids)
                    first.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if digests else ids)
                    second.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
                kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    return run


def encode_and_decode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Per document: n_tokens, ids and the bytes decoded from them.

    digests: instead of both, their SHA-256 (ids as decimals joined by commas).
    """
    bounded_batches(docs.sparkSession)
    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else RESULT_SCHEMA
    return rows.mapInArrow(_coder(path, pattern, digests), schema)
