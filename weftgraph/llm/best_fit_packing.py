"""Packing token sequences by bounded-space online best fit.

Every document becomes pieces of at most ``capacity`` tokens; pieces are put
into sequences of that capacity. A packer holds a fixed number of open bins.
They are keyed by free space: ``stacks[f]`` holds the open bins with ``f``
tokens free and bit ``f`` of one integer says whether that stack has any, so
the tightest bin that still fits a piece is the lowest set bit at or above its
length. When a new bin is needed and all are open, the fullest is closed.

Scale: tokens are made where the text is read and only (document, piece,
length) rows are dealt out, by a hash that no key can make uneven. The number
of packers follows the number of pieces, each sorts its pieces from long to
short (spilling if need be) and streams them through fixed memory, so the waste
is at most a few sequences a packer.

Defined results: a null or empty text is one piece, the end marker alone.
Rows that repeat a doc_id, a null doc_id too, are documents of their own; their
pieces come out as often as the rows do. Other columns are ignored. An empty
table gives no rows. Texts of any length are cut into pieces, never shortened.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, bounded_batches, only
from .wordhash import split_words, word_hashes

CAPACITY = 2048
#: Open bins of a packer. Each costs about 200 bytes.
OPEN_BINS = 65_536
#: Pieces that one packer takes, on average.
PIECES_A_PACKER = 250_000
#: Words whose ids a tokenising worker remembers.
CACHED_WORDS = 400_000

PIECE_SCHEMA = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
#: Words of these characters are unchanged by NFC and split alike by ``re`` and the vocabulary's own pattern.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*").fullmatch
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]| |[^a-zß-öø-ÿ0-9 ]+").findall
_END = "\x01"


def _byte_of() -> dict[str, int]:
    """Bytes by the printable character that byte-level vocabularies write for them."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordIds:
    """Token ids of texts, made once per distinct word and gathered by numpy.

    White space ends a word in the vocabulary's own splitting rule and is
    dropped, and its normaliser never joins across it; so the ids of a text
    are those of its white-space words in turn. Words are told apart by a
    64-bit hash and remembered in a bounded cache. New words of plain
    characters are split into the rule's pre-tokens and merged many at a time
    by the same ranks (the mark that ends a pre-token is one more byte, merged
    first); all others go through the tokenizer one by one, words that hold an
    added token such as an end marker too.
    """

    def __init__(self, path: str, suffix: str = "</w>") -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(not t.content or t.single_word or re.search(r"\s", t.content) for t in added):
            raise ValueError("added tokens that depend on what stands around them are not supported")
        marks = "|".join(re.escape(t.content) for t in added)
        self.marked = re.compile(marks, re.IGNORECASE).search if marks else lambda word: None
        byte_of = _byte_of()
        ranks: dict[bytes, int] = {}
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            ends = token.endswith(suffix)
            core = token[: -len(suffix)] if ends else token
            if all(c in byte_of for c in core):
                ranks[bytes(byte_of[c] for c in core) + _END.encode() * ends] = number
        self.space = ranks[b" " + _END.encode()]
        self.merger = tiktoken.Encoding("words", pat_str=f"[^{_END}]*{_END}", mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids, self.offset = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        plain = [k for k, word in enumerate(words) if _PLAIN(word) and not self.marked(word)]
        chosen = set(plain)
        rest = [k for k in range(len(words)) if k not in chosen]
        coded = np.zeros(0, "<u4")
        lengths = np.zeros(0, np.int64)
        if plain:
            parts = _PARTS(" ".join([words[k] for k in plain]).lower())
            coded = np.array(self.merger.encode_ordinary(_END.join(parts) + _END), "<u4")
            spaces = np.flatnonzero(coded == self.space)
            lengths = np.diff(np.concatenate([[-1], spaces, [len(coded)]])) - 1
            coded = np.delete(coded, spaces)
        others = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)]
        self.place.update(zip([keys[k] for k in plain + rest], range(len(self.place), len(self.place) + len(keys)), strict=True))
        self.ids = np.concatenate([self.ids, coded, *others])
        lengths = np.concatenate([lengths, np.array([len(x) for x in others], np.int64)])
        self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(lengths)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and each text's offsets into them."""
        w = split_words(texts)
        if len(self.place) > CACHED_WORDS:
            self._forget()
        distinct, first, group = np.unique(word_hashes(w), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        missing = [k for k, key in enumerate(keys) if key not in self.place]
        if missing:
            raw, at = w.data.tobytes(), first[missing]
            self._learn([keys[k] for k in missing], [raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
        place = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[group]
        lengths = self.offset[place + 1] - self.offset[place]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.offset[place] - ends[:-1], lengths)]
        return ids, ends[w.first]


def _pieces(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, mark = WordIds(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            if batch.num_rows:
                coded, bounds = coder(batch["text"])
                raw, bounds = coded.tobytes(), (4 * bounds).tolist()
                rows: list[tuple] = []
                for doc, copy, begin, end in zip(batch["doc_id"].to_pylist(), batch["copy"].to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    ids = raw[begin:end] + mark
                    for k, place in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[place : place + 4 * capacity]
                        rows.append((doc, copy, k, place // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def tokenised_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, copy, piece, start, length, ids_crc32."""
    bounded_batches(docs.sparkSession, megabytes=4)
    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(vocabulary, end_id, capacity), PIECE_SCHEMA)


class BestFit:
    """Open bins of one packer; place() gives a piece's (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.count = self.made = 0

    def _pop(self, free: int) -> int:
        stack = self.stacks[free]
        out = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        return out

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._pop(free)
            self.count -= 1
        else:
            if self.count >= self.limit:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes first
                self.count -= 1
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if not self.stacks[left]:
                self.bits |= 1 << left
            self.stacks[left].append(number)
            self.count += 1
        return number, self.capacity - free


def _packer(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch["length"].to_pylist()]
            numbers, offsets = zip(*placed, strict=True) if placed else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + n for n in numbers], pa.int64()), pa.array(offsets, pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_a_packer: int = PIECES_A_PACKER) -> DataFrame:
    """Add sequence_id and offset to rows that have a length of 1 to capacity.

    The rows must be cheap to read again (a stored table): they are counted
    first, for the number of packers.
    """
    packers = max(1, math.ceil(pieces.count() / pieces_a_packer))
    order = [F.col("length").desc(), *[F.col(c) for c in pieces.columns if c != "length"]]
    dealt = pieces.repartition(packers, F.xxhash64(*pieces.columns)).sortWithinPartitions(*order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(_packer(capacity, open_bins), f"{fields}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenise, cut and pack all documents: one row per piece."""
    stored = Scratch(spark, "packing").keep(tokenised_pieces(docs, vocabulary, end_id, capacity), "pieces")
    return pack(stored, capacity, open_bins).drop("copy")
