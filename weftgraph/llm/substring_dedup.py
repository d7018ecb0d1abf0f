"""Removal of word sequences that repeat across documents, by fixed-block anchors.

A word goes when a window of 13 words covers it whose sequence also starts in a
document with a smaller doc_id. A window of 13 holds a whole block of 7 of any
division of a text into blocks, so:

1. every document's non-overlapping blocks of 7 words are the index, and all
   its rolling 7-word runs probe it. Batches of documents send both, packed, to
   hash ranges and learn which runs meet a block elsewhere;
2. around those hits the repeats are extended: each 13-word window that holds a
   hit is looked up by a long digest, so what survives is exactly the windows
   that repeat, and runs of them are the maximal exact repeats;
3. these documents are kept in doc_id order, in batches of disjoint id ranges,
   so whether a smaller document has a window follows from the batches that
   hold it and, within a batch, from the rows.

Scale: a probe is 5 bytes: 32 bits of hash within its range and the document's
number in its batch. There are as many ranges as the bytes of all texts ask for,
so that a range's group stays at some megabytes however long the texts are, and
false hits (which cost work, not results) at one in 30,000. A window's digest is
56 bits within its range. A run or window is sent once a batch however often it
occurs there, so no hot passage gathers in one task. Texts without hits are not
moved at all while a filter of bounded size can hold the ids of the others; those
move once. Rows that share a doc_id, however many, fill batches of their own.

Defined results: null, empty and wordless texts have no words. Rows that share
a doc_id never remove each other's words; identical rows give identical rows. A
null doc_id counts as larger than any other (as do the last 2^40 numbers, which
stand for nulls, dealt out by their texts). A text longer than any batch is one
by itself. Other columns are ignored by deduplicated() and kept by
remove_repeats(). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import filter_of, held
from .runtime import Scratch, bounded_batches, fresh, only
from .wordhash import Words, runs, split_words, window_hashes, word_hashes

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
DOCS_A_BATCH = 256
#: Bytes of text whose runs share a hash range.
BYTES_A_RANGE = 8 << 20
_LAST = (1 << 63) - 1
#: Null ids are dealt over the numbers from here on, which all count as one.
_NULLS = 1 << 40
_NULL_ID = _LAST - _NULLS


def _ranges(size: int) -> int:
    """Bits that number the hash ranges of so many bytes of text."""
    return min(24, max(4, math.ceil(math.log2(max(1, size / BYTES_A_RANGE)))))


def _rank(ids: np.ndarray) -> np.ndarray:
    """Ids in their order: all that stand for nulls are equal and last."""
    return np.minimum(ids, _NULL_ID)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Numbered slices of the batches."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_A_BATCH):
            yield number, batch.slice(at, DOCS_A_BATCH)
            number += 1


_SENT = pa.schema([("range", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _probes(bits: int):
    """Of each batch: its documents (with the runs that meet inside it), and its distinct runs by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in _parts(batches):
            w = split_words(part["text"])
            at, hashes = window_hashes(word_hashes(w), w.first, BLOCK)
            doc = np.searchsorted(w.first, at, "right") - 1
            anchor = (at - w.first[doc]) % BLOCK == 0
            key = hashes >> np.uint64(32 - bits)
            order = np.lexsort((doc, key))
            key, doc, anchor = key[order], doc[order], anchor[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            end = np.concatenate([start[1:], [len(key)]]).astype(np.int64)
            anchored = np.logical_or.reduceat(anchor, start) if len(start) else np.zeros(0, bool)
            shared = doc[start] != doc[end - 1] if len(start) else np.zeros(0, bool)
            # runs in several documents of the batch are hits already
            inside = np.repeat(shared, end - start)
            pair = np.unique(np.stack([doc[inside].astype(np.uint64), key[inside]], axis=1), axis=0) if inside.any() else np.zeros((0, 2), np.uint64)
            table = _ids(part["doc_id"]).astype("<i8").tobytes()
            rows = [(-1 - number % (1 << bits), number, len(table).to_bytes(4, "little") + table + pair[:, 0].astype("<u1").tobytes() + pair[:, 1].astype("<u8").tobytes())]
            distinct, owner = key[start], doc[start].astype("<u1")
            state = anchored.astype("<u1") | shared.astype("<u1") << 1
            span = (distinct >> np.uint64(32)).astype(np.int64)
            for a, b in runs(span):
                flags = np.concatenate([np.packbits(state[a:b] & 1), np.packbits(state[a:b] >> 1)])
                rows.append((int(span[a]), number, distinct[a:b].astype("<u4").tobytes() + owner[a:b].tobytes() + flags.tobytes()))
            yield _rows(_SENT, rows)

    return run


def _probe_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs, owners, whether anchored, whether shared inside the batch."""
    n = len(blob) * 4 // 21  # 4 + 1 bytes and 2 bits each, the bits rounded up
    while 5 * n + 2 * ((n + 7) // 8) < len(blob):
        n += 1
    while 5 * n + 2 * ((n + 7) // 8) > len(blob):
        n -= 1
    flags = np.frombuffer(blob, np.uint8, -1, 5 * n).reshape(2, -1)
    bits = np.unpackbits(flags, axis=1)[:, :n].astype(bool)
    return np.frombuffer(blob, "<u4", n), np.frombuffer(blob, np.uint8, n, 4 * n), bits[0], bits[1]


_TOLD = pa.schema([("kind", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])


def _meet(key: tuple, rows: pa.Table) -> pa.Table:
    """Runs of a range that several batches hold and that is a block somewhere."""
    span = key[0].as_py()
    if span < 0:
        return rows.rename_columns(["kind", "batch", "blob"]).cast(_TOLD)
    parts = [_probe_blob(b) for b in rows["blob"].to_pylist()]
    keys = np.concatenate([p[0] for p in parts])
    owner, anchored, inside = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    _, group, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hit = (counts > 1) & (np.bincount(group, anchored, len(counts)) > 0)
    told = np.flatnonzero(hit[group] & ~inside)
    edges = np.searchsorted(of[told], np.arange(len(parts) + 1)).tolist()
    out = []
    for batch, a, b in zip(rows["batch"].to_pylist(), edges[:-1], edges[1:], strict=True):
        if b > a:
            at = told[a:b]
            out.append((span, batch, owner[at].tobytes() + keys[at].tobytes()))
    return pa.Table.from_batches([_rows(_TOLD, out)])


_HITS = pa.schema([("doc_id", pa.int64()), ("hits", pa.binary())])


def _hits_of(rows: pa.Table) -> pa.Table:
    """Hit runs of every document of a batch that has any."""
    owners, found, table = [], [], b""
    for kind, blob in zip(rows["kind"].to_pylist(), rows["blob"].to_pylist(), strict=True):
        if kind < 0:
            size = 4 + int.from_bytes(blob[:4], "little")
            table, n = blob[4:size], (len(blob) - size) // 9
            owners.append(np.frombuffer(blob, np.uint8, n, size))
            found.append(np.frombuffer(blob, "<u8", n, size + n))
        else:
            n = len(blob) // 5
            owners.append(np.frombuffer(blob, np.uint8, n))
            found.append(np.frombuffer(blob, "<u4", n, n).astype(np.uint64) | np.uint64(kind << 32))
    owner, run, ids = np.concatenate(owners), np.concatenate(found), np.frombuffer(table, np.int64)
    order = np.lexsort((run, owner))
    owner, run = owner[order], run[order]
    out = [(int(ids[owner[a]]), run[a:b].astype("<u8").tobytes()) for a, b in runs(owner)]
    return pa.Table.from_batches([_rows(_HITS, out)])


def _texts_held(bits: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(held(bits, _ids(batch["doc_id"]))))
            yield pa.RecordBatch.from_arrays([pa.array(_ids(part["doc_id"])), pa.nulls(part.num_rows, pa.binary()), part["text"]], names=["doc_id", "hits", "text"])

    return run


_GROUP = pa.schema([("doc_id", pa.int64()), ("hits", pa.binary()), ("text", pa.string())])
_STORED = pa.schema([("batch", pa.int64()), ("low", pa.int64()), ("body", pa.binary())])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put rows that come by doc_id, hits before texts, into stored batches.

    A batch ends between two ids, or holds rows of a single one: so no batch
    has an id of another and a larger one.
    """
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held_rows: list[tuple[int, bytes, str]] = []
    last, hits, size, single = None, {}, 0, False

    def pack(rows: list[tuple[int, bytes, str]]) -> pa.RecordBatch:
        nonlocal number
        table = _rows(_GROUP, rows)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _GROUP, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(table)
        number += 1
        return _rows(_STORED, [(number - 1, int(_rank(np.array(rows[0][0]))), sink.getvalue().to_pybytes())])

    for batch in batches:
        for doc, hit, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "hits", "text")), strict=True):
            full = len(held_rows) >= DOCS_A_BATCH or size > 8 << 20
            if doc != last:
                if held_rows and (full or single):
                    yield pack(held_rows)
                    held_rows, size, single = [], 0, False
                last, hits = doc, {}
            elif full and text:  # an id with more rows than a batch takes
                for rows in ([r for r in held_rows if r[0] != doc], [r for r in held_rows if r[0] == doc]):
                    if rows:
                        yield pack(rows)
                held_rows, size, single = [], 0, True
            if hit is not None:
                hits[hit] = None  # equal texts have equal hits
            elif hits and text:
                held_rows.append((doc, b"".join(hits), text))
                size += len(text)
    if held_rows:
        yield pack(held_rows)


class _Windows:
    """Candidate windows of a stored batch, and which of them it settles itself."""

    def __init__(self, body: bytes, bits: int) -> None:
        table = pa.ipc.open_stream(body).read_all().combine_chunks()
        self.texts, self.ids = table["text"].combine_chunks(), table["doc_id"].to_numpy()
        self.words = w = split_words(self.texts)
        hashes = word_hashes(w)
        at, blocks = window_hashes(hashes, w.first, BLOCK)
        key = blocks >> np.uint64(32 - bits)
        near = np.zeros(len(hashes) + WINDOW + 1, np.int64)
        edges = np.searchsorted(at, w.first)
        for k, blob in enumerate(table["hits"].to_pylist()):
            a, b = edges[k], edges[k + 1]
            hit = at[a:b][np.isin(key[a:b], np.frombuffer(blob, "<u8"))]
            np.add.at(near, np.maximum(hit - (WINDOW - BLOCK), w.first[k]), 1)
            np.add.at(near, hit + 1, -1)
        wanted = np.cumsum(near)[: len(hashes)] > 0
        at, digests = window_hashes(hashes, w.first, WINDOW, seed=1)
        chosen = wanted[at]
        self.at, digests = at[chosen], digests[chosen]
        self.doc = _rank(self.ids)[np.searchsorted(w.first, self.at, "right") - 1]
        self.distinct, self.group = np.unique(digests, return_inverse=True)
        low = np.full(len(self.distinct), _LAST, np.int64)
        np.minimum.at(low, self.group, self.doc)
        self.settled = low[self.group] < self.doc
        self.span = (self.distinct >> np.uint64(64 - bits)).astype(np.int64)


def _digests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, low, body in zip(*(batch[c].to_pylist() for c in ("batch", "low", "body")), strict=True):
                found, rows = _Windows(body, bits), []
                # 7 bytes below the range's bits; with fewer than 8 of these, the lowest bits go
                cut = (found.distinct << np.uint64(bits) >> np.uint64(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
                for a, b in runs(found.span):
                    rows.append((int(found.span[a]), number, low.to_bytes(8, "little", signed=True) + cut[a:b].tobytes()))
                yield _rows(_SENT, rows)

    return run


def _earlier(rows: pa.Table) -> pa.Table:
    """For each batch: which of its windows of this range a lower batch holds."""
    span, blobs = rows["range"][0].as_py(), rows["blob"].to_pylist()
    low = [int.from_bytes(b[:8], "little", signed=True) for b in blobs]
    sizes = [(len(b) - 8) // 7 for b in blobs]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :7] = np.frombuffer(b"".join(b[8:] for b in blobs), np.uint8).reshape(-1, 7)
    rank = np.repeat(low, sizes)
    _, group = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    least = np.full(len(group), _LAST, np.int64)
    np.minimum.at(least, group, rank)
    gone = least[group] < rank
    edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    out = [(span, batch, np.packbits(gone[a:b]).tobytes()) for batch, a, b in zip(rows["batch"].to_pylist(), edges[:-1], edges[1:], strict=True) if gone[a:b].any()]
    return pa.Table.from_batches([_rows(_TOLD, out)])


def joined_words(w: Words, keep: np.ndarray) -> list[bytes]:
    """Of each text: the words kept, joined by one space."""
    start, size = w.start[keep], w.end[keep] - w.start[keep] + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    out = np.append(w.data, np.uint8(32))[np.minimum(place, len(w.data))]
    out[ends[1:] - 1] = 32
    raw = out.tobytes()
    bounds = ends[np.concatenate([[0], np.cumsum(keep)])[w.first]].tolist()
    return [raw[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_RESULT = pa.schema([("doc_id", pa.int64()), ("whole_sha256", pa.string()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _finish(bits: int, with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for body in left["body"].to_pylist():
            found = _Windows(body, bits)
            gone = np.zeros(len(found.distinct), bool)
            for span, blob in zip(right["kind"].to_pylist(), right["blob"].to_pylist(), strict=True):
                a, b = np.searchsorted(found.span, [span, span + 1])
                gone[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a).astype(bool)
            at = found.at[gone[found.group] | found.settled]
            w = found.words
            cover = np.zeros(len(w.start) + WINDOW + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            keep = np.cumsum(cover)[: len(w.start)] == 0
            removed = np.add.reduceat(np.append(~keep, False).astype(np.int64), w.first[:-1]) * (np.diff(w.first) > 0)
            whole = joined_words(w, np.ones(len(keep), bool))
            for doc, n, all_words, kept in zip(found.ids.tolist(), removed.tolist(), whole, joined_words(w, keep), strict=True):
                if n:
                    out.append((doc, hashlib.sha256(all_words).hexdigest(), n, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pa.Table.from_batches([_rows(_RESULT, out)])

    return run


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = split_words(batch["text"])
        digests = [hashlib.sha256(x).hexdigest() for x in joined_words(w, np.ones(len(w.start), bool))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["id"], pa.array(np.diff(w.first)), pa.array(digests, pa.string())], names=["doc_id", "id", "n_words", "whole_sha256"])


def _id(doc_id: str, text: str) -> Column:
    """A doc_id that is never null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST) - F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(_NULLS)))


def _removals(docs: DataFrame, with_text: bool) -> tuple[DataFrame, Scratch]:
    """doc_id (null: a number of its own), whole_sha256, n_removed, kept_sha256, kept: texts that lose words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "substring")
    rows = only(docs, doc_id="doc_id", text="text").select(_id("doc_id", "text").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = _ranges(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    sent = rows.mapInArrow(_probes(bits), "range long, batch long, blob binary")
    told = sent.groupBy("range").applyInArrow(_meet, "kind long, batch long, blob binary")
    hits = scratch.keep(told.groupBy("batch").applyInArrow(_hits_of, "doc_id long, hits binary"), "hits")

    # texts meet their hits by ranges of ids; both kinds of row are sorted together (without a filter all texts come, and those without hits go there)
    texts = rows.mapInArrow(_texts_held(filter_of(hits.select(F.col("doc_id").alias("key")))), "doc_id long, hits binary, text string")
    both = hits.select("doc_id", "hits", F.lit(None).cast("string").alias("text")).union(texts)
    ordered = both.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.col("hits").isNull(), "text")
    stored = scratch.keep(ordered.mapInArrow(_in_order, "batch long, low long, body binary"), "batches")
    scratch.drop("hits")

    digests = stored.mapInArrow(_digests(bits), "range long, batch long, blob binary")
    earlier = digests.groupBy("range").applyInArrow(_earlier, "kind long, batch long, blob binary")
    result = "doc_id long, whole_sha256 string, n_removed long, kept_sha256 string, kept binary"
    out = stored.groupBy("batch").cogroup(earlier.groupBy("batch")).applyInArrow(_finish(bits, with_text), result)
    return scratch.keep(out.dropDuplicates(["doc_id", "whole_sha256"]), "removals"), scratch


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    changed, _ = _removals(docs, False)
    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), _id("doc_id", "text").alias("id"), F.col("text").cast("string").alias("text"))
    base = rows.mapInArrow(_base, "doc_id long, id long, n_words long, whole_sha256 string")
    joined = base.join(changed.select(F.col("doc_id").alias("id"), "whole_sha256", "n_removed", "kept_sha256"), ["id", "whole_sha256"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated words taken out of text; rows and other columns stay.

    A text that loses words has the rest joined by single spaces.
    """
    changed, _ = _removals(docs, True)
    key, whole, left = fresh(docs, "id", "whole", "kept")
    kept = changed.select(F.col("doc_id").alias(key), F.col("whole_sha256").alias(whole), F.decode("kept", "UTF-8").alias(left))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # rows of one doc_id are told apart by their words
    same = (_id("doc_id", "text") == F.col(key)) & (F.sha2(F.array_join(words, " "), 256) == F.col(whole))
    joined = docs.join(kept, same, "left")
    return joined.withColumn("text", F.coalesce(F.col(left), F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])
