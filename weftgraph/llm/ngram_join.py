"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct five-word shingles (fewer words: the whole
sequence as one). Two documents link when their sets' Jaccard similarity is at
least 80 %. The result gives each document its set's size and the smallest
doc_id of its connected component.

Equal sets collapse to one node first. A node of size n can only link with an
overlap of o = ceil(0.8 n) or more, so in one global order of all shingles two
linked nodes share at least l of their first n - o + l shingles, for any l that
both use (with different ones: the smaller). Longer prefixes thus ask for more
shared tokens. Prefixes are lengthened where candidates are expected:

1. every document posts a prefix with a small l (5 % of n), in the order of
   hashes. A node that does not share with any others the l tokens that its
   smallest partner would need has no link and costs nothing more;
2. nodes with a cost post their whole sets (l = o), so 80 % of them must be
   shared with other such nodes: long common passages alone do not reach that.
   The answers bring every token's frequency;
3. what is left is posted from rare to common tokens. The frequencies estimate
   the cost of going on: l grows by each further token whose list is short. A
   pair is verified when it shares the smaller l of both; the tokens' places in
   both orders rule out most others before they are counted.

Verification compares whole sets. Only links that change components matter:
each node is first verified against the hub (the node of most common tokens)
that it shares most with, which joins a group of copies in linear time. What a
hub's component lacks of the hub's nodes meets all of these in pairs of blocks,
as exact products of token tables that write links only. Pairs across hubs and
components are enumerated from the lists and verified; nothing is capped.

Scale: tokens travel packed, 8 bytes each, between batches and hash buckets
whose number follows the input. In steps 1 and 2 a token is sent once a batch
however many documents hold it, so hot shingles stay small, and each batch gets
counts back. A 1 MB Bloom filter picks step 2's documents from the texts; its
false hits are harmless, being more nodes to try. Token hashes are 64 bits wide
within a set and 48 in candidate search, where a collision only adds work.

Defined results: null or wordless texts have size 0 and are linked with nothing
(their component is their own doc_id). Rows that repeat come out
as often; rows that share a doc_id but not the text are documents of their own
that report the same id. A null doc_id is ignored in minima. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .bloom import filter_of, held
from .runtime import Scratch, bounded_batches, fresh, only
from .wordhash import _BASES, mix, runs, split_words, window_hashes, word_hashes

WORDS = 5
#: Nodes a hash bucket serves, on average.
NODES_A_BUCKET = 800
_MULTI = 0xFFFF
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def overlap_needed(n: np.ndarray) -> np.ndarray:
    return (4 * n + 4) // 5


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their offsets."""
    w = split_words(texts, lower=True)
    n_words = np.diff(w.first)
    hashes = word_hashes(w)
    at, grams = window_hashes(hashes, w.first, words)
    doc = np.searchsorted(w.first, at, "right") - 1
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            there = k < n_words[short]
            place = np.minimum(w.first[short] + k, max(len(hashes) - 1, 0))
            whole = np.where(there, whole * np.uint64(_BASES[0]) + hashes[place], whole)
        grams = np.concatenate([grams, mix(whole + n_words[short].astype(np.uint64) * _SECOND)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[keep], grams[keep]
    return grams, np.searchsorted(doc, np.arange(len(n_words) + 1))


def node_ids(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A digest of each set (0 for an empty one)."""
    sums = []
    for salt in (np.uint64(0x8CB92BA72F3D8DD7), _SECOND):
        run = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams ^ salt), out=run[1:])
        sums.append(run[first[1:]] - run[first[:-1]])
    size = np.diff(first)
    out = mix(sums[0] ^ mix(sums[1] + size.astype(np.uint64)))
    out[out == 0] = 1
    out[size == 0] = 0
    return out.view(np.int64)


def _heads(first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first lengths[i] items of each run, and their runs' numbers."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + first[owner], owner


def _pack(tokens: np.ndarray, owner: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Blobs of (48-bit token, owner's number) by hash bucket, tokens ascending."""
    bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    low = tokens & np.uint64((1 << 48) - 1)
    order = np.lexsort((low, bucket))
    bucket, low, owner = bucket[order], low[order], owner[order]
    for a, b in runs(bucket):
        part = low[a:b]
        yield int(bucket[a]), (part & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (part >> np.uint64(32)).astype("<u2").tobytes() + owner[a:b].astype("<u2").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 8
    low, high, owner = np.frombuffer(blob, "<u4", n), np.frombuffer(blob, "<u2", n, 4 * n), np.frombuffer(blob, "<u2", n, 6 * n)
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), owner


_POSTED = "bucket long, batch long, blob binary"
_POSTED_ARROW = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])


def _post(batch: int, ids: np.ndarray, tokens: np.ndarray, owner: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of one batch: its table of ids with local counts, and its distinct tokens by bucket."""
    distinct, first, counts = np.unique(tokens, return_index=True, return_counts=True)
    many = counts > 1
    shared = np.zeros(len(ids), np.uint32)
    cost = np.zeros(len(ids), np.float32)
    if many.any():
        n = counts[np.searchsorted(distinct, tokens)]
        shared += np.bincount(owner[n > 1], minlength=len(ids)).astype(np.uint32)
        cost += np.bincount(owner, n - 1, len(ids)).astype(np.float32)
    sent = np.where(many, _MULTI, owner[first])
    rows = [(-1 - batch % buckets, batch, ids.tobytes() + shared.tobytes() + cost.tobytes()), *((b, batch, blob) for b, blob in _pack(distinct, sent, buckets))]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _POSTED_ARROW, strict=True)], schema=_POSTED_ARROW)


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    """Within a bucket: which tokens other batches hold too, told to each batch."""
    if key[0].as_py() < 0:  # tables of ids only pass through
        return rows.rename_columns(["kind", "batch", "blob"]).cast(_POSTED_ARROW_KIND)
    blobs, batches = rows["blob"].to_pylist(), rows["batch"].to_pylist()
    parts = [_unpack(b) for b in blobs]
    size = np.array([len(t) for t, _ in parts])
    tokens, owner = np.concatenate([t for t, _ in parts]), np.concatenate([o for _, o in parts])
    _, group, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    lengths = counts[group]
    of = np.repeat(np.arange(len(parts)), size)
    hit = (lengths > 1) & (owner != _MULTI)
    out = []
    key_of = of[hit].astype(np.int64) << 16 | owner[hit]
    pairs, inverse, shared = np.unique(key_of, return_inverse=True, return_counts=True)
    cost = np.bincount(inverse, lengths[hit] - 1, len(pairs))
    edges = np.searchsorted(pairs >> 16, np.arange(len(parts) + 1))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b > a:
            out.append((0, batches[k], (pairs[a:b] & 0xFFFF).astype("<u2").tobytes() + shared[a:b].astype("<u4").tobytes() + cost[a:b].astype("<f4").tobytes()))
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _POSTED_ARROW_KIND, strict=True)], schema=_POSTED_ARROW_KIND) if out else _POSTED_ARROW_KIND.empty_table()


_POSTED_ARROW_KIND = pa.schema([("kind", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])
_COUNTED = pa.schema([("node", pa.int64()), ("shared", pa.int64()), ("cost", pa.float64())])


def _total(rows: pa.Table) -> pa.Table:
    """All answers to one batch added up."""
    table = next(b for k, b in zip(rows["kind"].to_pylist(), rows["blob"].to_pylist(), strict=True) if k < 0)
    n = len(table) // 16
    ids = np.frombuffer(table, np.int64, n)
    shared, cost = np.frombuffer(table, np.uint32, n, 8 * n).astype(np.int64), np.frombuffer(table, np.float32, n, 12 * n).astype(np.float64)
    for kind, blob in zip(rows["kind"].to_pylist(), rows["blob"].to_pylist(), strict=True):
        if kind == 0:
            m = len(blob) // 10
            who = np.frombuffer(blob, "<u2", m)
            shared[who] += np.frombuffer(blob, "<u4", m, 2 * m)
            cost[who] += np.frombuffer(blob, "<f4", m, 6 * m)
    return pa.Table.from_arrays([pa.array(ids), pa.array(shared), pa.array(cost)], schema=_COUNTED)


def _counts(posted: DataFrame) -> DataFrame:
    """node, shared (tokens that others hold too), cost (their further holders)."""
    answers = posted.groupBy("bucket").applyInArrow(_answer, "kind long, batch long, blob binary")
    return answers.groupBy("batch").applyInArrow(_total, "node long, shared long, cost double")


def _batch_numbers() -> Iterator[int]:
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    while True:
        yield base
        base += 1


def _text_prefixes(buckets: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, number in zip(batches, _batch_numbers(), strict=False):
            grams, first = shingle_sets(batch["text"], words)
            n = np.diff(first)
            nodes = node_ids(grams, first)
            _, one = np.unique(nodes, return_index=True)  # copies in the batch post once
            one = one[nodes[one] != 0]
            place, owner = _heads(first[one], np.minimum(n, n - overlap_needed(n) + 1 + n // 20)[one])
            yield _post(number, nodes[one], grams[place], owner, buckets)

    return run


def _described(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, first = shingle_sets(batch["text"], words)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(np.diff(first)), pa.array(node_ids(grams, first))], names=["doc_id", "mark", "n", "node"])

    return run


_STORED = pa.schema([("batch", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("grams", pa.binary())])
SETS_A_BATCH = 400


def _chosen_sets(bits: np.ndarray | None, words: int):
    """Sets of the documents in the filter, stored in numbered batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _batch_numbers()
        for batch in batches:
            ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            part = batch.filter(pa.array(held(bits, ids)))
            grams, first = shingle_sets(part["text"], words)
            nodes = node_ids(grams, first)
            _, some = np.unique(nodes, return_index=True)
            some = np.sort(some[nodes[some] != 0])
            for at in range(0, len(some), SETS_A_BATCH):
                few = some[at : at + SETS_A_BATCH]
                place, _ = _heads(first[few], np.diff(first)[few])
                row = (next(numbers), nodes[few].tobytes(), np.diff(first)[few].astype("<i8").tobytes(), grams[place].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _STORED, strict=True)], schema=_STORED)

    return run


class _Sets:
    """A stored batch: nodes, set sizes, and its distinct tokens in the order they are sent."""

    def __init__(self, nodes: bytes, sizes: bytes, grams: bytes, buckets: int) -> None:
        self.nodes, self.n, self.grams = np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(grams, np.uint64)
        self.distinct, self.group, self.counts = np.unique(self.grams, return_inverse=True, return_counts=True)
        bucket = (self.distinct >> np.uint64(32)) % np.uint64(buckets)
        self.sent = np.lexsort((self.distinct & np.uint64((1 << 48) - 1), bucket))


def _token_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, nodes, sizes, grams in zip(*(batch[c].to_pylist() for c in _STORED.names), strict=True):
                x = _Sets(nodes, sizes, grams, buckets)
                rows = [(b, number, blob) for b, blob in _pack(x.distinct, np.minimum(x.counts, 0xFFFF), buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _POSTED_ARROW, strict=True)], schema=_POSTED_ARROW)

    return run


def _frequencies(rows: pa.Table) -> pa.Table:
    """Document frequency of each token of a bucket, told to the batches as a class."""
    parts = [_unpack(b) for b in rows["blob"].to_pylist()]
    tokens, counts = np.concatenate([t for t, _ in parts]), np.concatenate([c for _, c in parts])
    _, group = np.unique(tokens, return_inverse=True)
    total = np.bincount(group, counts)
    classes = np.minimum(255, np.floor(CLASSES * np.log2(total))).astype(np.uint8)[group]
    edges = np.concatenate([[0], np.cumsum([len(t) for t, _ in parts])]).tolist()
    blobs = [classes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.Table.from_arrays([rows["bucket"], rows["batch"], pa.chunked_array([pa.array(blobs, pa.binary())])], schema=_POSTED_ARROW)


#: Classes of frequency for each doubling, and the class up to which a longer prefix is cheap.
CLASSES = 12
CHEAP = 5 * CLASSES
LONGEST = 0.3
_SMALL = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("l", pa.int64()), ("own", pa.int64()), ("centre", pa.int64()), ("grams", pa.binary())])


def _ordered(buckets: int):
    """Nodes that share 80 % of their tokens, with tokens from rare to common and their l."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right["bucket"].to_pylist(), right["blob"].to_pylist(), strict=True))
        told = np.frombuffer(b"".join(answers[b] for b in sorted(answers)), np.uint8)
        rows: list[tuple] = []
        for nodes, sizes, grams in zip(*(left[c].to_pylist() for c in _STORED.names[1:]), strict=True):
            x = _Sets(nodes, sizes, grams, buckets)
            by_token = np.empty(len(x.distinct), np.uint8)
            by_token[x.sent] = told
            classes = by_token[x.group]
            owner = np.repeat(np.arange(len(x.n)), x.n)
            shared = np.bincount(owner, classes > 0, len(x.n))
            centre = np.bincount(owner, classes, len(x.n)) / x.n
            order = np.lexsort((x.grams, classes, owner))
            base = np.cumsum(x.n) - x.n + x.n - overlap_needed(x.n) + 1
            cheap = np.concatenate([[0], np.cumsum(classes[order] <= CHEAP)])
            # a cheap token that lengthens the prefix also raises what must be shared
            more = 1 + np.minimum(cheap[np.cumsum(x.n)] - cheap[np.minimum(base, np.cumsum(x.n))], (LONGEST * x.n).astype(np.int64))
            raw, ends = x.grams[order].tobytes(), (8 * np.cumsum(x.n)).tolist()
            for k in np.flatnonzero(shared >= overlap_needed(x.n)).tolist():
                rows.append((int(x.nodes[k]), int(x.n[k]), int(more[k]), int(x.n[k] - shared[k]), int(1000 * centre[k]), raw[ends[k] - 8 * int(x.n[k]) : ends[k]]))
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SMALL, strict=True)], schema=_SMALL) if rows else _SMALL.empty_table()

    return run


_LISTED = "bucket long, blob binary"


def _final_prefixes(buckets: int, grouped: bool):
    """Postings of nodes by bucket: token, owner, place in the owner's order; and the owners' table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, bytes]] = []
            if batch.num_rows:
                nodes, n, more, own, centre = (batch[c].to_numpy() for c in ("node", "n", "l", "own", "centre"))
                grams = np.frombuffer(b"".join(batch["grams"].to_pylist()), np.uint64)
                component, hub = (batch[c].to_numpy() if grouped else nodes for c in ("component", "hub"))
                first = np.cumsum(n) - n
                place, owner = _heads(first, np.minimum(n, n - overlap_needed(n) + more))
                token, rank = grams[place], place - first[owner]
                bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for a, b in runs(bucket[order]):
                    at = order[a:b]
                    used, small = np.unique(owner[at], return_inverse=True)
                    head = np.stack([nodes[used], component[used], n[used] << 32 | more[used], centre[used] << 32 | own[used], hub[used]]).astype("<i8").tobytes()
                    out.append((int(bucket[at[0]]), len(used).to_bytes(4, "little") + head + token[at].astype("<u8").tobytes() + rank[at].astype("<u4").tobytes() + small.astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])

    return run


class _Lists(NamedTuple):
    """Postings of a bucket by token, the likeliest original first."""

    token: np.ndarray
    node: np.ndarray
    component: np.ndarray
    n: np.ndarray
    more: np.ndarray
    hub: np.ndarray
    own: np.ndarray  # tokens that only the node has; they come first in its order
    rank: np.ndarray  # place of the token in its node's order
    start: np.ndarray  # where each list begins


def _lists(rows: pa.Table) -> _Lists:
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    for blob in rows["blob"].to_pylist():
        used = int.from_bytes(blob[:4], "little")
        head = np.frombuffer(blob, "<i8", 5 * used, 4).reshape(5, used)
        at = 4 + 40 * used
        m = (len(blob) - at) // 14
        own = np.frombuffer(blob, "<u2", m, at + 12 * m)
        columns[0].append(np.frombuffer(blob, "<u8", m, at))
        columns[6].append(np.frombuffer(blob, "<u4", m, at + 8 * m).astype(np.int64))
        for k in range(5):
            columns[k + 1].append(head[k][own])
    token, node, component, sizes, centre, hub, rank = (np.concatenate(c) for c in columns)
    order = np.lexsort((node, -(centre >> 32), token))
    token, node = token[order], node[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])  # a repeated row posts its node once
    order, token, node = order[fresh], token[fresh], node[fresh]
    sizes = sizes[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    return _Lists(token, node, component[order], sizes >> 32, sizes & 0xFFFFFFFF, hub[order], centre[order] & 0xFFFFFFFF, rank[order], start)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("least", pa.int64())])


def _pair_table(a: np.ndarray, b: np.ndarray, least: np.ndarray, times: np.ndarray | None = None) -> pa.Table:
    """Distinct pairs with how often they came, and the l that they need."""
    if not len(a):
        return _PAIRS.empty_table()
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    shared = np.diff([*start, len(a)]) if times is None else np.add.reduceat(times[order], start)
    return pa.Table.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(shared.astype(np.int64)), pa.array(least[start])], schema=_PAIRS)


def _may_link(x: _Lists, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether two holders of a token can link, as far as sizes and its places tell.

    Links need an overlap of t = 4/9 of both sizes. Tokens before the place can
    add no more than the smaller place less the node's own tokens, those after
    it no more than the smaller rest. And with l tokens to share, the smaller set's must be among its first
    n - ceil(8 n / 9) + l and the larger set's among its first n - o + l.
    """
    n, m, i, j = x.n[p], x.n[q], x.rank[p], x.rank[q]
    low, high = np.minimum(n, m), np.maximum(n, m)
    before = np.minimum(np.maximum(i - x.own[p], 0), np.maximum(j - x.own[q], 0))
    out = (100 * low >= 80 * high) & (9 * (before + np.minimum(n - i, m - j)) >= 4 * (n + m))
    least = np.minimum(x.more[p], x.more[q])
    swap = n > m
    small, large = np.where(swap, j, i), np.where(swap, i, j)
    return out & (small < low - (8 * low + 8) // 9 + least) & (large < high - overlap_needed(high) + least)


def _hub_pairs(rows: pa.Table) -> pa.Table:
    """Each node with the first node of each of its lists, whether the two can link or not."""
    x = _lists(rows)
    hub = np.repeat(x.start, np.diff([*x.start, len(x.token)]))
    pair = np.flatnonzero(hub != np.arange(len(hub)))
    return _pair_table(x.node[hub[pair]], x.node[pair], np.minimum(x.more[pair], x.more[hub[pair]]))


#: Pairs that a task holds before it adds them up.
PAIRS_AT_ONCE = 2_000_000


def _cross_pairs(rows: pa.Table) -> pa.Table:
    """Pairs of a list that may link, of different components and different hubs."""
    x = _lists(rows)
    total, waiting, size = _PAIRS.empty_table(), [], 0

    def settle() -> pa.Table:
        a, b, least = (np.concatenate(c) for c in zip(*waiting, strict=True))
        new = _pair_table(a, b, least)
        both = pa.concat_tables([total, new])
        return _pair_table(both["a"].to_numpy(), both["b"].to_numpy(), both["least"].to_numpy(), both["shared"].to_numpy())

    for a, b in runs(x.token):
        own = x.component[a:b]
        if b - a < 2 or (own == own[0]).all():
            continue
        order = a + np.lexsort((x.n[a:b], own))
        edges = np.flatnonzero(np.diff(x.component[order])) + 1
        for part, after in zip(np.split(order, edges)[:-1], edges.tolist(), strict=True):  # a component against all that come after it
            rest = order[after:]
            for low in range(0, len(part), 256):
                some = part[low : low + 256]
                i, j = np.nonzero(_may_link(x, some[:, None], rest[None, :]) & (x.hub[some][:, None] != x.hub[rest][None, :]))
                p, q = some[i], rest[j]
                waiting.append((np.minimum(x.node[p], x.node[q]), np.maximum(x.node[p], x.node[q]), np.minimum(x.more[p], x.more[q])))
                size += len(p)
                if size > PAIRS_AT_ONCE:
                    total, waiting, size = settle(), [], 0
    return settle() if waiting else total


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose whole sets reach the similarity."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            good[k] = 100 * same >= 80 * (len(x) + len(y) - same)
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    right = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    return pairs.select("a", "b").join(left, "b").join(right, "a").mapInArrow(_similar, "a long, b long").distinct()


#: Nodes of a block of a hub's group, and tokens that a product of two blocks takes at once.
BLOCK_NODES, BLOCK_TOKENS = 1024, 4096


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two blocks of one hub's group, by products of their token tables."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    sides = [[np.frombuffer(b"".join(t["grams"].to_pylist()), np.uint64), t["n"].to_numpy(), t["node"].to_numpy(), t["component"].to_numpy()] for t in (left, right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    same = np.zeros((left.num_rows, right.num_rows), np.float32)
    places = []
    for grams, n, _, _ in sides:
        owner, at = np.repeat(np.arange(len(n)), n), np.searchsorted(common, grams)
        hit = at < len(common)
        hit[hit] = common[at[hit]] == grams[hit]
        order = np.argsort(at[hit], kind="stable")
        places.append((owner[hit][order], at[hit][order]))
    for low in range(0, len(common), BLOCK_TOKENS):
        tables = []
        for (owner, at), (_, n, _, _) in zip(places, sides, strict=True):
            a, b = np.searchsorted(at, [low, low + BLOCK_TOKENS])
            table = np.zeros((len(n), min(BLOCK_TOKENS, len(common) - low)), np.float32)
            table[owner[a:b], at[a:b] - low] = 1
            tables.append(table)
        same += tables[0] @ tables[1].T  # whole numbers below 2 ** 24 are exact
    (_, n, x, cx), (_, m, y, cy) = sides
    i, j = np.nonzero((100 * same >= 80 * (n[:, None] + m[None, :] - same)) & (cx[:, None] != cy[None, :]))
    return pa.Table.from_arrays([pa.array(np.minimum(x[i], y[j])), pa.array(np.maximum(x[i], y[j]))], schema=schema)


def _groups(grouped: DataFrame) -> DataFrame:
    """h, main, blocks, odd_blocks of the hubs with nodes that the hub's component lacks."""
    parts = grouped.groupBy("hub", "component").agg(F.count("*").alias("size"), F.max(F.col("node") == F.col("hub")).alias("main"))
    hubs = parts.groupBy(F.col("hub").alias("h")).agg(F.sum("size").alias("size"), F.max(F.when(F.col("main"), F.col("component"))).alias("main"), F.max(F.when(F.col("main"), F.col("size"))).alias("n_main"))
    hubs = hubs.withColumn("n_odd", F.col("size") - F.coalesce("n_main", F.lit(0))).where("n_odd > 0 AND size > 1")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_NODES).cast("int")
    return hubs.select("h", "main", blocks("size").alias("blocks"), blocks("n_odd").alias("odd_blocks"))


def _group_links(grouped: DataFrame) -> DataFrame:
    """Links inside each hub's group of the nodes that the hub's component lacks.

    They meet all nodes of the group in pairs of blocks, so that no task holds
    more than two blocks and no pair is written but a link. A node is copied
    once for each block of such nodes, these once for each block of all. The
    join by hub has nothing but its two exchanges below it and none above, so
    that adaptive execution splits a hub that holds much of the rows.
    """
    rows = grouped.join(_groups(grouped), F.col("hub") == F.col("h"))
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.col(n)).cast("int")
    rows = rows.withColumn("odd", ~F.col("component").eqNullSafe(F.col("main")))
    left = rows.where("odd").withColumn("i", part("odd_blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = rows.withColumn("j", part("blocks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)))
    columns = ["hub", "i", "j", "node", "n", "component", "grams"]
    left = left.select(columns)
    right = right.select([F.col(c).alias(c) for c in columns])  # fresh columns: both sides come from one table
    keys = ["hub", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_links, "a long, b long").distinct()


def _buckets(nodes: int) -> int:
    return max(16, math.ceil(nodes / NODES_A_BUCKET))


def _mark(text: str) -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def _components_of(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, mark, n, node and component (null without words) for every row, stored."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ngram")
    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = scratch.keep(rows.withColumn("mark", _mark("text")).mapInArrow(_described(words), "doc_id long, mark long, n long, node long"), "described")
    total = described.count()

    # 1: short prefixes of all documents
    posted = rows.select("text").mapInArrow(_text_prefixes(_buckets(total), words), _POSTED)
    counted = _counts(posted).groupBy("node").agg(F.max("shared").alias("shared"), F.max("cost").alias("cost"))
    owners = described.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    smallest = F.floor((4 * F.col("n") + 4) / 5)
    first = scratch.keep(owners.join(counted.where("shared > 0"), "node").where(F.col("shared") >= 1 + F.floor(smallest / 20)), "first")

    # 2: whole sets of those with a cost
    some = first.select(F.coalesce("doc_id", F.lit(0)).alias("key"))
    bits = filter_of(some)
    if bits is None:  # too many for a filter
        rows = rows.join(some.distinct(), F.coalesce(F.col("doc_id"), F.lit(0)) == F.col("key"), "left_semi")
    sets = scratch.keep(rows.mapInArrow(_chosen_sets(bits, words), "batch long, nodes binary, sizes binary, grams binary"), "sets")
    buckets = _buckets(first.count())
    told = sets.mapInArrow(_token_counts(buckets), _POSTED).groupBy("bucket").applyInArrow(_frequencies, _POSTED)
    ordered = sets.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_ordered(buckets), "node long, n long, l long, own long, centre long, grams binary")
    small = scratch.keep(ordered, "small")
    scratch.drop("sets")

    # 3: candidates by hub, then across components
    buckets = _buckets(small.count())
    listed = small.mapInArrow(_final_prefixes(buckets, False), _LISTED)
    hubs = listed.groupBy("bucket").applyInArrow(lambda t: _hub_pairs(t), "a long, b long, shared long, least long")
    hubs = hubs.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    best = scratch.keep(hubs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")), "best")
    links = scratch.keep(_verified(best, small), "links1")
    component = scratch.keep(connected_components(links, scratch, "c1"), "component1")

    grouped = small.join(component.select(F.col("id").alias("node"), "component"), "node", "left").join(best.select(F.col("b").alias("node"), F.col("a").alias("hub")), "node", "left")
    grouped = scratch.keep(grouped.withColumn("component", F.coalesce("component", "node")).withColumn("hub", F.coalesce("hub", "node")), "grouped")
    scratch.drop("small")
    inside = scratch.keep(_group_links(grouped), "links3")
    listed = grouped.mapInArrow(_final_prefixes(buckets, True), _LISTED)
    cross = listed.groupBy("bucket").applyInArrow(lambda t: _cross_pairs(t), "a long, b long, shared long, least long")
    cross = cross.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("least").alias("least")).where("shared >= least")
    links2 = scratch.keep(_verified(cross, grouped), "links2")
    component = scratch.keep(connected_components(links.union(inside).union(links2), scratch, "c2"), "component2")

    named = described.join(component.select(F.col("id").alias("node"), "component"), "node", "left")
    return scratch.keep(named.select("doc_id", "mark", "n", "node", F.when(F.col("node") != 0, F.coalesce("component", "node")).alias("component")), "named")


def linked_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, node and component_id for every row of docs."""
    named = _components_of(docs, words)
    smallest = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # stored, so that the join has exchanges of its own and a large component's rows can be split
    smallest = Scratch(docs.sparkSession, "ngram").keep(smallest, "smallest")
    linked = named.where("component is not null").join(smallest, "component")
    alone = named.where("component is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "node", "component_id"]
    return linked.select(columns).union(alone.select(columns))


def keep_one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of docs for each component, that with the smallest doc_id (null last); texts without words all stay.

    Of rows that share that doc_id one stays, by the smallest hash of the text.
    """
    named = _components_of(docs, words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("x")
    chosen = named.where("component is not null").groupBy("component").agg(first)
    blank = named.where("component is null").select("doc_id", "mark", F.lit(None).cast("long").alias("component"))
    key, mark, group = fresh(docs, "id", "mark", "component")
    kept = chosen.select("x.doc_id", "x.mark", "component").union(blank).select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("component").alias(group)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (_mark("text") == F.col(mark))
    out = docs.join(kept, same)
    if named.where("component is not null").groupBy("doc_id", "mark").count().where("count > 1").limit(1).count():
        # equal rows of one doc_id: all but one go, and blank texts stay as they are
        out = out.where(F.col(group).isNull()).union(out.where(F.col(group).isNotNull()).dropDuplicates([group]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
