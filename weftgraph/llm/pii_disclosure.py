"""Personal data and the terms that give it away.

Base spans (e-mail, IP, card, phone) are found by fixed rules. Then the corpus
decides which ordinary words beside them disclose them. An entity c is one
protected value; a document counts for it when it mentions it, and a term t
counts with it when it stands anywhere in such a document, outside every base
span. Over all N documents

    IC(c)     = ln(N / n(c))                  information content of the entity
    PMI(c, t) = ln(N n(c,t) / (n(c) n(t)))    information t gives about c

and t discloses c where PMI >= theta IC, which is reached when t hardly occurs
without c. Every occurrence of such a term in the documents of c becomes a span
too. Terms with a digit or a capital letter are generalised (to a class name),
others removed. ``least_together`` asks for so many documents of both; at 1 the
threshold alone decides.

Scale: one pass over the texts finds mentions; texts with one are kept apart.
As n(c,t) <= n(c), a term tells nothing where n(t) > N^(1-theta) n(c)^theta, so
words common among the texts with mentions go first. n(t) is counted over every
document, but only for the words left: a Bloom filter of bounded size picks them
where the texts are read (all words count if there are too many for one), and
after the same test a second one picks the places of the rest; exact joins
follow, so false hits only cost time. Pairs are
counted by partial aggregates, and entities of one document need no pairs: there
n(c,t) is 1. No step holds the terms of all documents.

Defined results: a null text is an empty one, without spans. Rows that repeat
count as documents of their own. Ties need no order: all counts are sums. Texts of any
length are searched and counted whole. Other columns are ignored by find() and
kept by sanitise(). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import filter_of, held
from .runtime import Scratch, bounded_batches, fresh, map_texts, only
from .wordhash import split_words, word_hashes

# fixed values: the base kinds, in order
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: Words on either side of a mention that count as beside it: those of any document.
AROUND = 1 << 31
#: Documents that must show a term and an entity, where the caller does not say.
LEAST_TOGETHER = 2
THETA = 0.9
#: Terms whose counts a task holds before it passes them on.
COUNTED_TERMS = 1_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
# the look-behind and the possessive runs keep the match and make it linear: a run of digits that fails as a whole fails from each of its digits
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FORM = re.compile(r"[0-9A-Z]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses; linear, by the place of each @."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            last = domain.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _value(kind: int, text: str) -> str:
    """A protected value, free of how it is written."""
    return text.lower() if kind == 0 else ".".join(p.lstrip("0") or "0" for p in text.split(".")) if kind == 1 else "".join(_DIGIT.findall(text))


class Mention(NamedTuple):
    entity: int
    term: int
    start: int
    end: int


def outside(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of the words between the spans."""
    last = 0
    for a, b in [*sorted(spans), (len(text), len(text))]:
        for m in _WORD.finditer(text, last, max(a, last)):
            yield m[0], m.start(), m.end()
        last = max(last, b)


_FOUND = "row long, doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, entities array<bigint>, text string"
_PLACES = "row long, term long, start int, stop int"


def _term(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>").lower()


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in KINDS]
        digests, joined, entities, texts = [], [], [], []
        for text in batch["text"].to_pylist():
            spans = base_spans(text or "")
            for k in range(len(KINDS)):
                counts[k].append(sum(s[0] == k for s in spans))
            written = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
            digests.append(hashlib.sha256(written.encode()).hexdigest())
            joined.append(written)
            entities.append(sorted({_key(f"{KINDS[k]}:{_value(k, text[a:b])}") for k, a, b in spans}))
            texts.append(text if spans else None)
        yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["text_key"], *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(joined, pa.string()), pa.array(entities, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["row", "doc_id", "text_key", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "entities", "text"])


def _placer(bits: np.ndarray):
    """Places of the words outside base spans whose terms the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick: dict[str, int] = {}
        for batch in batches:
            out: tuple[list[int], ...] = ([], [], [], [])
            for row, text, written in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                for word, *place in outside(text, [tuple(map(int, s.split(":")[1:])) for s in written.split(",")]):
                    if (key := quick.get(word)) is None:
                        if len(quick) > 500_000:
                            quick.clear()
                        key = quick[word] = _key(_term(word)) if _term(word) else 0
                    if key:
                        for values, x in zip(out, (row, key, *place), strict=True):
                            values.append(x)
            hit = held(bits, np.array(out[1], np.int64))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64)[hit], k) for v, k in zip(out, kinds, strict=True)], names=["row", "term", "start", "stop"])

    return run


def _counter(bits: np.ndarray | None = None):
    """Documents of a task by term, for the terms that the filter may hold, or for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick: dict[bytes, int] = {}
        none = np.zeros(0, np.int64)
        held_terms, held_n = none, none

        def add(terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            every, group = np.unique(np.concatenate([held_terms, terms]), return_inverse=True)
            return every, np.bincount(group, np.concatenate([held_n, n]), len(every)).astype(np.int64)

        def rows(terms: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])

        for batch in batches:
            w = split_words(batch["text"])
            doc = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
            # a word's key is made once; equal words are found by their fast hash
            _, first, group = np.unique(word_hashes(w), return_index=True, return_inverse=True)
            raw, keys = w.data.tobytes(), np.zeros(len(first), np.int64)
            spelt = [raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
            if len(quick) > 500_000:
                quick = {}
            for k, word in enumerate(spelt):
                got = quick.get(word)
                if got is None:
                    got = quick[word] = _key(_term(word.decode()))
                keys[k] = got
            hit = (np.ones(len(keys), bool) if bits is None else held(bits, keys))[group]
            pairs = np.unique(np.stack([keys[group[hit]], doc[hit]], axis=1), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
            terms, n = np.unique(pairs[:, 0], return_counts=True)
            held_terms, held_n = add(terms, n)
            if len(held_terms) > COUNTED_TERMS:
                yield rows(held_terms, held_n)
                held_terms, held_n = none, none
        yield rows(held_terms, held_n)

    return run


def _text_rows(docs: DataFrame) -> DataFrame:
    return only(docs, doc_id="doc_id", text="text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _text_key("text").alias("text_key"), F.col("text").cast("string").alias("text"))


def _text_key(text: str) -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def find(docs: DataFrame, least_together: int = LEAST_TOGETHER, theta: float = THETA, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, text_key (the text's hash), counts by kind, base_sha256, spans (base and term spans).

    with_text adds sanitised, the text with its spans masked; null where there
    are no spans and the text stays as it is.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "pii")
    rows = _text_rows(docs)
    found = scratch.keep(rows.mapInArrow(_finder, _FOUND), "found")
    n = F.lit(float(max(found.count(), 1)))
    private = found.where("text is not null")

    def telling(n_both: Column, n_entity: Column, n_term: Column) -> Column:
        information = F.log(n / n_entity)
        return (information > 0) & (F.log(n * n_both / (n_entity * n_term)) >= theta * information - 1e-9)

    mentions = private.select("row", F.explode("entities").alias("entity"))
    entities = mentions.groupBy("entity").agg(F.count("*").alias("n_entity")).where((F.col("n_entity") >= least_together) & (F.col("n_entity") < n))
    owners = scratch.keep(mentions.join(entities, "entity"), "owners")
    most = F.lit(owners.agg(F.max("n_entity")).first()[0] or 1)
    # n(t) is at least the number of texts with mentions that show t, and that already rules most terms out
    counted = lambda texts, count: texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    beside = counted(private.select("text"), _counter()).where(telling(most, most, F.col("n_term")))
    bits = filter_of(beside.select(F.col("term").alias("key")))
    rare = scratch.keep(counted(rows.select("text"), _counter(bits)).where(telling(most, most, F.col("n_term"))), "rare")
    bits = filter_of(rare.select(F.col("term").alias("key")))
    places = scratch.keep(private.select("row", "text", "spans").mapInArrow(_placer(bits), _PLACES).join(rare, "term"), "places")

    one = F.lit(1)
    alone = places.where(telling(one, one, F.col("n_term"))).join(owners.where("n_entity = 1").select("row").distinct(), "row", "left_semi").select("row", "term").distinct()
    shared = places.select("row", "term", "n_term").distinct().join(owners.where("n_entity > 1"), "row").where(telling(F.col("n_entity"), F.col("n_entity"), F.col("n_term")))
    pairs = shared.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term"))
    pairs = pairs.where((F.col("n_both") >= least_together) & telling(F.col("n_both"), F.col("n_entity"), F.col("n_term"))).select("entity", "term")
    told = alone.union(shared.join(pairs, ["entity", "term"], "left_semi").select("row", "term")).distinct()

    extra = places.join(told, ["row", "term"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("terms"))
    written = F.array_join(F.transform("terms", lambda t: F.concat(F.lit(f"{TERM}:"), t["start"].cast("string"), F.lit(":"), t["stop"].cast("string"))), ",")
    spans = F.concat_ws(",", F.nullif("spans", F.lit("")), written)
    columns = ["doc_id", "text_key", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans")]
    rows = found.drop("entities").join(extra, "row", "left")
    if not with_text:
        return rows.select(columns)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(columns).schema)
    return rows.select(*columns, "text").mapInArrow(_sanitiser, f"{fields}, sanitised string")


def _sanitiser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [sanitise_text(t, s) if s else None for t, s in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True)]
        yield batch.drop_columns(["text"]).append_column("sanitised", pa.array(texts, pa.string()))


def sanitise_text(text: str | None, spans: str | None) -> str | None:
    """Put class names in place of spans; telling words without form are removed."""
    if not text or not spans:
        return text
    marks = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",")))
    out, last = [], 0
    for a, b, kind in marks:
        if b <= last:
            continue
        a = max(a, last)
        new = f"<{kind}>" if kind != TERM else "<term>" if _FORM.search(text[a:b]) else ""
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with spans masked in text; found is find()'s result for docs. Rows and other columns stay."""
    marks, key, text_key = fresh(docs, "spans", "key", "text_key")

    def change(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        last = batch.num_columns - 1
        texts = [sanitise_text(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).remove_column(last)

    # equal texts have equal spans, so one row for each doc_id and text is enough
    spans = found.groupBy(F.col("doc_id").alias(key), F.col("text_key").alias(text_key)).agg(F.first("spans").alias(marks))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (_text_key("text") == F.col(text_key))
    return map_texts(docs.join(spans, same, "left").drop(key, text_key), change, marks)
