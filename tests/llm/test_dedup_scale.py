"""Ids that many rows share, sizes of ranges, the filter's size, and clashing columns."""

import random

import numpy as np
import pyarrow as pa

from tests.llm.helpers import BASE, documents, odd_texts
from tests.llm.test_joins import _key, _removed
from weftgraph.llm import bloom, ngram_join, pii_disclosure, substring_dedup


def _many(n, seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(20))
    return [" ".join(f"u{rng.randrange(10**6)}" for _ in range(8)) + f" {passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(8)) for _ in range(n)]


def test_rows_without_an_id_or_with_one_id_fill_many_batches(spark, monkeypatch):
    texts = _many(1500, 1)
    ids = [None] * 700 + [7] * 700 + list(range(100, 200))
    seen, keep = [], substring_dedup.Scratch.keep

    def spy(self, df, name):
        out = keep(self, df, name)
        seen.extend([out] if name == "batches" else [])
        return out

    monkeypatch.setattr(substring_dedup.Scratch, "keep", spy)
    order = list(range(len(ids)))
    random.Random(2).shuffle(order)
    rows = substring_dedup.deduplicated(documents(spark, [texts[i] for i in order], [ids[i] for i in order])).collect()
    assert _key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == _key(_removed(ids, texts))
    sizes = [pa.ipc.open_stream(r.body).read_all().num_rows for r in seen[0].collect()]
    assert sum(sizes) == 1500 and max(sizes) <= substring_dedup.DOCS_A_BATCH


def test_batches_of_one_id_keep_others_apart():
    rows = [(1, b"h", None), (1, None, "a")] + [(5, b"h", None)] + [(5, None, f"t{i}") for i in range(600)] + [(6, b"h", None), (6, None, "b")]

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():  # noqa: N802
            return 0

    import pyspark

    old, pyspark.TaskContext = pyspark.TaskContext, Context
    try:
        batch = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "hits", "text"), r, strict=True)) for r in rows], schema=substring_dedup._GROUP)
        out = [pa.ipc.open_stream(b["body"][0].as_py()).read_all()["doc_id"].to_pylist() for b in substring_dedup._in_order(iter([batch]))]
    finally:
        pyspark.TaskContext = old
    assert [x for ids in out for x in ids] == [1] + [5] * 600 + [6] and all(len(set(ids)) == 1 or max(ids[:-1]) < ids[-1] for ids in out)
    assert all(len(set(ids)) == 1 for ids in out[1:]) and max(map(len, out)) <= substring_dedup.DOCS_A_BATCH


def test_ranges_follow_the_bytes_of_texts():
    assert substring_dedup._ranges(0) == 4 and substring_dedup._ranges(substring_dedup.BYTES_A_RANGE << 9) == 9
    assert substring_dedup._ranges(10**15) == 24


def test_the_filter_grows_with_its_keys_and_ends(spark, monkeypatch):
    monkeypatch.setattr(bloom, "LEAST_BITS", 1 << 12)
    bits = bloom.filter_of(spark.range(0, 20_000).selectExpr("id * 3 AS key"))
    assert 64 * len(bits) >= 160_000 and bloom.held(bits, np.arange(20_000) * 3).all() and bloom.held(bits, np.arange(50_000) * 3 + 1).mean() < 0.08
    monkeypatch.setattr(bloom, "MOST_KEYS", 100)
    assert bloom.filter_of(spark.range(101).selectExpr("id AS key")) is None and bloom.held(None, np.arange(3)).all()


def test_operators_work_without_a_filter(spark, monkeypatch):
    texts = _many(60, 3) + odd_texts() + [BASE + " a b c write to zorb at me@x.org", BASE + " a b c write to zorb at me@x.org again"]
    docs = documents(spark, texts)
    runs = [lambda: substring_dedup.deduplicated(docs), lambda: ngram_join.linked_documents(docs), lambda: pii_disclosure.find(docs)]
    expected = [_key(map(tuple, run().collect())) for run in runs]
    monkeypatch.setattr(bloom, "MOST_KEYS", 0)
    assert [_key(map(tuple, run().collect())) for run in runs] == expected


def test_columns_named_like_our_own_stay(spark):
    extra = ["id", "mark", "component", "whole", "kept", "__id", "__mark", "__component", "__whole", "__kept", "__doc", "__spans", "doc", "spans", "text_key"]
    texts = [BASE, BASE, "new here " + BASE + " mail a@b.cd now", None, ""]
    docs = documents(spark, texts).selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in extra], "1 AS `a.b`")
    for run in (ngram_join.keep_one_of_each, substring_dedup.remove_repeats, lambda d: pii_disclosure.sanitise(d, pii_disclosure.find(d))):
        out = run(docs)
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)
        assert run(docs.limit(0)).count() == 0


def test_rows_without_or_with_shared_ids_are_sanitised(spark):
    docs = documents(spark, ["mail a@b.cd now", "mail a@b.cd now", "to c@d.ef then", "plain", *["mail now to then"] * 9], [None, 3, 3, None, *range(10, 19)])
    out = pii_disclosure.sanitise(docs, pii_disclosure.find(docs)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out if (r.doc_id or 0) < 10) == [(0, "mail <email> now"), (0, "plain"), (3, "mail <email> now"), (3, "to <email> then")]


def test_found_rows_carry_the_sanitised_text(spark):
    docs = documents(spark, ["mail a@b.cd now", "to c@d.ef then", "plain", None, *["mail now to then"] * 9])
    rows = {r.doc_id: r for r in pii_disclosure.find(docs, with_text=True).collect()}
    masked = {r.doc_id: r.text for r in pii_disclosure.sanitise(docs, pii_disclosure.find(docs)).collect()}
    assert {k: r.sanitised for k, r in rows.items()} == {k: masked[k] if r.spans else None for k, r in rows.items()}
    assert rows[0].sanitised == "mail <email> now" and rows[2].sanitised is None
    assert [c for c in pii_disclosure.find(docs).columns] == [c for c in pii_disclosure.find(docs, with_text=True).columns if c != "sanitised"]
