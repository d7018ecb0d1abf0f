"""Queries that pass whole texts on."""

import json

from weftgraph.plans import graph_queries
from weftgraph.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def test_requests_and_contents_hold_whole_texts(spark):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert min(map(len, texts.values())) > 40
    sent = {r.item_id: json.loads(r.request)["body"]["input"] for r in QUERIES["k9_whole_batch_requests"](spark, DATA).collect()}
    assert sent == texts
    got = {r.item_id: r.content for r in QUERIES["json_whole_batch_content"](spark, DATA).collect()}
    assert got == {k: t if k % 3 else None for k, t in texts.items()}


def test_the_flagship_offers_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph_queries.context, "local_context", lambda nodes, edges, texts, *rest, **more: seen.append(texts))
    graph_queries.flagship_context(spark, DATA)
    given = {r.chunk_id: r.text for r in seen[0].collect()}
    assert given == {f"chunk-{r.doc_id}": r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
