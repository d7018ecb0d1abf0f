import random

from tests.llm.helpers import SCHEMA
from weftgraph.llm import best_fit_packing


def test_stages_run_in_order_and_their_decisions_hold(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))
    size = lambda: rng.randrange(20, 60)
    prose = [f"{fresh(size())}, {fresh(size())} shared{rng.randrange(10**6)} with. {fresh(size())}" for _ in range(200)]
    junk = [" ".join(f"T{i}U{j}!! ***" for j in range(size())).upper() for i in range(80)]
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = prose + junk + [prose[0] + " end", fresh(60) + " " + passage, fresh(60) + " " + passage + ' token = "1eb9c654e721b4f812088970e66a6345cee33dd6"']
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i in range(280)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "secret scans", "best-fit packing"]
    kept = docs
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/stage-{len(ids)}")
        kept = spark.read.parquet(f"{tmp_path}/stage-{len(ids)}")
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert ids[0] == set(range(200)) | {280, 281, 282}  # the junk goes
    assert ids[1] == ids[0] - {280} and ids[2] == ids[3] == ids[1]  # then the copy
    last = {r.doc_id: r for r in kept.collect()}
    assert "shared5" in last[281].text and "shared5" not in last[282].text
    assert "[SECRET]" in last[282].text and all(r.n_chars == len(r.text) for r in last.values())

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    coder = best_fit_packing.WordIds(corpus_pipeline.WORD_VOCABULARY)
    lengths = {i: len(coder.tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in last.items()}
    assert {r.doc_id for r in rows} == set(lengths) and sum(r.length for r in rows) == sum(lengths.values())


def test_packed_rows_of_an_empty_corpus(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_nulls_repeats_and_further_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))
    texts = [fresh(40) for _ in range(60)] + [" ".join(f"T{i}U{j}!! ***" for j in range(40)).upper() for i in range(30)]
    rows = [(i, t, f"x{i}") for i, t in enumerate(texts)] + [(None, fresh(40), "n"), (None, None, "e"), (3, fresh(40), "again"), (5, texts[5], "x5"), (200, None, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, node string").selectExpr("*", "node AS `__id`", "1 AS runs").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = kept.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/kept-{k}")
        kept = spark.read.parquet(f"{tmp_path}/kept-{k}")
    got = kept.collect()
    assert all(r.node == r["__id"] and r.runs == 1 for r in got) and {r.node for r in got} >= {f"x{i}" for i in range(60)} | {"n", "again"}
    assert sum(r.doc_id == 5 for r in got) == 1 and sum(r.doc_id == 3 for r in got) == 2
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(got)
