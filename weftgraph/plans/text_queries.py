"""Queries over texts: chunks, offsets, cleaning, repair, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.citations import page_range
from ..functions.relations import relation_group, relation_group_sql
from ..functions.text import embedding_text, without_tags
from ..operators import chunking, evaluation, repair
from .adapters import load, units
from .catalogue import query

_STRIP = r"regexp_replace(text, '^[ \t\n\f\r\x0b]+|[ \t\n\f\r\x0b]+$', '', 'g')"


@query(
    "p1_chunk",
    """
    WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
    c AS (SELECT doc_id, text, n, unnest(range(greatest(1, CAST(ceil((n - 200) / 800.0) AS BIGINT)))) AS k FROM d),
    x AS (SELECT doc_id, k, k * 800 AS s, least(k * 800 + 1000, n) AS e, substr(text, k * 800 + 1, 1000) AS t FROM c)
    SELECT doc_id, CAST(k AS INTEGER) AS chunk, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end",
           'chunk-' || md5(doc_id || '-' || k || '-' || t) AS chunk_id, CAST(length(t) AS INTEGER) AS n_chars FROM x
    """,
)
def p1_chunk(spark, sf_dir):
    return chunking.chunk_texts(load(spark, sf_dir, "documents")).select("doc_id", "chunk", "start", "end", "chunk_id", F.length("text").alias("n_chars"))


def _segments(spark, sf_dir):
    return chunking.segment_offsets(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_SEGMENTS = f"""
    t AS (SELECT conv_id, turn, {_STRIP} AS content FROM conversations),
    s AS (SELECT conv_id, turn, content, CAST(coalesce(sum(length(content) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS st
          FROM t WHERE length(content) > 0)
"""


@query("w1_segment_offsets", f'WITH {_SEGMENTS} SELECT conv_id, turn, st AS "start", CAST(st + length(content) AS INTEGER) AS "end", md5(content) AS content_md5 FROM s')
def w1_segment_offsets(spark, sf_dir):
    return _segments(spark, sf_dir).select("conv_id", "turn", "start", "end", F.md5("content").alias("content_md5"))


_DOCUMENT = f"""
    {_SEGMENTS},
    d AS (SELECT conv_id, string_agg(content, E'\\n\\n' ORDER BY turn) AS text FROM s GROUP BY conv_id),
    c AS (SELECT conv_id, text, length(text) AS n, unnest(range(greatest(1, CAST(ceil((length(text) - 40) / 160.0) AS BIGINT)))) AS k FROM d)
"""


@query(
    "p2_chunk_provenance",
    f"""WITH {_DOCUMENT} SELECT c.conv_id, CAST(k AS INTEGER) AS chunk, md5(substr(c.text, k * 160 + 1, 200)) AS text_md5,
        string_agg(CAST(s.turn AS VARCHAR), ',' ORDER BY s.turn) AS sources
        FROM c JOIN s ON s.conv_id = c.conv_id AND s.st < least(k * 160 + 200, n) AND s.st + length(s.content) > k * 160 GROUP BY c.conv_id, k, c.text""",
)
def p2_chunk_provenance(spark, sf_dir):
    documents = chunking.joined_text(_segments(spark, sf_dir), "conv_id", "turn")
    rows = chunking.chunk_sources(documents, "conv_id", 200, 40).where(F.size("sources") > 0)
    return rows.select("conv_id", "chunk", F.md5("text").alias("text_md5"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query(
    "j7_segment_overlap",
    f"""WITH {_DOCUMENT} SELECT c.conv_id, CAST(k AS INTEGER) AS chunk, count(*) AS n, CAST(sum(s.st) AS BIGINT) AS starts
        FROM c JOIN s ON s.conv_id = c.conv_id AND s.st < least(k * 160 + 200, n) AND s.st + length(s.content) > k * 160 GROUP BY c.conv_id, k""",
)
def j7_segment_overlap(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    documents = chunking.joined_text(segments, "conv_id", "turn")
    chunks = chunking.chunk_sources(documents, "conv_id", 200, 40).select("conv_id", "chunk", "start", "end")
    return chunking.overlapping_segments(chunks, segments, "conv_id").groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.sum("segment_start").alias("starts"))


@query(
    "u1_modalities",
    """WITH u AS (SELECT 'text' AS unit_type, text FROM documents UNION ALL SELECT 'abstract', text FROM benchmark
        UNION ALL SELECT 'table', text FROM conversations UNION ALL SELECT 'image', html FROM pages)
       SELECT unit_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM u GROUP BY unit_type""",
)
def u1_modalities(spark, sf_dir):
    from ..operators.stats import with_share

    rows = units(spark, sf_dir).groupBy("unit_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))
    return with_share(rows).withColumn("share", F.round("share", 8))


@query(
    "v2_json_props",
    """SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, json_extract_string(props, '$.none') IS NULL AS lacks FROM events""",
)
def v2_json_props(spark, sf_dir):
    from ..functions.text import tolerant_variant

    rows = load(spark, sf_dir, "events").withColumn("v", tolerant_variant(F.col("props")))
    return rows.select("event_id", F.coalesce(F.try_variant_get("v", "$.k", "int"), F.lit(-1)).alias("k"), F.try_variant_get("v", "$.none", "string").isNull().alias("lacks"))


@query(
    "v2_repair_relationships",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS relationship, 'Relationship' AS description,
              coalesce(try_cast(CASE WHEN event_type = 'view' THEN 'x' ELSE CAST(event_id % 5 AS VARCHAR) END AS DOUBLE), 1.0) AS weight FROM events""",
)
def v2_repair_relationships(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "NaN").otherwise(F.col("event_type"))
    weight = F.when(F.col("event_type") == "view", "x").otherwise((F.col("event_id") % 5).cast("string"))
    rows = e.select("event_id", F.create_map(F.lit("relationship"), kind, F.lit("weight"), weight).alias("fields"))
    return repair.repair_relationships(rows).select("event_id", "relationship", "description", "weight")


@query(
    "v1_repair_entities",
    """SELECT p_partkey,
        CASE p_partkey % 4 WHEN 0 THEN 'e-' || p_partkey WHEN 1 THEN 'e-' || p_partkey WHEN 2 THEN 'e-' || p_partkey ELSE 'e-unknown' END AS id,
        CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name ELSE 'Unknown Entity' END AS name,
        CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE CASE WHEN p_partkey % 4 = 3 THEN 'Entity' WHEN regexp_matches(lower(p_name), 'alloy|superalloy|material|steel|metal') THEN 'Material'
             WHEN regexp_matches(lower(p_name), 'temperature|stress|strength|hardness|toughness|property') THEN 'Property' ELSE 'Entity' END END AS type,
        CASE p_partkey % 4 WHEN 0 THEN 'description_generated,attributes_missing' WHEN 1 THEN 'missing_id_field,name_in_id_field,type_inferred,description_generated,attributes_missing'
             WHEN 2 THEN 'name_merged_with_description,type_inferred,attributes_missing,non_standard_field_name' || p_name || ': ' ELSE 'missing_id_completely,name_default_fallback,type_inferred,description_generated,attributes_missing' END AS errors
        FROM part""",
)
def v1_repair_entities(spark, sf_dir):
    key = F.concat(F.lit("e-"), F.col("p_partkey"))
    shape = F.col("p_partkey") % 4
    fields = (
        F.when(shape == 0, F.create_map(F.lit("id"), key, F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type")))
        .when(shape == 1, F.create_map(key, F.col("p_name")))
        .when(shape == 2, F.create_map(F.lit("id"), key, F.concat(F.lit("name"), "p_name", F.lit(": ")), F.lit("told")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    rows = repair.repair_entities(load(spark, sf_dir, "part").select("p_partkey", fields.alias("fields")))
    return rows.select("p_partkey", "id", "name", "type", F.array_join("error_types", ",").alias("errors"))


@query(
    "a1_fix_statistics",
    """SELECT error_type, count(*) AS n FROM (SELECT unnest(CASE p_partkey % 3 WHEN 0 THEN ['description_generated', 'attributes_missing']
        WHEN 1 THEN ['missing_id_field', 'name_in_id_field', 'type_inferred', 'description_generated', 'attributes_missing']
        ELSE ['missing_id_completely', 'name_default_fallback', 'type_inferred', 'description_generated', 'attributes_missing'] END) AS error_type FROM part) GROUP BY error_type""",
)
def a1_fix_statistics(spark, sf_dir):
    key = F.concat(F.lit("e-"), F.col("p_partkey"))
    shape = F.col("p_partkey") % 3
    fields = F.when(shape == 0, F.create_map(F.lit("id"), key, F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"))).when(shape == 1, F.create_map(key, F.col("p_name"))).otherwise(F.create_map().cast("map<string,string>"))
    return repair.error_counts(repair.repair_entities(load(spark, sf_dir, "part").select(fields.alias("fields"))))


@query("f1_normalise_type", f"SELECT p_partkey, {relation_group_sql('p_type')} AS by_type, {relation_group_sql('p_name')} AS by_name FROM part")
def f1_normalise_type(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", relation_group(F.col("p_type")).alias("by_type"), relation_group(F.col("p_name")).alias("by_name"))


@query(
    "f3_page_range",
    """WITH p AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS p FROM lineitem GROUP BY l_orderkey)
       SELECT l_orderkey, CASE WHEN len(p) = 1 THEN 'Page ' || p[1] WHEN p[len(p)] - p[1] + 1 = len(p) THEN 'Page ' || p[1] || '-' || p[len(p)]
              ELSE 'Pages ' || array_to_string(p, ', ') END AS pages FROM p""",
)
def f3_page_range(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(page_range(F.collect_list("l_linenumber")).alias("pages"))


@query(
    "f5_clean",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\[Data:[^\]]*\]', '', 'g'), '[ \t\n\x0b\f\r]*\([ER]\d+\)', '', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS clean_md5 FROM documents""",
)
def f5_clean(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(embedding_text(F.col("text"))).alias("clean_md5"))


@query(
    "s1_page_text",
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
        '(?s)<!--.*?-->|<[^>]+>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS text_md5 FROM pages""",
)
def s1_page_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(without_tags(F.col("html"))).alias("text_md5"))


@query(
    "f8_keyword_f1",
    """WITH t AS (SELECT item_id, list_distinct([lower(x) FOR x IN string_split(text, ' ') IF length(x) > 6]) AS t FROM benchmark),
       d AS (SELECT doc_id, list_distinct([lower(x) FOR x IN string_split(text, ' ') IF length(x) > 6]) AS a FROM documents WHERE doc_id % 50 = 0),
       h AS (SELECT item_id, doc_id, len(t) AS nt, len(a) AS na, len([x FOR x IN t IF len([y FOR y IN a IF contains(y, x) OR contains(x, y)]) > 0]) AS h FROM t, d)
       SELECT item_id, doc_id, round(CASE WHEN nt = 0 THEN 1 WHEN na = 0 OR h = 0 THEN 0 ELSE 2.0 * (h / na) * (h / nt) / (h / na + h / nt) END, 8) AS f1 FROM h""",
)
def f8_keyword_f1(spark, sf_dir):
    """The stated questions (ids divisible by 50) against all of the small benchmark."""
    words = lambda c: F.filter(F.split(c, " "), lambda x: F.length(x) > 6)
    truth = load(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("t"))
    answers = load(spark, sf_dir, "documents").where("doc_id % 50 = 0").select("doc_id", words(F.col("text")).alias("a"))
    score = evaluation.matched_share(F.col("t"), F.col("a"))["f1"]
    return truth.crossJoin(answers).select("item_id", "doc_id", F.round(score, 8).alias("f1"))


@query(
    "w2_batches",
    """SELECT item_id, row_number() OVER (ORDER BY length(text) DESC, item_id) - 1 AS position, CAST(floor((row_number() OVER (ORDER BY length(text) DESC, item_id) - 1) / 16) AS BIGINT) AS batch FROM benchmark""",
)
def w2_batches(spark, sf_dir):
    rows = load(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n"))
    return chunking.batch_numbers(rows, [F.desc("n"), F.asc("item_id")], 16).select("item_id", F.col("position").cast("long").alias("position"), F.col("batch").cast("long").alias("batch"))


@query(
    "k9_whole_batch_requests",
    """SELECT item_id, '{"custom_id":"item-' || item_id || '","method":"POST","url":"/v1/embeddings","body":{"input":' || to_json(text) || ',"model":"stub"}}' AS request FROM benchmark""",
)
def k9_whole_batch_requests(spark, sf_dir):
    return _batch_requests(spark, sf_dir, F.col("text"))


def _batch_requests(spark, sf_dir, text):
    from ..sources.sinks import batch_requests

    rows = load(spark, sf_dir, "benchmark")
    return batch_requests(rows, F.concat(F.lit("item-"), "item_id"), "/v1/embeddings", F.struct(text.alias("input"), F.lit("stub").alias("model"))).select("item_id", "request")
