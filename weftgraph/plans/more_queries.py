"""Queries of the smaller operators: joins, sets, texts, ranks and units."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import categories, citations, ids, text
from ..operators import communities, context, evaluation, repair, walks, words
from ..scratch import Scratch
from ..sources import pages, sinks
from .adapters import SIMPLE_EDGES_SQL, load, simple_edges, supply_edges, supply_nodes
from .catalogue import query

_S = f"s AS ({SIMPLE_EDGES_SQL})"
#: A type that has words of the category rules in it, made from a part's fields.
_KIND = "CASE p_size % 5 WHEN 0 THEN 'Crystal ' || p_type WHEN 1 THEN 'Test ' || p_name WHEN 2 THEN 'material' WHEN 3 THEN 'Component' ELSE p_type END"


@query("a29_broad_categories", f"SELECT {categories.broad_category_sql('k')} AS category, count(*) AS n FROM (SELECT {_KIND} AS k FROM part) GROUP BY 1")
def a29_broad_categories(spark, sf_dir):
    size = F.col("p_size") % 5
    kind = F.when(size == 0, F.concat(F.lit("Crystal "), "p_type")).when(size == 1, F.concat(F.lit("Test "), "p_name")).when(size == 2, "material").when(size == 3, "Component").otherwise(F.col("p_type"))
    return load(spark, sf_dir, "part").groupBy(categories.broad_category(kind).alias("category")).agg(F.count("*").alias("n"))


@query(
    "a30_word_groups",
    """WITH w AS (SELECT p_name AS word, count(*) AS count FROM part GROUP BY p_name), g AS (SELECT 'ring' AS word, coalesce(sum(count) FILTER (word LIKE '% ring'), 0) AS count, 'Y' AS keep, 1 AS r FROM w),
       a AS (SELECT * FROM g UNION ALL SELECT word, count, 'Y', 0 FROM w WHERE word LIKE 'small %' UNION ALL SELECT word, count, 'N', 2 FROM w WHERE word LIKE 'red %')
       SELECT word, CAST(count AS BIGINT) AS count, keep FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY r DESC) AS k FROM a) WHERE k = 1""",
)
def a30_word_groups(spark, sf_dir):
    w = load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("word")).agg(F.count("*").alias("count"))
    groups = w.where(F.col("word").endswith(" ring")).agg(F.lit("ring").alias("representative"), F.array_sort(F.collect_list("word")).alias("members"), F.lit(0).cast("long").alias("total_count"))
    return words.apply_groups(w, groups, w.where("word LIKE 'small %'"), w.where("word LIKE 'red %'"))


@query(
    "v11_word_candidates",
    f"""WITH n AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'Phase' WHEN 1 THEN '(' || p_name WHEN 2 THEN '7' || p_name WHEN 3 THEN 'ab' ELSE p_name END AS name FROM part)
        SELECT name, count(*) AS n FROM n WHERE lower(name) NOT IN ({", ".join(repr(g) for g in words.GENERIC)}) AND length(name) > 2 AND NOT regexp_matches(name, '^[\\[(0-9]') AND regexp_matches(name, '[A-Za-z]') GROUP BY name""",
)
def v11_word_candidates(spark, sf_dir):
    kind = F.col("p_partkey") % 6
    name = F.when(kind == 0, "Phase").when(kind == 1, F.concat(F.lit("("), "p_name")).when(kind == 2, F.concat(F.lit("7"), "p_name")).when(kind == 3, "ab").otherwise(F.col("p_name"))
    return load(spark, sf_dir, "part").select(name.alias("name")).where(words.candidate(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query("f10_normal_forms", "SELECT p_partkey, replace(translate(p_name, 'aeiou', 'aeiou'), '″', '''''') || translate(CAST(p_size AS VARCHAR), '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS shown FROM part")
def f10_normal_forms(spark, sf_dir):
    lowered = F.replace(words.formula(F.concat(F.lit("Q"), F.col("p_size").cast("string"))), F.lit("Q"), F.lit(""))
    return load(spark, sf_dir, "part").select("p_partkey", F.concat(words.plain_quotes(F.col("p_name")), lowered).alias("shown"))


@query(
    "f4_block_range",
    """WITH b AS (SELECT l_orderkey, list_distinct(list('page_1_block_' || l_linenumber ORDER BY l_linenumber)) AS u, list_sort(list_distinct(list(l_linenumber))) AS n FROM lineitem GROUP BY l_orderkey),
       x AS (SELECT l_orderkey, ['page_1_block_' || i FOR i IN n] AS b, n FROM b)
       SELECT l_orderkey, CASE WHEN len(b) = 1 THEN 'Block ' || b[1] WHEN n[len(n)] - n[1] + 1 = len(n) OR len(b) > 3 THEN (CASE WHEN n[len(n)] - n[1] + 1 = len(n) THEN 'Block ' ELSE 'Blocks ' END) || b[1] || '~' || b[len(b)]
              ELSE 'Blocks ' || array_to_string(b, ', ') END AS blocks FROM x""",
)
def f4_block_range(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    return lines.select("l_orderkey", citations.block_range(F.transform("n", lambda x: F.concat(F.lit("page_1_block_"), x.cast("string")))).alias("blocks"))


@query("f2_citations", "SELECT item_id, 'see [source: doc' || item_id || ' Page ' || item_id || ' Block b' || item_id || '] end' AS answer FROM benchmark")
def f2_citations(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark")
    sources = b.select(F.concat(F.lit("chunk-"), F.lower(F.hex("item_id"))).alias("chunk_id"), F.lit("text").alias("chunk_type"), F.format_string("doc%d.json", "item_id").alias("source_filename"), F.array(F.col("item_id").cast("int")).alias("pages"), F.array(F.format_string("b%d", "item_id")).alias("blocks"), F.lit(None).cast("string").alias("journal"), F.lit(None).cast("string").alias("year"))
    answers = b.select("item_id", F.concat(F.lit("see (E1) [Data: Entities (chunk-"), F.lower(F.hex("item_id")), F.lit("-e-3)]  end")).alias("answer"))
    return citations.rewrite_citations(answers, sources, "item_id").withColumn("answer", F.trim("answer"))


@query("f6_local_to_global", "SELECT s_suppkey, '[Data: S (N' || s_nationkey || ', ' || s_name || ')]' AS text FROM supplier")
def f6_local_to_global(spark, sf_dir):
    mapping = F.create_map(F.lit("E1"), F.concat(F.lit("N"), "s_nationkey"), F.lit("E12"), F.col("s_name"))
    rows = load(spark, sf_dir, "supplier").withColumn("m", mapping)
    from ..functions.citations import global_ids

    return rows.select("s_suppkey", global_ids(F.lit("[Data: S (E1, E12)]"), F.col("m")).alias("text"))


@query(
    "f9_blended_scores",
    """SELECT event_id, round(CASE event_type WHEN 'click' THEN 0.6 * k + 0.4 * s WHEN 'view' THEN CASE WHEN j IS NULL THEN s ELSE 0.8 * j + 0.2 * s END ELSE CASE WHEN j IS NULL THEN s ELSE 0.85 * j + 0.15 * s END END, 8) AS score
       FROM (SELECT event_id, event_type, (event_id % 7) / 7.0 AS k, (event_id % 11) / 11.0 AS s, CASE WHEN event_id % 3 > 0 THEN (event_id % 5) / 5.0 END AS j FROM events)""",
)
def f9_blended_scores(spark, sf_dir):
    n = F.col("event_id")
    level = F.when(F.col("event_type") == "click", "L1").when(F.col("event_type") == "view", "L3").otherwise("hard")
    none = [F.lit(None).cast("double")] * 3
    score = evaluation.blended_score(level, n % 7 / 7.0, n % 11 / 11.0, F.when(n % 3 > 0, n % 5 / 5.0), none)
    return load(spark, sf_dir, "events").select("event_id", F.round(score, 8).alias("score"))


@query("f11_templates", "SELECT s_suppkey, 'Name: ' || s_name || '; nation ' || s_nationkey || '.' AS prompt FROM supplier")
def f11_templates(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", text.filled("Name: $name; nation {nation}.", name=F.col("s_name"), nation=F.col("s_nationkey")).alias("prompt"))


@query("json_whole_batch_content", "SELECT item_id, CASE WHEN item_id % 3 > 0 THEN text END AS content FROM benchmark")
def json_whole_batch_content(spark, sf_dir):
    return _batch_content(spark, sf_dir, F.col("text"))


def _batch_content(spark, sf_dir, content):
    message = F.struct(F.struct(content.alias("content")).alias("message"))
    body = F.struct(F.array(message).alias("choices"))
    response = F.to_json(F.struct(F.struct(F.when(F.col("item_id") % 3 > 0, 200).otherwise(500).alias("status_code"), body.alias("body")).alias("response")))
    return load(spark, sf_dir, "benchmark").select("item_id", text.batch_content(response).alias("content"))


@query("hash_ids", "SELECT doc_id, 'doc-' || md5(source) AS document_key, 'chunk-' || md5(doc_id || '-7-' || lang) AS chunk_key FROM documents")
def hash_ids(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", ids.document_key(F.col("source")).alias("document_key"), ids.chunk_key(F.col("doc_id").cast("string"), F.lit(7), F.col("lang")).alias("chunk_key"))


@query("j3_repaired_keys", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_name END AS found FROM part")
def j3_repaired_keys(spark, sf_dir):
    """Lookup by an id as given, with hyphens, and with its last mark restored."""
    p = load(spark, sf_dir, "part")
    n, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    known = p.where("p_partkey % 4 < 3").select(F.when(kind == 0, F.concat(F.lit("c_"), n)).when(kind == 1, F.concat(F.lit("c-"), n)).otherwise(F.concat(F.lit("c-"), n, F.lit("_e-1"))).alias("key"), F.col("p_name").alias("name"))
    out = p.select("p_partkey", F.when(kind == 2, F.concat(F.lit("c_"), n, F.lit("-e-1"))).otherwise(F.concat(F.lit("c_"), n)).alias("asked"))
    for k, key in enumerate(ids.repaired_keys(F.col("asked"))):
        out = out.withColumn(f"k{k}", key).join(known.select(F.col("key").alias(f"k{k}"), F.col("name").alias(f"n{k}")), f"k{k}", "left")
    return out.select("p_partkey", F.coalesce("n0", "n1", "n2").alias("found"))


@query("j5_inside_edges", f"WITH {_S} SELECT src, dst, weight FROM s WHERE src IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey < 5) AND dst IN (SELECT 'P' || p_partkey FROM part WHERE p_type = 'ECONOMY')")
def j5_inside_edges(spark, sf_dir):
    members = load(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.concat(F.lit("S"), "s_suppkey").alias("id")).union(load(spark, sf_dir, "part").where("p_type = 'ECONOMY'").select(F.concat(F.lit("P"), "p_partkey").alias("id")))
    return walks.induced(simple_edges(spark, sf_dir), members).select("src", "dst", "weight")


@query("j11_capped_texts", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 15")
def j11_capped_texts(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return load(spark, sf_dir, "documents").select("source", "doc_id", rank.alias("r")).where("r <= 15").drop("r")


@query(
    "j14_child_summaries",
    """WITH c AS (SELECT r_name AS p, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation JOIN region ON r_regionkey = n_regionkey)
       SELECT p AS community, string_agg('### ' || n_name || E'\\nnation ' || n_name || E'\\n- a\\n- b\\n- c', E'\\n\\n' ORDER BY k) AS text FROM c GROUP BY p""",
)
def j14_child_summaries(spark, sf_dir):
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    groups = n.groupBy(F.col("r_name").alias("community")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("children_ids"))
    reports = n.select(F.col("n_name").alias("community"), F.col("n_name").alias("title"), F.concat(F.lit("nation "), "n_name").alias("summary"), F.array(*[F.lit(x) for x in "abcd"]).alias("findings"))
    return context.child_summaries(groups, reports)


@query("j18_base_chunks", "SELECT item_id, source FROM (SELECT item_id, item_id % 7 AS k FROM benchmark) JOIN (SELECT DISTINCT source, CAST(substr(source, 4) AS BIGINT) AS n FROM documents) ON k = n")
def j18_base_chunks(spark, sf_dir):
    cited = load(spark, sf_dir, "benchmark").select("item_id", F.format_string("chunk-%x-e-%d", F.col("item_id") % 7, F.col("item_id")).alias("key"))
    files = load(spark, sf_dir, "documents").select("source").distinct().select("source", F.format_string("chunk-%x", F.substring("source", 4, 9).cast("long")).alias("chunk"))
    return cited.join(files, ids.base_chunk(F.col("key")) == F.col("chunk")).select("item_id", "source")


@query("u2_u3_sets", f"WITH {_S} SELECT 'union' AS kind, count(*) AS n FROM (SELECT src FROM s WHERE weight > 120 UNION SELECT dst FROM s WHERE weight > 120) UNION ALL SELECT 'both', count(*) FROM (SELECT dst FROM s WHERE weight > 100 INTERSECT SELECT dst FROM s WHERE weight < 5)")
def u2_u3_sets(spark, sf_dir):
    e = simple_edges(spark, sf_dir)
    union = e.where("weight > 120").select("src").union(e.where("weight > 120").select("dst")).distinct()
    both = e.where("weight > 100").select("dst").intersect(e.where("weight < 5").select("dst"))
    return union.agg(F.lit("union").alias("kind"), F.count("*").alias("n")).union(both.agg(F.lit("both").alias("kind"), F.count("*").alias("n")))


@query("u5_path_chunks", "SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS chunks FROM lineitem GROUP BY l_orderkey")
def u5_path_chunks(spark, sf_dir):
    """Chunk ids of a path's nodes: scalar or list, all in one set."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array(F.col("l_suppkey").cast("string"))).alias("lists"))
    return rows.select("l_orderkey", F.array_join(F.array_sort(F.array_distinct(F.flatten("lists"))), ",").alias("chunks"))


@query("u6_last_map_wins", "SELECT user_id, event_type, max(k) AS id FROM (SELECT user_id, event_type, last_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS k FROM events) GROUP BY user_id, event_type")
def u6_last_map_wins(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("id"))


@query("w9_top_nodes", f"WITH {_S} SELECT src AS id, sum(weight) AS score FROM s GROUP BY src ORDER BY score DESC, id LIMIT 20")
def w9_top_nodes(spark, sf_dir):
    return simple_edges(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("w10_best_then_least", f"WITH {_S} SELECT src, dst, score FROM (SELECT src, dst, weight / 200 AS score FROM s ORDER BY score DESC, dst, src LIMIT 10) WHERE score >= 0.7")
def w10_best_then_least(spark, sf_dir):
    rows = simple_edges(spark, sf_dir).select(F.array("dst", "src").alias("path"), (F.col("weight") / 200).alias("score"))
    best = walks.ranked_paths(rows, 10, 0.7)
    return best.select(F.get("path", F.lit(1)).alias("src"), F.get("path", F.lit(0)).alias("dst"), "score")


@query(
    "w11_seeds_first",
    f"""WITH {_S}, h AS (SELECT 'S1' AS id, 0 AS hop UNION ALL SELECT DISTINCT dst, 1 FROM s WHERE src = 'S1') SELECT id, hop = 0 AS is_seed, CAST(row_number() OVER (ORDER BY hop, id) AS INTEGER) AS place FROM h""",
)
def w11_seeds_first(spark, sf_dir):
    hops = walks.neighbourhood(simple_edges(spark, sf_dir), spark.createDataFrame([("S1",)], "id string"), 1)
    rows = context.seeds_first(hops)
    return rows.select("id", "is_seed", F.row_number().over(Window.orderBy(F.desc("is_seed"), "id")).alias("place"))


@query("w13_first_three", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3")
def w13_first_three(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return rows.select("conv_id", F.explode(F.slice("t", 1, 3)).alias("turn"))


@query("v5_clean_fields", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS brand, CAST((p_partkey % 3 > 0)::INTEGER + (p_partkey % 4 > 0)::INTEGER AS INTEGER) AS n FROM part")
def v5_clean_fields(spark, sf_dir):
    nan = lambda k, c: F.when(F.col("p_partkey") % k == 0, "NaN").otherwise(F.col(c))
    fields = F.create_map(F.lit("name"), nan(3, "p_name"), F.lit("brand"), nan(4, "p_brand"), F.lit("name x: "), F.lit("y"), F.concat(F.lit("e-"), "p_partkey"), F.lit("own"))
    rows = load(spark, sf_dir, "part").select("p_partkey", repair.clean_fields(fields, F.concat(F.lit("e-"), "p_partkey")).alias("f"))
    return rows.select("p_partkey", F.col("f")["name"].alias("name"), F.col("f")["brand"].alias("brand"), F.size("f").alias("n"))


@query("v8_community_text", "SELECT n_nationkey, E'Title: ' || n_name || E'\\nAbstract: region ' || n_regionkey || E'\\nfindings:\\na ' || n_name || E'\\nb b' AS text FROM nation")
def v8_community_text(spark, sf_dir):
    finding = lambda a, b: F.struct(a.alias("summary"), b.alias("explanation"))
    report = F.struct(F.col("n_name").alias("title"), F.concat(F.lit("region (E1)  "), "n_regionkey").alias("summary"), F.array(finding(F.lit("a"), F.col("n_name")), finding(F.lit("b"), F.lit("b [Data: x (1)]"))).alias("findings"))
    return load(spark, sf_dir, "nation").select("n_nationkey", communities.community_text(report).alias("text"))


@query("v13_map_points", "SELECT event_id AS id, value AS score FROM events WHERE event_type <> 'error' AND value > 0")
def v13_map_points(spark, sf_dir):
    points = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", "x").alias("answer"), F.col("value").alias("score"))
    return context.reduced_points(points).select("id", "score")


def _blocks(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 3
    none = F.lit(None).cast("string")
    return p.select(
        F.concat("p_brand", F.lit(".json")).alias("filename"), none.alias("title"), F.lit("1").alias("page_number"), F.col("p_partkey").alias("place"), F.concat(F.lit("b"), "p_partkey").alias("block_id"),
        F.when(kind == 0, "table").otherwise("image").alias("type"), F.when(kind == 1, F.to_json(F.struct(F.col("p_name").alias("title"), F.lit("up").alias("trend")))).when(kind == 2, F.to_json(F.struct(F.col("p_name").alias("description")))).alias("content"),
        F.when(F.col("p_size") > 10, F.col("p_type")).alias("caption"), F.when(F.col("p_size") > 5, F.concat(F.lit("a,"), "p_size")).alias("csv_data"), none.alias("data"), none.alias("summary"), F.when(kind == 1, "chart").otherwise("photograph").alias("image_type"),
    )


@query("s5_table_units", "SELECT 'b' || p_partkey AS block, CASE WHEN p_size > 10 THEN 'Caption: ' || p_type || chr(10) ELSE '' END || 'Data:' || chr(10) || 'a,' || p_size AS text FROM part WHERE p_partkey % 3 = 0 AND p_size > 5")
def s5_table_units(spark, sf_dir):
    return pages.table_units(_blocks(spark, sf_dir)).select(F.get("blocks", F.lit(0)).alias("block"), "text")


@query(
    "s6_image_units",
    """SELECT 'b' || p_partkey AS block, CASE WHEN p_size > 10 THEN 'Caption: ' || p_type || chr(10) ELSE '' END || CASE p_partkey % 3 WHEN 1 THEN 'Image Type: chart' || chr(10) || 'Title: ' || p_name || chr(10) || 'Trend: up' || chr(10) || 'Full Content: {"title":"' || p_name || '","trend":"up"}'
       ELSE 'Image Type: photograph' || chr(10) || 'Description: ' || p_name || chr(10) || 'Full Content: {"description":"' || p_name || '"}' END AS text FROM part WHERE p_partkey % 3 > 0""",
)
def s6_image_units(spark, sf_dir):
    return pages.image_units(_blocks(spark, sf_dir)).select(F.get("blocks", F.lit(0)).alias("block"), "text")


@query("s7_image_prompts", "SELECT 'b' || p_partkey AS block, CASE p_partkey % 3 WHEN 1 THEN 'Title: ' || p_name || chr(10) || 'Trend: up' ELSE 'Description: ' || p_name END AS prompt FROM part WHERE p_partkey % 3 > 0")
def s7_image_prompts(spark, sf_dir):
    rows = _blocks(spark, sf_dir).where("type = 'image'")
    return rows.select(F.col("block_id").alias("block"), pages.image_prompt(F.col("image_type"), F.col("content")).alias("prompt"))


@query("s15_report_texts", "SELECT n_nationkey, '**' || n_name || '**' || chr(10) || chr(10) || 'in ' || n_regionkey || chr(10) || chr(10) || '**Key Findings:**' || chr(10) || '- one' || chr(10) || '- two' AS text FROM nation")
def s15_report_texts(spark, sf_dir):
    from ..sources.tables import report_text

    finding = lambda s: F.struct(F.lit(s).alias("summary"), F.lit("").alias("explanation"))
    report = F.struct(F.col("n_name").alias("title"), F.concat(F.lit("in "), "n_regionkey").alias("summary"), F.array(finding("one"), finding("two")).alias("findings"))
    return load(spark, sf_dir, "nation").select("n_nationkey", report_text(report).alias("text"))


@query("s19_latest_files", "SELECT method, 'd/' || method || '_scores_' || max(d) || '_000000.jsonl' AS path FROM (SELECT event_type AS method, strftime(ts, '%Y%m%d') AS d FROM events) GROUP BY method")
def s19_latest_files(spark, sf_dir):
    from ..sources.tables import latest_files

    files = load(spark, sf_dir, "events").select(F.concat(F.lit("d/"), "event_type", F.lit("_scores_"), F.date_format("ts", "yyyyMMdd"), F.lit("_000000.jsonl")).alias("path")).distinct()
    return latest_files(files).select("method", "path")


@query("s20_methods_by_rule", "SELECT event_id, CASE WHEN event_type LIKE 'cl%' THEN 'local' WHEN event_type LIKE '%o%' THEN 'global' END AS method FROM events")
def s20_methods_by_rule(spark, sf_dir):
    from ..sources.tables import method_of

    return load(spark, sf_dir, "events").select("event_id", method_of(F.col("event_type"), {"^cl": "local", "o": "global"}).alias("method"))


@query("k7_property_nodes", "SELECT id, CASE WHEN label = '' THEN 'Thing' ELSE label END AS label, name, k FROM (SELECT 'P' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS label, p_name AS name, p_brand AS k FROM part)")
def k7_property_nodes(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")).alias("type"), F.create_map(F.lit("name"), F.lit("hidden"), F.lit("k"), F.col("p_brand")).alias("attributes"))
    p = F.col("properties")
    return sinks.property_nodes(rows).select(p["id"].alias("id"), "label", p["name"].alias("name"), p["k"].alias("k"))


@query("k5_vector_rows", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(event_id % 4 AS INTEGER) END AS level, CASE WHEN event_type = 'view' THEN 0.0 ELSE value END AS rating FROM events")
def k5_vector_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "x").otherwise((F.col("event_id") % 4).cast("string")).alias("level"), F.when(F.col("event_type") == "view", "bad").otherwise(F.col("value").cast("string")).alias("rating"))
    return sinks.vector_rows(rows, []).select("id", "level", "rating")


@query("k11_scores_by_method", "SELECT user_id, round(max(value) FILTER (event_type = 'click'), 4) AS click, round(max(value) FILTER (event_type = 'view'), 4) AS \"view\" FROM events GROUP BY user_id")
def k11_scores_by_method(spark, sf_dir):
    best = load(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("method")).agg(F.round(F.max("value"), 4).alias("score"))
    return evaluation.wide_scores(best, "user_id", ["click", "view"])


@query(
    "g18_completed_labels",
    f"""WITH {_S}, l AS (SELECT 'S' || s_suppkey AS id, CAST(s_nationkey AS VARCHAR) AS community FROM supplier), n AS (SELECT 'P' || p_partkey AS id FROM part),
        f AS (SELECT dst AS id, arg_min(l.community, l.id) AS community FROM s JOIN l ON l.id = s.src GROUP BY dst)
        SELECT id, community FROM l UNION ALL SELECT n.id, coalesce(f.community, 'new-' || n.id) FROM n LEFT JOIN f USING (id)""",
)
def g18_completed_labels(spark, sf_dir):
    labels = load(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("community"))
    return communities.complete_labels(supply_nodes(spark, sf_dir).select("id"), simple_edges(spark, sf_dir), labels)


@query(
    "g24_labelled_nodes",
    """WITH d AS (SELECT id, count(*) AS degree FROM (SELECT 'S' || l_suppkey AS id FROM lineitem UNION ALL SELECT 'P' || l_partkey FROM lineitem) GROUP BY id)
       SELECT 'S' || s_suppkey AS id, s_nationkey AS community, coalesce(degree, 0) AS degree FROM supplier LEFT JOIN d ON d.id = 'S' || s_suppkey""",
)
def g24_labelled_nodes(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    return communities.labelled(s.select("id"), supply_edges(spark, sf_dir), s).select("id", "community", "degree")


@query("g32_masked_scores", f"WITH {_S} SELECT src, dst, round(weight / 100, 6) AS attention FROM s WHERE src IN ('S1', 'S2')")
def g32_masked_scores(spark, sf_dir):
    """Attention on real edges only: what is no edge has no row."""
    e = simple_edges(spark, sf_dir)
    scores = e.where(F.col("src").isin("S1", "S2")).select("src", "dst", F.round(F.col("weight") / 100, 6).alias("attention")).union(spark.createDataFrame([("S1", "S2", 1.0)], "src string, dst string, attention double"))
    return scores.join(e.select("src", "dst"), ["src", "dst"], "left_semi")


@query(
    "g6_all_explanations",
    f"""WITH {_S} SELECT src, dst, s_name || ' --[SUPPLIES]--> ' || p_name AS explanation FROM s JOIN supplier ON 'S' || s_suppkey = src JOIN part ON 'P' || p_partkey = dst""",
)
def g6_all_explanations(spark, sf_dir):
    return _explanations(spark, sf_dir, simple_edges(spark, sf_dir))


def _explanations(spark, sf_dir, edges):
    edges = Scratch(spark, "g6").keep(edges.select("src", "dst"), "edges")  # read twice, so its rows must not change places
    e = edges.select("src", "dst", F.lit("SUPPLIES").alias("relationship"), F.lit("").alias("description"))
    paths = e.select(F.array("src", "dst").alias("path"))
    rows = walks.explained(paths, e, supply_nodes(spark, sf_dir))
    return rows.select(F.get("path", F.lit(0)).alias("src"), F.get("path", F.lit(1)).alias("dst"), "explanation")


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from ..streaming.incremental import event_windows as windows

    return windows(load(spark, sf_dir, "events")).withColumn("mean", F.round("mean", 6))


@query(
    "f7_keywords",
    """SELECT p_partkey, p_size || ' MPa' AS numbers, 'CMSX-' || p_size AS alloys, CASE WHEN p_size % 2 = 0 THEN 'gamma|gamma prime' ELSE 'rafting' END AS terms FROM part""",
)
def f7_keywords(spark, sf_dir):
    from ..functions import keywords

    size = F.col("p_size").cast("string")
    said = F.concat(F.lit("at "), size, F.lit(" MPa: "), F.when(F.col("p_size") % 2 == 0, "Gamma Prime").otherwise("RAFTING"))
    join = lambda a: F.array_join(a, "|")
    rows = load(spark, sf_dir, "part").select("p_partkey", said.alias("said"), F.concat(F.lit("CMSX-"), size).alias("alloy"))
    number = F.replace(join(keywords.numbers(F.replace(F.col("said"), F.lit(" MPa"), F.lit("MPa")))), F.lit("MPa"), F.lit(" MPa"))
    named = F.filter(keywords.alloys(F.col("alloy")), lambda a: a.startswith("CMSX"))
    return rows.select("p_partkey", number.alias("numbers"), join(F.when(F.size(named) > 0, named).otherwise(F.array("alloy"))).alias("alloys"), join(keywords.terms(F.col("said"))).alias("terms"))


@query(
    "n1_attention",
    """WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, l_linenumber % 2 AS head, sum(l_discount) AS l FROM lineitem GROUP BY ALL), m AS (SELECT *, exp(l - max(l) OVER (PARTITION BY dst, head)) AS x FROM e)
       SELECT src, dst, head, round(x / sum(x) OVER (PARTITION BY dst, head), 8) AS attention FROM m""",
)
def n1_attention(spark, sf_dir):
    e = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_linenumber") % 2).alias("head")).agg(F.sum("l_discount").alias("l"))
    return walks.attention(e, F.col("l")).select("src", "dst", "head", F.round("attention", 8).alias("attention"))


@query("n6_mean_attention", f"WITH {_S} SELECT src, dst, CASE WHEN src = 'S1' THEN 0.75 ELSE weight END AS attention FROM s")
def n6_mean_attention(spark, sf_dir):
    e = simple_edges(spark, sf_dir)
    heads = e.where("src = 'S1'").select("src", "dst", F.explode(F.array(F.lit(0.5), F.lit(1.0))).alias("attention"))
    return walks.mean_attention(e, heads).select("src", "dst", "attention")


@query("v6_to_embed", "SELECT 'P' || p_partkey AS id, p_name || ': ' || p_brand AS text FROM part WHERE p_size % 3 = 0")
def v6_to_embed(spark, sf_dir):
    nodes = supply_nodes(spark, sf_dir).join(load(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), (F.col("p_size") % 3 == 0).alias("is_disambiguated")), "id", "left")
    return repair.to_embed(nodes)
