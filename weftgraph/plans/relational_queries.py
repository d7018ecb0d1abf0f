"""Queries of joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.relations import relation_group, relation_group_sql
from ..operators import context, evaluation, importance, merging, repair, stats
from .adapters import SIMPLE_EDGES_SQL, load, simple_edges, supply_edges, supply_nodes, units
from .catalogue import query

_EDGES = "e AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_returnflag AS relationship, l_linestatus AS description, l_quantity AS weight, l_orderkey * 10 + l_linenumber AS position FROM lineitem)"


@query(
    "v4_first_wins",
    f"""WITH {_EDGES} SELECT src, dst, relationship, weight, position FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY position, relationship, weight, description) AS r FROM e) WHERE r = 1""",
)
def v4_first_wins(spark, sf_dir):
    rows = repair.first_by_key(supply_edges(spark, sf_dir), ["src", "dst"], ["position", "relationship", "weight", "description"])
    return rows.select("src", "dst", "relationship", "weight", "position")


@query(
    "j1_edges",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, coalesce(s_name, 'Unknown') || ' -> [' || l_linestatus || '] -> ' || coalesce(p_name, 'Unknown') AS text
       FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey""",
)
def j1_edges(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.col("l_linestatus").alias("description"))
    return merging.triplet_texts(rows, supply_nodes(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "text")


_ALIAS = """a AS (SELECT 'S' || s_suppkey AS alias, 'S' || min(s_suppkey) OVER (PARTITION BY s_nationkey) AS canonical FROM supplier),
    r AS (SELECT coalesce(canonical, src) AS src, dst, relationship, weight, description, position FROM e LEFT JOIN a ON alias = src)"""


def _aliased(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("c"))
    aliases = s.join(first, "s_nationkey").select(F.concat(F.lit("S"), "s_suppkey").alias("alias"), F.concat(F.lit("S"), "c").alias("canonical"))
    return merging.rewrite_ends(supply_edges(spark, sf_dir), aliases)


for _rule in ("max", "sum"):

    @query(
        f"j4_alias_rewrite_{_rule}",
        f"WITH {_EDGES}, {_ALIAS} SELECT src, dst, relationship, {_rule}(weight) AS weight, count(*) AS n_merged FROM r WHERE src <> dst GROUP BY src, dst, relationship",
    )
    def j4_alias_rewrite(spark, sf_dir, rule=_rule):
        return merging.merge_edges(_aliased(spark, sf_dir), rule).select("src", "dst", "relationship", "weight", "n_merged")


@query(
    "a2_entity_merge",
    """WITH n AS (SELECT p_brand, p_name, count(*) AS c FROM part GROUP BY p_brand, p_name), t AS (SELECT p_brand, p_type, count(*) AS c, min(p_partkey) AS f FROM part GROUP BY p_brand, p_type),
       best AS (SELECT p_brand, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, length(p_name) DESC, p_name DESC) AS r FROM n) WHERE r = 1),
       kind AS (SELECT p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, f) AS r FROM t) WHERE r = 1),
       told AS (SELECT p_brand, p_name AS d, count(*) OVER (PARTITION BY p_brand) AS m, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS r FROM part)
       SELECT b.p_brand AS group_id, b.p_name AS name, k.p_type AS type, told.d AS description, told.m AS n_members,
         (SELECT string_agg(x.p_name, '|' ORDER BY x.p_name) FROM n x WHERE x.p_brand = b.p_brand AND x.p_name <> b.p_name) AS aliases
       FROM best b JOIN kind k USING (p_brand) JOIN told ON told.p_brand = b.p_brand AND told.r = 1""",
)
def a2_entity_merge(spark, sf_dir):
    members = load(spark, sf_dir, "part").select(F.col("p_brand").alias("group_id"), F.lit(None).cast("string").alias("canonical_name"), F.col("p_name").alias("name"), F.col("p_name").alias("description"), F.col("p_type").alias("type"), F.col("p_partkey").alias("position"))
    return merging.merge_entities(members).withColumn("aliases", F.array_join("aliases", "|"))


@query(
    "a4_strongest_parallel",
    f"WITH {_EDGES} SELECT src, dst, relationship, weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, relationship) AS r FROM (SELECT DISTINCT src, dst, relationship, weight FROM e)) WHERE r = 1",
)
def a4_strongest_parallel(spark, sf_dir):
    return merging.strongest_parallel(supply_edges(spark, sf_dir).select("src", "dst", "relationship", "weight"))


@query(
    "a5_importance",
    f"""WITH s AS ({SIMPLE_EDGES_SQL}), o AS (SELECT src, count(*) AS c FROM s GROUP BY src), x AS (SELECT s.*, CAST(c AS DOUBLE) AS c FROM s JOIN o USING (src)),
        r AS (SELECT min(weight) wl, max(weight) wh, min(c) cl, max(c) ch FROM x)
        SELECT src, dst, round(0.8 * (c - cl) / CASE WHEN ch > cl THEN ch - cl ELSE 1 END + 0.2 * (weight - wl) / CASE WHEN wh > wl THEN wh - wl ELSE 1 END, 8) AS composite FROM x, r""",
)
def a5_importance(spark, sf_dir):
    edges = simple_edges(spark, sf_dir)
    out = edges.groupBy("src").agg(F.count("*").cast("double").alias("centrality"))
    return importance.composite_importance(edges.join(out, "src")).select("src", "dst", F.round("composite", 8).alias("composite"))


_NORMALISED = {
    "minmax": "(weight - min(weight) OVER ()) / nullif(max(weight) OVER () - min(weight) OVER (), 0)",
    "softmax": "exp(weight - h) / sum(exp(weight - h)) OVER () * count(*) OVER ()",
    "log": "ln(1 + weight) / max(ln(1 + weight)) OVER ()",
    "none": "weight",
}
for _name, _sql in _NORMALISED.items():

    @query(f"a6_weight_{_name}", f"WITH s AS ({SIMPLE_EDGES_SQL}) SELECT src, dst, round({_sql}, 7) AS normalised FROM s, (SELECT max(weight) AS h FROM s)")
    def a6_weight(spark, sf_dir, strategy=_name):
        return importance.normalised_weights(simple_edges(spark, sf_dir), strategy).select("src", "dst", F.round("normalised", 7).alias("normalised"))


@query(
    "a7_size_stats",
    """WITH s AS (SELECT c_nationkey, count(*) AS z FROM customer GROUP BY c_nationkey)
       SELECT count(*) AS n_communities, min(z) AS min_size, max(z) AS max_size, round_even(avg(z), 2) AS avg_size, round_even(median(z), 2) AS median_size, round_even(stddev_pop(z), 2) AS std_size, count(*) FILTER (z = 1) AS singletons FROM s""",
)
def a7_size_stats(spark, sf_dir):
    return stats.size_statistics(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community")))


@query(
    "a8_level_distribution",
    """SELECT c_nationkey AS level, count(*) AS n, round(avg(c_acctbal), 4) AS avg_rating, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM customer GROUP BY c_nationkey""",
)
def a8_level_distribution(spark, sf_dir):
    rows = stats.level_distribution(load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("level"), F.col("c_acctbal").alias("rating")), "rating")
    return rows.select("level", "n", F.round("avg_rating", 4).alias("avg_rating"), F.round("percent", 6).alias("percent"))


@query(
    "a9_report",
    """WITH s AS (SELECT event_type, CAST(user_id % 4 AS VARCHAR) AS bucket, value FROM events WHERE event_type <> 'error')
       SELECT d AS dimension, v AS value, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(*) AS n FROM
       (SELECT 'overall' AS d, NULL AS v, value FROM s UNION ALL SELECT 'event_type', event_type, value FROM s UNION ALL SELECT 'bucket', bucket, value FROM s) GROUP BY d, v""",
)
def a9_report(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 4).withColumn("score", F.when(F.col("event_type") != "error", F.col("value")))
    return evaluation.score_report(e, ["event_type", "bucket"]).withColumn("avg", F.round("avg", 6))


@query(
    "a10_baseline_report",
    """WITH s AS (SELECT CAST(user_id % 3 AS VARCHAR) AS model, event_type, value FROM events)
       SELECT model, event_type, round(avg(value), 6) AS avg, count(*) AS n FROM s GROUP BY GROUPING SETS ((model, event_type), (model))""",
)
def a10_baseline_report(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("model", (F.col("user_id") % 3).cast("string"))
    return rows.groupingSets([["model", "event_type"], ["model"]], "model", "event_type").agg(F.round(F.avg("value"), 6).alias("avg"), F.count("*").alias("n"))


_SCORES = "s AS (SELECT CASE toxic WHEN 1 THEN 'L2' ELSE 'L1' END AS difficulty, CASE WHEN doc_id % 7 = 0 THEN 'hard.json' ELSE 'q.json' END AS source, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"


@query(
    "a11_levels",
    f"""WITH {_SCORES}, l AS (SELECT CASE WHEN source = 'hard.json' THEN 'hard' ELSE difficulty END AS level, score FROM s), k AS (SELECT * FROM l WHERE level IN ('L1', 'L2', 'L3', 'hard')),
        g AS (SELECT level, avg(score) a, count(score) n, min(score) lo, max(score) hi FROM k GROUP BY level UNION ALL SELECT 'Overall', avg(score), count(score), min(score), max(score) FROM k),
        d AS (SELECT unnest(['L1', 'L2', 'L3', 'hard', 'Overall']) AS level)
        SELECT d.level, round(coalesce(a, 0), 6) AS avg, coalesce(n, 0) AS n, coalesce(lo, 0.0) AS min, coalesce(hi, 0.0) AS max FROM d LEFT JOIN g USING (level)""",
)
def a11_levels(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    scores = rows.select(F.when(F.col("toxic") == 1, "L2").otherwise("L1").alias("difficulty"), F.when(F.col("doc_id") % 7 == 0, "hard.json").otherwise("q.json").alias("source"), F.col("n_chars").cast("double").alias("score"))
    return evaluation.level_analysis(scores, ["L1", "L2", "L3", "hard"]).withColumn("avg", F.round("avg", 6))


@query(
    "a12_rescore_summary",
    "SELECT round(avg(v), 4) AS avg, round(min(v), 4) AS min, round(max(v), 4) AS max, count(*) AS total, count(v) AS valid FROM (SELECT CASE WHEN event_type <> 'error' THEN value END AS v FROM events)",
)
def a12_rescore_summary(spark, sf_dir):
    return evaluation.rescore_summary(load(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("value")).alias("score")))


def _judged(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.col("user_id") % 6).alias("method"), F.col("event_type").alias("dim"), F.col("value").alias("score"))


_JUDGED = "j AS (SELECT 'm' || (user_id % 6) AS method, event_type AS dim, value AS score FROM events)"
_SUMMARY = f"{_JUDGED}, d AS (SELECT method, dim, round(avg(score), 3) AS mean FROM j GROUP BY method, dim), o AS (SELECT method, 'overall' AS dim, round(avg(mean), 3) AS mean FROM d GROUP BY method)"


@query("a13_dimension_summary", f"WITH {_SUMMARY} SELECT * FROM d UNION ALL SELECT * FROM o")
def a13_dimension_summary(spark, sf_dir):
    return evaluation.dimension_summary(_judged(spark, sf_dir))


@query("w8_ranking", f"WITH {_SUMMARY} SELECT method, mean, CAST(row_number() OVER (ORDER BY mean DESC, method) AS INTEGER) AS place FROM o")
def w8_ranking(spark, sf_dir):
    return evaluation.ranking(evaluation.dimension_summary(_judged(spark, sf_dir)))


_DIMS = ("click", "error", "purchase", "signup", "view")


@query(
    "a14_matrix",
    f"""WITH {_JUDGED}, m AS (SELECT method, {", ".join(f"avg(score) FILTER (dim = '{d}') AS c_{d}" for d in _DIMS)} FROM j GROUP BY method)
        SELECT method, {", ".join(f"round(c_{d}, 6) AS c_{d}" for d in _DIMS)}, round(({" + ".join(f"c_{d}" for d in _DIMS)}) / 5, 6) AS overall FROM m""",
)
def a14_matrix(spark, sf_dir):
    rows = evaluation.comparison_matrix(_judged(spark, sf_dir), _DIMS)
    return rows.select("method", *[F.round(d, 6).alias(f"c_{d}") for d in _DIMS], F.round("overall", 6).alias("overall"))


_DEGREE = f"{_EDGES}, g AS (SELECT id, count(*) AS degree, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id)"


@query("a15_degree", f"WITH {_DEGREE} SELECT id, degree, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree FROM g")
def a15_degree(spark, sf_dir):
    return stats.degrees(supply_edges(spark, sf_dir))


@query("a15_degree_distribution", f"WITH {_DEGREE} SELECT degree, count(*) AS n_nodes FROM g GROUP BY degree")
def a15_degree_distribution(spark, sf_dir):
    return stats.degree_distribution(stats.degrees(supply_edges(spark, sf_dir)))


@query("a16_top_types", "SELECT p_type AS type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def a16_top_types(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.col("p_type").alias("type"))
    return stats.top_counts(rows, "type", 10).withColumn("share", F.round("share", 8))


@query("a17_cdf", "SELECT l_quantity, count(*) AS n, round(max(c), 8) AS cdf FROM (SELECT l_quantity, cume_dist() OVER (ORDER BY l_quantity) AS c FROM lineitem) GROUP BY l_quantity")
def a17_cdf(spark, sf_dir):
    return stats.empirical_cdf(load(spark, sf_dir, "lineitem"), "l_quantity").withColumn("cdf", F.round("cdf", 8))


@query(
    "a17_histogram",
    "SELECT CAST(least(49, floor((l_extendedprice - lo) / (hi - lo) * 50)) AS INTEGER) AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem) GROUP BY bin",
)
def a17_histogram(spark, sf_dir):
    return stats.histogram(load(spark, sf_dir, "lineitem"), "l_extendedprice", 50)


_KINDS = "k AS (SELECT 'S' || s_suppkey AS id, 'N' || s_nationkey AS category FROM supplier UNION ALL SELECT 'P' || p_partkey, p_type FROM part)"


def _kinds(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.concat(F.lit("N"), "s_nationkey").alias("category"))
    return s.union(load(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_type").alias("category")))


@query(
    "a18_type_matrix",
    f"""WITH {_EDGES}, {_KINDS} SELECT a.category AS src_category, b.category AS dst_category, count(*) AS n, count(DISTINCT relationship) AS n_kinds, min(weight) AS min_weight, max(weight) AS max_weight, round(avg(weight), 6) AS avg_weight
        FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst GROUP BY ALL""",
)
def a18_type_matrix(spark, sf_dir):
    return stats.pair_matrix(supply_edges(spark, sf_dir), _kinds(spark, sf_dir)).withColumn("avg_weight", F.round("avg_weight", 6))


@query(
    "a22_top_label",
    f"""WITH {_EDGES}, {_KINDS}, c AS (SELECT a.category AS s, b.category AS d, relationship, count(*) AS n FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst GROUP BY ALL),
        t AS (SELECT s, d, relationship AS label FROM (SELECT *, row_number() OVER (PARTITION BY s, d ORDER BY n DESC, relationship) AS r FROM c) WHERE r = 1), n AS (SELECT DISTINCT category AS c FROM k)
        SELECT x.c AS src_category, y.c AS dst_category, coalesce(t.label, u.label, 'RELATED_TO') AS label FROM n x CROSS JOIN n y LEFT JOIN t ON t.s = x.c AND t.d = y.c LEFT JOIN t u ON u.s = y.c AND u.d = x.c""",
)
def a22_top_label(spark, sf_dir):
    return stats.top_label(supply_edges(spark, sf_dir), _kinds(spark, sf_dir))


#: Names of relations that hit groups by themselves, by a part, or not at all.
_RELATIONS = ("is a type of", "Contains", "AUTHORED_BY", "Increases strongly", " reduces ", "correlates with", "USED_IN", "observed_at", "models", "forms", "located near", "FLOWS_TO", "differs from", "interacts", "depends on", "precedes", "no_effect on", "has_phase", "xyz", "", "SIMILAR_TO", "caused by", "affects")


@query(
    "a21_relation_groups",
    f"""WITH n AS (SELECT [{", ".join(repr(x) for x in _RELATIONS)}][p_partkey % {len(_RELATIONS)} + 1] AS raw FROM part), r AS (SELECT raw, count(*) AS c FROM n GROUP BY raw), g AS (SELECT raw, c, {relation_group_sql("raw")} AS normalised FROM r),
        t AS (SELECT *, row_number() OVER (PARTITION BY normalised ORDER BY c DESC, raw) AS k FROM g)
        SELECT normalised, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_raw, round(sum(c) / sum(sum(c)) OVER (), 8) AS share, string_agg(CASE WHEN k <= 5 THEN raw END, ', ' ORDER BY k) AS examples FROM t GROUP BY normalised""",
)
def a21_relation_groups(spark, sf_dir):
    """The distribution over names that fall into most groups."""
    rows = load(spark, sf_dir, "part").select(F.element_at(F.array(*[F.lit(x) for x in _RELATIONS]), (F.col("p_partkey") % len(_RELATIONS) + 1).cast("int")).alias("name"))
    return stats.relation_distribution(rows, "name", relation_group(F.col("raw"))).withColumn("share", F.round("share", 8))


@query(
    "a21_relation_dist",
    f"""WITH r AS (SELECT p_name AS raw, count(*) AS c FROM part GROUP BY p_name), g AS (SELECT raw, c, {relation_group_sql("raw")} AS normalised FROM r),
        t AS (SELECT *, row_number() OVER (PARTITION BY normalised ORDER BY c DESC, raw) AS k FROM g)
        SELECT normalised, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_raw, round(sum(c) / sum(sum(c)) OVER (), 8) AS share, string_agg(CASE WHEN k <= 5 THEN raw END, ', ' ORDER BY k) AS examples FROM t GROUP BY normalised""",
)
def a21_relation_dist(spark, sf_dir):
    return stats.relation_distribution(load(spark, sf_dir, "part"), "p_name", relation_group(F.col("raw"))).withColumn("share", F.round("share", 8))


@query(
    "a23_crosstab",
    "SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS b0, count(*) FILTER (user_id % 3 = 1) AS b1, count(*) FILTER (user_id % 3 = 2) AS b2 FROM events GROUP BY event_type",
)
def a23_crosstab(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("b", F.concat(F.lit("b"), F.col("user_id") % 3))
    return rows.groupBy("event_type").pivot("b", ["b0", "b1", "b2"]).count().fillna(0)


@query(
    "a24_quartiles",
    "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY event_type",
)
def a24_quartiles(spark, sf_dir):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = load(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), q.alias("q"))
    return rows.select("event_type", F.round("mean", 6).alias("mean"), *[F.round(F.get("q", F.lit(k)), 6).alias(f"q{k + 1}") for k in range(3)])


@query(
    "a25_casefold",
    """WITH s AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part), c AS (SELECT trim(name) AS name, count(*) AS c FROM s GROUP BY 1)
       SELECT lower(name) AS folded, CAST(sum(c) AS BIGINT) AS n, (list(name ORDER BY c DESC, name DESC))[1] AS name FROM c GROUP BY lower(name)""",
)
def a25_casefold(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return stats.folded_counts(rows, "name")


@query(
    "a26_last_wins",
    """WITH l AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)
       SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS "view", max(value) FILTER (event_type = 'purchase') AS purchase FROM l GROUP BY user_id""",
)
def a26_last_wins(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("method"), F.col("value").alias("score"), "ts", "event_id")
    last = evaluation.last_scores(rows, ["user_id", "method"], ["ts", "event_id"])
    return evaluation.wide_scores(last, "user_id", ["click", "view", "purchase"])


@query(
    "a27_agreement",
    """WITH o AS (SELECT o_custkey AS c, list_sort(list_distinct(list(o_orderkey))) AS members FROM orders GROUP BY o_custkey), h AS (SELECT members, c % 2 AS d FROM o), m AS (SELECT members, c % 3 AS d FROM o WHERE c % 5 <> 0)
       SELECT count(*) AS n, count(m.d) AS n_matched, count(*) FILTER (h.d = m.d) AS n_agree, round(avg(CAST(h.d = m.d AS INTEGER)), 8) AS rate FROM h LEFT JOIN m USING (members)""",
)
def a27_agreement(spark, sf_dir):
    groups = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.collect_list("o_orderkey").alias("members"))
    human = groups.select("members", (F.col("c") % 2).alias("decision"))
    machine = groups.where("c % 5 <> 0").select(F.reverse("members").alias("members"), (F.col("c") % 3).alias("decision"))
    return evaluation.agreement(human, machine).withColumn("rate", F.round("rate", 8))


@query("u4_pending", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u4_pending(spark, sf_dir):
    return evaluation.pending(load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels"), "doc_id")


@query("j13_scored_answers", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def j13_scored_answers(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(
    "w7_tie_ranks",
    """WITH j AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
       o AS (SELECT *, CASE WHEN n > 1 THEN 1 - p / (n - 1) ELSE 1 END AS own, CASE WHEN p IN (1, 2) THEN 't' ELSE 'm' || turn END AS g FROM j)
       SELECT conv_id, turn, round(avg(own) OVER (PARTITION BY conv_id, g), 8) AS rank_score FROM o""",
)
def w7_tie_ranks(spark, sf_dir):
    from pyspark.sql.window import Window

    by = Window.partitionBy("conv_id")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(by.orderBy("turn")) - 1).alias("position"), F.count("*").over(by).alias("n_methods"))
    rows = rows.select("*", F.col("turn").cast("string").alias("method"), F.when(F.col("position").isin(1, 2), 1).alias("tie_group"))
    return evaluation.tie_ranks(rows, ["conv_id"]).select("conv_id", "turn", F.round("rank_score", 8).alias("rank_score"))


@query(
    "w14_budget",
    """WITH t AS (SELECT conv_id, turn, CAST(floor(length(text) * 0.3) AS INTEGER) AS k FROM conversations WHERE length(text) > 0),
       r AS (SELECT *, sum(k) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM t), o AS (SELECT *, min(CASE WHEN s > 200 THEN turn END) OVER (PARTITION BY conv_id) AS f FROM r)
       SELECT conv_id, turn, k AS tokens, CAST(s AS BIGINT) AS total FROM o WHERE f IS NULL OR turn < f""",
)
def w14_budget(spark, sf_dir):
    rows = context.budgeted_sections(load(spark, sf_dir, "conversations"), 200, ["conv_id"], "turn", "text")
    return rows.select("conv_id", "turn", "tokens", "total")


@query("w16_sample")
def w16_sample(spark, sf_dir):
    return evaluation.deterministic_sample(load(spark, sf_dir, "part").select("p_partkey", "p_name"), 20, "p_partkey", 42)


@query("v9_heavy_graph", f"""WITH {_EDGES}, h AS (SELECT * FROM e WHERE weight >= 40), g AS (SELECT id FROM (SELECT src AS id FROM h UNION ALL SELECT dst FROM h) GROUP BY id HAVING count(*) >= 3)
    SELECT src, dst, weight, position FROM h WHERE src IN (SELECT id FROM g) AND dst IN (SELECT id FROM g)""")
def v9_heavy_graph(spark, sf_dir):
    from ..operators.walks import induced

    heavy = supply_edges(spark, sf_dir).where("weight >= 40")
    return induced(heavy, stats.degrees(heavy).where("degree >= 3")).select("src", "dst", "weight", "position")


@query("v12_text_only", "SELECT 'text' AS unit_type, count(*) AS n FROM documents UNION ALL SELECT 'abstract', count(*) FROM benchmark")
def v12_text_only(spark, sf_dir):
    return units(spark, sf_dir).where(F.col("unit_type").isin("text", "abstract")).groupBy("unit_type").agg(F.count("*").alias("n"))
