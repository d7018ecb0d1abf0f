"""Whole questions and builds: routing, local, global, drift, reasoning, and the graph build."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tolerant_json
from ..operators import communities, context, importance, merging, repair, stats, vector, walks
from .providers import Provider, ProviderFactory, complete_column, embed_column, extracted

#: Words that show what a question is after, tried in this order.
INTENTS = {
    "REASONING": r"\b(why|how does|mechanism|because|path|cause)\b",
    "GLOBAL": r"\b(overall|overview|summari[sz]e|main|themes?|trends?|in general|all)\b",
    "DRIFT": r"\b(compare|difference|versus|vs|relate)\b",
}


def route(question: str, has_graph_model: bool = True) -> tuple[str, int]:
    """(intent, community level) of a question; LOCAL when nothing else fits, DRIFT for reasoning without a graph."""
    if not question.strip():
        raise ValueError("the question is empty")
    lower = question.lower()
    intent = next((i for i, pattern in INTENTS.items() if re.search(pattern, lower)), "LOCAL")
    if intent == "REASONING" and not has_graph_model:
        intent = "DRIFT"
    level = 0 if re.search(r"\b(overview|overall)\b", lower) else 2 if re.search(r"\b(detail|specific)", lower) else 1
    return intent, level


class Graph(NamedTuple):
    """The tables that questions are asked of."""

    nodes: DataFrame  # id, name, type, description, chunk_id, community
    edges: DataFrame  # src, dst, relationship, description, weight
    vectors: DataFrame  # id, vector
    texts: DataFrame  # chunk_id, text
    reports: DataFrame  # community, level, rating, text, vector


def ask_local(graph: Graph, question: str, provider: Provider, k: int = 20, hops: int = 1) -> tuple[str, DataFrame]:
    """Nearest nodes, their neighbourhood, budgeted sections, and an answer."""
    seeds = vector.top_k(graph.vectors, provider.embed([question])[0], k).select("id")
    near = walks.neighbourhood(graph.edges, seeds, hops)
    sections = context.local_context(graph.nodes, graph.edges, graph.texts, graph.reports.select("community", "text"), near)
    text = "\n\n".join(r.text for r in sections.orderBy("position").collect())
    return provider.complete([f"TASK answer\n{question}\n{text}"])[0], sections


def ask_global(graph: Graph, question: str, factory: ProviderFactory, level: int | None = None, least_rating: float | None = None, k: int = 10) -> tuple[str, DataFrame]:
    """Nearest reports under the filters, a scored point from each, and an answer from the best."""
    provider = factory()
    found = vector.top_k(graph.reports, provider.embed([question])[0], k, key="community", where=vector.level_filter(level=level, rating=least_rating))
    asked = found.select(F.col("community").cast("string").alias("id"), F.concat(F.lit(f"TASK map\n{question}\n"), "text").alias("prompt"))
    told = complete_column(asked, "prompt", "told", factory)
    points = context.reduced_points(told.select("id", F.get_json_object("told", "$.answer").alias("answer"), F.get_json_object("told", "$.score").try_cast("double").alias("score")))
    best = "\n".join(r.answer for r in points.collect())
    return provider.complete([f"TASK answer\n{question}\n{best}"])[0], points


def ask_drift(graph: Graph, question: str, provider: Provider, steps: int = 2, most_tokens: int = 2000, k: int = 10) -> tuple[str, list[str]]:
    """A local answer, then follow-up questions that are searched in turn under a growing text's budget."""
    answer, sections = ask_local(graph, question, provider, k)
    parts = ["\n\n".join(r.text for r in sections.orderBy("position").collect())]
    for _ in range(steps):
        more = provider.complete([f"TASK follow\n{answer}"])[0]
        if not more.strip():
            break
        answer, sections = ask_local(graph, more, provider, k)
        parts.append("\n\n".join(r.text for r in sections.orderBy("position").collect()))
    kept = context.progressive_context(parts, most_tokens)
    return provider.complete([f"TASK answer\n{question}\n" + "\n\n".join(kept)])[0], kept


def ask_reasoning(graph: Graph, question: str, keywords: list[str], provider: Provider, k: int = 10, top_paths: int = 10, most_nodes: int = 4, least: float = 0.0) -> tuple[str, DataFrame]:
    """Fused query, best nodes, personalised PageRank ends, scored paths between them, and an answer."""
    fused = vector.fused_query(provider.embed([question])[0], provider.embed(keywords) if keywords else [], "ppr")
    scored = vector.scored(graph.vectors, fused).select("id", F.col("similarity").alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    mass = walks.personalised_pagerank(graph.edges, graph.nodes.select("id").join(scored, "id", "left"))
    ends = mass.orderBy(F.desc("mass"), "id").limit(k).select("id")
    from pyspark.sql.window import Window

    starts = best.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("position")).where("position <= 5")
    simple = merging.strongest_parallel(graph.edges.select("src", "dst", "relationship", "description", "weight"))
    weighted = importance.composite_importance(simple.withColumn("centrality", F.lit(0.0)))
    paths = walks.bounded_paths(simple, starts, ends, most_nodes, 200)
    ranked = walks.ranked_paths(walks.path_scores(paths, weighted, walks.edge_score()), top_paths, least)
    explained = walks.explained(ranked, simple, graph.nodes)
    text = "\n".join(r.explanation for r in explained.orderBy(F.desc("score"), "explanation").limit(5).collect())
    return provider.complete([f"TASK answer\n{question}\n{text}"])[0], explained


def ask_basic(units: DataFrame, question: str, provider: Provider, k: int = 5) -> tuple[str, DataFrame]:
    """Nearest text units and an answer."""
    found = vector.top_k(units, provider.embed([question])[0], k)
    text = "\n\n".join(r.text for r in found.collect())
    return provider.complete([f"TASK answer\n{question}\n{text}"])[0], found


def merge_groups(clusters: DataFrame, nodes: DataFrame, factory: ProviderFactory) -> DataFrame:
    """alias, canonical: the provider's groups inside candidate clusters (id, cluster).

    A cluster is one prompt; clusters are bounded by the search that made them.
    """
    named = clusters.join(nodes.select("id", "name"), "id")
    line = F.concat_ws("\t", "id", "name")
    asked = named.groupBy("cluster").agg(F.concat(F.lit("TASK merge\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("prompt"))
    told = complete_column(asked.withColumn("cluster", F.col("cluster").cast("string")), "prompt", "told", factory)
    groups = told.select("cluster", F.posexplode(F.from_json(F.get_json_object("told", "$.groups"), "array<struct<canonical_name:string,member_ids:array<string>>>")).alias("at", "g"))
    members = groups.select(F.concat_ws("#", "cluster", "at").alias("group_id"), F.col("g.canonical_name").alias("canonical_name"), F.explode("g.member_ids").alias("id")).join(nodes.select("id", "name"), "id")
    return members


def build_graph(units: DataFrame, factory: ProviderFactory, least: float = 0.9, k: int = 10) -> dict[str, DataFrame]:
    """Units to a merged graph with communities: extract, repair, load, resolve, detect."""
    records = extracted(units, factory)
    nodes, edges = repair.load_graph(records)
    vectors = embed_column(nodes.select("id", F.concat_ws(" ", "name", "description").alias("text")), "text", "vector", factory).where("vector is not null")
    numbered = vectors.withColumn("key", F.xxhash64("id"))
    clusters = vector.candidate_clusters(numbered, k, least, key="key").withColumnRenamed("id", "key").join(numbered.select("key", "id"), "key").select("id", "cluster")
    members = merge_groups(clusters, nodes, factory)
    kept = merging.representatives(members, stats.degrees(edges))
    aliases = members.join(kept.withColumnRenamed("id", "canonical"), "group_id").select(F.col("id").alias("alias"), "canonical")
    edges = merging.merge_edges(merging.rewrite_ends(edges.withColumn("position", F.xxhash64("id")), aliases))
    nodes = nodes.join(aliases.where("alias <> canonical").select(F.col("alias").alias("id")), "id", "left_anti")
    labels = communities.label_propagation(edges, nodes.select("id"))
    return {"nodes": communities.labelled(nodes, edges, labels), "edges": edges, "aliases": aliases, "labels": labels}


def report_row(community: str, told: str, level: int = 1) -> dict[str, object]:
    """A community report from a model's text; the raw text stays if it is no JSON."""
    report = tolerant_json(told)
    return {"community_id": community, "level": level, "report": report} if isinstance(report, Mapping) else {"community_id": community, "level": level, "report_raw": told}
