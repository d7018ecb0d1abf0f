"""Sinks: units, graphs, requests, and tables for other tools."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_units(units: DataFrame, path: str, kind: str = "jsonl") -> None:
    """Text units as jsonl (the default for unknown kinds), json or parquet."""
    writer = units.write.mode("overwrite")
    if kind == "parquet":
        writer.parquet(path)
    else:
        writer.json(path)


def batch_requests(rows: DataFrame, custom_id: Column, url: str, body: Column, batch_size: int | None = None) -> DataFrame:
    """Add request: one line of a batch file; with batch_size, write_requests() makes the files."""
    return rows.withColumn("request", F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))))


def write_requests(numbered: DataFrame, path: str) -> None:
    """Requests of numbered batches (see chunking.batch_numbers), a folder for each batch."""
    numbered.select("batch", F.col("request").alias("value")).write.mode("overwrite").partitionBy("batch").text(path)


def node_link(nodes: DataFrame, edges: DataFrame) -> str:
    """One JSON document of a small graph, for tools that read such files."""
    n = [json.loads(r[0]) for r in nodes.select(F.to_json(F.struct("*"))).toLocalIterator()]
    e = [json.loads(r[0]) for r in edges.select(F.to_json(F.struct(*[F.col(c).alias({"src": "source", "dst": "target"}.get(c, c)) for c in edges.columns]))).toLocalIterator()]
    return json.dumps({"directed": True, "multigraph": False, "nodes": n, "links": e}, ensure_ascii=False)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables, which is how large ones are kept."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_reports(reports: DataFrame, path: str) -> None:
    """Community reports by level, ordered inside (a missing level counts as 999)."""
    rows = reports.withColumn("level", F.coalesce("level", F.lit(999)))
    rows.repartition("level").sortWithinPartitions("level", "community_id").write.mode("overwrite").partitionBy("level").json(path)


def hierarchy_rows(communities: DataFrame) -> DataFrame:
    """Communities with their size, lists as JSON texts, for a CSV file."""
    return communities.withColumn("node_count", F.size("node_ids")).withColumns({c: F.to_json(c) for c in ("node_ids", "children_ids")})


def vector_rows(rows: DataFrame, payloads: list[str]) -> DataFrame:
    """Vector table: level, rating and node_count as numbers (0 if unusable), payloads as JSON."""
    whole = {c: F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(0)) for c in ("level", "node_count") if c in rows.columns}
    rating = {"rating": F.coalesce(F.col("rating").cast("string").try_cast("double"), F.lit(0.0))} if "rating" in rows.columns else {}
    out = rows.withColumns(whole | rating) if whole or rating else rows
    return out.withColumns({f"payload_{p}_json": F.to_json(p) for p in payloads}).drop(*payloads)


def property_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes for a property-graph import: label (default Thing) and flat properties.

    Attributes are flattened; the node's own fields win over them.
    """
    own = [c for c in nodes.columns if c not in ("type", "attributes")]
    mine = F.map_filter(F.create_map(*[x for c in own for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
    other = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(mine), k))
    return nodes.select(F.coalesce(F.nullif("type", F.lit("")), F.lit("Thing")).alias("label"), F.map_concat(other, mine).alias("properties"))


def property_edges(edges: DataFrame) -> DataFrame:
    own = [c for c in edges.columns if c not in ("src", "dst", "relationship")]
    values = F.map_filter(F.create_map(*[x for c in own for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if own else F.create_map().cast("map<string,string>")
    return edges.select("src", "dst", F.coalesce(F.nullif("relationship", F.lit("")), F.lit("RELATED_TO")).alias("type"), values.alias("properties"))


def plain_value(value: Any) -> Any:
    """A value that a GEXF file can hold: null as empty, NaN and infinities as 0, nests as JSON."""
    if value is None:
        return ""
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return 0.0
    return value if isinstance(value, (str, int, float, bool)) else json.dumps(value, ensure_ascii=False)


def gexf(nodes: DataFrame, edges: DataFrame) -> str:
    """A small graph as GEXF text; map columns become one attribute per key."""
    from xml.sax.saxutils import escape, quoteattr

    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>']
    for row in nodes.toLocalIterator():
        flat: dict[str, Any] = {}
        for k, v in row.asDict(recursive=True).items():
            flat |= {f"{k}_{i}": plain_value(x) for i, x in v.items()} if isinstance(v, dict) else {k: plain_value(v)}
        values = "".join(f"<attvalue for={quoteattr(str(k))} value={quoteattr(str(v))}/>" for k, v in flat.items())
        out.append(f"<node id={quoteattr(str(row['id']))} label={quoteattr(escape(str(flat.get('name', row['id']))))}><attvalues>{values}</attvalues></node>")
    out.append("</nodes><edges>")
    for k, row in enumerate(edges.toLocalIterator()):
        out.append(f'<edge id="{k}" source={quoteattr(str(row["src"]))} target={quoteattr(str(row["dst"]))}/>')
    return "\n".join([*out, "</edges></graph></gexf>"])


def append_lines(rows: DataFrame, path: str) -> None:
    """Answers or checkpoints as JSON lines, added to what is there."""
    rows.write.mode("append").json(path)


def sheets(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per sheet of a workbook; arrays and structs as JSON."""
    for name, table in tables.items():
        flat = table.withColumns({f.name: F.to_json(f.name) for f in table.schema if f.dataType.typeName() in ("array", "struct", "map")}) if table.columns else table
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
