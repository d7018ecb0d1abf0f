"""Validation and repair of extracted entities and relationships.

Records come from language models, so keys are open: an entity is a map from
key to text (attributes: a JSON object or null). Rules are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: type by words in the name, first match wins
TYPE_WORDS = {
    "Material": ("alloy", "superalloy", "material", "steel", "metal"),
    "Property": ("temperature", "stress", "strength", "hardness", "toughness", "property"),
    "Phase": ("phase", "γ", "gamma", "precipitate", "carbide"),
    "Process": ("process", "treatment", "machining", "forging", "heat"),
    "Defect": ("crack", "defect", "void", "porosity"),
    "Method": ("test", "measurement", "analysis", "characterization"),
}
STANDARD = ("id", "name", "type", "description", "attributes")


def missing(value: Column) -> Column:
    """Null, empty, or the text NaN."""
    return value.isNull() | value.isin("", "NaN")


def _given(value: Column) -> Column:
    return F.when(~missing(value), value)


def inferred_type(name: Column) -> Column:
    lower = F.lower(name)
    out = F.lit("Entity")
    for kind, words in reversed(TYPE_WORDS.items()):
        out = F.when(lower.rlike("|".join(words)), kind).otherwise(out)
    return out


def repair_entities(records: DataFrame, fields: str = "fields") -> DataFrame:
    """Add id, name, type, description, attributes and error_types to rows with a map of fields.

    fields keeps the order of the source's keys. attributes is a map of texts:
    what ``attributes`` holds as a JSON object, plus unknown keys under _raw_.
    """
    f = F.col(fields)
    keys = F.map_keys(f)
    rows = records.withColumn("__keys", keys)
    id_key = F.filter("__keys", lambda k: k.startswith("e-") & f[k].isNotNull())
    given_id = F.array_contains("__keys", "id")
    rows = rows.withColumn("id", F.when(given_id, f["id"]).when(F.size(id_key) > 0, F.get(id_key, F.lit(0))).otherwise(F.lit("e-unknown")))
    id_error = F.when(given_id, F.lit(None)).when(F.size(id_key) > 0, "missing_id_field").otherwise("missing_id_completely")

    # keys like "nameAlloy 706: " or "nameAlloy" carry the name themselves
    broken = F.filter("__keys", lambda k: k.startswith("name") & (k != "name") & ((F.regexp_extract(k, r"^name\s*(.+?)\s*:\s*$", 1) != "") | (F.trim(F.substring(k, 5, 1 << 20)) != "")))
    rows = rows.withColumn("__broken", F.when(missing(f["name"]), F.get(broken, F.lit(0))))
    with_colon = F.trim(F.regexp_extract("__broken", r"^name\s*(.+?)\s*:\s*$", 1))
    from_key = F.when(F.col("__broken").isNotNull(), F.coalesce(F.nullif(with_colon, F.lit("")), F.trim(F.substring("__broken", 5, 1 << 20))))
    under_id = _given(f[F.col("id")])
    default = F.when(F.col("id") != "e-unknown", F.concat(F.lit("Entity_"), "id")).otherwise(F.lit("Unknown Entity"))
    name_error = (
        F.when(~missing(f["name"]), F.lit(None))
        .when(F.col("__broken").isNotNull(), F.when(with_colon != "", "name_merged_with_description").otherwise("name_without_separator"))
        .when(under_id.isNotNull(), "name_in_id_field")
        .otherwise("name_default_fallback")
    )
    rows = rows.withColumn("name", F.coalesce(_given(f["name"]), from_key, under_id, default)).withColumn("__name_error", name_error)
    rows = rows.withColumn("type", F.coalesce(_given(f["type"]), inferred_type(F.col("name"))))
    told = F.when(F.col("__broken").isNotNull(), _given(f[F.col("__broken")]))
    described = F.coalesce(told, _given(f["description"]))
    rows = rows.withColumn("description", F.coalesce(described, F.concat("type", F.lit(" entity: "), "name")))
    odd = F.filter("__keys", lambda k: ~k.isin(*STANDARD) & (k != F.col("id")))
    raw = F.map_from_entries(F.transform(F.filter(odd, lambda k: ~missing(f[k])), lambda k: F.struct(F.concat(F.lit("_raw_"), k), f[k])))
    parsed = F.coalesce(F.from_json(f["attributes"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("attributes", F.map_concat(F.map_filter(parsed, lambda k, _: ~F.array_contains(F.map_keys(raw), k)), raw))
    errors = F.concat(
        F.array(
            id_error,
            F.col("__name_error"),
            F.when(missing(f["type"]), "type_inferred"),
            F.when(described.isNull(), "description_generated"),
            F.when(~F.array_contains("__keys", "attributes"), "attributes_missing"),
        ),
        F.transform(odd, lambda k: F.concat(F.lit("non_standard_field_"), k)),
    )
    return rows.withColumn("error_types", F.filter(errors, lambda e: e.isNotNull())).drop("__keys", "__broken", "__name_error")


def repair_relationships(records: DataFrame, fields: str = "fields") -> DataFrame:
    """Add id, source, target, relationship, description, weight, source_sentence."""
    f = F.col(fields)
    default = {"id": "r-unknown", "description": "Relationship", "source": "unknown", "target": "unknown", "relationship": "unknown"}
    given = lambda v: F.when(v != "NaN", v)
    rows = records
    for field, value in default.items():
        rows = rows.withColumn(field, F.coalesce(given(f[field]), F.lit(value)))
    weight = F.when(F.array_contains(F.map_keys(f), "weight"), F.coalesce(f["weight"].try_cast("double"), F.lit(1.0)))
    return rows.withColumn("weight", weight).withColumn("source_sentence", f["source_sentence"])


def error_counts(repaired: DataFrame) -> DataFrame:
    """How often each kind of error was repaired."""
    return repaired.select(F.explode("error_types").alias("error_type")).groupBy("error_type").agg(F.count("*").alias("n"))


def clean_fields(fields: Column, own_id: Column, longest: int | None = None, allowed: tuple[str, ...] = ()) -> Column:
    """Drop null and NaN values, keys like name…:, the key that equals the id, and overlong keys."""

    def keep(k: Column, v: Column) -> Column:
        out = ~(v.isNull() | (v == "NaN")) & ~k.rlike(r"^name.*:") & ~k.eqNullSafe(own_id)
        return out & ((F.length(k) <= longest) | k.isin(*allowed)) if longest else out

    return F.map_filter(fields, keep)


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order, without sorting groups."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def load_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of records (id, position, entities, relationships).

    entities and relationships are arrays of maps. Global ids are chunk-local;
    an edge stays only if both ends are entities of its own record; of equal
    ids the first by position stays.
    """
    good = records.where(F.col("id").isNotNull())
    entities = good.select(F.col("id").alias("chunk_id"), "position", F.posexplode("entities").alias("at", "e")).where(F.col("e")["id"].isNotNull())
    nodes = entities.select(F.concat_ws("-", "chunk_id", F.col("e")["id"]).alias("id"), F.col("e")["id"].alias("original_id"), "chunk_id", F.col("e")["name"].alias("name"), F.col("e")["type"].alias("type"), F.col("e")["description"].alias("description"), "position", "at")
    nodes = first_by_key(nodes, ["id"], ["position", "at"])
    r = F.col("r")
    rels = good.select(F.col("id").alias("chunk_id"), "position", F.posexplode("relationships").alias("at", "r"))
    rels = rels.select("chunk_id", "position", "at", r["id"].alias("original_id"), F.concat_ws("-", "chunk_id", r["source"]).alias("src"), F.concat_ws("-", "chunk_id", r["target"]).alias("dst"), r["relationship"].alias("relationship"), r["description"].alias("description"), r["weight"].try_cast("double").alias("weight"))
    ids = nodes.select("id")
    edges = rels.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    edges = edges.withColumn("id", F.concat_ws("-", "chunk_id", "original_id"))
    return nodes.drop("position", "at"), first_by_key(edges, ["id"], ["position", "at"]).drop("position", "at")


def to_embed(nodes: DataFrame, resolved_only: bool = True) -> DataFrame:
    """id and text of the nodes to embed: those resolved, or without a merge all with a text."""
    text = F.trim(F.concat_ws(": ", "name", "description"))
    rows = nodes.withColumn("text", text)
    kept = F.coalesce(F.col("is_disambiguated"), F.lit(False)) if resolved_only else F.col("text") != ""
    return rows.where(kept).select("id", "text")
