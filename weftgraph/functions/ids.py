"""Stable ids of documents, chunks, and graph parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_key(filename: Column) -> Column:
    return F.concat(F.lit("doc-"), F.md5(filename))


def chunk_key(document: Column, position: Column, text: Column) -> Column:
    return F.concat(F.lit("chunk-"), F.md5(F.concat_ws("-", document, position.cast("string"), text)))


def unit_key(document: Column, kind: str, *parts: Column) -> Column:
    """Chunk id of an abstract, table or image unit."""
    return F.concat(F.lit("chunk-"), F.md5(F.concat_ws("-", document, F.lit(kind), *parts)))


def global_key(chunk: Column, local: Column) -> Column:
    return F.concat_ws("-", chunk, local)


def repaired_keys(key: Column) -> list[Column]:
    """An id as given, with underscores as hyphens, and with the last ``-e-`` as ``_e-``."""
    hyphens = F.translate(key, "_", "-")
    return [key, hyphens, F.regexp_replace(hyphens, r"^(.*)-e-", "$1_e-")]


def base_chunk(key: Column) -> Column:
    """The chunk that a citation starts with, null if none."""
    return F.nullif(F.regexp_extract(key, r"^(chunk-[0-9a-fA-F]+)", 1), F.lit(""))


def is_community(key: Column) -> Column:
    return key.rlike(r"^\d+(_\d+)+$")


def chunk_ids(chunk_id: Column, text_unit_ids: Column) -> Column:
    """Chunks of a node: of chunk_id, else of text_unit_ids, each one id or a JSON list of them."""
    listed = lambda c: F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).when(F.trim(c) != "", F.array(c))
    return F.coalesce(listed(chunk_id), listed(text_unit_ids), F.array().cast("array<string>"))
