"""Cleaning of texts and tolerant reading of JSON."""

from __future__ import annotations

import ast
import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: lower and raised digits as plain ones
LOWERED, RAISED = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹"


def embedding_text(text: Column, names: Column | None = None) -> Column:
    """Drop [Data: …] marks and local ids, put names for ids, collapse white space.

    names: map from local id to name; the longest ids are replaced first.
    """
    out = F.regexp_replace(F.regexp_replace(text, r"\[Data:[^\]]*\]", ""), r"\s*\([ER]\d+\)", "")
    if names is not None:
        keys = F.array_sort(F.map_keys(names), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
        out = F.aggregate(keys, out, lambda t, k: F.regexp_replace(t, F.concat(F.lit(r"\b"), k, F.lit(r"\b")), F.regexp_replace(names[k], r"([\\$])", r"\\$1")))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def plain_digits(text: Column) -> Column:
    return F.translate(text, LOWERED + RAISED, "0123456789" * 2)


def without_tags(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags out, spaces collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def filled(template: str, **values: Column) -> Column:
    """A template with $name and {name} replaced."""
    out = F.lit(template)
    for name, value in sorted(values.items(), key=lambda x: -len(x[0])):
        for mark in (f"${name}", f"{{{name}}}"):
            out = F.replace(out, F.lit(mark), F.coalesce(value.cast("string"), F.lit("")))
    return out


def json_candidates(text: Column) -> list[Column]:
    """The text as given, out of its code fence, its outer object, and without trailing commas."""
    fenced = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), text)
    outer = F.coalesce(F.nullif(F.regexp_extract(fenced, r"(?s)(\{.*\})", 1), F.lit("")), fenced)
    return [text, fenced, outer, F.regexp_replace(outer, r",(\s*[}\]])", "$1")]


def tolerant_variant(text: Column) -> Column:
    """The first candidate that is JSON, as a variant; null if none is."""
    return F.coalesce(*[F.try_parse_json(c) for c in json_candidates(text)])


def tolerant_json(text: str | None) -> Any:
    """Driver-side reading with two more attempts: bare keys quoted, and Python literals."""
    if not text:
        return None
    if fence := re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL):
        text = fence[1]
    start, end = text.find("{"), text.rfind("}")
    body = text[start : end + 1] if 0 <= start < end else text
    tidy = re.sub(r",(\s*[}\]])", r"\1", body)
    for attempt in (body, tidy, re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', tidy), tidy.replace("'", '"')):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    try:
        return ast.literal_eval(tidy)
    except (ValueError, SyntaxError):
        return None


def batch_content(response: Column) -> Column:
    """Text of a batch answer with status 200, null otherwise."""
    v = F.try_parse_json(response)
    ok = F.try_variant_get(v, "$.response.status_code", "int") == 200
    return F.when(ok, F.try_variant_get(v, "$.response.body.choices[0].message.content", "string"))
