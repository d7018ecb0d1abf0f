"""Names for word clouds: filters, normal forms, and reviewed groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: names that say nothing about the field
GENERIC = (
    "unknown", "none", "n/a", "", "et al.", "et al", "temperature", "time", "stress", "strain", "results", "figure", "table", "data", "method", "analysis",
    "study", "research", "paper", "work", "effect", "effects", "properties", "property", "process", "structure", "material", "materials", "alloy", "alloys",
    "sample", "samples", "test", "tests", "value", "values", "condition", "conditions", "type", "types", "phase", "system", "model", "experiment", "experiments",
    "microstructure", "composition", "content", "rate", "surface", "size", "strength", "behavior", "response", "region", "area", "volume", "weight", "mass", "ratio",
    "number", "range", "level", "degree", "state", "form", "group", "case", "part", "point", "line", "base", "high", "low", "large", "small", "new", "different",
    "mechanical properties", "high temperature",
)

# fixed values: designations whose digits stay as they are
DESIGNATION = r"(?i)^(GH\d|IN\d|UNS\s|CMSX|Ren[eé]\s|PWA\s|Mar-M|Alloy\s|Inconel\s|Hastelloy\s|Nimonic\s|Udimet\s|Waspaloy|AM1|SRR|TMS|DD\d|DZ\d|IC\d)|^[A-Za-z]+\s+\d+"


def candidate(name: Column) -> Column:
    """Whether a name may be shown: not generic, three letters or more, no leading digit or bracket, a Latin letter in it."""
    return ~F.lower(name).isin(*GENERIC) & (F.length(name) > 2) & ~name.rlike(r"^[\[(\d]") & name.rlike("[A-Za-z]")


def plain_quotes(name: Column) -> Column:
    """Primes and curly quotes as plain ones, lowered digits as digits, no outer blanks."""
    out = F.replace(name, F.lit("″"), F.lit("''"))
    return F.trim(F.translate(out, "′’‘“”₀₁₂₃₄₅₆₇₈₉", "'''\"\"0123456789"))


def formula(name: Column) -> Column:
    """Digits after element symbols lowered, unless the name is a designation."""
    digits, lowered = "0123456789", "₀₁₂₃₄₅₆₇₈₉"
    gaps = F.split(name, r"(?<=[A-Z])(?=\d)|(?<=[A-Z][a-z])(?=\d)", -1)
    parts = F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.translate(F.regexp_extract(g, r"^(\d+)", 1), digits, lowered), F.regexp_replace(g, r"^\d+", ""))))
    return F.when(name.rlike(DESIGNATION), name).otherwise(F.array_join(parts, ""))


def apply_groups(words: DataFrame, groups: DataFrame, kept: DataFrame, deleted: DataFrame) -> DataFrame:
    """word, count, keep: reviewed words, counts desc.

    words: word, count. groups: representative, members, total_count; a group
    counts its members, or its total if none is known. kept and deleted: word.
    A word kept as it is yields to a representative of the same name, and a
    deletion wins over both.
    """
    member = groups.select("representative", "total_count", F.explode_outer("members").alias("word")).join(words, "word", "left")
    one = member.groupBy(F.col("representative").alias("word")).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("s"), F.max("total_count").alias("t"))
    one = one.select("word", F.when(F.col("s") > 0, F.col("s")).otherwise(F.coalesce("t", F.lit(0))).alias("count"), F.lit("Y").alias("keep"), F.lit(1).alias("rank"))
    plain = lambda d, flag, rank: d.select("word").join(words, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("count"), F.lit(flag).alias("keep"), F.lit(rank).alias("rank"))
    every = one.union(plain(kept, "Y", 0)).union(plain(deleted, "N", 2))
    return every.groupBy("word").agg(F.max_by(F.struct("count", "keep"), "rank").alias("x")).select("word", "x.count", "x.keep").orderBy(F.desc("count"), "word")
