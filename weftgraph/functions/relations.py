"""Names of relation types brought to a small vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: exact names and the groups they go to
EXACT = {
    "HAS_NO_EFFECT_ON": "NO_EFFECT_OR_EXCLUDES",
    "DOES_NOT_AFFECT": "NO_EFFECT_OR_EXCLUDES",
    "EXCLUDES": "NO_EFFECT_OR_EXCLUDES",
    "LACKS": "NO_EFFECT_OR_EXCLUDES",
    "OUTPERFORMS": "COMPARES_WITH",
    "IMPROVES_UPON": "COMPARES_WITH",
    "VARIES_WITH": "CORRELATES_WITH",
    "PARAMETER_OF": "HAS_OR_EXHIBITS",
    "COMPONENT_OF": "CONTAINS_OR_PART_OF",
    "MADE_OF": "CONTAINS_OR_PART_OF",
    "COMPRISES": "CONTAINS_OR_PART_OF",
    "USED_AS": "USES_OR_APPLIES_TO",
    "APPLIED_IN": "USES_OR_APPLIES_TO",
    "EMPLOYS": "USES_OR_APPLIES_TO",
    "EXAMINES": "OBSERVES_OR_MEASURES",
    "DEMONSTRATES": "OBSERVES_OR_MEASURES",
    "REPORTS": "OBSERVES_OR_MEASURES",
    "VERIFIES": "OBSERVES_OR_MEASURES",
    "CAPTURES": "OBSERVES_OR_MEASURES",
    "MODELED_BY": "MODELS_OR_PREDICTS",
    "COMPUTES": "MODELS_OR_PREDICTS",
    "ESTIMATES": "MODELS_OR_PREDICTS",
    "MANUFACTURED_BY": "PROCESSED_OR_SUBJECTED_TO",
    "TREATED_WITH": "PROCESSED_OR_SUBJECTED_TO",
    "COATED_WITH": "PROCESSED_OR_SUBJECTED_TO",
    "DOPES": "PROCESSED_OR_SUBJECTED_TO",
    "CAUSES_FORMATION_OF": "CAUSES_OR_CONTRIBUTES_TO",
    "STRENGTHENED_BY": "PROMOTES_OR_INCREASES",
    "WEAKENS": "REDUCES_OR_INHIBITS",
    "DEPOSITED_ON": "LOCATED_OR_OCCURS_IN",
    "OCCURS_DURING": "TEMPORAL_ORDER",
    "DEVELOPED": "PRODUCES_OR_TRANSFORMS_TO",
    "DEVELOPS": "PRODUCES_OR_TRANSFORMS_TO",
    "PRECIPITATES": "PRODUCES_OR_TRANSFORMS_TO",
    "EVOLVES_INTO": "PRODUCES_OR_TRANSFORMS_TO",
    "DRIVES": "CAUSES_OR_CONTRIBUTES_TO",
    "PROVIDES": "PROMOTES_OR_INCREASES",
    "ACHIEVES": "PRODUCES_OR_TRANSFORMS_TO",
    "ATTRIBUTED_TO": "CAUSES_OR_CONTRIBUTES_TO",
    "INFORMS": "DESCRIBES_OR_DEFINES",
    "PROCESSES": "PROCESSED_OR_SUBJECTED_TO",
    "FABRICATES": "PROCESSED_OR_SUBJECTED_TO",
    "INCORPORATES": "CONTAINS_OR_PART_OF",
    "INVOLVES": "CONTAINS_OR_PART_OF",
    "DERIVED_FROM": "PROCESSED_OR_SUBJECTED_TO",
    "ORIGINATES_FROM": "PROCESSED_OR_SUBJECTED_TO",
    "DISSOLVES": "PRODUCES_OR_TRANSFORMS_TO",
    "ACTIVATES": "PROMOTES_OR_INCREASES",
    "EXTENDS": "CONNECTS_OR_FLOWS_TO",
    "JOINS": "CONNECTS_OR_FLOWS_TO",
    "INTERFACES_WITH": "CONNECTS_OR_FLOWS_TO",
    "RESISTS": "REDUCES_OR_INHIBITS",
    "CONSTRAINS": "DEPENDS_ON_OR_REQUIRES",
    "GOVERNED_BY": "DEPENDS_ON_OR_REQUIRES",
    "AGREES_WITH": "COMPARES_WITH",
    "CONSISTENT_WITH": "COMPARES_WITH",
    "SIMILAR_TO": "COMPARES_WITH",
    "RESEMBLES": "COMPARES_WITH",
    "ALIGNS_WITH": "COMPARES_WITH",
    "ALIGNED_WITH": "COMPARES_WITH",
    "HAS_COUNTERPART": "COMPARES_WITH",
    "IS_A_TYPE_OF": "IS_A",
    "CLASSIFIED_AS": "IS_A",
    "AFFILIATED_WITH": "PUBLICATION_METADATA",
    "EXCEEDS": "COMPARES_WITH",
    "PROTECTS": "PROMOTES_OR_INCREASES",
    "PRESERVES": "PROMOTES_OR_INCREASES",
    "PARTICIPATES_IN": "PROCESSED_OR_SUBJECTED_TO",
    "EQUIPPED_WITH": "CONTAINS_OR_PART_OF",
    "DEPOSITS": "PRODUCES_OR_TRANSFORMS_TO",
    "GROUPED_WITH": "COMPARES_WITH",
    "DOMINATES": "AFFECTS_OR_INFLUENCES",
    "EXEMPLIFIES": "DESCRIBES_OR_DEFINES",
    "HAS_STRUCTURE": "HAS_OR_EXHIBITS",
    "FEATURES": "HAS_OR_EXHIBITS",
    "SUBJECT_TO": "PROCESSED_OR_SUBJECTED_TO",
    "GUIDES": "DESCRIBES_OR_DEFINES",
    "SUITABLE_FOR": "USES_OR_APPLIES_TO",
}

# fixed values: parts of names, tried group by group in this order
PARTS = {
    "PUBLICATION_METADATA": ("AUTHOR", "PUBLISH", "FUND", "AFFILIAT", "ACKNOWLEDG", "REFERENCE"),
    "IS_A": ("IS_A", "IS_TYPE", "INSTANCE", "CLASSIFIED_AS", "VARIANT_OF"),
    "CONTAINS_OR_PART_OF": ("CONTAIN", "INCLUDE", "CONSIST", "COMPOSE", "COMPRIS", "PART", "COMPONENT", "ELEMENT", "BELONG", "INCORPORAT", "INVOLVE", "EQUIPPED"),
    "HAS_OR_EXHIBITS": ("HAS_", "HAS", "EXHIBIT", "DISPLAY", "MANIFEST", "FEATURE"),
    "AFFECTS_OR_INFLUENCES": ("AFFECT", "INFLUENC", "IMPACT", "MODULAT", "ALTER", "MODIF", "DETERMINE", "CONTROL", "GOVERN", "DOMINAT"),
    "CAUSES_OR_CONTRIBUTES_TO": ("CAUSE", "INDUC", "TRIGGER", "LEAD", "RESULT", "CONTRIBUT", "DRIVE", "ATTRIBUTED"),
    "PROMOTES_OR_INCREASES": ("INCREASE", "ENHANC", "IMPROV", "PROMOT", "ENABLE", "FACILIT", "STRENGTHEN", "ACCELERAT", "STABILIZ", "SUPPORT", "ACTIVAT", "PROVID", "PROTECT", "PRESERV"),
    "REDUCES_OR_INHIBITS": ("REDUC", "DECREAS", "SUPPRESS", "INHIBIT", "HINDER", "LIMIT", "PREVENT", "ELIMINAT", "DEGRAD", "MITIGAT", "WEAKEN", "MINIMIZ", "RESIST", "INTERFERE"),
    "CORRELATES_WITH": ("CORRELAT", "ASSOCIAT", "RELAT", "CORRESPOND", "MATCH", "VARY", "EQUAL"),
    "USES_OR_APPLIES_TO": ("USES", "USED", "UTILIZ", "APPLI", "EMPLOY", "SUITABLE_FOR"),
    "OBSERVES_OR_MEASURES": ("OBSERV", "ANALYZ", "MEASUR", "CHARACTERIZ", "DETECT", "IDENTIF", "REVEAL", "SHOW", "INDICAT", "CONFIRM", "EVALUAT", "TEST", "STUDI", "INVESTIGAT", "EXAMIN", "DEMONSTRAT", "VERIFY", "CAPTUR", "REPORT"),
    "DESCRIBES_OR_DEFINES": ("DESCRIB", "DEFIN", "REPRESENT", "EXPLAIN", "ILLUSTRAT", "EXEMPLIF", "INFORM", "GUIDE"),
    "MODELS_OR_PREDICTS": ("MODEL", "PREDICT", "SIMULAT", "CALCULAT", "QUANTIF", "VALIDAT", "ESTIMAT", "COMPUT"),
    "PRODUCES_OR_TRANSFORMS_TO": ("PRODUC", "GENERAT", "FORM", "TRANSFORM", "TRANSITION", "YIELD", "CREATE", "PRECIPITAT", "DEVELOP", "DISSOLV", "DEPOSIT", "EVOLVE", "INTRODUC", "REPLACE", "SEPARAT"),
    "PROCESSED_OR_SUBJECTED_TO": ("PROCESS", "PREPAR", "FABRICAT", "MANUFACTUR", "ADD", "SUBJECT", "UNDERGO", "PERFORM", "EXPOS", "DERIV", "ORIGINAT", "PARTICIPAT", "TREAT", "COAT", "DOPE", "IMPLEMENT"),
    "LOCATED_OR_OCCURS_IN": ("ADJACENT", "DISTRIBUT", "LOCAT", "SURROUND", "OCCUR", "PRESENT", "SEGREGAT"),
    "CONNECTS_OR_FLOWS_TO": ("FLOW", "CONNECT", "JOIN", "EXTEND", "INTERFACE"),
    "COMPARES_WITH": ("DIFFER", "COMPARE", "CONTRAST", "ALTERNATIVE", "SIMILAR", "AGREE", "CONSISTENT", "RESEMBL", "MATCH", "COUNTERPART", "OUTPERFORM", "EXCEED", "GROUPED", "ALIGN"),
    "INTERACTS_WITH": ("INTERACT", "COMBIN", "REACT", "COEXIST", "COLLABORAT"),
    "DEPENDS_ON_OR_REQUIRES": ("DEPEND", "REQUIR", "BASED", "CONSTRAIN"),
    "TEMPORAL_ORDER": ("FOLLOW", "PRECEDE", "DURING"),
    "NO_EFFECT_OR_EXCLUDES": ("NO_EFFECT", "DOES_NOT", "EXCLUD", "LACK"),
}
OTHER = "OTHER"


def _by_group() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, group in EXACT.items():
        out.setdefault(group, []).append(name)
    return out


def relation_group(name: Column) -> Column:
    """Exact name, else the first group with a part in the name, else OTHER."""
    raw = F.trim(F.upper(F.coalesce(F.nullif(name, F.lit("")), F.lit("UNKNOWN"))))
    exact = F.lit(None).cast("string")
    for group, names in _by_group().items():
        exact = F.when(raw.isin(*names), group).otherwise(exact)
    part = F.lit(OTHER)
    for group, parts in reversed(PARTS.items()):
        part = F.when(raw.rlike("|".join(parts)), group).otherwise(part)
    return F.coalesce(exact, part)


def relation_group_sql(name: str) -> str:
    """The same rule as a SQL expression."""
    raw = f"trim(upper(coalesce(nullif({name}, ''), 'UNKNOWN')))"
    exact = " ".join(f"WHEN {raw} IN ({', '.join(map(repr, names))}) THEN '{group}'" for group, names in _by_group().items())
    parts = " ".join(f"WHEN regexp_matches({raw}, '{'|'.join(p)}') THEN '{group}'" for group, p in PARTS.items())
    return f"CASE {exact} {parts} ELSE '{OTHER}' END"
