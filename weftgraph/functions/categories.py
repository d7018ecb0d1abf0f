"""Node types brought to eight broad categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: types by category; of a type named twice the last counts
TYPES = {
    "Material": ("Material", "MATERIAL", "Material Sample", "Alloying Element", "COMPONENT", "Alloy System", "Alloy", "Superalloy", "Nickel-based Superalloy", "Chemical Element", "Solute Atoms", "Solute Elements"),
    "Property": ("PROPERTY", "Material Property", "Mechanical Property", "Physical Property", "MEASUREMENT", "Thermal Property", "Creep Property", "Fatigue Property", "Oxidation Property"),
    "Processing": ("Process Parameter", "CONDITION", "Heat Treatment Process", "Manufacturing Process", "Processing", "Ageing Route", "Casting Process", "Welding Process"),
    "Microstructure": ("Microstructural Feature", "PHASE", "STRUCTURE", "Microstructural Phase", "Microstructural Phenomenon", "Crystal Structure", "Grain", "Precipitate"),
    "Defect": ("Crystallographic Defect", "Crystal Defect", "Defect", "Crack", "Failure Mode", "Degradation"),
    "Equipment": ("Equipment", "Instrument", "Testing Method", "Characterization Technique", "Experimental Setup"),
    "Literature": ("Author", "Scientific Study", "Publication", "Research Group", "Institution"),
    "Other": ("Technical Category", "COMPONENT", "Concept", "Application", "Environment"),
}

# fixed values: parts of a type's name, tried in this order
PARTS = {
    "Defect": ("DEFECT", "CRACK", "FAILURE", "DEGRAD", "VOID", "POROSITY", "CORROSION", "OXIDAT", "DAMAGE", "FRACTURE", "FATIGUE LIFE"),
    "Microstructure": ("MICRO", "PHASE", "STRUCTURE", "GRAIN", "PRECIPITAT", "CRYSTAL STRUCT", "DISLOC", "DEFORMATION", "REGION", "MORPHOLOG", "TEXTURE", "SEGREGAT", "DENDRIT", "SOLIDIF", "RECRYSTALL", "INTERMETALL", "CRYSTALLOGRAPH", "ORIENTATION", "PLANE", "DIRECTION", "INTERFACE", "OXIDE LAYER", "MECHANISM", "STRUCTURAL FEATURE", "FEATURE"),
    "Material": ("MATERIAL", "ALLOY", "ELEMENT", "SAMPLE", "COMPONENT", "SUPERALLOY", "STEEL", "ALUMINUM", "NICKEL", "TITANIUM", "COBALT", "SUBSTRATE", "COATING", "SOLUTE", "SYSTEM", "COMPOUND", "CHEMICAL", "METAL", "REAGENT", "ION", "SPECIES", "OXIDE"),
    "Property": ("PROPERTY", "STRENGTH", "HARDNESS", "MODULUS", "MEASUREMENT", "THERMAL", "CREEP", "TENSILE", "YIELD", "DUCTIL", "TOUGHNESS", "DENSITY", "CONDUCTIV", "METRIC", "PERFORMANCE", "RESISTANCE", "STRESS", "STRAIN", "ELASTIC", "QUANTITY", "PHENOMENON", "BEHAVIOR", "RESPONSE", "TREND", "THERMODYNAMIC"),
    "Processing": ("PROCESS", "TREATMENT", "CONDITION", "PARAMETER", "MANUFACTUR", "CASTING", "WELD", "ANNEAL", "SINTER", "FORGING", "ROLLING", "MACHINING", "ADDITIVE", "SLM", "LASER", "TEMPERATURE", "AGING", "AGEING", "QUENCH", "COOL"),
    "Equipment": ("EQUIP", "INSTRUMENT", "TECHNIQUE", "TEST", "METHOD", "ANALYT", "CHARACTERIZ", "MODEL", "SIMULAT", "COMPUTAT", "SOFTWARE", "SEM", "TEM", "XRD", "EBSD", "DFT", "FEM", "ALGORITHM", "MACHINE LEARN", "FRAMEWORK", "THEORETICAL"),
    "Literature": ("AUTHOR", "STUDY", "PUBLICATION", "JOURNAL", "RESEARCH", "PERSON", "ORGANIZ", "INSTITUT", "UNIVERSIT", "LABORATOR", "STANDARD", "BOOK", "REFERENCE", "DATASET", "FIGURE", "VISUALIZATION"),
}
OTHER = "Other"


def _exact() -> dict[str, list[str]]:
    """Upper-cased types by category, each in one category."""
    of = {t.upper(): c for c, types in TYPES.items() for t in types}
    out: dict[str, list[str]] = {}
    for t, c in of.items():
        out.setdefault(c, []).append(t)
    return out


def broad_category(kind: Column) -> Column:
    upper = F.upper(kind)
    part = F.lit(OTHER)
    for category, parts in reversed(PARTS.items()):
        part = F.when(upper.rlike("|".join(parts)), category).otherwise(part)
    out = part
    for category, types in _exact().items():
        out = F.when(upper.isin(*types), category).otherwise(out)
    return out


def broad_category_sql(kind: str) -> str:
    exact = " ".join(f"WHEN upper({kind}) IN ({', '.join(map(repr, t))}) THEN '{c}'" for c, t in _exact().items())
    parts = " ".join(f"WHEN regexp_matches(upper({kind}), '{'|'.join(p)}') THEN '{c}'" for c, p in PARTS.items())
    return f"CASE {exact} {parts} ELSE '{OTHER}' END"
