"""Numbers with units, alloy names and technical terms of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: numbers with an optional qualifier, range and unit
NUMBER = r"(?i)(?:约|大约|接近|超过|低于|小于|大于)?\d+(?:\.\d+)?(?:\s*[-~至到]\s*\d+(?:\.\d+)?)?(?:\s*[%％℃°CKGhμn²³]|MPa|GPa|mm|nm|wt\.?%|at\.?%|vol\.?%)?"
# fixed values: chemical formulas and alloy names
ALLOY = (
    r"(?i)(?:Ni|Co|Fe|Cr|Mo|W|Re|Ru|Ta|Ti|Al|Nb|V|Hf|Zr|B|C|Y|La|Ce)\d*(?:[.\d]*)?(?:\s*[-_]?\s*(?:Ni|Co|Fe|Cr|Mo|W|Re|Ru|Ta|Ti|Al|Nb|V|Hf|Zr|B|C|Y|La|Ce)\d*(?:[.\d]*)?)*"
    r"|(?:IN|CMSX|RR|TMS|PWA|René|Waspaloy|Inconel|Hastelloy|Mar-M|Udimet|Nimonic)[\s\-]?\d+[A-Za-z]*"
)
# fixed values: technical terms
TERMS = (
    "γ相", "γ'相", "γ\"相", "gamma", "gamma prime", "δ相", "σ相", "μ相", "P相", "TCP相", "拓扑密排相", "FCC", "BCC", "HCP",
    "固溶强化", "沉淀强化", "弥散强化", "晶界强化", "奥罗万", "Orowan", "位错", "滑移", "攀移", "交滑移", "层错", "反相畴界", "APB",
    "定向凝固", "单晶", "真空熔炼", "VIM", "VAR", "ESR", "HIP", "粉末冶金", "铸造", "锻造", "热处理", "时效", "固溶处理",
    "蠕变", "疲劳", "氧化", "腐蚀", "屈服", "断裂", "韧性", "硬度", "筏化", "rafting", "蠕变断裂", "低周疲劳", "高周疲劳",
)


def _found(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.trim), lambda x: x != "")


def numbers(text: Column) -> Column:
    return _found(text, NUMBER)


def alloys(text: Column) -> Column:
    return F.array_distinct(_found(text, ALLOY))


def terms(text: Column) -> Column:
    """Terms that stand anywhere in the text, whatever their case, in the list's order."""
    lower = F.lower(text)
    return F.filter(F.array(*[F.lit(t) for t in TERMS]), lambda t: F.contains(lower, F.lower(t)))


def keywords(text: Column) -> Column:
    return F.struct(numbers(text).alias("numbers"), alloys(text).alias("alloys"), terms(text).alias("terms"))
