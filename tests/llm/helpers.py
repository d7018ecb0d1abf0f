import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

BASE = "the quick brown fox jumps over one lazy dog while seven wise owls watch from a tall old oak near the quiet river bank at dusk and nobody else is around to see it happen again today"


def words(text):
    return WORD.findall(text or "")


def documents(spark, texts, ids=None, extra=False):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    # columns whose names clash with those that the operators make
    return df.selectExpr("*", "'x' AS node", "1 AS n", "2 AS batch", "3 AS hits", "'y' AS spans", "4 AS score") if extra else df


def odd_texts():
    """Empty, blank, short, long, repeated and copied texts."""
    long = " ".join(f"word{i % 977} item{i}" for i in range(6000))
    near = BASE.replace("seven", "eight")
    return [
        None, "", "  \n\t ", "one", "two words", "a b c d", "a b c d e", BASE, BASE, near, BASE.upper(), BASE + " and some more words follow here",
        long, long, long + " tail", "x" * 30_000, "é ü ñ 日本語 text here   wide", "line\nline\n\nline\nother\nother", BASE + "\n" + BASE,
        "intro words that are new here " + BASE, "ß" * 500 + " " + BASE + " end", "a a a a a a a a a a a a a a a a a a a a",
    ]
