"""Secret scanning with a random forest against false positives, JVM-side.

A candidate is a maximal run of key characters that has at least 16 of them, or
stands after an assignment (= or :, at most eight blanks, a quote), or begins as
known keys do; of any length then, with or without digits. An equals sign ends a
run, so a name and its value are two, unless it pads base64. A random forest
decides from its length, character transitions, dictionary coverage, whether it
stands in a path or host name, and from the neighbouring words (three whole ones
before it, of any length, the candidate before among them, and one after it)
whether it is a secret. The forest is trained by MLlib on labelled findings, whose
texts are cut into candidates by the same pattern; its trees are turned into flat
arrays and walked by higher-order SQL functions inside the projection that finds
the candidates. So scanning, scoring and redaction are one narrow pass of
built-in expressions: nothing is exploded, shuffled or joined, and no Python runs
on executors.

Scale: linear in the text; the patterns use possessive runs and look-behind, so
a run is looked at once however long it is, and the words around candidates are
taken from the ends of the text between them. A document's candidates stay in
its own row. The forest is a literal of about 100 kB.

Defined results: a null text has no candidates and stays null when redacted; so
does an empty one stay empty. Repeated rows are scanned each. Other columns are
kept by redact() and ignored by scan(). Texts and candidates of any length are
read whole. A score that equals the threshold is a secret. An empty table gives
no rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, fresh, only

_RUN = r"A-Za-z0-9+/_.~\-"
_PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|sk[_\-]|xox[abprs]-|eyJ|AIza|glpat-|npm_)"
_CODE = "[A-Za-z0-9+/]"
_PADDED = rf"(?:{_CODE}{{4}}){{4,}}+(?:{_CODE}{{2}}==|{_CODE}{{3}}=)(?![{_RUN}=])"
#: Look-behinds of fixed widths, as not every engine has others.
_ASSIGNED = "|".join(rf"(?<=[=:]{blank}{quote})" for n in range(9) for blank in [rf"\s{{{n}}}" if n else ""] for quote in ("", "[\"'`]"))
CANDIDATE = rf"(?<![{_RUN}])(?:{_PADDED}|[{_RUN}]{{16,}}+|{_PREFIX}[{_RUN}]*+|(?<=[\s:=\"'`])(?:{_ASSIGNED})[{_RUN}]++)"

# fixed values: words that show what a run is
SECRET_WORDS = ("token", "secret", "key", "apikey", "passwd", "password", "pwd", "auth", "bearer", "credential", "private", "access", "signing")
HARMLESS_WORDS = ("commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "id", "etag", "revision", "version", "example", "sample", "test", "dummy", "placeholder", "isbn", "order", "build", "file", "image", "path", "url", "host")
DICTIONARY = (
    "the", "and", "for", "with", "that", "this", "from", "have", "not", "are", "was", "you", "your", "here", "all", "can", "one", "time", "word", "text", "page", "part", "note",
    "chapter", "section", "table", "figure", "photo", "image", "video", "file", "path", "home", "user", "name", "data", "test", "demo", "sample", "example", "index", "main", "model",
    "config", "server", "client", "service", "system", "mail", "host", "local", "web", "www", "http", "https", "com", "org", "net", "html", "json", "xml", "css", "jpg", "png", "pdf", "txt",
    "version", "release", "build", "beta", "alpha", "update", "report", "result", "value", "number", "item", "list", "order", "group", "class", "type", "string", "public", "static",
    "api", "key", "token", "secret", "password", "change", "insert", "replace", "project", "product", "article", "news", "blog", "post", "archive", "category", "search", "ing", "tion", "ment", "able",
)

FEATURES = (
    "length", "transitions", "distinct", "digits", "upper", "longest_letters", "dictionary", "hex", "slashes", "dots", "marks", "separators",
    "assigned", "quoted", "secret_word", "harmless_word", "after_at", "in_path", "repeats", "prefix", "secret_name", "names",
)

TREES, DEPTH = 40, 6
THRESHOLD = 0.5
MASK = "[SECRET]"
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=.~-")


def _share(part: Column, whole: Column) -> Column:
    return F.length(part) / F.greatest(F.length(whole), F.lit(1))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _tail(before: Column) -> Column:
    """The last three words of a text and the blanks after them, written backwards."""
    return F.regexp_extract(F.reverse(before), r"^\s*+\S*+\s*+\S*+\s*+\S*+", 0)


def _head(after: Column) -> Column:
    """What stands in a text up to its first whole word."""
    return F.regexp_extract(after, r"^\S*+\s*+\S*+", 0)


def features(run: Column, before: Column, after: Column) -> Column:
    """Array of doubles in the order of FEATURES; before and after are the text around."""
    return _features(run, _tail(before), _head(after))


def _features(run: Column, tail: Column, head: Column) -> Column:
    classes = F.translate(run, "".join(_KINDS), "".join(k * len(s) for k, s in zip("aA0-", _KINDS, strict=True)))
    lower = F.lower(run)
    letters = F.regexp_replace(run, r"[^A-Za-z]++", " ")
    secret = "(?:" + "|".join(SECRET_WORDS) + ")"
    around = F.lower(F.concat_ws(" ", F.reverse(tail), F.regexp_extract(head, r"^\S*+\s++(\S++)", 1)))
    name = F.lower(F.reverse(F.regexp_extract(tail, r"^[\"'`]?\s*+[=:]\s*+[\"'`]?([A-Za-z0-9_.\-]++)", 1)))
    values = (
        F.length(run),
        F.length(F.regexp_replace(classes, r"(.)\1*+", "x")) / F.length(run),
        F.size(F.array_distinct(F.split(run, ""))) / F.least(F.length(run), F.lit(40)),
        _share(F.regexp_replace(run, r"[^0-9]++", ""), run),
        _share(F.regexp_replace(run, r"[^A-Z]++", ""), run),
        F.array_max(F.transform(F.split(letters, " "), lambda w: F.length(w))) / F.length(run),
        1 - _share(F.regexp_replace(lower, "(?:" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", ""), run),
        _flag(run.rlike(r"^[0-9a-fA-F]++$")),
        F.length(F.regexp_replace(run, r"[^/]++", "")),
        F.length(F.regexp_replace(run, r"[^.]++", "")),
        F.length(F.regexp_replace(run, r"[^+=~]++", "")),
        F.length(F.regexp_replace(run, r"[^_\-]++", "")),
        _flag(tail.rlike(r"^[\"'`]?\s*+[=:]")),
        _flag(tail.rlike(r"^[\"'`]") & head.rlike(r"^[\"'`]")),
        _flag(around.rlike(secret)),
        _flag(around.rlike(r"\b(?:" + "|".join(HARMLESS_WORDS) + r")\b")),
        _flag(tail.rlike("^@") | head.rlike("^@")),
        _flag(tail.rlike(r"^(?://:|[\\/])") | run.rlike(r"^(?:\.{0,2}/|www\.)|\.(?:com|org|net|html?|jpe?g|png|gif|css|js|pdf|txt)(?:/|$)")),
        _flag(run.rlike(r"(.)\1{4}") | lower.rlike(r"example|placeholder|changeme|your[_\-]|12345678")),
        _flag(run.rlike(rf"^{_PREFIX}")),
        _flag(name.rlike(secret)),
        _flag(head.rlike(r"^[\"'`]?\s*+[=:]")),
    )
    return F.array(*[v.cast("double") for v in values])


class FlatForest(NamedTuple):
    """Complete binary trees of one depth; node k has children 2k+1 and 2k+2."""

    depth: int
    feature: list[int]
    cut: list[float]
    leaf: list[float]


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Findings (run, before, after, label, kind) of known kinds, made by rule.

    Every one of ``rows`` texts (the bound of the fit) is cut into candidates as
    scanned texts are; the planted run has its kind's label, other candidates
    0. Texts vary with hashes of the row's number, so the same rows come out
    everywhere.
    """
    n = F.col("id")
    h = lambda salt: F.sha2(F.concat(n.cast("string"), F.lit(salt)), 256)
    pick = lambda salt, items: F.element_at(F.array(*[F.lit(i) for i in items]), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(items))) + 1).cast("int"))
    base64 = lambda salt: F.regexp_replace(F.base64(F.concat(F.unhex(h(salt)), F.unhex(h(salt + "2")))), r"[\r\n]", "")
    plain = lambda salt: F.regexp_replace(base64(salt), "[+/=]", "7")
    size = lambda low, high: (F.lit(low) + F.pmod(F.xxhash64(n, F.lit("size")), F.lit(high - low + 1))).cast("int")
    cut = lambda text, low, high: F.substring(text, F.lit(1), size(low, high))
    words = ("the", "and", "stone", "river", "house", "light", "report", "market", "people", "garden", "window", "letter", "summer", "music")
    w = lambda salt: pick(salt, words)
    number = F.pmod(F.xxhash64(n, F.lit("number")), F.lit(100000)).cast("string")
    prose = F.concat(w("p1"), F.lit(" "), w("p2"), F.lit(" "))
    assign = F.concat(prose, pick("name", ("token", "secret", "api_key", "apikey", "password", "auth_token", "access_key", "SECRET_KEY", "client_secret")), pick("mark", (" = \"", "=\"", ": ", "=", " = '", ": \"")))
    name = pick("short", ("password", "passwd", "pwd", "secret", "db_password", "auth_token", "api_key", "token", "PASSWORD"))
    given = F.concat(prose, name, pick("given", (" = \"", ": \"", "=\"", " = '", ": ", " = ", "\": \"", "=", ":")))
    long_name = F.concat(w("n1"), pick("n2", ("_", "-", "")), w("n3"), F.lit("_"), pick("n4", ("setting", "option", "width", "label", "format")), pick("said", (" = \"", ": \"", "=\"", " = '", ": ", " = ", "=")))
    long_secret = F.concat(w("n1"), F.lit("_"), w("n3"), F.lit("_"), pick("n5", ("api_key", "token", "password", "secret_key")), pick("said", (" = \"", ": \"", "=\"", " = '", ": ", " = ", "=")))
    plain_name = pick("plain", ("color", "title", "name", "size", "class", "date", "note", "lang", "level", "width", "city", "count"))
    said = F.concat(prose, plain_name, pick("said", (" = \"", ": \"", "=\"", " = '", ": ", " = ", ":")))
    letters = lambda salt: F.regexp_replace(base64(salt), "[^A-Za-z]", "")
    shorter = lambda text, low, high: F.substring(text, F.lit(1), (F.lit(low) + F.pmod(F.xxhash64(n, F.lit("shorter")), F.lit(high - low + 1))).cast("int"))
    made = F.concat(pick("m1", ("S3cr3t", "P4ss", "hunter2", "Tr0ub4dor", "qwe9", "Xk7", "Adm1n", "L3tme")), pick("m2", ("Pass9", "In!", "Word1", "Zz8", "Rt5", "Key7", "Go3", "")))
    made = F.regexp_replace(made, "!", "_")
    closing = pick("close", ("\"", "'", "", " ", "\n"))
    cases = (
        (1, cut(h("a"), 32, 64), assign, closing),
        (1, cut(plain("b"), 20, 48), assign, closing),
        (1, cut(base64("c"), 24, 60), assign, closing),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(plain("d"), 1, 16))), pick("da", ("", "aws ", "key ", "id = ", "the ")), closing),
        (1, F.concat(pick("ea", ("ghp_", "gho_", "npm_", "glpat-", "sk_live_", "sk-", "xoxb-")), F.substring(plain("e"), 1, 36)), pick("eb", ("", "token ", "use ", "= ", "and ")), closing),
        (1, F.concat(F.lit("eyJ"), cut(plain("f"), 30, 60)), pick("fa", ("Bearer ", "Authorization: Bearer ", "jwt=", "token: ")), closing),
        (1, cut(plain("g"), 28, 60), F.concat(prose, pick("ga", ("Bearer ", "credential ", "private key ", "auth "))), closing),
        (1, cut(h("i"), 40, 40), assign, F.lit("\"")),
        (0, F.concat(w("h1"), number, F.lit("."), w("h2"), pick("h3", (".example.com", ".org", ".net", ".example.org"))), pick("h4", ("@", "http://", "host ", "")), F.lit(" ")),
        (0, F.concat(F.lit("/"), w("q1"), F.lit("/"), number, F.lit("/"), w("q2"), pick("q3", (".jpg", ".html", ".png", "", ".css"))), pick("q4", ("", "file ", "href=\"", "https:/", "src=\"")), closing),
        (0, F.concat(w("s1"), F.lit("-"), w("s2"), F.lit("-"), number, F.lit("-"), w("s3")), prose, F.lit(" ")),
        (0, F.concat(pick("c1", ("v1.", "release-", "build.")), number, F.lit(".0-beta."), number), prose, F.lit(" ")),
        (0, cut(h("k"), 32, 64), F.concat(prose, pick("k1", ("commit ", "sha256:", "md5 ", "checksum ", "revision ", "etag=\"", "digest: ", "hash "))), closing),
        (0, F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12)), pick("u1", ("id=", "uuid ", "order ", "guid: ")), closing),
        (0, F.concat(pick("x1", ("xxxxxxxxxxxxxxxx", "your_api_key_here_", "EXAMPLEKEY", "changeme-changeme", "0000000000000000", "placeholder_token_", "1234567890123456")), number), assign, closing),
        (0, F.concat(w("y1"), F.lit("_"), w("y2"), F.lit("_"), w("y3"), F.lit("_"), number), prose, closing),
        (0, F.concat(w("z1"), w("z2"), w("z3"), w("z4"), number), prose, F.lit(" ")),
        (0, F.concat(F.lit("2024-01-"), F.lpad(F.substring(number, 1, 2), 2, "0"), F.lit("T10:20:"), number), pick("t1", ("date: ", "at ", "build ")), F.lit(" ")),
        (0, F.concat(number, number, number, number), pick("n1", ("order ", "isbn ", "", "number ")), F.lit(" ")),
        # short or letters only, after an assignment or a known prefix, and what else stands there
        (1, made, given, closing),
        (1, shorter(plain("r1"), 8, 15), given, closing),
        (1, shorter(letters("r2"), 12, 40), given, closing),
        (1, F.concat(pick("r3", ("a", "b", "c")), shorter(plain("r3"), 8, 30)), F.concat(prose, name, F.lit("=")), closing),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(letters("r4"), 1, 16))), pick("da", ("", "aws ", "key ", "id = ", "the ")), closing),
        (0, w("o1"), given, closing),
        (0, w("o2"), said, closing),
        (0, pick("o3", ("The", "A", "This", "We", "It", "In", "1", "10", "2020", "30.", "word,", "Part.")), F.concat(w("p3"), F.lit(" "), w("p4"), pick("o4", (": ", ":", ":  "))), F.lit(" ")),
        (0, shorter(number, 1, 5), said, closing),
        (0, F.concat(w("o5"), number), said, closing),
        (0, w("o6"), F.concat(prose, plain_name, F.lit("=")), closing),
        (0, number, F.concat(prose, plain_name, F.lit("=")), closing),
        (0, F.concat(F.lit("sk-"), w("o7")), prose, F.lit(" ")),
        (0, F.repeat(pick("o8", ("-", "=", "_", ".", "~", "-=", "a")), 40), pick("o9", ("", "\n", "the ")), F.lit("\n")),
        (0, F.concat(w("l1"), pick("l0", ("-", "/", "", "_")), w("l2"), pick("l0", ("-", "/", "", "_")), w("l3"), pick("l0", ("-", "/", "", "_")), w("l4")), prose, F.lit(" ")),
        (1, F.concat(F.substring(plain("b1"), 1, 30), pick("b2", ("a", "b7", "Q3")), F.lit("==")), assign, closing),
        (1, cut(plain("b3"), 16, 40), long_secret, closing),
        (1, cut(h("b4"), 32, 40), long_secret, closing),
        (0, w("b5"), long_name, closing),
        (0, F.concat(w("b6"), F.lit(" "), number), long_name, closing),
        (0, F.concat(F.lit("/search/"), w("b7"), F.lit("?page="), F.substring(number, 1, 2), F.lit("&lang="), w("b8")), pick("b9", ("http://www.example.org", "see ", "href=\"")), closing),
        (0, F.concat(F.upper(F.concat(w("u2"), w("u3"), w("u4"), w("u5"))), pick("u6", ("", ".", ""))), pick("u7", ("THE ", "and ", "\n", "OF THE ")), F.lit(" ")),
    )
    kind = F.pmod(n, F.lit(len(cases)))
    parts = F.coalesce(*[F.when(kind == k, F.struct(F.lit(label).alias("label"), run.alias("planted"), before.alias("before"), after.alias("after"))) for k, (label, run, before, after) in enumerate(cases)])
    # inside a lambda the many cases are evaluated as they stand; as generated code they would pass a method's limit
    made = spark.range(rows).select(kind.alias("kind"), F.transform(F.array(F.lit(0)), lambda _: parts)[0].alias("x")).select("kind", "x.*")
    texts = made.select("kind", "planted", "label", F.concat("before", "planted", "after").alias("text"))
    found = _cut(texts, "runs", "gaps").select("kind", "planted", "label", F.posexplode("runs").alias("i", "run"), "runs", "gaps")
    i = F.col("i")
    label = F.when(F.col("run") == F.col("planted"), F.col("label")).otherwise(0)
    return found.select("run", _before(F.col("runs"), F.col("gaps"), i).alias("before"), _after(F.col("runs"), F.col("gaps"), i).alias("after"), label.alias("label"), F.col("kind").cast("int").alias("kind"))


_LINE = re.compile(r"^(\s*)(?:(If|Else) \(feature (\d+) (<=|>) ([-\d.E]+)\)|Predict: ([-\d.E]+))")


def _flatten(tree: str, depth: int) -> tuple[list[int], list[float], list[float]]:
    inner = (1 << depth) - 1
    feature, cut, leaf = [0] * inner, [0.0] * inner, [0.0] * (inner + 1)
    lines = [m for line in tree.splitlines() if (m := _LINE.match(line))]
    at = 0

    def walk(node: int, level: int) -> None:
        nonlocal at
        m = lines[at]
        at += 1
        if m[6] is not None:
            first = node
            for _ in range(depth - level):
                first = 2 * first + 1
            for k in range(1 << (depth - level)):
                leaf[first - inner + k] = float(m[6])
            return
        feature[node], cut[node] = int(m[3]), float(m[5])
        walk(2 * node + 1, level + 1)
        at += 1  # the Else line
        walk(2 * node + 2, level + 1)

    walk(0, 0)
    return feature, cut, leaf


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """MLlib's random forest of labelled findings (run, before, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    made = findings.select(features(F.col("run"), F.col("before"), F.col("after")).alias("features"), F.col("label").cast("double").alias("label"))
    rows = Scratch(findings.sparkSession, "findings").keep(made, "features").select(array_to_vector("features").alias("features"), "label").coalesce(2)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird", maxBins=32).fit(rows)


def flatten(model, depth: int = DEPTH) -> FlatForest:
    """The trees of MLlib's model as flat arrays."""
    parts = re.split(r"\n\s*Tree \d+ \(weight [-\d.E]+\):\n", model.toDebugString)[1:]
    flat = [_flatten(p, depth) for p in parts]
    return FlatForest(depth, *[[x for tree in flat for x in tree[k]] for k in range(3)])


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> FlatForest:
    """Fit a random forest on labelled findings and flatten it."""
    return flatten(fit(findings, trees, depth), depth)


def vote(forest: FlatForest, x: Column) -> Column:
    """Share of trees that call the finding with feature array x a secret."""
    inner = (1 << forest.depth) - 1
    trees = len(forest.leaf) // (inner + 1)
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    feature, cut, leaf = literal(forest.feature), literal(forest.cut), literal(forest.leaf)

    def walk(tree: Column) -> Column:
        step = lambda node, _: 2 * node + 1 + F.when(x[feature[tree * inner + node]] > cut[tree * inner + node], 1).otherwise(0)
        last = F.aggregate(F.sequence(F.lit(1), F.lit(forest.depth)), F.lit(0), step)
        return leaf[tree * (inner + 1) + last - inner]

    votes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), walk)
    return F.aggregate(votes, F.lit(0.0), lambda a, v: a + v) / trees


def _cut(docs: DataFrame, runs: str, gaps: str) -> DataFrame:
    """docs with their candidates and the text between them (null without candidates)."""
    text = F.col("text")
    some = text.rlike(CANDIDATE)
    return docs.withColumns({runs: F.when(some, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))), gaps: F.when(some, F.split(text, CANDIDATE, -1))})


def _before(runs: Column, gaps: Column, i: Column) -> Column:
    """The candidate before the i-th and the text between them."""
    return F.concat(F.when(i > 0, F.get(runs, i - 1)).otherwise(""), F.get(gaps, i))


def _after(runs: Column, gaps: Column, i: Column) -> Column:
    return F.concat(F.get(gaps, i + 1), F.coalesce(F.get(runs, i + 1), F.lit("")))


def _scored(docs: DataFrame, forest: FlatForest, threshold: float, gaps: str, found: str) -> DataFrame:
    """docs with gaps (text between candidates) and found (run, score, secret)."""
    runs, tails, heads = fresh(docs.withColumns({gaps: F.lit(0), found: F.lit(0)}), "runs", "tails", "heads")
    rows = _cut(docs, runs, gaps)
    around = lambda part, end: F.transform(runs, lambda _, i: end(part(F.col(runs), F.col(gaps), i)))
    rows = rows.withColumns({tails: around(_before, _tail), heads: around(_after, _head)})
    described = F.transform(runs, lambda r, i: F.struct(r.alias("run"), _features(r, F.get(tails, i), F.get(heads, i)).alias("x")))
    rows = rows.withColumn(found, described)
    rows = rows.withColumn(found, F.transform(found, lambda f: F.struct(f["run"].alias("run"), vote(forest, f["x"]).alias("score"))))
    return rows.withColumn(found, F.transform(found, lambda f: F.struct(f["run"].alias("run"), f["score"].alias("score"), (f["score"] >= threshold).alias("secret"))))


def scan(docs: DataFrame, forest: FlatForest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_candidates, n_secrets and secrets (start, stop, score, sha256), one row per document."""
    rows = _scored(only(docs, doc_id="doc_id", text="text").withColumn("text", F.col("text").cast("string")), forest, threshold, "gaps", "found")
    kind = "array<struct<start:int,stop:int,score:double,sha256:string>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(kind).alias("out"))

    def step(acc: Column, f: Column) -> Column:
        begin = acc["at"] + F.length(F.col("gaps")[acc["i"]])
        stop = begin + F.length(f["run"])
        one = F.array(F.struct(begin.alias("start"), stop.alias("stop"), f["score"].alias("score"), F.sha2(f["run"], 256).alias("sha256")))
        return F.struct(stop.alias("at"), (acc["i"] + 1).alias("i"), F.when(f["secret"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    secrets = F.coalesce(F.aggregate("found", start, step, lambda acc: acc["out"]), F.array().cast(kind))
    count = F.coalesce(F.size("found"), F.lit(0))
    return rows.select("doc_id", F.greatest(count, F.lit(0)).alias("n_candidates"), secrets.alias("secrets")).select("doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), "secrets")


def redact(docs: DataFrame, forest: FlatForest, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """docs with every secret in text replaced by mask; columns and rows stay."""
    gaps, found = fresh(docs, "gaps", "found")
    rows = _scored(docs, forest, threshold, gaps, found)
    parts = F.transform(found, lambda f, i: F.concat(F.when(f["secret"], F.lit(mask)).otherwise(f["run"]), F.col(gaps)[i + 1]))
    clean = F.concat(F.col(gaps)[0], F.array_join(parts, ""))
    changed = F.exists(found, lambda f: f["secret"])
    return rows.withColumn("text", F.when(changed, clean).otherwise(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])
