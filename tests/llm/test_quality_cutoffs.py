"""The guarantee of the certified cutoffs, by simulation and against a plain recount."""

import math

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import BASE, documents, odd_texts
from weftgraph.llm import quality_rules as rules


def test_false_rejection_stays_limited_in_every_stratum():
    """Over many holdouts, no stratum's chosen step rejects too many, but for a share delta of them."""
    rng, risk, delta, wrong = np.random.default_rng(3), 0.02, 0.05, 0
    true = {"a": np.linspace(0.001, 0.06, 12), "b": np.array([0.0, 0.019, 0.0201, 0.05]), "c": np.array([0.03] * 3)}
    ladders = {s: tuple(range(len(p))) for s, p in true.items()}
    for _ in range(1500):
        counts = {}
        for s, n in (("a", 900), ("b", 400), ("c", 1500)):
            at = np.searchsorted(np.sort(true[s]), rng.random(n))  # the step from which a good document is rejected
            counts[s, s] = (n, [int((at <= k).sum()) for k in range(len(true[s]))])
        chosen = rules.certify(counts, risk, delta, ladders)
        wrong += any(true[s][k] > risk for (s, _), k in chosen.items())
    assert wrong / 1500 <= delta + 3 * math.sqrt(delta * (1 - delta) / 1500)


def test_strata_are_tested_by_size_alone():
    least = rules.least_holdout(0.02, 0.05)
    assert 0.98**least <= 0.05 < 0.98 ** (least - 1)
    assert rules.tested({}, 0.02, 0.05) == [] and rules.tested({"a": least - 1}, 0.02, 0.05) == []
    assert rules.tested({"a": least, "b": least}, 0.02, 0.05) == ["a"]
    assert rules.tested({"a": 300, None: 300, "b": 200}, 0.02, 0.05) == ["a", None]


def test_the_path_has_useful_steps_with_the_least_harm_first():
    shares = {("symbols", 0): (0.0, 0.2), ("symbols", 1): (0.01, 0.5), ("top_word", 0): (0.0, 0.4), ("repeats", 0): (0.3, 0.3), ("repeats", 1): (0.0, 0.0)}
    assert rules.path_of(shares) == [("top_word", 0.9), ("symbols", 3.0), ("symbols", 2.0)]


def test_verdicts_equal_a_plain_recount(spark):
    rng = np.random.default_rng(4)
    good = [BASE + " " + " ".join(f"w{i}x{j}" for j in range(30)) + " #" * int(rng.integers(0, 3)) for i in range(900)]
    bad = [" ".join(f"b{j} " + "$" * int(rng.integers(1, 4)) for j in range(60)) + f" {i}" for i in range(90)]
    bad[::2] = [" ".join(f"b{i}y{j}" + "long" * 6 for j in range(60)) for i in range(0, 90, 2)]
    docs = documents(spark, good + bad + odd_texts(), extra=True).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.lit("en")))
    labels = spark.createDataFrame([(i, int(i < 900), 0) for i in range(990)], "doc_id long, quality int, toxic int")
    rows = rules.apply_rules(docs, labels).collect()
    marks = spark.range(990).select("id", F.pmod(F.xxhash64("id"), F.lit(rules.PARTS)).alias("part")).collect()
    part, base = {r.id: r.part for r in marks}, {r.doc_id: r.base_failed for r in rows}
    fails = lambda r, rule, cutoff: r[rules.RULES[rule][0]] > cutoff * r[rules.RULES[rule][1]]
    known = [r for r in rules.document_statistics(docs).collect() if r.doc_id < 990 and not base[r.doc_id]]
    some = [[r for r in known if part[r.doc_id] == 0 and (r.doc_id < 900) == kind] for kind in (True, False)]
    steps = [(rule, k, cutoff) for rule, (_, _, ladder) in rules.RULES.items() for k, cutoff in enumerate(ladder)]
    path = rules.path_of({(rule, k): tuple(sum(fails(r, rule, cutoff) for r in group) / len(group) for group in some) for rule, k, cutoff in steps})
    path = [step for k, step in enumerate(path) if any(fails(r, *step) and not any(fails(r, *x) for x in path[:k]) for r in some[1])]
    certified = {}
    for stratum in ("en", None):
        group = [r for r in known if r.stratum == stratum and r.doc_id < 900 and part[r.doc_id] > 0]
        for k in range(len(path)):
            gone = sum(any(fails(r, *step) for step in path[: k + 1]) for r in group)
            if sum(math.comb(len(group), i) * 0.02**i * 0.98 ** (len(group) - i) for i in range(gone + 1)) > 0.05 / 2:
                break
            certified[stratum] = path[: k + 1]
    assert len(path) > 1 and set(certified) == {"en", None}
    stats = {r.doc_id: r for r in rules.document_statistics(docs).collect()}
    assert {r.doc_id: r.kept for r in rows} == {i: not base[i] and not any(fails(r, *step) for step in certified[r.stratum]) for i, r in stats.items()}
    assert any(not r.kept and not r.base_failed for r in rows)
