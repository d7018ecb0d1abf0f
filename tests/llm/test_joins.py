import hashlib
import random

import pytest

from tests.llm.helpers import BASE, documents, odd_texts, words
from weftgraph.llm import ngram_join, substring_dedup


def _shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _components(ids, texts):
    sets = [_shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if a and sets[j] and 100 * same >= 80 * (len(a) + len(sets[j]) - same):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(zip(ids, sets, strict=True)))


def _family(seed, size, edits):
    """Variants of one text, some of them copies of variants, with passages of others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    out = [base]
    while len(out) < size:
        copy = list(rng.choice(out))
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(10_000)}"
        if rng.random() < 0.2:
            copy[10:10] = [f"p{i}" for i in range(30)]
        if rng.random() < 0.2:
            copy = copy[: rng.randrange(90, 120)]
        out.append(copy)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_brute_force(spark, seed):
    texts = odd_texts() + _family(seed, 120, 5) + _family(seed + 10, 60, 9)
    order = list(range(len(texts)))
    random.Random(seed).shuffle(order)
    docs = documents(spark, [texts[i] for i in order], order, extra=True)
    rows = ngram_join.linked_documents(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == _components(order, [texts[i] for i in order])


def test_join_of_an_empty_table_and_of_repeated_rows(spark):
    assert ngram_join.linked_documents(documents(spark, [])).count() == 0
    rows = ngram_join.linked_documents(documents(spark, [BASE, BASE, None, BASE + " x"], [5, 5, 3, 4])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (4, 4), (5, 4), (5, 4)]


def test_blocks_of_a_hub_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 16)
    texts = _family(7, 150, 7)
    rows = ngram_join.linked_documents(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == _components(range(len(texts)), texts)


def test_one_of_each_group_stays(spark):
    kept = ngram_join.keep_one_of_each(documents(spark, [BASE, BASE, "", None, "other words entirely than those before"]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4] and len(kept.columns) == 5


def _removed(ids, texts):
    first = {}
    for d, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, x[0] or 0)):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    out = []
    for d, t in zip(ids, texts, strict=True):
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] != d:
                gone |= set(range(i, i + 13))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def _key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [" ".join(f"p{k}x{i}" for i in range(rng.randrange(8, 40))) for k in range(6)]
    texts = odd_texts() + _family(seed, 60, 4)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + " " + rng.choice(passages) + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))) for _ in range(600)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = substring_dedup.deduplicated(documents(spark, texts, ids, extra=True)).collect()
    assert _key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == _key(_removed(ids, texts))


def test_substring_dedup_of_repeated_rows_nulls_and_nothing(spark):
    texts, ids = [BASE, BASE, BASE, BASE + " more", None, BASE], [3, 3, 4, None, 9, None]
    rows = substring_dedup.deduplicated(documents(spark, texts, ids)).collect()
    assert _key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == _key(_removed(ids, texts))
    assert substring_dedup.deduplicated(documents(spark, [])).count() == 0


def test_cut_texts_keep_rows_and_columns(spark):
    docs = documents(spark, ["new start here " + BASE, BASE, None, "nothing to cut"])
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert out == {0: "new start here " + BASE, 1: "", 2: None, 3: "nothing to cut"}


def test_stages_with_null_and_repeated_ids(spark):
    texts, ids = [BASE, BASE, BASE, "", None, "", BASE + " x", "single text of another kind here now"], [None, 4, 4, 4, None, 4, 4, None]
    kept = ngram_join.keep_one_of_each(documents(spark, texts, ids, extra=True))
    assert sorted(((r.doc_id or -1), r.text or "-") for r in kept.collect())[:1] == [(-1, "-")] and kept.count() == 5
    mine = [r for r in kept.collect() if r.text and "quick" in r.text]
    assert len(mine) == 1 and mine[0].doc_id == 4
    cut = substring_dedup.remove_repeats(documents(spark, texts, ids))
    assert sorted(((r.doc_id or -1), r.text or "") for r in cut.collect()) == sorted([(-1, ""), (4, BASE), (4, BASE), (4, ""), (-1, ""), (4, ""), (4, BASE + " x"), (-1, texts[-1])])
