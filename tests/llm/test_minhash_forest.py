"""The Jaccard join against all pairs."""

import random
from collections import Counter

from quayside.llm import minhash_forest


def grams(t, n=5):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain(rows):
    sets = [grams(t) for _, t in rows]
    split = [tuple((t or "").encode().split()) for _, t in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and (split[i] == split[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))] for i in range(n)]
    label = list(range(n))
    while True:
        new = [min([label[i]] + [label[j] for j in near[i]]) for i in range(n)]
        if new == label:
            break
        label = new
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    out = []
    for i, (d, _) in enumerate(rows):
        group = least(rows[j][0] for j in range(n) if label[j] == label[i]) if near[i] else d
        copies = [j for j in range(n) if split[j] == split[i]] if split[i] else [i]
        out.append((d, group, least(rows[j][0] for j in copies) if len(copies) > 1 or near[i] else d, len(copies), len(near[i])))
    return Counter(out)


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    rows = [(None, None), (-1, ""), (-2, " \n"), (-3, "a b"), (-4, "a  b"), (-5, "a c"), (None, "one two three four five six"), (None, "one two three four five six"), (-6, "b " * 2000), (-7, "b " * 30)]
    for k in range(n):
        base = [word() for _ in range(r.randint(30, 200))]
        rows.append((100 * k, " ".join(base)))
        for c in range(r.randint(0, 5)):
            own = list(base)
            for _ in range(r.randint(0, len(own) // 40)):
                own[r.randrange(len(own))] = word()
            rows.append((100 * k + c + 1, " ".join(own)))
    return [*rows, rows[20], rows[21]]


def result(df):
    return Counter((r.doc_id, r.class_id, r.copy_of, r.n_copies, r.n_links) for r in df.collect())


def test_join(spark):
    rows = made(4)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, label int").repartition(3)
    assert result(minhash_forest.jaccard_join(spark, df)) == plain(rows)
    kept = minhash_forest.one_of_each_group(spark, df).collect()
    groups = Counter(r.label for r in minhash_forest.jaccard_join(spark, df).collect() if r.label is not None)
    assert len(kept) == len(groups) + 3 and len(kept[0]) == 3
    assert minhash_forest.jaccard_join(spark, df.limit(0)).collect() == [] and minhash_forest.one_of_each_group(spark, df.limit(0)).collect() == []


def test_large_branches_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "BLOCK", 16)
    r = random.Random(8)
    base = [str(r.random()) for _ in range(150)]
    rows = []
    for k in range(120):
        own = list(base)
        for _ in range(k % 4):
            own[r.randrange(150)] = str(r.random())
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash_forest.jaccard_join(spark, df)) == plain(rows)


def test_real_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(minhash_forest.jaccard_join(spark, docs)) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_depth_follows_recall(spark):
    rows = made(6, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash_forest.jaccard_join(spark, df, trees=30, depth=6, recall=0.99999)) == plain(rows)
    assert minhash_forest.recall_at(0.8, 16, 4) > 0.999 > minhash_forest.recall_at(0.8, 16, 5)


def edited(seed, n=40, words=160):
    """Pairs of texts that differ in three words: a similarity a little above 0.8."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        base = [str(r.random()) for _ in range(words)]
        own = list(base)
        for i in (74 + k, 20, 132):
            own[i] = "x"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    return rows


def test_measured_recall_shortens_the_prefixes(spark, monkeypatch):
    rows = edited(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash_forest, "recall_at", lambda *a: 1.0)  # the calculation promises too much
    asked = []
    original = minhash_forest.branches
    monkeypatch.setattr(minhash_forest, "branches", lambda nodes, trees, depth, full: asked.append((depth, full)) or original(nodes, trees, depth, full))
    got = result(minhash_forest.jaccard_join(spark, df, trees=3, depth=5, recall=0.8))
    assert asked[0][0] < asked[0][1] == 5
    found = sum(n for (*_, links), n in got.items() if links)
    assert found >= 0.8 * sum(n for (*_, links), n in plain(rows).items() if links)


def test_sample_has_a_bound_and_may_be_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "SAMPLE_GRAMS", 400)
    rows = edited(5, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash_forest.jaccard_join(spark, df)) == plain(rows)
    alone = spark.createDataFrame(rows[::2], "doc_id long, text string")
    assert result(minhash_forest.jaccard_join(spark, alone)) == plain(rows[::2])
