"""Indexes for many queries against plain scans."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.operators import closeness, index, vectors
from quayside.plans import catalog


def plain_neighbours(rows, asks, ok, k):
    out = {}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for i in asks:
        scores = sorted(((-round(float(unit[i] @ unit[j]), 6), j) for j in ok if j != i))
        out[i] = [j for _, j in scores[:k]]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_inverted_lists_find_the_exact_neighbours(spark, hot):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (12, 16))
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(0, 0.35, (1500, 16))
    if hot:
        x[300:900] = centres[0] + rng.normal(0, 0.05, (600, 16))
    rows = [(i, [float(v) for v in x[i].astype(np.float32)]) for i in range(1500)]
    odd = [(2000, None), (2001, [1.0] * 3), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "id_ long, v array<float>, score int").repartition(4)
    got = vectors.nearest(spark, df, "id_", "v", F.col("id_") % 50 == 0, F.col("id_") % 3 != 0, k=5, dims=16, lists=24)
    found = {}
    for r in got.orderBy("query_id", "pos").collect():
        found.setdefault(r.query_id, []).append(r.id_)
    want = plain_neighbours(rows, range(0, 1500, 50), [i for i in range(1500) if i % 3], 5)
    recall = np.mean([len(set(found[i]) & set(w)) / len(w) for i, w in want.items()])
    assert set(found) == set(want) and recall >= 0.9 and all(len(f) == 5 and all(j % 3 for j in f) for f in found.values())


def test_no_vectors_no_neighbours(spark):
    df = spark.createDataFrame([(1, None)], "id long, v array<float>")
    assert vectors.nearest(spark, df, "id", "v", F.lit(True), dims=4).collect() == []


def test_recall_over_the_given_table(spark):
    d = "/root/testdata/sf0.01/embeddings.parquet"
    df = spark.read.parquet(d)
    got = {}
    for r in vectors.nearest(spark, df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, F.col("label") % 2 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = plain_neighbours(rows, [i for i, _ in rows if i % 100 == 0], [r.vec_id for r in df.filter("label % 2 = 0").collect()], 10)
    assert np.mean([len(got[i] & set(w)) / len(w) for i, w in want.items()]) >= 0.9


def test_all_tiers_are_found_through_keys(spark):
    titles = ["konut kredisi", "ihtiyaclar paketi", "tasit", "kredikarti sahipleri", "a", ""]
    entries = spark.createDataFrame([(i, t, None) for i, t in enumerate(titles)], "id long, title string, note string")
    asked = ["konut", "kred", "redi", "konur", "knut", "ehtiyac", "ihtiyca", "kart", "tasit kredisi", "KONUT kredisi", "zzzz", "a", "", None]
    got = index.search(entries, "id", [("title", 8.0, True), ("note", 1.0, False)], spark.createDataFrame([(q,) for q in asked], "q string"), "q")
    found = {}
    for r in got.orderBy("query", "pos").collect():
        found.setdefault(r.query, []).append((r.id, r.score))
    assert found == {
        "konut": [(0, 16.0)], "kred": [(0, 14.8), (3, 14.8)], "redi": [(0, 12.8), (3, 12.8)], "konur": [(0, 4.0)], "knut": [(0, 3.2)], "ehtiyac": [(1, 2.8)], "ihtiyca": [(1, 4.0)], "kart": [(3, 12.8)], "konut kredisi": [(0, 24.0)],
        "a": [(4, 16.0), (2, 12.8), (1, 12.8), (3, 12.8)],
    }


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=14), st.text("abcé ", max_size=14))
def test_ratio_of_matching_blocks(a, b):
    assert closeness.blocks_ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()


def plain_closeness(a, b):
    pairs = lambda s: [s[i : i + 2] for i in range(max(1, len(s) - 1))]
    x, y = pairs(a), pairs(b)
    dot = sum(x.count(g) * y.count(g) for g in set(x))
    if not dot:
        return None
    cos = dot / np.sqrt(sum(x.count(g) ** 2 for g in set(x)) * sum(y.count(g) ** 2 for g in set(y)))
    return round(max(float(cos), SequenceMatcher(None, a, b, autojunk=False).ratio()), 6)


def test_closest_types_are_those_of_all_pairs(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    names = {p.p_name.lower() for p in parts}
    kinds = {" ".join([p.p_name.split(" ")[1], p.p_type, p.p_brand]).lower() for p in parts}
    got = {}
    for r in catalog.queries()["closest_types"](spark, sf).orderBy("p_name", "pos").collect():
        got.setdefault(r.p_name, []).append(r.score)
    for n in names:
        want = sorted((s for k in kinds if (s := plain_closeness(n, k)) is not None), reverse=True)[:3]
        assert got[n] == pytest.approx(want, abs=2e-6)


def test_nearest_holds_few_rows_at_once(spark, monkeypatch):
    """The same neighbours whatever the steps are."""
    df = spark.createDataFrame([(k, [float((k * p) % 101 - 50) for p in (3, 7, 11, 13)]) for k in range(400)], "id long, v array<double>")
    ask = lambda: sorted(map(tuple, vectors.nearest(spark, df, "id", "v", F.col("id") % 40 == 0, k=3, dims=4, lists=6, recall=1.0).collect()))
    want = ask()
    for name, n in (("STEP", 7), ("PAIRS", 1), ("HELD", 20)):
        monkeypatch.setattr(vectors, name, n)
    assert ask() == want and len(want) == 30
