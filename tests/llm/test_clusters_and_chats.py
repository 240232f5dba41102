"""Ball-tree clustering and chat formatting against plain versions."""

import hashlib
import json
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.llm import ball_tree, chat_format, queries, sql


def plain_kmeans(rows, k=8, rounds=10, dims=4):
    """(vec_id, integers) by brute force: cluster and distance of each row, final centroids."""
    kept = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    c = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for j, g in groups.items():
            c[j] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    return [(i, *nearest(x)[::-1]) for i, x in kept], c


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(1, 5), st.integers(0, 10**6), st.sampled_from([1, 3, 40, 1 << 26]))
def test_filtering_is_exact(n, k, seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (n, 3)) + rng.integers(-5 * spread, 5 * spread + 1, (4, 3))[rng.integers(0, 4, n)]
    c = np.concatenate([x[rng.integers(0, n, k - 1)], rng.integers(-spread, spread + 1, (1, 3))])
    order, balls = ball_tree.build(x, 4)
    assert sorted(order.tolist()) == list(range(n))
    counts, sums, found, _ = ball_tree.filtered(x[order], balls, c)
    d = ((x[order][:, None] - c[None]) ** 2).sum(2)
    to = np.full(n, -1)
    for places, j in found:
        to[places] = j
    assert (to == d.argmin(1)).all() and (counts == np.bincount(to, minlength=k)).all()
    assert all((sums[j] == x[order][to == j].sum(0)).all() for j in range(k))


def test_balls_are_given_whole():
    rng = np.random.default_rng(2)
    c = rng.integers(-10_000, 10_000, (4, 64))
    x = (c[rng.integers(0, 4, 3000)] + rng.integers(-50, 50, (3000, 64))).astype(np.int64)
    order, balls = ball_tree.build(x)
    assert ball_tree.filtered(x[order], balls, c)[3] < 300


def test_cluster_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(i % 3, 0.4, 4)]) for i in range(90)]
    rows += [(90, None), (91, [1.0, 2.0]), (92, [1.0, None, 0.0, 0.0]), (93, [float("nan"), 0.0, 0.0, 0.0]), (94, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5]), (95, [])]
    rows += [(7, rows[7][1])] * 60 + [(7, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(1)).repartition(5)
    want, c = plain_kmeans([(i, None if v is None else [None if a is None else float(np.float32(a)) for a in v]) for i, v in rows])
    got = ball_tree.cluster(spark, df, dims=4, tree=16, leaf=2).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    assert {r.cluster: r.centroid_sha256 for r in got} == {j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest() for _, j, _ in want}
    assert {r.cluster: r.cluster_inertia for r in got} == {j: sum(d for _, h, d in want if h == j) for _, j, _ in want} and {r.inertia for r in got} == {sum(d for *_, d in want)}


def test_cluster_of_few_and_of_none(spark):
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.distance) for r in ball_tree.cluster(spark, few, dims=2).collect()) == [(1, 0), (2, 0)]
    none = ball_tree.cluster(spark, few.filter("vec_id > 5"), dims=2)
    assert none.collect() == [] and none.columns == ball_tree.cluster(spark, few, dims=2).columns


ODD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("\\#</turn>: \nhe")), max_size=40)


def plain_escape(text):
    return text.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\e")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), max_size=4))
def test_template_round_trip(turns):
    out = "".join(f"### {plain_escape(r).replace(':', chr(92) + 'c')}: {plain_escape(t)}</turn>\n" for r, t in turns)
    assert chat_format.parsed(out) == turns and all("###" not in plain_escape(t) and "</turn>" not in plain_escape(t) for _, t in turns)


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "c"}]}]}, "message parts", [("user", "ac")]),
        ({"id": 3, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "from and value", [("user", "a"), ("assistant", "b")]),
        ({"dialog": [{"speaker": "bot", "utterance": "x"}]}, "dialog", [("assistant", "x")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "system, prompt and response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "response": "r", "score": 2}, "prompt and response", [("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction and output", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction and output", [("user", "i"), ("assistant", "o")]),
        ({"question": "q", "answer": 4}, "question and answer", [("user", "q"), ("assistant", "4")]),
        ({"message": {"role": "tool", "content": "t"}}, "message", [("tool", "t")]),
        ({"role": "user"}, "row without text", [("user", "")]),
    ],
)
def test_layouts(record, layout, turns):
    found = chat_format.layout_of(chat_format.field_paths(record))
    assert found.name == layout and chat_format.turns_of(record, found) == turns


def test_fingerprints_tell_layouts_apart_and_not_values():
    mark = lambda r: chat_format.fingerprint(chat_format.field_paths(r))
    assert mark({"a": [{"b": 1}, {"b": "x"}]}) == mark({"a": [{"b": None}, {"b": 2}]}) and mark({"a": {"b": 1}}) != mark({"a": [{"b": 1}]})


def plain_chats(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        out.setdefault(conv, []).append((role or "", text or ""))
    made = {}
    for conv, turns in out.items():
        said = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(f"### {plain_escape(r).replace(':', '::')}: {plain_escape(t)}</turn>\n") for r, t in turns)
        made[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size)
    return made


def test_format_with_odd_rows(spark):
    rows = [(1, 1, "assistant", "b\\h </turn>"), (1, 0, "user", "#### a"), (2, 0, "user", None), (2, 1, "assistant", ""), (None, 0, "user", "x"), (None, 1, None, "y: z"), (3, None, "a:b", "</turn>\n### user: c"), (3, 0, "system", "é😀" * 9), (4, 0, None, None)]
    rows += [(5, k, "assistant" if k % 2 else "user", f"turn {k} " * (k % 7)) for k in range(400)] + [(6, 0, "assistant", "w\\###</turn> " * 40_000)] + [(7, 0, "user", "same")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1)).withColumn("layout", F.lit(1)).repartition(7)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.format_chats(spark, chat_format.row_records(df), piece=500).collect()}
    assert got == plain_chats(rows)
    assert chat_format.format_chats(spark, chat_format.row_records(df.filter("turn > 1000"))).collect() == []


def test_records_of_unknown_layout_are_told(spark):
    rows = [(1, 0, json.dumps({"x": 1})), (2, 0, json.dumps({"x": 2})), (3, 0, "no json"), (4, 0, None), (5, 0, json.dumps({"prompt": "p", "completion": "c"})), (6, 0, "[1]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    assert sorted(r.n for r in chat_format.unmapped(df).collect()) == [2, 3]
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in chat_format.format_chats(spark, df).collect()] == [(5, 2, 1)]


@pytest.mark.parametrize("name", ["op11_ball_tree", "op13_chat_format"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql.ORACLES[name]}) ORDER BY 1").fetchall()
    assert sorted(map(tuple, df.collect())) == want and want
