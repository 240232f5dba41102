"""Classifier, quality rules, mixing and WARC packages."""

import hashlib
import io
import math
import re
import struct
import zipfile
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quayside.llm import likelihood_rules, line_crf, mixing, warc_zip
from quayside.llm._shared import shared_dir, stored


# ---- classifier ----


def test_forward_backward_matches_all_paths():
    r = np.random.default_rng(3)
    odds, cut, pairs = r.normal(size=8), np.array([0, 1, 5, 8]), r.normal(size=(2, 2))
    good, expected, log_z = line_crf.forward_backward(odds, cut, pairs)
    for c, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        n = b - a
        total, marginal, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in range(1 << n):
            y = [(path >> k) & 1 for k in range(n)]
            w = math.exp(sum(odds[a + k] * y[k] for k in range(n)) + sum(pairs[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            marginal += w * np.array(y)
            for k in range(n - 1):
                pair[y[k], y[k + 1]] += w
        assert np.allclose(good[a:b], marginal / total) and np.allclose(expected[c], pair / total) and np.isclose(log_z[c], math.log(total))


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = line_crf.classify(spark, docs, labels, 2000)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 500 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_classifier_cases(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(None, None), (1001, None), (1001, ""), (1002, "\n\n"), (1003, "word " * 30000), (None, "a")], "doc_id long, text string")
    labels = labels.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (1001, None), (55555, 0)], "doc_id long, quality int"))
    model = line_crf.learn(docs, labels)
    rows = line_crf.score(odd.withColumn("score", F.lit(3)), model, True).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1001}) == 1 and [len(r.lines) for r in rows if r.doc_id == 1002] == [3]
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
    assert line_crf.score(docs.limit(0).select("doc_id", "text"), model).collect() == []
    assert line_crf.learn(docs, labels.limit(0)).prior == 0.5
    assert {r.score for r in line_crf.classify(spark, odd, labels.filter("quality = 1")).collect()} == {0.5}
    kept = line_crf.good_documents(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in line_crf.score(docs, model).filter("predicted = 1").collect()}


# ---- quality rules ----


def plain_rules(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [s for s in t.split("\n") if re.search("[^\x20\x09-\x0d]", s)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    hit = {k for i, x in enumerate(wins) if n[x] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_rules(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows += [(None, None), (-1, ""), (-2, " \x0b\x0c\r"), (-3, "a\n\na\na \n"), (-4, "x y " * 300), (-5, "é# <b>\x85 \xa0x " * 9), (-6, "w " * 8 + "v " + "w " * 8), rows[0], (-7, " ".join(map(str, range(9000))))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kept int").repartition(3)
    got = likelihood_rules.quality_rules(spark, df, labels).collect()
    assert Counter(tuple(r[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == Counter((d, *plain_rules(t)) for d, t in rows)
    assert not any(r.kept for r in got if r.base_failed)
    assert likelihood_rules.quality_rules(spark, df.limit(0), labels).collect() == []
    assert {r.score for r in likelihood_rules.quality_rules(spark, df.filter("doc_id < 3"), labels.limit(0)).collect()} == {0.0, None}


def plain_grams(t):
    """Buckets of the words and neighbouring pairs of a text."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64(w.encode(), 42).intdigest()) for w in re.findall("[^\x20\x09-\x0d]+", t or "")]
    long = lambda x, seed: xxhash.xxh64(struct.pack("<q", x), seed).intdigest()
    return [x % likelihood_rules.N_BUCKETS for x in h + [signed(long(y, long(x, 42))) for x, y in zip(h[:-1], h[1:], strict=True)]]


def test_scores_and_verdicts_against_a_plain_version(spark, sf, monkeypatch):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, good = Counter(), Counter()
    for d, t in rows:
        raw.update(plain_grams(t))
        good.update(plain_grams(t) if d in trusted else [])
    share = good.total() / raw.total()
    want = {}
    for d, t in rows:
        w = [math.log((good[b] + 16 * share) / (raw[b] + 16)) - math.log(share) for b in plain_grams(t)]
        want[d] = sum(w) / len(w) if w else None
    for sent in (1 << 20, 0):
        monkeypatch.setattr(likelihood_rules.bucket_counts, "__defaults__", (likelihood_rules.N_BUCKETS, sent))
        got = likelihood_rules.quality_rules(spark, docs, labels).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.score is None) == (want[r.doc_id] is None) and (r.score is None or abs(r.score - want[r.doc_id]) < 2e-6)
            assert r.kept == (not r.base_failed and want[r.doc_id] >= -0.2)


def test_rules_tell_good_from_bad(spark):
    for sf, most in (("sf0.001", 0.4), ("sf0.01", 0.1), ("sf0.1", 0.02)):
        labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
        own = likelihood_rules.quality_rules(spark, spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), labels).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
        share = {r.quality: r.kept for r in own}
        assert share[1] > 0.99 and share[0] <= most, (sf, share)


def test_a_verdict_depends_on_the_counts_alone(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = likelihood_rules.bucket_weights(likelihood_rules.bucket_counts(docs, labels.filter("quality = 1")))
    every = {tuple(r) for r in likelihood_rules.score(docs, weights).collect()}
    assert {tuple(r) for r in likelihood_rules.score(docs.filter("doc_id % 7 = 0"), weights).collect()} <= every


def test_ratio_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    weights = likelihood_rules.bucket_weights(likelihood_rules.bucket_counts(docs, spark.createDataFrame([(1,)], "doc_id long")))
    got = {r.doc_id: r.score for r in likelihood_rules.score(docs, weights).collect()}
    good, raw = Counter(["a", "b", "a", "ab", "ba"]), Counter(["a", "b", "a", "ab", "ba", "b", "c", "bc"])
    w = lambda x: math.log((good[x] + 16 * 5 / 8) / (raw[x] + 16)) - math.log(5 / 8)
    assert got[1] == pytest.approx(sum(map(w, ["a", "b", "a", "ab", "ba"])) / 5, abs=2e-6) and got[2] == pytest.approx(sum(map(w, ["b", "c", "bc"])) / 3, abs=2e-6)


# ---- mixing ----


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    got, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > 3 * sizes[s]}
        for s in full or set(open_):
            got[s] = 3 * sizes[s] if full else weight[s] * unit
        open_ -= full or set(open_)
        left -= sum(got[s] for s in full)
    return got


def check_mix(rows, got):
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    goal, taken = plain_targets(sizes), defaultdict(int)
    of = {d: s for d, s, _ in rows}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for d, _, t in rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[of[r.doc_id]] and r.target == pytest.approx(goal[of[r.doc_id]])
        taken[of[r.doc_id]] += r.taken
    for s, g in goal.items():
        assert abs(taken[s] - g) <= 64 + 0.01 * g


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    got = mixing.mix(spark, docs).collect()
    check_mix(rows, got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(spark, docs.repartition(5)).collect()))
    rows = [(k, "big" if k % 3 else f"s{k % 12}", "w " * (k % 50)) for k in range(2500)]
    rows += [(9001, None, "x y z " * 900), (9002, "", None), (9003, "tiny", "one two"), (9004, "none", ""), (9005, "é", "x " * 40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, taken int").repartition(3)
    check_mix(rows, mixing.mix(spark, df).collect())
    assert mixing.mix(spark, df.limit(0)).collect() == []
    mixed = mixing.mixed_documents(spark, df)
    assert mixed.columns == df.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    rows = [(None if k % 2 else 7, "s", f"w{k % 40} " * (k % 40 + 1)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(spark, df)
    assert got.select("row").distinct().count() == 40 and got.count() == 400 and abs(got.agg(F.sum("taken")).first()[0] - sum(k % 40 + 1 for k in range(400))) <= mixing.BLOCK_WORDS


def test_seats(spark):
    votes = [53, 24, 23, 1, 0, 999]
    df = spark.createDataFrame([("a", k, v, 37) for k, v in enumerate(votes)] + [("b", 0, 0, 0)], "g string, k int, v long, n long")
    got = {r.k: r.quota for r in mixing.sainte_lague(df, "v", "n", ["g"], F.col("k")).collect() if r.g == "a"}
    want = Counter()
    for _ in range(37):
        want[max(range(6), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))] += 1
    assert got == {k: want[k] for k in range(6)}


# ---- WARC ----


def test_packages(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "c\r\nd", ""), (-7, "é", "é\r\n\r\nWARC/1.1"), (None, "n", "<p>x</p>"), (None, "m", "only"), (None, "m", "only"), (2, "http://b", "<p>x</p>"), (8, "big", "z" * 300000), (9, "e", "ab"), (10, "e", "ab")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    for least in (0, 3):
        folder = shared_dir(spark, "w")
        files = stored(warc_zip.write_packages(df, folder, least, 2000, zip64=least == 0), spark, "f")
        got = warc_zip.read_packages(files, folder).collect()
        first = {}
        for p, _, h in rows:
            if len((h or "").encode()) >= least:
                first[h or ""] = max(first.get(h or "", -100), -100 if p is None else p)
        left, want = Counter(), Counter()
        for p, _, h in rows:
            b = (h or "").encode()
            own = len(b) >= least and first[h or ""]
            is_first = len(b) < least or ((-100 if p is None else p) == own and not left[h or ""])
            left[h or ""] += is_first
            want[p, len(b), b32encode(hashlib.sha1(b).digest()).decode(), "response" if is_first else "revisit", None if is_first or own == -100 else own] += 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        assert files.count() > 1
    assert warc_zip.archive(spark, df.limit(0)).collect() == []


@pytest.mark.parametrize("zip64", [False, True])
def test_package_is_a_zip(zip64):
    records = [b"a" * 10, b"b" * 5]
    raw = b"".join(warc_zip.package(records, [{"url": "u", "offset": 0, "length": 10}], zip64))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.read(warc_zip.DATA) == b"a" * 10 + b"b" * 5
    p = warc_zip.Package(io.BytesIO(raw), len(raw))
    assert p.range(warc_zip.DATA, 8, 4) == b"aabb" and p.index() == [{"url": "u", "offset": 0, "length": 10}]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment with PK\x05\x06 inside" + b"x" * 30
        with z.open("é.txt", "w", force_zip64=zip64) as f:
            f.write(b"hello")
    p = warc_zip.Package(out, len(out.getvalue()))
    assert p.range("é.txt", 1, 3) == b"ell"
    with pytest.raises(ValueError):
        warc_zip.Package(io.BytesIO(b"no zip"), 6)
