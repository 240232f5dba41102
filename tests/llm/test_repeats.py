"""Substring and line operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from quayside.llm.line_templates import drop_template_lines
from quayside.llm.queries import op10_line_templates
from quayside.llm.substring_radix import remove_repeats
from quayside.llm.substring_recompress import remove_repeated_windows

SMALL = {"batch_bytes": 4096, "bucket_bytes": 2048}


def made_rows(seed: int) -> list[tuple[int | None, str | None]]:
    """Texts with nulls, empty ones, copies, shared passages, long runs of one word and long texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    rows: list[tuple[int | None, str | None]] = [(None, passage[0]), (None, None), (900, None), (901, ""), (902, " \n\t "), (903, "ab " * 300), (904, "ab " * 80), (905, "abc" * 90), (906, "x" + "abc" * 40)]
    for k in range(70):
        parts = [" ".join(word() for _ in range(r.randint(0, 50)))]
        if k % 3 == 0:
            parts.insert(r.randint(0, 1), passage[k % 4][r.randint(0, 40) :])
        rows.append((k, r.choice([" ", "\n", "  "]).join(parts)))
    rows += [rows[12], (950, rows[12][1]), (951, rows[13][1]), (5000, " ".join(word() for _ in range(4000)) + passage[1])]
    r.shuffle(rows)
    return rows


def brute_bytes(rows, width=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            first[w] = min(first.get(w, float("inf")), float("inf") if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < (float("inf") if d is None else d):
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_words(rows, width=35):
    split = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    n = Counter(tuple(w[i : i + width]) for _, w in split for i in range(len(w) - width + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if n[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def brute_lines(rows, depth=3, min_docs=3, min_tokens=3, share=0.5):
    lines = []
    for k, (_, t) in enumerate(rows):
        for s in (t or "").split("\n"):
            tokens = ["*" if re.search("[0-9]", x) else x for x in re.findall("[^\x20\x09-\x0d]+", s)]
            lines.append((k, s, tokens, (len(tokens), *tokens[:depth])))
    used = [x for x in lines if len(x[2]) >= min_tokens]
    leaf, token, template = defaultdict(set), defaultdict(set), defaultdict(set)
    for k, _, _, at in used:
        leaf[at].add(k)
    for k, _, tokens, at in used:
        for i, x in enumerate(tokens):
            token[at, i, x].add(k)
    of = {}
    for n, (k, _, tokens, at) in enumerate(lines):
        if len(tokens) >= min_tokens and len(leaf[at]) >= min_docs:
            made = tuple(x if x != "*" and len(token[at, i, x]) >= min_docs else "*" for i, x in enumerate(tokens))
            if sum(x != "*" for x in made) >= share * len(made):
                of[n] = (at, made)
                template[of[n]].add(k)
    out = []
    for k, (d, _) in enumerate(rows):
        own = [(n, x) for n, x in enumerate(lines) if x[0] == k]
        kept = "\n".join(x[1] for n, x in own if len(template.get(of.get(n), ())) < min_docs)
        lost = sum(len(template.get(of.get(n), ())) >= min_docs for n, _ in own)
        out.append((d, len(own), lost, len(kept), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def frame(spark, rows):
    """With columns whose names clash with those of the results."""
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_removed int, batch string").repartition(3)


def test_bytes(spark):
    for seed in (1, 2):
        rows = made_rows(seed)
        got = Counter(tuple(r) for r in remove_repeats(spark, frame(spark, rows), **SMALL).collect())
        assert got == brute_bytes(rows)


def test_words(spark):
    for seed in (1, 2):
        rows = made_rows(seed)
        got = Counter(tuple(r) for r in remove_repeated_windows(spark, frame(spark, rows), **SMALL).collect())
        assert got == brute_words(rows)


def test_words_of_real_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in remove_repeated_windows(spark, docs, **SMALL).collect()) == brute_words(rows)
    assert Counter(tuple(r) for r in remove_repeats(spark, docs, **SMALL).collect()) == brute_bytes(rows)


def test_lines(spark):
    r = random.Random(5)
    rows = [(k, "\n".join(r.choice([f"user {r.randint(1, 99)} logged in from {r.choice('abcdefgh')}", "all rights are reserved here", "", "one", "two words", " ".join(r.choice(["pear", "fig", "plum"]) for _ in range(5)), f"the end of {k} days"]) for _ in range(r.randint(0, 9)))) for k in range(60)]
    rows += [(None, None), (7, ""), rows[3], rows[3], (8, "all rights are reserved here\nall rights are reserved here")]
    for min_docs in (3, 8):
        got = Counter(tuple(x) for x in drop_template_lines(spark, frame(spark, rows), min_docs=min_docs, **SMALL).collect())
        assert got == brute_lines(rows, min_docs=min_docs)
    assert sum(x[2] for x in got) > 0


def test_short_lines_and_leading_fields(spark, tmp_path):
    name = lambda k: "abcdefghijklmno"[k] * 4
    texts = [f"By {name(k)} | posted on the site\nRead more\nLes.\n{name(k)} {name(k)}\n{k}" for k in range(12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_line_templates(spark, str(tmp_path)).collect()
    want = {k: "\n".join(t.split("\n")[3:]) for k, t in enumerate(texts)}
    assert {(x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in got} == {(k, 5, 3, hashlib.sha256(t.encode()).hexdigest()) for k, t in want.items()}


def test_empty(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert remove_repeats(spark, none).collect() == []
    assert remove_repeated_windows(spark, none).collect() == []
    assert drop_template_lines(spark, none).collect() == []
