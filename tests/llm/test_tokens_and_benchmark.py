"""Token files and decontamination against plain versions."""

import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quayside.llm import decontaminate, token_files
from quayside.llm._shared import shared_dir, stored

PATH = public_tokenizers.path("word_bpe_49k.json")


def written(ids, ends, doc_ids, step=100, block=64):
    out = io.BytesIO()
    w = token_files.TokenWriter(out, block=block)
    w.end_documents(doc_ids, np.array(ends))
    for k in range(0, len(ids), step):
        w.add(ids[k : k + step])
    w.close()
    return token_files.TokenFile(io.BytesIO(out.getvalue()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 49407), st.integers(0, 2**32 - 1)), max_size=1500), st.integers(0, 1499), st.integers(0, 1499))
def test_file_round_trip(ids, a, b):
    ids = np.array(ids, np.uint32)
    file = written(ids, [0, len(ids)], [3, None])
    assert (file.ids() == ids).all() and file.doc_ids == [3, None] and file.ends.tolist() == [0, len(ids)]
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert (file.ids(a, b) == ids[a:b]).all()


def test_file_in_pieces(monkeypatch):
    monkeypatch.setattr(token_files, "PIECE", 256)
    ids = np.random.default_rng(1).integers(0, 50_000, 5_003).astype(np.uint32)
    assert (written(ids, [5_003], [1], 77).ids() == ids).all()
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(b"x" * 200))


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    pieces = list(encoder(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    ids = np.concatenate([p[0] for p in pieces])
    ends = np.concatenate([e + b for (_, e), b in zip(pieces, np.cumsum([0, *[len(p[0]) for p in pieces[:-1]]]), strict=True)])
    return [ids[a : b - 1].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


ODD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab'sT 1\n\t ́İΣς<|endoftext|>\x1c\x85")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_word_by_word_is_the_same(texts):
    assert encoded(FAST, texts) == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZéÉßÿ×÷ªµ'sT19.,!<|>#-_ ÀÖØ´"), max_size=40))
def test_runs_are_the_same(text):
    assert FAST.by_word and FAST.simple
    assert encoded(FAST, [text]) == [PLAIN.encode(text, add_special_tokens=False).ids]


def test_a_tokenizer_with_spaces_in_its_tokens_sees_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = token_files.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.by_word
    texts = ["Hello  world, it's\n\n here", "", " x"]
    assert encoded(encoder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_very_long_texts_and_a_full_table(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 64)
    monkeypatch.setattr(token_files, "CACHED_WORDS", 20)
    texts = ["word " * 300 + "x" * 500 + " end", "", " a b ", "y" * 1000, "nine wörds " * 40]
    assert encoded(token_files.Encoder(PATH), texts) == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


PLAIN, FAST = Tokenizer.from_file(PATH), token_files.Encoder(PATH)


def plain_tokens(rows, order):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order.get(r[1], 0), (r[1] or "").encode())):
        ids = [*PLAIN.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return Counter(out)


def test_tokens(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = token_files.tokenise(spark, docs, PATH)
    assert Counter(tuple(r) for r in got.collect()) == plain_tokens([tuple(r) for r in docs.select("doc_id", "text").collect()], {})
    rows = [(5, "One two"), (None, "three"), (5, "a b"), (5, None), (-3, ""), (9, "x " * 5000), (5, "One two")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3)
    order = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    monkeypatch.setattr(token_files, "IDS_PER_FILE", 4)
    assert Counter(tuple(r) for r in token_files.tokenise(spark, docs, PATH).collect()) == plain_tokens(rows, order)
    assert token_files.tokenise(spark, docs.limit(0), PATH).collect() == []
    folder = shared_dir(spark, "t")
    files = stored(token_files.write_tokens(docs, folder, PATH), spark, "f")
    ids = {tuple(r.ids) for r in token_files.read_tokens(token_files.file_starts(files), folder, True).collect()}
    assert ids == {(*PLAIN.encode(t or "", add_special_tokens=False).ids, 1) for _, t in rows}


def plain_hits(rows, items, width=13):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    fold = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = fold(t)
        if i is not None:
            for k in range(max(1, len(w) - width + 1) if w else 0):
                wins.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, of = fold(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    of |= wins[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        n = sum(hit)
        out.append((d, len(w), n, len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("most", [decontaminate.AUTOMATON_BYTES, 2000])
def test_hits(spark, sf, most, monkeypatch):
    monkeypatch.setattr(decontaminate.benchmark_hits, "__defaults__", (13, most))
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    bench = [tuple(r) for r in items.collect()] + [(91, "Two words!"), (92, None), (None, "a b c"), (93, "..."), (94, "été là"), (95, "two words"), (91, "Two words!")]
    q = bench[3][1]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows += [(None, None), (-1, ""), (-2, "..."), (-3, q), (-3, q), (-3, "other"), (None, "x" + q.upper() + "x two,words " + "pad " * 3000), (-4, "Été là two-Words"), (-5, "étÉ là\x85été là"), (-6, "TWO\x01words")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, items int").repartition(3)
    bf = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contamination(spark, df, bf)
    assert Counter(tuple(r) for r in got.drop("spans").collect()) == plain_hits(rows, bench)
    for r in got.filter("n_hit > 0 and doc_id = -3").collect():
        (s,) = r.spans
        assert decontaminate.fold(q.encode()[s.begin : s.end].decode()) == decontaminate.fold(q.rstrip("."))
    assert decontaminate.contamination(spark, df.limit(0), bf).collect() == []
    assert {r.n_hit for r in decontaminate.contamination(spark, df, bf.limit(0)).collect()} == {0}


def test_clean_documents_by_row(spark):
    passage = " ".join(f"word{k}" for k in range(40))
    bench = spark.createDataFrame([("a", passage), ("b", " ".join(f"other{k}" for k in range(40)))], "item_id string, text string")
    rows = [(None, passage, 1), (None, "clean words", 2), (5, f"x {passage}", 3), (5, "clean", 4), (6, None, 5), (7, " ".join(f"other{k}" for k in range(20)), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(2)
    for most in (1 << 24, 100):
        got = decontaminate.clean_documents(spark, docs, bench, automaton_bytes=most)
        assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter([rows[1], rows[3], rows[4]])
