"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quayside.llm import _exchange, queries, token_alignment
from quayside.llm._shared import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PLAIN_A = Tokenizer.from_file(A)
PLAIN_A.encode_special_tokens = True
PLAIN_B = sentencepiece.SentencePieceProcessor(model_file=B)
BACK = token_alignment.byte_of_character()


def plain_tokens(text):
    """(id, begin, end) of A and of B, or None."""
    if not text:
        return None
    sides = []
    ids = PLAIN_A.encode(" " + text, add_special_tokens=False).ids
    sides.append([(i, bytes(BACK[c] for c in PLAIN_A.id_to_token(i))) for i in ids])
    sides.append([(i, bytes([int(PLAIN_B.id_to_piece(i)[3:5], 16)]) if PLAIN_B.is_byte(i) else PLAIN_B.id_to_piece(i).replace("▁", " ").encode()) for i in PLAIN_B.encode(text)])
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
        return None
    out = []
    for side in sides:
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def plain_align(rows):
    held, links = [], {}
    counts = Counter()
    for n, (_, text) in enumerate(rows):
        tokens = plain_tokens(text)
        held.append(tokens)
        if tokens:
            a, b = tokens
            links[n], k = [], 0
            for i, s, e in a:
                while b[k][2] <= s:
                    k += 1
                j = k
                while j < len(b) and b[j][1] < e:
                    links[n].append((i, b[j][0]))
                    j += 1
            counts.update(set(links[n]))
    best = {}
    for (a, _), c in counts.items():
        best[a] = max(best.get(a, 0), c)
    out = []
    for n, (doc, _) in enumerate(rows):
        if held[n] is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = held[n]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if before <= s < c) for side in (a, b)))
            before = c
        own = links[n]
        out.append((doc, len(a), len(b), len(groups), len(own), sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


ODD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tab'sT1.\r  　▁éłЖ漢<|endoftext|><s>\x1c\x85")), max_size=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_chunks_give_the_tokens_of_whole_texts(texts):
    both = token_alignment.tokenizers(A, B)
    assert both.by_chunk and both.fast is not None
    raw = [t.encode() for t in texts]

    class Held:
        ids, data, at = np.arange(len(texts)), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])

    x = token_alignment.Batch(Held, both, token_alignment.Line())
    want = plain_align(list(enumerate(texts)))
    doc, chunk, n = x.uses()
    for column, k in ((x.n_a, 1), (x.n_b, 2), (x.n_groups, 3), (x.n_links, 4)):
        assert np.bincount(doc, column[chunk] * n, len(texts)).tolist() == [w[k] for w in want]
    assert x.digests() == [w[7] for w in want]


def test_rows(spark):
    rng = np.random.default_rng(3)
    words = ["the", "Ångström", "naïve", "x1", "foo-bar", "漢字", "don't", "▁", "ﬁ", "(a)", "über", "😀"]
    rows = [(i, " ".join(rng.choice(words[:7] + words[8:], 12))) for i in range(60)] + [(60, None), (61, ""), (62, "a ▁ b"), (None, "the naïve"), (63, " lead  two\n\nlines \n"), (64, "\n"), (65, " "), (66, "<|endoftext|> <s></s><0x41>")]
    rows += [(67, "copy of the text")] * 3 + [(68, "w" * 3000), (69, "the   naïve　 x\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("batch", F.lit(1)).withColumn("n", F.lit("x")).repartition(4)
    got = token_alignment.align(spark, df, A, B, batch_bytes=2000, bucket_bytes=500)
    assert got.columns == [c.split(" ")[0] for c in token_alignment.RESULT.split(", ")]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_align(rows), key=key)
    assert token_alignment.align(spark, df.filter("doc_id > 1000"), A, B).collect() == []


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, queries.queries()["op12_token_alignment"](spark, sf).collect())) == sorted(plain_align(rows))


@pytest.mark.parametrize("grow", [1 << 30, 1 << 10])
def test_batches_of_several_files_and_many_buckets(spark, grow):
    rows = [(i, f"text {i % 40} " * (1 + i % 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    x = _exchange.Exchange(spark, df, batch_bytes=1500, bucket_bytes=256, grow=grow)
    files = [len(r.file.split(",")) for r in x.batches.collect()]
    assert max(files) > 1 if grow == 1 << 10 else set(files) == {1}

    def words(t):
        found, n = np.unique(token_alignment.word_hashes(t.data, t.at[:-1], t.at[1:]), return_counts=True)
        t.save(n=n)
        return found, [n]

    x.ask(words, token_alignment._sum, ["i8"])
    x.ask(lambda t: (words(t)[0], [t.longs(0), t.saved(0)["n"]]), lambda first, v: np.add.reduceat(v[1], first) == v[0][first], ["i8", "u2"], (0,))

    def out(t):
        import pyarrow as pa

        assert t.bits(1).all()
        return pa.RecordBatch.from_pydict({"n": [int((t.longs(0) == 10).sum())], "m": [len(t.bits(1))]})

    got = x.result(out, "n long, m long", (0, 1)).collect()
    assert sum(r.m for r in got) > 40 and all(r.n <= r.m for r in got)
