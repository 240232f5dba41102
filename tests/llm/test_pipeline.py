"""The pipeline against its stages done plainly."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import test_minhash_forest as joins
import test_quality_mix_warc as mixes
import test_tokens_and_benchmark as tokens
from quayside.llm import decontaminate, line_crf, mixing, token_files
from quayside.llm._bytes import text_bytes
from quayside.llm._shared import release, small_batches, stored, whole_groups


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(7001, None, "en", "src1", 0), (7002, "", None, None, None), (None, "some words stand here", "en", "src1", 4)], docs.schema)
    docs = docs.unionByName(extra)
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, sf), spark, name)
        after = docs.collect()
        assert name == "tokens" or docs.columns == columns
        rows = [(r.doc_id, r.text) for r in before]
        if name == "good_quality":
            scores = line_crf.classify(spark, spark.createDataFrame(before, docs.schema), labels).filter("predicted = 1").collect()
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in scores) and len(after) < len(before)
        elif name == "near_copies":
            groups = {(d, g): n for d, g, _, _, n in joins.plain(rows)}
            assert Counter(r.doc_id for r in after) == Counter(d for (d, g), n in groups.items() if n == 0 or d == g)
        elif name == "decontaminated":
            bad = {x[0] for x in tokens.plain_hits(rows, [tuple(r) for r in bench.collect()]) if x[-1]}
            assert Counter(r.doc_id for r in after) == Counter(d for d, _ in rows if d not in bad) and bad
        elif name == "mixed":
            got = mixing.mix(spark, spark.createDataFrame(before, docs.schema)).collect()
            mixes.check_mix([(r.doc_id, r.source, r.text) for r in before], got)
            assert Counter(r.doc_id for r in after) == Counter({r.doc_id: (2 * r.taken + r.size) // (2 * r.size) for r in got if r.size})
            assert {(r.doc_id, r.text) for r in after} <= set(rows)
        else:
            order = {r.text: r.h for r in spark.createDataFrame(before).selectExpr("text", "xxhash64(text) AS h").collect()}
            assert Counter(tuple(r) for r in after) == tokens.plain_tokens(rows, order)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and min(r.start for r in got) == 0 and max(r.start + r.n_tokens for r in got) == sum(r.n_tokens for r in got)


def test_clean_documents_stay(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, sf).collect()}
    assert len(good & kept) >= 0.97 * len(good)
    assert not [r for r in docs.collect() if r.doc_id in kept and len(re.findall(r"\$\$\$|%%%", r.text)) > 30]


def test_odd_rows(spark, sf):
    """Null and repeated ids, repeated rows, clashing columns, a long text, empty tables: each stage decides by row."""
    dirty = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    prose = [" ".join(f"word{(k * 7 + j * j) % 997}" for j in range(60)) + "." for k in range(4)]
    rows = [(None, dirty, "a"), (None, prose[0], "a"), (5, prose[1], None), (5, dirty, None), (5, prose[1], None), (6, "x " * 200_000, "b"), (7, None, "b"), (7, "", "b")]
    schema = "doc_id long, text string, source string, _doc int, _row int, _times int, _row_key int, _bad int, _spans int, row_key int"
    docs = spark.createDataFrame([(*r, *range(7)) for r in rows], schema)
    clean = corpus_pipeline.decontaminated(spark, docs, sf)
    left = Counter((r.doc_id, r.text) for r in clean.collect())
    assert clean.columns == docs.columns and left == Counter((d, t) for d, t, _ in rows if t != dirty)
    single = corpus_pipeline.near_copies(spark, docs, sf)
    assert single.columns == docs.columns
    assert Counter(r.text for r in single.collect()) == Counter({dirty: 1, prose[0]: 1, prose[1]: 1, "x " * 200_000: 1, None: 1, "": 1})
    mixed = corpus_pipeline.mixed(spark, docs, sf)
    assert mixed.columns == docs.columns
    taken = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert taken and set(taken) <= {(d, t) for d, t, _ in rows if t} and taken[(5, prose[1])] in (2, 4, 6, 0)
    judged = corpus_pipeline.good_quality(spark, docs, sf)
    assert judged.columns == docs.columns and not Counter(tuple(r) for r in judged.collect()) - Counter(tuple(r) for r in docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []


def test_run_over_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_without_labels_no_document_is_rejected(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert line_crf.good_documents(docs, line_crf.learn(docs, labels.limit(0))).count() == docs.count()


def test_rows_reach_python_in_small_batches(spark, sf):
    """Batches of some ten thousand whole texts stayed in the memory of executors from stage to stage."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    docs = spark.range(9000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 200) AS text", "'en' AS lang", "'src1' AS source", "0 AS n_chars").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "n_bytes": [b.nbytes]})

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(limit)
            stage(spark, docs.limit(0), sf)
            got = docs.mapInArrow(sizes, "n long, n_bytes long").collect()
            assert sum(r.n for r in got) == 9000 and max(r.n_bytes for r in got) < 5 << 20
        spark.conf.set(limit, "1m")  # the session's own limit stays
        assert small_batches(spark).conf.get(limit) == "1m"
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def test_groups_of_many_batches():
    """A group is put together once, however many batches it comes in."""
    keys = [0] * 3 + [1] * 40 + [2, 3, 3]
    rows = pa.table({"k": pa.array(keys, pa.int64()), "v": list(range(len(keys)))})
    got = list(whole_groups(iter(rows.to_batches(max_chunksize=2)), ["k"]))
    assert [v for t, cuts in got for i, j in zip(cuts[:-1], cuts[1:], strict=True) for v in [t.column("v").to_pylist()[i:j]]] == [list(range(3)), list(range(3, 43)), [43], [44, 45]]


def test_an_operator_leaves_no_memory_to_the_next(spark):
    """A worker that encodes has let the automaton go, and keeps its own words; the one that decontaminates keeps its automaton."""
    import public_tokenizers

    found = decontaminate.automaton([("a", "one two three")], 13)
    assert found is not None and decontaminate._automata
    decontaminate.make_room()
    assert decontaminate._automata
    encode = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    list(encode(*text_bytes(pa.array(["some words stand here " * 10]))))
    known = len(encode.table.keys)
    release(keep=(encode.runs, encode.table))
    assert not decontaminate._automata and len(encode.table.keys) == known > 0


def test_texts_are_encoded_in_small_slices():
    """What a worker holds beside its batch goes with the slice."""
    import public_tokenizers

    texts = [f"word{k} stands here, the {k % 97}th. " * 40 for k in range(3000)] + ["x1 " * 900_000, "", "end"]
    encode = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    data, at = text_bytes(pa.array(texts))
    got = [(ids, ends) for ids, ends in encode(data, at)]
    assert max(len(ids) for ids, _ in got) < 1 << 19
    plain = [x for t in texts for x in (*encode.tokenizer.encode(t, add_special_tokens=False).ids, 1)]
    assert np.concatenate([ids for ids, _ in got]).tolist() == plain and sum(len(e) for _, e in got) == len(texts)
