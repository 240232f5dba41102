"""Quality rules and a log-likelihood ratio test, in DataFrame operations only.

Words and pairs of neighbouring words are hashed into `n_buckets` buckets, a fixed parameter: a document's verdict depends on the counts
alone and not on how large the corpus is. Two multinomials over the buckets, of the trusted documents and of the whole raw corpus, give each bucket
the weight log(p_trusted / p_raw). Both are smoothed by `PRIOR` occurrences that follow the raw share of trusted text, so a
bucket seen a few times weighs little. A document's score is the mean weight of its words and pairs; at `threshold` or above it is kept, unless a base rule
fails. Every word and pair of every document is counted; a task sums its own by bucket before the shuffle. The weights have a proven size, four bytes a bucket, so they go to all tasks as one array.

Cases: null and empty texts have no words and fail the base rules; without trusted documents all weights are the
same and every document's score is 0; labels of absent documents are ignored, a document with several
labels is trusted if one of them is good; scores are rounded to six places, so that the order of sums doesn't matter, and one equal to the threshold is kept; rows repeat in the result as in the input, and each counts in the raw corpus;
a very long text is one row of its task, and needs memory for its words' hashes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import stored

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
THRESHOLD = -0.2
PRIOR = 16
N_BUCKETS = 1 << 20
#: Weights are gathered in arrays of so many buckets.
CELLS = 1 << 16
#: Up to so many trusted ids, 8 bytes each, are sent to all tasks; beyond, texts and ids meet by a shuffle.
SENT_IDS = 1 << 20
SPACES = " \t\n\x0b\f\r"
REPEAT = 8


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def text_counts(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def paired(hashes: Column, step: int) -> Column:
    """A hash of each element and the one `step` places on; the last `step` elements drop out."""
    return F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + step)))


def repeated_words(pairs: Column) -> Column:
    """The words in windows of 8 that are found twice or more, from the hashes of neighbouring pairs. Windows are
    sorted by hash; the places of those with an equal neighbour, sorted, give the words that they cover."""
    def over(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(ranked, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])))
        total = let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(REPEAT), F.coalesce(F.get(p, k + 1) - x, F.lit(REPEAT)))), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(total).cast("long")

    return let(let(pairs, lambda p: let(paired(p, 2), lambda q: paired(q, 4))), over)


def gram_hashes(words: Column) -> Column:
    """Hashes of all words and pairs."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(h, paired(h, 1)))


def bucket_counts(docs: DataFrame, trusted: DataFrame, n_buckets: int = N_BUCKETS, sent_ids: int = SENT_IDS) -> DataFrame:
    """bucket, raw and good: how often all documents and the trusted ones have each bucket that occurs. trusted: doc_id of trusted
    documents."""
    good = trusted.select(F.col("doc_id").cast("long").alias("_good")).dropna().distinct()
    good = F.broadcast(good) if good.count() <= sent_ids else good.hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(good, F.col("doc_id") == F.col("_good"), "left")
    each = rows.select(F.col("_good").isNotNull().cast("long").alias("good"), F.explode(gram_hashes(word_array(F.col("text")))).alias("hash"))
    return stored(each.groupBy(F.pmod("hash", F.lit(n_buckets)).alias("bucket")).agg(F.count("*").alias("raw"), F.sum("good").alias("good")), docs.sparkSession, "bucket-counts")


def bucket_weights(counts: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """One row, w: the weights of all buckets in order, as 32-bit floats. They are gathered in arrays of CELLS buckets first."""
    raw, good = (x or 0 for x in counts.agg(F.sum("raw"), F.sum("good")).first())
    share = good / raw if raw else 0.0
    weight = F.log((F.col("good") + PRIOR * share) / (F.col("raw") + PRIOR)) - math.log(share) if share else F.lit(0.0)
    own = counts.select("bucket", weight.alias("w"))
    every = counts.sparkSession.range(n_buckets).withColumnRenamed("id", "bucket").join(own, "bucket", "left").select("bucket", F.coalesce("w", F.lit(0.0)).cast("float").alias("w"))
    ordered = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "w"))), lambda x: x["w"])
    cells = every.groupBy(F.floor(F.col("bucket") / CELLS).alias("cell")).agg(ordered("bucket").alias("w"))
    return stored(cells.agg(F.flatten(ordered("cell")).alias("w")), counts.sparkSession, "bucket-weights")


def score(docs: DataFrame, weights: DataFrame, n_buckets: int = N_BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, score (null without words) and kept. weights: as bucket_weights gives them.

    A text is read once: its words' and pairs' buckets become rows, which meet the array of weights, and are summed by doc_id and a hash of the
    text before anything moves. Rows equal in both come out as often as they went in."""
    table = weights.scalar()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def over(words: Column) -> Column:
        both = lambda h, p: F.struct(F.size(words).cast("long").alias("n"), repeated_words(p).alias("repeat"), F.concat(h, p).alias("hashes"))
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(paired(h, 1), lambda p: both(h, p)))

    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key"), *[c.alias(k) for k, c in text_counts(text).items()], let(word_array(text), over).alias("_x"))
    rows = rows.select("doc_id", "_key", F.col("_x.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_x.repeat").alias("n_repeat_words"), F.posexplode_outer("_x.hashes").alias("_pos", "_hash"))
    each = rows.select("doc_id", "_key", *counts, F.coalesce("_pos", F.lit(0)).alias("_pos"), F.get(table, F.pmod("_hash", F.lit(n_buckets)).cast("int")).cast("double").alias("_w"))
    made = each.groupBy("doc_id", "_key").agg(*[F.max(c).alias(c) for c in counts], F.round(F.avg("_w"), 6).alias("score"), F.count_if(F.col("_pos") == 0).alias("_times"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    made = made.select("doc_id", *counts, "score", failed.alias("base_failed"), (~failed & F.coalesce(F.col("score") >= threshold, F.lit(False))).alias("kept"), F.explode(F.expr("sequence(1, cast(_times AS int))")).alias("_n"))
    return made.drop("_n")


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n_buckets: int = N_BUCKETS) -> DataFrame:
    """Trusted: documents labelled as good."""
    weights = bucket_weights(bucket_counts(docs, labels.filter("quality = 1"), n_buckets), n_buckets)
    return score(docs, weights, n_buckets, threshold)
