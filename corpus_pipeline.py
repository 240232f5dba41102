"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.

Cases: an empty table gives no rows at any stage; a null text is an empty one; rows with a null or repeated doc_id each stand for themselves; of equal rows one stays (near_copies), ties between
copies go to the smaller doc_id; very long texts are read whole by the task that has them; other columns may have any names, also those that stages use themselves; without any label no
document is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import decontaminate, line_crf, minhash_forest, mixing, token_files
from quayside.llm._shared import forget, small_batches, stored, table
from quayside.ship import ship


def ready(spark: SparkSession) -> SparkSession:
    """Executors have the package, and rows reach Python in small batches: what five stages leave behind in one executor adds up."""
    return small_batches(ship(spark))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go. It learns from the labels of the documents at hand."""
    return line_crf.good_documents(docs, line_crf.learn(docs, table(ready(spark), sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return minhash_forest.one_of_each_group(ready(spark), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words are in benchmark passages go."""
    return decontaminate.clean_documents(ready(spark), docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times."""
    return mixing.mixed_documents(ready(spark), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return token_files.tokenise(ready(spark), docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("good_quality", good_quality), ("near_copies", near_copies), ("decontaminated", decontaminated), ("mixed", mixed), ("tokens", tokens),
]

#: SQL can't express the classifier, the tokenizer or the mix; tests/llm compares stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), spark, f"pipeline-{name}")
        forget(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
