"""The queries of the llm operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, chat_format, decontaminate, likelihood_rules, line_crf, line_templates, minhash_forest, mixing, sql, substring_radix, substring_recompress, token_alignment, token_files, warc_zip
from ._shared import table


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_forest.jaccard_join(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copy_of", "n_copies", "n_links")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.tokenise(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_radix.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op6_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents")).drop("row")


def op7_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive(spark, table(spark, sf_dir, "pages"))


def op8_likelihood_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood_rules.quality_rules(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_recompress.remove_repeated_windows(spark, table(spark, sf_dir, "documents"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_template_lines(spark, table(spark, sf_dir, "documents"), min_tokens=1)


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(spark, table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    return chat_format.format_chats(spark, chat_format.row_records(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_minhash_forest, op2_token_files, op3_decontamination, op4_line_crf, op5_substring_dedup, op6_sainte_lague_mix, op7_warc_packages, op8_likelihood_rules, op9_recompression_dedup, op10_line_templates, op11_ball_tree, op12_token_alignment, op13_chat_format)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
