"""Vector and text search: filtered cosine top-k, pages without duplicates, tiered word scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def score_against(rows: DataFrame, vector: str, query: DataFrame, digits: int = 6) -> DataFrame:
    """Adds score against the one vector of `query`, which is a scalar subquery: no join."""
    with_query = rows.withColumn("_q", query.scalar())
    return with_query.withColumn("score", F.round(cosine(F.col(vector), F.col("_q")), digits)).drop("_q")


def top(scored: DataFrame, k: int, tie: str, offset: int = 0) -> DataFrame:
    """Ordered by score, then id, and cut: each task keeps k + offset rows only."""
    return scored.orderBy(F.col("score").desc(), F.col(tie)).offset(offset).limit(k) if offset else scored.orderBy(F.col("score").desc(), F.col(tie)).limit(k)


def best_of_duplicates(scored: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """One row of each key, the best; before any paging."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), tie))
    return scored.withColumn("_n", nth).filter("_n = 1").drop("_n")


def word_score(word: Column, tokens: Column, field: Column, fuzzy: bool = True) -> Column:
    """How well a word meets a field: 1 for an equal token; else .85 where one of word and token begins the other, .6 where a token or the field holds the
    word; else .5 where they agree in four letters from the left; else, for words of four letters and more, .4 for a token within the edits that the
    word's length allows (two from seven letters on), or .35 where that holds for as much of a longer token as the word has."""
    slack = F.when(F.length(word) >= 7, 2).otherwise(1)
    near = lambda t: F.levenshtein(t, word) <= slack
    any_ = lambda test: F.exists(tokens, test)
    last = F.when(F.length(word) < 4, 0.0).when(any_(near), 0.4).when(any_(lambda t: (F.length(t) > F.length(word)) & near(F.substring(t, F.lit(1), F.length(word)))), 0.35).otherwise(0.0)
    return (
        F.when(F.array_contains(tokens, word), 1.0).when(any_(lambda t: t.startswith(word) | word.startswith(t)), 0.85).when(any_(lambda t: t.contains(word)) | field.contains(word), 0.6)
        .when((F.length(word) >= 4) & any_(lambda t: (F.length(t) >= 4) & (F.substring(t, 1, 4) == F.substring(word, 1, 4))), 0.5).otherwise(last if fuzzy else F.lit(0.0))
    )


def entry_score(words: list[str], fields: list[tuple[Column, float]], phrase: str) -> Column:
    """Sum over the words of the best field, weighted; 8 more if the first field holds the phrase; 0 if any word finds nothing."""
    each = [F.greatest(*[word_score(F.lit(w), F.filter(F.split(f, "[^\\p{L}\\p{N}]+"), lambda t: t != ""), f) * weight for f, weight in fields], F.lit(0.0)) for w in words]
    total = sum(each[1:], each[0])
    missed = F.least(*each, F.lit(1e9)) == 0
    return F.when(missed, 0.0).otherwise(total + F.when(fields[0][0].contains(phrase), 8.0).otherwise(0.0))
