"""Search of many queries at once through an inverted index of words.

Entries have weighted fields of text. The distinct words of queries and of fields meet by keys: prefixes of either, short grams, the first four letters, and what is left after
deleting up to two letters, so that every pair that scores shares a key and few others do. A pair's score is then computed once, a field's text takes the best score of its words, and only
entries that hold such a text are summed for a query. All words of a query have to be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != ""))


def _less_one(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substr(s, i + 1)))


def _deletions(s: Column, two: Column | bool = True) -> Column:
    """s, and s without one letter and, where `two` says so, without two."""
    one = F.when(F.length(s) > 1, _less_one(s)).otherwise(F.array().cast("array<string>"))
    more = F.flatten(F.transform(one, lambda x: F.when(F.length(x) > 1, _less_one(x)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(s), one, more if two is True else F.when(two, more).otherwise(F.array().cast("array<string>"))))


def _prefixes(s: Column, least: int = 1) -> Column:
    return F.when(F.length(s) >= least, F.transform(F.sequence(F.lit(least), F.length(s)), lambda n: F.substring(s, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def _tagged(tag: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(tag), k))


def _keys_of_words(w: Column) -> Column:
    n = F.length(w)
    none = F.array().cast("array<string>")
    return F.concat(
        F.array(F.concat(F.lit("p"), w)), _tagged("q", _prefixes(w)), F.array(F.concat(F.lit("g"), F.substring(w, 1, 3))), F.when(n >= 4, F.array(F.concat(F.lit("s"), F.substring(w, 1, 4)))).otherwise(none), F.when(n >= 4, _tagged("d", _deletions(w, n >= 7))).otherwise(none),
    )


def _keys_of_tokens(t: Column) -> Column:
    n = F.length(t)
    none = F.array().cast("array<string>")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), n - i + 1)), lambda k: F.substring(t, i, k))))
    cut = F.flatten(F.transform(_prefixes(t, 4), lambda p: _deletions(p)))
    return F.array_distinct(F.concat(_tagged("p", _prefixes(t)), F.array(F.concat(F.lit("q"), t)), _tagged("g", grams), F.when(n >= 4, F.array(F.concat(F.lit("s"), F.substring(t, 1, 4)))).otherwise(none), _tagged("d", F.array_distinct(F.concat(_deletions(t), cut)))))


def pair_score(w: Column, t: Column, fuzzy: Column) -> Column:
    """1 for equal words; .85 where one begins the other; .6 where the token holds the word; .5 where they agree in four letters; for fuzzy fields and words of four letters and more .4
    within the edits that the word's length allows, .35 where that holds for as much of a longer token as the word has."""
    n = F.length(w)
    slack = F.when(n >= 7, 2).otherwise(1)
    near = F.when(F.levenshtein(t, w) <= slack, 0.4).when((F.length(t) > n) & (F.levenshtein(F.substring(t, F.lit(1), n), w) <= slack), 0.35)
    return (
        F.when(t == w, 1.0).when(t.startswith(w) | w.startswith(t), 0.85).when(t.contains(w), 0.6).when((n >= 4) & (F.length(t) >= 4) & (F.substring(t, 1, 4) == F.substring(w, 1, 4)), 0.5).when(fuzzy & (n >= 4), near)
    )


def search(entries: DataFrame, id_col: str, fields: list[tuple[str, float, bool]], queries: DataFrame, query: str, k: int = 10, phrase: float = 8.0) -> DataFrame:
    """query, pos from 1, the id and the score of the k best entries of each distinct query; the first field is the title. fields: (column, weight, fuzzy). Ties go to shorter titles, then
    smaller ids."""
    names = [c for c, _, _ in fields]
    texts = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"_f{i}") for i, c in enumerate(names)]
    kinds = [f"_f{i}" for i in range(len(names))]
    rows = entries.select(F.col(id_col).alias("_id"), *texts)
    # Entries of one text in all fields score alike: a class has its k smallest ids, for no more can be among the best.
    nth = F.row_number().over(W.partitionBy(*kinds).orderBy("_id"))
    members = rows.withColumn("_n", nth).filter(F.col("_n") <= k).drop("_n")
    classes = rows.select(*kinds).distinct()
    field = None
    for i, (_, weight, fuzzy) in enumerate(fields):
        own = classes.select(F.lit(i).alias("field"), F.lit(float(weight)).alias("weight"), F.lit(fuzzy).alias("fuzzy"), F.col(f"_f{i}").alias("text")).distinct()
        field = own if field is None else field.unionByName(own)
    postings = field.select("*", F.explode(tokens(F.col("text"))).alias("token"))
    asked = queries.select(F.lower(F.col(query)).alias("query")).filter("query IS NOT NULL").distinct()
    words = asked.select("query", F.explode(tokens(F.col("query"))).alias("word"))
    left = words.select("word").distinct().select("word", F.explode(F.array_distinct(_keys_of_words(F.col("word")))).alias("key"))
    right = postings.select("token").distinct().select("token", F.explode(_keys_of_tokens(F.col("token"))).alias("key"))
    pairs = left.join(right, "key").select("word", "token").distinct()
    scored = pairs.join(postings, "token").select("word", "field", "text", (pair_score(F.col("word"), F.col("token"), F.col("fuzzy")) * F.col("weight")).alias("s")).filter("s IS NOT NULL")
    best = scored.groupBy("word", "field", "text").agg(F.max("s").alias("s"))
    hits = None
    for i in range(len(fields)):
        own = best.filter(F.col("field") == i).select("word", "s", F.col("text").alias(f"_f{i}")).join(classes, f"_f{i}").select("word", "s", *kinds)
        hits = own if hits is None else hits.unionByName(own)
    each = hits.groupBy("word", *kinds).agg(F.max("s").alias("s"))
    n_words = words.groupBy("query").agg(F.count("*").alias("_n"))
    total = words.join(each, "word").groupBy("query", *kinds).agg(F.sum("s").alias("s"), F.count("*").alias("_m")).join(n_words, "query").filter("_m = _n")
    score = F.round(F.col("s") + F.when(F.col("_f0").contains(F.col("query")), phrase).otherwise(0.0), 6)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), F.length("_f0"), "_id"))
    found = total.select("query", *kinds, score.alias("score")).join(members, kinds)
    return found.withColumn("pos", place).filter(F.col("pos") <= k).select("query", "pos", F.col("_id").alias(id_col), "score")
