"""Search for many queries at once: words through an inverted index, vectors through inverted lists; windows of texts with a stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import closeness, index, scan, vectors
from ._tables import table
from .catalog import register

C = F.col

FIELDS = [("p_name", 8.0, True), ("p_type", 3.0, True), ("p_brand", 1.0, False)]
#: Queries made of every hundredth part: its name; name and type; the first word without its last letter; the name with the second letter of the first word missing and the last doubled.
MADE = """CASE WHEN p_partkey % 400 = 0 THEN p_name WHEN p_partkey % 400 = 100 THEN p_name || ' ' || lower(p_type) WHEN p_partkey % 400 = 200 THEN substr(split_part(p_name, ' ', 1), 1, length(split_part(p_name, ' ', 1)) - 1)
 ELSE substr(p_name, 1, 1) || substr(p_name, 3) || substr(p_name, length(p_name), 1) END"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_partkey % 100 = 0").select("p_name", F.expr(MADE).alias("query"))


_WORD = "list_max(list_transform(list_filter(string_split_regex({f}, '[^a-z0-9]+'), lambda t: t <> ''), lambda t: CASE WHEN t = w THEN 1.0 WHEN starts_with(t, w) OR starts_with(w, t) THEN 0.85 WHEN contains(t, w) THEN 0.6 WHEN length(w) >= 4 AND length(t) >= 4 AND t[1:4] = w[1:4] THEN 0.5 {fuzzy} ELSE 0.0 END))"
_NEAR = "WHEN length(w) >= 4 AND levenshtein(t, w) <= CASE WHEN length(w) >= 7 THEN 2 ELSE 1 END THEN 0.4 WHEN length(w) >= 4 AND length(t) > length(w) AND levenshtein(t[1:length(w)], w) <= CASE WHEN length(w) >= 7 THEN 2 ELSE 1 END THEN 0.35"
FOUND = f"""WITH q AS (SELECT DISTINCT lower({MADE}) AS query FROM part WHERE p_partkey % 100 = 0), w AS (SELECT query, unnest(list_distinct(list_filter(string_split_regex(query, '[^a-z0-9]+'), lambda t: t <> ''))) AS w FROM q),
    e AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b, lower(p_brand) AS c FROM part), k AS (SELECT DISTINCT a, b, c FROM e),
    s AS (SELECT query, a, b, c, w, greatest({_WORD.format(f='a', fuzzy=_NEAR)} * 8, {_WORD.format(f='b', fuzzy=_NEAR)} * 3, {_WORD.format(f='c', fuzzy='')}) AS s FROM w, k),
    t AS (SELECT query, a, b, c, round(sum(s) + CASE WHEN contains(a, query) THEN 8 ELSE 0 END, 6) AS score FROM s GROUP BY query, a, b, c HAVING min(s) > 0),
    f AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, length(a), p_partkey) AS pos, p_partkey, CAST(score AS DOUBLE) AS score FROM t JOIN e USING (a, b, c))"""


@register("search_many", FOUND + " SELECT query, CAST(pos AS INTEGER) AS pos, p_partkey, score FROM f WHERE pos <= 10")
def search_many(spark: SparkSession, d: str) -> DataFrame:
    """The ten best parts of every query that is made of a hundredth of the table, with typing errors and cut words among them."""
    return index.search(table(spark, d, "part"), "p_partkey", FIELDS, _asked(spark, d), "query")


@register(
    "search_quality",
    FOUND + f""", src AS (SELECT p_partkey, p_name, lower({MADE}) AS query FROM part WHERE p_partkey % 100 = 0), r AS (SELECT src.p_partkey, min(f.pos) AS pos FROM src LEFT JOIN (SELECT query, pos, p_name FROM f JOIN part USING (p_partkey) WHERE pos <= 10) f ON f.query = src.query AND f.p_name = src.p_name GROUP BY src.p_partkey)
    SELECT count(*) AS n_queries, round(avg(CASE WHEN pos = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN pos <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, round(avg(coalesce(1.0 / pos, 0)), 6) AS mrr, round(avg(CASE WHEN pos IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missed FROM r""",
)
def search_quality(spark: SparkSession, d: str) -> DataFrame:
    """How often a query finds a part of the name that it was made of: first, among five, and the mean reciprocal place."""
    src = table(spark, d, "part").filter("p_partkey % 100 = 0").select(C("p_partkey").alias("src"), "p_name", F.lower(F.expr(MADE)).alias("query"))
    got = search_many(spark, d).join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select("query", "p_name", "pos")
    pos = src.join(got, ["query", "p_name"], "left").groupBy("src").agg(F.min("pos").alias("pos"))
    share = lambda test: F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 6)
    return pos.agg(F.count("*").alias("n_queries"), share(C("pos") == 1).alias("hit_1"), share(C("pos") <= 5).alias("hit_5"), F.round(F.avg(F.coalesce(1.0 / C("pos"), F.lit(0.0))), 6).alias("mrr"), share(C("pos").isNull()).alias("missed"))


@register("nearest_vectors")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors with an even label of every vector whose id is divisible by 100, through inverted lists; tests measure the recall against the exact scan."""
    return vectors.nearest(spark, table(spark, d, "embeddings"), "vec_id", "embedding", C("vec_id") % 100 == 0, C("label") % 2 == 0)


@register("closest_types")
def closest_types(spark: SparkSession, d: str) -> DataFrame:
    """The three closest of all types for every name, by letter pairs or matching blocks, whichever is higher; tests compare it with all pairs."""
    part = table(spark, d, "part")
    return closeness.closest(part.select("p_name"), "p_name", part.select(F.concat_ws(" ", F.split("p_name", " ")[1], "p_type", "p_brand").alias("kind")), "kind", 3)


LONG, STOP = 400, 10
_WINDOWS = f"""WITH w AS (SELECT doc_id, k, substr(text, k * {LONG} + 1, {LONG}) AS w FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(length(text) / {LONG}.0) AS BIGINT) - 1)) AS k FROM documents WHERE length(text) > 0)),
    m AS (SELECT *, length(w) - length(replace(w, ' ', '')) < 0.13 * length(w) AS bad FROM w), r AS (SELECT *, k - coalesce(max(CASE WHEN NOT bad THEN k END) OVER (PARTITION BY doc_id ORDER BY k), -1) AS run FROM m),
    s AS (SELECT *, coalesce(min(CASE WHEN run >= {STOP} THEN k END) OVER (PARTITION BY doc_id), k) AS stop FROM r)"""


@register("windows_until_stop", _WINDOWS + " SELECT doc_id, count(*) AS n_windows, count(*) FILTER (k <= stop AND NOT bad) AS n_kept, count(*) FILTER (k > stop) AS n_unseen, md5(string_agg(CASE WHEN k <= stop AND NOT bad THEN w ELSE '' END, '' ORDER BY k)) AS kept_md5 FROM s GROUP BY doc_id")
def windows_until_stop(spark: SparkSession, d: str) -> DataFrame:
    """Windows of each text in order, until ten in a row say nothing (here: hold few spaces); those that say something are put together again. Windows of a long text are spread
    over tasks, and the runs are found by a scan across them."""
    docs = table(spark, d, "documents").filter(F.length("text") > 0)
    each = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / LONG).cast("int") - 1), lambda k: F.struct(k.alias("k"), F.substring(C("text"), k * LONG + 1, F.lit(LONG)).alias("w")))).alias("x")).select("doc_id", "x.k", "x.w")
    bad = F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) < 0.13 * F.length("w")
    rows = scan.ranged(each.withColumn("bad", bad).withColumn("_good", F.when(~bad, C("k"))), ["doc_id"], ["k"])
    runs = scan.last_so_far(rows, ["doc_id"], ["k"], "_good", "_last").withColumn("run", C("k") - F.coalesce("_last", F.lit(-1)))
    stops = runs.filter(C("run") >= STOP).groupBy("doc_id").agg(F.min("k").alias("stop"))
    seen = runs.join(stops, "doc_id", "left").withColumn("kept", (C("k") <= F.coalesce("stop", "k")) & ~C("bad"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(C("kept"), F.struct("k", "w")))), lambda x: x["w"]), "")
    return seen.groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.count_if("kept").alias("n_kept"), F.count_if(C("k") > C("stop")).alias("n_unseen"), F.md5(body.cast("binary")).alias("kept_md5"))
