"""Search queries: cosine top-k, pages, tiered text scores; and comparison tables in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, ordering, search, tables
from ._tables import table
from .catalog import register

COS = "CAST(round(CAST(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS DECIMAL(20,12)), 6) AS DOUBLE)"
STRIP = "regexp_replace(text, '^[\\t\\n\\v\\f\\r ]+|[\\t\\n\\v\\f\\r ]+$', '', 'g')"


@register(
    "search_active_topk",
    f"""WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY substr(sha256({STRIP}), 1, 16) ORDER BY doc_id) AS rn FROM documents WHERE lang = 'en' AND n_chars >= 250)
    SELECT d.doc_id, d.lang, {COS} AS score FROM d JOIN embeddings e ON e.vec_id = d.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE rn = 1 ORDER BY score DESC, doc_id LIMIT 8""",
)
def search_active_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight closest distinct documents of a language to a fixed vector: filter, distinct texts, score, cut."""
    docs = table(spark, d, "documents").filter("lang = 'en' AND n_chars >= 250").select("doc_id", "lang", X.text_hash(F.col("text")).alias("h"))
    distinct = dedup.first_of(docs, ["h"], [F.col("doc_id")]).select("doc_id", "lang")
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    query = vectors.filter("vec_id = 0").select("embedding")
    scored = search.score_against(distinct.join(vectors, F.col("doc_id") == F.col("vec_id")), "embedding", query)
    return search.top(scored.select("doc_id", "lang", "score"), 8, "doc_id")


@register("cosine_topk", f"SELECT e.vec_id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY score DESC, e.vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return search.top(search.score_against(v, "embedding", v.filter("vec_id = 3").select("embedding")).select("vec_id", "score"), 20, "vec_id")


@register("cosine_topk_filtered", f"SELECT e.vec_id, e.label, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.label IN (1, 2, 3) AND e.vec_id % 10 <> 0 ORDER BY score DESC, e.vec_id LIMIT 20")
def cosine_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Tenant and expiry conditions reach the scan, before any score."""
    v = table(spark, d, "embeddings")
    own = v.filter("label IN (1, 2, 3) AND vec_id % 10 != 0")
    return search.top(search.score_against(own, "embedding", v.filter("vec_id = 3").select("embedding")).select("vec_id", "label", "score"), 20, "vec_id")


@register("paged_topk", f"WITH s AS (SELECT e.vec_id, e.label, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q), b AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id // 3 ORDER BY score DESC, vec_id) AS rn FROM s) SELECT vec_id, label, score FROM b WHERE rn = 1 ORDER BY score DESC, vec_id LIMIT 5 OFFSET 10")
def paged_topk(spark: SparkSession, d: str) -> DataFrame:
    """Page three, five rows each, of what is left after duplicates are gone."""
    v = table(spark, d, "embeddings")
    scored = search.score_against(v, "embedding", v.filter("vec_id = 3").select("embedding")).select("vec_id", "label", "score", F.floor(F.col("vec_id") / 3).alias("g"))
    return search.top(search.best_of_duplicates(scored, ["label", "g"], "vec_id").drop("g"), 5, "vec_id", 10)


@register(
    "label_centroid_scores",
    "WITH x AS (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2) SELECT label, count(*) AS dims, CAST(round(CAST(sqrt(sum(m * m)) AS DECIMAL(20,10)), 5) AS DOUBLE) AS norm FROM c GROUP BY label",
)
def label_centroid_scores(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    return each.groupBy("label").agg(F.count("*").alias("dims"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))).cast("decimal(20,10)"), 5).cast("double").alias("norm"))


@register("embedding_dimensions", "SELECT len(embedding) AS dims, count(*) AS n, bool_and(len(embedding) = 64) AS fits FROM embeddings GROUP BY 1")
def embedding_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """A collection refuses vectors of another size; here are the sizes there are."""
    return table(spark, d, "embeddings").groupBy(F.size("embedding").cast("long").alias("dims")).agg(F.count("*").alias("n"), F.bool_and(F.size("embedding") == 64).alias("fits"))


def _field_sql(f: str, w: str, weight: int) -> str:
    t = f"list_filter(string_split_regex({f}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    slack, n = 2 if len(w) >= 7 else 1, len(w)
    has = lambda test: f"len(list_filter({t}, lambda t: {test})) > 0"
    typo = f"WHEN {has(f'levenshtein(t, {chr(39)}{w}{chr(39)}) <= {slack}')} THEN 0.4 WHEN {has(f'length(t) > {n} AND levenshtein(substr(t, 1, {n}), {chr(39)}{w}{chr(39)}) <= {slack}')} THEN 0.35" if n >= 4 else ""
    stem = f"WHEN {has(f'length(t) >= 4 AND substr(t, 1, 4) = {chr(39)}{w[:4]}{chr(39)}')} THEN 0.5" if n >= 4 else ""
    return f"(CASE WHEN list_contains({t}, '{w}') THEN 1.0 WHEN {has(f'starts_with(t, {chr(39)}{w}{chr(39)}) OR starts_with({chr(39)}{w}{chr(39)}, t)')} THEN 0.85 WHEN contains({f}, '{w}') THEN 0.6 {stem} {typo} ELSE 0.0 END) * {weight}"


_WORDS = [f"greatest({_field_sql('name', w, 8)}, {_field_sql('brand', w, 3)}, {_field_sql('kind', w, 1)}, 0.0)" for w in ("small", "boltt")]


@register(
    "tiered_text_search",
    f"""WITH f AS (SELECT p_partkey, lower(p_name) AS name, regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') AS brand, lower(p_type) AS kind FROM part), s AS (SELECT p_partkey, {_WORDS[0]} AS a, {_WORDS[1]} AS b, CASE WHEN contains(name, 'small boltt') THEN 8.0 ELSE 0.0 END AS phrase FROM f)
    SELECT p_partkey, CAST(round(CAST(a + b + phrase AS DECIMAL(20,8)), 4) AS DOUBLE) AS score FROM s WHERE a > 0 AND b > 0""",
)
def tiered_text_search(spark: SparkSession, d: str) -> DataFrame:
    """Every word must find a field; exact, prefix, substring, typo and stem tiers; fields weigh 8, 3 and 1."""
    part = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", " ").alias("brand"), F.lower("p_type").alias("kind"))
    score = search.entry_score(["small", "boltt"], [(F.col("name"), 8.0), (F.col("brand"), 3.0), (F.col("kind"), 1.0)], "small boltt")
    return part.select("p_partkey", F.round(score.cast("decimal(20,8)"), 4).cast("double").alias("score")).filter("score > 0")


@register("fuzzy_id_match", "WITH q AS (SELECT DISTINCT p_brand || 'x' AS asked FROM part), c AS (SELECT DISTINCT p_brand AS brand FROM part), m AS (SELECT asked, brand, count(*) OVER (PARTITION BY asked) AS n FROM q JOIN c ON levenshtein(asked, brand) <= 1) SELECT asked, brand FROM m WHERE n = 1")
def fuzzy_id_match(spark: SparkSession, d: str) -> DataFrame:
    """A near match is taken only when it is the only one. Candidates share one of the strings that deleting one letter leaves, an equality join:
    strings within one edit always do."""
    brand = table(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    asked = brand.select(F.concat("brand", F.lit("x")).alias("asked"))
    cut = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1000))))))
    pairs = asked.select("asked", F.explode(cut(F.col("asked"))).alias("k")).join(brand.select("brand", F.explode(cut(F.col("brand"))).alias("k")), "k").select("asked", "brand").distinct()
    near = pairs.filter(F.levenshtein("asked", "brand", 1) >= 0)
    return near.withColumn("n", F.count("*").over(W.partitionBy("asked"))).filter("n = 1").select("asked", "brand")


# Comparison tables in long form: a table for each market segment, a row for each nation, columns from aggregates.
CELLS_SQL = """WITH b AS (SELECT c_mktsegment AS table_id, c_nationkey AS bank, count(*) AS n, max(c_acctbal) AS top, min(c_acctbal) AS low FROM customer GROUP BY 1, 2),
    cells AS (SELECT table_id, bank, 'durum' AS col, 1 AS pos, CASE WHEN n % 4 = 0 THEN 'yok' WHEN n % 7 = 0 THEN '' ELSE 'Var' END AS value FROM b WHERE table_id <> 'MACHINERY'
      UNION ALL SELECT table_id, bank, 'adet', 2, CASE WHEN n % 4 = 0 THEN '-' ELSE CAST(n AS VARCHAR) END FROM b UNION ALL SELECT table_id, bank, 'not', 3, CASE WHEN low < -900 THEN 'sunulmuyor' WHEN low < 0 THEN '' ELSE 'pozitif' END FROM b)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("table_id"), F.col("c_nationkey").alias("bank")).agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low"))
    cell = lambda c, p, v: F.struct(F.lit(c).alias("col"), F.lit(p).alias("pos"), v.alias("value"))
    status = cell("durum", 1, F.when(F.col("n") % 4 == 0, "yok").when(F.col("n") % 7 == 0, "").otherwise("Var"))
    rest = [cell("adet", 2, F.when(F.col("n") % 4 == 0, "-").otherwise(F.col("n").cast("string"))), cell("not", 3, F.when(F.col("low") < -900, "sunulmuyor").when(F.col("low") < 0, "").otherwise("pozitif"))]
    all_ = F.when(F.col("table_id") != "MACHINERY", F.array(status, *rest)).otherwise(F.array(*rest))
    return b.select("table_id", "bank", F.inline(all_))


YES_SQL, NO_SQL = "('var', 'sunuluyor', 'evet')", "('yok', 'sunulmuyor', 'hayır', '-')"


@register("status_column", CELLS_SQL + f", k AS (SELECT table_id, col, min(pos) AS pos, bool_and(lower(trim(value)) IN {YES_SQL} OR lower(trim(value)) IN {NO_SQL}) AS v, bool_or(lower(trim(value)) IN {YES_SQL}) AS y FROM cells WHERE trim(value) <> '' GROUP BY 1, 2) SELECT table_id, arg_min(col, pos) AS col FROM k WHERE v AND y GROUP BY table_id")
def status_column(spark: SparkSession, d: str) -> DataFrame:
    return tables.status_columns(_cells(spark, d))


OFFERS_SQL = CELLS_SQL + f""", k AS (SELECT table_id, col, min(pos) AS pos, bool_and(lower(trim(value)) IN {YES_SQL} OR lower(trim(value)) IN {NO_SQL}) AS v, bool_or(lower(trim(value)) IN {YES_SQL}) AS y FROM cells WHERE trim(value) <> '' GROUP BY 1, 2), s AS (SELECT table_id, arg_min(col, pos) AS status FROM k WHERE v AND y GROUP BY 1),
    r AS (SELECT c.table_id, bank, bool_or(CASE WHEN col = status AND trim(value) <> '' THEN lower(trim(value)) IN {YES_SQL} END) AS said, count(*) FILTER (trim(value) <> '') AS filled, count(*) FILTER (lower(trim(value)) IN {NO_SQL}) AS neg FROM cells c LEFT JOIN s USING (table_id) GROUP BY 1, 2),
    o AS (SELECT table_id, bank, CASE WHEN said IS NOT NULL THEN said WHEN filled = 0 THEN NULL WHEN filled = neg THEN false ELSE true END AS offers FROM r)"""


@register("offers_3vl", OFFERS_SQL + " SELECT table_id, bank, offers FROM o")
def offers_3vl(spark: SparkSession, d: str) -> DataFrame:
    """True, false or unknown; unknown never becomes false."""
    return tables.offers(_cells(spark, d))


@register("drawn_rows", OFFERS_SQL + f" SELECT o.table_id, o.bank FROM o WHERE coalesce(offers, true) AND EXISTS (SELECT 1 FROM cells c WHERE c.table_id = o.table_id AND c.bank = o.bank AND c.col <> 'durum' AND lower(trim(value)) NOT IN {NO_SQL} AND trim(value) <> '')")
def drawn_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are shown: not refused, with content."""
    cells = _cells(spark, d)
    content = cells.filter("col != 'durum'").filter(tables.blank(F.col("value")).isNotNull()).select("table_id", "bank").distinct()
    return tables.offers(cells).filter(F.coalesce("offers", F.lit(True))).select("table_id", "bank").join(content, ["table_id", "bank"], "left_semi")


@register("infer_column_type", CELLS_SQL + " SELECT table_id, col, CASE WHEN bool_and(regexp_matches(value, '^(true|false)$')) THEN 'bool' WHEN bool_and(regexp_matches(value, '^-?[0-9]+(\\.[0-9]+)?$')) THEN 'number' WHEN bool_and(regexp_matches(value, '^https?://')) THEN 'link' WHEN bool_and(regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')) THEN 'date' ELSE 'text' END AS type, count(*) AS n FROM cells WHERE value <> '' AND value <> '-' GROUP BY 1, 2")
def infer_column_type(spark: SparkSession, d: str) -> DataFrame:
    return tables.column_types(_cells(spark, d).filter("value != '-'"))


@register("empty_columns", CELLS_SQL + f" SELECT table_id, col, count(*) FILTER (trim(value) <> '' AND lower(trim(value)) NOT IN {NO_SQL}) AS filled, count(*) AS n FROM cells GROUP BY 1, 2")
def empty_columns(spark: SparkSession, d: str) -> DataFrame:
    own = tables.blank(F.col("value"))
    return _cells(spark, d).groupBy("table_id", "col").agg(F.count(own).alias("filled"), F.count("*").alias("n"))


@register("not_offered_cleanup", CELLS_SQL + f" SELECT table_id, count(*) FILTER (lower(trim(value)) IN {NO_SQL} AND trim(value) <> '-') AS rewritten, count(DISTINCT bank) AS n_rows FROM cells GROUP BY 1")
def not_offered_cleanup(spark: SparkSession, d: str) -> DataFrame:
    own = F.lower(F.trim("value"))
    return _cells(spark, d).groupBy("table_id").agg(F.count_if(own.isin(*tables.NO) & (F.trim("value") != "-")).alias("rewritten"), F.count_distinct("bank").alias("n_rows"))


@register("restore_lost_values", CELLS_SQL + " SELECT a.table_id, a.bank, a.value FROM (SELECT DISTINCT table_id, bank, value FROM cells WHERE bank % 2 = 0) a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.table_id = a.table_id AND b.bank = a.bank + 1 AND b.value = a.value)")
def restore_lost_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of an older row that the newer one lacks under any name."""
    c = _cells(spark, d)
    old = c.filter("bank % 2 = 0").select("table_id", "bank", "value").distinct()
    new = c.select("table_id", (F.col("bank") - 1).alias("bank"), "value").distinct()
    return old.join(new, ["table_id", "bank", "value"], "left_anti")


@register("typed_sort_blanks_last", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 40 THEN NULL ELSE p_size END DESC NULLS LAST, p_name, p_partkey) AS pos FROM part")
def typed_sort_blanks_last(spark: SparkSession, d: str) -> DataFrame:
    """Blanks come last whichever way a column is sorted."""
    own = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("s"))
    return ordering.placed(own, [F.desc_nulls_last("s"), F.col("p_name"), F.col("p_partkey")]).select("p_partkey", "pos")


@register("faceted_filter", "SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt')) AND p_type IN ('SMALL', 'LARGE', 'PROMO') AND p_retailprice BETWEEN 950 AND 1100")
def faceted_filter(spark: SparkSession, d: str) -> DataFrame:
    text = F.exists(F.array("p_name", "p_brand"), lambda c: F.lower(c).contains("bolt"))
    return table(spark, d, "part").filter(F.col("p_type").isin("SMALL", "LARGE", "PROMO") & F.col("p_retailprice").between(950, 1100) & text).select("p_partkey")


@register("distinct_capped", "SELECT 'p_type' AS col, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS vals FROM part UNION ALL SELECT 'p_name', CASE WHEN count(DISTINCT p_name) > 25 THEN '' ELSE array_to_string(list_sort(list(DISTINCT p_name)), ',') END FROM part")
def distinct_capped(spark: SparkSession, d: str) -> DataFrame:
    """A column's values for a menu, none if there are more than 25: a report of bounded size, so at most 26 of each are fetched."""
    part = table(spark, d, "part")
    of = lambda c: part.select(F.lit(c).alias("col"), F.col(c).alias("v")).filter("v IS NOT NULL").distinct().limit(26)
    both = of("p_type").unionByName(of("p_name")).groupBy("col").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("v")), ",").alias("vals"))
    return both.select("col", F.when(F.col("n") > 25, "").otherwise(F.col("vals")).alias("vals"))


@register("column_widths", "SELECT greatest(9, least(52, max(length(p_name)) + 2)) AS name_width, greatest(9, least(52, max(length(p_type)) + 2)) AS type_width FROM part")
def column_widths(spark: SparkSession, d: str) -> DataFrame:
    width = lambda c: F.greatest(F.lit(9), F.least(F.lit(52), F.max(F.length(c)) + 2)).cast("long")
    return table(spark, d, "part").agg(width("p_name").alias("name_width"), width("p_type").alias("type_width"))


@register("merge_tables", "SELECT bank, col, point, min(src) AS src FROM (SELECT s_nationkey AS bank, 'a' AS col, s_suppkey % 40 AS point, 1 AS src FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_nationkey, 'a', s_suppkey % 40, 2 FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY 1, 2, 3")
def merge_tables(spark: SparkSession, d: str) -> DataFrame:
    """Sources of two tables merged, one of each point in a cell, the older table's first."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("bank"), F.lit("a").alias("col"), (F.col("s_suppkey") % 40).alias("point"), "s_suppkey")
    both = s.filter("s_suppkey % 3 = 0").withColumn("src", F.lit(1)).unionByName(s.filter("s_suppkey % 2 = 0").withColumn("src", F.lit(2)))
    return both.groupBy("bank", "col", "point").agg(F.min("src").alias("src"))


@register("url_pool_merge", "SELECT l_suppkey AS bank, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS points, min(l_shipdate) AS first_seen FROM lineitem GROUP BY 1")
def url_pool_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("bank")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("points"), F.min("l_shipdate").alias("first_seen"))
