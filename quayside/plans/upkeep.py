"""Queries over upkeep of an index: reachability, removal marks, stamps, audits, verdicts, fingerprints, and what is left of scalar work."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import dedup, finance, graphs, ordering
from ._tables import dealt, table
from .catalog import register


@register(
    "graph_reach",
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (SELECT p_partkey % n AS src, (p_partkey * 3 + 1) % n AS dst FROM part, n UNION SELECT p_partkey % n, (p_partkey * 7 + 2) % n FROM part, n),
    r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 60) SELECT node, min(depth) AS depth FROM r GROUP BY node""",
)
def graph_reach(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl from one page reaches, level by level until nothing new is found. The SQL stops at depth 60, which no page here has."""
    part = table(spark, d, "part")
    n = part.count()
    k = F.col("p_partkey")
    edges = part.select((k % n).alias("src"), ((k * 3 + 1) % n).alias("dst")).union(part.select(k % n, (k * 7 + 2) % n)).distinct()
    return graphs.reach(edges, spark.range(1).select(F.col("id").alias("node"))).select("node", "depth")


@register("mark_removed_by_url", "SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) IN (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) FROM pages WHERE page_id % 9 = 0), false) AS removed FROM pages")
def mark_removed_by_url(spark: SparkSession, d: str) -> DataFrame:
    """Rows are flagged, not deleted; no flag means not removed."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    p = table(spark, d, "pages").select("page_id", host.alias("host"))
    gone = p.filter("page_id % 9 = 0").select("host").distinct().withColumn("flag", F.lit(True))
    return p.join(gone, "host", "left").select("page_id", F.coalesce("flag", F.lit(False)).alias("removed"))


@register(
    "stamp_group_end",
    """WITH g AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id) SELECT c.conv_id, c.turn, length(whole) AS n, CASE WHEN length(whole) > 2000 THEN 'long' END AS stamp FROM conversations c JOIN g USING (conv_id)""",
)
def stamp_group_end(spark: SparkSession, d: str) -> DataFrame:
    """Parts are joined in order, the whole is judged, and every part gets the verdict."""
    c = table(spark, d, "conversations")
    whole = c.groupBy("conv_id").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("n"))
    return c.select("conv_id", "turn").join(whole, "conv_id").withColumn("stamp", F.when(F.col("n") > 2000, "long"))


@register(
    "evidence_audit",
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey % 10 <> 3), b AS (SELECT p_partkey AS k, p_size FROM part WHERE p_partkey % 10 <> 4), j AS (SELECT a.k AS ak, b.k AS bk, p_size FROM a FULL JOIN b ON a.k = b.k)
    SELECT count(*) FILTER (bk IS NULL) AS missing, count(*) FILTER (ak IS NULL) AS extra, count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL) AS matched, count(*) FILTER (ak IS NOT NULL AND p_size > 45) AS mismatched FROM j""",
)
def evidence_audit(spark: SparkSession, d: str) -> DataFrame:
    """References against the index, both ways, in one full outer join."""
    a = table(spark, d, "lineitem").filter("l_partkey % 10 != 3").select(F.col("l_partkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "part").filter("p_partkey % 10 != 4").select(F.col("p_partkey").alias("k"), "p_size").withColumn("b", F.lit(1))
    j = a.join(b, "k", "full_outer")
    has_a, has_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return j.agg(F.count_if(~has_b).alias("missing"), F.count_if(~has_a).alias("extra"), F.count_if(has_a & has_b).alias("matched"), F.count_if(has_a & (F.col("p_size") > 45)).alias("mismatched"))


@register("guard_verdict", "SELECT l_orderkey, count(DISTINCT l_linenumber) = count(*) AS each_once, bool_and(l_discount <= 0.09) AS passed, array_to_string(list_sort(list(DISTINCT l_linenumber) FILTER (l_discount > 0.09)), ',') AS problems FROM lineitem GROUP BY l_orderkey")
def guard_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Each rule exactly once; passed if none failed; failures are named."""
    failed = F.collect_set(F.when(F.col("l_discount") > 0.09, F.col("l_linenumber")))
    got = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count_distinct("l_linenumber") == F.count("*")).alias("each_once"), F.bool_and(F.col("l_discount") <= 0.09).alias("passed"), failed.alias("f"))
    return got.select("l_orderkey", "each_once", "passed", F.when(F.size("f") > 0, F.array_join(F.array_sort("f"), ",")).alias("problems"))


@register("rates_from_converter", "SELECT s_suppkey, round(s_acctbal / 100, 6) AS buy, CASE WHEN s_acctbal > 0 THEN 100000 / s_acctbal END AS sell, true AS derived FROM supplier WHERE s_acctbal > 0")
def rates_from_converter(spark: SparkSession, d: str) -> DataFrame:
    """Buy and sell rates derived from two conversions; failed ones drop out."""
    s = table(spark, d, "supplier").filter("s_acctbal > 0")
    return s.select("s_suppkey", F.round(F.col("s_acctbal") / 100, 6).alias("buy"), (100000 / F.col("s_acctbal")).alias("sell"), F.lit(True).alias("derived"))


@register("row_fingerprint", "SELECT c_custkey, sha256(concat_ws('|', c_name, c_nationkey, c_mktsegment)) AS fingerprint FROM customer")
def row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment"), 256).alias("fingerprint"))


@register("infer_columns_union", "SELECT key, min(event_id) AS first_seen, count(*) AS n FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def infer_columns_union(spark: SparkSession, d: str) -> DataFrame:
    """The union of the rows' keys in order of first sight."""
    keys = table(spark, d, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.min("event_id").alias("first_seen"), F.count("*").alias("n"))


@register("keyword_similarity")
def keyword_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Matching-blocks ratio of names to one query: a vectorised UDF over the distinct names only."""

    @F.pandas_udf("double")
    def ratio(names: pd.Series) -> pd.Series:
        return names.map(lambda s: SequenceMatcher(None, "small bolt", s).ratio())

    names = table(spark, d, "part").select(F.lower("p_name").alias("name")).distinct()
    return names.select("name", F.round(ratio("name"), 6).alias("score")).orderBy(F.col("score").desc(), "name").limit(8)


@register(
    "decide_cascade",
    "SELECT decision, rule, count(*) AS n FROM (SELECT CASE WHEN contains(p_name, 'small') THEN 'keep' WHEN contains(p_name, 'old') THEN 'drop' WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'keep' ELSE 'ask' END AS decision, CASE WHEN contains(p_name, 'small') THEN 'allow' WHEN contains(p_name, 'old') THEN 'deny' WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'section' ELSE 'model' END AS rule FROM part) GROUP BY 1, 2",
)
def decide_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rules in order, each with its reason; what no rule decides goes to a model."""
    verdict = lambda a, b: F.struct(F.lit(a).alias("decision"), F.lit(b).alias("rule"))
    rule = F.coalesce(F.when(F.col("p_name").contains("small"), verdict("keep", "allow")), F.when(F.col("p_name").contains("old"), verdict("drop", "deny")), F.when(F.col("p_type").isin("PROMO", "ECONOMY"), verdict("keep", "section")), verdict("ask", "model"))
    return table(spark, d, "part").select(rule.alias("v")).select("v.*").groupBy("decision", "rule").agg(F.count("*").alias("n"))


@register("sampled_windows", "WITH n AS (SELECT doc_id, CAST(ceil(length(text) / 500.0) AS INT) AS n FROM documents) SELECT doc_id, n, CASE WHEN n <= 10 THEN n ELSE 10 END AS picked, CASE WHEN n <= 10 THEN n - 1 ELSE CAST(floor((n - 1) * 9 / 9.0) AS INT) END AS last_start FROM n WHERE n > 0")
def sampled_windows(spark: SparkSession, d: str) -> DataFrame:
    """All windows of a text up to ten; beyond, ten evenly spaced ones with the first and the last."""
    n = F.ceil(F.length("text") / 500).cast("int")
    starts = F.when(F.col("n") <= 10, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.floor((F.col("n") - 1) * i / 9).cast("int")))
    own = table(spark, d, "documents").select("doc_id", n.alias("n")).filter("n > 0").withColumn("s", starts)
    return own.select("doc_id", "n", F.size("s").alias("picked"), F.element_at("s", -1).alias("last_start"))


@register("indexed_keys", "SELECT DISTINCT lang AS kind, CASE WHEN lang = 'en' THEN source ELSE '' END AS key FROM documents")
def indexed_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("kind"), F.when(F.col("lang") == "en", F.col("source")).otherwise("").alias("key")).distinct()


@register("identity_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def identity_violations(spark: SparkSession, d: str) -> DataFrame:
    """Keys that should be unique and are not."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@register("last_mark_wins", "SELECT user_id, arg_max(event_type, event_id) IN ('click', 'purchase') AS useful FROM events WHERE event_type <> 'view' GROUP BY user_id")
def last_mark_wins(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").filter("event_type != 'view'").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("m"))
    return last.select("user_id", F.col("m").isin("click", "purchase").alias("useful"))


@register("point_reference_counts", "SELECT point, count(*) AS n FROM (SELECT l_partkey AS point FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem UNION ALL SELECT o_custkey FROM orders) GROUP BY point")
def point_reference_counts(spark: SparkSession, d: str) -> DataFrame:
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    every = l.select(F.explode(F.array("l_partkey", "l_suppkey")).alias("point")).unionByName(o.select(F.col("o_custkey").alias("point")))
    return every.groupBy("point").agg(F.count("*").alias("n"))


@register("first_cited_order", "SELECT o_custkey, o_orderkey AS first_order, n FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_cited_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.count("*").alias("n"))


@register("distinct_points_in_order", "SELECT l_orderkey, l_partkey, rank FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2)")
def distinct_points_in_order(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("rank"))
    return dedup.first_of(own, ["l_orderkey", "l_partkey"], [F.col("rank")])


@register("offers_first_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal <= 0, s_nationkey, s_suppkey) AS pos FROM supplier")
def offers_first_order(spark: SparkSession, d: str) -> DataFrame:
    """Offers first, then by bank."""
    own = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return ordering.placed(own, [F.col("s_acctbal") <= 0, F.col("s_nationkey"), F.col("s_suppkey")]).select("s_suppkey", "pos")


@register("remap_ids_in_arrays", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_transform(list(l_suppkey), lambda x: CASE WHEN x = 7 THEN 3 ELSE x END))), ',') AS ids FROM lineitem GROUP BY l_orderkey")
def remap_ids_in_arrays(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_distinct(F.transform(F.collect_set("l_suppkey"), lambda x: F.when(x == 7, 3).otherwise(x)))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(ids), ",").alias("ids"))


@register("family_limits", "SELECT p_type, count(DISTINCT l_suppkey) AS banks, min(l_quantity) AS low, max(l_quantity) AS high, min(l_extendedprice) AS cheapest FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY p_type")
def family_limits(spark: SparkSession, d: str) -> DataFrame:
    """Envelope of a family over all banks that sell it."""
    l = table(spark, d, "lineitem").filter("l_returnflag != 'R'").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    j = l.join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_type").agg(F.count_distinct("l_suppkey").alias("banks"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.min("l_extendedprice").alias("cheapest"))


_FULL = "CAST(1.05057 AS DOUBLE)"


@register(
    "card_installment_plan",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(date_trunc('month', o_orderdate) AS DATE) + 16 AS day FROM orders),
    p AS (SELECT o_orderkey, amount, day, (SELECT sum(round(1 / pow({_FULL}, date_diff('day', day, CAST(day + k * INTERVAL 1 MONTH AS DATE)) / 30), 6)) FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k)) AS f FROM o),
    q AS (SELECT o_orderkey, day, amount, CAST(round(CAST(amount AS DOUBLE) / f, 2) AS DECIMAL(18,2)) AS pay FROM p),
    w AS (SELECT o_orderkey, day, k, CAST(round(pow(CAST(1.0389 AS DOUBLE), date_diff('day', CAST(day + (k - 1) * INTERVAL 1 MONTH AS DATE), CAST(day + k * INTERVAL 1 MONTH AS DATE)) / 30), 4) - 1 AS DECIMAL(8,4)) AS m FROM q, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k)),
    s AS (SELECT q.o_orderkey, pay, 1 AS n, amount AS before, CAST(round(amount * m, 2) AS DECIMAL(18,2)) AS profit FROM q JOIN w ON w.o_orderkey = q.o_orderkey AND k = 1
      UNION ALL SELECT o_orderkey, pay, k, left_, CAST(round(left_ * m, 2) AS DECIMAL(18,2)) FROM (SELECT s.o_orderkey, pay, k, m, CAST(before - (pay - profit - 2 * round(profit * 0.15, 2)) AS DECIMAL(18,2)) AS left_ FROM s JOIN w ON w.o_orderkey = s.o_orderkey AND k = n + 1))
    SELECT o_orderkey, n, CAST(CASE WHEN n = 6 THEN before + profit + 2 * round(profit * 0.15, 2) ELSE pay END AS DOUBLE) AS payment, CAST(profit AS DOUBLE) AS profit, CAST(2 * round(profit * 0.15, 2) AS DOUBLE) AS taxes,
      CAST(CASE WHEN n = 6 THEN before ELSE pay - profit - 2 * round(profit * 0.15, 2) END AS DOUBLE) AS principal FROM s""",
)
def card_installment_plan(spark: SparkSession, d: str) -> DataFrame:
    """A plan on the statement days after a purchase on one: six payments, the level one priced at the taxed rate by days, the last one made of what remains."""
    day = F.date_add(F.trunc("o_orderdate", "month"), 16)
    o = dealt(table(spark, d, "orders").select("o_orderkey", "o_totalprice", day.alias("day")))
    dates = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.add_months("day", k))
    return finance.dated_plans(o, "o_orderkey", "o_totalprice", dates, "day", 0.0389, 0.15, 0.15).select("o_orderkey", "n", "payment", "profit", "taxes", "principal")
