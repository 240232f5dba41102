"""Queries over change: snapshots, upserts, validity windows, transitions, alerts, ledgers and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import incremental, intervals, scan
from ._tables import dealt, table
from .catalog import register

TODAY = "1998-06-30"
OLD = "(SELECT o_custkey, md5(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS h FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)"
NEW = "(SELECT o_custkey, md5(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS h FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1998-06-01' AND o_custkey % 7 <> 0 GROUP BY 1)"


def _snapshot(df: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderstatus"])), ",")
    return df.groupBy("o_custkey").agg(F.md5(text.cast("binary")).alias("h"))


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    at = lambda s: F.lit(s).cast("timestamp")
    return _snapshot(o.filter(F.col("o_orderdate") < at("1998-01-01"))), _snapshot(o.filter((F.col("o_orderdate") >= at("1995-03-01")) & (F.col("o_orderdate") < at("1998-06-01")) & (F.col("o_custkey") % 7 != 0)))


@register("snapshot_diff", f"SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM {OLD} a FULL JOIN {NEW} b ON a.o_custkey = b.o_custkey")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return incremental.classify(old, new, "o_custkey", "h")


@register("upsert_merge", f"SELECT o_custkey, h FROM {NEW} UNION ALL SELECT o_custkey, h FROM {OLD} WHERE o_custkey NOT IN (SELECT o_custkey FROM {NEW}) AND o_custkey % 2 = 0")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return incremental.upsert(old, new, "o_custkey", F.col("o_custkey") % 2 == 0)


@register("delete_gate", f"WITH a AS {OLD}, b AS {NEW} SELECT count(*) AS held, count(*) FILTER (o_custkey NOT IN (SELECT o_custkey FROM b)) AS to_delete, count(*) FILTER (o_custkey NOT IN (SELECT o_custkey FROM b)) > 0.2 * count(*) AS refused FROM a")
def delete_gate(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    marked = old.join(new.select("o_custkey", F.lit(1).alias("kept")), "o_custkey", "left")
    gone = F.count_if(F.col("kept").isNull())
    return marked.agg(F.count("*").alias("held"), gone.alias("to_delete"), (gone > 0.2 * F.count("*")).alias("refused"))


@register("universe_diff", f"SELECT o_custkey, 'added' AS side FROM {NEW} WHERE o_custkey NOT IN (SELECT o_custkey FROM {OLD}) UNION ALL SELECT o_custkey, 'missing' FROM {OLD} WHERE o_custkey NOT IN (SELECT o_custkey FROM {NEW})")
def universe_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return incremental.set_difference(old, new, "o_custkey")


@register(
    "scd_first_last_seen",
    """WITH c AS (SELECT user_id, min(CAST(ts AS DATE)) AS first_seen, max(CAST(ts AS DATE)) AS last_seen, arg_max(event_type, event_id) AS kind FROM events WHERE ts < TIMESTAMP '2024-01-10' AND user_id % 5 <> 0 GROUP BY 1), n AS (SELECT user_id, min(CAST(ts AS DATE)) AS f, max(CAST(ts AS DATE)) AS l, arg_max(event_type, event_id) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND user_id % 3 <> 0 GROUP BY 1)
    SELECT coalesce(c.user_id, n.user_id) AS user_id, coalesce(first_seen, f) AS first_seen, greatest(last_seen, l) AS last_seen, coalesce(k, kind) AS kind FROM c FULL JOIN n ON c.user_id = n.user_id""",
)
def scd_first_last_seen(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("day"), "ts", F.col("event_type").alias("kind"))
    cut = F.lit("2024-01-10").cast("timestamp")
    old = e.filter((F.col("ts") < cut) & (F.col("user_id") % 5 != 0)).groupBy("user_id").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.max_by("kind", "event_id").alias("kind"))
    batch = e.filter((F.col("ts") >= cut) & (F.col("user_id") % 3 != 0)).groupBy("user_id").agg(F.min("day").alias("f"), F.max("day").alias("day"), F.max_by("kind", "event_id").alias("kind"))
    both = incremental.seen_dates(old, batch.select("user_id", "day", "kind"), "user_id", "day", ["kind"]).drop("first_seen")
    return both.join(old.select("user_id", F.col("first_seen").alias("a")), "user_id", "left").join(batch.select("user_id", "f"), "user_id", "left").select("user_id", F.coalesce("a", "f").alias("first_seen"), "last_seen", "kind")


@register("movement_diff", "SELECT event_id, CASE WHEN p IS NULL THEN 'first' WHEN value > p THEN 'up' WHEN value < p THEN 'down' ELSE 'same' END AS move FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events)")
def movement_diff(spark: SparkSession, d: str) -> DataFrame:
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    e = scan.previous(scan.ranged(table(spark, d, "events").select(*keys, *order, "value"), keys, order), keys, order, "value", "p")
    return e.select("event_id", F.when(F.col("p").isNull(), "first").when(F.col("value") > F.col("p"), "up").when(F.col("value") < F.col("p"), "down").otherwise("same").alias("move"))


@register("edge_alert", "SELECT event_id, user_id FROM (SELECT event_id, user_id, value > 40 AS hit, lag(value > 40) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE hit AND NOT coalesce(before, false)")
def edge_alert(spark: SparkSession, d: str) -> DataFrame:
    """An alert fires when its condition turns true, not while it stays so."""
    hit = F.col("value") > 40
    e = scan.ranged(table(spark, d, "events").select("event_id", "user_id", "ts", hit.alias("hit")), ["user_id"], ["ts", "event_id"])
    e = scan.previous(e, ["user_id"], ["ts", "event_id"], "hit", "before")
    return e.filter(F.col("hit") & ~F.coalesce("before", F.lit(False))).select("event_id", "user_id")


ISLANDS = """WITH s AS (SELECT *, CASE WHEN event_type = 'error' THEN 'down' ELSE 'ok' END AS state FROM events), m AS (SELECT *, CASE WHEN lag(state) OVER w IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m)"""


@register("status_since_islands", ISLANDS + " SELECT event_id, state, min(ts) OVER (PARTITION BY user_id, island) AS since FROM i")
def status_since_islands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("state", F.when(F.col("event_type") == "error", "down").otherwise("ok"))
    return intervals.islands(e, "user_id", ["ts", "event_id"], "state", "ts").select("event_id", "state", "since")


@register("status_changes", "SELECT user_id, event_id, before, state FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'down' ELSE 'ok' END AS state, lag(CASE WHEN event_type = 'error' THEN 'down' ELSE 'ok' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE (before IS NULL AND state <> 'ok') OR before <> state")
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes only; being fine when first seen is silent."""
    state = F.when(F.col("event_type") == "error", "down").otherwise("ok")
    e = scan.ranged(table(spark, d, "events").select("user_id", "event_id", "ts", state.alias("state")), ["user_id"], ["ts", "event_id"])
    e = scan.previous(e, ["user_id"], ["ts", "event_id"], "state", "before")
    return e.filter((F.col("before").isNull() & (F.col("state") != "ok")) | (F.col("before") != F.col("state"))).select("user_id", "event_id", "before", "state")


@register("ledger_latest_counts", "SELECT stage, decision, count(*) AS n FROM (SELECT user_id % 3 AS stage, user_id, arg_max(event_type, event_id) AS decision FROM events GROUP BY 1, 2) GROUP BY 1, 2")
def ledger_latest_counts(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("stage"), "user_id").agg(F.max_by("event_type", "event_id").alias("decision"))
    return last.groupBy("stage", "decision").agg(F.count("*").alias("n"))


@register("validity_hull", "SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS start, max(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT)) AS end FROM orders GROUP BY 1".replace("AS end", 'AS "end"'))
def validity_hull(spark: SparkSession, d: str) -> DataFrame:
    return intervals.hull(_windows(spark, d), ["o_custkey"], "a", "b")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("a"), F.date_add(day, (F.col("o_orderkey") % 60).cast("int")).alias("b"))


@register("validity_intersection", """SELECT o_custkey, s AS start, CASE WHEN s <= e THEN e END AS "end" FROM (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS s, min(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT)) AS e FROM orders GROUP BY 1)""")
def validity_intersection(spark: SparkSession, d: str) -> DataFrame:
    return intervals.intersection(_windows(spark, d), ["o_custkey"], "a", "b")


@register("active_filter", f"SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0 OR CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) >= DATE '{TODAY}'")
def active_filter(spark: SparkSession, d: str) -> DataFrame:
    """No end means active; the day is a parameter."""
    end = F.when(F.col("o_orderkey") % 11 != 0, F.date_format("b", "yyyy-MM-dd"))
    return _windows(spark, d).filter(V.is_active(end, TODAY)).select("o_orderkey")


@register("validity_verdict", f"SELECT CASE WHEN b < DATE '{TODAY}' THEN 'expired' WHEN a > DATE '{TODAY}' THEN 'scheduled' ELSE 'current' END AS verdict, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS b FROM orders) GROUP BY 1")
def validity_verdict(spark: SparkSession, d: str) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    return _windows(spark, d).select(intervals.verdict(F.col("a"), F.col("b"), today).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@register("window_text", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y') || ' - ' || CASE WHEN o_orderkey % 5 = 0 THEN '?' ELSE strftime(CAST(o_orderdate AS DATE) + 30, '%d/%m/%Y') END AS shown, o_orderkey % 5 <> 0 AS closed FROM orders")
def window_text(spark: SparkSession, d: str) -> DataFrame:
    """A window written as text and read back."""
    day = F.to_date("o_orderdate")
    shown = V.window_text(day, F.when(F.col("o_orderkey") % 5 != 0, F.date_add(day, 30)))
    return table(spark, d, "orders").select("o_orderkey", shown.alias("shown")).withColumn("closed", V.window_dates(F.col("shown"))["end"].isNotNull())


@register("date_cascade", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start, CAST(CAST(o_orderdate AS DATE) + 45 AS VARCHAR) AS \"end\", 'label' AS rule FROM orders")
def date_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Dates in running text, by the cascade of rules; years before 2000 are moved up for it."""
    day = F.to_date("o_orderdate")
    text = F.concat(F.lit("Kampanya Tarihleri: "), F.date_format(F.add_months(day, 480), "d.MM.yyyy"), F.lit(" - "), F.date_format(F.add_months(F.date_add(day, 45), 480), "d.MM.yyyy"), F.lit(" arası."))
    got = dealt(table(spark, d, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", V.validity(text).alias("v"))
    back = lambda c: F.date_format(F.add_months(F.to_date(c), -480), "yyyy-MM-dd")
    return got.select("o_orderkey", F.coalesce(back("v.start"), F.lit("")).alias("start"), F.coalesce(back("v.end"), F.lit("")).alias("end"), "v.rule")


@register(
    "next_run_schedule",
    """SELECT event_id, (SELECT min(c) FROM (SELECT CAST(CAST(ts + INTERVAL 3 HOUR AS DATE) + k AS TIMESTAMP) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE - INTERVAL 3 HOUR AS c, isodow(CAST(ts + INTERVAL 3 HOUR AS DATE) + k) AS w FROM (SELECT CAST(unnest(generate_series(0, 7)) AS INT) AS k)) WHERE w IN (1, 3, 5) AND c > ts) AS next_run FROM events""",
)
def next_run_schedule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.next_run(F.col("ts"), 9, 30, (0, 2, 4)).alias("next_run"))


@register("usage_stats", "SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_totalprice > 200000) AS large, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0, ["n", "done", "large"])


@register("json_props_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.k'), '') AS k_text, json_extract_string(props, '$.absent') AS absent FROM events")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.cast("int").alias("k"), F.coalesce(k, F.lit("")).alias("k_text"), F.get_json_object("props", "$.absent").alias("absent"))


@register("claim_due", "SELECT event_id, ts FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 20")
def claim_due(spark: SparkSession, d: str) -> DataFrame:
    due = table(spark, d, "events").filter((F.col("event_type") == "signup") & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp")))
    return due.select("event_id", "ts").orderBy("ts", "event_id").limit(20)


@register("build_gates", "SELECT source, n, bad, bad > 0.2 * n AS refused FROM (SELECT source, count(*) AS n, count(*) FILTER (n_chars < 600) AS bad FROM documents GROUP BY source)")
def build_gates(spark: SparkSession, d: str) -> DataFrame:
    """A site with too large a share of bad documents is not published."""
    s = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 600).alias("bad"))
    return s.withColumn("refused", F.col("bad") > 0.2 * F.col("n"))


@register("retry_gate", "SELECT user_id, bool_and(event_type = 'error') AS failed FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 2 GROUP BY user_id")
def retry_gate(spark: SparkSession, d: str) -> DataFrame:
    """A failure counts when the second attempt failed too."""
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("rn", nth).filter("rn <= 2").groupBy("user_id").agg(F.bool_and(F.col("event_type") == "error").alias("failed"))


@register("condition_evaluate", "SELECT a.user_id, a.v AS left_value, b.v AS right_value, a.v >= b.v AS holds FROM (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'view' GROUP BY 1) a JOIN (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.user_id = b.user_id")
def condition_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """Two live operands compared."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    last = e.groupBy("user_id").agg(F.max_by("value", F.when(F.col("event_type") == "view", F.col("event_id"))).alias("left_value"), F.max_by("value", F.when(F.col("event_type") == "click", F.col("event_id"))).alias("right_value"), F.count_distinct("event_type").alias("n"))
    return last.filter("n = 2").select("user_id", "left_value", "right_value", (F.col("left_value") >= F.col("right_value")).alias("holds"))


@register("reuse_verdict", "SELECT n.user_id, coalesce(o.kind, 'fetch') AS verdict FROM (SELECT user_id, md5(string_agg(DISTINCT event_type, ',' ORDER BY event_type)) AS h FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) n LEFT JOIN (SELECT user_id, md5(string_agg(DISTINCT event_type, ',' ORDER BY event_type)) AS h, max(event_type) AS kind FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) o ON n.user_id = o.user_id AND n.h = o.h")
def reuse_verdict(spark: SparkSession, d: str) -> DataFrame:
    """A prior verdict counts while the fingerprint is the same."""
    e, cut = table(spark, d, "events"), F.lit("2024-01-15").cast("timestamp")
    print_ = F.md5(F.array_join(F.array_sort(F.collect_set("event_type")), ",").cast("binary")).alias("h")
    new = e.filter(F.col("ts") >= cut).groupBy("user_id").agg(print_)
    old = e.filter(F.col("ts") < cut).groupBy("user_id").agg(print_, F.max("event_type").alias("kind"))
    return new.join(old, ["user_id", "h"], "left").select("user_id", F.coalesce("kind", F.lit("fetch")).alias("verdict"))
