"""Queries over offers and quotes: scope, families, ranking, envelopes, bands, boards, gates and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import finance, lookups, ordering, tables
from ._tables import table
from .catalog import register


@register(
    "quote_scope_partition",
    """SELECT n_name AS bank, 'quoted' AS outcome, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name
    UNION ALL SELECT n_name, 'not offered', 0 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""",
)
def quote_scope_partition(spark: SparkSession, d: str) -> DataFrame:
    """Every bank in scope appears on exactly one side."""
    scope = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("bank"))
    members = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    offered, missing = lookups.scope_partition(scope, members, "k")
    quoted = offered.groupBy("bank").agg(F.lit("quoted").alias("outcome"), F.count("*").alias("n")).select("bank", "outcome", "n")
    return quoted.unionByName(missing.select("bank", F.lit("not offered").alias("outcome"), F.lit(0).cast("long").alias("n")))


FAMILY = "CASE WHEN contains(p_name, 'small') OR contains(p_type, 'SMALL') THEN 'compact' WHEN contains(p_name, 'large') OR contains(p_type, 'LARGE') THEN 'bulk' WHEN p_type = 'PROMO' THEN 'campaign' END"


@register("family_classify", f"SELECT p_partkey, array_to_string(list_filter([{FAMILY}, CASE WHEN p_size >= 40 THEN 'xl' WHEN p_size < 5 THEN 'xs' END, CASE WHEN p_type = 'ECONOMY' THEN 'economy' END], lambda x: x IS NOT NULL), '-') AS family FROM part")
def family_classify(spark: SparkSession, d: str) -> DataFrame:
    """Axes read off a name by ordered rules, joined to a key; axes that don't apply drop out."""
    axes = tables.family_axes(F.col("p_name"), F.col("p_type"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(axes, lambda x: x.isNotNull()), "-").alias("family"))


@register(
    "catalogue_gap",
    """WITH s AS (SELECT p_type, p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_brand) >= 2), c AS (SELECT DISTINCT p_type, p_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))
    SELECT s.p_type, s.p_name, s.n FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.p_type = s.p_type AND c.p_name = s.p_name)""",
)
def catalogue_gap(spark: SparkSession, d: str) -> DataFrame:
    """What two banks or more sell and the covered ones don't."""
    part = table(spark, d, "part")
    sold = part.groupBy("p_type", "p_name").agg(F.count_distinct("p_brand").alias("n")).filter("n >= 2")
    covered = part.filter(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select("p_type", "p_name").distinct()
    return sold.join(covered, ["p_type", "p_name"], "left_anti")


@register("family_entries", "SELECT p_type, p_brand, min(p_partkey) AS first_member, count(*) AS n FROM part GROUP BY 1, 2")
def family_entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("first_member"), F.count("*").alias("n"))


@register(
    "ranked_quotes",
    """SELECT l_partkey, l_suppkey, price, rank FROM (SELECT l_partkey, l_suppkey, l_extendedprice / l_quantity AS price, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice / l_quantity ASC, l_suppkey, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3""",
)
def ranked_quotes(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    nth = F.row_number().over(W.partitionBy("l_partkey").orderBy(F.asc_nulls_last("price"), "l_suppkey", "l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").withColumn("price", price).withColumn("rank", nth).filter("rank <= 3").select("l_partkey", "l_suppkey", "price", "rank")


@register(
    "winner_non_null",
    """WITH q AS (SELECT o_orderpriority, o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders)
    SELECT o_orderpriority, min(price) AS best, count(*) AS n, count(price) AS priced, count(DISTINCT o_custkey) AS banks FROM q GROUP BY o_orderpriority""",
)
def winner_non_null(spark: SparkSession, d: str) -> DataFrame:
    """A missing price never wins."""
    q = table(spark, d, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return q.groupBy("o_orderpriority").agg(F.min("price").alias("best"), F.count("*").alias("n"), F.count("price").alias("priced"), F.count_distinct("o_custkey").alias("banks"))


@register("envelope_limits", "SELECT l_suppkey, min(l_quantity) AS low, max(l_quantity) AS high, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags FROM lineitem GROUP BY l_suppkey")
def envelope_limits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@register(
    "intersect_limits",
    """WITH e AS (SELECT l_partkey, l_suppkey, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, max(low) AS low, min(high) AS high, count(*) AS n FROM e GROUP BY 1)
    SELECT m.l_partkey, m.low, m.high, m.low <= m.high AS possible, count(*) FILTER (e.low = m.low) AS n_low, count(*) FILTER (e.high = m.high) AS n_high FROM m JOIN e USING (l_partkey) GROUP BY m.l_partkey, m.low, m.high""",
)
def intersect_limits(spark: SparkSession, d: str) -> DataFrame:
    """Tightest bounds over banks, and how many cause each."""
    e = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return tables.intersect_bounds(e, "l_partkey", "lo", "hi")


BANDS = [1, 7, 14, 30, 45]


@register(
    "nearest_band",
    f"""WITH q AS (SELECT DISTINCT CAST(l_quantity AS INT) AS days FROM lineitem), b AS (SELECT unnest({BANDS}) AS band), r AS (SELECT days, band, abs(band - days) AS off, row_number() OVER (PARTITION BY days ORDER BY abs(band - days), band) AS rn FROM q, b)
    SELECT days, CASE WHEN days >= 45 OR off <= 0.15 * days THEN band END AS band FROM r WHERE rn = 1""",
)
def nearest_band(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("days")).distinct()
    return lookups.nearest_band(days, "days", BANDS)


RANGES = [(1, 10, "short", 1), (8, 25, "middle", 2), (26, 40, "long", 3)]


@register(
    "range_band",
    """WITH b(lo, hi, name, pos) AS (VALUES (1, 10, 'short', 1), (8, 25, 'middle', 2), (26, 40, 'long', 3)), q AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem)
    SELECT l_orderkey, l_linenumber, (SELECT name FROM b WHERE l_quantity BETWEEN lo AND hi ORDER BY pos LIMIT 1) AS name FROM q""",
)
def range_band(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame(RANGES, "lo int, hi int, name string, pos int")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lookups.containing_band(rows, "l_quantity", bands, "lo", "hi", "pos").select("l_orderkey", "l_linenumber", "name")


@register(
    "tightest_product",
    """WITH p AS (SELECT p_type, p_size AS max_term, floor(p_retailprice) AS max_amount FROM part), q AS (SELECT o_orderkey, CAST(o_totalprice / 1000 AS INT) % 40 + 1 AS term, 900 + o_orderkey % 50 AS amount FROM orders),
    c AS (SELECT DISTINCT term, amount FROM q), f AS (SELECT c.term, c.amount, min(max_term) AS max_term, count(*) AS n_fit, count(DISTINCT p_type) AS n_stems FROM c JOIN p ON c.term <= p.max_term AND c.amount <= p.max_amount GROUP BY 1, 2)
    SELECT o_orderkey, f.max_term, n_fit, n_stems FROM q JOIN f USING (term, amount)""",
)
def tightest_product(spark: SparkSession, d: str) -> DataFrame:
    """Products whose bounds hold a request; the tightest one. Products are counted by term, whole amount and type before anything meets: an amount
    above all requests' counts as the highest one, so there are at most 50 x 52 cells a type, and 40 x 50 kinds of request. Halves of a thousand go to the even term, as in SQL."""
    p = table(spark, d, "part").select("p_type", F.col("p_size").alias("max_term"), F.least(F.floor("p_retailprice"), F.lit(950)).alias("max_amount"))
    cells = p.filter("max_amount >= 900").groupBy("p_type", "max_term", "max_amount").agg(F.count("*").alias("n"))
    q = table(spark, d, "orders").select("o_orderkey", (F.rint(F.col("o_totalprice") / 1000).cast("int") % 40 + 1).alias("term"), (900 + F.col("o_orderkey") % 50).alias("amount"))
    # Each cell serves all terms up to its own and all amounts up to its own: both are dealt out step by step.
    by_term = cells.withColumn("term", F.explode(F.sequence(F.lit(1), F.least("max_term", F.lit(40))))).groupBy("p_type", "term", "max_amount").agg(F.sum("n").alias("n"), F.min("max_term").alias("max_term"))
    each = by_term.withColumn("amount", F.explode(F.sequence(F.lit(900), F.least("max_amount", F.lit(949)))))
    fit = each.groupBy("term", "amount").agg(F.min("max_term").alias("max_term"), F.sum("n").alias("n_fit"), F.count_distinct("p_type").alias("n_stems"))
    return q.join(F.broadcast(fit), ["term", "amount"]).select("o_orderkey", "max_term", "n_fit", "n_stems")


@register(
    "tiered_product_lookup",
    """WITH q AS (SELECT DISTINCT p_name AS asked FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT 'nothing'),
    t AS (SELECT asked, 0 AS tier, p_type AS target FROM q JOIN part ON lower(p_brand) = lower(asked) UNION ALL SELECT asked, 1, p_type FROM q JOIN part ON lower(p_name) = lower(asked)),
    m AS (SELECT asked, tier, count(DISTINCT target) AS n, min(target) AS target FROM t GROUP BY 1, 2) SELECT asked, tier, n AS n_matches, CASE WHEN n = 1 THEN target END AS p_type FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY tier) AS rn FROM m) WHERE rn = 1""",
)
def tiered_product_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    asked = part.select(F.col("p_name").alias("asked")).union(part.select("p_brand")).distinct().union(spark.createDataFrame([("nothing",)], "asked string"))
    return lookups.tiered(asked, part, [(F.lower("asked"), F.lower("p_brand")), (F.lower("asked"), F.lower("p_name"))], ["asked"], "p_type")


@register(
    "as_of_last_value",
    """SELECT e.event_id, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def as_of_last_value(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    errors = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    buys = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("value").alias("last_value"))
    return lookups.as_of(errors, buys, "user_id", "ts", "bought", "last_value").select("event_id", "last_value")


PLAN = "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, 3 + CAST(o_orderkey % 10 AS INT) AS term FROM orders"


@register(
    "amortisation_schedule",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey, amount, term, CAST(round(CAST(amount AS DOUBLE) / ((1 - pow(1.052, -term)) / 0.052), 2) AS DECIMAL(18,2)) AS pay FROM ({PLAN})),
    s AS (SELECT o_orderkey, term, pay, 1 AS n, amount AS before, CAST(round(amount * 0.0400, 2) AS DECIMAL(18,2)) AS profit FROM o
      UNION ALL SELECT o_orderkey, term, pay, n + 1, left_, CAST(round(left_ * 0.0400, 2) AS DECIMAL(18,2)) FROM (SELECT *, CAST(before - (pay - profit - round(profit * 0.15, 2) - round(profit * 0.15, 2)) AS DECIMAL(18,2)) AS left_ FROM s WHERE n < term))
    SELECT o_orderkey, n, CAST(pay AS DOUBLE) AS payment, CAST(profit AS DOUBLE) AS profit, CAST(2 * round(profit * 0.15, 2) AS DOUBLE) AS taxes, CAST(CASE WHEN n = term THEN before ELSE pay - profit - 2 * round(profit * 0.15, 2) END AS DOUBLE) AS principal,
      CAST(CASE WHEN n = term THEN 0 ELSE before - (pay - profit - 2 * round(profit * 0.15, 2)) END AS DOUBLE) AS remaining FROM s""",
)
def amortisation_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Level payments priced at the rate with both taxes on it; each period's profit is the bare rate on the balance; every step is rounded, and the last
    principal closes to zero. A plan for every order."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), (3 + F.col("o_orderkey") % 10).cast("int").alias("term"))
    return finance.level_plans(o, "o_orderkey", "amount", "term", 0.04, 0.15, 0.15)


@register(
    "quote_consistency_gate",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity <= 0 THEN 'no amount' WHEN l_extendedprice / l_quantity < 900 THEN 'price too low' WHEN l_discount > l_tax + 0.05 THEN 'discount beyond tax' WHEN l_shipdate < TIMESTAMP '1995-06-01' THEN 'too old' ELSE 'ok' END AS reason FROM lineitem) GROUP BY reason""",
)
def quote_consistency_gate(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that a quote breaks is its reason; nothing is dropped."""
    reason = (
        F.when(F.col("l_quantity") <= 0, "no amount").when(F.col("l_extendedprice") / F.col("l_quantity") < 900, "price too low")
        .when(F.col("l_discount") > F.col("l_tax") + 0.05, "discount beyond tax").when(F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp"), "too old").otherwise("ok")
    )
    return table(spark, d, "lineitem").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register(
    "profit_agreement",
    """SELECT l_orderkey, l_linenumber, abs(reported - implied) <= 0.15 * implied OR (reported - 0.005 <= implied + 0.01 AND implied - 0.01 <= reported + 0.005) AS agrees FROM (SELECT l_orderkey, l_linenumber, l_tax AS reported, l_discount AS implied FROM lineitem)""",
)
def profit_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two figures agree if their ranges of published precision overlap, or within 15 %."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", finance.agrees(F.col("l_tax"), F.col("l_discount"), 0.005, 0.01, 0.15).alias("agrees"))


BOARD = "SELECT event_type AS instrument, user_id % 4 AS bank, min(value) AS buy, max(value) AS sell FROM events GROUP BY 1, 2"


@register(
    "rates_board_pivot",
    f"SELECT instrument, max(buy) FILTER (bank = 0) AS buy_0, max(sell) FILTER (bank = 0) AS sell_0, max(buy) FILTER (bank = 1) AS buy_1, max(sell) FILTER (bank = 1) AS sell_1, max(buy) FILTER (bank = 2) AS buy_2, max(sell) FILTER (bank = 2) AS sell_2, max(buy) FILTER (bank = 3) AS buy_3, max(sell) FILTER (bank = 3) AS sell_3 FROM ({BOARD}) GROUP BY instrument",
)
def rates_board_pivot(spark: SparkSession, d: str) -> DataFrame:
    board = _board(spark, d)
    wide = board.groupBy("instrument").pivot("bank", [0, 1, 2, 3]).agg(F.max("buy").alias("buy"), F.max("sell").alias("sell"))
    return wide.select("instrument", *[F.col(f"{b}_{s}").alias(f"{s}_{b}") for b in range(4) for s in ("buy", "sell")])


def _board(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("instrument"), (F.col("user_id") % 4).alias("bank")).agg(F.min("value").alias("buy"), F.max("value").alias("sell"))


@register(
    "best_rates",
    f"""WITH b AS (SELECT *, (sell - buy) / ((sell + buy) / 2) * 100 AS spread FROM ({BOARD})), s AS (SELECT * FROM b WHERE spread BETWEEN 0 AND 250)
    SELECT instrument, max(buy) AS best_buy, min(sell) AS best_sell, count(*) AS n FROM s GROUP BY instrument HAVING count(*) >= 2""",
)
def best_rates(spark: SparkSession, d: str) -> DataFrame:
    sane = _board(spark, d).filter(~finance.spread_looks_broken(F.col("buy"), F.col("sell"), 250))
    return sane.groupBy("instrument").agg(F.max("buy").alias("best_buy"), F.min("sell").alias("best_sell"), F.count("*").alias("n")).filter("n >= 2")


@register("spread_guard", "SELECT l_orderkey, l_linenumber, coalesce(s > 25 OR s < 0, true) AS broken FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount + l_tax > 0 THEN (l_tax - l_discount) / ((l_tax + l_discount) / 2) * 100 END AS s FROM lineitem)")
def spread_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", finance.spread_looks_broken(F.col("l_discount"), F.col("l_tax")).alias("broken"))


@register("coverage_order", "SELECT bank, n, row_number() OVER (ORDER BY n DESC, bank) AS pos FROM (SELECT s_nationkey AS bank, count(*) AS n FROM supplier GROUP BY 1)")
def coverage_order(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("bank")).agg(F.count("*").alias("n"))
    return n.select("bank", "n", F.row_number().over(W.orderBy(F.col("n").desc(), "bank")).cast("long").alias("pos"))


@register(
    "cross_rate_convert",
    f"""WITH b AS (SELECT * FROM ({BOARD}) WHERE bank = 0) SELECT s.instrument AS source, t.instrument AS target, CAST(CAST(100 AS DECIMAL(18,6)) * CAST(s.buy + 1 AS DECIMAL(18,6)) / CAST(t.sell + 1 AS DECIMAL(18,6)) AS DOUBLE) AS amount FROM b s JOIN b t ON s.instrument <> t.instrument""",
)
def cross_rate_convert(spark: SparkSession, d: str) -> DataFrame:
    """100 units of one instrument in every other, at one bank: a board has a fixed few instruments."""
    b = _board(spark, d).filter("bank = 0")
    listed = b.agg(F.collect_list(F.struct(F.col("instrument").alias("target"), (F.col("sell") + 1).cast("decimal(18,6)").alias("get")))).scalar()
    pairs = b.select(F.col("instrument").alias("source"), (F.col("buy") + 1).cast("decimal(18,6)").alias("give"), F.inline(listed)).filter("source != target")
    return pairs.select("source", "target", (F.lit(100.0) * F.col("give").cast("double") / F.col("get").cast("double")).alias("amount"))


@register("audit_pivot_states", "SELECT user_id % 10 AS bank, count(*) FILTER (event_type IN ('view', 'click')) AS ok, count(*) FILTER (event_type = 'error') AS down, count(*) FILTER (event_type IN ('signup', 'purchase')) AS known FROM events GROUP BY 1")
def audit_pivot_states(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type").isin("view", "click"), "ok").when(F.col("event_type") == "error", "down").otherwise("known")
    return table(spark, d, "events").select((F.col("user_id") % 10).alias("bank"), state.alias("state")).groupBy("bank").pivot("state", ["ok", "down", "known"]).count().na.fill(0)


@register("money_text", "SELECT c_custkey, c_acctbal AS amount, CAST(round(CAST(abs(c_acctbal) AS DECIMAL(18,4)), 1) AS DOUBLE) AS tenth FROM customer")
def money_text(spark: SparkSession, d: str) -> DataFrame:
    """An amount written the Turkish way, read back."""
    text = F.translate(F.format_number("c_acctbal", 2), ",.", ".,")
    tenth = F.round(F.abs(F.col("c_acctbal")).cast("decimal(18,4)"), 1).cast("double")
    return table(spark, d, "customer").select("c_custkey", V.money(F.concat(text, F.lit(" TL"))).alias("amount"), tenth.alias("tenth"))


@register("clamp_defaults", "SELECT p_partkey, least(greatest(1000, CAST(p_size AS DOUBLE) * 10), p_retailprice) AS amount, least(greatest(12, p_size), 36) AS term FROM part")
def clamp_defaults(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.least(F.greatest(F.lit(1000.0), F.col("p_size") * 10.0), F.col("p_retailprice")).alias("amount"), F.least(F.greatest(F.lit(12), F.col("p_size")), F.lit(36)).alias("term"))


@register(
    "probe_plan",
    "SELECT n_name AS bank, p_type AS capability, n_products FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT p_type, count(*) AS n_products FROM part GROUP BY 1)",
)
def probe_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every bank with every capability: a capability is a type of product, of which there are few; its products are counted first."""
    caps = table(spark, d, "part").groupBy(F.col("p_type").alias("capability")).agg(F.count("*").alias("n_products"))
    banks = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("bank"))
    listed = caps.agg(F.collect_list(F.struct("capability", "n_products")).alias("all")).scalar()
    return banks.select("bank", F.inline(listed))


@register("hoist_constants", "SELECT o_orderpriority, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS same_status, CASE WHEN count(DISTINCT substr(o_orderpriority, 1, 1)) = 1 THEN min(substr(o_orderpriority, 1, 1)) END AS same_digit FROM orders GROUP BY 1")
def hoist_constants(spark: SparkSession, d: str) -> DataFrame:
    """Fields with one value on all rows of a comparison move to its head."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.min(c))
    return table(spark, d, "orders").withColumn("digit", F.substring("o_orderpriority", 1, 1)).groupBy("o_orderpriority").agg(one("o_orderstatus").alias("same_status"), one("digit").alias("same_digit"))


@register("latency_percentiles", "SELECT event_type, median(value) AS median, list_sort(list(value))[CAST(floor(0.95 * count(*)) AS INT)] AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact median; the 95th percentile is the element at place floor(0.95 n). Both are read off places in one order over types and values, so that a type
    may hold any share of the events."""
    ranked = ordering.placed(table(spark, d, "events").select("event_type", "value", "event_id"), [F.col("event_type"), F.col("value"), F.col("event_id")])
    first, n = F.col("first"), F.col("n")
    places = [(first + F.floor((n - 1) / 2)).alias("low"), (first + F.floor(n / 2)).alias("high"), (first + F.floor(0.95 * n) - 1).alias("p95")]
    types = ranked.groupBy("event_type").agg(F.min("pos").alias("first"), F.count("*").alias("n")).select("event_type", *places)
    hit = ranked.join(F.broadcast(types), "event_type").filter(F.col("pos").isin(F.col("low"), F.col("high"), F.col("p95")))
    of = lambda k: F.max(F.when(F.col("pos") == F.col(k), F.col("value")))
    return hit.groupBy("event_type").agg(((of("low") + of("high")) / 2).alias("median"), of("p95").alias("p95"))
