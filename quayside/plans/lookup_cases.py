"""Predicates, lookups and folds over cells, evidence and quotes: one query for each operation, over the driver's tables or stated cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import finance
from ._tables import table
from .catalog import given, register, rule, values

C = F.col
TODAY = "2026-06-15"

# ---- predicates over metadata ----
META = "id int, url string, source_url string, pdf_url string, kind string, image string, removed boolean, campaign_end string, end_date string, status string"
ROWS = [(1, "https://h/a", None, "", "text", None, None, "2026-07-01", None, None), (2, "", "https://h/a", None, "image", "https://h/i", False, "", "2026-01-01", "over"), (3, None, None, "https://h/c", "text", "", True, None, "", "over"), (4, None, "", None, "image", "https://h/j", None, None, None, "running"), (5, "https://h/b", "https://h/a", None, "text", None, False, "2026-06-15", "2020-01-01", None)]
fields = lambda: F.array("url", "source_url", "pdf_url")
some = lambda *cs: F.coalesce(*[F.nullif(C(c), F.lit("")) for c in cs])
SOME = lambda *cs: "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cs) + ")"
rule("tenant_predicate", "A bank's rows only, without those marked as removed; no mark is no removal.", META, ROWS, {"passes": lambda: (C("kind") == "text") & ~F.coalesce("removed", F.lit(False))}, {"passes": "kind = 'text' AND NOT coalesce(removed, false)"})
rule("document_predicate", "Any of the address fields, and the kind; the image only for images.", META, ROWS, {"passes": lambda: F.exists(fields(), lambda u: F.coalesce(u, F.lit("")) == "https://h/a") & ((C("kind") != "image") | (C("image") == "https://h/i"))}, {"passes": "list_contains([url, source_url, pdf_url], 'https://h/a') AND (kind <> 'image' OR image = 'https://h/i')"})
rule("first_end_date", "The first date that is filled.", META, ROWS, {"stop": lambda: F.coalesce(some("campaign_end", "end_date"), F.lit(""))}, {"stop": f"coalesce({SOME('campaign_end', 'end_date')}, '')"})
rule("first_source", "The first address that is filled.", META, ROWS, {"source": lambda: F.coalesce(some("url", "source_url", "pdf_url"), F.lit(""))}, {"source": f"coalesce({SOME('url', 'source_url', 'pdf_url')}, '')"})
rule("canonical_source", "The same over more fields, the image among them.", META, ROWS, {"source": lambda: F.coalesce(some("source_url", "url", "pdf_url", "image"), F.lit(""))}, {"source": f"coalesce({SOME('source_url', 'url', 'pdf_url', 'image')}, '')"})
rule("canonical_window", "Dates and status under the names of two generations.", META, ROWS, {"window": lambda: F.concat_ws("/", F.coalesce(some("campaign_end", "end_date"), F.lit("?")), F.coalesce(some("status"), F.lit("unknown")))}, {"window": f"concat_ws('/', coalesce({SOME('campaign_end', 'end_date')}, '?'), coalesce({SOME('status')}, 'unknown'))"})
rule("any_address_equals", "One condition over all fields that may hold an address.", META, ROWS, {"cites": lambda: F.exists(F.array("url", "source_url", "pdf_url", "image"), lambda u: F.coalesce(u, F.lit("")) == "https://h/i")}, {"cites": "list_contains([url, source_url, pdf_url, image], 'https://h/i')"})
END = SOME("campaign_end", "end_date")
rule("expired_predicate", "The date decides where there is one; else the producer's status.", META, ROWS, {"expired": lambda: F.when(some("campaign_end", "end_date").isNotNull(), some("campaign_end", "end_date") < TODAY).otherwise(F.coalesce(C("status") == "over", F.lit(False)))}, {"expired": f"CASE WHEN {END} IS NOT NULL THEN {END} < '{TODAY}' ELSE coalesce(status = 'over', false) END"})
rule("page_is_fresh", "A page whose window has not passed.", META, ROWS, {"fresh": lambda: F.coalesce(some("campaign_end") >= TODAY, F.lit(True))}, {"fresh": f"coalesce({SOME('campaign_end')} >= '{TODAY}', true)"})
rule("page_is_relevant", "A page stays unless it is tagged as irrelevant.", "id int, tag string", [(1, "gereksiz"), (2, "gerekli"), (3, None), (4, "")], {"stays": lambda: F.coalesce("tag", F.lit("")) != "gereksiz"}, {"stays": "coalesce(tag, '') <> 'gereksiz'"})


@register("optional_filters", f"SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 500 AND (doc_id % 5 <> 0 OR doc_id % 10 = 0)")
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """Only the filters that are given narrow a search; they reach the scan. An absent date passes."""
    given = {"lang": "en", "source": None}
    docs = table(spark, d, "documents")
    for name, value in given.items():
        docs = docs.filter(C(name) == value) if value is not None else docs
    end = F.when(C("doc_id") % 5 == 0, F.when(C("doc_id") % 10 == 0, TODAY).otherwise("2020-01-01"))
    return docs.filter(C("n_chars") >= 500).filter(end.isNull() | (end >= TODAY)).select("doc_id")


# ---- cells of comparison tables: a bank's row as "column=value|..." ----
CELLS = "bank string, cells string"
TABLE = [("A", "offers=Sunuluyor|rate=3,5|rate (Validity)=01/01/2026 - 01/02/2026"), ("B", "offers=Sunulmuyor|rate=|rate (Validity)="), ("C", "offers=|rate=|rate (Validity)="), ("D", "offers=Sunuluyor|rate=4|rate (Validity)=01/01/2026 - 31/12/2026"), ("E", "offers=Sunulmuyor|rate=Sunulmuyor|rate (Validity)=")]
cell_map = lambda: F.str_to_map("cells", F.lit("\\|"), F.lit("="))
CELL = lambda k: f"regexp_extract(cells, '(?:^|\\|){k.replace('(', chr(92) + '(').replace(')', chr(92) + ')')}=([^|]*)', 1)"
at = lambda k: F.coalesce(F.element_at(cell_map(), F.lit(k)), F.lit(""))
rule("row_has_content", "Whether any cell but the verdict's says something.", CELLS, TABLE, {"content": lambda: (at("rate") != "") & (F.lower(at("rate")) != "sunulmuyor")}, {"content": f"{CELL('rate')} <> '' AND lower({CELL('rate')}) <> 'sunulmuyor'"})
END_OF = f"strftime(try_strptime(string_split({CELL('rate (Validity)')}, ' - ')[2], '%d/%m/%Y'), '%Y-%m-%d')"
end_of = lambda: F.date_format(F.try_to_date(F.get(F.split(at("rate (Validity)"), " - "), F.lit(1)), "dd/MM/yyyy"), "yyyy-MM-dd")
rule("current_cells", "Cells whose own window has passed are blanked; the row stays.", CELLS, TABLE, {"rate": lambda: F.when(F.coalesce(end_of() < TODAY, F.lit(False)), F.lit(None)).otherwise(F.nullif(at("rate"), F.lit("")))}, {"rate": f"CASE WHEN coalesce({END_OF} < '{TODAY}', false) THEN NULL ELSE nullif({CELL('rate')}, '') END"})
rule("offer_verdict", "The verdict's column decides; else a row whose filled cells all refuse; no filled cell is unknown.", CELLS, TABLE, {"offers": lambda: F.when(at("offers") == "Sunuluyor", True).when(at("offers") == "Sunulmuyor", False)}, {"offers": f"CASE {CELL('offers')} WHEN 'Sunuluyor' THEN true WHEN 'Sunulmuyor' THEN false END"})
rule("expire_cells", "A cell whose sources have all passed is marked; the changes are counted.", CELLS, TABLE, {"rate": lambda: F.when(F.coalesce(end_of() < TODAY, F.lit(False)), "expired").otherwise(at("rate")), "changed": lambda: F.coalesce(end_of() < TODAY, F.lit(False)).cast("int")}, {"rate": f"CASE WHEN coalesce({END_OF} < '{TODAY}', false) THEN 'expired' ELSE {CELL('rate')} END", "changed": f"CAST(coalesce({END_OF} < '{TODAY}', false) AS INTEGER)"})
rule("all_sources_expired", "Sources, at least one, that have all passed.", "id int, ends string", [(1, "2026-01-01|2025-01-01"), (2, "2026-01-01|2027-01-01"), (3, "")], {"expired": lambda: (C("ends") != "") & F.forall(F.split("ends", "\\|"), lambda e: e < TODAY)}, {"expired": f"ends <> '' AND len(list_filter(string_split(ends, '|'), lambda e: e >= '{TODAY}')) = 0"})
KINDS = [("rate", "number", 40), ("bank", "text", 10), ("note", "text", 90), ("link", "link", 12), ("from", "date", 9)]
rule("filter_kind", "Which filter a column earns by its type and how many values it has.", "name string, type string, n_values int", KINDS, {"filter": lambda: F.when(C("type") == "number", "range").when((C("type") == "text") & (C("n_values") <= 25), "list").otherwise("none")}, {"filter": "CASE WHEN type = 'number' THEN 'range' WHEN type = 'text' AND n_values <= 25 THEN 'list' ELSE 'none' END"})
rule("searchable_column", "Columns that a free text search reads.", "name string, type string, n_values int", KINDS, {"searched": lambda: C("type").isin("text", "bank", "badge")}, {"searched": "type IN ('text', 'bank', 'badge')"})
PICKS = [("A", "A,B", "buy"), ("B", None, "sell"), ("C", "", "buy")]
rule("hidden_columns", "Columns left out by the picks of banks and side; no pick is not an empty pick.", "bank string, picked string, side string", PICKS, {"hidden": lambda: F.concat_ws("|", F.when(C("picked").isNotNull() & ~F.array_contains(F.split("picked", ","), C("bank")), "bank"), F.when(C("side") != "buy", "buy"), F.when(C("side") != "sell", "sell"))}, {"hidden": "concat_ws('|', CASE WHEN picked IS NOT NULL AND NOT list_contains(string_split(picked, ','), bank) THEN 'bank' END, CASE WHEN side <> 'buy' THEN 'buy' END, CASE WHEN side <> 'sell' THEN 'sell' END)"})
PRICES = [("USD", "1", 40.0, 41.0), ("USD", "1", 40.0, 60.0), ("XAU", "gram", 41.0, 40.0), ("EUR", "1", 0.0, 0.0), ("COIN", "coin", 10.0, 11.0), ("USD/EUR", "1", 1.0, 1.1)]
rule("broken_spread", "A spread that is missing, negative or above a quarter.", "code string, unit string, buy double, sell double", PRICES, {"broken": lambda: finance.spread_looks_broken(C("buy"), C("sell"))}, {"broken": "coalesce((sell - buy) / nullif((sell + buy) / 2, 0) * 100 > 25 OR (sell - buy) / nullif((sell + buy) / 2, 0) * 100 < 0, true)"})
rule("spread_percent", "The spread in percent of the middle.", "code string, unit string, buy double, sell double", PRICES, {"spread": lambda: F.round(finance.spread(C("buy"), C("sell")), 6)}, {"spread": "round(CASE WHEN buy + sell > 0 THEN (sell - buy) / ((sell + buy) / 2) * 100 END, 6)"})
rule("rate_group", "Parities, metals, coins and currencies.", "code string, unit string, buy double, sell double", PRICES, {"kind": lambda: F.when(C("code").contains("/"), "parity").when(C("unit") == "gram", "metal").when(C("unit") == "coin", "coin").otherwise("currency")}, {"kind": "CASE WHEN contains(code, '/') THEN 'parity' WHEN unit = 'gram' THEN 'metal' WHEN unit = 'coin' THEN 'coin' ELSE 'currency' END"})
LIMITS = [(100.0, 12, 50.0, 1000.0, 3, 36), (100.0, 12, 0.0, 0.0, 0, 0), (10.0, 12, 50.0, None, 3, 36), (100.0, 48, None, None, None, 36), (0.0, 12, None, None, None, None), (2000.0, 2, 50.0, 1000.0, 3, 36)]
rule("limit_reason", "Amount and term against the bounds that are declared; an absent bound and one of 0 are none.", "amount double, term int, low double, high double, least int, most int", LIMITS,
     {"reason": lambda: F.when((C("amount") <= 0) | (C("term") <= 0), "not positive").when(C("amount") > F.nullif("high", F.lit(0.0)), "amount above").when(C("amount") < C("low"), "amount below").when(C("term") > F.nullif("most", F.lit(0)), "term above").when(C("term") < C("least"), "term below")},
     {"reason": "CASE WHEN amount <= 0 OR term <= 0 THEN 'not positive' WHEN high <> 0 AND amount > high THEN 'amount above' WHEN amount < low THEN 'amount below' WHEN most <> 0 AND term > most THEN 'term above' WHEN term < least THEN 'term below' END"})
QUOTES = [(1000.0, 12, 95.0, 1140.0, 12, 3.0), (1000.0, 12, 0.0, 0.0, 0, 3.0), (1000.0, 12, 80.0, 960.0, 12, 3.0), (1000.0, 12, 95.0, 1140.0, 11, 3.0), (1000.0, 12, 84.0, 1008.0, 12, 3.0)]
rule("quote_reason", "The first rule that a quote breaks.", "amount double, term int, pay double, total double, n_rows int, rate double", QUOTES,
     {"reason": lambda: F.when(C("pay") <= 0, "no quote").when(C("total") <= C("amount"), "total not above amount").when((C("n_rows") > 0) & (C("n_rows") != C("term")), "plan length").when(C("total") - C("amount") < 0.5 * C("amount") * C("rate") / 100, "profit below half a month's")},
     {"reason": "CASE WHEN pay <= 0 THEN 'no quote' WHEN total <= amount THEN 'total not above amount' WHEN n_rows > 0 AND n_rows <> term THEN 'plan length' WHEN total - amount < 0.5 * amount * rate / 100 THEN 'profit below half a month''s' END"})
SHARES = [(1000.0, 32, 35.0, 40.0, 46.0), (1000.0, 32, 0.0, 0.0, 46.0), (1000.0, 32, 41.0, 40.0, 46.0), (1000.0, 32, 3.0, 4.0, 46.0)]
rule("profit_share_reason", "Net above zero, gross not below net, and the gross has to follow from the yearly rate.", "amount double, days int, net double, gross double, rate double", SHARES,
     {"reason": lambda: F.when(C("net") <= 0, "no profit").when(C("gross") < C("net"), "gross below net").when(F.abs(C("gross") - C("amount") * C("rate") / 100 * C("days") / 365) > 0.15 * C("gross"), "rate contradicts")},
     {"reason": "CASE WHEN net <= 0 THEN 'no profit' WHEN gross < net THEN 'gross below net' WHEN abs(gross - amount * rate / 100 * days / 365) > 0.15 * gross THEN 'rate contradicts' END"})

# ---- lookups ----
M = "(SELECT p_brand AS bank, p_type AS family, p_name AS product FROM part)"
B = "(SELECT DISTINCT p_brand AS bank, CASE WHEN length(p_brand) = 7 THEN 'rates' ELSE 'finance,rates' END AS can FROM part)"


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return given(spark, d, M[1:-1]), given(spark, d, B[1:-1])


@register("scope_by_capability", f"SELECT bank FROM {B} WHERE list_contains(string_split(can, ','), 'finance')")
def scope_by_capability(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d)[1].filter(F.array_contains(F.split("can", ","), "finance")).select("bank")


@register("family_in_scope", f"SELECT b.bank, coalesce(m.product, 'not offered') AS product FROM {B} b LEFT JOIN (SELECT * FROM {M} WHERE family = 'SMALL') m ON b.bank = m.bank WHERE list_contains(string_split(can, ','), 'finance')")
def family_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Members of a family at the banks in scope; a bank without one says so."""
    m, b = _two(spark, d)
    scope = b.filter(F.array_contains(F.split("can", ","), "finance")).select("bank")
    return scope.join(m.filter("family = 'SMALL'").select("bank", "product"), "bank", "left").select("bank", F.coalesce("product", F.lit("not offered")).alias("product"))


@register("members_without_capability", f"SELECT bank, family, product FROM {M} m WHERE NOT EXISTS (SELECT 1 FROM {B} b WHERE b.bank = m.bank AND list_contains(string_split(can, ','), 'finance'))")
def members_without_capability(spark: SparkSession, d: str) -> DataFrame:
    m, b = _two(spark, d)
    return m.join(b.filter(F.array_contains(F.split("can", ","), "finance")).select("bank"), "bank", "left_anti").select("bank", "family", "product")


@register("first_member_of_bank", f"SELECT bank, family, min(product) AS product FROM {M} GROUP BY 1, 2")
def first_member_of_bank(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d)[0].groupBy("bank", "family").agg(F.min("product").alias("product"))


ALIASES = [("ev", "SMALL"), ("konut", "SMALL"), ("araba", "ECONOMY")]
NAMES_ASKED = "SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'ev' WHEN 1 THEN 'araba' WHEN 2 THEN lower(p_type) ELSE p_type END AS asked FROM part"


@register("family_by_alias", f"SELECT a.asked, coalesce(f.family, a.asked) AS family, count(m.product) AS n FROM ({NAMES_ASKED}) a LEFT JOIN {values('alias string, family string', ALIASES)} f ON f.alias = a.asked LEFT JOIN {M} m ON m.family = coalesce(f.family, a.asked) GROUP BY 1, 2")
def family_by_alias(spark: SparkSession, d: str) -> DataFrame:
    """Members of every family asked for, by any of its names; the names are a short list."""
    alias = F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES for x in kv]), C("asked"))
    named = given(spark, d, NAMES_ASKED).select("asked", F.coalesce(alias, "asked").alias("family"))
    counts = _two(spark, d)[0].groupBy("family").agg(F.count("product").alias("n"))
    return named.join(counts, "family", "left").select("asked", "family", F.coalesce("n", F.lit(0)).alias("n"))


@register("fan_out_outcomes", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'answer' END AS outcome, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY 1")
def fan_out_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every key that is asked ends in exactly one class of outcome."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(C("o_orderstatus") == "P", "error").otherwise("answer").alias("outcome"))
    return o.groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


@register("rate_code_resolved", "WITH q AS (SELECT unnest(['Brand#2', 'BRAND#3', 'gold', 'none']) AS asked), a AS (SELECT 'gold' AS alias, 'Brand#4' AS code), c AS (SELECT DISTINCT p_brand AS code FROM part) SELECT asked, coalesce((SELECT c.code FROM a JOIN c ON a.code = c.code WHERE alias = asked), (SELECT code FROM c WHERE code = asked), (SELECT min(code) FROM c WHERE lower(code) = lower(asked))) AS code FROM q")
def rate_code_resolved(spark: SparkSession, d: str) -> DataFrame:
    """An alias first, then the code itself, then the code without case."""
    asked = spark.createDataFrame([(x,) for x in ("Brand#2", "BRAND#3", "gold", "none")], "asked string")
    codes = table(spark, d, "part").select(C("p_brand").alias("code")).distinct()
    alias = spark.createDataFrame([("gold", "Brand#4")], "alias string, target string")
    tried = asked.join(alias, C("asked") == C("alias"), "left").join(codes.select(C("code").alias("a")), C("target") == C("a"), "left").join(codes.select(C("code").alias("b")), C("asked") == C("b"), "left")
    folded = codes.groupBy(F.lower("code").alias("k")).agg(F.min("code").alias("c"))
    return tried.join(folded, F.lower("asked") == C("k"), "left").select("asked", F.coalesce("a", "b", "c").alias("code"))


@register("rates_by_codes", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#4', 'Brand#2')")
def rates_by_codes(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the codes asked for, aliases resolved."""
    wanted = spark.createDataFrame([("gold", "Brand#4"), ("Brand#2", "Brand#2")], "asked string, code string")
    return table(spark, d, "part").select("p_partkey", "p_brand").join(F.broadcast(wanted), C("p_brand") == C("code"), "left_semi")


BANDS = [(1, 12, 4.0), (12, 24, 3.5), (30, 36, 3.0)]
rule("first_band_of_term", "The first band whose ends hold the term.", "term int", [(t,) for t in (0, 1, 12, 24, 27, 36, 40)], {"rate": lambda: F.coalesce(*[F.when(C("term").between(a, b), F.lit(r)) for a, b, r in BANDS])}, {"rate": "CASE " + " ".join(f"WHEN term BETWEEN {a} AND {b} THEN {r}" for a, b, r in BANDS) + " END"})


@register("live_source_of_tool", "SELECT n_name AS bank, r_name AS tool, 'https://' || lower(r_name) || '.example/' || n_nationkey AS page FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def live_source_of_tool(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), C("n_regionkey") == C("r_regionkey"), "left")
    return n.select(C("n_name").alias("bank"), C("r_name").alias("tool"), F.concat(F.lit("https://"), F.lower("r_name"), F.lit(".example/"), C("n_nationkey").cast("string")).alias("page"))


@register("first_link_to_file", """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1)) AS href, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>([^<]*)<', 1)) AS label FROM pages) SELECT href, arg_min(page_id, page_id) AS first_page, count(DISTINCT page_id) AS n_pages FROM a GROUP BY href""")
def first_link_to_file(spark: SparkSession, d: str) -> DataFrame:
    """The first page that links to a file, which gives its context."""
    each = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"[^>]*>'), F.lit(1))).alias("href"))
    return each.groupBy("href").agg(F.min("page_id").alias("first_page"), F.count_distinct("page_id").alias("n_pages"))


@register("payloads_merged", "SELECT doc_id, 'new' AS side FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'old' FROM documents WHERE n_chars >= 500 AND lang <> 'en' AND lang <> 'de'")
def payloads_merged(spark: SparkSession, d: str) -> DataFrame:
    """New payloads (one language), and the old ones (long texts) that have no new one and are still wanted."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    new, old = docs.filter("lang = 'en'"), docs.filter("n_chars >= 500")
    kept = old.join(new.select("doc_id"), "doc_id", "left_anti").filter("lang != 'de'")
    return new.select("doc_id", F.lit("new").alias("side")).unionByName(kept.select("doc_id", F.lit("old").alias("side")))


@register("hits_still_published", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def hits_still_published(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose table still shows a row."""
    shown = table(spark, d, "part").filter("p_size <= 10").select("p_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(shown, C("l_partkey") == C("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")


@register("table_links_in_prose", "WITH l AS (SELECT conv_id, turn, 'see [t](/en/compare/cards?table=' || (conv_id % 40) || ') and [u](/en/compare/cards?table=' || (turn % 3) || ')' AS text FROM conversations), i AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[?]table=([0-9]+)', 1)) AS id FROM l) SELECT conv_id, id, min(turn) AS first_turn FROM i WHERE CAST(id AS INT) IN (SELECT n_nationkey FROM nation) GROUP BY 1, 2")
def table_links_in_prose(spark: SparkSession, d: str) -> DataFrame:
    """Tables that an answer links to, if there are such tables, each once by its first mention."""
    text = F.concat(F.lit("see [t](/en/compare/cards?table="), (C("conv_id") % 40).cast("string"), F.lit(") and [u](/en/compare/cards?table="), (C("turn") % 3).cast("string"), F.lit(")"))
    ids = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(text, F.lit("[?]table=([0-9]+)"), F.lit(1))).alias("id"))
    known = table(spark, d, "nation").select(C("n_nationkey").cast("string").alias("id"))
    return ids.join(known, "id", "left_semi").groupBy("conv_id", "id").agg(F.min("turn").alias("first_turn"))


@register("sources_audited", "WITH c AS (SELECT l_orderkey, l_suppkey, l_extendedprice AS priority, l_linenumber FROM lineitem), cited AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT l_orderkey, l_suppkey, max(priority) AS priority FROM c WHERE l_orderkey IN (SELECT o_orderkey FROM cited) GROUP BY 1, 2")
def sources_audited(spark: SparkSession, d: str) -> DataFrame:
    """Cited candidates, one of each address, the one of highest priority."""
    cited = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(C("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", C("l_extendedprice").alias("priority")).join(cited, "l_orderkey", "left_semi").groupBy("l_orderkey", "l_suppkey").agg(F.max("priority").alias("priority"))


@register("tool_evidence", "SELECT c.conv_id, c.turn, p.page_id FROM conversations c JOIN pages p ON p.page_id = c.conv_id * 7 + c.turn WHERE c.role = 'assistant'")
def tool_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tools beside the addresses that an answer cites."""
    said = table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", (C("conv_id") * 7 + C("turn")).alias("page_id"))
    return said.join(table(spark, d, "pages").select("page_id"), "page_id").select("conv_id", "turn", "page_id")


POINTS = "SELECT source AS doc, lang || '-' || doc_id AS point FROM documents"
CITED = "SELECT source AS doc, CASE doc_id % 3 WHEN 0 THEN lang || '-' || doc_id WHEN 1 THEN lang || '-' || CAST(floor(doc_id / 10) AS BIGINT) ELSE 'x' || lang || '-' || doc_id || '-y' END AS given FROM documents WHERE doc_id % 50 < 3"


@register(
    "evidence_resolved",
    f"""WITH p AS ({POINTS}), g AS (SELECT DISTINCT * FROM ({CITED})), m AS (SELECT g.doc, given, min(point) AS point, count(*) AS n FROM g JOIN p ON g.doc = p.doc AND (contains(point, given) OR contains(given, point)) GROUP BY 1, 2)
    SELECT g.doc, g.given, coalesce((SELECT min(point) FROM p WHERE point = g.given AND p.doc = g.doc), (SELECT point FROM m WHERE m.given = g.given AND m.doc = g.doc AND n = 1)) AS point FROM g""",
)
def evidence_resolved(spark: SparkSession, d: str) -> DataFrame:
    """An id as cited; else the only one of its document that holds it or is held by it. Ids meet over their substrings of the lengths that the cited ones have, and the cited ones over theirs, so no pairs of a document are formed."""
    points, cited = given(spark, d, POINTS), given(spark, d, CITED).distinct()
    parts = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substring(C(c), i, n)))))
    inside = points.select("doc", "point", F.explode(parts("point")).alias("given")).join(cited, ["doc", "given"]).select("doc", "given", "point")
    around = cited.select("doc", "given", F.explode(parts("given")).alias("point")).join(points, ["doc", "point"]).select("doc", "given", "point")
    near = inside.unionByName(around).distinct().groupBy("doc", "given").agg(F.count("*").alias("n"), F.min("point").alias("one"), F.max(F.when(C("point") == C("given"), C("point"))).alias("same"))
    return cited.join(near, ["doc", "given"], "left").select("doc", "given", F.coalesce("same", F.when(C("n") == 1, C("one"))).alias("point"))


# ---- chunks, votes and dates ----
VOTES = [("a", n, p) for n, p in ((0, 0), (3, 1), (3, 0), (9, 0), (10, 5), (10, 4), (12, 12))]
rule("page_relevance", "Below ten parts one vote for is enough; from ten on the majority, ties for; no votes are for.", "id string, n int, pros int", VOTES, {"relevant": lambda: F.when(C("n") == 0, True).when(C("n") < 10, C("pros") > 0).otherwise(C("n") - C("pros") <= C("pros"))}, {"relevant": "CASE WHEN n = 0 THEN true WHEN n < 10 THEN pros > 0 ELSE n - pros <= pros END"})
DATED = (
    "SELECT CAST(o_custkey AS STRING) AS page, o_orderkey AS pos, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS start, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1997 + o_orderkey % 5 AS STRING) || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 5) END AS stop, "
    "CASE o_orderstatus WHEN 'F' THEN 'over' WHEN 'O' THEN 'running' WHEN 'P' THEN '' END AS status FROM orders"
)


@register("dates_first_status", f"SELECT page, min(start) AS start, max(stop) AS stop, arg_min(status, pos) FILTER (coalesce(status, '') <> '') AS status FROM ({DATED}) GROUP BY page")
def dates_first_status(spark: SparkSession, d: str) -> DataFrame:
    """A page's dates over its parts: first start, last end, the first status that says something."""
    return given(spark, d, DATED).groupBy("page").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by(F.when(F.coalesce("status", F.lit("")) != "", C("status")), F.when(F.coalesce("status", F.lit("")) != "", C("pos"))).alias("status"))


@register("dates_last_status", f"SELECT page, min(start) AS start, max(stop) AS stop, arg_max(status, pos) FILTER (coalesce(status, '') <> '') AS status FROM ({DATED}) GROUP BY page")
def dates_last_status(spark: SparkSession, d: str) -> DataFrame:
    """The same with the last status."""
    return given(spark, d, DATED).groupBy("page").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max_by(F.when(F.coalesce("status", F.lit("")) != "", C("status")), F.when(F.coalesce("status", F.lit("")) != "", C("pos"))).alias("status"))


@register("dates_any_ended", f"SELECT page, min(start) AS start, max(stop) AS stop, coalesce(bool_or(status = 'over'), false) AS ended FROM ({DATED}) GROUP BY page")
def dates_any_ended(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, DATED).groupBy("page").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.coalesce(F.bool_or(C("status") == "over"), F.lit(False)).alias("ended"))


@register("cell_window", f"SELECT page, coalesce(min(start), '?') || ' - ' || coalesce(max(stop), '?') AS window_ FROM ({DATED}) GROUP BY page")
def cell_window(spark: SparkSession, d: str) -> DataFrame:
    """A cell's window: the hull of its sources'."""
    return given(spark, d, DATED).groupBy("page").agg(F.concat_ws(" - ", F.coalesce(F.min("start"), F.lit("?")), F.coalesce(F.max("stop"), F.lit("?"))).alias("window_"))


@register("validity_columns", f"SELECT page, 'rate' AS col, status AS value FROM ({DATED}) WHERE pos % 7 = 0 UNION ALL SELECT page, 'rate (Validity)', coalesce(min(start), '?') || ' - ' || coalesce(max(stop), '?') FROM ({DATED}) GROUP BY page")
def validity_columns(spark: SparkSession, d: str) -> DataFrame:
    """A column of validity beside each column of data."""
    rows = given(spark, d, DATED)
    made = cell_window(spark, d).select("page", F.lit("rate (Validity)").alias("col"), C("window_").alias("value"))
    return rows.filter("pos % 7 = 0").select("page", F.lit("rate").alias("col"), C("status").alias("value")).unionByName(made)


@register("row_stamp", f"SELECT page, max(start) AS start, CASE WHEN min(stop) >= max(start) THEN min(stop) END AS stop FROM ({DATED}) WHERE start IS NOT NULL AND stop IS NOT NULL GROUP BY page")
def row_stamp(spark: SparkSession, d: str) -> DataFrame:
    """A row's stamp: the intersection of its closed windows."""
    return given(spark, d, DATED).filter("start IS NOT NULL AND stop IS NOT NULL").groupBy("page").agg(F.max("start").alias("start"), F.min("stop").alias("e")).select("page", "start", F.when(C("e") >= C("start"), C("e")).alias("stop"))


WIDE = "SELECT p_partkey AS k, CASE WHEN p_size > 10 THEN p_name ELSE '' END AS x, CASE WHEN p_size > 100 THEN p_type WHEN p_size > 20 THEN '' END AS y FROM part"


@register("columns_without_values", f"SELECT sum(CASE WHEN x IS NOT NULL AND x <> '' THEN 1 ELSE 0 END) = 0 AS x_empty, sum(CASE WHEN y IS NOT NULL AND y <> '' THEN 1 ELSE 0 END) = 0 AS y_empty FROM ({WIDE})")
def columns_without_values(spark: SparkSession, d: str) -> DataFrame:
    empty = lambda c: F.sum(F.when(F.coalesce(C(c), F.lit("")) != "", 1).otherwise(0)) == 0
    return given(spark, d, WIDE).agg(empty("x").alias("x_empty"), empty("y").alias("y_empty"))


# ---- counts ----
@register("documents_per_site", "SELECT source, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'all', count(*) FROM documents")
def documents_per_site(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each site and of all."""
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.unionByName(n.agg(F.lit("all").alias("source"), F.sum("n").alias("n")))


@register("unread_reports", "SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'O') AS unread FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def unread_reports(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").filter("o_orderstatus = 'O'").groupBy(C("o_custkey").alias("c_custkey")).agg(F.count("*").alias("unread"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["unread"])


@register("count_with_predicate", "SELECT count(*) AS n FROM events WHERE event_type = 'error' AND value > 20")
def count_with_predicate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'error' AND value > 20").agg(F.count("*").alias("n"))


@register("ledger_stage_counts", "WITH l AS (SELECT user_id % 4 AS stage, event_id % 500 AS url, arg_max(event_type, event_id) AS decision FROM events GROUP BY 1, 2) SELECT stage, decision, count(*) AS n FROM l GROUP BY 1, 2")
def ledger_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """The latest entry of each stage and address, counted by decision."""
    last = table(spark, d, "events").groupBy((C("user_id") % 4).alias("stage"), (C("event_id") % 500).alias("url")).agg(F.max_by("event_type", "event_id").alias("decision"))
    return last.groupBy("stage", "decision").agg(F.count("*").alias("n"))


@register("bank_state_pivot", "SELECT user_id % 10 AS bank, count(*) FILTER (event_type = 'view') AS ok, count(*) FILTER (event_type = 'error') AS down, count(*) FILTER (event_type NOT IN ('view', 'error')) AS known FROM events GROUP BY 1")
def bank_state_pivot(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(C("event_type") == "view", "ok").when(C("event_type") == "error", "down").otherwise("known")
    return table(spark, d, "events").select((C("user_id") % 10).alias("bank"), state.alias("state")).groupBy("bank").pivot("state", ["ok", "down", "known"]).count().na.fill(0)


@register("redundant_points", "WITH g AS (SELECT md5(text) AS fp, doc_id, n_chars FROM documents), r AS (SELECT fp, doc_id, row_number() OVER (PARTITION BY fp ORDER BY n_chars DESC, doc_id) AS rn, first_value(doc_id) OVER (PARTITION BY fp ORDER BY n_chars DESC, doc_id) AS canonical FROM g) SELECT doc_id, canonical FROM r WHERE rn > 1")
def redundant_points(spark: SparkSession, d: str) -> DataFrame:
    """Of points with one fingerprint all but the canonical one, and what takes their place."""
    own = table(spark, d, "documents").select(F.md5(C("text").cast("binary")).alias("fp"), "doc_id", "n_chars")
    first = own.groupBy("fp").agg(F.min_by("doc_id", F.struct(-C("n_chars"), "doc_id")).alias("canonical"), F.count("*").alias("n")).filter("n > 1")
    return own.join(first, "fp").filter("doc_id != canonical").select("doc_id", "canonical")


@register("canonical_point", "SELECT l_partkey, min(l_orderkey) AS canonical, max(n) AS refs FROM (SELECT l_partkey, l_orderkey, count(*) AS n, max(count(*)) OVER (PARTITION BY l_partkey) AS most FROM lineitem GROUP BY 1, 2) WHERE n = most GROUP BY 1")
def canonical_point(spark: SparkSession, d: str) -> DataFrame:
    """The one with most references, the smallest id of equals."""
    n = table(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.count("*").alias("n"))
    best = n.groupBy("l_partkey").agg(F.min(F.struct((-C("n")).alias("fewer"), "l_orderkey")).alias("b"))
    return best.select("l_partkey", C("b.l_orderkey").alias("canonical"), (-C("b.fewer")).alias("refs"))
