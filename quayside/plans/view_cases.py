"""Views, paging, set operations, chunk plans, comparisons, states and gates: one query for each operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compare, ordering, scan, search
from ._tables import table
from .catalog import given, register, rule
from .documents import fold_sql
from .given import GIVEN

C = F.col
ROUND = lambda c, n=4: F.round(c.cast("decimal(38,10)"), n).cast("double")
DEC = lambda e, n=4: f"CAST(round(CAST({e} AS DECIMAL(38,10)), {n}) AS DOUBLE)"

# ---- sorting, paging, listing ----
rule("default_sort", "How a category's table is sorted at first.", "category string", [(c,) for c in ("finance", "card", "profit_share", "exchange", "")], {"column": lambda: F.when(C("category").isin("finance", "card"), "instalment").when(C("category") == "profit_share", "net"), "descending": lambda: C("category") == "profit_share"}, {"column": "CASE WHEN category IN ('finance', 'card') THEN 'instalment' WHEN category = 'profit_share' THEN 'net' END", "descending": "category = 'profit_share'"})
rule("report_limit", "A limit between 1 and 100.", "asked int", [(n,) for n in (-1, 0, 1, 50, 100, 1000)], {"given": lambda: F.least(F.greatest("asked", F.lit(1)), F.lit(100))}, {"given": "least(greatest(asked, 1), 100)"})


@register("tables_by_match", "SELECT p_partkey, p_name, CASE WHEN p_name = 'small' THEN 3 WHEN starts_with(p_name, 'small') THEN 2 WHEN contains(p_name, 'small') THEN 1 ELSE 0 END AS score FROM part WHERE contains(p_name, 'small') ORDER BY score DESC, length(p_name), p_name, p_partkey LIMIT 20")
def tables_by_match(spark: SparkSession, d: str) -> DataFrame:
    """A top list: matches by score, then the shorter title, then the title."""
    score = F.when(C("p_name") == "small", 3).when(C("p_name").startswith("small"), 2).when(C("p_name").contains("small"), 1).otherwise(0)
    return table(spark, d, "part").select("p_partkey", "p_name", score.alias("score")).filter("score > 0").orderBy(C("score").desc(), F.length("p_name"), "p_name", "p_partkey").limit(20)


@register("bank_page_two", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_suppkey = 3 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5 OFFSET 5")
def bank_page_two(spark: SparkSession, d: str) -> DataFrame:
    """A bank's second page of five, best first: the page is the feature."""
    own = table(spark, d, "lineitem").filter("l_suppkey = 3").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return own.orderBy(C("l_extendedprice").desc(), "l_orderkey", "l_linenumber").offset(5).limit(5)


@register("survivors_paged", "SELECT p_partkey, p_retailprice FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def survivors_paged(spark: SparkSession, d: str) -> DataFrame:
    """The filter goes before the page: no more is fetched than the five that survive."""
    shown = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_partkey")
    return table(spark, d, "part").select("p_partkey", "p_retailprice").join(shown, C("p_partkey") == C("l_partkey"), "left_semi").orderBy(C("p_retailprice").desc(), "p_partkey").limit(5)


@register("best_of_each_document", "SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rn FROM lineitem WHERE l_returnflag <> 'R') WHERE rn = 1")
def best_of_each_document(spark: SparkSession, d: str) -> DataFrame:
    """Of a ranked scan without what has gone, the best of each document."""
    best = F.min_by(F.struct("l_partkey", "l_extendedprice"), F.struct(-C("l_extendedprice"), C("l_partkey")))
    return table(spark, d, "lineitem").filter("l_returnflag != 'R'").groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.*")


@register("build_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus <> 'F', o_custkey, o_orderkey) AS pos FROM orders")
def build_order(spark: SparkSession, d: str) -> DataFrame:
    """Reports with offers first, then by bank."""
    return ordering.placed(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), [C("o_orderstatus") != "F", C("o_custkey"), C("o_orderkey")]).select("o_orderkey", "pos")


@register("sections_by_size", "SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS pos FROM documents GROUP BY source")
def sections_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Children of a root by the pages below them; there are as many as sources."""
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return ordering.placed(n, [C("n").desc(), C("source")]).select("source", "n", "pos")


@register("newest_reports", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def newest_reports(spark: SparkSession, d: str) -> DataFrame:
    """A list's newest hundred that are unread: the limit is the feature."""
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate").orderBy(C("o_orderdate").desc(), "o_orderkey").limit(100)


@register("tables_of_category", "SELECT p_type, p_name FROM part WHERE p_brand = 'Brand#1' AND p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY 1, 2")
def tables_of_category(spark: SparkSession, d: str) -> DataFrame:
    """Tables of a category that show a row."""
    sold = table(spark, d, "lineitem").select("l_partkey")
    return table(spark, d, "part").filter("p_brand = 'Brand#1'").join(sold, C("p_partkey") == C("l_partkey"), "left_semi").select("p_type", "p_name").distinct()


CITED = [(1, "https://a", "A", 2), (2, "https://b", "B", None), (3, None, "C", 1)]
rule("citation_shape", "Citations as they go over the wire.", "id int, url string, title string, page int", CITED, {"shown": lambda: F.concat(C("title"), F.coalesce(F.concat(F.lit(" <"), C("url"), F.coalesce(F.concat(F.lit("#page="), C("page").cast("string")), F.lit("")), F.lit(">")), F.lit("")))}, {"shown": "title || coalesce(' <' || url || coalesce('#page=' || page, '') || '>', '')"})
rule("table_view", "What a table's page shows of a row: hidden columns out, a tone by how near the end is.", "col string, stop string", [("rate", "2026-07-01"), ("rate (Validity)", "2026-06-20"), ("note", "2026-06-01"), ("x", None)],
     {"shown": lambda: ~C("col").endswith(" (Validity)"), "tone": lambda: F.when(F.to_date("stop") < F.lit("2026-06-15").cast("date"), "past").when(F.datediff(F.to_date("stop"), F.lit("2026-06-15").cast("date")) <= 7, "soon").otherwise("calm")},
     {"shown": "NOT ends_with(col, ' (Validity)')", "tone": "CASE WHEN CAST(stop AS DATE) < DATE '2026-06-15' THEN 'past' WHEN date_diff('day', DATE '2026-06-15', CAST(stop AS DATE)) <= 7 THEN 'soon' ELSE 'calm' END"})

# ---- keys and sets ----
POINTS = [("p", "i", "image", 0, "t"), ("p", "i", "text", 0, "t"), ("p", None, "text", 0, "t"), ("q", None, "text", 1, "t")]
rule("document_key", "The image is part of the key of images only.", "page string, image string, kind string, idx int, body string", POINTS, {"key": lambda: F.concat_ws("/", "page", F.when(C("kind") == "image", F.coalesce("image", F.lit(""))).otherwise(""), "kind")}, {"key": "concat_ws('/', page, CASE WHEN kind = 'image' THEN coalesce(image, '') ELSE '' END, kind)"})
rule("point_key", "Document, place and exact text.", "page string, image string, kind string, idx int, body string", POINTS, {"key": lambda: F.sha2(F.concat_ws("|", "page", "kind", C("idx").cast("string"), "body"), 256)}, {"key": "sha256(concat_ws('|', page, kind, CAST(idx AS VARCHAR), body))"})


@register("sources_merged", "SELECT bank, point, min(side) AS side FROM (SELECT l_suppkey AS bank, l_partkey AS point, 1 AS side FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_suppkey, l_partkey, 2 FROM lineitem WHERE l_linenumber = 2) GROUP BY 1, 2")
def sources_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two tables' sources as one, each once; the first table's count first."""
    l = table(spark, d, "lineitem").filter("l_linenumber IN (1, 2)")
    return l.groupBy(C("l_suppkey").alias("bank"), C("l_partkey").alias("point")).agg(F.min(C("l_linenumber").cast("int")).alias("side"))


@register("cell_sources_merged", "SELECT l_suppkey AS bank, l_returnflag AS col, count(DISTINCT l_partkey) AS n_points FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2")
def cell_sources_merged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_linenumber <= 3").groupBy(C("l_suppkey").alias("bank"), C("l_returnflag").alias("col")).agg(F.count_distinct("l_partkey").alias("n_points"))


@register("entries_pruned", "SELECT conv_id, count(*) AS n_kept FROM conversations WHERE turn NOT IN (1, 3) GROUP BY conv_id")
def entries_pruned(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a text's entries without those that were discarded."""
    gone = spark.createDataFrame([(1,), (3,)], "turn long")
    return table(spark, d, "conversations").join(F.broadcast(gone), "turn", "left_anti").groupBy("conv_id").agg(F.count("*").alias("n_kept"))


@register("examined_once", "SELECT md5(html) AS digest, min(page_id) AS first_page, count(*) AS n FROM pages GROUP BY 1")
def examined_once(spark: SparkSession, d: str) -> DataFrame:
    """Content is examined once, whatever the number of pages that show it."""
    return table(spark, d, "pages").groupBy(F.md5(C("html").cast("binary")).alias("digest")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


@register("citations_first_order", "SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2")
def citations_first_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))


# ---- chunk plans ----
UNITS = [("campaign", "d1", 3, 0), ("pdf", "d2", 3, 2), ("page", "d3", 2, 1), ("page", "d4", 0, 0)]
rule("chunk_units", "A campaign is one unit, a PDF one a page, a page one a section, or one.", "kind string, doc string, n int, part int", UNITS, {"units": lambda: F.when(C("kind") == "campaign", 1).otherwise(F.greatest("n", F.lit(1)))}, {"units": "CASE WHEN kind = 'campaign' THEN 1 ELSE greatest(n, 1) END"})
rule("chunk_id", "A chunk's id: document, kind, unit, and the part where there are several.", "kind string, doc string, n int, part int", UNITS, {"id": lambda: F.concat(C("doc"), F.lit(":"), C("kind"), F.lit(":"), C("n").cast("string"), F.when(C("part") > 0, F.concat(F.lit("#"), C("part").cast("string"))).otherwise(""))}, {"id": "doc || ':' || kind || ':' || n || CASE WHEN part > 0 THEN '#' || part ELSE '' END"})
ITEMS = [("Fees <t1> and <t2>.", "<t1>", "12 TL"), ("No marker.", "<t1>", "12 TL"), ("<t1> twice <t1>", "<t1>", "a"), ("x", "", "")]
rule("page_with_items", "An item's text after its first marker, else at the end; an item without text is left out.", "body string, marker string, detail string", ITEMS,
     {"made": lambda: F.when(C("detail") == "", C("body")).when((C("marker") != "") & C("body").contains(C("marker")), F.concat(F.expr("substring(body, 1, instr(body, marker) - 1 + length(marker))"), F.lit("\n"), C("detail"), F.expr("substring(body, instr(body, marker) + length(marker))"))).otherwise(F.concat(C("body"), F.lit("\n\n"), C("detail")))},
     {"made": "CASE WHEN detail = '' THEN body WHEN marker <> '' AND contains(body, marker) THEN substr(body, 1, strpos(body, marker) - 1 + length(marker)) || chr(10) || detail || substr(body, strpos(body, marker) + length(marker)) ELSE body || chr(10) || chr(10) || detail END"})


@register("chunks_flattened", "SELECT 'doc' || (doc_id % 400) || ':0' AS key, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def chunks_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by key; of equal keys the last counts."""
    key = F.concat(F.lit("doc"), (C("doc_id") % 400).cast("string"), F.lit(":0"))
    return table(spark, d, "documents").groupBy(key.alias("key")).agg(F.max("doc_id").alias("doc_id"))


IMAGES = [("text\n![a](https://h/a.png)\nmore ![b](b.jpg)\n", 0), ("plain", 1)]
rule("images_apart", "A page's images and the text without them.", "body string, id int", IMAGES, {"images": lambda: F.array_join(F.regexp_extract_all("body", F.lit("!\\[[^\\]]*\\]\\(([^)]*)\\)"), F.lit(1)), "|"), "rest": lambda: F.regexp_replace("body", "!\\[[^\\]]*\\]\\([^)]*\\)", "")}, {"images": "array_to_string(regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)]*)\\)', 1), '|')", "rest": "regexp_replace(body, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g')"})
rule("strip_link_targets", "Links and images as what they say.", "body string, id int", [*IMAGES, ("see [rates](https://h/r) now", 2)], {"plain": lambda: X.strip_links(C("body"))}, {"plain": "regexp_replace(body, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')"})


@register("windows_without_overlap", "SELECT doc_id, k AS pos, md5(substr(text, k * 4000 + 1, 4000)) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0) // 4000)) AS k FROM documents)")
def windows_without_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Windows one after another, without overlap."""
    own = table(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / 4000).cast("int"))).alias("k"))
    return own.select("doc_id", C("k").cast("long").alias("pos"), F.md5(F.substring("text", C("k") * 4000 + 1, F.lit(4000)).cast("binary")).alias("piece"))


LENGTHS = [(n,) for n in (0, 100, 821, 8196, 8197, 20000, 120000)]
rule("window_starts", "Starts of windows of 8,196 that overlap by 820 and leave no gap.", "n int", LENGTHS, {"starts": lambda: F.array_join(X.window_starts(C("n"), 8196, 820).cast("array<string>"), "|")}, {"starts": "array_to_string(list_transform(generate_series(0, greatest(n - 820, 1) - 1, 7376), lambda s: CAST(s AS VARCHAR)), '|')"})
rule("answer_pieces", "A text in pieces of about ninety characters that end with a word and lose nothing.", "body string", [("word " * 60,), ("short",), ("x" * 200,)], {"n": lambda: F.size(F.regexp_extract_all("body", F.lit("(?s)(.{1,90}(?:\\s|$)|.{1,90})"), F.lit(1))), "whole": lambda: F.array_join(F.regexp_extract_all("body", F.lit("(?s)(.{1,90}(?:\\s|$)|.{1,90})"), F.lit(1)), "") == C("body")}, {"n": "CAST(len(regexp_extract_all(body, '(?s)(.{1,90}(?:\\s|$)|.{1,90})', 1)) AS INTEGER)", "whole": "array_to_string(regexp_extract_all(body, '(?s)(.{1,90}(?:\\s|$)|.{1,90})', 1), '') = body"})
SCREEN = [("rate 5 here " + "x" * 50 + " then fee 7", "rate|fee"), ("nothing", "rate"), ("", "rate")]
rule("screened_windows", "Windows that hold a word looked for; without any the first and the last.", "body string, wanted string", SCREEN, {"kept": lambda: F.array_join(_screened(), "|")},
     {"kept": "(WITH w AS (SELECT substr(body, s + 1, 20) AS w, s FROM (SELECT unnest(generate_series(0, greatest(length(body) - 1, 0), 20)) AS s)) SELECT CASE WHEN count(*) FILTER (regexp_matches(w, wanted)) > 0 THEN string_agg(w, '|' ORDER BY s) FILTER (regexp_matches(w, wanted)) WHEN count(*) = 1 THEN min(w) ELSE arg_min(w, s) || '|' || arg_max(w, s) END FROM w)"})


def _screened():
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.length("body") - 1, F.lit(0)), F.lit(20)), lambda s: F.substring("body", s + 1, F.lit(20)))
    hit = F.filter(each, lambda w: F.regexp_like(w, C("wanted")))
    return F.when(F.size(hit) > 0, hit).when(F.size(each) == 1, each).otherwise(F.array(F.get(each, F.lit(0)), F.element_at(each, -1)))


# ---- scores of search ----
WORDS = [("finansman", "konut finansmani"), ("kredi", "kredikarti"), ("konur", "konut finansmani"), ("finansmanlar", "konut finansmani"), ("xy", "konut"), ("kart", "kredikarti"), ("finansmna", "finansman"), ("ihtiyca", "ihtiyaclar kredisi")]
T = "list_filter(string_split_regex(field, '[^a-z0-9]+'), lambda t: t <> '')"
ANY = lambda test: f"len(list_filter({T}, lambda t: {test})) > 0"
rule("field_score", "How well one word meets one field, in tiers.", "word string, field string", WORDS, {"score": lambda: search.word_score(C("word"), F.filter(F.split("field", "[^a-z0-9]+"), lambda t: t != ""), C("field"))},
     {"score": f"CASE WHEN list_contains({T}, word) THEN 1.0 WHEN {ANY('starts_with(t, word) OR starts_with(word, t)')} THEN 0.85 WHEN contains(field, word) THEN 0.6 WHEN length(word) >= 4 AND {ANY('length(t) >= 4 AND substr(t, 1, 4) = substr(word, 1, 4)')} THEN 0.5 WHEN length(word) < 4 THEN 0.0 WHEN {ANY('levenshtein(t, word) <= CASE WHEN length(word) >= 7 THEN 2 ELSE 1 END')} THEN 0.4 WHEN {ANY('length(t) > length(word) AND levenshtein(substr(t, 1, length(word)), word) <= CASE WHEN length(word) >= 7 THEN 2 ELSE 1 END')} THEN 0.35 ELSE 0.0 END"})
rule("shared_prefix", "How many characters two words agree in from the left.", "word string, field string", WORDS, {"n": lambda: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length("word"), F.length("field")), F.lit(1))), lambda k: F.substring("word", F.lit(1), k) == F.substring("field", F.lit(1), k)))}, {"n": "CAST(len(list_filter(generate_series(1, greatest(least(length(word), length(field)), 1)), lambda k: substr(word, 1, k) = substr(field, 1, k))) AS INTEGER)"})
rule("within_edits", "Whether two words are within a number of edits.", "word string, field string", WORDS, {"near": lambda: F.levenshtein("word", "field", 2) >= 0}, {"near": "levenshtein(word, field) <= 2"})
rule("index_text", "What is embedded of a table: its title twice, then where it belongs and what it says.", "topic string, category string, note string", [("Home", "finance", "rates"), ("Car", "", "")], {"made": lambda: F.concat_ws("\n", "topic", "topic", "category", "note")}, {"made": "concat_ws(chr(10), topic, topic, category, note)"})


@register("indexed_fields", f"SELECT p_partkey, {fold_sql('p_name')} AS name, len(list_filter(string_split_regex({fold_sql('p_name')}, '[^a-z0-9]+'), lambda t: t <> '')) AS n_tokens FROM part")
def indexed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Each field folded and cut into words once."""
    name = F.translate(F.lower(F.translate("p_name", X.FOLD_FROM, X.FOLD_TO)), X.MARKS_FROM, X.MARKS_TO)
    return table(spark, d, "part").select("p_partkey", name.alias("name"), F.size(F.filter(F.split(name, "[^a-z0-9]+"), lambda t: t != "")).cast("long").alias("n_tokens"))


# ---- comparisons ----
KIND = "CASE l_linestatus WHEN 'F' THEN 'finance' ELSE 'account' END"


@register("quotes_by_type", f"SELECT {KIND} AS type, count(*) AS n, {DEC('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY 1")
def quotes_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of different kinds, parted by type."""
    return table(spark, d, "lineitem").groupBy(F.when(C("l_linestatus") == "F", "finance").otherwise("account").alias("type")).agg(F.count("*").alias("n"), ROUND(F.sum("l_extendedprice"), 2).alias("total"))


_FINANCE = "SELECT DISTINCT l_suppkey AS bank, p_partkey, p_size, p_retailprice FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'SMALL'"


@register(
    "finance_comparison",
    f"""WITH m AS ({_FINANCE}), q AS (SELECT bank, p_partkey, CASE WHEN 50000 > p_retailprice * p_size * 4 THEN 'amount above' WHEN 24 > p_size + 6 THEN 'term above' END AS r, round(50000 * (p_size / 1000.0) / (1 - pow(1 + p_size / 1000.0, -24)), 2) AS v FROM m),
    b AS (SELECT bank, arg_min(p_partkey, (v, p_partkey)) FILTER (r IS NULL) AS p_partkey, min(v) FILTER (r IS NULL) AS value, arg_min(r, p_partkey) FILTER (r IS NOT NULL) AS why FROM q GROUP BY bank),
    s AS (SELECT s_suppkey AS bank, p_partkey, value, CASE WHEN value IS NULL THEN coalesce(why, 'not offered') END AS reason FROM supplier LEFT JOIN b ON bank = s_suppkey WHERE s_acctbal >= 0)
    SELECT bank, p_partkey, value, reason, CASE WHEN value IS NOT NULL THEN CAST(rank() OVER (PARTITION BY value IS NULL ORDER BY value) AS INTEGER) END AS place FROM s""",
)
def finance_comparison(spark: SparkSession, d: str) -> DataFrame:
    """A family's instalment for 50,000 over 24 months at every bank with a calculator (here: with a balance): the best that its own limits allow, or why there is none."""
    rate = C("p_size") / 1000
    refusal = F.when(F.lit(50000) > C("p_retailprice") * C("p_size") * 4, "amount above").when(F.lit(24) > C("p_size") + 6, "term above")
    scope = table(spark, d, "supplier").filter("s_acctbal >= 0").select(C("s_suppkey").alias("bank"))
    return compare.compared(scope, "bank", given(spark, d, _FINANCE), "p_partkey", F.round(50000 * rate / (1 - F.pow(1 + rate, F.lit(-24))), 2), refusal, False)


_ACCOUNTS = "SELECT l_suppkey AS bank, CASE WHEN l_quantity < 13 THEN 32 WHEN l_quantity < 26 THEN 92 WHEN l_quantity < 39 THEN 181 ELSE 365 END AS days, max(l_tax) AS rate FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2"


@register(
    "account_comparison",
    f"""WITH m AS ({_ACCOUNTS}), q AS (SELECT bank, days, CASE WHEN abs(days - 90) > 0.15 * 90 THEN 'no band near the term' WHEN rate <= 0.02 THEN 'no profit' END AS r, round(10000 * rate * days / 365 * 0.95, 4) AS v FROM m),
    b AS (SELECT bank, arg_max(days, v) FILTER (r IS NULL) AS days, max(v) FILTER (r IS NULL) AS value, arg_min(r, days) FILTER (r IS NOT NULL) AS why FROM q GROUP BY bank),
    s AS (SELECT s_suppkey AS bank, days, value, CASE WHEN value IS NULL THEN coalesce(why, 'not offered') END AS reason FROM supplier LEFT JOIN b ON bank = s_suppkey WHERE s_acctbal >= 0)
    SELECT bank, days, value, reason, CASE WHEN value IS NOT NULL THEN CAST(rank() OVER (PARTITION BY value IS NULL ORDER BY value DESC) AS INTEGER) END AS place FROM s""",
)
def account_comparison(spark: SparkSession, d: str) -> DataFrame:
    """What 10,000 for about 90 days earn after tax at every bank with a calculator: the band within 15 percent of the term, or why there is none."""
    refusal = F.when(F.abs(C("days") - 90) > 0.15 * 90, "no band near the term").when(C("rate") <= 0.02, "no profit")
    scope = table(spark, d, "supplier").filter("s_acctbal >= 0").select(C("s_suppkey").alias("bank"))
    return compare.compared(scope, "bank", given(spark, d, _ACCOUNTS), "days", F.round(10000 * C("rate") * C("days") / 365 * 0.95, 4), refusal, True)


@register("card_comparison", "SELECT n_name AS bank, s_suppkey AS card, s_acctbal AS payment, rank() OVER (PARTITION BY n_name ORDER BY s_acctbal) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def card_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every card of every bank, cheapest first within it."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), C("s_nationkey") == C("n_nationkey"))
    return s.select(C("n_name").alias("bank"), C("s_suppkey").alias("card"), C("s_acctbal").alias("payment"), F.rank().over(W.partitionBy("n_name").orderBy("s_acctbal")).alias("place"))


@register(
    "exchange_comparison",
    """WITH r AS (SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'view') AS buy, arg_max(value, event_id) FILTER (event_type = 'click') AS sell FROM events GROUP BY 1),
    s AS (SELECT user_id, round(CASE WHEN buy >= 5 AND sell >= 5 THEN 100 * buy / sell END, 6) AS value, CASE WHEN coalesce(buy, 0) < 5 THEN 'no rate of the source' WHEN coalesce(sell, 0) < 5 THEN 'no rate of the target' END AS reason FROM r)
    SELECT user_id, CASE WHEN value IS NOT NULL THEN 0 END AS board, value, reason, CASE WHEN value IS NOT NULL THEN CAST(rank() OVER (PARTITION BY value IS NULL ORDER BY value DESC) AS INTEGER) END AS place FROM s""",
)
def exchange_comparison(spark: SparkSession, d: str) -> DataFrame:
    """What a hundred of one currency give in another at every bank, worked out from its latest two rates, or which of them is missing."""
    e = table(spark, d, "events")
    last = lambda kind: F.max_by("value", F.when(C("event_type") == kind, C("event_id")))
    rates = e.groupBy("user_id").agg(last("view").alias("buy"), last("click").alias("sell")).withColumn("board", F.lit(0))
    refusal = F.when(F.coalesce("buy", F.lit(0.0)) < 5, "no rate of the source").when(F.coalesce("sell", F.lit(0.0)) < 5, "no rate of the target")
    return compare.compared(rates, "user_id", rates, "board", F.round(F.try_divide(100 * C("buy"), C("sell")), 6), refusal, True)


VARIANTS = [("A", "car", "12-36", False), ("B", "car", None, True)]
rule("quote_variant", "A quote carries its variant and whether it is a general product.", "bank string, family string, variant string, broad boolean", VARIANTS, {"label": lambda: F.concat_ws(" ", "bank", "family", F.concat(F.lit("("), C("variant"), F.lit(")")), F.when(C("broad"), "[general]"))}, {"label": "concat_ws(' ', bank, family, '(' || variant || ')', CASE WHEN broad THEN '[general]' END)"})
rule("percent_shown", "Percentages to two places.", "rate double", [(3.14159,), (0.0,), (None,), (-1.239,)], {"shown": lambda: F.round("rate", 2)}, {"shown": "round(rate, 2)"})
FIN = [("A", 950.5, 12, 3.9, None), ("B", None, 12, None, "no quote")]
FS = "bank string, pay double, term int, rate double, reason string"
rule("finance_row", "A row of a finance table.", FS, FIN, {"row": lambda: F.concat_ws("|", "bank", C("pay").cast("decimal(18,2)").cast("string"), (C("pay") * C("term")).cast("decimal(18,2)").cast("string"), C("rate").cast("decimal(8,2)").cast("string"), "reason")}, {"row": "concat_ws('|', bank, CAST(CAST(pay AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(pay * term AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(rate AS DECIMAL(8,2)) AS VARCHAR), reason)"})
rule("account_row", "A row of an account table.", FS, FIN, {"row": lambda: F.concat_ws("|", "bank", F.coalesce(C("pay").cast("decimal(18,2)").cast("string"), "reason"))}, {"row": "concat_ws('|', bank, coalesce(CAST(CAST(pay AS DECIMAL(18,2)) AS VARCHAR), reason))"})
rule("conversion_row", "A row of a conversion table.", FS, FIN, {"row": lambda: F.concat_ws("|", "bank", (C("pay") / C("rate")).cast("decimal(18,4)").cast("string"))}, {"row": "concat_ws('|', bank, CAST(CAST(pay / rate AS DECIMAL(18,4)) AS VARCHAR))"})
rule("card_row", "A row of a card table.", FS, FIN, {"row": lambda: F.concat_ws("|", "bank", C("term").cast("string"), C("pay").cast("decimal(18,2)").cast("string"))}, {"row": "concat_ws('|', bank, CAST(term AS VARCHAR), CAST(CAST(pay AS DECIMAL(18,2)) AS VARCHAR))"})
rule("mile_row", "A row of a table of reward rates, the tier with a capital in front.", "card string, tier string, rate double", [("c", "gold", 1.5), ("d", "", 2.0)], {"row": lambda: F.concat_ws("|", "card", F.concat(F.upper(F.substring("tier", 1, 1)), F.substring("tier", 2, 100)), C("rate").cast("decimal(8,2)").cast("string"))}, {"row": "concat_ws('|', card, upper(substr(tier, 1, 1)) || substr(tier, 2), CAST(CAST(rate AS DECIMAL(8,2)) AS VARCHAR))"})
rule("quote_basis", "What a quote rests on, the parts that apply.", "own boolean, derived boolean, general boolean", [(True, False, True), (False, False, False), (True, True, True)], {"basis": lambda: F.concat_ws(" · ", F.when(C("own"), "own rate"), F.when(C("derived"), "derived"), F.when(C("general"), "general product"))}, {"basis": "concat_ws(' · ', CASE WHEN own THEN 'own rate' END, CASE WHEN derived THEN 'derived' END, CASE WHEN general THEN 'general product' END)"})

# ---- states and gates ----
STATES = [("A", "rates", "ok", "down"), ("B", "rates", None, "ok"), ("C", "rates", None, "down"), ("D", "rates", "down", "down"), ("E", "rates", "down", None)]
SS = "bank string, can string, before string, now string"
rule("state_merged", "The state after a round; what was not looked at keeps its own.", SS, STATES, {"after": lambda: F.coalesce("now", "before")}, {"after": "coalesce(now, before)"})
rule("state_change", "Changes only; being fine when first seen is silent.", SS, STATES, {"changed": lambda: F.when(C("before").isNull(), C("now") != "ok").otherwise(F.coalesce(C("now") != C("before"), F.lit(False)))}, {"changed": "CASE WHEN before IS NULL THEN now <> 'ok' ELSE coalesce(now <> before, false) END"})
rule("outage_lookup", "Unknown is fine.", SS, STATES, {"down": lambda: F.coalesce(C("now") == "down", F.lit(False))}, {"down": "coalesce(now = 'down', false)"})
rule("product_outage_lookup", "A product's outage by its folded key.", "key string, asked string", [("Konut Kredisi", "KONUT-KREDİSİ"), ("Araç", "arac"), ("x", "y")], {"down": lambda: X.fold(C("key")) == X.fold(C("asked"))}, {"down": f"regexp_replace({fold_sql('key')}, '[^a-z0-9]', '', 'g') = regexp_replace({fold_sql('asked')}, '[^a-z0-9]', '', 'g')"})
OPERANDS = [("rate", "USD", "buy"), ("rate", "USD", "sell"), ("constant", "", ""), ("finance", "car", "pay")]
rule("operand_key", "What may be compared with what.", "kind string, what string, field string", OPERANDS, {"key": lambda: F.when(C("kind") == "constant", F.lit(None)).otherwise(F.concat_ws("/", "kind", "what"))}, {"key": "CASE WHEN kind <> 'constant' THEN concat_ws('/', kind, what) END"})
VERDICTS = [("b1", "f1", "f1", None), ("b2", "f2", "f9", None), ("b3", None, "f3", "DIVE")]
rule("verdict_gate", "A verdict is used again where the branch's fingerprint is the same; a new branch of a known site is followed.", "branch string, before string, now string, verdict string", VERDICTS, {"next": lambda: F.when(C("before") == C("now"), "reuse").when(C("before").isNull(), F.coalesce("verdict", F.lit("DIVE"))).otherwise("ask")}, {"next": "CASE WHEN before = now THEN 'reuse' WHEN before IS NULL THEN coalesce(verdict, 'DIVE') ELSE 'ask' END"})


@register("verdict_cache", "SELECT user_id % 50 AS branch, arg_max(event_type, event_id) AS verdict, max(event_id) AS at FROM events GROUP BY 1")
def verdict_cache(spark: SparkSession, d: str) -> DataFrame:
    """The last verdict of each branch."""
    return table(spark, d, "events").groupBy((C("user_id") % 50).alias("branch")).agg(F.max_by("event_type", "event_id").alias("verdict"), F.max("event_id").alias("at"))


@register("capability_gate", "SELECT DISTINCT event_type AS capability, e.user_id AS bank FROM events e JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) s USING (user_id) WHERE last <> 'error'")
def capability_gate(spark: SparkSession, d: str) -> DataFrame:
    """Capabilities of banks whose last check was no error."""
    e = table(spark, d, "events").select(C("event_type").alias("capability"), C("user_id").alias("bank"), "ts", "event_id")
    down = e.groupBy("bank").agg(F.max_by("capability", F.struct("ts", "event_id")).alias("last")).filter("last = 'error'")
    return e.select("capability", "bank").distinct().join(down, "bank", "left_anti").select("capability", "bank")


@register("alerts_by_automation", "SELECT user_id, count(*) AS n_runs, count(*) FILTER (hit AND NOT coalesce(before, false)) AS n_alerts FROM (SELECT user_id, value > 60 AS hit, lag(value > 60) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1")
def alerts_by_automation(spark: SparkSession, d: str) -> DataFrame:
    """Alerts on the turn of a condition, by automation."""
    hit = C("value") > 60
    e = scan.ranged(table(spark, d, "events").select("user_id", "ts", "event_id", hit.alias("hit")), ["user_id"], ["ts", "event_id"])
    e = scan.previous(e, ["user_id"], ["ts", "event_id"], "hit", "before")
    return e.groupBy("user_id").agg(F.count("*").alias("n_runs"), F.count_if(C("hit") & ~F.coalesce("before", F.lit(False))).alias("n_alerts"))


@register("index_gate", "SELECT source, count(*) AS held, count(*) FILTER (doc_id % 7 = 0) AS deleted, count(*) FILTER (doc_id % 7 = 0) > 0.2 * count(*) AS refused FROM documents GROUP BY source")
def index_gate(spark: SparkSession, d: str) -> DataFrame:
    """Deletions above a fifth of what is held are refused."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("held"), F.count_if(C("doc_id") % 7 == 0).alias("deleted")).withColumn("refused", C("deleted") > 0.2 * C("held"))


@register(
    "publish_gate",
    """WITH n AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars < 40) AS bad FROM documents WHERE source IS NOT NULL AND length(source) % 3 <> 1 OR n_chars % 8 <> 0 GROUP BY source), p AS (SELECT source, count(*) AS was FROM documents GROUP BY source)
    SELECT source, coalesce(n, 0) AS n, was, CASE WHEN coalesce(n, 0) = 0 THEN 'no documents' WHEN bad > 0.2 * n THEN 'errors' WHEN 100 * (1 - n / was) > 10 THEN 'shrunk' ELSE 'ok' END AS verdict FROM p LEFT JOIN n USING (source)""",
)
def publish_gate(spark: SparkSession, d: str) -> DataFrame:
    """A build is refused for a site without documents, too many errors, or more than a tenth fewer documents than the build before. The build before is the whole table; in this one some sites lack the
    documents whose length is a multiple of eight."""
    docs = table(spark, d, "documents")
    now = docs.filter((C("source").isNotNull() & (F.length("source") % 3 != 1)) | (C("n_chars") % 8 != 0)).groupBy("source").agg(F.count("*").alias("n"), F.count_if(C("n_chars") < 40).alias("bad"))
    before = docs.groupBy("source").agg(F.count("*").alias("was"))
    g = before.join(now, before["source"].eqNullSafe(now["source"]), "left").select(before["source"], F.coalesce("n", F.lit(0)).alias("n"), "was", "bad")
    shrink = 100 * (1 - C("n") / C("was"))
    return g.select("source", "n", "was", F.when(C("n") == 0, "no documents").when(C("bad") > 0.2 * C("n"), "errors").when(shrink > 10, "shrunk").otherwise("ok").alias("verdict"))


PROBES = [("A", "rates", 1.0, True, True), ("A", "cards", 9.0, True, True), ("B", "rates", 1.0, False, True), ("B", "cards", 1.0, False, False)]
PS = "bank string, can string, secs double, first boolean, again boolean"
rule("probe_outcome", "What a probe says: too slow, known, down or fine.", PS, PROBES, {"state": lambda: F.when(C("secs") > 5, "slow").when(C("first"), "ok").otherwise("down")}, {"state": "CASE WHEN secs > 5 THEN 'slow' WHEN first THEN 'ok' ELSE 'down' END"})
rule("audit_outcome", "A failure counts only when it fails again.", PS, PROBES, {"failed": lambda: ~C("first") & ~C("again")}, {"failed": "NOT first AND NOT again"})


@register("health_by_bank", f"SELECT bank, count(*) FILTER (first) AS ok, count(*) FILTER (NOT first) AS down FROM ({GIVEN[PS]}) GROUP BY bank")
def health_by_bank(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, GIVEN[PS]).groupBy("bank").agg(F.count_if(C("first")).alias("ok"), F.count_if(~C("first")).alias("down"))


WIDTHS = [(1, "a|b|c", 3), (2, "a|b", 3), (3, "a|b|c|d", 3)]
rule("export_row_width", "A row has as many cells as there are columns.", "id int, cells string, n_columns int", WIDTHS, {"fits": lambda: F.size(F.split("cells", "\\|")) == C("n_columns")}, {"fits": "len(string_split(cells, '|')) = n_columns"})
rule("padded_row", "A short row is padded, a long one keeps its cells under made-up names.", "id int, cells string, n_columns int", WIDTHS, {"keys": lambda: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("cells", "\\|")), C("n_columns"))), lambda k: F.concat(F.lit("col"), k.cast("string"), F.lit("="), F.coalesce(F.get(F.split("cells", "\\|"), k - 1), F.lit("-")))), "|")},
     {"keys": "array_to_string(list_transform(generate_series(1, greatest(len(string_split(cells, '|')), n_columns)), lambda k: 'col' || k || '=' || coalesce(string_split(cells, '|')[k], '-')), '|')"})
LABELS = [("Rate|rate|RATE!|Bank|rate 2",)]
rule("column_keys", "Keys of column labels, made unique by -2, -3.", "labels string", LABELS, {"keys": lambda: F.array_join(_keys(), "|")},
     {"keys": "(WITH l AS (SELECT regexp_replace(lower(unnest(string_split(labels, '|'))), '[^a-z0-9]+', '', 'g') AS k, generate_subscripts(string_split(labels, '|'), 1) AS n) SELECT string_agg(k || CASE WHEN r > 1 THEN '-' || r ELSE '' END, '|' ORDER BY n) FROM (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) AS r FROM l))"})


def _keys():
    folded = F.transform(F.split("labels", "\\|"), lambda s: F.regexp_replace(F.lower(s), "[^a-z0-9]+", ""))
    nth = lambda k, i: F.size(F.filter(F.slice(folded, F.lit(1), i + 1), lambda o: o == k))
    return F.transform(folded, lambda k, i: F.when(nth(k, i) > 1, F.concat(k, F.lit("-"), nth(k, i).cast("string"))).otherwise(k))


ARGS = [('{"b":1,"a":"x"}', "n"), ('{"a":"x","b":1}', "n"), ('{"a":"y"}', "n")]
rule("args_fingerprint", "Equal arguments have one fingerprint, whatever their order.", "args string, name string", ARGS, {"print": lambda: F.sha2(F.concat_ws("|", "name", F.array_join(F.array_sort(F.transform(F.map_entries(F.from_json("args", "map<string,string>")), lambda e: F.concat_ws("=", e["key"], e["value"]))), "&")), 256)}, {"print": "sha256(name || '|' || array_to_string(list_sort(list_transform(json_keys(args), lambda k: k || '=' || json_extract_string(args, '$.' || k))), '&'))"})


@register("text_digest", "SELECT page_id, sha256(html) AS digest FROM pages")
def text_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


@register("payload_fingerprint", "SELECT doc_id, sha256(text || '|' || 'lang=' || lang || '&source=' || source) AS digest FROM documents")
def payload_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Content and metadata in order of name."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat(C("text"), F.lit("|lang="), C("lang"), F.lit("&source="), C("source")), 256).alias("digest"))


TIMES = [("3,1,1,9,-1,0",), ("",), ("6,5",)]
rule("clean_weekdays", "Days of the week, each once, in order, what is none left out.", "days string", TIMES, {"kept": lambda: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split("days", ","), lambda x: x.try_cast("int")), lambda n: n.between(0, 6)))).cast("array<string>"), ",")}, {"kept": "array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(string_split(days, ','), lambda x: TRY_CAST(x AS INTEGER)), lambda n: n BETWEEN 0 AND 6))), lambda n: CAST(n AS VARCHAR)), ',')"})
rule("schedule_text", "A schedule in words.", "hour int, minute int, days string", [(9, 5, "0,1,2,3,4,5,6"), (18, 30, "0,2")], {"shown": lambda: F.concat(F.lpad(C("hour").cast("string"), 2, "0"), F.lit(":"), F.lpad(C("minute").cast("string"), 2, "0"), F.when(F.size(F.split("days", ",")) == 7, " every day").otherwise(F.concat(F.lit(" on "), C("days"))))}, {"shown": "lpad(CAST(hour AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute AS VARCHAR), 2, '0') || CASE WHEN len(string_split(days, ',')) = 7 THEN ' every day' ELSE ' on ' || days END"})


@register("interval_runs", "SELECT event_id, CASE WHEN slot <= ts THEN slot + INTERVAL 15 MINUTE ELSE slot END AS next_run FROM (SELECT event_id, ts, time_bucket(INTERVAL 15 MINUTE, ts) AS slot FROM events)")
def interval_runs(spark: SparkSession, d: str) -> DataFrame:
    """The next quarter of an hour, strictly after."""
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900)
    return table(spark, d, "events").select("event_id", F.when(slot <= C("ts"), slot + F.expr("interval 15 minutes")).otherwise(slot).alias("next_run"))


@register("utc_stamp", "SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def utc_stamp(spark: SparkSession, d: str) -> DataFrame:
    """Local times as UTC stamps."""
    return table(spark, d, "events").select("event_id", F.date_format(F.to_utc_timestamp("ts", "Europe/Istanbul"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


ANY_CELL = [("text", "a", None), ("number", "12.5", None), ("bank", "A", None), ("date", "2026-01-02", None), ("link", "https://h/a", "A"), ("number", None, None)]
rule("cell_shown", "A cell as text by its column's type.", "type string, value string, label string", ANY_CELL, {"shown": lambda: F.coalesce(F.when(C("type") == "number", F.format_number(C("value").cast("double"), 2)).when(C("type") == "date", F.date_format(F.try_to_date("value", "yyyy-MM-dd"), "dd/MM/yyyy")).when(C("type") == "link", F.coalesce("label", "value")).otherwise(C("value")), F.lit("—"))}, {"shown": "coalesce(CASE type WHEN 'number' THEN format('{:,.2f}', CAST(value AS DOUBLE)) WHEN 'date' THEN strftime(try_strptime(value, '%Y-%m-%d'), '%d/%m/%Y') WHEN 'link' THEN coalesce(label, value) ELSE value END, '—')".replace("CAST(value AS DOUBLE)", "TRY_CAST(value AS DOUBLE)")})
rule("cell_time", "A cell as a time, or none.", "type string, value string, label string", ANY_CELL, {"at": lambda: F.try_to_timestamp("value", F.lit("yyyy-MM-dd"))}, {"at": "try_strptime(value, '%Y-%m-%d')"})
NUMBERS = [(1234.5, "TRY"), (0.0, "XAU"), (-7.25, "USD"), (None, "TRY")]
rule("money_shown", "Money, metals to four places.", "value double, code string", NUMBERS, {"shown": lambda: F.when(C("code").isin("XAU", "XAG"), F.format_number("value", 4)).otherwise(F.format_number("value", 2))}, {"shown": "CASE WHEN code IN ('XAU', 'XAG') THEN format('{:,.4f}', value) ELSE format('{:,.2f}', value) END"})
rule("rate_shown", "A rate with its sign in front.", "value double, code string", NUMBERS, {"shown": lambda: F.concat(F.lit("%"), F.translate(F.format_number("value", 2), ",.", ".,"))}, {"shown": "'%' || translate(format('{:,.2f}', value), ',.', '.,')"})
rule("number_shown", "A number with at most two places.", "value double, code string", NUMBERS, {"shown": lambda: F.regexp_replace(F.regexp_replace(F.format_number("value", 2), "0+$", ""), "\\.$", "")}, {"shown": "regexp_replace(regexp_replace(format('{:,.2f}', value), '0+$', ''), '\\.$', '')"})
rule("sheet_format", "A column's number format for a sheet.", "type string, unit string", [("money", "TRY"), ("money", "XAU"), ("rate", ""), ("text", "")], {"format": lambda: F.when((C("type") == "money") & C("unit").isin("XAU", "XAG"), "#,##0.0000").when(C("type") == "money", "#,##0.00").when(C("type") == "rate", "0.00%").otherwise("@")}, {"format": "CASE WHEN type = 'money' AND unit IN ('XAU', 'XAG') THEN '#,##0.0000' WHEN type = 'money' THEN '#,##0.00' WHEN type = 'rate' THEN '0.00%' ELSE '@' END"})
rule("sheet_name", "A legal name of a sheet of 31 characters at most.", "title string", [("Rates: all/of [them]?",), ("x" * 40,), ("",)], {"name": lambda: F.coalesce(F.nullif(F.substring(F.trim(F.regexp_replace("title", "[\\[\\]:*?/\\\\]", " ")), 1, 31), F.lit("")), F.lit("Sheet"))}, {"name": "coalesce(nullif(substr(trim(regexp_replace(title, '[\\[\\]:*?/\\\\]', ' ', 'g')), 1, 31), ''), 'Sheet')"})
rule("file_stem", "A file's name from a title and a moment.", "title string, day string", [("Konut Kâr!", "2026-01-02"), ("", "2026-01-02")], {"stem": lambda: F.concat_ws("_", X.slug(C("title"), "report"), "day")}, {"stem": f"concat_ws('_', coalesce(nullif(regexp_replace(substr(replace(trim(regexp_replace({fold_sql('title')}, '[^a-z0-9]+', ' ', 'g')), ' ', '-'), 1, 80), '-+$', ''), ''), 'report'), day)"})
