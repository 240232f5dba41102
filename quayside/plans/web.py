"""Queries over web structure: cells and options of pages, robots decisions, verdicts of an address tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from ..sources import markup, robots
from ._tables import dealt, table
from .catalog import register

C = F.col


def _money(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(14,2)").cast("string")


def plan_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each order, as banks write plans: an outer table with the order's lines in a table inside a cell, a header over two rows, end tags left out, entities."""
    line = F.concat(F.lit("<tr><td>"), C("l_linenumber"), F.lit("<td class='n>1'>"), _money(C("l_extendedprice")), F.lit("<!-- <td>no --><TD>"), _money(C("l_tax") * 100), F.lit("&nbsp;&#37;"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))).alias("ls"))
    inner = F.concat(F.lit("<table><thead><tr><th rowspan=2>No<th colspan=\"2\">Amounts<tr><th>Price<th>Tax</thead>"), F.array_join(F.transform("ls", lambda x: x["t"]), "\n"), F.lit("</table>"))
    page = F.concat(
        F.lit("<html><script>var x = '<table><td>';</script><body><table border=0><tr><th>Order<th>Lines</tr><tr><td><b>"), C("o_orderstatus"), F.lit("</b> &amp;\n "), C("o_orderpriority"), F.lit("<td>see "), inner, F.lit(" below</td></tr></table></body>"),
    )
    return table(spark, d, "orders").join(lines, C("o_orderkey") == C("l_orderkey")).select("o_orderkey", page.alias("page"))


@register(
    "html_table_cells",
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(CAST(round(l_extendedprice, 2) AS DECIMAL(14,2)) AS VARCHAR) AS p, CAST(CAST(round(l_tax * 100, 2) AS DECIMAL(14,2)) AS VARCHAR) || ' %' AS t FROM lineitem),
    r AS (SELECT *, CAST(1 + row_number() OVER (PARTITION BY k ORDER BY n, p, t) AS INTEGER) AS i FROM l), o AS (SELECT o_orderkey AS k, o_orderstatus || ' & ' || o_orderpriority AS s FROM orders WHERE o_orderkey IN (SELECT k FROM l)),
    h AS (SELECT * FROM (VALUES (0, NULL, 0, 0, 1, 1, true, 'Order'), (0, NULL, 0, 1, 1, 1, true, 'Lines'), (0, NULL, 1, 1, 1, 1, false, 'see below'), (1, 0, 0, 0, 2, 1, true, 'No'), (1, 0, 0, 1, 1, 2, true, 'Amounts'), (1, 0, 1, 1, 1, 1, true, 'Price'), (1, 0, 1, 2, 1, 1, true, 'Tax')) v(table_no, parent_table, row_no, col_no, row_span, col_span, is_header, cell))
    SELECT k AS o_orderkey, h.* FROM o, h UNION ALL SELECT k, 0, NULL, 1, 0, 1, 1, false, s FROM o UNION ALL SELECT k, 1, 0, i, 0, 1, 1, false, CAST(n AS VARCHAR) FROM r UNION ALL SELECT k, 1, 0, i, 1, 1, 1, false, p FROM r UNION ALL SELECT k, 1, 0, i, 2, 1, 1, false, t FROM r""",
)
def html_table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of every table of every plan page, at its place in the grid."""
    return markup.table_cells(plan_pages(spark, d), "o_orderkey", "page")


@register(
    "html_select_options",
    """WITH p AS (SELECT p_partkey, p_name, p_type, p_size, p_retailprice, unnest(generate_series(1, p_size)) AS k FROM part)
    SELECT p_partkey, CAST(0 AS INTEGER) AS select_no, 'term' AS select_name, CAST(k - 1 AS INTEGER) AS option_no, p_type || ' <' || p_name || '>' AS option_group, CAST(k AS VARCHAR) AS value, k || ' months' AS label, k = p_size AS selected, k % 7 = 0 AS disabled,
      '{"data-limit":"' || CAST(CAST(k * floor(p_retailprice) AS BIGINT) AS VARCHAR) || '"}' AS attributes FROM p
    UNION ALL SELECT p_partkey, 1, 'cur"x', CAST(i AS INTEGER), NULL, v, v, false, false, '{}' FROM part, (VALUES (0, 'TL'), (1, 'A & B')) x(i, v)""",
)
def html_select_options(spark: SparkSession, d: str) -> DataFrame:
    """Every option of every list of a form page for each product: groups, attributes, unclosed options, values left out."""
    one = lambda k: F.concat(F.lit("<option value="), k, F.lit(" data-limit='"), (k * F.floor("p_retailprice")).cast("long"), F.when(k == C("p_size"), "' selected").otherwise("'"), F.when(k % 7 == 0, " DISABLED>").otherwise(">"), k, F.lit("\n <i>months</i>"))
    page = F.concat(F.lit('<form><select name="term"><optgroup label="'), "p_type", F.lit(" &lt;"), "p_name", F.lit('&gt;">'), F.array_join(F.transform(F.sequence(F.lit(1), "p_size"), one), ""), F.lit("</select><select id='cur&quot;x'><option>TL</option><option>A &amp; B</select></form>"))
    part = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice"))
    return markup.select_options(part.select("p_partkey", page.alias("page")), "p_partkey", "page")


HOST, PATH = "lower(regexp_extract(url, '^https?://([^/]+)', 1))", "regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)"


def robots_files(pages: DataFrame) -> DataFrame:
    """A robots file for each host, made of its own addresses: one group for another crawler, one for two agents with a delay, an exception and a rule behind it, one for all others."""
    seg = F.regexp_extract("path", "^/([^/]*)", 1)
    of = pages.select("host", "path", seg.alias("s")).groupBy("host").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.min("path").alias("first"), F.count("*").alias("n"))
    text = F.concat(
        F.lit("# made\nUser-agent: Otherbot\nDisallow: /\n\nUSER-AGENT: quaybot # ours\nuser-agent: mirrorbot\r\nCrawl-delay: "), C("n") % 5, F.lit("\nAllow: "), "first", F.lit("\nDisallow: /"), "low", F.lit("/\nDisallow:"),
        F.when(C("n") % 2 == 0, F.concat(F.lit(" /"), "high")).otherwise(F.lit("")), F.lit("\nDisallow: /\n\nUser-agent: *\nDisallow: /private\n"),
    )
    return of.select("host", text.alias("text"))


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.expr(HOST).alias("host"), F.expr(PATH).alias("path"))


@register(
    "robots_decisions",
    f"""WITH p AS (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages), h AS (SELECT host, min(s) AS low, max(s) AS high, min(path) AS first, count(*) AS n FROM (SELECT host, path, regexp_extract(path, '^/([^/]*)', 1) AS s FROM p) GROUP BY host)
    SELECT page_id, host, path, CASE WHEN starts_with(path, first) THEN true WHEN starts_with(path, '/' || low || '/') THEN false WHEN n % 2 = 1 THEN true WHEN starts_with(path, '/' || high) THEN false ELSE NOT starts_with(path, '/') END AS allowed,
      CAST(greatest(n % 5, 1) AS DOUBLE) AS delay FROM p JOIN h USING (host)""",
)
def robots_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether each page may be fetched, and how long to wait between pages of its host."""
    pages = _addresses(spark, d)
    return robots.decisions(pages, "host", "path", robots.rules(robots_files(pages), "quaybot"))


NODES = f"""WITH RECURSIVE p AS (SELECT page_id, {HOST} || rtrim({PATH}, '/') AS leaf FROM pages), parts AS (SELECT page_id, string_split(leaf, '/') AS w FROM p),
    n AS (SELECT DISTINCT array_to_string(w[1:k], '/') AS node, k FROM (SELECT w, unnest(generate_series(1, len(w))) AS k FROM parts)),
    leaves AS (SELECT array_to_string(w[1:k], '/') AS node, count(DISTINCT array_to_string(w, '/')) AS m FROM (SELECT w, unnest(generate_series(1, len(w))) AS k FROM parts) GROUP BY 1),
    own AS (SELECT n.node, k, CASE WHEN contains(node, 'spam') AND k = 1 THEN 'skip' WHEN k = 1 THEN 'dive' WHEN m >= 3 THEN 'fetch' WHEN regexp_matches(node, '/[0-9]*7$') THEN 'skip' END AS verdict FROM n JOIN leaves USING (node))"""


@register(
    "inherited_verdicts",
    NODES + """, up AS (SELECT node, node AS anc, k, verdict FROM own UNION ALL SELECT up.node, o.node, o.k, o.verdict FROM up JOIN own o ON up.verdict IS NULL AND o.k = up.k - 1 AND starts_with(up.anc, o.node || '/'))
    SELECT node, anc AS decided_by, verdict FROM up WHERE verdict IS NOT NULL""",
)
def inherited_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every node of the address tree with the verdict of its nearest decided ancestor or itself."""
    leaf = F.concat("host", F.regexp_replace("path", "/+$", ""))
    nodes = trees.nodes(_addresses(spark, d).select(leaf.alias("leaf")), "leaf")
    own = F.when((C("depth") == 1) & C("node").contains("spam"), "skip").when(C("depth") == 1, "dive").when(C("n_leaves") >= 3, "fetch").when(C("node").rlike("/[0-9]*7$"), "skip")
    return trees.inherited(nodes.withColumn("verdict", own), "verdict").select("node", "decided_by", "verdict")


@register(
    "branch_reuse",
    NODES.replace("WITH RECURSIVE", "WITH") + """, fresh AS (SELECT DISTINCT leaf FROM p q WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.leaf = q.leaf AND o.page_id % 10 <> 3)),
    touched AS (SELECT DISTINCT array_to_string(w[1:k], '/') AS node FROM (SELECT string_split(leaf, '/') AS w, unnest(generate_series(1, len(string_split(leaf, '/')))) AS k FROM fresh))
    SELECT n.node, k AS depth, n.node IN (SELECT node FROM touched) AS changed FROM n""",
)
def branch_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Which branches hold an address that the crawl before had not (here: that without a tenth of the pages); verdicts of the others are used again."""
    pages = _addresses(spark, d).select("page_id", F.concat("host", F.regexp_replace("path", "/+$", "")).alias("leaf"))
    fresh = pages.select("leaf").distinct().join(pages.filter("page_id % 10 <> 3").select("leaf").distinct(), "leaf", "left_anti")
    touched = trees.nodes(fresh, "leaf").select("node", F.lit(True).alias("t"))
    return trees.nodes(pages, "leaf").join(touched, "node", "left").select("node", "depth", F.coalesce("t", F.lit(False)).alias("changed"))


@register(
    "crawl_budget_by_level",
    NODES + """, c AS (SELECT regexp_extract(node, '^(.*)/[^/]*$', 1) AS parent, node, k FROM n WHERE k > 1), b AS (SELECT node, k, CAST(1000 AS BIGINT) AS budget FROM n WHERE k = 1
      UNION ALL SELECT c.node, c.k, CAST(b.budget // (SELECT count(*) FROM c c2 WHERE c2.parent = c.parent) AS BIGINT) FROM b JOIN c ON c.parent = b.node) SELECT node, k AS depth, budget FROM b""",
)
def crawl_budget_by_level(spark: SparkSession, d: str) -> DataFrame:
    """A budget of 1000 for each host, dealt evenly to the children of a node, level by level."""
    leaf = F.concat("host", F.regexp_replace("path", "/+$", ""))
    return trees.dealt(trees.nodes(_addresses(spark, d).select(leaf.alias("leaf")), "leaf"), 1000)
