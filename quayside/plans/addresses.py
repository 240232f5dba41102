"""Queries over addresses and pages: canonical forms, scope, trees, links, headings and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import ordering
from ._tables import table
from .catalog import register

TRACK = ", ".join(f"'{t}'" for t in U.TRACKING)
HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), ':(80|443)$', '')"
RAW_PATH = "regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
PATH = f"(CASE WHEN {RAW_PATH} = '' THEN '/' ELSE {RAW_PATH} END)"
KEPT = f"list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT (starts_with(lower(string_split(p, '=')[1]), 'utm_') OR lower(string_split(p, '=')[1]) IN ({TRACK}))))"
CANON = f"('https://' || {HOST} || {PATH} || CASE WHEN len({KEPT}) > 0 THEN '?' || array_to_string({KEPT}, '&') ELSE '' END)"
SEGS = f"list_filter(string_split(lower({PATH}), '/'), lambda s: s <> '')"


@register("url_canonical", f"SELECT page_id, {CANON} AS canonical FROM pages")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


@register("url_doc_id", f"SELECT page_id, substr(sha256({CANON}), 1, 16) AS doc_key FROM pages")
def url_doc_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.document_id(U.canonical(F.col("url"))).alias("doc_key"))


@register(
    "url_tracking",
    f"""WITH p AS (SELECT page_id, unnest(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')) AS kv FROM pages)
    SELECT string_split(kv, '=')[1] AS param, starts_with(lower(string_split(kv, '=')[1]), 'utm_') OR lower(string_split(kv, '=')[1]) IN ({TRACK}) AS tracking, count(*) AS n
    FROM p WHERE kv <> '' GROUP BY 1, 2""",
)
def url_tracking(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "pages").select(F.explode(F.split(U.query(F.col("url")), "&")).alias("kv")).filter("kv != ''").select(F.split("kv", "=")[0].alias("param"))
    return each.select("param", U.is_tracking(F.col("param")).alias("tracking")).groupBy("param", "tracking").agg(F.count("*").alias("n"))


@register("url_same_site", f"SELECT page_id, {HOST} = 'example.com' OR ends_with({HOST}, '.example.com') AS same_site FROM pages")
def url_same_site(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.same_site(F.col("url"), "example.com").alias("same_site"))


@register(
    "url_wanted_page",
    f"""SELECT page_id, {PATH} AS path FROM pages WHERE ({HOST} = 'example.com' OR ends_with({HOST}, '.example.com')) AND NOT regexp_matches(lower({PATH}), '\\.(pdf|{"|".join(U.ASSET_SUFFIXES)})$')
    AND (length(coalesce({SEGS}[1], '')) <> 2 OR coalesce({SEGS}[1], '') IN ('en', 'de'))""",
)
def url_wanted_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter(U.wanted_page(F.col("url"), "example.com", ("en", "de"))).select("page_id", U.path(F.col("url")).alias("path"))


@register("url_segments_kind", f"SELECT page_id, coalesce({SEGS}[1], '') AS section, coalesce({SEGS}[2], '') AS category, CASE WHEN ends_with({PATH}, '.html') THEN 'document' WHEN regexp_matches(url, '[?]page=') THEN 'listing' ELSE 'other' END AS kind FROM pages")
def url_segments_kind(spark: SparkSession, d: str) -> DataFrame:
    s = U.segments(F.col("url"))
    kind = F.when(U.path(F.col("url")).endswith(".html"), "document").when(F.col("url").rlike("[?]page="), "listing").otherwise("other")
    return table(spark, d, "pages").select("page_id", F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("section"), F.coalesce(F.get(s, F.lit(1)), F.lit("")).alias("category"), kind.alias("kind"))


@register("url_title_from_slug", f"SELECT page_id, upper(substr(w, 1, 1)) || substr(w, 2) AS title FROM (SELECT page_id, trim(regexp_replace(regexp_replace(coalesce({SEGS}[-1], ''), '\\.[a-z0-9]+$', ''), '[-_]+', ' ', 'g')) AS w FROM pages)")
def url_title_from_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.title_from_slug(F.col("url")).alias("title"))


ANCESTORS = f"list_transform(generate_series(0, len({SEGS})), lambda n: array_to_string(list_concat([{HOST}], list_slice({SEGS}, 1, n)), '/'))"


@register("url_prefix_tree_counts", f"WITH n AS (SELECT page_id, unnest({ANCESTORS}) AS node FROM pages) SELECT node, count(*) AS n_pages, min(page_id) AS sample FROM n GROUP BY node")
def url_prefix_tree_counts(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "pages").select("page_id", F.explode(U.ancestors(F.col("url"))).alias("node"))
    return each.groupBy("node").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("sample"))


@register(
    "url_leaf_fingerprint",
    f"""WITH n AS (SELECT unnest({ANCESTORS}) AS node, {CANON} AS leaf FROM pages), u AS (SELECT DISTINCT node, leaf FROM n)
    SELECT node, CAST(sum(CAST(CAST('0x' || substr(md5(leaf), 1, 12) AS BIGINT) AS HUGEINT)) AS DECIMAL(38,0)) % 1000000007 AS low, CAST(sum(CAST(CAST('0x' || substr(md5(leaf), 13, 12) AS BIGINT) AS HUGEINT)) AS DECIMAL(38,0)) % 998244353 AS high, count(*) AS n_leaves FROM u GROUP BY node""",
)
def url_leaf_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A digest of the set of addresses below a node: sums of parts of each one's hash, so no order and no list is needed."""
    each = table(spark, d, "pages").select(F.explode(U.ancestors(F.col("url"))).alias("node"), U.canonical(F.col("url")).alias("leaf")).distinct()
    part = lambda at: F.sum(F.conv(F.substring(F.md5(F.col("leaf").cast("binary")), at, 12), 16, 10).cast("decimal(38,0)"))
    return each.groupBy("node").agg((part(1) % F.lit(1000000007).cast("decimal(38,0)")).cast("bigint").alias("low"), (part(13) % F.lit(998244353).cast("decimal(38,0)")).cast("bigint").alias("high"), F.count("*").alias("n_leaves"))


@register("url_tree_leaves", f"WITH n AS (SELECT DISTINCT unnest({ANCESTORS}) AS node FROM pages) SELECT node FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE regexp_replace(b.node, '/[^/]*$', '') = a.node AND b.node <> a.node)")
def url_tree_leaves(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "pages").select(F.explode(U.ancestors(F.col("url"))).alias("node")).distinct()
    parents = nodes.select(F.col("node").alias("child"), F.regexp_replace("node", "/[^/]*$", "").alias("up")).filter("up != child").select("up").distinct()
    return nodes.join(parents, F.col("node") == F.col("up"), "left_anti")


LINKS = """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1)) AS href FROM pages)
    SELECT page_id, href, count(*) AS n FROM a WHERE NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)') GROUP BY page_id, href"""


@register("html_links", LINKS)
def html_links(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"[^>]*>'), F.lit(1))).alias("href"))
    return each.filter(~F.col("href").rlike("^(#|javascript:|mailto:|tel:)")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@register("page_link_graph_indegree", f"WITH l AS ({LINKS}) SELECT href, count(*) AS n_pages, sum(n) AS n_links FROM l GROUP BY href")
def page_link_graph_indegree(spark: SparkSession, d: str) -> DataFrame:
    return html_links(spark, d).groupBy("href").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_links"))


@register(
    "linked_from_map",
    """WITH a AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1)) AS href FROM pages)
    SELECT href, page_id AS linked_from, min(page_id) OVER (PARTITION BY href) = page_id AS first FROM a""",
)
def linked_from_map(spark: SparkSession, d: str) -> DataFrame:
    """Links turned round: a row for each page that links to an address, the first one marked. An address may be linked from any share of all pages."""
    each = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"[^>]*>'), F.lit(1))).alias("href")).distinct()
    first = each.groupBy("href").agg(F.min("page_id").alias("first_page"))
    return each.join(first, "href").select("href", F.col("page_id").alias("linked_from"), (F.col("page_id") == F.col("first_page")).alias("first"))


@register(
    "orphan_pages_anti",
    f"""WITH l AS ({LINKS}) SELECT page_id, {PATH} AS path FROM pages p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.href = {PATH.replace("url", "p.url")})""",
)
def orphan_pages_anti(spark: SparkSession, d: str) -> DataFrame:
    targets = html_links(spark, d).select("href").distinct()
    return table(spark, d, "pages").select("page_id", U.path(F.col("url")).alias("path")).join(targets, F.col("path") == F.col("href"), "left_anti")


@register(
    "html_headings",
    """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1)) AS level, unnest(regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2)) AS title FROM pages)
    SELECT page_id, CAST(level AS INT) AS level, title, count(*) AS n FROM h GROUP BY 1, 2, 3""",
)
def html_headings(spark: SparkSession, d: str) -> DataFrame:
    p = "(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>"
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(p), F.lit(1)).alias("level"), F.regexp_extract_all("html", F.lit(p), F.lit(2)).alias("title"))
    each = table(spark, d, "pages").select("page_id", F.explode(both).alias("h"))
    return each.select("page_id", F.col("h.level").cast("int").alias("level"), F.col("h.title").alias("title")).groupBy("page_id", "level", "title").agg(F.count("*").alias("n"))


HTML_TEXT = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|header)\\b.*?</(script|style|nav|footer|header)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML_TEXT = f"replace({HTML_TEXT}, '{_e}', '{_c}')"
HTML_TEXT = f"trim(regexp_replace({HTML_TEXT}, '[\\t\\n\\v\\f\\r ]+', ' ', 'g'))"


@register("html_text", f"SELECT page_id, length({HTML_TEXT}) AS n_chars, substr(sha256({HTML_TEXT}), 1, 16) AS text_hash FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    own = X.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(own).cast("long").alias("n_chars"), F.substring(F.sha2(own, 256), 1, 16).alias("text_hash"))


@register(
    "sections_from_html",
    """WITH s AS (SELECT page_id, string_split_regex(html, '(?i)<h[1-6][^>]*>') AS parts FROM pages),
    e AS (SELECT page_id, unnest(list_slice(parts, 2, len(parts))) AS part, generate_subscripts(list_slice(parts, 2, len(parts)), 1) AS pos FROM s)
    SELECT page_id, pos, regexp_extract(part, '(?s)^(.*?)</h[1-6]>', 1) AS title, length(part) AS n_chars FROM e""",
)
def sections_from_html(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("html", "(?i)<h[1-6][^>]*>")
    each = table(spark, d, "pages").select("page_id", F.posexplode(F.slice(parts, 2, 1_000_000)).alias("pos", "part"))
    return each.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.regexp_extract("part", "(?s)^(.*?)</h[1-6]>", 1).alias("title"), F.length("part").cast("long").alias("n_chars"))


@register("page_signature", f"SELECT page_id, sha256({HTML_TEXT} || '|images|' || array_to_string(list_sort(regexp_extract_all(html, '<img[^>]*src=\"([^\"]*)\"', 1)), chr(10))) AS signature FROM pages")
def page_signature(spark: SparkSession, d: str) -> DataFrame:
    images = F.array_join(F.array_sort(F.regexp_extract_all("html", F.lit('<img[^>]*src="([^"]*)"'), F.lit(1))), "\n")
    return table(spark, d, "pages").select("page_id", F.sha2(F.concat(X.html_text(F.col("html")), F.lit("|images|"), images), 256).alias("signature"))


@register("url_host_verify_key", f"SELECT page_id, regexp_replace({HOST}, '^www\\.', '') || {PATH} AS verify_key, {HOST} AS host FROM pages")
def url_host_verify_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.without_www(F.col("url")).alias("verify_key"), U.host(F.col("url")).alias("host"))


@register("url_parent", f"WITH s AS (SELECT page_id, {HOST} AS host, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS segs FROM pages) SELECT page_id, 'https://' || host || '/' || array_to_string(list_slice(segs, 1, len(segs) - 1), '/') AS parent FROM s")
def url_parent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.parent(F.col("url")).alias("parent"))


@register(
    "coverage_classes",
    f"""WITH u AS (SELECT page_id, {CANON} AS address, {PATH} AS path FROM pages)
    SELECT CASE WHEN address IN (SELECT address FROM u WHERE page_id % 5 = 0) THEN 'saved' WHEN address IN (SELECT address FROM u WHERE page_id % 7 = 0) THEN 'failed' WHEN path = '/de' OR starts_with(path, '/de/') OR path = '/fr' OR starts_with(path, '/fr/') THEN 'skipped' ELSE 'unaccounted' END AS class, count(*) AS n FROM u GROUP BY 1""",
)
def coverage_classes(spark: SparkSession, d: str) -> DataFrame:
    """Universe of addresses, first class that fits: saved, failed, under a skipped prefix, unaccounted. The prefixes are a fixed
    short list, so the prefix join is a broadcast one."""
    universe = table(spark, d, "pages").select("page_id", U.canonical(F.col("url")).alias("address"), U.path(F.col("url")).alias("path"))
    saved = universe.filter("page_id % 5 = 0").select("address").distinct().withColumn("saved", F.lit(True))
    failed = universe.filter("page_id % 7 = 0").select("address").distinct().withColumn("failed", F.lit(True))
    skip = spark.createDataFrame([("/de",), ("/fr",)], "prefix string")
    under = (F.col("path") == F.col("prefix")) | F.col("path").startswith(F.concat("prefix", F.lit("/")))
    all_ = universe.join(saved, "address", "left").join(failed, "address", "left").join(F.broadcast(skip), under, "left")
    kind = F.when(F.col("saved"), "saved").when(F.col("failed"), "failed").when(F.col("prefix").isNotNull(), "skipped").otherwise("unaccounted")
    return all_.select(kind.alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@register(
    "round_robin_pages",
    f"SELECT page_id, host, row_number() OVER (ORDER BY turn, host) AS pos FROM (SELECT page_id, {HOST} AS host, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) AS turn FROM pages)",
)
def round_robin_pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages in the order in which every site takes its turn."""
    each = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    turns = ordering.placed_within(each, ["host"], [F.col("page_id")], "turn")
    return ordering.placed(turns, [F.col("turn"), F.col("host")]).select("page_id", "host", "pos")
