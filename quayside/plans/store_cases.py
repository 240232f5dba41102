"""Scans, upserts and marks of a store of documents, tables and reports: one query for each operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import graphs, ordering
from ._tables import table
from .addresses import HOST, PATH
from .catalog import register, rule

C = F.col


@register("manifest_of_site", f"SELECT page_id, url FROM pages WHERE {HOST} = 'example.net' OR ends_with({HOST}, '.example.net')")
def manifest_of_site(spark: SparkSession, d: str) -> DataFrame:
    """A site's entries of a manifest."""
    return table(spark, d, "pages").filter(U.same_site(C("url"), "example.net")).select("page_id", "url")


@register("folder_signature", "SELECT count(*) AS n, sum(strlen(html)) AS bytes, max(page_id) AS newest FROM pages")
def folder_signature(spark: SparkSession, d: str) -> DataFrame:
    """What tells whether files have changed: how many, how large, how new."""
    return table(spark, d, "pages").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"), F.max("page_id").alias("newest"))


@register("all_sources", "SELECT DISTINCT source FROM documents")
def all_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct()


@register("payload_scan", "SELECT vec_id, label FROM embeddings")
def payload_scan(spark: SparkSession, d: str) -> DataFrame:
    """A whole collection without its vectors: the scan reads two columns."""
    return table(spark, d, "embeddings").select("vec_id", "label")


@register("held_hashes", "SELECT doc_id AS point_id, substr(sha256(text), 1, 16) AS text_hash FROM documents")
def held_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Ids and hashes of all that an index holds."""
    return table(spark, d, "documents").select(C("doc_id").alias("point_id"), F.substring(F.sha2("text", 256), 1, 16).alias("text_hash"))


@register("new_files_of_pages", """WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1)) AS href FROM pages) SELECT href FROM l WHERE href NOT IN (SELECT regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) FROM pages)""")
def new_files_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Targets of links that have not been fetched yet: no page has their path."""
    links = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"[^>]*>'), F.lit(1))).alias("href")).distinct()
    return links.join(table(spark, d, "pages").select(F.regexp_extract("url", "^https?://[^/]+([^?#]*)", 1).alias("href")), "href", "left_anti")


@register("links_with_anchors", """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)<', 1)) AS href, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)<', 2)) AS label FROM pages) SELECT DISTINCT page_id, href, trim(label) AS label FROM a""")
def links_with_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Links with what they say, each once."""
    p = F.lit('<a [^>]*href="([^"]*)"[^>]*>([^<]*)<')
    pairs = F.arrays_zip(F.regexp_extract_all("html", p, F.lit(1)).alias("href"), F.regexp_extract_all("html", p, F.lit(2)).alias("label"))
    return table(spark, d, "pages").select("page_id", F.explode(pairs).alias("l")).select("page_id", "l.href", F.trim("l.label").alias("label")).distinct()


@register("own_page_links", f"""WITH a AS (SELECT page_id, {HOST} AS host, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1)) AS href FROM pages) SELECT DISTINCT page_id, 'https://' || host || href AS target FROM a WHERE starts_with(href, '/') AND NOT regexp_matches(lower(href), '\\.(pdf|png|jpg|css|js)$')""")
def own_page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to pages of the same site."""
    each = table(spark, d, "pages").select("page_id", U.host(C("url")).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"[^>]*>'), F.lit(1))).alias("href"))
    return each.filter(C("href").startswith("/") & ~F.lower("href").rlike("\\.(pdf|png|jpg|css|js)$")).select("page_id", F.concat(F.lit("https://"), "host", "href").alias("target")).distinct()


@register("url_universe", f"WITH RECURSIVE e AS (SELECT p_partkey % n AS src, (p_partkey * 5 + 3) % n AS dst FROM part, (SELECT count(*) AS n FROM part)), r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT dst FROM r JOIN e ON src = node) SELECT node, min(source) AS source FROM (SELECT node, 'crawl' AS source FROM r UNION ALL SELECT p_partkey, 'sitemap' FROM part WHERE p_size <= 3) GROUP BY node")
def url_universe(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl reaches and what a site map lists, as one set."""
    part = table(spark, d, "part")
    n = part.count()
    edges = part.select((C("p_partkey") % n).alias("src"), ((C("p_partkey") * 5 + 3) % n).alias("dst"))
    crawl = graphs.reach(edges, spark.createDataFrame([(1,)], "node long")).select("node", F.lit("crawl").alias("source"))
    listed = part.filter("p_size <= 3").select(C("p_partkey").alias("node"), F.lit("sitemap").alias("source"))
    return crawl.unionByName(listed).groupBy("node").agg(F.min("source").alias("source"))


@register("pages_with_text_layer", "SELECT conv_id AS file, turn AS page, length(trim(text)) >= 100 AS has_text FROM conversations")
def pages_with_text_layer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(C("conv_id").alias("file"), C("turn").alias("page"), (F.length(F.trim("text")) >= 100).alias("has_text"))


rule("bank_without_calculator", "A bank that offers none of the capabilities: every question is refused.", "can string", [(c,) for c in ("finance", "account", "card", "rates")], {"answer": lambda: F.concat(F.lit("no "), C("can"), F.lit(" here"))}, {"answer": "'no ' || can || ' here'"})


@register("candidate_pages", f"SELECT host, page_id FROM (SELECT {HOST} AS host, page_id, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) AS rn FROM pages WHERE regexp_matches({PATH}, '5|hesap')) WHERE rn <= 3")
def candidate_pages(spark: SparkSession, d: str) -> DataFrame:
    """A site's first three pages whose address names a tool: the limit is the feature."""
    own = table(spark, d, "pages").filter(U.path(C("url")).rlike("5|hesap")).select(U.host(C("url")).alias("host"), "page_id")
    return ordering.placed_within(own, ["host"], [C("page_id")]).filter("pos <= 3").select("host", "page_id")


COMPONENTS = [('{"category":"finance","components":[{"id":"a","kind":"slider"},{"id":"b","kind":"table"}]}',), ('{"category":"cards","components":[]}',)]
rule("components_of_category", "Components as a stored file lists them.", "body string", COMPONENTS, {"category": lambda: F.get_json_object("body", "$.category"), "ids": lambda: F.array_join(F.from_json(F.get_json_object("body", "$.components"), "array<struct<id:string,kind:string>>")["id"], "|")}, {"category": "json_extract_string(body, '$.category')", "ids": "array_to_string(list_transform(from_json(json_extract(body, '$.components'), '[{\"id\":\"VARCHAR\",\"kind\":\"VARCHAR\"}]'), lambda c: c.id), '|')"})

NEW = "SELECT p_partkey AS id, p_name AS topic, CASE WHEN p_size % 2 = 0 THEN '/en/' || p_partkey END AS link FROM part WHERE p_size > 25"


@register("directory_upsert", f"SELECT coalesce(n.id, o.p_partkey) AS id, coalesce(n.topic, o.p_type) AS topic, coalesce(n.link, '/old/' || o.p_partkey) AS link FROM ({NEW}) n FULL JOIN (SELECT * FROM part WHERE p_size < 40) o ON n.id = o.p_partkey")
def directory_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A directory's rows renewed; a link that isn't given keeps the old one."""
    part = table(spark, d, "part")
    new = part.filter("p_size > 25").select(C("p_partkey").alias("id"), C("p_name").alias("topic"), F.when(C("p_size") % 2 == 0, F.concat(F.lit("/en/"), C("p_partkey").cast("string"))).alias("link"))
    old = part.filter("p_size < 40").select(C("p_partkey").alias("id"), C("p_type").alias("was"), F.concat(F.lit("/old/"), C("p_partkey").cast("string")).alias("old_link"))
    return new.join(old, "id", "full_outer").select("id", F.coalesce("topic", "was").alias("topic"), F.coalesce("link", "old_link").alias("link"))


@register("directory_row_dropped", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def directory_row_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the directory whose table is gone (here: parts that no line has) go with it."""
    live = table(spark, d, "lineitem").select(C("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name").join(live, "p_partkey", "left_semi")


@register("table_overwritten", "SELECT p_partkey, coalesce(n.content, p_name) AS content, p_size AS created FROM part LEFT JOIN (SELECT l_partkey, CAST(max(l_quantity) AS VARCHAR) AS content FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) n ON l_partkey = p_partkey")
def table_overwritten(spark: SparkSession, d: str) -> DataFrame:
    """New content (here: from returned lines) takes the place of the old, the time of creation is kept."""
    old = table(spark, d, "part").select("p_partkey", C("p_name").alias("content"), C("p_size").alias("created"))
    new = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(C("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("string").alias("now"))
    return old.join(new, "p_partkey", "left").select("p_partkey", F.coalesce("now", "content").alias("content"), "created")


@register("tables_deleted", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 6)")
def tables_deleted(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "lineitem").filter("l_returnflag = 'A' AND l_linenumber = 6").select(C("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(gone, "p_partkey", "left_anti")


@register("verdicts_recorded", "SELECT l_partkey AS url, bool_or(l_returnflag = 'R') AS own_verdict, max(l_tax) AS latest, count(DISTINCT l_suppkey) AS n_tables FROM lineitem GROUP BY 1")
def verdicts_recorded(spark: SparkSession, d: str) -> DataFrame:
    """A page's own verdict once given stays; its tables are a set."""
    return table(spark, d, "lineitem").groupBy(C("l_partkey").alias("url")).agg(F.bool_or(C("l_returnflag") == "R").alias("own_verdict"), F.max("l_tax").alias("latest"), F.count_distinct("l_suppkey").alias("n_tables"))


@register("citations_recorded", "SELECT l_partkey AS url, array_to_string(list_sort(list_distinct(list(CAST(l_linenumber AS INTEGER)))), ',') AS tables FROM lineitem GROUP BY 1")
def citations_recorded(spark: SparkSession, d: str) -> DataFrame:
    """A citation adds to the set of a page's tables, of which there are seven at most here, and sets no verdict."""
    return table(spark, d, "lineitem").groupBy(C("l_partkey").alias("url")).agg(F.array_join(F.array_sort(F.collect_set(C("l_linenumber").cast("int"))).cast("array<string>"), ",").alias("tables"))


@register("saved_views", "SELECT user_id, event_type AS slug, max(event_id) AS version, count(*) AS n_saves FROM events GROUP BY 1, 2")
def saved_views(spark: SparkSession, d: str) -> DataFrame:
    """A view of a user and slug is its last save."""
    return table(spark, d, "events").groupBy("user_id", C("event_type").alias("slug")).agg(F.max("event_id").alias("version"), F.count("*").alias("n_saves"))


@register("cited_column", "SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS has_sources FROM lineitem GROUP BY 1")
def cited_column(spark: SparkSession, d: str) -> DataFrame:
    """A document shows a column of sources if any of its rows has one."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(C("l_returnflag") == "R").alias("has_sources"))


REPORT = [("# Title\nProse here.\n| a | b |\n| - | - |\n| 1 | 2 |\nMore prose.",), ("only prose",), ("| a |\n| - |",)]
rule("report_blocks", "A report's lines as prose and rows of tables.", "body string", REPORT, {"kinds": lambda: F.array_join(F.transform(F.split("body", "\n"), lambda s: F.when(s.rlike("^\\|[\\s|-]*\\|$") & s.contains("-"), "rule").when(s.startswith("|"), "row").otherwise("prose")), "|")}, {"kinds": "array_to_string(list_transform(string_split(body, chr(10)), lambda s: CASE WHEN regexp_matches(s, '^\\|[\\s|-]*\\|$') AND contains(s, '-') THEN 'rule' WHEN starts_with(s, '|') THEN 'row' ELSE 'prose' END), '|')"})


@register("missing_chunks", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the index lacks: only these are embedded."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(C("vec_id").alias("doc_id")), "doc_id", "left_anti")


@register("stamp_audit", "SELECT count(*) FILTER (d IS NULL) AS missing, count(*) FILTER (t IS NULL) AS extra, count(*) FILTER (d IS NOT NULL AND t IS NOT NULL) AS stamped FROM (SELECT p_partkey AS t FROM part WHERE p_size > 10) a FULL JOIN (SELECT p_partkey AS d FROM part WHERE p_size < 45) b ON t = d")
def stamp_audit(spark: SparkSession, d: str) -> DataFrame:
    """Directory rows that get an address, tables without a row, rows without a table."""
    part = table(spark, d, "part")
    a, b = part.filter("p_size > 10").select(C("p_partkey").alias("k"), F.lit(1).alias("t")), part.filter("p_size < 45").select(C("p_partkey").alias("k"), F.lit(1).alias("d"))
    j = a.join(b, "k", "full_outer")
    return j.agg(F.count_if(C("d").isNull()).alias("missing"), F.count_if(C("t").isNull()).alias("extra"), F.count_if(C("d").isNotNull() & C("t").isNotNull()).alias("stamped"))


@register("index_audit_by_bank", "SELECT source, count(*) FILTER (v.vec_id IS NULL) AS missing, count(*) - count(DISTINCT md5(text)) AS collisions FROM documents LEFT JOIN embeddings v ON v.vec_id = doc_id GROUP BY source")
def index_audit_by_bank(spark: SparkSession, d: str) -> DataFrame:
    """Per bank: pages that the index lacks, and keys that collide."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.md5(C("text").cast("binary")).alias("k"))
    found = docs.join(table(spark, d, "embeddings").select(C("vec_id").alias("doc_id"), F.lit(1).alias("hit")), "doc_id", "left")
    return found.groupBy("source").agg(F.count_if(C("hit").isNull()).alias("missing"), (F.count("*") - F.count_distinct("k")).alias("collisions"))


@register("removal_propagated", "SELECT 'catalog' AS place, count(*) AS n FROM part WHERE p_size = 50 UNION ALL SELECT 'ledger', count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 50 UNION ALL SELECT 'again', count(DISTINCT l_orderkey) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 50")
def removal_propagated(spark: SparkSession, d: str) -> DataFrame:
    """What has gone is marked in every place that knows it, and what rests on it is looked at again."""
    gone = table(spark, d, "part").filter("p_size = 50").select("p_partkey")
    ledger = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(gone, C("l_partkey") == C("p_partkey"))
    return gone.agg(F.lit("catalog").alias("place"), F.count("*").alias("n")).unionByName(ledger.agg(F.lit("ledger").alias("place"), F.count("*").alias("n"))).unionByName(ledger.agg(F.lit("again").alias("place"), F.count_distinct("l_orderkey").alias("n")))


@register("site_counters", "SELECT source, count(*) FILTER (doc_id % 3 = 0) AS new, count(*) FILTER (doc_id % 3 = 1) AS changed, count(*) FILTER (doc_id % 3 = 2) AS unchanged FROM documents GROUP BY source")
def site_counters(spark: SparkSession, d: str) -> DataFrame:
    """New, changed and unchanged documents of a site; the unchanged keep what they have."""
    now = table(spark, d, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    before = now.filter("doc_id % 3 != 0").select("doc_id", F.when(C("doc_id") % 3 == 1, "other").otherwise(C("h")).alias("was"))
    kind = F.when(C("was").isNull(), "new").when(C("was") != C("h"), "changed").otherwise("unchanged")
    return now.join(before, "doc_id", "left").select("source", kind.alias("kind")).groupBy("source").pivot("kind", ["new", "changed", "unchanged"]).count().na.fill(0)


@register("resumed_queue", "SELECT doc_id, CASE WHEN length(text) < 200 THEN 'deferred' ELSE 'done' END AS outcome FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def resumed_queue(spark: SparkSession, d: str) -> DataFrame:
    """What a queue still holds after a stop (here: in the middle of the languages): contents that are memoised aren't done again; passing failures (short texts) are put off, not kept."""
    queue = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))
    memo = queue.filter("lang = 'en'").select("digest").distinct()
    return queue.join(memo, "digest", "left_anti").select("doc_id", F.when(C("n") < 200, "deferred").otherwise("done").alias("outcome"))


@register("reports_fanned_out", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 16")
def reports_fanned_out(spark: SparkSession, d: str) -> DataFrame:
    """A user's queue holds the last sixteen; the oldest drop out: the limit is the feature."""
    return ordering.placed_within(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], [C("event_id").desc()]).filter("pos <= 16").select("user_id", "event_id")


@register("index_queue", "SELECT DISTINCT l_partkey AS table_id FROM lineitem WHERE l_returnflag = 'N'")
def index_queue(spark: SparkSession, d: str) -> DataFrame:
    """A queue to which a table may be added twice and in which it stands once."""
    return table(spark, d, "lineitem").filter("l_returnflag = 'N'").select(C("l_partkey").alias("table_id")).distinct()


@register("branch_leaves_changed", "SELECT source, bool_or(doc_id % 97 = 0) AS touched FROM documents GROUP BY source")
def branch_leaves_changed(spark: SparkSession, d: str) -> DataFrame:
    """Whether any of a branch's leaves is among the added ones."""
    docs = table(spark, d, "documents").select("source", "doc_id")
    added = docs.filter("doc_id % 97 = 0").select("doc_id", F.lit(True).alias("added"))
    return docs.join(added, "doc_id", "left").groupBy("source").agg(F.coalesce(F.bool_or("added"), F.lit(False)).alias("touched"))


@register("validity_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 AS INT) < DATE '1996-06-15' THEN 'expired' WHEN CAST(o_orderdate AS DATE) > DATE '1996-06-15' THEN 'upcoming' ELSE 'valid' END AS status FROM orders")
def validity_status(spark: SparkSession, d: str) -> DataFrame:
    """Computed from the dates for a given day whenever it is asked for, never stored; an offer without an end is unknown."""
    day, today = F.to_date("o_orderdate"), F.lit("1996-06-15").cast("date")
    end = F.when(C("o_orderstatus") != "P", F.date_add(day, (C("o_custkey") % 400).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", F.when(end.isNull(), "unknown").when(end < today, "expired").when(day > today, "upcoming").otherwise("valid").alias("status"))


@register("session_transcript", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) FILTER (role = 'assistant') AS n_answers FROM conversations GROUP BY conv_id")
def session_transcript(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's texts in order of turn; a conversation has few turns."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return table(spark, d, "conversations").groupBy("conv_id").agg(ordered.alias("text"), F.count_if(C("role") == "assistant").alias("n_answers"))


@register("site_spreads", "SELECT user_id % 10 AS bank, event_type AS instrument, (max(value) - min(value)) / ((max(value) + min(value)) / 2) * 100 > 25 AS broken FROM events GROUP BY 1, 2 HAVING max(value) + min(value) > 0")
def site_spreads(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy((C("user_id") % 10).alias("bank"), C("event_type").alias("instrument")).agg(F.max("value").alias("b"), F.min("value").alias("a")).filter("a + b > 0")
    return g.select("bank", "instrument", ((C("b") - C("a")) / ((C("b") + C("a")) / 2) * 100 > 25).alias("broken"))


@register("rate_list_unique", "SELECT event_type AS canonical, user_id % 4 AS unit, count(*) AS n, count(*) > 1 AS repeated FROM (SELECT DISTINCT event_type, user_id, user_id % 8 AS quoted FROM events) GROUP BY 1, 2")
def rate_list_unique(spark: SparkSession, d: str) -> DataFrame:
    """Identities of rates that stand more than once."""
    e = table(spark, d, "events").select(C("event_type").alias("canonical"), (C("user_id") % 4).alias("unit"), "user_id").distinct()
    return e.groupBy("canonical", "unit").agg(F.count("*").alias("n")).withColumn("repeated", C("n") > 1)
