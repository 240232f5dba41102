"""Files written and read back: records, manifests, pools, tables, pages with headers, blobs and sheets, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs
from ..operators.ordering import shared_base
from ..sources import files
from ._tables import table
from .catalog import register

C = F.col


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("records_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source AS site, sha256(text) AS digest FROM documents")
def records_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents as one JSON object a line, in key order, read with a stated schema."""
    path = _folder(spark, "records")
    files.write_records(table(spark, d, "documents").select(C("doc_id").cast("string").alias("doc_id"), "lang", C("source").alias("site"), "text"), path, "doc_id")
    return files.read_records(spark, path).select("doc_id", "lang", "site", F.sha2("text", 256).alias("digest"))


@register("records_missing", "SELECT url, count(*) AS n_pages, CAST(0 AS BIGINT) AS n_known FROM pages GROUP BY url")
def records_missing(spark: SparkSession, d: str) -> DataFrame:
    """A file that isn't there is an empty table: no address is known from a run before."""
    before = files.read_records_or_none(spark, _folder(spark, "nothing")).select(C("doc_id").alias("known"))
    return table(spark, d, "pages").join(before, C("url") == C("known"), "left").groupBy("url").agg(F.count("*").alias("n_pages"), F.count("known").alias("n_known"))


@register("queue_round_trip", "SELECT url, page_id AS priority FROM pages")
def queue_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A queue of addresses, written and read."""
    path = _folder(spark, "queue")
    files.write_records(table(spark, d, "pages").select("url", C("page_id").alias("priority")), path, "url")
    return files.read_records(spark, path, "url string, priority long")


@register("manifest_round_trip", "SELECT 'https://h/' || n_nationkey AS url, CAST(200 + n_nationkey % 3 AS INTEGER) AS status, n_name AS etag, CASE WHEN n_nationkey % 5 = 0 THEN 'gone' END AS error FROM nation")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """One object of address to record in a file: as many entries as nations."""
    n = table(spark, d, "nation")
    record = F.struct((200 + C("n_nationkey") % 3).cast("int").alias("status"), C("n_name").alias("etag"), F.when(C("n_nationkey") % 5 == 0, "gone").alias("error"))
    path = _folder(spark, "manifest")
    n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("https://h/"), C("n_nationkey").cast("string")), record)))).alias("value")).coalesce(1).write.text(path)
    return files.read_manifest(spark, path).select("url", "status", "etag", "error")


@register("pool_last_bank_wins", "SELECT 'https://h/' || (n_nationkey % 7) AS url, max(r_name) AS bank FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def pool_last_bank_wins(spark: SparkSession, d: str) -> DataFrame:
    """Bank, address, record, nested; flattened to addresses, of which the last bank by name keeps each."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    url = F.concat(F.lit("https://h/"), (C("n_nationkey") % 7).cast("string"))
    per = n.select("r_name", url.alias("url")).distinct().groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("url", F.struct(F.array("r_name").alias("tables"))))).alias("urls"))
    path = _folder(spark, "pool")
    per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "urls")))).alias("value")).coalesce(1).write.text(path)
    return files.read_pool(spark, path).select("url", "bank")


def _tables(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "nation").join(table(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    cells = F.map_from_arrays(F.array(F.lit("key"), F.lit("name")), F.array(C("n_nationkey").cast("string"), C("n_name")))
    each = r.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", cells))).alias("rows"))
    path = _folder(spark, "tables")
    each.select(C("r_name").alias("id"), F.lower("r_name").alias("topic"), F.lit("geo").alias("category"), F.array(F.lit("name"), F.lit("key"), F.lit("more")).alias("columns"), "rows").write.option("maxRecordsPerFile", 1).json(path)
    return files.read_tables(spark, path)


@register("tables_of_folder", "SELECT r_name AS id, lower(r_name) AS topic, count(*) AS n_rows FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def tables_of_folder(spark: SparkSession, d: str) -> DataFrame:
    """Every table of a folder, a file each."""
    return _tables(spark, d).select("id", "topic", F.size("rows").cast("long").alias("n_rows"))


@register("table_cells_long", "SELECT r_name AS table_id, n_name AS bank, col, pos, CASE col WHEN 'name' THEN n_name WHEN 'key' THEN CAST(n_nationkey AS VARCHAR) END AS value FROM nation JOIN region ON r_regionkey = n_regionkey, (VALUES ('name', 0), ('key', 1), ('more', 2)) AS c(col, pos)")
def table_cells_long(spark: SparkSession, d: str) -> DataFrame:
    """The cells of tables as rows; the order of columns is data."""
    return files.table_cells(_tables(spark, d)).select("table_id", "bank", "col", "pos", "value")


@register("table_by_id", "SELECT r_name AS id, count(*) AS n_rows FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def table_by_id(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).filter("id = 'ASIA'").select("id", F.size("rows").cast("long").alias("n_rows"))


@register("registry_subcategories", "SELECT DISTINCT 'geo' AS category, lower(r_name) AS topic FROM region JOIN nation ON r_regionkey = n_regionkey")
def registry_subcategories(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).select("category", "topic").distinct()


@register(
    "pages_by_precedence",
    "SELECT 'https://h/' || n_nationkey AS url, CASE WHEN n_nationkey % 2 = 0 THEN 'rich' ELSE 'plain' END AS version, n_name AS title FROM nation WHERE n_nationkey % 6 <> 5",
)
def pages_by_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Text files with headers in two folders; the first folder's version of an address counts, pages tagged as irrelevant stay out."""
    n = table(spark, d, "nation")
    page = lambda version, tag: F.concat(F.lit("---\nurl: https://h/"), C("n_nationkey").cast("string"), F.lit('\ntitle: "'), C("n_name"), F.lit('"\nversion: ' + version), tag, F.lit("\n---\nbody of "), C("n_name"))
    tag = F.when(C("n_nationkey") % 6 == 5, "\ncontent_relevance: gereksiz").otherwise("")
    rich, plain = _folder(spark, "rich"), _folder(spark, "plain")
    n.filter("n_nationkey % 2 = 0").select(page("rich", tag).alias("value")).write.option("maxRecordsPerFile", 1).text(rich)
    n.select(page("plain", tag).alias("value")).write.option("maxRecordsPerFile", 1).text(plain)
    return files.read_pages(spark, [rich, plain]).select("url", C("fields")["version"].alias("version"), C("fields")["title"].alias("title"))


@register("page_skip_reasons", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'not required' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 40 THEN 'too short' WHEN quality = 0 THEN 'rejected' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def page_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a page is left out, as a column: rows stay. The judgements are a table of their own."""
    short = F.length(F.regexp_replace("text", "^\\s+|\\s+$", "")) < 40
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(C("toxic") == 1, "not required").when(short, "too short").when(C("quality") == 0, "rejected").alias("reason"))


@register("richest_version", "SELECT page_id % 200 AS path, arg_min(page_id, CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END * 1000000 + page_id) AS chosen FROM pages GROUP BY 1")
def richest_version(spark: SparkSession, d: str) -> DataFrame:
    """Of a page's versions the richest kind there is."""
    return table(spark, d, "pages").groupBy((C("page_id") % 200).alias("path")).agg(F.min_by("page_id", F.struct(C("page_id") % 3, "page_id")).alias("chosen"))


@register("blobs_put_once", "SELECT sha256(html) AS digest, max(strlen(html)) AS n_bytes FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 10 = 0) GROUP BY 1")
def blobs_put_once(spark: SparkSession, d: str) -> DataFrame:
    """Content by its digest: what is held already is not written again."""
    pages = table(spark, d, "pages").select("page_id", C("html").cast("binary").alias("content"))
    held = pages.filter("page_id % 10 = 0").select(F.sha2("content", 256).alias("digest")).distinct()
    return files.put_blobs(held, pages.select("content")).select("digest", C("n_bytes").cast("long").alias("n_bytes"))


@register("blob_by_path", "SELECT page_id, sha256(html) AS digest, strlen(html) AS n_bytes FROM pages")
def blob_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Content looked up by what refers to it."""
    pages = table(spark, d, "pages").select("page_id", C("html").cast("binary").alias("content"))
    blobs = files.put_blobs(pages.select(F.sha2("content", 256).alias("digest")).limit(0), pages.select("content"))
    asked = pages.select("page_id", F.sha2("content", 256).alias("digest"))
    return asked.join(blobs, "digest").select("page_id", "digest", C("n_bytes").cast("long").alias("n_bytes"))


@register("memo_by_content", "SELECT doc_id, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE source < 'm') THEN 'known' ELSE 'new' END AS outcome FROM documents WHERE text IS NOT NULL")
def memo_by_content(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes kept by content, failures too: what has one (here: from the first sources) isn't read again, whatever its name."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    memo = docs.filter("source < 'm'").select("digest", F.lit("known").alias("outcome")).distinct()
    return docs.join(memo, "digest", "left").select("doc_id", F.coalesce("outcome", F.lit("new")).alias("outcome"))


@register("garbage_collected", "SELECT count(*) AS files, coalesce(sum(strlen(html)), 0) AS bytes FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0")
def garbage_collected(spark: SparkSession, d: str) -> DataFrame:
    """Blobs that nothing refers to, but for kinds that are always kept."""
    blobs = table(spark, d, "pages").select(C("page_id").cast("string").alias("digest"), F.concat(C("page_id").cast("string"), F.when(C("page_id") % 5 == 0, ".pdf").otherwise(".html")).alias("path"), F.octet_length("html").cast("long").alias("n_bytes"), "page_id")
    return files.garbage(blobs.drop("page_id"), blobs.filter("page_id % 3 = 0").select("digest"), ".pdf")


@register("sheet_lines", "SELECT n_nationkey || ';' || n_name || ';' || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS line FROM nation UNION ALL SELECT chr(65279) || 'key;name;region'")
def sheet_lines(spark: SparkSession, d: str) -> DataFrame:
    """A sheet as its lines: semicolons, blanks for nulls, a byte order mark before the header."""
    path = _folder(spark, "sheet")
    n = table(spark, d, "nation").select(C("n_nationkey").alias("key"), C("n_name").alias("name"), F.when(C("n_nationkey") % 4 != 0, C("n_regionkey")).alias("region"))
    files.write_sheet(n.coalesce(1), path)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(F.decode("content", "UTF-8").alias("sheet"))
    return whole.select(F.explode(F.filter(F.split("sheet", "\r\n"), lambda s: s != "")).alias("line"))


@register("sitemap_walk", "SELECT 'https://h/index' AS url, 0 AS depth UNION ALL SELECT 'https://h/map-' || r_name, 1 FROM region UNION ALL SELECT 'https://h/' || r_name || '/' || n_name, 2 FROM nation JOIN region ON r_regionkey = n_regionkey")
def sitemap_walk(spark: SparkSession, d: str) -> DataFrame:
    """An index of site maps, walked level by level over the stored documents; each address once."""
    r = table(spark, d, "region")
    n = table(spark, d, "nation").join(r, C("r_regionkey") == C("n_regionkey"))
    loc = lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>"))
    index = r.agg(F.concat_ws("", F.collect_list(loc(F.concat(F.lit("https://h/map-"), "r_name")))).alias("xml")).select(F.lit("https://h/index").alias("url"), "xml")
    maps = n.groupBy("r_name").agg(F.concat_ws("", F.collect_list(loc(F.concat(F.lit("https://h/"), "r_name", F.lit("/"), "n_name")))).alias("xml")).select(F.concat(F.lit("https://h/map-"), "r_name").alias("url"), "xml")
    links = index.unionByName(maps).select(C("url").alias("src"), F.explode(files.sitemap_locations(C("xml"))).alias("dst")).distinct()
    return graphs.reach(links, spark.createDataFrame([("https://h/index",)], "node string")).select(C("node").alias("url"), "depth")
