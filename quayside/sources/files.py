"""Readers and writers: line-delimited records with a pinned schema, key-record manifests, text with a header, partitioned
addresses, content-addressed blobs, CSV for spreadsheets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import let

DOCUMENT = (
    "doc_id string, url string, source_urls array<string>, site string, source_type string, fetched_at string, content_hash string, text_hash string, doc_kind string, title string, text string, lang string,"
    " sections array<struct<heading_path:string,anchor:string,level:int,text:string,order:int>>, campaign_start string, campaign_end string, duplicate_of string, attachments array<string>"
)
MANIFEST_ENTRY = "struct<fetched_at:string,status:int,content_type:string,content_hash:string,etag:string,size:bigint,error:string,missing_since:string>"


def read_records(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a malformed one fails the read; the schema is never inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_records_or_none(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """As read_records, but a path that doesn't exist is an empty table."""
    try:
        return read_records(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One object of key -> record in a file, as rows: url and the record's fields."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{MANIFEST_ENTRY}>")).alias("url", "e"))
    return whole.select("url", "e.*")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Nested objects bank -> url -> record, flattened; the last bank by name wins for a url."""
    entry = "struct<point_ids:array<string>,tables:array<string>,start:string,end:string>"
    banks = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,map<string,{entry}>>")).alias("bank", "urls"))
    rows = banks.select("bank", F.explode("urls").alias("url", "e")).select("bank", "url", "e.*")
    return rows.groupBy("url").agg(F.max_by(F.struct("bank", "point_ids", "tables", "start", "end"), "bank").alias("r")).select("url", "r.*")


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.json of a folder but those whose names begin with _; unreadable files are left out."""
    schema = "id string, topic string, category string, subcategory string, columns array<string>, rows map<string,map<string,string>>, _corrupt_record string"
    got = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "[!_]*.json").json(folder)
    return got.filter(F.col("id").isNotNull()).drop("_corrupt_record")


def table_cells(tables: DataFrame) -> DataFrame:
    """Comparison tables in long form: table_id, bank, col, pos, value. Column order is data."""
    each = tables.select(F.col("id").alias("table_id"), "columns", F.explode("rows").alias("bank", "cells"))
    placed = each.select("table_id", "bank", "cells", F.posexplode("columns").alias("pos", "col"))
    return placed.select("table_id", "bank", "col", "pos", F.element_at("cells", F.col("col")).alias("value"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """The fields of a header between two lines that are exactly ---, as a map, and the body after it."""
    pattern = "(?s)^---[ ]*\\r?\\n(.*?)\\r?\\n---[ ]*(?:\\r?\\n|$)(.*)$"
    has = text.rlike(pattern)
    head = F.filter(F.split(F.regexp_extract(text, pattern, 1), "\\r?\\n"), lambda s: s.contains(":"))
    pair = lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.substring(s, F.length(F.substring_index(s, ":", 1)) + 2, F.length(s))), '^["\']|["\']$', "").alias("v"))
    entries = F.transform(head, pair)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.when(has, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>")), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text)


def read_pages(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Text files with headers from several folders, earlier folders first: url, fields, body. Of several files of one url the first folder's
    counts; pages tagged as irrelevant stay out."""
    all_ = None
    for rank, folder in enumerate(folders):
        own = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.lit(rank).alias("rank"))
        all_ = own if all_ is None else all_.unionByName(own)
    fields, body = front_matter(F.col("value"))
    rows = all_.select(fields.alias("fields"), body.alias("body"), "file", "rank").withColumn("url", F.col("fields")["url"]).filter("url IS NOT NULL")
    rows = rows.filter(F.coalesce(F.col("fields")["content_relevance"], F.lit("")) != "gereksiz")
    return rows.groupBy("url").agg(F.min_by(F.struct("fields", "body", "file"), F.struct("rank", "file")).alias("r")).select("url", "r.*")


def sitemap_locations(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit("(?is)<loc>\\s*(.*?)\\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def html_options(page: Column, name: str) -> Column:
    """(value, label) of every option of a named select."""
    body = F.regexp_extract(page, f"(?is)<select[^>]*name=[\"']{name}[\"'][^>]*>(.*?)</select>", 1)
    p = F.lit("(?is)<option[^>]*value=[\"']([^\"']*)[\"'][^>]*>\\s*(.*?)\\s*</option>")
    return F.arrays_zip(F.regexp_extract_all(body, p, F.lit(1)).alias("value"), F.regexp_extract_all(body, p, F.lit(2)).alias("label"))


def html_rows(page: Column) -> Column:
    """The rows of the first table as arrays of cell texts."""
    body = F.regexp_extract(page, "(?is)<table[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(body, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), "\\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), clean))


def by_header(rows: Column, fold) -> Column:
    """Rows under their header as maps from folded header to cell: columns are found by name, not place. Rows and header are read once."""
    cut = lambda xs, k, r: F.slice(xs, F.lit(1), F.least(F.size(k), F.size(r)))
    below = lambda all_: F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0)))
    return let(rows, lambda all_: let(F.transform(F.get(all_, F.lit(0)), fold), lambda k: F.transform(below(all_), lambda r: F.map_from_arrays(cut(k, k, r), cut(r, k, r)))))


def write_records(df: DataFrame, path: str, key: str) -> None:
    """Line-delimited JSON, replaced as a whole, in key order over all files; columns in order of name."""
    df.select(*sorted(df.columns)).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """CSV as spreadsheets of this locale read it: semicolons, CRLF, blank for null, a byte order mark before the header."""
    names = df.columns
    marked = df.select(*[F.col(c).alias(("\ufeff" if k == 0 else "") + c) for k, c in enumerate(names)])
    marked.write.mode("overwrite").option("sep", ";").option("lineSep", "\r\n").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def put_blobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Content-addressed store: rows of `new` (content) whose digest `old` lacks, once each: digest, content, n_bytes."""
    keyed = new.select(F.sha2("content", 256).alias("digest"), "content", F.octet_length("content").alias("n_bytes"))
    return keyed.join(old.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])


def garbage(blobs: DataFrame, live: DataFrame, keep_suffix: str) -> DataFrame:
    """Blobs that nothing refers to and whose kind isn't kept, with their total."""
    dead = blobs.join(live.select("digest").distinct(), "digest", "left_anti").filter(~F.col("path").endswith(keep_suffix))
    return dead.agg(F.count("*").alias("files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"))


def latest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(time).desc()))
    return df.withColumn("_n", nth).filter("_n = 1").drop("_n")
