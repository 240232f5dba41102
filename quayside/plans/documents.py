"""Queries over documents: normalisation, quality gates, duplicates, chunks, votes and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, ordering
from ._tables import table
from .catalog import register

STRIP = "regexp_replace(text, '^[\\t\\n\\v\\f\\r ]+|[\\t\\n\\v\\f\\r ]+$', '', 'g')"
LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: length(s) >= {n})"


def fold_sql(e: str) -> str:
    return f"translate(lower(translate({e}, '{X.FOLD_FROM}', '{X.FOLD_TO}')), '{X.MARKS_FROM}', '{X.MARKS_TO}')"


@register("text_normalise", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\t ]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM documents")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[\\t ]+", " "), " ?\\n ?", "\n"), "\\n{3,}", "\n\n")
    return table(spark, d, "documents").select("doc_id", F.trim(own, F.lit(" \n")).alias("text"))


@register("text_hash", f"SELECT doc_id, substr(sha256({STRIP}), 1, 16) AS text_hash FROM documents")
def text_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.text_hash(F.col("text")).alias("text_hash"))


@register("exact_dup_groups", f"SELECT substr(sha256({STRIP}), 1, 16) AS text_hash, count(*) AS n, min(doc_id) AS canonical FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_groups(table(spark, d, "documents"), X.text_hash(F.col("text")).alias("text_hash"), "doc_id")


@register(
    "canonical_of_dup",
    f"""WITH h AS (SELECT doc_id, n_chars, substr(sha256({STRIP}), 1, 16) AS k FROM documents), r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id % 3 DESC, doc_id) AS rn FROM h)
    SELECT d.doc_id AS redundant, c.doc_id AS canonical FROM r d JOIN r c ON d.k = c.k AND c.rn = 1 WHERE d.rn > 1""",
)
def canonical_of_dup(spark: SparkSession, d: str) -> DataFrame:
    """The copy with the most references (here doc_id % 3) stands for all, then the least id."""
    keyed = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("refs"), X.text_hash(F.col("text")).alias("k"))
    return dedup.redundant_to_canonical(keyed, "k", "doc_id", "refs")


@register("unique_line_ratio", f"WITH l AS (SELECT doc_id, {LINES.format(n=20)} AS l FROM documents) SELECT doc_id, CASE WHEN len(l) < 5 THEN 1.0 ELSE len(list_distinct(l)) / len(l) END AS ratio FROM l")
def unique_line_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.unique_line_ratio(F.col("text")).alias("ratio"))


@register("stub_filter", f"SELECT doc_id, length({STRIP}) AS n FROM documents WHERE length({STRIP}) < 250")
def stub_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(X.is_stub(F.col("text"))).select("doc_id", F.length(X.strip(F.col("text"))).cast("long").alias("n"))


@register("toc_filter", f"WITH l AS (SELECT doc_id, text, list_slice({LINES.format(n=1)}, 1, 40) AS l FROM documents) SELECT doc_id, contains(substr(text, 1, 400), '— Site İçeriği') OR len(l) >= 20 AND len(list_filter(l, lambda s: starts_with(s, '- [') OR starts_with(s, '* ['))) > 0.8 * len(l) AS is_contents FROM l")
def toc_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.looks_like_contents(F.col("text")).alias("is_contents"))


LANG_WORDS = ("der", "die", "und", "von", "zu", "dem", "den", "als", "in", "ist")


@register(
    "lang_score",
    f"""WITH t AS (SELECT doc_id, substr(text, 1, 8000) AS own FROM documents), s AS (SELECT doc_id, own, length(own) AS n, length(regexp_replace(own, '[^\\p{{L}}]', '', 'g')) AS letters FROM t)
    SELECT doc_id, CASE WHEN length(regexp_replace(own, '^\\s+|\\s+$', '', 'g')) < 40 THEN 0.0 ELSE CAST(round(CAST((CASE WHEN letters = 0 THEN 0 ELSE least((n - length(regexp_replace(own, '[äöüßÄÖÜ]', '', 'g'))) / letters * 25.0, 1.0) END
      + least(len(list_intersect(list_distinct(string_split_regex(lower(own), '[^\\p{{L}}\\p{{N}}_]+')), {list(LANG_WORDS)})) / 6.0, 1.0)
      + least(letters / n * 1.5, 1.0)) / 3 AS DECIMAL(20, 12)), 3) AS DOUBLE) END AS score FROM s""",
)
def lang_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.language_score(F.col("text"), "äöüßÄÖÜ", LANG_WORDS).alias("score"))


PAGED = "SELECT conv_id, turn, 'Verification of ' || conv_id || chr(10) || text || chr(10) || CASE WHEN turn % 2 = 0 THEN 'even page' ELSE 'page ' || turn END AS text FROM conversations"
STAMPS = f"""WITH pg AS ({PAGED}), l AS (SELECT DISTINCT conv_id, turn, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')) AS line FROM pg),
    n AS (SELECT conv_id, count(*) AS pages FROM pg GROUP BY 1), b AS (SELECT conv_id, line, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT b.conv_id, line, b.n FROM b JOIN n USING (conv_id) WHERE pages >= 3 AND b.n >= pages * 0.8)"""


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """Documents of several pages: the turns of a conversation, each with a stamp above and a foot below."""
    foot = F.when(F.col("turn") % 2 == 0, "even page").otherwise(F.concat(F.lit("page "), F.col("turn").cast("string")))
    text = F.concat(F.lit("Verification of "), F.col("conv_id").cast("string"), F.lit("\n"), "text", F.lit("\n"), foot)
    return table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))


@register("boilerplate_lines", STAMPS + " SELECT conv_id, line, n FROM s")
def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines on four fifths of a document's pages, if it has three or more; a line counts once a page."""
    pages = _paged(spark, d)
    lines = pages.select("conv_id", F.explode(F.array_distinct(X.lines(F.col("text")))).alias("line")).groupBy("conv_id", "line").agg(F.count("*").alias("n"))
    counts = pages.groupBy("conv_id").agg(F.count("*").alias("pages"))
    return lines.join(counts, "conv_id").filter((F.col("pages") >= 3) & (F.col("n") >= F.col("pages") * 0.8)).select("conv_id", "line", "n")


@register("strip_boilerplate", STAMPS + """, g AS (SELECT conv_id, list(line) AS stamps FROM s GROUP BY 1)
    SELECT conv_id, turn, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(stamps, []), trim(x))), chr(10))) AS kept, len(list_filter(string_split(text, chr(10)), lambda x: list_contains(coalesce(stamps, []), trim(x)))) AS n_stripped FROM pg LEFT JOIN g USING (conv_id)""")
def strip_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Each page without its document's stamps. A document has at most as many stamps as a page has lines."""
    stamps = boilerplate_lines(spark, d).groupBy("conv_id").agg(F.collect_set("line").alias("stamps"))
    rows = _paged(spark, d).join(stamps, "conv_id", "left").withColumn("stamps", F.coalesce("stamps", F.array().cast("array<string>")))
    own = F.split("text", "\n")
    kept = F.filter(own, lambda s: ~F.array_contains(F.col("stamps"), F.trim(s)))
    return rows.select("conv_id", "turn", F.md5(F.array_join(kept, "\n").cast("binary")).alias("kept"), (F.size(own) - F.size(kept)).cast("long").alias("n_stripped"))


@register("chunk_windows_8196_820", "SELECT doc_id, pos, start, length(substr(text, start + 1, 8196)) AS n_chars, md5(substr(text, start + 1, 8196)) AS chunk_hash FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 820, 1) - 1, 7376)) AS start FROM documents) w, LATERAL (SELECT start // 7376 AS pos)")
def chunk_windows_8196_820(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", "text", F.explode(X.window_starts(F.length("text"), 8196, 820)).alias("start"))
    piece = F.substring(F.col("text"), F.col("start") + 1, F.lit(8196))
    return own.select("doc_id", F.expr("cast(start div 7376 as bigint)").alias("pos"), F.col("start").cast("long").alias("start"), F.length(piece).cast("long").alias("n_chars"), F.md5(piece.cast("binary")).alias("chunk_hash"))


@register("chunk_spans", "SELECT doc_id, max(start // 7376) + 1 AS n_chunks FROM (SELECT doc_id, unnest(generate_series(0, greatest(length(text) - 820, 1) - 1, 7376)) AS start FROM documents) GROUP BY doc_id")
def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    return chunk_windows_8196_820(spark, d).groupBy("doc_id").agg((F.max("pos") + 1).alias("n_chunks"))


@register("chunk_ids", "SELECT 'doc' || doc_id || ':window:' || (start // 7376) AS chunk_id, sha256('doc' || doc_id || ':window:' || (start // 7376)) AS point_key, doc_id FROM (SELECT doc_id, unnest(generate_series(0, greatest(length(text) - 820, 1) - 1, 7376)) AS start FROM documents)")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(":window:"), F.col("pos").cast("string"))
    return chunk_windows_8196_820(spark, d).select(key.alias("chunk_id"), F.sha2(key, 256).alias("point_key"), "doc_id")


def _fold_sql(pieces: str, most: int, gap: str) -> str:
    """Pieces packed in order, as X.packed does it."""
    own = f"list_transform({pieces}, lambda p: [p])"
    step = f"lambda a, x: CASE WHEN a[-1] = '' THEN list_concat(a[:-2], x) WHEN length(a[-1]) + {len(gap)} + length(x[1]) <= {most} THEN list_concat(a[:-2], [a[-1] || '{gap}' || x[1]]) ELSE list_concat(a, x) END"
    return f"list_transform(list_reduce({own}, {step}), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))"


def chunk_sql(most: int) -> str:
    paragraphs = _fold_sql("string_split(text, chr(10) || chr(10))", most, "\n\n")
    sentences = _fold_sql("string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))", most, " ")
    split = f"flatten(list_transform({paragraphs}, lambda p: CASE WHEN length(p) <= {most} THEN [p] ELSE {sentences} END))"
    hard = f"flatten(list_transform({split}, lambda p: CASE WHEN length(p) <= {most} THEN [p] ELSE list_transform(generate_series(0, (length(p) - 1) // {most}), lambda k: substr(p, k * {most} + 1, {most})) END))"
    return f"list_filter(CASE WHEN length(text) <= {most} THEN [text] ELSE {hard} END, lambda s: s <> '' OR length(text) <= {most})"


@register("chunk_paragraph_pack", f"WITH c AS (SELECT doc_id, {chunk_sql(8196)} AS c FROM documents) SELECT doc_id, generate_subscripts(c, 1) - 1 AS pos, length(unnest(c)) AS n_chars, md5(unnest(c)) AS chunk_hash FROM c")
def chunk_paragraph_pack(spark: SparkSession, d: str) -> DataFrame:
    """Texts beyond 8,196 characters in pieces: paragraphs packed in order, then sentences, then a cut. A running sum would give other borders, so this is a
    fold in each document."""
    pieces = X.chunks(F.col("text"), 8196)
    return table(spark, d, "documents").select("doc_id", F.posexplode(pieces).alias("pos", "chunk")).select("doc_id", "pos", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_hash"))


LEAD = "regexp_replace(c[i][-820:], CASE WHEN strpos(c[i][-820:], ' ') BETWEEN 1 AND length(c[i][-820:]) - 1 THEN '^[^ ]* ' ELSE '^$' END, '')"


@register(
    "chunk_overlap_words",
    f"""WITH c AS (SELECT doc_id, {chunk_sql(8196)} AS c FROM documents), o AS (SELECT doc_id, list_transform(generate_series(0, len(c) - 1), lambda i: CASE WHEN i = 0 OR trim({LEAD}) = '' THEN c[i + 1] ELSE {LEAD} || chr(10) || chr(10) || c[i + 1] END) AS c FROM c)
    SELECT doc_id, generate_subscripts(c, 1) - 1 AS pos, length(unnest(c)) AS n_chars, md5(unnest(c)) AS chunk_hash FROM o""",
)
def chunk_overlap_words(spark: SparkSession, d: str) -> DataFrame:
    """Each piece after the first begins with the last 820 characters of the one before, from a word's beginning."""
    pieces = X.with_overlap(X.chunks(F.col("text"), 8196), 820)
    return table(spark, d, "documents").select("doc_id", F.posexplode(pieces).alias("pos", "chunk")).select("doc_id", "pos", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_hash"))


@register("title_slug", f"SELECT doc_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(substr(regexp_replace(replace(trim(regexp_replace({fold_sql('string_split(text, chr(10))[1]')}, '[^a-z0-9]+', ' ', 'g')), ' ', '-'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '') AS s FROM documents)")
def title_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.slug(F.split("text", "\n")[0]).alias("slug"))


@register("fold_key", f"SELECT p_partkey, regexp_replace({fold_sql('p_name')}, '[^a-z0-9]', '', 'g') AS key FROM part")
def fold_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.fold(F.col("p_name")).alias("key"))


@register(
    "slug_unique_suffix",
    f"SELECT p_partkey, CASE WHEN rn = 1 THEN s ELSE s || '-' || rn END AS slug FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS rn FROM (SELECT p_partkey, replace(trim(regexp_replace({fold_sql('p_name')}, '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS s FROM part))",
)
def slug_unique_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Slugs made unique by -2, -3 in order of creation."""
    return dedup.unique_suffix(table(spark, d, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug")), "slug", "p_partkey")


VOTES = "SELECT d.source, sum(l.quality) AS pos, sum(1 - l.quality) AS neg, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source"


@register("relevance_vote", f"SELECT source, CASE WHEN n < 10 THEN pos > 0 ELSE neg <= pos END AS relevant FROM ({VOTES})")
def relevance_vote(spark: SparkSession, d: str) -> DataFrame:
    """Under ten votes one positive is enough; from ten on the majority decides, ties are positive."""
    votes = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    own = votes.groupBy("source").agg(F.sum("quality").alias("pos"), F.sum(1 - F.col("quality")).alias("neg"), F.count("*").alias("n"))
    return own.select("source", F.when(F.col("n") < 10, F.col("pos") > 0).otherwise(F.col("neg") <= F.col("pos")).alias("relevant"))


@register("contamination_join", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evidence text word for word: candidates share a window of words, then containment is checked. Items and documents meet
    by window, not each with each; only items of one or two words, which have no inner word, are sought in every document."""
    split = lambda text: F.filter(F.split(text, "\\s+"), lambda w: w != "")
    window = lambda t, i, n: F.xxhash64(F.lit(n), *[F.get(t, i + k) for k in range(n)])
    windows = lambda t, n: F.transform(F.slice(t, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0))), lambda _, i: window(t, i, n))

    # The first and last words of an item may be parts of words in a document, so its anchor is the window after the first word, six words at most and
    # without the last.
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"), split(F.col("text")).alias("w")).withColumn("n", F.least(F.size("w") - 2, F.lit(6)))
    sizes = sorted(r.n for r in items.filter("n > 0").select("n").distinct().collect())
    documents = table(spark, d, "documents").select("doc_id", "text")
    found = documents.join(F.broadcast(items.filter("n <= 0")), F.col("text").contains(F.col("passage"))).select("doc_id", "item_id")
    if not sizes:
        return found
    anchor = F.coalesce(*[F.when(F.col("n") == n, window(F.col("w"), F.lit(1), n)) for n in sizes])
    grams = X.let(split(F.col("text")), lambda t: F.array_distinct(F.concat(*[windows(t, n) for n in sizes])))
    pairs = documents.select("doc_id", F.explode(grams).alias("g")).join(items.filter("n > 0").select("item_id", "passage", anchor.alias("g")), "g").select("doc_id", "item_id", "passage").distinct()
    return pairs.join(documents, "doc_id").filter(F.col("text").contains(F.col("passage"))).select("doc_id", "item_id").unionByName(found)


@register("neighbour_expand", "SELECT a.conv_id, a.turn, count(*) AS n_turns, string_agg(b.role, '>' ORDER BY b.turn) AS roles FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY a.conv_id, a.turn")
def neighbour_expand(spark: SparkSession, d: str) -> DataFrame:
    near = W.partitionBy("conv_id").orderBy("turn").rangeBetween(-1, 1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(near).alias("n_turns"), F.array_join(F.collect_list("role").over(near), ">").alias("roles"))


@register("token_concat", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS transcript, count(*) FILTER (role = 'assistant') AS n_answers FROM conversations GROUP BY conv_id")
def token_concat(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("transcript"), F.count_if(F.col("role") == "assistant").alias("n_answers"))


@register(
    "conversation_feedback_join",
    "SELECT conv_id, turn, asked, answered FROM (SELECT q.conv_id, q.turn, length(q.text) AS asked, length(a.text) AS answered, row_number() OVER (PARTITION BY q.conv_id ORDER BY q.turn DESC) AS nth FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant') WHERE nth <= 20",
)
def conversation_feedback_join(spark: SparkSession, d: str) -> DataFrame:
    """The newest twenty question and answer pairs of each conversation; Spark cuts the groups before and after the shuffle."""
    c = table(spark, d, "conversations")
    q = c.filter("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("asked"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("answered"))
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return q.join(a, ["conv_id", "turn"]).withColumn("_n", nth).filter("_n <= 20").drop("_n")


@register(
    "greedy_token_groups",
    f"WITH g AS (SELECT conv_id, list(text ORDER BY turn) AS m FROM conversations GROUP BY 1), p AS (SELECT conv_id, {_fold_sql('m', 600, chr(10))} AS p FROM g) SELECT conv_id, generate_subscripts(p, 1) - 1 AS pos, length(unnest(p)) AS n_chars FROM p",
)
def greedy_token_groups(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a conversation grouped in order under a budget of 600 characters; none is cut, a longer one stands alone."""
    msgs = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"])
    packs = table(spark, d, "conversations").groupBy("conv_id").agg(msgs.alias("m")).select("conv_id", F.posexplode(X.packed(F.col("m"), 600, "\n")).alias("pos", "body"))
    return packs.select("conv_id", "pos", F.length("body").alias("n_chars"))


@register("ends_cut", f"WITH l AS (SELECT doc_id, coalesce({LINES.format(n=1)}[-1], '') AS last FROM documents) SELECT doc_id, starts_with(last, '#') OR NOT regexp_matches(last, '[.!?:;…)\"»]$') AS cut FROM l")
def ends_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.ends_cut(F.col("text")).alias("cut"))


@register("header_passage", "SELECT doc_id, array_to_string(list_filter([source, CASE WHEN lang = 'en' THEN '' ELSE upper(lang) END, string_split(text, chr(10))[1]], lambda x: x <> ''), ' — ') AS header FROM documents")
def header_passage(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a header that are not empty, joined."""
    parts = F.array("source", F.when(F.col("lang") == "en", "").otherwise(F.upper("lang")), F.split("text", "\n")[0])
    return table(spark, d, "documents").select("doc_id", F.array_join(F.filter(parts, lambda x: x != ""), " — ").alias("header"))


@register("uuid5_point_ids", """WITH h AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)
    SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def uuid5_point_ids(spark: SparkSession, d: str) -> DataFrame:
    """Version 5 UUIDs in the URL namespace, from expressions only."""
    return table(spark, d, "pages").select("page_id", X.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.col("url")).alias("point_id"))


@register("sentence_split", "WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS s FROM documents) SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest FROM s GROUP BY doc_id")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
    return own.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).alias("longest"))


@register("cited_sources", "WITH u AS (SELECT page_id, unnest(regexp_extract_all('see ' || url || ', ' || url || '/.', 'https?://[^\\s\"<>]+')) AS link FROM pages) SELECT page_id, regexp_replace(regexp_replace(link, '[.,;:!?]+$', ''), '/$', '') AS source_key, count(*) AS n FROM u GROUP BY 1, 2")
def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(F.concat(F.lit("see "), "url", F.lit(", "), "url", F.lit("/.")), F.lit('https?://[^\\s"<>]+'), F.lit(0))).alias("link"))
    key = F.regexp_replace(F.regexp_replace("link", "[.,;:!?]+$", ""), "/$", "")
    return each.select("page_id", key.alias("source_key")).groupBy("page_id", "source_key").agg(F.count("*").alias("n"))


@register("corpus_tally", "SELECT source, lang, count(*) AS n, sum(n_chars) AS chars, count(*) FILTER (n_chars < 250) AS stubs FROM documents GROUP BY ROLLUP (source, lang)")
def corpus_tally(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 250).alias("stubs"))


@register("group_size_shape", f"SELECT n AS group_size, count(*) AS n_groups FROM (SELECT substr(sha256({STRIP}), 1, 16) AS k, count(*) AS n FROM documents GROUP BY 1) GROUP BY n")
def group_size_shape(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").groupBy(X.text_hash(F.col("text")).alias("k")).agg(F.count("*").alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count("*").alias("n_groups"))


@register("weighted_samples", "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rn <= greatest(12, ceil(0.2 * n))")
def weighted_samples(spark: SparkSession, d: str) -> DataFrame:
    """Of each source the longest fifth, twelve at least."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    ranked = ordering.placed_within(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")]).join(n, "source")
    return ranked.filter(F.col("pos") <= F.greatest(F.lit(12), F.ceil(0.2 * F.col("n")))).select("source", "doc_id", "n_chars")
