"""Tokenizer of pages, robots rules, address trees and running scans against plain versions."""

from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from quayside.operators import intervals, lookups, scan, trees
from quayside.sources import markup, robots

NESTED = """<table><caption>c</caption><tr><td rowspan=2>a<td colspan='2'>b &lt;x&gt;<tr><td>c<td><table><tr><td>in<p>ner</table>after
<tr><td>d</td></tr></table></div><TABLE><TBODY><TR><TH>only<script>if (a<b) '<td>'</script> head</TABLE><table><tr><td>open"""


def test_cells_of_nested_unclosed_and_spanned_tables():
    cells = [(c["table_no"], c["parent_table"], c["row_no"], c["col_no"], c["row_span"], c["col_span"], c["is_header"], markup.tidy(c["parts"])) for c in markup.Page(NESTED).cells]
    assert cells == [
        (0, None, 0, 0, 2, 1, False, "a"), (0, None, 0, 1, 1, 2, False, "b <x>"), (0, None, 1, 1, 1, 1, False, "c"), (0, None, 1, 2, 1, 1, False, "after"), (1, 0, 0, 0, 1, 1, False, "inner"),
        (0, None, 2, 0, 1, 1, False, "d"), (2, None, 0, 0, 1, 1, True, "only head"), (3, None, 0, 0, 1, 1, False, "open"),
    ]


def test_options_with_groups_and_attributes(spark):
    page = "<select name=a><option value='1' data-x='{\"k\": 2}' selected>One<option>Two &amp; more</select><select id=b><optgroup label='G'><option value=''>none<option disabled value=9>nine</optgroup><option>out</select><option>stray"
    rows = markup.select_options(spark.createDataFrame([(1, page), (2, None), (3, "no list <b>")], "k long, page string"), "k", "page").collect()
    assert [(r.select_no, r.select_name, r.option_no, r.option_group, r.value, r.label, r.selected, r.disabled, r.attributes) for r in rows] == [
        (0, "a", 0, None, "1", "One", True, False, '{"data-x":"{\\"k\\": 2}"}'), (0, "a", 1, None, "Two & more", "Two & more", False, False, "{}"),
        (1, "b", 0, "G", "", "none", False, False, "{}"), (1, "b", 1, "G", "9", "nine", False, True, "{}"), (1, "b", 2, None, "out", "out", False, False, "{}"),
    ]


FILES = {
    "a": "User-agent: x\nUser-agent: quaybot\nAllow: /p/open\nDisallow: /p/\nDisallow: /q\nCrawl-delay: 7\n\nUser-agent: *\nDisallow: /",
    "b": "User-agent: *\nDisallow: /p\nAllow: /\n\nUser-agent: other\nDisallow: /",
    "c": "",
    "d": "Disallow: /lost\nuser-agent: *  # all\ndisallow:\n",
    "e": "User-agent: QuayBot/2.0\nDisallow: /\n\nUser-agent: QuayBot\nDisallow: *\nDisallow: /q",
    "f": "User-agent: nobody\nDisallow: /",
    "g": "User-agent: *\nDisallow: /p/open\nDisallow: /p/o\nAllow: /p\nDisallow: /p/x/y.html\nCrawl-delay: many",
}
PATHS = ["/", "/p", "/p/", "/p/open/1", "/p/other", "/q", "/qq/1", "/lost", "/p/x/y.html", ""]


def test_robots_decisions_are_those_of_the_standard_parser(spark):
    pages = [(h, p) for h in [*FILES, "none"] for p in PATHS]
    of = robots.rules(spark.createDataFrame(list(FILES.items()), "host string, text string"), "quaybot")
    got = {(r.host, r.path): (r.allowed, r.delay) for r in robots.decisions(spark.createDataFrame(pages, "host string, path string"), "host", "path", of).collect()}
    for h in [*FILES, "none"]:
        parser = RobotFileParser()
        parser.parse(FILES.get(h, "").splitlines())
        for p in PATHS:
            assert got[h, p][0] == parser.can_fetch("quaybot", f"https://{h}.example{p}"), (h, p)
    assert {h: d for (h, _), (_, d) in got.items()} == {**dict.fromkeys([*FILES, "none"], 1.0), "a": 7.0}


def test_verdicts_come_from_the_nearest_decided_ancestor(spark):
    leaves = [("h/a/b/c/d/e/f/g",), ("h/a/x",), ("i/z",), (None,)]
    nodes = trees.nodes(spark.createDataFrame(leaves, "leaf string"), "leaf")
    decided = {"h": "dive", "h/a/b": "skip", "h/a/b/c/d/e/f": "fetch"}
    given = nodes.withColumn("verdict", F.create_map(*[F.lit(x) for kv in decided.items() for x in kv])[F.col("node")])
    got = {r.node: (r.decided_by, r.verdict) for r in trees.inherited(given, "verdict").collect()}
    assert got["h/a/b/c/d/e/f/g"] == ("h/a/b/c/d/e/f", "fetch") and got["h/a/b/c/d/e"] == ("h/a/b", "skip") and got["h/a/x"] == ("h", "dive") and got["i/z"] == (None, None)
    assert {r.node: r.n_leaves for r in nodes.collect()}["h/a"] == 2


@pytest.mark.parametrize("share", [0.0, 0.6])
def test_scans_over_a_hot_key_equal_windows(spark, share):
    rows = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") < 3000 * share, 1).when(F.col("id") % 50 != 0, F.col("id") % 7).alias("k"), (F.xxhash64("id") % 1000).alias("t"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"), F.when(F.xxhash64("id", F.lit(2)) % 5 != 0, "a").otherwise("b").alias("s"),
    )
    there = scan.ranged(rows, ["k"], ["t", "id"], 8)
    if share:
        sizes = [r["count"] for r in there.filter("k = 1").groupBy("_part").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 900
    got = scan.last_so_far(scan.previous(there, ["k"], ["t", "id"], "v", "p"), ["k"], ["t", "id"], "v", "l").select("id", "p", "l")
    rows.createOrReplaceTempView("scan_rows")
    want = spark.sql("SELECT id, lag(v) OVER w AS p, last(v, true) OVER (PARTITION BY k ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS l FROM scan_rows WINDOW w AS (PARTITION BY k ORDER BY t, id)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    since = intervals.islands(rows, "k", ["t", "id"], "s", "t").select("id", "since")
    want = spark.sql("SELECT id, min(t) OVER (PARTITION BY k, i) AS since FROM (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY t, id) AS i FROM (SELECT *, CASE WHEN s <=> lag(s) OVER (PARTITION BY k ORDER BY t, id) THEN 0 ELSE 1 END AS f FROM scan_rows))")
    assert sorted(map(tuple, since.collect())) == sorted(map(tuple, want.collect()))


def test_as_of_over_stretches(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, at long")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (3, 1, 1)], "k long, seen long, value long")
    assert sorted((r.k, r["at"], r.value) for r in lookups.as_of(left, right, "k", "at", "seen", "value").collect()) == [(1, 1, None), (1, 5, 50), (2, 9, None)]


def test_layouts_are_shared_and_pages_dealt_out(spark, sf):
    from quayside.plans import catalog

    page = "<script>'<td>'</script><table><tr><th rowspan=2>{}<td>a &amp; {}<tr><td><![CDATA[<{}>]]></table>"
    one, two = (markup.Page(page.format(*x)) for x in (("x", "y", "z"), ("p", "&lt;", "z")))
    assert one.layout is two.layout
    assert [[markup.tidy(c["parts"]) for c in p.cells] for p in (one, two)] == [["x", "a & y", "<z>"], ["p", "a & <", "<z>"]]
    assert [(c["row_no"], c["col_no"]) for c in one.cells] == [(0, 0), (0, 1), (1, 1)]
    wide = markup.Page("<table><tr><td rowspan=3 colspan=2>a<td>b<tr><td rowspan=1000 colspan=1000>c<tr><td>d").cells
    assert [(c["row_no"], c["col_no"]) for c in wide] == [(0, 0), (0, 2), (1, 2), (2, 1002)]
    # One small file is one read task; the pages made of it are more.
    assert catalog.queries()["html_select_options"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_malformed_raw_elements():
    for page, cells in (("<table><td><script\" \"a>x</script>y", ["y"]), ("<table><td><title/>x<td><style>a<td>", ["x", ""]), ("<table><td><title>a</TITLE >b", ["b"])):
        assert [markup.tidy(c["parts"]) for c in markup.Page(page).cells] == cells
