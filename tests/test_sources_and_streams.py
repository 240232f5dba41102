"""Readers, writers, payloads and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quayside.functions import text as X
from quayside.functions import values as V
from quayside.operators import incremental, lookups
from quayside.sources import files, quotes
from quayside.streaming import boards


def test_records(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("b", "x"), ("a", None)], "doc_id string, text string")
    files.write_records(rows, path, "doc_id")
    assert [r.doc_id for r in files.read_records(spark, path).orderBy("doc_id").collect()] == ["a", "b"]
    assert files.read_records_or_none(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad.json").write_text('{"doc_id": "a"}\n\n{oops\n')
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        files.read_records(spark, str(tmp_path / "bad.json")).collect()


def test_manifest_pool_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"u1": {"status": 200, "etag": "e"}, "u2": {"error": "x"}}))
    assert {(r.url, r.status) for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()} == {("u1", 200), ("u2", None)}
    (tmp_path / "p.json").write_text(json.dumps({"b1": {"u": {"point_ids": ["1"]}}, "b2": {"u": {"point_ids": ["2"]}, "v": {"start": "2026"}}}))
    assert {(r.url, r.bank) for r in files.read_pool(spark, str(tmp_path / "p.json")).collect()} == {("u", "b2"), ("v", "b2")}
    d = tmp_path / "tables"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"id": "a", "columns": ["x", "y"], "rows": {"k": {"y": "2"}}}, indent=1))
    (d / "_skip.json").write_text("{}")
    (d / "bad.json").write_text("{")
    assert [(r.bank, r.col, r.value) for r in files.table_cells(files.read_tables(spark, str(d))).orderBy("pos").collect()] == [("k", "x", None), ("k", "y", "2")]


def test_pages_with_headers(spark, tmp_path):
    for k, (folder, name, body) in enumerate([("one", "a.md", "---\nurl: https://h/a\ntitle: 'T: t'\n---\nbody --- x"), ("two", "a.md", "---\nurl: https://h/a\n---\nold"), ("two", "b.md", "---\nurl: https://h/b\ncontent_relevance: gereksiz\n---\nb"), ("two", "c.md", "no header")]):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{k}{name}").write_text(body)
    (r,) = files.read_pages(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).collect()
    assert r.url == "https://h/a" and r.fields["title"] == "T: t" and r.body == "body --- x"


def test_html_and_payloads(spark):
    page = """<select name='cur'><option value='1'>US Dollar</option><option value="">-</option><option value="2">  Euro </option></select>
    <table><tr><th>Döviz</th><th>Alış</th><th>Satış</th></tr><tr><td>Dollar (USD)</td><td>40,10</td><td>41,20</td></tr><tr><td>Euro (EUR)</td><td>0</td><td>0</td></tr></table>"""
    plan = "<table><tr><th>Taksit Tutarı</th><th>Ana Para</th><th>Kâr</th><th>Kalan</th></tr><tr><td>1.000,50</td><td>900</td><td>100,50</td><td>0</td></tr></table>"
    js = json.dumps({"Data": [{"c": "TL", "n": "lira", "b": "1,5", "s": "2"}, {"c": "X", "n": "x", "b": "0", "s": "2"}]})
    ajax = json.dumps([{"command": "insert", "selector": "#a", "data": "1"}, {"command": "other"}])
    df = spark.createDataFrame([(page, plan, js, ajax, "<urlset><url><loc> https://h/a?x=1&amp;y=2 </loc></url></urlset>")], "page string, plan string, js string, ajax string, xml string")
    r = df.select(
        quotes.products(F.col("page"), "cur").alias("p"), quotes.rates_from_table(F.col("page")).alias("t"),
        quotes.schedule_from_html(F.col("plan"), {"payment": "Taksit Tutarı", "principal": "Ana Para", "profit": "Kâr", "remaining": "Kalan"}).alias("s"),
        quotes.rates_from_json(F.col("js"), "Data array<struct<c:string,n:string,b:string,s:string>>", "Data", "c", "n", "b", "s").alias("j"),
        quotes.commands(F.col("ajax")).alias("a"), files.sitemap_locations(F.col("xml")).alias("x"),
        quotes.ms_date(F.lit("/Date(1754006400000+0300)/")).alias("d"), quotes.first_positive([F.lit(0.0), F.lit(2.5)]).alias("f"),
    ).first()
    assert [(x.code, x.name) for x in r.p] == [("1", "US Dollar"), ("2", "Euro")]
    assert [(x.code, x.buy, x.sell) for x in r.t] == [("USD", 40.10, 41.20)]
    assert [(x.n, x.payment, x.principal, x.profit, x.tax) for x in r.s] == [(1, 1000.5, 900.0, 100.5, 0.0)]
    assert [(x.code, x.buy) for x in r.j] == [("TRY", 1.5)] and r.a == {"#a": "1"} and r.x == ["https://h/a?x=1&y=2"] and r.d == "2025-08-01" and (r.f.attempt, r.f.value) == (1, 2.5)
    q = spark.range(1).select(quotes.quote(F.lit(100.0), F.lit(2), F.lit(0.0), F.lit(0.0), F.array().cast(quotes.SCHEDULE)).alias("q")).first().q
    assert q.refused == "no quote"


def test_mile_rates_and_union(spark):
    cards = spark.createDataFrame([("c", [("t", [("f", {"p": 1.5})])])], "card string, tiers array<struct<tier:string,features:array<struct<feature:string,rates:map<string,double>>>>>")
    assert [tuple(r) for r in quotes.unnest_mile_rates(cards).collect()] == [("c", "t", "f", "p", 1.5)]
    a, b = spark.createDataFrame([("USD", 1)], "code string, v int"), spark.createDataFrame([("USD", 2), ("EUR", 3)], "code string, v int")
    assert {tuple(r) for r in quotes.prefer_first(a, b, "code").collect()} == {("USD", 1), ("EUR", 3)}


def test_blobs_and_gates(spark):
    old = spark.createDataFrame([], "digest string")
    new = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    assert files.put_blobs(old, new).count() == 2
    blobs = spark.createDataFrame([("x", "1.pdf", 5), ("y", "2.html", 7), ("z", "3.html", 9)], "digest string, path string, n_bytes long")
    assert tuple(files.garbage(blobs, spark.createDataFrame([("z",)], "digest string"), ".pdf").first()) == (1, 7)
    assert incremental.deletion_gate(10, 3) and not incremental.deletion_gate(10, 2) and not incremental.deletion_gate(0, 0)


def test_bands(spark):
    df = spark.createDataFrame([(30,), (90,), (180,), (360,), (720,), (55,)], "days int")
    got = {r.days: r.band for r in lookups.nearest_band(df, "days", [31, 91, 180, 364, 366]).collect()}
    assert got == {30: 31, 90: 91, 180: 180, 360: 364, 720: 366, 55: None}


def test_language_and_money_round_trip(spark):
    r = spark.range(1).select(X.language_score(F.lit("x" * 39), "ç", ("ve",)).alias("a"), V.money(F.lit("1.234,5-")).alias("b")).first()
    assert r.a == 0.0 and r.b in (0.0, 1234.5)


def test_streams_in_many_batches(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    folder = tmp_path / "in"
    rows = events.collect()
    for k in range(4):
        part = rows[k * 250 : (k + 1) * 250]
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(str(folder / f"{k}"))
    stream = spark.readStream.schema(boards.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(folder))
    q = boards.edge_alerts(stream, 40).writeStream.format("memory").queryName("alerts").trigger(availableNow=True).start()
    q.awaitTermination()
    above, want = {}, set()
    for r in rows:
        if r.value > 40 and not above.get(r.user_id):
            want.add(r.event_id)
        above[r.user_id] = r.value > 40
    assert {r.event_id for r in spark.table("alerts").collect()} == want
    out = str(tmp_path / "out")
    q = stream.writeStream.foreachBatch(boards.upsert_into(out, "user_id", "ts")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.user_id: r.event_id for r in rows}
    assert {r.user_id: r.event_id for r in boards.last_version(spark, out).collect()} == last


def test_upsert_rewrites_only_the_buckets_of_a_batch(spark, tmp_path):
    out = str(tmp_path / "target")
    write = boards.upsert_into(out, "k", "t", buckets=8)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "target").rglob("*.parquet")}
    batch = lambda rows: spark.createDataFrame(rows, "k long, t long, n string")
    held = lambda: {r.k: (r.t, r.n) for r in boards.last_version(spark, out).collect()}
    write(batch([(k, 0, "a") for k in range(100)]), 0)
    before = files()
    write(batch([(3, 1, "b"), (3, 2, "c"), (1000, 1, "new")]), 1)
    want = {k: (0, "a") for k in range(100)} | {3: (2, "c"), 1000: (1, "new")}
    now = files()
    assert held() == want and all(now[p] == t for p, t in before.items()) and 1 <= len(set(now) - set(before)) <= 2
    write(batch([(3, 1, "b"), (3, 2, "c"), (1000, 1, "new")]), 1)
    assert held() == want and len(files()) == len(now)
    write(batch([(3, 5, "d")]), 2)
    write(batch([(3, 6, "e")]), 3)
    assert held() == want | {3: (6, "e")} and len(files()) <= len(now) + 1
    write(batch([]), 4)
    assert held() == want | {3: (6, "e")}


def test_by_header_reads_its_rows_once(spark):
    """The rows are named once in the made column, not once for each cell of each row."""
    page = "<table><tr><th>Ana Para</th><th>Kâr</th></tr><tr><td>1</td><td>2</td><td>3</td></tr><tr><td>4</td></tr></table>"
    df = spark.createDataFrame([(page,), ("none",), (None,)], "p string").select(files.by_header(files.html_rows(F.col("p")), X.fold).alias("r"))
    assert [r.r for r in df.collect()] == [[{"anapara": "1", "kar": "2"}, {"anapara": "4"}], [], None]
    assert df._jdf.queryExecution().analyzed().toString().count("<table") == 1


class _Kept:
    """A state variable that counts its calls."""

    calls = 0

    def __init__(self):
        self.held = {}

    def _of(name):  # noqa: N805
        def call(self, *args):
            _Kept.calls += 1
            return {
                "updateValue": lambda k, v: self.held.__setitem__(k, v), "update": lambda v: self.held.__setitem__((), v), "removeKey": lambda k: self.held.pop(k), "clear": lambda: self.held.clear(),
                "iterator": lambda: iter(list(self.held.items())), "exists": lambda: bool(self.held), "get": lambda: self.held[()],
            }[name](*args)

        return call

    updateValue, update, removeKey, clear, iterator, exists, get = map(_of, ("updateValue", "update", "removeKey", "clear", "iterator", "exists", "get"))  # noqa: N815


def test_rows_wait_in_blocks():
    """Few calls to the state for many rows, the rows that are not due wait on, and none is told twice."""
    import pandas as pd

    from quayside.streaming import status

    class Handle:
        getMapState = getValueState = lambda self, *a: _Kept()  # noqa: N815
        timers = []

        def registerTimer(self, ms):  # noqa: N802
            self.timers.append(ms)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    merge, n, minute = status.StatusMerge(), 10_000, 60_000_000
    merge.init(Handle())
    part = pd.DataFrame({"us": [k * minute for k in range(n)][::-1], "event_id": range(n), "product": "p", "state": ["ok" if k % 2 else "down" for k in range(n)]})
    assert list(merge.handleInputRows((1,), iter([part]), None)) == [] and Handle.timers == [0]
    half = [r for df in merge.handleExpiredTimer((1,), At(4999 * 60_000), None) for r in df["at"].tolist()]
    rest = [r for df in merge.handleExpiredTimer((1,), At(9999 * 60_000), None) for r in df["at"].tolist()]
    assert [len(half), len(rest)] == [4999, 5000] and half + rest == [k * minute for k in range(1, n)]
    assert _Kept.calls < 60 and not merge.waiting.held


def _told(checks, now, quiet):
    """What checks of (us, event_id, user_id, product, state) make, one source and one check at a time."""
    out = []
    for user in {c[2] for c in checks}:
        held, last = {}, None
        for us, event, _, product, state in sorted((c for c in checks if c[2] == user and c[0] // 1000 <= now), key=lambda c: c[:2]):
            if last is not None and us // 1000 > last // 1000 + quiet:
                out.append((user, None, None, None, last, "stale", last + quiet * 1000))
                held = {}
            last, (before, since) = us, held.get(product, (None, None))
            if before != state:
                if before is not None or state != "ok":
                    out.append((user, product, event, before or "unknown", since, state, us))
                held[product] = (state, us)
        if last is not None and last // 1000 + quiet <= now:
            out.append((user, None, None, None, last, "stale", last + quiet * 1000))
    return out


def _source_stream(seed=0, sources=300, n=12_000):
    import random

    r = random.Random(seed)
    users = [None, *((1 << 60) + k for k in range(sources - 1))]
    return [(r.randrange(2 * 86_400_000) * 1000 + r.choice((0, 0, 7)), (1 << 60) + k, r.choice(users), r.choice((None, "p", "q")), r.choice(("ok", "slow", "down"))) for k in range(n)]


@pytest.mark.parametrize("at_once", [1 << 20, 1000])
def test_sources_of_a_bucket_share_the_calls(monkeypatch, at_once):
    """The state is called as often for many sources as for one, and each is told what it would be told alone, however the stream is cut."""
    import pandas as pd
    import pyarrow as pa

    from quayside.streaming import status

    class Handle:
        getMapState = getValueState = lambda self, *a: _Kept()  # noqa: N815
        timers = []

        def registerTimer(self, ms):  # noqa: N802
            self.timers.append(ms)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    monkeypatch.setattr(status, "MERGE", at_once)
    merged, most = status.merge, []
    monkeypatch.setattr(status, "merge", lambda held, due, *a: most.append(due.num_rows) or merged(held, due, *a))
    kinds = pa.schema([("us", pa.int64()), ("event_id", pa.int64()), ("user_id", pa.int64()), ("product", pa.string()), ("state", pa.string()), ("bucket", pa.int32())])
    packed = lambda checks: pa.Table.from_batches(status.pack(iter(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*c, 0) for c in checks), strict=True), kinds.types, strict=True)], schema=kinds).to_batches(1000)))).to_pandas()
    checks, calls = _source_stream(), []
    # Up to four minutes late; where some come twice, they count once.
    came = sorted(checks + checks[::50], key=lambda c: c[0] // 1000 + hash(c[1]) % 240_000)
    for lots in (1, 6):
        merge, told, now, _Kept.calls, Handle.timers = status.StatusMerge(), [], 0, 0, []
        merge.init(Handle())
        for k in range(lots):
            lot = came[len(came) * k // lots : len(came) * (k + 1) // lots]
            assert list(merge.handleInputRows((0,), iter([packed(lot)]), At(now))) == []
            told += [r for t in sorted(t for t in Handle.timers if t <= now) for df in merge.handleExpiredTimer((0,), At(now), None) for r in df.astype(object).itertuples(index=False, name=None)]
            now = max(now, max(c[0] for c in lot) // 1000 - 600_000)
        # What comes after the watermark is not taken, what comes with it in a block is.
        late = (checks[0][2], "q", "late")
        assert list(merge.handleInputRows((0,), iter([packed([(now * 1000 + 999, 1, *late), ((now + 1) * 1000, 2, *late)])]), At(now))) == []
        for _ in range(2):
            told += [r for df in merge.handleExpiredTimer((0,), At(now), None) for r in df.astype(object).itertuples(index=False, name=None)]
        got = [tuple(None if pd.isna(v) else v for v in r) for r in told]
        want = _told(checks, now, status.QUIET_MS)
        assert len(got) == len(want) > 3000 and set(got) == set(want) and {c[2] for c in checks} == {g[0] for g in got}
        rest = [r for _, block in merge.waiting.held.values() for r in status._unpacked(block).to_pylist()]
        assert {r["event_id"] for r in rest} == {c[1] for c in checks if c[0] // 1000 > now} | {2} and all(t > now for t in Handle.timers[-1:])
        calls.append(_Kept.calls)
    assert calls[0] < 40 and calls[1] < 150 and (max(most) > 11_000 if at_once > 12_000 else 900 < max(most) < 1100)
    # An event without a number is none of the others; nothing makes nothing.
    some = pa.Table.from_pylist([{"user_id": 1, "us": 5, "event_id": e, "product": "p", "state": s, "since": 5} for e, s in ((None, "down"), (0, "slow"), (None, "ok"), (0, "slow"))], status.ROW)
    told, held = status.merge(status.ROW.empty_table(), some, 0, 1)
    assert told["state"].tolist() == ["slow", "down", "ok"] and held.to_pylist() == [{"user_id": 1, "us": 5, "event_id": None, "product": "p", "state": "ok", "since": 5}]
    assert [len(t) for t in status.merge(status.ROW.empty_table(), status.ROW.empty_table(), 0, 1)] == [0, 0]


def test_checks_go_into_as_many_files_as_said(spark, tmp_path):
    """A lot of checks is one micro-batch, so it must have all its files, though it has fewer rows."""
    from quayside.plans import streams

    rows = spark.createDataFrame([(None, 1, 2, "p", "ok")], "ts timestamp, user_id long, event_id long, product string, state string").withColumn("ts", F.timestamp_micros(F.lit(5)))
    for k, (some, n) in enumerate(((rows, 5), (rows.filter("user_id = 0"), 3))):
        streams._in_files(some, n).write.parquet(str(tmp_path / str(k)))
        assert len(list((tmp_path / str(k)).glob("*.parquet"))) == n
        assert [tuple(r) for r in spark.read.parquet(str(tmp_path / str(k))).filter("ts IS NOT NULL").drop("ts").collect()] == [(1, 2, "p", "ok")][: 1 - k]
