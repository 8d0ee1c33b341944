"""Events, scores, geography, text, sources, streaming, components and the entry module."""

import datetime
import math
import os
import shutil

import numpy as np
from pyspark.sql import functions as F

from tidewell.functions import geo, keys, money, text
from tidewell.operators import events, nearhash, scores
from tidewell.operators.components import connected_components
from tidewell.sources import readers
from tidewell.streaming import incremental

T0 = datetime.datetime(2024, 1, 1)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def test_components_match_union_find(spark):
    random = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_history_cycles_and_sessions(spark):
    rows = [(1, i, at(h), s) for i, (h, s) in enumerate([(0, "on"), (1, "on"), (2, "off"), (3, "on"), (30, "off"), (31, "on"), (32, "off"), (33, "on")])]
    df = spark.createDataFrame(rows, "key long, tie int, ts timestamp_ntz, state string")
    history = events.change_history(df, "key", "ts", "tie", ["state"]).orderBy("tie").collect()
    assert [r.tie for r in history] == [0, 2, 3, 4, 5, 6, 7] and history[0].changed == [] and history[1].changed == ["state"]
    assert events.cycles(df, "key", "ts", "tie", "state", "off", "on", 1).first().asDict() == {"key": 1, "cycles": 3, "flagged": True}
    assert [r.session for r in events.sessions(df, "key", "ts", "tie", "2 hours").orderBy("tie").collect()] == [1, 1, 1, 1, 2, 2, 2, 2]


def test_evidence_terms_are_rounded_one_by_one(spark):
    rows = [("a", "risk", "r1", 1.0, 1, "open", False), ("a", "risk", "r2", 0.35, 2, "confirmed", True), ("a", "trust", "t", 1.0, 3, "dismissed", False)]
    df = spark.createDataFrame(rows, "k string, polarity string, reason string, weight double, independent int, review string, stale boolean")
    got = scores.evidence_scores(df, ["k"]).first()
    risk = 0.5 + round(round(0.35 * 0.75 * 1.5 * 0.5, 3) / 2 + 1e-12, 3)
    assert got.risk == risk and got.trust == 0 and math.isclose(got.score, 1 - math.exp(-risk), abs_tol=1e-6)


def test_wilson_and_market(spark):
    low, high = scores.wilson(F.lit(8.0), F.lit(10.0))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert abs(r.l - 0.4902) < 1e-3 and abs(r.h - 0.9433) < 1e-3
    rows = [(i, "s", f"k{i}", float(100 + i), 50.0 + i, T0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, seg string, key string, p double, area double, created_at timestamp_ntz")
    got = {r.id: (r.comparables, r.median) for r in scores.market_comparison(df, ["seg"], "key", "p", "area").collect()}
    assert got[0] == (5, 103.0)


def test_near_hashes(spark):
    base = 0x0123456789ABCDEF
    rows = [(1, f"{base:016x}"), (2, f"{base ^ 0b1111111:016x}"), (3, f"{base ^ 0xFF:016x}"), (4, f"{base:016x}"), (5, "f" * 16)]
    df = spark.createDataFrame(rows, "id long, h string")
    assert {(r.a, r.b, r.bits) for r in nearhash.near_pairs(df, "id", "h").collect()} == {(1, 2, 7), (2, 3, 1)}
    assert nearhash.without_chrome(df, "h", "id", 2).count() == 3


def test_geography(spark):
    df = spark.createDataFrame([(46.43, 30.76), (46.48, 30.73), (None, 30.7)], "lat double, lng double")
    got = df.select(geo.cosine_distance(F.col("lat"), F.col("lng"), 46.43, 30.76).alias("d"), geo.in_polygon(F.col("lat"), F.col("lng"), [[(46.4, 30.7), (46.4, 30.8), (46.5, 30.8), (46.5, 30.7)]]).alias("inside")).collect()
    assert got[0].d < 0.2 and 5900 < got[1].d < 6100 and got[2].d is None
    assert [r.inside for r in got] == [True, True, False]
    south, west, north, east, wraps = geo.bounding_box(10, 179.99, 50_000)
    assert wraps and west > 179 and east < -179
    assert geo.bounding_box(89.99, 0, 50_000)[1::2] == (-180.0, 180.0)
    east_of = spark.range(1).select(geo.bearing(F.lit(0.0), F.lit(1.0), 0.0, 0.0).alias("b")).first().b
    assert abs(east_of - 90) < 1e-9


def test_money(spark):
    df = spark.createDataFrame([(100.0, "UAH", "sale"), (1e5, "USD", "sale"), (5.0, "ZZZ", "sale")], "p double, c string, d string")
    usd = money.to_usd(F.col("p"), F.col("c"))
    assert [r[0] for r in df.select(usd).collect()] == [2.5, 1e5, None]
    assert [r[0] for r in df.select(money.plausible(usd, F.col("d"))).collect()] == [None, 1e5, None]
    bands = spark.createDataFrame([(x,) for x in (0.5, 0.84, 1.15, 1.3, 1.4, 2.0)], "r double").select(money.band(F.col("r"))).collect()
    assert [r[0] for r in bands] == ["green", "blue", "pink", "orange", "yellow", "red"]


def test_text_and_keys(spark):
    df = spark.createDataFrame([("Write a@b.com or https://x.y/z or @handle_1 or +380 44 123 45 67",)], "t string")
    assert df.select(text.redact(F.col("t"))).first()[0] == "Write [EMAIL] or [URL] or [TELEGRAM] or [PHONE]"
    assert spark.range(1).select(text.transliterated(F.lit("Київ Харків"))).first()[0] == "kiiv kharkiv"
    one = keys.role_key(F.lit("UA"), F.lit("Acme LLC"), F.lit("Senior  Data Engineer"), F.lit("Kyiv"))
    two = keys.role_key(F.lit("ua"), F.lit("ACME, LLC."), F.lit("Data Engineer (full-time) remote"), F.lit("kyiv"))
    assert spark.range(1).select(one == two).first()[0]
    assert spark.createDataFrame([("a",), (None,)], "k string").select(keys.fnv1a_bucket("k")).collect()[0][0] == 0xAF63DC4C8601EC8C % 100


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([('[{"id": 1, "extra": 2}, {"id": 3}]', '{"n": 5, "s": "x"}')], "j string, p string")
    assert [r.id for r in readers.json_recordset(df, "j", "id long").collect()] == [1, 3]
    got = df.select(readers.typed_field(F.col("p"), "n", "int"), readers.typed_field(F.col("p"), "s", "int")).first()
    assert tuple(got) == (5, None)
    feed = "<rss><item><title><![CDATA[A & B]]></title><link>http://a</link></item><item><title>C</title></item></rss>"
    items = spark.range(1).select(readers.rss_items(F.lit(feed)).alias("i")).first().i
    assert [(i.title, i.link) for i in items] == [("A & B", "http://a"), ("C", None)]
    html = "<html><script>x</script><p>Hello <b>you</b></p><!-- no --></html>"
    assert spark.range(1).select(readers.visible_text(F.lit(html))).first()[0] == "Hello you"
    (tmp_path / "r.csv").write_text('Phone Number,Note\n"1,2","say ""hi"""\n')
    row = readers.registry_csv(spark, str(tmp_path / "r.csv"), {"phone": ["phone number"], "note": [], "gone": []}).first()
    assert (row.phone, row.note, row.gone) == ("1,2", 'say "hi"', None)
    pages = {0: [(1,)], 1: [(2,)], 2: [(1,)]}
    assert [p for p, _ in readers.crawl_pages(lambda n: pages.get(n, []))] == [0, 1]


def _stream(spark, tmp_path, small):
    folder = tmp_path / "in"
    os.makedirs(folder)
    shutil.copy(f"{small}/events.parquet", folder / "e.parquet")
    return incremental.event_stream(spark, str(folder), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def _drain(df, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName("out").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql("SELECT * FROM out")


def test_streamed_windows_match_the_batch(spark, tmp_path, small):
    got = _drain(incremental.windowed_counts(_stream(spark, tmp_path, small)), "complete")
    batch = spark.read.parquet(f"{small}/events.parquet").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    assert {(r.start, r.event_type, r.n) for r in got.collect()} == {(r.w.start, r.event_type, r["count"]) for r in batch.collect()}


def test_streamed_history_matches_the_batch(spark, tmp_path, small):
    got = _drain(incremental.state_changes(_stream(spark, tmp_path, small)), "append")
    batch = events.change_history(spark.read.parquet(f"{small}/events.parquet"), "user_id", "ts", "event_id", ["event_type"])
    assert {(r.event_id, r.state) for r in got.collect()} == {(r.event_id, r.state) for r in batch.collect()}


def test_upsert_sink_is_idempotent(spark, tmp_path):
    write = incremental.upsert_sink(spark, str(tmp_path / "t"), ["id"], ["v"], "at")
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, v string, at int")
    write(first, 0)
    for _ in range(2):
        write(spark.createDataFrame([(1, None, 3), (2, "c", 3)], "id long, v string, at int"), 1)
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()} == {(1, "b"), (2, "c")}


def test_entry_and_oracles(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 60
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) > 60


def test_queries_match_duckdb(spark, small):
    import duckdb

    from tidewell.plans import registry

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    norm = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, small)
        columns = sorted(df.columns)
        got = sorted(tuple(norm(r[k]) for k in columns) for r in df.collect())
        cursor = c.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns, name
        assert got == sorted(tuple(norm(r[names.index(k)]) for k in columns) for r in cursor.fetchall()), name
