"""Operators whose work must not grow with the square of a segment, a bucket or a crowd, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tidewell.plans.registry import QUERIES


def test_hashes_of_one_half_meet_in_chunks(spark, monkeypatch):
    from tidewell.operators import nearhash

    monkeypatch.setattr(nearhash, "CHUNK", 64, raising=True)
    rng = np.random.default_rng(5)
    low = np.concatenate([rng.integers(0, 2**32, 500), rng.integers(0, 2**16, 200), [0, 127, 255]]).astype(np.uint64)
    hashes = list({int(h) | int(0xDEADBEEF if i % 3 else 0xDEADBEFF) << 32 for i, h in enumerate(low)})
    rows = [(i, f"{h:016x}") for i, h in enumerate(hashes)] + [(9000, f"{hashes[0]:016x}"), (9001, None)]
    got = sorted(tuple(r) for r in nearhash.near_pairs(spark.createDataFrame(rows, "id long, h string"), "id", "h").collect())
    far = [[(a ^ b).bit_count() for b in hashes] for a in hashes]
    want = sorted((i, j, far[i][j]) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if far[i][j] <= 7)
    assert got == want and len(want) > 500


def test_a_vector_without_label_has_no_links(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    rows.withColumn("label", F.when(F.col("vec_id") % 7 > 0, F.col("label"))).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id for r in QUERIES["hamming_band_members"](spark, str(tmp_path)).collect()}
    assert got == {r.vec_id for r in rows.collect() if r.vec_id % 7 > 0}


def test_ranking_writes_no_row_for_each_query_and_document(spark):
    from tidewell.functions.text import words
    from tidewell.operators import search
    from tidewell.session import Scratch

    scratch = Scratch(spark)
    docs = spark.createDataFrame([(i, f"apartment balcony w{i % 3}" if i % 2 else "apartmant street") for i in range(40)], "id long, body string")
    made = search.build(docs, "id", {"body": search.Field(words(F.col("body")), 2.0)}, scratch)
    asked = spark.createDataFrame([(q, "apartment balcony") for q in range(60)], "query long, text string")
    got = {(r.query, r.id) for r in search.rank(made, asked, scratch, 0.5).collect()}
    assert got == {(q, i) for q in range(60) for i in range(40)}
    assert max(table.count() for table, _ in scratch.tables) <= 60 * 2  # as many as the words of the queries, not 60 x 40
    scratch.clear()


def test_market_comparison_leaves_out_the_own_key(spark):
    from tidewell.operators.scores import market_comparison

    rng = np.random.default_rng(3)
    rows = [(i, [None, "a", "b"][i % 3], f"k{rng.integers(0, 40)}", float(rng.integers(50, 70)), float(rng.integers(0, 60)) + 0.5 * (i % 2), int(rng.integers(0, 9))) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, seg string, key string, p double, area double, created_at int")
    got = {r.id: (r.comparables, r.median) for r in market_comparison(df, ["seg"], "key", "p", "area").collect()}
    one = {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        one[r[1], r[2]] = r
    want = {}
    for i, seg, key, _, area, _ in rows:
        near = [c[3] for (s, k), c in one.items() if s == seg and seg and k != key and abs(area - c[4]) <= max(5, area * 0.15)]
        if len(near) >= 3:
            want[i] = (len(near), float(np.median(near)))
    assert got == want and len(want) > 100


def test_windows_take_values_of_their_own_beside_shared_points(spark):
    from tidewell.operators.market import window_medians
    from tidewell.session import Scratch

    rng = np.random.default_rng(4)
    points = [("s", float(x) / 2, float(v)) for x, v in zip(rng.integers(0, 200, 300), rng.integers(1, 900, 300))]
    windows = [("s", float(w), w - 7.5, w + 7.5) for w in range(0, 110, 3)] + [("t", 1.0, 0.0, 2.0)]
    own = [("s", float(w), float(v)) for w in range(0, 60, 3) for v in rng.integers(1, 2000, w % 5)] + [("t", 1.0, 4.0)]
    made = [spark.createDataFrame(points, "seg string, x double, v double").withColumn("c", F.lit(1).cast("long")),
            spark.createDataFrame(windows, "seg string, w double, lo double, hi double"), spark.createDataFrame(own, "seg string, w double, v double")]
    scratch = Scratch(spark)
    got = {(r.seg, r.w): (r.n, r.median) for r in window_medians(made[0], made[1], ["seg"], scratch, made[2]).collect()}
    all_of = {(s, w): [v for t, x, v in points if t == s and lo <= x <= hi] + [v for t, u, v in own if (t, u) == (s, w)] for s, w, lo, hi in windows}
    assert got == {k: (len(v), float(np.median(v))) for k, v in all_of.items() if v}
    scratch.clear()


def test_nearest_of_each_kind_in_crowds_and_at_poles(spark):
    from tidewell.operators.scores import nearest_per_kind

    rng = np.random.default_rng(6)
    rows = [(i, 60 + float(rng.normal(0, 0.01)), 5 + float(rng.normal(0, 0.02)), "abc"[i % 3]) for i in range(300)]
    rows += [(1000 + i, 60.0, 5.0, "a") for i in range(40)] + [(2000, 60.02, 5.03, "rare"), (2001, 60.021, 5.03, "rare")]
    rows += [(3000, 89.99, 0.0, "a"), (3001, 89.99, 180.0, "a"), (3002, 10.0, 179.99, "a"), (3003, 10.0, -179.99, "b"), (3004, None, 1.0, "a")]
    df = spark.createDataFrame(rows, "point long, lat double, lng double, kind string")
    got = sorted((r.point, r.kind, r.rn, r.place) for r in nearest_per_kind(df, 3, 4000.0).collect())

    def way(p, q):
        (a, b), (c, d) = np.radians(p[1:3]), np.radians(q[1:3])
        return 2 * 6371000 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    want = []
    for p in rows[:-1]:
        for kind in ("a", "b", "c", "rare"):
            near = sorted((w, q[0]) for q in rows[:-1] if q[3] == kind and q[0] != p[0] and (w := way(p, q)) <= 4000)
            want += [(p[0], kind, i + 1, q) for i, (_, q) in enumerate(near[:3])]
    assert got == sorted(want)


def test_records_of_several_holders_and_contacts_come_once(spark):
    from tidewell.operators import privacy
    from tidewell.session import Scratch

    rng = np.random.default_rng(7)
    contacts = [(c, "mail" if c % 2 else "phone", str(c // 2)) for c in range(20)]
    links = [(int(a), int(c)) for a, c in zip(rng.integers(0, 30, 70), rng.integers(0, 20, 70))]
    held = [(int(a), "identity" if i % 2 else "evidence", int(i)) for a, i in zip(rng.integers(0, 30, 120), rng.integers(0, 80, 120))]
    asked = [(int(r), "mail" if k else "phone", str(v)) for r, k, v in zip(rng.integers(0, 25, 60), rng.integers(0, 2, 60), rng.integers(0, 14, 60))]
    scratch = Scratch(spark)
    frames = [spark.createDataFrame(x, s) for x, s in ((asked, "request int, type string, value string"), (contacts, "contact long, type string, value string"), (links, "actor long, contact long"), (held, "actor long, kind string, id long"))]
    got = sorted(privacy.subject_records(*frames, scratch).collect(), key=str)
    want = set()
    for r in {x[0] for x in asked}:
        own = {c: f"{t}:{v}" for c, t, v in contacts if (r, t, v) in set(asked)}
        actors = {a for a, c in links if c in own}
        want |= {(r, "contact", c, v) for c, v in own.items()} | {(r, "actor", a, None) for a in actors} | {(r, k, i, None) for a, k, i in held if a in actors}
        want |= {(r, "contact", c, None) for a, c in links if a in actors and c not in own}
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    # What is written is what contacts lead to, not the answers: more requests write no more.
    written = {p.split("-")[1]: t.count() for t, p in [(t, p.rsplit("/", 1)[1]) for t, p in scratch.tables]}
    assert "reached" not in written and len(want) > 300
    scratch.clear()


def test_lines_within_the_radius_are_linked_whatever_bits_differ(spark):
    from tests.llm.test_lines import alike, check, simhash
    from tidewell.llm import lines

    rng = np.random.default_rng(9)
    few = [m & (2**64 - 1) for m in lines.block_masks(5, 1)]
    docs = []
    while len(docs) < 40:
        words = [f"word{x}" for x in rng.integers(0, 10**6, 20)]
        other = [w if i not in (3, 11) else f"else{rng.integers(0, 10**6)}" for i, w in enumerate(words)]
        differ = simhash(" ".join(words)) ^ simhash(" ".join(other))
        if differ.bit_count() <= lines.RADIUS and all(differ & m for m in few) and alike(" ".join(words), " ".join(other)):
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(other))]
    assert len(check(spark, docs)) == 20
    for _ in range(2000):
        differ = sum(1 << int(b) for b in rng.choice(64, lines.RADIUS, replace=False))
        assert any(differ & m & (2**64 - 1) == 0 for m in lines.block_masks())
