"""Queries that answer for every row, against brute force."""

import hashlib

import numpy as np

from tidewell.plans.registry import QUERIES


def test_every_title_has_its_links(spark, small):
    rows = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{small}/part.parquet").collect()}
    words = {n: set(n.lower().split(" ")) for n in rows.values()}
    near = {(a, b) for a in words for b in words if len(words[a] & words[b]) / len(words[a] | words[b]) >= 0.3}
    got = {r.id: (r.class_id, r.links) for r in QUERIES["title_jaccard_members"](spark, small).collect()}
    least = {n: min(i for i, m in rows.items() if m == n) for n in words}
    assert got == {i: (least[n], sum((n, m) in near for m in rows.values()) - 1) for i, n in rows.items()}


def test_every_vector_has_its_links(spark, small):
    def hashed(r):
        x = np.array(r.embedding, dtype=np.float32)
        signs = (x[0::2] + x[1::2] > 0).astype(int)
        return int(hashlib.md5(str(r.label).encode()).hexdigest()[:8], 16) << 32 | int("".join(map(str, signs)), 2)

    rows = {r.vec_id: hashed(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    got = {r.id: (r.class_id, r.links) for r in QUERIES["hamming_band_members"](spark, small).collect()}
    least = {h: min(i for i, g in rows.items() if g == h) for h in rows.values()}
    assert got == {i: (least[h], sum((h ^ g).bit_count() <= 7 for g in rows.values()) - 1) for i, h in rows.items()}


def test_every_point_has_a_radius(spark, small):
    from tidewell.operators.scores import zone_radii
    from tidewell.plans.texts import points

    def way(a, b):
        (p, q), (r, s) = np.radians(a), np.radians(b)
        h = np.sin((r - p) / 2) ** 2 + np.cos(p) * np.cos(r) * np.sin((s - q) / 2) ** 2
        return 2 * 6371000 * np.arcsin(np.sqrt(h))

    rows = [(r.point, r.lat, r.lng) for r in points(spark, small).limit(400).collect()]
    rows += [(-1, 10.0, 179.99), (-2, 10.0, -179.99), (-3, 89.99, 0.0), (-4, 89.99, 180.0), (-5, -40.0, 5.0), (-6, 50.0, 5.0), (-7, 50.04, 5.0)]
    df = spark.createDataFrame([*rows, (-8, None, 5.0)], "point long, lat double, lng double")
    got = {r.id: r.radius for r in zone_radii(df, "point").collect()}
    want = {i: min(3000, max(300, 0.45 * min(way((a, b), (c, d)) for j, c, d in rows if j != i))) for i, a, b in rows}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 0.011 for i in want) and len(set(got.values())) > 2
    assert zone_radii(df.where("point = -1"), "point").count() == 0
    everyone = {r.point for r in points(spark, small).where("lat is not null and lng is not null").collect()}
    assert {r.point for r in QUERIES["zone_radii"](spark, small).collect()} == everyone


def test_all_words_of_an_item_are_searched(spark, small):
    import re

    words = lambda t: {w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w}
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = sorted((r.item_id, r.doc_id) for r in QUERIES["fulltext_all_terms"](spark, small).collect())
    assert got == sorted((i, d) for i, q in items.items() for d, w in docs.items() if q and q <= w)
