"""Operators on pages and embeddings, the pipeline, and the registry."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import packing, queries, registry, topk, toxicity, warc
from tidewell.session import load


def test_warc_whole_table(spark, small):
    pages = {r.page_id: r.html or "" for r in load(spark, small, "pages").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = {r.page_id: r for r in queries.op4_warc(spark, small).collect()}
    assert got.keys() == pages.keys()
    for i, html in pages.items():
        raw = html.encode()
        assert got[i].payload_bytes == len(raw) and got[i].intact
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first[html] == i else ("revisit", first[html]))


PAGES = [(4, "u", "same"), (2, "http://x/\n", "same"), (2, None, "same"), (9, "v", None), (8, "v", ""), (None, "w", "only null"), (None, "w", "same"), (5, "é", "x" * 300_000)]


def test_warc_edges(spark):
    df = spark.createDataFrame([(*r, "k") for r in PAGES], "page_id long, url string, html string, sha1 string")
    index, folder = warc.write_warc(df)
    rows = warc.read_warc(index, folder).collect()
    got = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in rows)
    assert got == sorted(
        [(False, 2, "response", 0, 4), (False, 2, "revisit", 2, 4), (False, 4, "revisit", 2, 4), (False, 5, "response", 0, 300_000),
         (False, 8, "response", 0, 0), (False, 9, "revisit", 8, 0), (True, 0, "response", 0, 9), (True, 0, "revisit", 2, 4)]
    )
    some = warc.read_warc(index.where("page_id = 5"), folder).collect()
    assert len(some) == 1 and bytes(some[0].payload) == b"x" * 300_000 and some[0].url == "é"
    files = {r.file for r in index.collect()}
    assert sum(gzip.open(f).read().count(b"WARC-Type:") for f in files) == len(PAGES)
    empty, folder = warc.write_warc(df.limit(0))
    assert warc.read_warc(empty, folder).count() == 0


def test_warc_least_payload(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    index, folder = warc.write_warc(df, least=3)
    got = {r.page_id: r.record_type for r in warc.read_warc(index, folder).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def _brute(ids, x, k):
    out = set()
    for i in range(len(ids)):
        if ids[i] % 50 == 0:
            scores = x @ x[i]
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
            out |= {(int(ids[i]), n, int(ids[j]), int(scores[j])) for n, j in enumerate(order, 1)}
    return out


def test_topk_whole_table(spark, small):
    rows = load(spark, small, "embeddings").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.floor(256 * np.array([r.embedding for r in rows], dtype=np.float64)).astype(np.int64)
    got = {tuple(r) for r in queries.op5_topk(spark, small).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == _brute(ids, x, 5)


def test_topk_ties_shards_and_bad_vectors(spark):
    random = np.random.default_rng(2)
    x = random.integers(-3, 4, (300, 4))
    x[40:160] = x[0]
    df = spark.createDataFrame([(i, [float(v) / 256 for v in row]) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    bad = [(1000, None), (1050, [1.0, None, 0.0, 0.0]), (1100, [float("nan"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (1150, [float("inf"), 0.0, 0.0, 0.0])]
    vectors = topk.quantised(df.union(spark.createDataFrame(bad, "vec_id long, embedding array<double>")))
    got = topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, shard_rows=64, block=2)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == _brute(np.arange(300), x, 5)
    two = vectors.where("vec_id in (0, 7)")
    assert topk.top_k(two, two.where("vec_id = 0"), 5).count() == 1
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 5).count() == 0


def test_sorted_lists_stop_early():
    random = np.random.default_rng(5)
    x = np.floor(random.pareto(1.2, (4000, 4)) * 10)
    lists = topk.SortedLists(x, np.arange(4000))
    depths = []
    for q in x[:20]:
        at, scores, depth = lists.search(q, 5, 8)
        order = np.lexsort((np.arange(4000), -(x @ q)))[:5]
        assert at.tolist() == order.tolist() and scores.tolist() == (x @ q)[order].tolist()
        depths.append(depth)
    assert np.mean(depths) < 1000


def test_pipeline_drops_what_it_should(spark, small):
    import corpus_pipeline

    docs = load(spark, small, "documents")
    kept = docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, small)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        sizes.append(kept.count())
    assert docs.count() > sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > docs.count() // 2
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    direct = packing.with_checksums(packing.pack(kept, queries.vocabulary_path("byte_bpe_50k.json")))
    assert direct.count() == packed.count()


def test_registry_has_every_operator():
    assert {name.split("_")[0] for name in registry.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_topk_of_vectors_of_several_lengths(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (1, [3, 1]), (2, [1, 1, 1]), (50, [2, 0, 1]), (4, [9])], "vec_id long, v array<long>")
    got = topk.top_k(rows, rows.where("vec_id % 50 = 0")).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(0, 1, 1, 5), (50, 1, 2, 3)}


def test_topk_is_exact_for_large_components(spark):
    rng = np.random.default_rng(8)
    for size in (3e7, 1e9):
        rows = [(i, [float(x) for x in rng.integers(-int(size), int(size), 4)]) for i in range(60)]
        df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, V string")
        v = topk.quantised(df, factor=1)
        found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 20 = 0")).collect()}
        for q in (0, 20, 40):
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(rows[q][1], w)), i) for i, w in rows if i != q)[:5]
            assert [found[q, n + 1] for n in range(5)] == [(i, -s) for s, i in scores]
    far = spark.createDataFrame([(1, [1e300]), (2, [2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leaves 64 bits"):
        topk.quantised(far).collect()


def test_toxicity_fits_one_row_an_id(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id % 2 AS doc_id", "concat('text number ', id) AS text")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    seen = []
    real = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, *rest: seen.append(len(rows)) or real(rows, *rest))
    toxicity.train(docs, labels, ["toxic"])
    assert seen == [2]
