"""Edge cases of the pipeline's stages, and the chain of classifiers against a plain version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidewell.llm import toxicity

PASSAGE = "Grey herons wade along the quiet northern canal. They wait for small fish between the reeds. Every evening they return to one tall tree. "
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 0), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 0),
    (None, "one two three four five six seven", "en", None, None), (None, None, None, None, None), (7, "", "en", "a", 0),
    (8, LONG, "en", "b", 1), (9, PASSAGE + "First of all it rains.", "en", "b", 1), (10, PASSAGE + "Last of all it snows.", "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def kept(*left_out):
    return sorted(((r[0], r[1]) for i, r in enumerate(ROWS) if i not in left_out), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("row", F.lit("x")).withColumn("Removed_Lines", F.lit(5))


def test_near_duplicates_keep_one_row_of_equal_ones(spark, docs, small):
    out = pipeline.drop_near_duplicates(spark, docs, small)
    assert out.columns == pipeline.COLUMNS
    got = rows_of(out)
    empty = [r for r in got if not r[1]]
    assert len(empty) == 1 and [r for r in got if r[1]] == [r for r in kept(1) if r[1]]  # null and empty texts are copies
    assert pipeline.drop_near_duplicates(spark, docs.limit(0), small).count() == 0


def test_repeated_lines_go_with_what_holds_nothing_else(spark, docs, small):
    out = pipeline.drop_repeated_lines(spark, docs, small)
    got = rows_of(out)
    assert out.columns == pipeline.COLUMNS and (1, ROWS[0][1]) in got and got.count((1, ROWS[0][1])) == 1
    assert {(None, None), (7, ""), (None, ROWS[2][1]), (8, LONG)} <= set(got)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in out.collect())
    assert pipeline.drop_repeated_lines(spark, docs.limit(0), small).count() == 0


def test_repeated_passages_stay_once(spark, docs, small):
    out = pipeline.drop_repeated_passages(spark, docs, small)
    got = dict(rows_of(out.where("doc_id in (9, 10)")))
    assert out.columns == pipeline.COLUMNS and got[9] == ROWS[6][1] and "herons" not in got[10] and "snows" in got[10]
    assert {(None, None), (7, ""), (None, ROWS[2][1]), (8, LONG)} <= set(rows_of(out))
    assert pipeline.drop_repeated_passages(spark, docs.limit(0), small).count() == 0


def test_packing_takes_every_row(spark, docs, small):
    got = pipeline.pack(spark, docs, small).collect()
    starts = [r for r in got if r.start == 0]
    assert len(starts) == len(ROWS) and sum(r.doc_tokens == 1 for r in starts) == 2
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in starts)
    assert pipeline.pack(spark, docs.limit(0), small).count() == 0


def test_toxicity_keeps_nulls_and_clean_rows(spark, small):
    real = spark.read.parquet(f"{small}/documents.parquet").select(*pipeline.COLUMNS)
    edge = spark.createDataFrame([(None, None, None, None, None), (-7, "", "en", "a", 0)], SCHEMA)
    out = pipeline.drop_toxic(spark, real.union(edge), small)
    assert out.columns == pipeline.COLUMNS and out.where("doc_id is null").count() == 1 and out.where("doc_id = -7").count() == 1
    assert 0.5 * real.count() < out.count() < real.count() + 2


def unique_rows(n=80):
    """Rows with a word of their own each, so only training on a row itself tells its label."""
    labels = np.random.default_rng(3).integers(0, 2, n)
    return [({f"own{i}": 1}, (int(y), int(y))) for i, y in enumerate(labels)], [[f"own{i}" for i in range(n)], []]


def test_links_are_not_fitted_to_predictions_of_the_row_itself():
    rows, chosen = unique_rows()
    chain = toxicity.fit_chain(rows, ["x", "y"], chosen)
    place = {f: i for i, f in enumerate(chosen[0])}
    x = np.zeros((len(rows), len(place)), dtype=np.float32)
    for i, (counts, _) in enumerate(rows):
        for f, n in counts.items():
            x[i, place[f]] = toxicity._value(n)
    y = np.array([r[1][0] for r in rows], dtype=np.float32)

    def link(earlier):
        return float(toxicity._fit_linear(toxicity._odds(earlier).astype(np.float32)[:, None], y)[0][0])

    w, b = toxicity._fit_linear(x, y)
    seen = link(1 / (1 + np.exp(-(x @ w + b))))
    unseen = np.zeros(len(rows))
    for k in range(toxicity.FOLDS):
        own = np.arange(len(rows)) % toxicity.FOLDS == k
        w, b = toxicity._fit_linear(x[~own], y[~own])
        unseen[own] = 1 / (1 + np.exp(-(x[own] @ w + b)))
    assert abs(chain.links[1][0] - link(unseen)) < 1e-3
    assert abs(chain.links[1][0] - seen) > 0.5


def test_scores_are_those_of_a_plain_chain(spark):
    texts = ["bad", "good words here", "bad bad good", "", None]
    chain = toxicity.Chain(("a", "b"), [{"bad": 2.0}, {"good": -1.0}], [[], [0.7]], [-1.0, 0.3])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, chain).collect():
        counts = toxicity.features(r.text or "")
        a = 1 / (1 + math.exp(-(-1.0 + 2.0 * (toxicity._value(counts["bad"]) if "bad" in counts else 0))))
        b = 1 / (1 + math.exp(-(0.3 + 0.7 * math.log(a / (1 - a)) - (toxicity._value(counts["good"]) if "good" in counts else 0))))
        assert abs(r.p_a - a) < 1e-9 and abs(r.p_b - b) < 1e-9
