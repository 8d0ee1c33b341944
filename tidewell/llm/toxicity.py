"""Toxicity by classifier chains.

Categories are predicted one after another by linear models over words and beginnings of
words; each later model also gets the earlier categories' probabilities. While training,
those come from models that have not seen the row (out of fold), so a later model learns how
far it can trust them.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.rows import place
from tidewell.session import materialize

#: Bounds of what reaches the driver: labelled rows that are fitted, features of a category.
SAMPLE_ROWS = 6000
FEATURES = 1200
LEAST_ROWS = 4
PREFIXES = (4, 5, 6)
FOLDS = 4
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> dict[str, int]:
    """Counts of a whole text's words (in lower case) and of their first letters, those with
    a trailing star."""
    words = Counter(_WORD.findall(text.lower()))
    out = dict(words)
    for word, n in words.items():
        for size in PREFIXES:
            if len(word) > size:
                key = word[:size] + "*"
                out[key] = out.get(key, 0) + n
    return out


def _value(n: int) -> float:
    return min(2.0, 0.7 + 0.3 * n)


@dataclass
class Chain:
    """A fitted chain: for each category its weights by feature, of the earlier
    categories' log-odds, and its intercept."""

    categories: tuple[str, ...]
    weights: list[dict[str, float]]
    links: list[list[float]]
    intercepts: list[float]

    def predict(self, text: str) -> list[float]:
        """Probabilities in the chain's order."""
        counts = features(text)
        out: list[float] = []
        odds: list[float] = []
        for weights, links, intercept in zip(self.weights, self.links, self.intercepts, strict=True):
            z = intercept + sum(a * b for a, b in zip(links, odds, strict=True))
            z += sum(weights[f] * _value(counts[f]) for f in weights.keys() & counts.keys())
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            out.append(p)
            odds.append(_odds(p))
        return out

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> Chain:
        return Chain(**{**json.loads(text), "categories": tuple(json.loads(text)["categories"])})


def _odds(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit_linear(x: np.ndarray, y: np.ndarray, decay: float = 2e-3, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty and classes of equal weight, by accelerated
    gradient descent; the last column is the intercept and bears no penalty."""
    n = len(y)
    if not n or y.min() == y.max():
        return np.zeros(x.shape[1]), 8.0 if n and y[0] else -8.0
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    x1 = np.hstack([x, np.ones((n, 1), dtype=np.float32)])
    norm = np.ones(x1.shape[1], dtype=np.float32)  # the largest curvature, by power iteration
    for _ in range(12):
        norm = x1.T @ (weight * (x1 @ norm))
        norm /= np.linalg.norm(norm)
    top = 0.25 * float(norm @ (x1.T @ (weight * (x1 @ norm)))) / n
    step = 1 / (top * 1.05 + decay)
    w = np.zeros(x1.shape[1], dtype=np.float32)
    ahead, t = w, 1.0
    keep = np.full(len(w), decay, dtype=np.float32)
    keep[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ ahead, -30, 30)))
        new = ahead - step * (x1.T @ (weight * (p - y)) / n + keep * ahead)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        w, t = new.astype(np.float32), t2
    return w[:-1], float(w[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(
    rows: Sequence[tuple[dict[str, int], Sequence[int]]],
    names: Sequence[str],
    chosen: Sequence[Sequence[str]],
    folds: int = FOLDS,
) -> Chain:
    """Fits a chain to (feature counts, labels) rows; ``chosen`` are each category's features.

    The rows' order decides their folds. A category with one class only, or no rows at all,
    gets a constant.
    """
    labels = np.array([y for _, y in rows], dtype=np.float32).reshape(len(rows), len(names))
    fold = np.arange(len(rows)) % folds
    weights, links, intercepts = [], [], []
    earlier = np.zeros((len(rows), 0), dtype=np.float32)
    for j, own in enumerate(chosen):
        place = {f: i for i, f in enumerate(own)}
        x = np.zeros((len(rows), len(own)), dtype=np.float32)
        for i, (counts, _) in enumerate(rows):
            for f in counts.keys() & place.keys():
                x[i, place[f]] = _value(counts[f])
        x = np.hstack([x, earlier])
        y = labels[:, j]
        w, b = _fit_linear(x, y)
        weights.append({f: round(float(v), 6) for f, v in zip(own, w, strict=False) if abs(v) > 1e-5})
        links.append([float(v) for v in w[len(own) :]])
        intercepts.append(b)
        if j + 1 < len(chosen):
            out = np.zeros(len(rows), dtype=np.float32)
            for k in range(folds):
                w, b = _fit_linear(x[fold != k], y[fold != k])
                out[fold == k] = _sigmoid(x[fold == k] @ w + b)
            earlier = np.hstack([earlier, _odds(out).astype(np.float32)[:, None]])
    return Chain(tuple(names), weights, links, intercepts)


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    sample_rows: int = SAMPLE_ROWS,
    n_features: int = FEATURES,
) -> Chain:
    """A chain over 0/1 label columns ``categories`` of ``labels`` (doc_id, ...).

    At most ``sample_rows`` labelled rows are fitted, those with the smallest hash of
    doc_id, which is no property of their text; rows with a null id or label take no part.
    Feature counts by class are aggregated on the executors; the driver gets each
    category's ``n_features`` features with the largest standardised difference between classes
    and the sample's counts of those. Repeated label rows count once, those of one
    document by their largest label.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg(*[F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    names = tuple(categories)
    if not picked:
        return Chain(names, [{} for _ in names], [[0.0] * j for j in range(len(names))], [-8.0] * len(names))
    ys = {r["id"]: tuple(r[1:]) for r in picked}
    small = spark.createDataFrame([(k,) for k in ys], "id long")  # at most sample_rows ids
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # One row a sampled id, so that what is fitted and collected is bounded by the sample, however often an id is repeated.
    texts = texts.join(F.broadcast(small), "id").groupBy("id").agg(F.min("text").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                y = ys[i]
                for f in features(text.as_py() or ""):
                    found[f, y] += 1
            columns = [[f for f, _ in found], [list(y) for _, y in found], list(found.values())]
            kinds = [pa.string(), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["f", "y", "n"])

    seen = texts.mapInArrow(words, "f string, y array<int>, n long")
    per = seen.groupBy("f").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col("y")[j]).alias(f"pos{j}") for j in range(len(names))]
    )
    per = materialize(per.where(F.col("n") >= LEAST_ROWS), "features")
    chosen = []
    for j in range(len(names)):
        total, ones = len(ys), sum(y[j] for y in ys.values())
        gap = F.abs(F.col(f"pos{j}") - F.col("n") * (ones / total)) / F.sqrt(F.col("n") + F.lit(1.0))
        chosen.append([r["f"] for r in per.select("f", gap.alias("gap")).orderBy(F.desc("gap"), "f").limit(n_features).collect()])
    wanted = {f for own in chosen for f in own}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for text in batch.column(1):
                found = features(text.as_py() or "")
                own.append(json.dumps({f: found[f] for f in wanted & found.keys()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string())], ["id", "counts"])

    rows = texts.mapInArrow(counts, "id long, counts string").orderBy("id", "counts").collect()
    return fit_chain([(json.loads(r["counts"]), ys[r["id"]]) for r in rows], names, chosen)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with a column ``p_<category>`` for each category. A null or empty text has the
    probability that the intercepts give. Runs where the rows lie, without a shuffle; only
    the text goes to Python. All other columns are kept, whatever their names, but for those named
    as the added ones, in any case."""
    names = [f"p_{c}" for c in chain.categories]
    spec = chain.to_json()

    @F.arrow_udf("array<double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Chain.from_json(spec)
        for texts in batches:  # one text at a time, so that a batch isn't held twice
            yield pa.array((own.predict(t.as_py() or "") for t in texts), pa.list_(pa.float64()), size=len(texts))

    columns = docs.columns
    kept = [i for i, c in enumerate(columns) if c.lower() not in {n.lower() for n in names}]
    moved = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    moved = moved.withColumn("scores", predict(F.col(f"c{place(columns, 'text')}").cast("string")))
    out = moved.select(*[f"c{i}" for i in kept], *[F.col("scores")[j].alias(f"p{j}") for j in range(len(names))])
    return out.toDF(*[columns[i] for i in kept], *names)
