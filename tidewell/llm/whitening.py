"""Whitening of embeddings by matrix-free block subspace iteration.

Entries become whole numbers, so sums, counts and deviations are exact; rows are centred as whole numbers (n x - S) before
they are divided. The covariance is never formed: each pass over the written fit list computes X'(XQ) for a
block Q, in tasks that hold a batch of rows and one block. The driver, which gets a bounded number of partial blocks,
does QR and Rayleigh-Ritz. The next block spans the image of the Ritz vectors and the vectors
themselves, up to ``width`` columns, which converges where eigenvalues lie close together;
passes end when the residuals certify all components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import Scratch

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Columns of a block: the first has this many more than components, later ones up to ``WIDTH``.
EXTRA, WIDTH = 16, 128
#: A component is certified if its residual is at most so much of the largest eigenvalue. Components of less than ``LEAST`` of
#: it have no variance that doubles can tell from none.
CERTIFIED, LEAST = 1e-13, 1e-11
PASSES = 500
BATCH = 2048
#: Partial sums that reach the driver at once.
GROUPS = 16


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): rows whose vector is neither null nor empty nor holds null or non-finite entries; x are longs.
    Entries beyond 2^45 raise, as n x - S would leave 64 bits."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    small = lambda c: F.when(F.abs(c) > 2.0**45, F.raise_error(F.lit("an entry is beyond 2^45")).cast("double")).otherwise(c)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), sound.alias("sound")).where("sound")
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(small(c) * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrow lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / float(n)


def _checked(x: np.ndarray, n: int, sums: np.ndarray) -> None:
    if n * float(np.abs(x).max(initial=0)) >= 2**62:
        raise OverflowError("n x - S leaves 64 bits")


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of partial blocks (part, block): those of a group are added in their order in one task, then the driver adds
    the groups'. So it gets ``GROUPS`` blocks, however many tasks there were."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(int(np.prod(shape)))
        for block in frame.sort_values("part")["block"]:
            total += np.asarray(block)
        return pd.DataFrame({"g": [int(frame["part"].iloc[0] % GROUPS)], "block": [total]})

    groups = parts.groupBy((F.col("part") % GROUPS).alias("key")).applyInPandas(add, "g int, block array<double>").collect()
    total = np.zeros(shape)
    for g in sorted(groups, key=lambda r: r["g"]):
        total += np.asarray(g["block"]).reshape(shape)
    return total


def _partials(fit_list: DataFrame, size: int, of) -> DataFrame:
    """One partial block a task: the sum of ``of(x)`` over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                total += of(_matrix(batch.slice(at, BATCH).column(0))).ravel()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "block": pa.array([total], pa.list_(pa.float64()))})

    return fit_list.select("x").mapInArrow(run, "part int, block array<double>")


@dataclass(frozen=True)
class Fit:
    """Whitening of one length of vectors: ``basis`` has a column a component, ``values`` their eigenvalues."""

    n: int
    sums: np.ndarray
    basis: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def fit(distinct: DataFrame, n: int, sums: list[int], k: int = COMPONENTS, width: int = WIDTH) -> Fit:
    """The first ``k`` components (fewer if the data have fewer dimensions with variance) of a written table of distinct vectors."""
    s = np.array(sums, dtype=np.int64)
    d = len(s)
    k = min(k, d)
    q = np.linalg.qr(np.random.default_rng(12).normal(size=(d, min(d, k + EXTRA))))[0]
    last, trace = np.inf, None
    for step in range(1, PASSES + 1):

        def image(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            _checked(x, n, s)
            y = _centred(x, n, s)
            return np.vstack([(y.T @ (y @ q)).ravel()[:, None], [[float((y * y).sum())]]])

        total = _summed(_partials(distinct, d * q.shape[1] + 1, image), (d * q.shape[1] + 1,)) / n
        w, trace = total[:-1].reshape(d, -1), float(total[-1])
        h = q.T @ w
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = q @ turn, w @ turn
        top = max(values[0], 0.0)
        residual = np.linalg.norm(moved[:, :k] - ritz[:, :k] * values[:k], axis=0).max() if top else 0.0
        # Rounding of the sums may leave residuals a little above the bound: then they no longer fall.
        if residual <= CERTIFIED * top or (residual <= 100 * CERTIFIED * top and residual > last / 2):
            break
        last = residual
        # The images are made orthogonal to the Ritz vectors first; directions that are none but rounding go.
        fresh = moved - ritz @ (ritz.T @ moved)
        fresh -= ritz @ (ritz.T @ fresh)
        u, size, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = u[:, size > 1e-15 * top][:, : max(0, min(d, width) - min(ritz.shape[1], width // 2))]
        keep = ritz[:, : min(d, width) - fresh.shape[1]]
        q = np.linalg.qr(np.hstack([keep, fresh]))[0]
    else:
        raise RuntimeError(f"residuals of {residual:.3g} after {PASSES} passes")
    alive = np.flatnonzero(values[:k] > LEAST * top) if top > 0 else np.array([], dtype=int)
    basis, values = ritz[:, alive], values[alive]
    return Fit(n, s, basis, values, trace, _identity_error(distinct, n, s, basis, values), step)


def _whiten(x: np.ndarray, n: int, sums: np.ndarray, basis: np.ndarray, values: np.ndarray) -> np.ndarray:
    return _centred(x, n, sums) @ basis / np.sqrt(values)


def _identity_error(distinct: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray, values: np.ndarray) -> float:
    """Of the whitened fit list's covariance, by two passes: the mean, then products of centred values."""
    k = len(values)
    if not k:
        return 0.0
    mean = _summed(_partials(distinct, k, lambda x: _whiten(x, n, sums, basis, values).sum(axis=0)), (k,)) / n

    def products(x: np.ndarray) -> np.ndarray:
        z = _whiten(x, n, sums, basis, values) - mean
        return z.T @ z

    covariance = _summed(_partials(distinct, k * k, products), (k, k)) / n
    return float(np.abs(covariance - np.eye(k)).max())


def apply(rows: DataFrame, model: Fit) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per row of ``rows`` and component."""
    k, explained = len(model.values), model.values / model.trace if len(model.values) else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = _matrix(part.column(1))
                exact = model.n * x - model.sums
                if float(np.abs(exact).max(initial=0)) ** 2 * x.shape[1] >= 2**63:
                    deviation = np.array([sum(int(v) ** 2 for v in row) for row in exact], dtype=np.int64)  # raises beyond 64 bits
                else:
                    deviation = (exact * exact).sum(axis=1)
                white = _whiten(x, model.n, model.sums, model.basis, model.values)
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n, dtype=np.int64)), pa.array(deviation[each]), pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), model.identity_error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Whitened vectors in long form (see ``apply``).

    Rows whose vector is null, empty or holds null or non-finite entries are left out. Of equal vectors one is in the fit
    list, and each row gets its result, also under a null or repeated vec_id. Vectors of each length are a space
    of their own, fitted and whitened apart. Components without variance (below 1e-11 of the largest) are left out, so
    equal vectors alone give no rows, as does an empty table. Other columns take no part. A deviation or sum beyond 64 bits raises.
    The vectors are written once as whole numbers to the shared folder, next to the fit list, and are read from there."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    rows = scratch.put(quantised(embeddings), "vectors")
    distinct = scratch.put(rows.select("x").distinct(), "fit-list")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    places = distinct.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "v")).groupBy("d", "i").agg(F.sum("v").alias("s")).collect()
    out = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for d, n in [(r["d"], r["n"]) for r in lengths]:
        sums = [r["s"] for r in sorted((p for p in places if p["d"] == d), key=lambda p: p["i"])]
        of_length = F.size("x") == d
        model = fit(distinct.where(of_length), n, sums, k)
        out = out.unionByName(apply(rows.where(of_length), model))
    scratch.drop(distinct)
    return out
