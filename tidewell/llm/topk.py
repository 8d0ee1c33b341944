"""Exact top-k search by inner product with the threshold algorithm.

Vectors of whole numbers are cut into shards; a shard holds, for every dimension, its
vectors sorted by that component. For a query the lists are walked side by side from the end
that its component's sign favours, each vector that turns up is scored in full, and the
walk stops when no vector further down can beat the kth score: the bound is the sum of
the query's components times the values that the walk has reached. It also ends once the
lists have shown every vector, which on dense vectors is often first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_QUERIES = 2048


class SortedLists:
    """A shard's vectors, distinct, with one sorted list for each dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.exact, self.ids = vectors[order].astype(np.int64), ids[order]
        self.vectors = self.exact.astype(np.float64)
        self.most = float(np.abs(self.vectors).max(initial=0.0))
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors.T, self.lists, axis=1)

    def search(self, query: np.ndarray, k: int, first_step: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and scores of the k best (ties to smaller ids), and the depth walked.

        Where a product may leave 2^53, below which doubles are exact, it is taken in 64-bit
        whole numbers; beyond those it raises. The step doubles, so a walk
        that has to go to the bottom takes few rounds.
        """
        n, dims = self.vectors.shape
        size = float(np.abs(query.astype(np.float64)).sum()) * self.most
        large = size >= 2.0**53
        own, query = query, query.astype(np.float64)
        up = query > 0
        lists, values = self.lists, self.values
        seen = np.zeros(n, dtype=bool)
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        live = np.flatnonzero(query)
        depth, step = 0, first_step
        while depth < n:
            end = min(n, depth + step)
            down = lists[live[~up[live]], depth:end].ravel()
            ups = lists[live[up[live]], n - end : n - depth].ravel()
            met = seen.copy() if len(live) else ~seen
            met[down] = True
            met[ups] = True
            fresh = np.flatnonzero(met & ~seen)
            seen = met
            best = np.concatenate([best, fresh])
            if large:
                rough = self.vectors[fresh] @ query
                if np.abs(rough).max(initial=0.0) >= 2.0**63 * (1 - 1e-9):
                    raise OverflowError("a score leaves 64 bits")
                scores = np.concatenate([scores.astype(np.int64), self.exact[fresh] @ own.astype(np.int64)])
            else:
                scores = np.concatenate([scores, np.einsum("ij,j->i", self.vectors[fresh], query)])
            if len(scores) > k:  # the kth score and all that tie with it
                some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                best, scores = best[some], scores[some]
            keep = np.lexsort((best, -scores))[:k]  # positions rise with ids
            best, scores = best[keep], scores[keep]
            depth, step = end, step * 2
            if not len(live) or depth >= n or seen.all():
                break
            at = np.where(up, n - depth, depth - 1)
            bound = float((query * values[np.arange(dims), at]).sum())
            bound += 1e-12 * size if large else 0.0  # more than rounding may have taken off
            if len(scores) == k and bound < scores[-1]:
                break
        return best, scores, depth


def quantised(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", factor: int = 256) -> DataFrame:
    """(vec_id, v): whole components floor(factor * x). Rows whose vector is null, empty or
    holds a null, an infinity or NaN are left out, as are null ids. A component beyond 64 bits raises.
    Other columns take no part, whatever their names."""
    x = F.col("v")
    out = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    out = out.where(x.isNotNull() & (F.size(x) > 0) & ~bad & F.col("vec_id").isNotNull())
    far = lambda c: F.when(F.abs(c) * factor >= 2.0**63, F.raise_error(F.lit("a component leaves 64 bits")).cast("double")).otherwise(c)
    return out.select("vec_id", F.transform(x, lambda c: F.floor(far(c) * factor).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to smaller ids.

    Both sides are (vec_id, v) with whole numbers; a query's own id is no candidate, nor is
    a vector of another length. Fewer than k candidates are all returned; repeated
    ids count as different rows of the one id; an empty side gives no rows. Scores are exact in 64 bits; one beyond raises.

    Equal vectors are first brought together, with their k + 1 smallest ids (found
    before the shuffle as well), so copies cost one row however many there are. Blocks of
    queries meet shards of vectors; every task gets one block and one shard, of bounded
    size, and gives k + 1 classes for each of its queries. No side is broadcast.
    """
    same = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    n_vectors, n_queries = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n_vectors // shard_rows)), max(1, -(-n_queries // block))

    def dealt(key: str, own: int, others: int, mine: str, theirs: str, rows: DataFrame) -> DataFrame:
        here = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(own)).cast("int").alias(mine)
        return rows.select("*", here, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(theirs))

    left = dealt("vec_id", blocks, shards, "b", "s", queries.select("vec_id", "v"))
    right = dealt("v", shards, blocks, "s", "b", classes)

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        widths = q["v"].map(len)
        for width in widths.unique():
            asked, some = q[widths == width], c[c["v"].map(len) == width]
            if not len(some):
                continue
            ids = some["ids"].tolist()
            lists = SortedLists(np.stack(some["v"].tolist()), np.array([i[0] for i in ids]))
            place = {i[0]: i for i in ids}
            for query, v in zip(asked["vec_id"].tolist(), asked["v"].tolist(), strict=True):
                at, scores, _ = lists.search(np.asarray(v, dtype=np.int64), k + 1)
                for p, s in zip(at.tolist(), scores.tolist(), strict=True):
                    found += [(query, i, int(s)) for i in place[int(lists.ids[p])] if i != query]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
