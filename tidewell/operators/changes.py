"""Upserts, snapshot syncs and change detection by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key in a batch."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return batch.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], values: Sequence[str], never_back: Sequence[str] = ()) -> DataFrame:
    """Full outer merge: values of the batch win where they aren't null, columns in
    ``never_back`` keep the greater one; ``change`` says inserted, updated, same or kept."""
    old, new = current.withColumn("is_there", F.lit(True)).alias("o"), batch.withColumn("is_there", F.lit(True)).alias("n")
    joined = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    has_old, has_new = F.col("o.is_there").isNotNull(), F.col("n.is_there").isNotNull()
    differs = F.lit(False)
    for v in values:
        differs = differs | (F.col(f"n.{v}").isNotNull() & ~F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}")))
    change = F.when(~has_old, "inserted").when(~has_new, "kept").when(differs, "updated").otherwise("same")
    return joined.select(
        *[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys],
        *[
            (F.greatest(f"n.{v}", f"o.{v}") if v in never_back else F.coalesce(f"n.{v}", f"o.{v}")).alias(v) for v in values
        ],
        change.alias("change"),
    )


def closed_keys(current: DataFrame, snapshot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key a full snapshot no longer has."""
    return current.join(snapshot.select(*keys), list(keys), "left_anti")


def changed_rows(current: DataFrame, batch: DataFrame, keys: Sequence[str], ignored: Sequence[str] = ()) -> DataFrame:
    """Rows of the batch whose fingerprint differs from the stored one, or is new."""
    kept = sorted(c for c in batch.columns if c not in ignored)

    def print_of(df: DataFrame) -> DataFrame:
        return df.withColumn("fp", F.sha1(F.to_json(F.struct(*kept))))

    return print_of(batch).join(print_of(current).select(*keys, "fp"), [*keys, "fp"], "left_anti").drop("fp")
