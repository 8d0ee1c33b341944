"""Winners kept as a table: after a batch only the keys it touches are elected anew.

Three Parquet tables lie side by side: ``members`` (the rows that may be shown) and ``winners`` (one a key) are partitioned by a
hash of the key, ``places`` (id, key) by a hash of the id, so that a batch finds the old keys of its ids without
reading all members. A batch rewrites the partitions of its old and new keys by dynamic partition overwrite, each from
a staged copy, so a batch that failed half-way can be applied again with the same outcome.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.session import Scratch, remove_path


@dataclass(frozen=True)
class KeptWinners:
    """``order`` says which row of a key wins, the first; ``parts`` bounds what the driver learns of a batch."""

    path: str
    key: str = "dkey"
    id: str = "id"
    order: tuple[str, ...] = ("created_at DESC NULLS LAST", "id DESC")
    parts: int = 64

    def _part(self, of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.parts)).cast("int")

    def _table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def members(self, spark: SparkSession) -> DataFrame:
        """All rows that may be shown."""
        return self._table(spark, "members").drop("part")

    def winners(self, spark: SparkSession) -> DataFrame:
        """The first row of each key."""
        return self._table(spark, "winners").drop("part")

    def _elected(self, members: DataFrame) -> DataFrame:
        w = Window.partitionBy(self.key).orderBy(*[_ordered(o) for o in self.order])
        return members.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")

    def create(self, rows: DataFrame) -> None:
        """Writes the tables anew from the rows that may be shown; ids are unique."""
        spark = rows.sparkSession
        members = rows.withColumn("part", self._part(self.key))
        members.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/members")
        members = self._table(spark, "members")
        self._elected(members).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/winners")
        places = members.select(self.id, self.key).withColumn("part", self._part(self.id))
        places.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/places")

    def _replace(self, name: str, rows: DataFrame, touched: Sequence[int], scratch: Scratch) -> None:
        """The partitions ``touched`` of a table become ``rows``; those without any row go."""
        spark = rows.sparkSession
        staged = scratch.put(rows.repartition("part"), name)
        left = {r["part"] for r in staged.select("part").distinct().collect()}
        staged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")
        for part in set(touched) - left:
            remove_path(spark, f"{self.path}/{name}/part={part}")

    def apply(self, batch: DataFrame, order: str | None = None) -> dict[str, int]:
        """Rows of ``batch`` replace those of their id; rows whose column ``gone`` is true (closed, hidden, deleted) are taken
        out. Of rows of one id the last by ``order`` counts (without it ids are unique). Rows that are as stored touch
        nothing. Returns how many rows, keys and partitions were touched; an empty batch touches none."""
        spark = batch.sparkSession
        scratch = Scratch(spark)
        try:
            return self._applied(spark, batch, order, scratch)
        finally:
            scratch.clear()

    def _applied(self, spark: SparkSession, batch: DataFrame, order: str | None, scratch: Scratch) -> dict[str, int]:
        columns = [c for c in self.members(spark).columns]
        if order:
            w = Window.partitionBy(self.id).orderBy(F.desc_nulls_last(order))
            batch = batch.withColumn("rn", F.row_number().over(w)).where("rn = 1")
        new = scratch.put(batch.select(*columns, F.coalesce("gone", F.lit(False)).alias("gone")).withColumn("idpart", self._part(self.id)), "batch")
        # Lists of partitions: at most ``parts`` numbers each.
        idparts = [r["idpart"] for r in new.select("idpart").distinct().collect()]
        known = self._table(spark, "places").where(F.col("part").isin(idparts)).select(self.id, F.col(self.key).alias("old_key"))
        met = scratch.put(new.join(known, self.id, "left"), "met")
        old_parts = met.where("old_key IS NOT NULL").select(self._part("old_key").alias("p")).distinct()
        stored = self._table(spark, "members").where(F.col("part").isin([r["p"] for r in old_parts.collect()]))
        print_of = lambda df: df.select(self.id, F.sha1(F.to_json(F.struct(*columns))).alias("print"))
        same = print_of(new.where("NOT gone")).join(print_of(stored.join(new.select(self.id), self.id, "left_semi")), [self.id, "print"]).select(self.id)
        met = met.join(same, self.id, "left_anti").where("old_key IS NOT NULL OR NOT gone")
        met = scratch.put(met, "changed")
        keys = met.where("old_key IS NOT NULL").select(F.col("old_key").alias(self.key)).union(met.where("NOT gone").select(self.key)).distinct()
        keys = scratch.put(keys.withColumn("part", self._part(self.key)), "keys")
        touched = [r["part"] for r in keys.select("part").distinct().collect()]
        if not touched:
            return {"rows": 0, "keys": 0, "parts": 0}
        mine = F.col("part").isin(touched)
        fresh = met.where("NOT gone").select(*columns).withColumn("part", self._part(self.key))
        members = self._table(spark, "members").where(mine).join(met.select(self.id), self.id, "left_anti").select(*columns, "part").unionByName(fresh)
        members = scratch.put(members, "members")
        elected = self._elected(members.join(keys.select(self.key), self.key, "left_semi").select(*columns, "part"))
        kept = self._table(spark, "winners").where(mine).join(keys.select(self.key), self.key, "left_anti").select(*columns, "part")
        idparts = [r["p"] for r in met.select(F.col("idpart").alias("p")).distinct().collect()]
        places = self._table(spark, "places").where(F.col("part").isin(idparts)).join(met.select(self.id), self.id, "left_anti").select(self.id, self.key, "part")
        places = places.unionByName(met.where("NOT gone").select(self.id, self.key, F.col("idpart").alias("part")))
        winners = scratch.put(kept.unionByName(elected), "elected")
        places = scratch.put(places, "placed")
        # In this order a batch that is lost half-way is found unapplied by what comes later, and done again.
        self._replace("winners", winners, touched, scratch)
        self._replace("members", members, touched, scratch)
        self._replace("places", places, idparts, scratch)
        return {"rows": met.count(), "keys": keys.count(), "parts": len(touched)}

    def sink(self, order: str):
        """A foreachBatch function: each micro-batch is applied, a replayed one without effect."""
        return lambda batch, number: self.apply(batch, order)


def _ordered(text: str) -> Column:
    name, direction, *nulls = text.split()
    if direction == "DESC":
        return F.desc_nulls_last(name) if nulls != ["NULLS", "FIRST"] else F.desc_nulls_first(name)
    return F.asc_nulls_last(name) if nulls == ["NULLS", "LAST"] else F.asc_nulls_first(name)
