"""Replay buffer: added rows and reservations as two Parquet tables, joined on reading.

Rows are partitioned by the batch that added them, reservations by their name; a step replaces its own partition (dynamic
overwrite), so a step that is repeated after a failure leaves the same rows, and no other row is ever written again. What
is free, reserved, taken or too old follows from the two tables when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from ..sources.writers import replace_partitions

_RESERVED = "edge_id bigint, state string, batch bigint, name string"


class ReplayTable:
    """Rows: edge_id, question_id, iteration, advantage and a status, 'free' or the name of a reservation.

    A row leaves `max_age` iterations after its own unless it is reserved; a reservation that is rolled back keeps its rows
    until the next batch is added.
    """

    def __init__(self, spark: SparkSession, max_age: int, schema: str, root: str | None = None):
        self.spark, self.max_age, self.schema = spark, max_age, schema
        self.root = root or scratch_path(spark, "replay")
        for name, kind, part in (("rows", f"{schema}, batch bigint", "batch"), ("reservations", _RESERVED, "name")):
            spark.createDataFrame([], kind).write.mode("append").partitionBy(part).parquet(f"{self.root}/{name}")  # the folders

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch bigint").parquet(f"{self.root}/rows")

    def _reservations(self) -> DataFrame:
        return self.spark.read.schema(_RESERVED).parquet(f"{self.root}/reservations")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows with their status, without those that were taken or are too old; `batch` is the batch that added them."""
        held = self._reservations().groupBy("edge_id").agg(
            F.max(F.when(F.col("state") == "reserved", F.col("name"))).alias("held"),
            F.count_if(F.col("state") == "taken").alias("taken"),
            F.max(F.when(F.col("state") == "released", F.col("batch"))).alias("released"),
        )
        last = rows.agg(F.struct(F.max("iteration").alias("now"), F.max("batch").alias("batch")).alias("v")).scalar()
        out = rows.join(held, "edge_id", "left").withColumn("last", last)
        young = F.col("last.now") - F.col("iteration") < self.max_age
        kept = F.col("held").isNotNull() | young | F.coalesce(F.col("released") == F.col("last.batch"), F.lit(False))
        out = out.where((F.coalesce("taken", F.lit(0)) == 0) & F.coalesce(kept, F.lit(True)))
        return out.withColumn("status", F.coalesce("held", F.lit("free"))).drop("held", "taken", "released", "last")

    def read(self) -> DataFrame:
        return self._live(self._rows()).drop("batch")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Transactional add: a duplicate id inside the batch or against the buffer fails the whole batch. A batch id that
        comes again replaces its own rows."""
        if not batch.groupBy("edge_id").count().where("count > 1").isEmpty():
            raise ValueError("duplicate edge ids within the batch")
        others = self._live(self._rows().where(F.col("batch") != batch_id))
        if not batch.select("edge_id").join(others.select("edge_id"), "edge_id", "left_semi").isEmpty():
            raise ValueError("edge ids already in the buffer")
        replace_partitions(batch.withColumn("batch", F.lit(batch_id).cast("bigint")), f"{self.root}/rows", ["batch"])

    def late(self, batch_id: int) -> int | None:
        """Rows of a batch that were too old when it was added; null for an unknown batch."""
        upto = self._rows().where(F.col("batch") <= batch_id)
        own = F.col("batch") == batch_id
        one = upto.withColumn("now", upto.agg(F.max("iteration").alias("v")).scalar()).agg(
            F.count_if(own).alias("rows"), F.count_if(own & (F.col("now") - F.col("iteration") >= self.max_age)).alias("late")
        )
        row = one.first()
        return row.late if row.rows else None

    def _set(self, rows: DataFrame, name: str, state: str) -> None:
        marked = rows.select("edge_id", F.lit(state).alias("state"), F.lit(self._rows().agg(F.max("batch")).first()[0]).cast("bigint").alias("batch"), F.lit(name).alias("name"))
        replace_partitions(materialise(marked, "reservation"), f"{self.root}/reservations", ["name"])

    def reserve(self, name: str, cap: int, target: int, seed: int = 0) -> DataFrame:
        """Sample free rows and mark them; reserved rows neither expire nor get sampled again. A name that is reserved already
        is returned as it is."""
        from ..operators.replay import sample_edges

        if self._named(name).isEmpty():
            rows = self.read()
            now = rows.agg(F.max("iteration")).first()[0]
            self._set(sample_edges(rows.where("status = 'free'").drop("status"), now, self.max_age, cap, target, seed), name, "reserved")
        return self.read().where(F.col("status") == name)

    def _named(self, name: str) -> DataFrame:
        return self._reservations().where((F.col("name") == name) & (F.col("state") == "reserved"))

    def commit(self, name: str) -> None:
        """The rows of a reservation are taken for good."""
        self._set(self._named(name), name, "taken")

    def rollback(self, name: str) -> None:
        self._set(self._named(name), name, "released")
