"""A live table that a stream upserts, and that repeated batches leave unchanged.

Each micro-batch keeps the last row of every key in a folder of its own number,
which it overwrites, so a batch that is run again replaces what it wrote. Readers
take the row of the highest number of each key. ``compact`` folds the batches up
to a number into a base; batches up to there are read no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINAL = "_batch"


class Live:
    """A table of ``columns`` (DDL) below ``root`` with one row for each ``key``; the last is that of the highest ``order``."""

    def __init__(self, spark: SparkSession, root: str, columns: str, key: str, order: str):
        self.spark, self.root, self.columns, self.key, self.order = spark, root, columns, key, order
        none = spark.createDataFrame([], columns)
        none.withColumn(FINAL, F.lit(-1).cast("long")).write.mode("ignore").parquet(f"{root}/base/upto=-1")
        none.write.mode("ignore").parquet(f"{root}/batches/number=-1")

    def upsert(self, batch: DataFrame, number: int):
        """Takes a micro-batch; for ``foreachBatch``."""
        others = [c for c in batch.columns if c != self.key]
        last = batch.groupBy(self.key).agg(F.max_by(F.struct(*others), self.order).alias("m")).select(self.key, "m.*")
        last.select(*batch.columns).write.mode("overwrite").parquet(f"{self.root}/batches/number={number}")

    def upto(self) -> int:
        """The number of the last batch in the base."""
        bases = self.spark.read.schema(f"{self.columns}, {FINAL} long, upto long").parquet(f"{self.root}/base")
        folders = bases.select(F.regexp_extract(F.col("_metadata.file_path"), r"upto=(-?\d+)", 1).cast("long").alias("n"))
        return folders.agg(F.coalesce(F.max("n"), F.lit(-1))).first()[0]

    def read(self) -> DataFrame:
        """The rows as they are now."""
        upto = self.upto()
        base = self.spark.read.schema(f"{self.columns}, {FINAL} long").parquet(f"{self.root}/base/upto={upto}")
        more = self.spark.read.schema(f"{self.columns}, number long").parquet(f"{self.root}/batches").where(F.col("number") > upto).withColumnRenamed("number", FINAL)
        names = [c for c in base.columns if c != FINAL]
        others = [c for c in names if c != self.key]
        rows = base.unionByName(more).groupBy(self.key).agg(F.max_by(F.struct(*others), FINAL).alias("m"))
        return rows.select(self.key, "m.*").select(*names)

    def compact(self, number: int):
        """Folds all batches up to ``number``, which are complete, into a new base."""
        upto = self.upto()
        if number <= upto:
            return
        base = self.spark.read.schema(f"{self.columns}, {FINAL} long").parquet(f"{self.root}/base/upto={upto}")
        more = self.spark.read.schema(f"{self.columns}, number long").parquet(f"{self.root}/batches").where(F.col("number").between(upto + 1, number)).withColumnRenamed("number", FINAL)
        others = [c for c in base.columns if c != self.key]
        rows = base.unionByName(more.select(*base.columns)).groupBy(self.key).agg(F.max_by(F.struct(*others), FINAL).alias("m")).select(self.key, "m.*")
        rows.select(*base.columns).write.parquet(f"{self.root}/base/upto={number}")

    def follow(self, stream: DataFrame, checkpoint: str):
        """Upserts all that the stream has."""
        stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
