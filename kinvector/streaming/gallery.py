"""The online gallery and detection counts as Structured Streaming queries."""

from __future__ import annotations

import time
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from kinvector.operators import gallery as online
from kinvector.sources.shared import folder

LANDING_ROWS = 50_000
BATCH_ROWS = 500_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(spark: SparkSession, path: str):
    """Sets the times of a folder's files by their names, a second apart: a file stream reads the oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(hadoop) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    now = int(time.time() * 1000)
    for i, file in enumerate(files):
        fs.setTimes(file, now - 1000 * (len(files) - i), -1)


def stream_of(df: DataFrame, by: str | None = None, rows: int = BATCH_ROWS) -> DataFrame:
    """Rows written to a landing folder and read as a file stream.

    With ``by`` they arrive in its order, about ``rows`` rows a micro-batch:
    ranges are written at once, a file each, of at most ``LANDING_ROWS`` or so,
    and a micro-batch reads the next files that make up its rows, by a task each.
    Rows of one value are in one file.
    """
    spark, path = df.sparkSession, folder(df.sparkSession)
    if by is None:
        df.write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)
    files = max(1, rows // LANDING_ROWS)
    parts = max(1, -(-df.count() * files // rows))
    df.repartitionByRange(parts, by).sortWithinPartitions(by).write.parquet(path)
    in_order(spark, path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def begun(writer, spark: SparkSession):
    """The started query. Its state has at most two partitions for each core: every micro-batch runs a task for each, also for those without keys.

    A query keeps the number that it was first started with.
    """
    name = "spark.sql.shuffle.partitions"
    given = spark.conf.get(name)
    spark.conf.set(name, min(int(given), 2 * spark.sparkContext.defaultParallelism))
    try:
        return writer.start()
    finally:
        spark.conf.set(name, given)


def drained(stream: DataFrame, mode: str = "append", out: str | None = None) -> DataFrame:
    """Runs the stream over all available input into files below ``out`` and reads them; its checkpoint is ``out`` and -state."""
    spark, out = stream.sparkSession, out or folder(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    begun(query, spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drained_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs the stream in update mode and returns each key's last row: windows that are still open count too."""
    spark, out = stream.sparkSession, folder(stream.sparkSession)

    def keep(batch: DataFrame, number: int):
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("append").parquet(out)

    begun(stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True), spark).awaitTermination()
    others = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, _batch long").parquet(out)
    return rows.groupBy(*keys).agg(F.max(F.struct("_batch", *others)).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in others])


class GalleryState(StatefulProcessor):
    """A gallery as typed state of its key: its counters, and a map with a value for each entity.

    A micro-batch reads the entities, folds its frames in order and writes back
    the entities that changed. While a gallery has entities, a timer stands at the
    end of the frame at which they are next pruned, so they age in event time
    even where a camera sends nothing more.
    """

    def __init__(self, settings: online.Settings, frame_seconds: float | None):
        self.settings, self.frame_seconds = settings, frame_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.entities = handle.getMapState("entities", "entity_id long", online.ENTITY)
        self.counters = handle.getValueState("counters", online.COUNTERS)

    def recalled(self) -> online.Gallery:
        g = online.Gallery(self.settings)
        if self.counters.exists():
            g.recall(*self.counters.get())
        held = sorted(((i[0], online.Entity.of(*e)) for i, e in self.entities.iterator()), key=lambda x: x[1].sequence)
        g.entities = dict(held)
        return g

    def store(self, g: online.Gallery):
        for i in g.removed:
            if i not in g.entities and self.entities.containsKey((i,)):
                self.entities.removeKey((i,))
        for i in g.changed:
            self.entities.updateValue((i,), g.entities[i].row())
        self.counters.update(g.counters())
        if self.frame_seconds is not None and g.s.ticks and g.s.gaps:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if g.entities:
                ahead = g.s.tick_every - g.tick % g.s.tick_every
                self.handle.registerTimer(int((g.newest + ahead + 1) * self.frame_seconds * 1000))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in initialState.to_dict("records"):
            if row["entity_id"] is None or pd.isna(row["entity_id"]):
                values = [row[n] for n in online.names_of(online.COUNTERS)]
                self.counters.update(tuple(None if pd.isna(v) else int(v) for v in values))
            else:
                entity = [row[n] for n in online.names_of(online.ENTITY)]
                self.entities.updateValue((int(row["entity_id"]),), online.Entity.of(*[int(x) if n in WHOLE else x for n, x in zip(online.names_of(online.ENTITY), entity)]).row())

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat([p[list(online.NEEDED)] for p in rows]).sort_values(["frame_id", "camera_id", "event_id"], kind="stable")
        g, out = self.recalled(), []
        held = zip(*(pdf[n].tolist() for n in ("camera_id", "frame_id", "event_id", "embedding", "conf", "t")))
        for _, part in groupby(held, key=lambda r: r[:2]):
            one = [(c, f, e, np.asarray(v, float), w, t) for c, f, e, v, w, t in part]
            out += online.assigned_rows(int(key[0]), one, g.frame([(v, w, t, f) for _, f, _, v, w, t in one]))
        self.store(g)
        yield pd.DataFrame(out, columns=online.names_of(online.ASSIGNED))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        g = self.recalled()
        g.idle_until(int(expiredTimerInfo.getExpiryTimeInMs() // (self.frame_seconds * 1000)) - 1)
        self.store(g)
        return iter([])

    def close(self) -> None:
        pass


WHOLE = [n for n, t in (c.split() for c in online.ENTITY.split(", ")) if t in ("long", "int")]


def assign_stream(found: DataFrame, settings: online.Settings = online.Settings(), start: DataFrame | None = None, frame_seconds: float | None = None) -> DataFrame:
    """Streaming twin of ``gallery.assign``: the gallery is the state of its key.

    Rows of a micro-batch are ordered by frame; micro-batches must arrive in
    order, and their size (``stream_of``) bounds the rows held at a time. A stream
    may begin with the galleries of ``start`` (``gallery.SAVED``, or a snapshot to
    load). With ``frame_seconds``, the event time of a frame, entities also expire
    by timers as event time passes.
    """
    spark = found.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the one that keeps maps and timers
    if start is not None:
        start = (start if "buffer" in start.columns else online.loaded(start)).select(*online.names_of(online.SAVED)).groupBy("gallery_id")
    rows = found.select(*online.NEEDED)
    if frame_seconds is not None:
        rows = rows.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", "0 seconds")
    return rows.groupBy("gallery_id").transformWithStateInPandas(GalleryState(settings, frame_seconds), online.ASSIGNED, "append", "None" if frame_seconds is None else "EventTime", start)


def saved_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The galleries of a stopped stream as ``gallery.SAVED``, read from the state in its checkpoint."""
    held = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    entities = held("entities").select(F.col("key.gallery_id").alias("gallery_id"), F.col("user_map_key.entity_id").alias("entity_id"), *[F.col(f"user_map_value.{n}").alias(n) for n in online.names_of(online.ENTITY)])
    counters = held("counters").select(F.col("key.gallery_id").alias("gallery_id"), *[F.col(f"value.{n}").alias(n) for n in online.names_of(online.COUNTERS)])
    return entities.unionByName(counters, allowMissingColumns=True).select(*online.names_of(online.SAVED))


def hourly_counts(found: DataFrame) -> DataFrame:
    """Detections per camera and hour of event time, with a watermark of two hours (an addition)."""
    rows = found.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", "2 hours")
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "camera_id").agg(F.count("*").alias("detections")).select(F.unix_seconds("w.start").alias("hour_start"), "camera_id", "detections")
