"""Shared helpers: tables, lineage cuts, shared files and connected components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 2000
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is unset and Spark runs on one machine, as in tests,
    a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(shared_dir, "fallback", None) or tempfile.mkdtemp(prefix="kinvector-")
        shared_dir.fallback = base
    return f"{base.rstrip('/')}/kinvector/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: ends lineage, survives lost executors.

    While it writes, Arrow batches have ``BATCH_ROWS`` rows and ``BATCH_BYTES`` at
    most (one row at least), which bounds the texts that a task holds on both
    sides of its Python worker.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def bound(value, body):
    """``body`` of a column's value, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def set_aside(docs: DataFrame, own: tuple[str, ...], step, adds: tuple[str, ...] = ()) -> DataFrame:
    """``step`` of ``docs`` with the columns of ``docs`` and those that it ``adds``.

    Others than ``own`` travel in one struct, so that no name of theirs clashes
    and a dot in one does no harm.
    """
    extra = [c for c in docs.columns if c not in own]
    if not extra:
        return step(docs).select(*docs.columns, *adds)
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    packed = docs.select(*[c for c in docs.columns if c in own], F.struct(*map(quoted, extra)).alias("set_aside"))
    return step(packed).select(*[F.col("set_aside").getField(c).alias(c) if c in extra else F.col(c) for c in docs.columns], *adds)


def below(value, edges: list[int]):
    """How many of the ascending edges are below the value, by binary search in an array literal."""
    steps = max(1, len(edges).bit_length())

    def search(es):
        def step(s, _):
            middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
            right = (s["low"] < s["high"]) & (F.get(es, middle) < value)
            return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when((s["low"] < s["high"]) & ~right, middle).otherwise(s["high"]).alias("high"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("low"), F.lit(len(edges)).alias("high")), step, lambda s: s["low"])

    if not edges:
        return F.lit(0)
    return bound(F.split(F.lit(",".join(map(str, edges))), ",").cast("array<long>"), search)


def open_shared(uri: str):
    """(pyarrow file system, path) of a shared folder, for tasks that read or write files."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        uri = uri.replace("s3a://", "s3://").replace("s3n://", "s3://")  # Hadoop's names of the scheme
        return fs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))
    return fs.LocalFileSystem(), uri


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (id, component), component the smallest id.

    Alternating large-star and small-star steps; every step is one shuffle by
    node, so no component meets in one task, and a chain of n nodes takes about
    log n steps. Nulls and loops are left out; no edges give no rows.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stamp = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == stamp:
            break
        stamp = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(items, size, limit: int):
    """Lists of neighbouring items whose sizes add up to about limit; one item at least."""
    out, total = [], 0
    for x in items:
        n = size(x)
        if out and total + n > limit:
            yield out
            out, total = [], 0
        out.append(x)
        total += n
    if out:
        yield out


def worker_state() -> dict:
    """What this Python worker keeps from task to task."""
    return sys.modules.setdefault("kinvector_worker", types.ModuleType("kinvector_worker")).__dict__


def release():
    """Let go of what earlier operators left in this worker, and give freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    held = [k for k in worker_state() if not isinstance(k, str)]
    for name in held:
        del worker_state()[name]
    pa.default_memory_pool().release_unused()
    if held:
        gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def sliced(batches, rows: int = 1000, keep: bool = False):
    """Arrow batches in slices, so that few texts are Python strings at a time.

    Unless told to keep it, what earlier operators left in this worker is let go.
    """
    if not keep:
        release()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    if not keep:
        release()
