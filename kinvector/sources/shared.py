"""Folders that the driver and all executors share, and lineage cuts through them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where the setting is unset and Spark runs on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(folder, "fallback", None) or tempfile.mkdtemp(prefix="kinvector-")
        folder.fallback = base
    return f"{base.rstrip('/')}/kinvector/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written to a shared folder and read again: their lineage ends there, lost executors don't matter."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_shared(uri: str):
    """(pyarrow file system, path) of a shared folder, for tasks that read its files."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        uri = uri.replace("s3a://", "s3://").replace("s3n://", "s3://")  # Hadoop's names of the scheme
        return fs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))
    return fs.LocalFileSystem(), uri
