"""File listings: uploads, models, images, and the queue's landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTOR, EMBEDDER = ("*.engine", "*.pt", "*.onnx"), ("*.pth", "*.engine")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, filename, bytes, modified) of files by glob; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("_metadata.file_name").alias("filename"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def model_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Model files of a kind, once for each name, by name; embedders leave out names with yolo in them."""
    patterns = DETECTOR if kind == "detector" else EMBEDDER
    rows = listing(spark, folder, "{" + ",".join(patterns) + "}")
    if kind != "detector":
        rows = rows.where(~F.lower("filename").contains("yolo"))
    return rows.groupBy("filename").agg(F.min("path").alias("path"), F.max("bytes").alias("bytes")).orderBy("filename")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Stored uploads, named by an id and a suffix: file_id, suffix, path, megabytes."""
    rows = listing(spark, folder)
    return rows.select(F.regexp_extract("filename", r"^([^.]+)", 1).alias("file_id"), F.regexp_extract("filename", r"(\.\w+)$", 1).alias("suffix"), "path", F.round(F.col("bytes") / 1048576, 1).alias("megabytes"))


def images(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """The first n images: .jpg by name, then .png by name."""
    rows = listing(spark, folder, "*.{jpg,png}")
    return rows.orderBy(F.lower("filename").endswith(".png"), "filename").limit(n)


def messages(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines of a landing folder as a stream, oldest file first."""
    return spark.readStream.schema(schema).option("latestFirst", "false").json(folder)
