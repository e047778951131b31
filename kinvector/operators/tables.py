"""Paging, overlays, folds and merges of the service's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinvector.operators import scan

SORTABLE = {"created_at": "created", "status": "status", "progress": "progress", "job_id": "job_id"}
TERMINAL = ("completed", "failed", "cancelled")


def page(jobs: DataFrame, sort_by: str = "created_at", direction: str = "desc", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of jobs; an unknown column sorts by created_at, an unknown direction descends; ties by job_id."""
    column = SORTABLE.get(sort_by, "created")
    order = F.asc_nulls_last(column) if direction == "asc" else F.desc_nulls_first(column)
    return jobs.orderBy(order, "job_id").offset(offset).limit(limit)


def overlaid(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """Jobs with the live values of keys job:<id> where there are any; live values are strings."""
    live = live.where(F.col("key").startswith("job:")).select(F.split("key", ":")[1].alias("job_id"), F.col("status").alias("_s"), F.col("progress").cast("double").alias("_p"))
    return jobs.join(live, "job_id", "left").withColumn("status", F.coalesce("_s", "status")).withColumn("progress", F.coalesce("_p", "progress")).drop("_s", "_p")


def folded(log: DataFrame) -> DataFrame:
    """Final state of each job from its status log: the first terminal status stays, the first start counts."""
    ended = F.min(F.when(F.col("status").isin(*TERMINAL), F.struct("seq", "status", "at")))
    running = F.min(F.when(F.col("status") == "running", F.struct("seq", "at")))
    rows = log.groupBy("job_id").agg(ended.alias("e"), F.max(F.struct("seq", "status")).alias("l"), running.alias("r"))
    started = F.when(F.col("e").isNull() | (F.col("r.seq") < F.col("e.seq")), F.col("r.at"))
    return rows.select("job_id", F.coalesce("e.status", "l.status").alias("status"), started.alias("started_at"), F.col("e.at").alias("completed_at"))


def deleted(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Summary of a bulk delete: requested, deleted_count, errors (ids not found) and what is left."""
    hit = wanted.join(jobs.select("job_id", F.lit(1).alias("hit")), "job_id", "left").agg(F.count("*").alias("requested"), F.count("hit").alias("deleted_count"))
    left = jobs.join(wanted, "job_id", "left_anti").agg(F.count("*").alias("left_over"))
    return hit.join(F.broadcast(left)).select("requested", "deleted_count", (F.col("requested") - F.col("deleted_count")).alias("errors"), "left_over")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by unique name: known names keep created_at, all take the new config and time."""
    new = new.select("name", F.col("config").alias("_c"), F.col("at").alias("_a"))
    rows = old.join(new, "name", "full_outer")
    return rows.select("name", F.coalesce("_c", "config").alias("config"), F.coalesce("created_at", "_a").alias("created_at"), F.coalesce("_a", "updated_at").alias("updated_at"))


def inserted(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """``jobs`` and the new ones (job_id, config, created): pending, without progress."""
    rows = new.select("job_id", F.lit("pending").alias("status"), "config", "created", F.lit(0.0).alias("progress"))
    return jobs.select("job_id", "status", "config", "created", "progress").unionByName(rows)


def numbered(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` and ``new`` rows (those of one insert), the new ones numbered on from the largest key in their order."""
    last = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    rows = scan.numbered(new, [order], name="_place").join(F.broadcast(last))  # one row
    return old.unionByName(rows.withColumn(key, (F.col("_last") + F.col("_place") + 1).cast(dict(old.dtypes)[key])).select(*old.columns))


#: Columns of the service's tables.
JOBS = "job_id string not null, status string, config string, input_video string, output_video string, created_at timestamp, started_at timestamp, completed_at timestamp, progress double, stats string, error_message string"
CONFIGS = "config_id bigint, name string not null, config string, created_at timestamp, updated_at timestamp"


def ensured(spark: SparkSession, name: str, columns: str, location: str | None = None) -> DataFrame:
    """The table of that name, which is created without rows where there is none; one that is there stays as it is."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet" + (f" LOCATION '{location}'" if location else ""))
    return spark.table(name)


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    """Point look-up; the predicate reaches the scan. No row means that it was not found."""
    return rows.where(F.col(key) == F.lit(value))


def changed(configs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(configurations after the requests, one answer for each request).

    Requests are (config_id, action, name, config, at), one for each id: an
    update sets name, config and updated_at, a delete takes the row. An unknown
    id changes nothing and answers 404.
    """
    asked = requests.select("config_id", F.col("action").alias("_do"), F.col("name").alias("_n"), F.col("config").alias("_c"), F.col("at").alias("_a"))
    after = configs.join(asked, "config_id", "left").where("_do is null or _do <> 'delete'")
    after = after.select("config_id", F.coalesce("_n", "name").alias("name"), F.coalesce("_c", "config").alias("config"), "created_at", F.coalesce("_a", "updated_at").alias("updated_at"))
    hit = requests.join(configs.select("config_id", F.lit(True).alias("_hit")), "config_id", "left")
    return after, hit.select("config_id", "action", F.when(F.col("_hit"), 200).otherwise(404).alias("status"))


def newest_first(configs: DataFrame) -> DataFrame:
    """Configurations by updated_at, newest first; ties by id."""
    return configs.orderBy(F.desc("updated_at"), "config_id")


def live_writes(updates: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, field, value) of the live hash ``job:<id>``: lists, maps and structs as JSON, all else as text; nulls as 'None'."""
    nested = ("array", "map", "struct")
    text = {c: F.to_json(c) if t.startswith(nested) else F.col(c).cast("string") for c, t in updates.dtypes if c != key}
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(v, F.lit("None")).alias("value")) for c, v in text.items()])
    return updates.select(F.concat(F.lit("job:"), F.col(key)).alias("key"), F.explode(fields).alias("f")).select("key", "f.*")


#: Media types of downloads by suffix.
MEDIA = {"mp4": "video/mp4", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "mov": "video/quicktime", "webm": "video/webm"}


def downloads(jobs: DataFrame) -> DataFrame:
    """(job_id, output_video, filename, media_type) of jobs with an output; unknown suffixes are mp4."""
    suffix = F.lower(F.regexp_extract("output_video", r"\.(\w+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return jobs.where("output_video is not null").select("job_id", "output_video", F.regexp_extract("output_video", r"([^/]+)$", 1).alias("filename"), F.coalesce(F.element_at(kinds, suffix), F.lit(MEDIA["mp4"])).alias("media_type"))


def models(files: DataFrame) -> DataFrame:
    """Model files (filename, size) by kind and name, once each: (kind, filename, type, path, size), the largest size of a name.

    Detectors are named yolo or YOLO with .pt or .engine; embedders after one of
    their families with .pth, .pt, .engine or .onnx, unless yolo is in the name.
    """
    detector = F.col("filename").rlike(r"(?:yolo|YOLO)[^/]*\.(?:pt|engine)$")
    embedder = F.col("filename").rlike(r"(?:reid|ReID|resnet|lttc|LTTC)[^/]*\.(?:pth|pt|engine|onnx)$") & ~F.lower("filename").contains("yolo")
    kind = F.when(detector, "detector").when(embedder, "embedder")
    rows = files.select("filename", "size", kind.alias("kind")).where("kind is not null").groupBy("kind", "filename").agg(F.max("size").alias("size"))
    return rows.select("kind", "filename", F.regexp_extract("filename", r"\.(\w+)$", 1).alias("type"), F.concat(F.lit("/models/"), "filename").alias("path"), "size").orderBy("kind", "filename")
