"""Queries of model calls, live tables and completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinvector.operators import tables as ops
from kinvector.plans.retrieval import BOXES, DETECTIONS
from kinvector.plans.service import JOBS
from kinvector.sources import batches, tables
from kinvector.sources.shared import folder
from kinvector.streaming import completion, live
from kinvector.streaming import gallery as streaming

CALL_ROWS, CAMERAS = 4, 4


def lengths(calls):
    """Stands in for a model: the length of every vector, with the place in the call and its size."""
    import numpy as np
    import pyarrow as pa

    from kinvector.operators.retrieval import matrix

    for batch in calls:
        n = batch.num_rows
        v = matrix(batch.column("embedding"))
        yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(range(n), pa.int64()), pa.array([n] * n, pa.int64()), pa.array(np.round(np.linalg.norm(v, axis=1), 6))], names=["event_id", "place", "call_rows", "length"])


def embedded_in_calls(spark, sf_dir):
    """The detections of each frame through a model that takes four at a time."""
    found = tables.detections(spark, sf_dir)
    return batches.embedded(found, "event_id long, place long, call_rows long, length double", lengths, CALL_ROWS, ["camera_id", "frame_id"], ["event_id"])[0]


EMBEDDED_IN_CALLS = f"""with {DETECTIONS}, k as (select event_id, embedding, row_number() over w - 1 as i, count(*) over (partition by camera_id, frame_id) as n from det window w as (partition by camera_id, frame_id order by event_id))
select event_id, i % 4 as place, least(4, n - i // 4 * 4) as call_rows, round(sqrt(list_inner_product(embedding, embedding)), 6) as length from k"""

STATUSES = (("signup", "pending"), ("view", "running"), ("click", "running"), ("error", "failed"), ("purchase", "completed"))


def live_overlay(spark, sf_dir):
    """Jobs under the last status and progress that a stream of events has brought for them, in batches that may be repeated."""
    status = F.create_map(*[F.lit(x) for pair in STATUSES for x in pair])
    news = tables.table(spark, sf_dir, "events").select(F.concat(F.lit("job:"), F.col("user_id").cast("string")).alias("key"), F.element_at(status, F.col("event_type")).alias("status"), (F.col("event_id") % 101).cast("string").alias("progress"), F.col("event_id").alias("seq"))
    at = folder(spark)
    held = live.Live(spark, at, "key string, status string, progress string, seq long", "key", "seq")
    held.follow(streaming.stream_of(news, "seq", max(1000, news.count() // 3)), f"{at}-state")
    held.compact(0)
    return ops.overlaid(tables.jobs(spark, sf_dir), held.read()).select("job_id", "status", "progress")


LIVE_OVERLAY = f"""with {JOBS}, l as (
  select cast(user_id as varchar) as job_id, arg_max(case event_type when 'signup' then 'pending' when 'error' then 'failed' when 'purchase' then 'completed' else 'running' end, event_id) as status, cast(max(event_id) % 101 as double) as progress from events group by user_id)
select jobs.job_id, coalesce(l.status, jobs.status) as status, coalesce(l.progress, jobs.progress) as progress from jobs left join l on l.job_id = jobs.job_id"""


def streams_finished(spark, sf_dir):
    """Days on which every camera has sent all its frames; end markers come before the frames that they count."""
    frames = tables.boxes(tables.table(spark, sf_dir, "events")).select(F.floor(F.col("frame_id") / 24).alias("job_id"), F.col("camera_id").alias("stream_id"), "frame_id").distinct()
    ends = frames.groupBy("job_id", "stream_id").agg(F.min("frame_id").alias("frame_id"), F.count("*").alias("announced"))
    rows = frames.withColumn("announced", F.lit(None).cast("long")).unionByName(ends)
    return streaming.drained(completion.finished(streaming.stream_of(rows, "frame_id", max(200, rows.count() // 3)), CAMERAS))


STREAMS_FINISHED = f"""with {BOXES}, f as (select distinct cast(floor(frame_id / 24) as bigint) as job_id, camera_id, frame_id from d)
select job_id, count(distinct camera_id) as streams, count(*) as frames from f group by job_id having count(distinct camera_id) = 4"""
