"""Queries of the job and configuration service."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinvector.operators import tables as ops
from kinvector.sources import tables
from kinvector.sources.shared import folder

JOBS = """j as (
  select cast(o_orderkey as varchar) as job_id, o_orderkey as n, case o_orderstatus when 'O' then 'running' when 'F' then 'completed' else 'pending' end as status, cast(epoch(o_orderdate) as bigint) as created, o_totalprice as price from orders
), jobs as (
  select *, case when status <> 'pending' then created + 60 end as started, case when status = 'completed' then created + 61 + n % 600 end as completed,
         case status when 'completed' then cast(100 as double) when 'running' then cast(n % 100 as double) else cast(0 as double) end as progress, case when status = 'completed' then 'out/' || job_id || '.mp4' end as output_video from j)"""
SHOWN = ("job_id", "status", "created", "progress")


def jobs_page(spark, sf_dir):
    return ops.page(tables.jobs(spark, sf_dir), sort_by="progress", direction="asc", limit=20, offset=20).select(*SHOWN)


JOBS_PAGE = f"with {JOBS} select job_id, status, created, progress from jobs order by progress asc nulls last, job_id limit 20 offset 20"


def jobs_count(spark, sf_dir):
    return tables.jobs(spark, sf_dir).agg(F.count("*").alias("total"))


JOBS_COUNT = f"with {JOBS} select count(*) as total from jobs"


def dashboard_counts(spark, sf_dir):
    newest = ops.page(tables.jobs(spark, sf_dir), limit=10)
    return newest.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("running", "completed", "failed")])


DASHBOARD_COUNTS = f"with {JOBS}, r as (select * from jobs order by created desc, job_id limit 10) select count(*) as total, count(*) filter (where status = 'running') as running, count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed from r"


def recent_jobs(spark, sf_dir):
    return ops.page(tables.jobs(spark, sf_dir), limit=5).select(*SHOWN, F.substring("job_id", 1, 8).alias("short_id"))


RECENT_JOBS = f"with {JOBS} select job_id, status, created, progress, substr(job_id, 1, 8) as short_id from jobs order by created desc, job_id limit 5"


def job_overlay(spark, sf_dir):
    jobs = tables.jobs(spark, sf_dir)
    live = jobs.where("status = 'running'").select(F.concat(F.lit("job:"), "job_id").alias("key"), F.when(F.col("n") % 5 == 0, "completed").otherwise("running").alias("status"), ((F.col("n") * 7) % 101).cast("string").alias("progress"))
    return ops.overlaid(jobs, live).select("job_id", "status", "progress")


JOB_OVERLAY = f"""with {JOBS} select job_id, case when status = 'running' and n % 5 = 0 then 'completed' else status end as status, case when status = 'running' then cast((n * 7) % 101 as double) else progress end as progress from jobs"""


def job_status_fold(spark, sf_dir):
    status = F.create_map(*[F.lit(x) for pair in (("signup", "pending"), ("view", "running"), ("click", "running"), ("error", "failed"), ("purchase", "completed")) for x in pair])
    log = tables.table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 1000)).alias("job_id"), F.col("event_id").alias("seq"), F.floor(tables.seconds(F.col("ts"))).alias("at"), F.element_at(status, F.col("event_type")).alias("status"))
    return ops.folded(log).withColumns({c: F.col(c).cast("double") for c in ("started_at", "completed_at")})


JOB_STATUS_FOLD = """with l as (
  select user_id || '-' || cast(floor(event_id / 1000) as bigint) as job_id, event_id as seq, cast(floor(epoch(ts)) as bigint) as moment,
         case event_type when 'signup' then 'pending' when 'error' then 'failed' when 'purchase' then 'completed' else 'running' end as status from events
), f as (select job_id, min(seq) filter (where status in ('completed', 'failed', 'cancelled')) as ended from l group by job_id)
select l.job_id, arg_max(status, seq) as status, cast(min(moment) filter (where status = 'running') as double) as started_at, cast(max(moment) filter (where seq = ended) as double) as completed_at
from l join f on l.job_id = f.job_id where ended is null or seq <= ended group by l.job_id"""


def bulk_delete(spark, sf_dir):
    wanted = tables.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 11).cast("string").alias("job_id"))
    return ops.deleted(tables.jobs(spark, sf_dir), wanted)


BULK_DELETE = f"""with {JOBS}, w as (select cast(c_custkey * 11 as varchar) as job_id from customer)
select count(*) as requested, count(j.job_id) as deleted_count, count(*) - count(j.job_id) as errors, (select count(*) from jobs) - count(j.job_id) as left_over from w left join jobs j on w.job_id = j.job_id"""


def config_upsert(spark, sf_dir):
    old = tables.configs(spark, sf_dir).select("name", F.col("segment").alias("config"), F.col("config_id").alias("created_at"), F.col("config_id").alias("updated_at"))
    changed = tables.configs(spark, sf_dir).where("balance < 0").select("name", F.concat(F.lit("new "), "segment").alias("config"), F.lit(10**6).cast("long").alias("at"))
    added = tables.table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(" (Copy)")).alias("name"), F.lit("added").alias("config"), F.lit(10**6).cast("long").alias("at"))
    return ops.upserted(old, changed.unionByName(added))


CONFIG_UPSERT = """select c_name as name, case when c_acctbal < 0 then 'new ' || c_mktsegment else c_mktsegment end as config, c_custkey as created_at, case when c_acctbal < 0 then 1000000 else c_custkey end as updated_at from customer
union all select s_name || ' (Copy)', 'added', 1000000, 1000000 from supplier"""


def job_metrics(spark, sf_dir):
    j = tables.jobs(spark, sf_dir)
    frames, done = F.col("n") % 900 + 1, F.col("n") % 1000
    duration = F.round(F.col("completed") - F.col("started")).cast("double")
    return j.select("job_id", F.round(F.least(F.lit(100.0), done / frames * 100), 6).alias("progress"), duration.alias("duration"), F.round(F.when(duration > 0, done / duration).otherwise(0.0), 6).alias("fps"), F.round(F.col("price") / F.when(done == 0, 1).otherwise(done), 6).alias("per_frame"))


JOB_METRICS = f"""with {JOBS} select job_id, round(least(cast(100 as double), (n % 1000) / (n % 900 + 1) * 100), 6) as progress, cast(completed - started as double) as duration,
  round(case when completed - started > 0 then (n % 1000) / (completed - started) else cast(0 as double) end, 6) as fps, round(price / case when n % 1000 = 0 then 1 else n % 1000 end, 6) as per_frame from jobs"""


def config_json_fields(spark, sf_dir):
    c = tables.configs(spark, sf_dir)
    text = F.to_json(F.struct(F.col("name"), F.struct(F.col("segment").alias("segment"), F.col("config_id").alias("id")).alias("config")))
    parsed = c.select("config_id", F.from_json(text, "name string, config struct<segment:string,id:bigint>").alias("p"), text.alias("text"))
    return parsed.select("config_id", F.coalesce("p.name", F.lit("Imported Config")).alias("name"), F.col("p.config.segment").alias("segment"), F.get_json_object("text", "$.config.id").cast("long").alias("id"), F.concat(F.regexp_replace("p.name", r"\s+", "_"), F.lit(".json")).alias("file"))


CONFIG_JSON_FIELDS = "select c_custkey as config_id, c_name as name, c_mktsegment as segment, c_custkey as id, regexp_replace(c_name, '\\s+', '_', 'g') || '.json' as file from customer"


def model_catalog(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    name = pick(FAMILIES, F.col("p_partkey") % len(FAMILIES))
    files = p.select(F.concat(name, F.lit("_"), F.col("p_size").cast("string"), pick(SUFFIXES, F.floor(F.col("p_partkey") / 7) % len(SUFFIXES))).alias("filename"), (F.col("p_partkey") * 1024).alias("size"))
    return ops.models(files)


FAMILIES, SUFFIXES = ("yolo11n", "YOLOv8", "my_reid", "ReID_yolo", "resnet50", "LTTC", "notes"), (".pt", ".pth", ".engine", ".onnx", ".txt")
MODEL_CATALOG = f"""with f as (select (['{"', '".join(FAMILIES)}'])[p_partkey % 7 + 1] || '_' || p_size || (['{"', '".join(SUFFIXES)}'])[p_partkey // 7 % 5 + 1] as filename, max(p_partkey * 1024) as size from part group by 1),
k as (select filename, size, case when regexp_matches(filename, '(yolo|YOLO).*\\.(pt|engine)$') then 'detector' when regexp_matches(filename, '(reid|ReID|resnet|lttc|LTTC).*\\.(pth|pt|engine|onnx)$') and lower(filename) not like '%yolo%' then 'embedder' end as kind from f)
select kind, filename, split_part(filename, '.', -1) as type, '/models/' || filename as path, size from k where kind is not null"""


def queue_messages(spark, sf_dir):
    """Messages as JSON lines in a landing folder, read by a file stream, skipping cancelled jobs."""
    from kinvector.streaming import gallery as streaming

    j = tables.jobs(spark, sf_dir)
    message = F.to_json(F.struct("job_id", F.when(F.col("n") % 4 == 0, "multi_camera").alias("type"), F.col("created").alias("created_at")))
    schema = T.StructType.fromDDL("job_id string, type string, created_at long")
    stream = streaming.stream_of(j.select(message.alias("value"))).select(F.from_json("value", schema).alias("m")).select("m.job_id", F.coalesce("m.type", F.lit("single_camera")).alias("type"), "m.created_at")
    cancelled = j.where("status = 'pending'").select("job_id")
    return streaming.drained(stream.join(cancelled, "job_id", "left_anti"))


QUEUE_MESSAGES = f"with {JOBS} select job_id, case when n % 4 = 0 then 'multi_camera' else 'single_camera' end as type, created as created_at from jobs where status <> 'pending'"


def stream_metadata_check(spark, sf_dir):
    """Whether all streams of a group have one size, and the mosaic's size: twice the first stream's."""
    p = tables.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("group"), (F.col("p_size") % 2 * 640 + 640).alias("w"), (F.col("p_size") % 2 * 360 + 360).alias("h"))
    rows = p.groupBy("group").agg(F.count("*").alias("streams"), (F.countDistinct("w", "h") == 1).alias("same"), F.min(F.struct("p_partkey", "w", "h")).alias("first"))
    return rows.select("group", "streams", "same", (F.col("first.w") * 2).alias("grid_w"), (F.col("first.h") * 2).alias("grid_h"))


STREAM_METADATA_CHECK = """with p as (select p_partkey, p_brand as "group", p_size % 2 * 640 + 640 as w, p_size % 2 * 360 + 360 as h from part)
select "group", count(*) as streams, count(distinct (w, h)) = 1 as same, arg_min(w, p_partkey) * 2 as grid_w, arg_min(h, p_partkey) * 2 as grid_h from p group by "group" """


def selection_toggle(spark, sf_dir):
    """Selected ids of each customer after toggling the orders of one more batch: known ones go, new ones come."""
    o = tables.table(spark, sf_dir, "orders")
    held = o.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))).alias("old"), F.collect_set(F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey"))).alias("more"))
    toggled = F.array_union(F.array_except("old", "more"), F.array_except("more", "old"))
    return held.select("o_custkey", F.explode(toggled).alias("o_orderkey"))


SELECTION_TOGGLE = "select o_custkey, o_orderkey from orders where o_orderstatus in ('O', 'P')"


def config_clone(spark, sf_dir):
    c = tables.configs(spark, sf_dir)
    return c.select(F.concat("name", F.lit(" (Copy)")).alias("name"), F.col("segment").alias("config"), F.concat(F.regexp_replace("name", r"\s+", "_"), F.lit("_(Copy).json")).alias("file"))


CONFIG_CLONE = r"select c_name || ' (Copy)' as name, c_mktsegment as config, regexp_replace(c_name, '\s+', '_', 'g') || '_(Copy).json' as file from customer"


def job_insert(spark, sf_dir):
    """The table of jobs after a job of every tenth customer was submitted."""
    jobs = tables.jobs(spark, sf_dir).withColumn("config", F.lit("{}"))
    c = tables.configs(spark, sf_dir).where("config_id % 10 = 0")
    config = F.to_json(F.struct(F.col("segment").alias("segment"), F.col("config_id").alias("id")))
    return ops.inserted(jobs, c.select(F.concat(F.lit("new-"), F.col("config_id").cast("string")).alias("job_id"), config.alias("config"), F.lit(10**9).cast("long").alias("created")))


JOB_INSERT = f"""with {JOBS} select job_id, status, '{{}}' as config, created, progress from jobs
union all select 'new-' || c_custkey, 'pending', '{{"segment":"' || c_mktsegment || '","id":' || c_custkey || '}}', 1000000000, cast(0 as double) from customer where c_custkey % 10 = 0"""


def job_by_id(spark, sf_dir):
    return ops.by_id(tables.jobs(spark, sf_dir), "job_id", "7").select(*SHOWN)


JOB_BY_ID = f"with {JOBS} select job_id, status, created, progress from jobs where job_id = '7'"


def config_requests(spark, sf_dir):
    """(configurations, requests): every seventh is deleted, every fifth other one updated, and some ids are unknown."""
    c = tables.configs(spark, sf_dir)
    held = c.select("config_id", "name", F.col("segment").alias("config"), F.col("config_id").alias("created_at"), (F.col("config_id") * 37 % 1000).alias("updated_at"))
    do = F.when(F.col("config_id") % 7 == 0, "delete").when(F.col("config_id") % 5 == 0, "update")
    asked = c.select(F.when(F.col("config_id") % 3 == 0, -F.col("config_id")).otherwise(F.col("config_id")).alias("config_id"), do.alias("action")).where("action is not null")
    update = F.col("action") == "update"
    return held, asked.select("config_id", "action", F.when(update, F.concat(F.lit("Renamed "), F.col("config_id").cast("string"))).alias("name"), F.when(update, F.lit("changed")).alias("config"), F.when(update, F.lit(5000).cast("long")).alias("at"))


REQUESTS = """h as (select c_custkey as config_id, c_name as name, c_mktsegment as config, c_custkey as created_at, c_custkey * 37 % 1000 as updated_at from customer),
q as (select case when c_custkey % 3 = 0 then -c_custkey else c_custkey end as config_id, case when c_custkey % 7 = 0 then 'delete' else 'update' end as action from customer where c_custkey % 7 = 0 or c_custkey % 5 = 0)"""


def configs_changed_by_id(spark, sf_dir):
    return ops.newest_first(ops.changed(*config_requests(spark, sf_dir))[0])


CONFIGS_CHANGED_BY_ID = f"""with {REQUESTS} select h.config_id, case when action = 'update' then 'Renamed ' || h.config_id else name end as name, case when action = 'update' then 'changed' else config end as config,
created_at, case when action = 'update' then 5000 else updated_at end as updated_at from h left join q on h.config_id = q.config_id where action is null or action = 'update'"""


def config_answers(spark, sf_dir):
    return ops.changed(*config_requests(spark, sf_dir))[1]


CONFIG_ANSWERS = f"with {REQUESTS} select q.config_id, action, case when h.config_id is null then 404 else 200 end as status from q left join h on q.config_id = h.config_id"


def configs_newest(spark, sf_dir):
    return ops.newest_first(config_requests(spark, sf_dir)[0]).limit(20)


CONFIGS_NEWEST = f"with {REQUESTS} select * from h order by updated_at desc, config_id limit 20"


def config_lookup(spark, sf_dir):
    """The configuration that each job was started with."""
    jobs = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_custkey").alias("config_id"))
    return jobs.join(tables.configs(spark, sf_dir).select("config_id", "name", F.col("segment").alias("config")), "config_id")


CONFIG_LOOKUP = "select c_custkey as config_id, cast(o_orderkey as varchar) as job_id, c_name as name, c_mktsegment as config from orders join customer on o_custkey = c_custkey"


def jobs_with_news(spark, sf_dir):
    """Shown jobs for which an update came in."""
    updates = tables.table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").cast("string").alias("job_id"))
    return tables.jobs(spark, sf_dir).join(updates, "job_id", "left_semi").select(*SHOWN)


JOBS_WITH_NEWS = f"with {JOBS} select job_id, status, created, progress from jobs where n in (select l_orderkey from lineitem where l_quantity > 49)"


def live_hash_writes(spark, sf_dir):
    """Fields of the live hash of running jobs, stats as JSON."""
    j = tables.jobs(spark, sf_dir).where("status = 'running'")
    stats = F.struct((F.col("n") % 900).alias("frames_captured"), F.array(F.col("n") % 4, F.col("n") % 7).alias("frames_processed"))
    return ops.live_writes(j.select("job_id", "status", F.col("n").alias("progress"), stats.alias("stats"), F.lit(None).cast("string").alias("error")))


LIVE_HASH_WRITES = f"""with {JOBS}, r as (select 'job:' || job_id as key, n, unnest(['status', 'progress', 'stats', 'error']) as field from jobs where status = 'running')
select key, field, case field when 'status' then 'running' when 'progress' then cast(n as varchar) when 'error' then 'None' else '{{"frames_captured":' || n % 900 || ',"frames_processed":[' || n % 4 || ',' || n % 7 || ']}}' end as value from r"""


def video_downloads(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, (".mp4", ".AVI", ".mkv", ".xyz"))), (F.col("n") % 4 + 1).cast("int"))
    j = tables.jobs(spark, sf_dir).withColumn("output_video", F.regexp_replace("output_video", r"\.mp4$", "")).withColumn("output_video", F.concat("output_video", ends))
    return ops.downloads(j)


VIDEO_DOWNLOADS = f"""with {JOBS}, v as (select job_id, n, 'out/' || job_id || (['.mp4', '.AVI', '.mkv', '.xyz'])[n % 4 + 1] as output_video from jobs where output_video is not null)
select job_id, output_video, substr(output_video, 5) as filename, (['video/mp4', 'video/x-msvideo', 'video/x-matroska', 'video/mp4'])[n % 4 + 1] as media_type from v"""


def pipeline_counters(spark, sf_dir):
    """Per camera: frames captured, processed and displayed, detections and entities tracked; an event that failed is captured only."""
    e = tables.boxes(tables.table(spark, sf_dir, "events"))
    ok = F.col("event_type") != "error"
    frames = lambda c: F.countDistinct(F.when(c, F.col("frame_id")))
    rows = e.groupBy("camera_id").agg(frames(F.lit(True)).alias("frames_captured"), frames(ok).alias("frames_processed"), frames(ok & (F.col("conf") >= 0.5)).alias("frames_displayed"), F.count_if(ok).alias("total_detections"), F.countDistinct(F.when(ok & (F.col("conf") >= 0.91), F.col("user_id"))).alias("total_persons_tracked"))
    return rows


PIPELINE_COUNTERS = """with d as (select user_id, event_type <> 'error' as ok, user_id % 4 as camera_id, cast(floor(epoch(ts) / 3600) as bigint) as frame_id, cast(0.25 as double) + cast(0.75 as double) * ((event_id * 7919) % 1000) / cast(1000 as double) as conf from events)
select camera_id, count(distinct frame_id) as frames_captured, count(distinct frame_id) filter (where ok) as frames_processed, count(distinct frame_id) filter (where ok and conf >= 0.5) as frames_displayed,
count(*) filter (where ok) as total_detections, count(distinct user_id) filter (where ok and conf >= cast(0.91 as double)) as total_persons_tracked from d group by camera_id"""


def streams_progress(spark, sf_dir):
    """Of all cameras: frames processed, the rough progress of a multi-camera job, and whether every camera is done."""
    c = pipeline_counters(spark, sf_dir)
    return c.agg(F.sum("frames_processed").alias("frames_processed"), F.round(F.least(F.lit(100.0), F.sum("frames_processed") / 4 / 10), 6).alias("progress"), F.count_if(F.col("frames_processed") >= F.col("frames_captured")).alias("cameras_done"), (F.count_if(F.col("frames_processed") >= F.col("frames_captured")) == 4).alias("finished"))


STREAMS_PROGRESS = f"select cast(sum(frames_processed) as bigint) as frames_processed, round(least(cast(100 as double), sum(frames_processed) / 4 / 10), 6) as progress, count(*) filter (where frames_processed >= frames_captured) as cameras_done, count(*) filter (where frames_processed >= frames_captured) = 4 as finished from ({PIPELINE_COUNTERS})"


def embedder_stats(spark, sf_dir):
    """Calls of the embedder (one a frame), its sub-batches of 4 crops, crops and mean batch size, per camera."""
    e = tables.boxes(tables.table(spark, sf_dir, "events"))
    calls = e.groupBy("camera_id", "frame_id").agg(F.count("*").alias("crops"))
    return calls.groupBy("camera_id").agg(F.count("*").alias("total_inferences"), F.sum(F.ceil(F.col("crops") / 4)).alias("sub_batches"), F.sum("crops").alias("total_crops_processed"), F.round(F.coalesce(F.avg("crops"), F.lit(0.0)), 6).alias("avg_batch_size"))


EMBEDDER_STATS = """with c as (select user_id % 4 as camera_id, floor(epoch(ts) / 3600) as frame_id, count(*) as crops from events group by all)
select camera_id, count(*) as total_inferences, cast(sum(ceil(crops / 4)) as bigint) as sub_batches, cast(sum(crops) as bigint) as total_crops_processed, round(avg(crops), 6) as avg_batch_size from c group by camera_id"""


def admission_with_force(spark, sf_dir):
    """Detections that may enter a gallery: sure ones, and those whose quality check is skipped."""
    e = tables.boxes(tables.table(spark, sf_dir, "events"))
    force = F.col("event_id") % 50 == 0
    return e.where(force | (F.col("conf") >= 0.91)).select("event_id", "camera_id", force.alias("forced"))


ADMISSION_WITH_FORCE = """select event_id, user_id % 4 as camera_id, event_id % 50 = 0 as forced from events
where event_id % 50 = 0 or cast(0.25 as double) + cast(0.75 as double) * ((event_id * 7919) % 1000) / cast(1000 as double) >= cast(0.91 as double)"""


def buffer_fill(spark, sf_dir):
    """Ring buffer of 10 of each entity: its size, and whether it is full."""
    n = F.least(F.count("*"), F.lit(10)).cast("int")
    return tables.table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("size"), (F.count("*") >= 10).alias("is_full"), (n / 10.0).alias("utilization"))


BUFFER_FILL = "select user_id, cast(least(count(*), 10) as int) as size, count(*) >= 10 as is_full, least(count(*), 10) / cast(10 as double) as utilization from events group by user_id"


def downloadable_jobs(spark, sf_dir):
    """Completed jobs with an output, and how many jobs have each status."""
    j = tables.jobs(spark, sf_dir)
    counts = j.groupBy("status").agg(F.count("*").alias("with_status"))
    return j.where("status = 'completed' and output_video is not null").select("job_id", "status", "output_video").join(counts, "status")


DOWNLOADABLE_JOBS = f"with {JOBS} select job_id, status, output_video, (select count(*) from jobs where status = 'completed') as with_status from jobs where status = 'completed' and output_video is not null"


def service_tables(spark, sf_dir):
    """Jobs put into a table that is created once: asking for it again leaves its rows."""
    name, at = f"jobs_{uuid.uuid4().hex}", folder(spark)
    j = tables.jobs(spark, sf_dir)
    ops.ensured(spark, name, ops.JOBS, at)
    times = {c: F.timestamp_seconds(v) for c, v in (("created_at", "created"), ("started_at", "started"), ("completed_at", "completed"))}
    own = {"job_id": F.col("job_id"), "status": F.col("status"), "progress": F.col("progress"), "output_video": F.col("output_video")} | times
    kinds = dict(ops.ensured(spark, name, ops.JOBS, at).dtypes)
    j.select(*[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]).write.insertInto(name)
    rows = ops.ensured(spark, name, ops.JOBS, at)
    return rows.select("job_id", "status", F.unix_seconds("created_at").alias("created"), F.unix_seconds("completed_at").alias("completed"), "progress", "output_video", F.col("error_message").isNull().alias("no_error"))


SERVICE_TABLES = f"with {JOBS} select job_id, status, created, completed, progress, output_video, true as no_error from jobs"


def serial_ids(spark, sf_dir):
    """Configurations with those of new names numbered on from the largest id."""
    new = tables.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return ops.numbered(tables.configs(spark, sf_dir).select("config_id", "name"), new, "config_id", "name")


SERIAL_IDS = "select c_custkey as config_id, c_name as name from customer union all select (select max(c_custkey) from customer) + row_number() over (order by s_name), s_name from supplier"
