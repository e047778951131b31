"""Queries on boxes, confidences, buffers and windows over detections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinvector.functions import boxes as box
from kinvector.operators import buffers, regions, scan
from kinvector.plans.retrieval import BOXES
from kinvector.sources import tables

#: Display colours by track.
PALETTE = ("red", "green", "blue", "cyan", "magenta", "yellow", "orange", "purple", "teal", "lime", "pink", "brown")
SLOTS, PRUNED, CAPACITY = 10, 20, 500


def found(spark, sf_dir):
    return tables.boxes(tables.table(spark, sf_dir, "events"))


def confidence_strata(spark, sf_dir):
    return found(spark, sf_dir).select("event_id", "camera_id", "conf", box.stratum(F.col("conf")).alias("stratum"))


STRATUM = "case when conf >= cast(0.8 as double) then 'high' when conf >= cast(0.3 as double) then 'medium' else 'low' end"
CONFIDENCE_STRATA = f"with {BOXES} select event_id, camera_id, conf, {STRATUM} as stratum from d"


def detector_stats(spark, sf_dir):
    d = found(spark, sf_dir).withColumn("stratum", box.stratum(F.col("conf")))
    part = d.groupBy("camera_id", "frame_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("stratum") == s).alias(s) for s in ("high", "medium", "low")])
    total = part.groupBy("camera_id").agg(F.count("*").alias("frames"), F.sum("n").alias("detections"), *[F.sum(s).alias(s) for s in ("high", "medium", "low")])
    return total.withColumn("per_frame", F.round(F.when(F.col("frames") > 0, F.col("detections") / F.col("frames")).otherwise(0.0), 6))


DETECTOR_STATS = f"""with {BOXES}, s as (select *, {STRATUM} as stratum from d)
select camera_id, count(distinct frame_id) as frames, count(*) as detections, count(*) filter (where stratum = 'high') as high, count(*) filter (where stratum = 'medium') as medium,
       count(*) filter (where stratum = 'low') as low, round(count(*) / count(distinct frame_id), 6) as per_frame from s group by camera_id"""


def overlaps(spark, sf_dir, which):
    return regions.overlapping(found(spark, sf_dir), ["camera_id", "frame_id"])[which].select("event_id", "camera_id", "frame_id")


def overlapping_detections(spark, sf_dir):
    return overlaps(spark, sf_dir, 0)


def non_overlapping_detections(spark, sf_dir):
    return overlaps(spark, sf_dir, 1)


IOU = """i as (select a.event_id, a.camera_id, a.frame_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
  (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ba from d a join d b on a.camera_id = b.camera_id and a.frame_id = b.frame_id and a.event_id <> b.event_id),
o as (select distinct event_id from i where aa + ba - inter > 0 and inter / (aa + ba - inter) > 0.6)"""
OVERLAPPING_DETECTIONS = f"with {BOXES}, {IOU} select event_id, camera_id, frame_id from d where event_id in (from o)"
NON_OVERLAPPING_DETECTIONS = f"with {BOXES}, {IOU} select event_id, camera_id, frame_id from d where event_id not in (from o)"


def overlapping_pairs(spark, sf_dir):
    """Pairs of boxes of one frame with their IoU, where it is above 0.55."""
    return regions.overlapping_pairs(found(spark, sf_dir), ["camera_id", "frame_id"], 0.55).withColumn("iou", F.round("iou", 6))


OVERLAPPING_PAIRS = f"""with {BOXES}, p as (select a.camera_id, a.frame_id, a.event_id as a, b.event_id as b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as both_areas from d a join d b on a.camera_id = b.camera_id and a.frame_id = b.frame_id and a.event_id < b.event_id)
select camera_id, frame_id, a, b, round(inter / (both_areas - inter), 6) as iou from p where inter / (both_areas - inter) > cast(0.55 as double)"""


def valid_crops(spark, sf_dir):
    d = found(spark, sf_dir)
    shift = F.when(F.col("event_id") % 97 == 0, 400).otherwise(0)
    x1, x2 = box.crop(F.col("x1") - shift, F.col("x2") - shift, tables.WIDTH)
    y1, y2 = box.crop(F.col("y1"), F.col("y2"), tables.HEIGHT)
    d = d.select("event_id", x1.alias("left"), y1.alias("top"), (x2 - x1).alias("width"), (y2 - y1).alias("height"))
    valid = (F.col("width") > 0) & (F.col("height") > 0)
    return d.withColumn("valid", valid).withColumn("pad_x", F.when(valid, F.floor(F.col("width") * 0.1).cast("int")).otherwise(0)).withColumn("pad_y", F.when(valid, F.floor(F.col("height") * 0.1).cast("int")).otherwise(0))


VALID_CROPS = f"""with {BOXES}, c as (select event_id, x1 - case when event_id % 97 = 0 then 400 else 0 end as x1, x2 - case when event_id % 97 = 0 then 400 else 0 end as x2, y1, y2 from d),
w as (select event_id, cast(greatest(0, trunc(x1)) as int) as "left", cast(greatest(0, trunc(y1)) as int) as top, cast(least(480, trunc(x2)) - greatest(0, trunc(x1)) as int) as width, cast(least(360, trunc(y2)) - greatest(0, trunc(y1)) as int) as height from c)
select *, width > 0 and height > 0 as valid, case when width > 0 and height > 0 then cast(floor(width * cast(0.1 as double)) as int) else 0 end as pad_x, case when width > 0 and height > 0 then cast(floor(height * cast(0.1 as double)) as int) else 0 end as pad_y from w"""


def ring_buffer_latest(spark, sf_dir):
    return buffers.latest(found(spark, sf_dir), "user_id", 3).select("user_id", "place", "event_id", "conf")


HELD = "k as (select *, row_number() over (partition by user_id order by frame_id desc, event_id desc) as place from d)"
RING_BUFFER_LATEST = f"with {BOXES}, {HELD} select user_id, cast(place as int) as place, event_id, conf from k where place <= 3"


def buffer_stats(spark, sf_dir):
    held = buffers.latest(found(spark, sf_dir), "user_id", SLOTS)
    return held.groupBy("user_id").agg(F.count("*").alias("size"), F.lit(SLOTS).alias("capacity"), (F.count("*") / SLOTS).alias("utilization"), F.round(F.avg("conf"), 6).alias("avg_conf"), F.min("conf").alias("min_conf"), F.max("conf").alias("max_conf"))


BUFFER_STATS = f"with {BOXES}, {HELD} select user_id, count(*) as size, 10 as capacity, count(*) / 10 as utilization, round(avg(conf), 6) as avg_conf, min(conf) as min_conf, max(conf) as max_conf from k where place <= 10 group by user_id"


def admission_candidates(spark, sf_dir):
    return found(spark, sf_dir).where(F.col("conf") >= tables.ADMIT).select("event_id", "user_id", "camera_id", "conf")


ADMISSION_CANDIDATES = f"with {BOXES} select event_id, user_id, camera_id, conf from d where conf >= cast(0.91 as double)"


def entities(spark, sf_dir):
    return found(spark, sf_dir).groupBy("user_id").agg(F.max("t").alias("last_seen"), F.max("frame_id").alias("last_frame"), F.min("event_id").alias("ins_seq"), F.count("*").alias("seen"), F.avg("conf").alias("avg_conf"), F.max("conf").alias("max_conf"))


ENTITIES = "e as (select user_id, max(t) as last_seen, max(frame_id) as last_frame, min(event_id) as ins_seq, count(*) as seen, avg(conf) as avg_conf, max(conf) as max_conf from d group by user_id)"


def lru_evict(spark, sf_dir):
    return buffers.longest_unseen(entities(spark, sf_dir), PRUNED).select("user_id", "last_frame", "ins_seq")


LRU_EVICT = f"with {BOXES}, {ENTITIES} select user_id, last_frame, ins_seq from e order by last_seen, ins_seq limit 20"


def expired(e):
    """Entities unseen for longer than the adaptive time to live, in frames of the newest one."""
    now = e.agg(F.max("last_frame").alias("now"), F.count("*").alias("size"))  # one row
    ttl = F.when(F.col("size") / CAPACITY > 0.8, 30).otherwise(150)
    return e.join(F.broadcast(now)).withColumn("absent", F.col("now") - F.col("last_frame")).where(F.col("absent") * 10 > ttl)


def ttl_expired(spark, sf_dir):
    return expired(entities(spark, sf_dir)).select("user_id", "absent")


EXPIRED = "x as (select user_id, (select max(last_frame) from e) - last_frame as absent from e where ((select max(last_frame) from e) - last_frame) * 10 > case when (select count(*) from e) / 500 > 0.8 then 30 else 150 end)"
TTL_EXPIRED = f"with {BOXES}, {ENTITIES}, {EXPIRED} select user_id, absent from x"


def prune_union(spark, sf_dir):
    e = entities(spark, sf_dir)
    return expired(e).select("user_id").unionByName(buffers.longest_unseen(e, PRUNED).select("user_id")).distinct()


PRUNE_UNION = f"with {BOXES}, {ENTITIES}, {EXPIRED} select user_id from x union (select user_id from (select * from e order by last_seen, ins_seq limit 20))"


def gallery_stats(spark, sf_dir):
    e = entities(spark, sf_dir)
    return e.agg(F.count("*").alias("size"), F.round(F.count("*") / CAPACITY, 6).alias("utilization"), F.round(F.avg("avg_conf"), 6).alias("avg_conf"), F.round(F.min("avg_conf"), 6).alias("min_conf"), F.round(F.max("avg_conf"), 6).alias("max_conf"), F.round(F.avg(F.col("seen") - 1), 6).alias("avg_seen"), (F.max("seen") - 1).alias("max_seen"))


GALLERY_STATS = f"with {BOXES}, {ENTITIES} select count(*) as size, round(count(*) / 500, 6) as utilization, round(avg(avg_conf), 6) as avg_conf, round(min(avg_conf), 6) as min_conf, round(max(avg_conf), 6) as max_conf, round(avg(seen - 1), 6) as avg_seen, max(seen) - 1 as max_seen from e"


def camera_locf_grid(spark, sf_dir):
    """Last event of each camera at every tick, carried forward; complete once all four have been seen."""
    last = found(spark, sf_dir).groupBy("frame_id", "camera_id").agg(F.max("event_id").alias("event_id"))
    grid = last.select("frame_id").distinct().withColumn("camera_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])))
    placed = scan.numbered(grid.join(last, ["frame_id", "camera_id"], "left"), ["frame_id"], ["camera_id"])
    held = scan.carried(placed, "event_id", ["camera_id"])
    wide = held.groupBy("frame_id").pivot("camera_id", [0, 1, 2, 3]).agg(F.max("event_id"))
    cells = [F.col(str(i)).alias(f"camera_{i}") for i in range(4)]
    complete = F.lit(True)
    for i in range(4):
        complete = complete & F.col(str(i)).isNotNull()
    return wide.select("frame_id", *cells, complete.alias("complete"))


CAMERA_LOCF_GRID = f"""with {BOXES}, l as (select frame_id, camera_id, max(event_id) as event_id from d group by all), g as (select frame_id, c as camera_id from (select distinct frame_id from d), range(4) r(c)),
h as (select g.frame_id, g.camera_id, last_value(l.event_id ignore nulls) over (partition by g.camera_id order by g.frame_id rows between unbounded preceding and current row) as event_id from g left join l on g.frame_id = l.frame_id and g.camera_id = l.camera_id)
select frame_id, max(event_id) filter (where camera_id = 0) as camera_0, max(event_id) filter (where camera_id = 1) as camera_1, max(event_id) filter (where camera_id = 2) as camera_2, max(event_id) filter (where camera_id = 3) as camera_3,
       count(event_id) = 4 as complete from h group by frame_id"""


def throughput_windows(spark, sf_dir):
    ticks = scan.numbered(found(spark, sf_dir).groupBy("camera_id", "frame_id").agg(F.count("*").alias("n")), ["frame_id"], ["camera_id"])
    ticks = scan.with_halo(ticks, 99)
    w = Window.partitionBy("camera_id", "_block").orderBy("place")  # a block of ticks and the 99 before it
    last, recent = w.rowsBetween(-99, 0), w.rowsBetween(-29, 0)
    count, span = F.count("*").over(recent), F.max("frame_id").over(recent) - F.min("frame_id").over(recent)
    rate = F.when(count < 10, 25.0).otherwise(F.greatest(F.lit(10.0), F.least(F.lit(30.0), 10 * count / F.greatest(span, F.lit(1)))))
    rows = ticks.select("camera_id", "frame_id", "n", F.round(F.avg("n").over(last), 6).alias("mean_100"), F.round(rate, 6).alias("rate"), "_halo")
    return rows.where("not _halo").drop("_halo")


THROUGHPUT_WINDOWS = f"""with {BOXES}, t as (select camera_id, frame_id, count(*) as n from d group by all),
w as (select *, avg(n) over (partition by camera_id order by frame_id rows between 99 preceding and current row) as m, count(*) over r as c, max(frame_id) over r - min(frame_id) over r as span from t window r as (partition by camera_id order by frame_id rows between 29 preceding and current row))
select camera_id, frame_id, n, round(m, 6) as mean_100, round(case when c < 10 then cast(25 as double) else greatest(cast(10 as double), least(cast(30 as double), cast(10 as double) * c / greatest(span, 1))) end, 6) as rate from w"""


def labels_palette(spark, sf_dir):
    d = found(spark, sf_dir)
    tracked = box.stratum(F.col("conf")) != "low"
    shown = F.format_string("%.2f", F.floor(F.col("conf") * 100 + 0.5) / 100)
    label = F.when(tracked, F.concat(F.lit("ID:"), F.col("user_id").cast("string"), F.lit(" ("), shown, F.lit(")"))).otherwise(F.concat(F.lit("Untracked ("), shown, F.lit(")")))
    path = F.when(F.col("event_type") == "", None).otherwise(F.concat(F.lit("/models/"), "event_type"))
    return d.select("event_id", label.alias("label"), box.colour(F.col("user_id"), list(PALETTE)).alias("colour"), path.alias("path"), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8).alias("short_id"))


LABELS_PALETTE = f"""with {BOXES} select event_id, case when conf >= cast(0.3 as double) then 'ID:' || user_id || ' (' || printf('%.2f', floor(conf * 100 + 0.5) / 100) || ')' else 'Untracked (' || printf('%.2f', floor(conf * 100 + 0.5) / 100) || ')' end as label,
  (['red','green','blue','cyan','magenta','yellow','orange','purple','teal','lime','pink','brown'])[cast(user_id % 12 + 1 as int)] as colour,
  case when event_type = '' then null else '/models/' || event_type end as path, substr(md5(cast(event_id as varchar)), 1, 8) as short_id from d"""


def detections_from_arrays(spark, sf_dir):
    """Frames with parallel arrays, as a detector returns them, back to one row per detection above the confidence threshold and of the wanted classes."""
    d = found(spark, sf_dir).withColumn("class_id", F.col("event_id") % 5)
    rows = d.groupBy("camera_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "conf", "class_id", "x1"))).alias("r"))
    packed = rows.select("camera_id", "frame_id", *[F.transform("r", lambda x: x["event_id"]).alias("event_id"), F.transform("r", lambda x: x["conf"]).alias("conf"), F.transform("r", lambda x: x["class_id"]).alias("class_id"), F.transform("r", lambda x: x["x1"]).alias("x1")])
    flat = packed.select("camera_id", "frame_id", F.posexplode(F.arrays_zip("event_id", "conf", "class_id", "x1")).alias("det_idx", "z"))
    return flat.select("camera_id", "frame_id", "det_idx", "z.event_id", "z.conf", "z.class_id", "z.x1").where((F.col("conf") >= 0.3) & F.col("class_id").isin(0, 2))


DETECTIONS_FROM_ARRAYS = f"""with {BOXES}, c as (select *, event_id % 5 as class_id, row_number() over (partition by camera_id, frame_id order by event_id) - 1 as det_idx from d)
select camera_id, frame_id, cast(det_idx as int) as det_idx, event_id, conf, class_id, x1 from c where conf >= cast(0.3 as double) and class_id in (0, 2)"""


def sampled_history(spark, sf_dir):
    """Entities seen so far at every 30th tick of each camera."""
    d = found(spark, sf_dir)
    first = d.groupBy("camera_id", "user_id").agg(F.min("frame_id").alias("frame_id")).groupBy("camera_id", "frame_id").agg(F.count("*").alias("fresh"))
    ticks = d.select("camera_id", "frame_id").distinct().join(first, ["camera_id", "frame_id"], "left")
    ticks = scan.running_sum(scan.numbered(ticks, ["frame_id"], ["camera_id"]), {"size": F.col("fresh")}, ["camera_id"])
    return ticks.withColumn("tick", (F.col("place") + 1).cast("int")).where("tick % 30 = 0").select("camera_id", "frame_id", "tick", "size")


SAMPLED_HISTORY = f"""with {BOXES}, f as (select camera_id, frame_id, count(*) as fresh from (select camera_id, user_id, min(frame_id) as frame_id from d group by all) group by all),
t as (select camera_id, frame_id, row_number() over w as tick, cast(sum(coalesce(fresh, 0)) over w as bigint) as size from (select distinct camera_id, frame_id from d) left join f using (camera_id, frame_id) window w as (partition by camera_id order by frame_id))
select camera_id, frame_id, cast(tick as int) as tick, size from t where tick % 30 = 0"""


def running_best(spark, sf_dir):
    """Appearances and best confidence of each entity so far, at every observation."""
    w = Window.partitionBy("user_id").orderBy("frame_id", "event_id")
    return found(spark, sf_dir).select("event_id", "user_id", (F.row_number().over(w) - 1).alias("appearance_count"), F.max("conf").over(w).alias("max_conf"))


RUNNING_BEST = f"""with {BOXES} select event_id, user_id, cast(row_number() over w - 1 as int) as appearance_count, max(conf) over w as max_conf from d window w as (partition by user_id order by frame_id, event_id)"""


def label_forms(spark, sf_dir):
    """Labels of tracked persons, and of classes with and without the track before them."""
    d = found(spark, sf_dir)
    shown = F.format_string("%.2f", F.floor(F.col("conf") * 100 + 0.5) / 100)
    kind = F.when(F.col("event_id") % 5 == 0, "person").otherwise(F.col("event_type"))
    track = F.when(F.col("conf") >= 0.6, F.concat(F.lit("ID:"), F.col("user_id").cast("string"), F.lit(" ")))
    return d.select("event_id", F.concat(F.lit("Person "), F.col("user_id").cast("string")).alias("person"), F.concat(F.coalesce(track, F.lit("")), kind, F.lit(": "), shown).alias("label"))


LABEL_FORMS = f"""with {BOXES} select event_id, 'Person ' || user_id as person,
  case when conf >= cast(0.6 as double) then 'ID:' || user_id || ' ' else '' end || case when event_id % 5 = 0 then 'person' else event_type end || ': ' || printf('%.2f', floor(conf * 100 + 0.5) / 100) as label from d"""


def detection_batches(spark, sf_dir):
    """One list for each frame of a batch, empty ones too, with the detections of the wanted classes in order."""
    d = found(spark, sf_dir).withColumn("class_id", F.col("event_id") % 5)
    wanted = F.when((F.col("conf") >= 0.3) & F.col("class_id").isin(0, 2), F.col("event_id"))
    rows = d.groupBy("camera_id", "frame_id").agg(F.array_sort(F.collect_list(wanted)).alias("ids"))  # the detections of one frame
    return rows.select("camera_id", "frame_id", F.size("ids").cast("long").alias("n"), F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))


DETECTION_BATCHES = f"""with {BOXES}, k as (select camera_id, frame_id, event_id, conf >= cast(0.3 as double) and event_id % 5 in (0, 2) as ok from d)
select camera_id, frame_id, count(*) filter (where ok) as n, coalesce(string_agg(cast(event_id as varchar), ',' order by event_id) filter (where ok), '') as ids from k group by camera_id, frame_id"""


def frame_numbers(spark, sf_dir):
    """Frames of each camera that were queued, numbered both ways: without gaps where dropped ones take no number, with gaps where they do."""
    d = found(spark, sf_dir).select("camera_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    placed = scan.numbered(d, ["event_id"], ["camera_id"])  # one capture is one sequence, numbered by many tasks
    rows = scan.running_sum(placed, {"upto": F.when(F.col("ok"), 1).otherwise(0)}, ["camera_id"])
    return rows.where("ok").select("camera_id", "event_id", F.col("place").cast("int").alias("with_gaps"), (F.col("upto") - 1).alias("dense"))


FRAME_NUMBERS = f"""with {BOXES}, k as (select camera_id, event_id, event_type <> 'error' as ok, row_number() over w - 1 as with_gaps, count(*) filter (where event_type <> 'error') over w - 1 as dense from d window w as (partition by camera_id order by event_id))
select camera_id, event_id, cast(with_gaps as int) as with_gaps, dense from k where ok"""


def matches_by_place(spark, sf_dir):
    """Detections and what was decided for them, joined by camera, frame and place in the frame."""
    w = Window.partitionBy("camera_id", "frame_id").orderBy("event_id")
    d = found(spark, sf_dir).withColumn("det_idx", F.row_number().over(w) - 1)
    matches = d.where("conf >= 0.5").select("camera_id", "frame_id", "det_idx", box.stratum(F.col("conf")).alias("decision"))
    return d.select("camera_id", "frame_id", "det_idx", "event_id").join(matches, ["camera_id", "frame_id", "det_idx"])


MATCHES_BY_PLACE = f"""with {BOXES}, k as (select camera_id, frame_id, cast(row_number() over (partition by camera_id, frame_id order by event_id) - 1 as int) as det_idx, event_id, conf from d)
select camera_id, frame_id, det_idx, event_id, case when conf >= cast(0.8 as double) then 'high' when conf >= cast(0.3 as double) then 'medium' else 'low' end as decision from k where conf >= cast(0.5 as double)"""
