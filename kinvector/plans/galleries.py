"""Queries on online galleries: whole states, ticks, resumed folds and streams, and the fold as recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinvector.operators import epochs, gallery
from kinvector.plans.retrieval import DETECTIONS
from kinvector.plans.service import PIPELINE_COUNTERS, pipeline_counters
from kinvector.sources import tables
from kinvector.sources.shared import folder, written
from kinvector.streaming import gallery as streaming

#: Galleries of ten zones of each camera, small enough to be full and to be folded by SQL.
BOUND, ZONES = 4, 40
BOUNDED = gallery.Settings(max_size=BOUND, ttl_crowded=3, ttl_sparse=6)
FRAME_SECONDS = 3600.0


def galleried(spark, sf_dir):
    return tables.detections(spark, sf_dir).withColumn("gallery_id", F.col("user_id") % ZONES)


def rounded(rows):
    return rows.withColumn("score", F.round("score", 6))


def bounded_gallery_assign(spark, sf_dir):
    return rounded(gallery.assign(galleried(spark, sf_dir), BOUNDED))


#: A step for each detection and for each prune, frames without detections included; the state is a list of entities in the order of insertion.
FOLD = f"""{DETECTIONS}, r as (
  select user_id % {ZONES} as gallery_id, frame_id, event_id, conf as w, t, embedding as v, min(frame_id) over (partition by user_id % {ZONES}) as first, max(frame_id) over (partition by user_id % {ZONES}) as newest from det
), p as (
  select gallery_id, first + unnest(range(1, (newest - first + 1) // 10 + 1)) * 10 - 1 as frame_id from (select distinct gallery_id, first, newest from r)
), k as (
  select *, row_number() over (partition by gallery_id order by frame_id, event_id nulls last) as k from (select gallery_id, frame_id, event_id, w, t, v from r union all select gallery_id, frame_id, null, null, null, null from p)
), steps as (
  select *, event_id is not null and event_id = min(event_id) over (partition by gallery_id, frame_id) as opens from k
), fold as (
  select distinct gallery_id, cast(0 as bigint) as k, cast([] as struct(id bigint, c double[], conf double, seen double, since bigint, n bigint, avg double)[]) as held, cast([] as struct(id bigint, c double[])[]) as snap,
    cast(0 as bigint) as next_id, cast(0 as bigint) as prunes, cast(6 as bigint) as ttl, cast(0 as bigint) as added, cast(0 as bigint) as pruned, cast(0 as bigint) as matches, cast(0 as bigint) as unsure, cast(0 as bigint) as fresh,
    cast(null as bigint) as frame_id, cast(null as bigint) as event_id, cast(null as bigint) as track_id, cast(null as varchar) as decision, cast(null as double) as score, cast(null as boolean) as admitted
  from r
  union all
  select gallery_id, k,
    case when admits then list_filter(held, lambda e: not list_contains(gone, e.id)) || [struct_pack(id := next_id, c := v, conf := w, seen := t, since := aged, n := cast(0 as bigint), avg := w)]
         when decision is null then list_filter(held, lambda e: not list_contains(gone, e.id))
         when hit.id is null then held
         else list_transform(held, lambda e: case when e.id = hit.id then struct_pack(id := e.id, c := ema, conf := greatest(e.conf, w), seen := t, since := aged, n := e.n + 1, avg := e.avg) else e end) end,
    snap, next_id + admits::int, aged, ttl2, added + admits::int, pruned + len(gone),
    matches + coalesce(decision = 'match', false)::int, unsure + coalesce(decision = 'uncertain', false)::int, fresh + coalesce(decision = 'new' and len(snap) > 0, false)::int,
    frame_id, event_id, case when decision = 'new' then next_id else near end, decision, s, case when decision = 'new' then admits else hit.id is not null end
  from (
    select *, list_transform(raw, lambda y: y / sqrt(list_inner_product(raw, raw))) as ema,
      case when aged = prunes then [] else list_distinct(list_concat(list_transform(list_filter(held, lambda e: aged - e.since > ttl2), lambda e: e.id), case when admits then [list_sort(list_transform(held, lambda e, i: struct_pack(seen := e.seen, i := i, id := e.id)))[1].id] else [] end)) end as gone
    from (
      select *, prunes + ages::int as aged, case when not ages then ttl when len(held) / cast({BOUND} as double) > cast(0.8 as double) then 3 else 6 end as ttl2,
        list_transform(generate_series(1, len(v)), lambda i: alpha * v[i] + (1 - alpha) * before[i]) as raw
      from (
        select *, coalesce(hit.c, v) as before, case when w > cast(0.7 as double) then cast(0.3 as double) else cast(0.1 as double) end as alpha
      from (
        select *, len(held) > 0 and (decision is null or admits and len(held) >= {BOUND}) as ages, case when decision in ('match', 'uncertain') then list_filter(held, lambda e: e.id = near)[1] end as hit
        from (
          select *, coalesce(decision = 'new' and w >= cast(0.91 as double), false) as admits
          from (
            select *, case when v is null then null when s >= cast(0.7 as double) then 'match' when s >= cast(0.5 as double) then 'uncertain' else 'new' end as decision
            from (
              select *, coalesce(-top.o, 0) as s, snap[top.i].id as near
              from (
                select *, list_sort(list_transform(snap, lambda e, i: struct_pack(o := -round(list_inner_product(v, e.c) / ((sqrt(list_inner_product(v, v)) + 1e-8) * (sqrt(list_inner_product(e.c, e.c)) + 1e-8)), 12), i := i)))[1] as top
                from (
                  select f.gallery_id, f.held, f.next_id, f.prunes, f.ttl, f.added, f.pruned, f.matches, f.unsure, f.fresh, s.k, s.frame_id, s.event_id, s.w, s.t, s.v, case when s.opens then list_transform(f.held, lambda e: struct_pack(id := e.id, c := e.c)) else f.snap end as snap
                  from fold f join steps s on s.gallery_id = f.gallery_id and s.k = f.k + 1))))))))))
, ended as (select * from fold qualify row_number() over (partition by gallery_id order by k desc) = 1)"""
BOUNDED_GALLERY_ASSIGN = f"with recursive {FOLD} select gallery_id, gallery_id % 4 as camera_id, frame_id, event_id, track_id, decision, round(s, 6) as score, admitted from (select *, score as s from fold) where event_id is not null"


def bounded_gallery_entities(spark, sf_dir):
    """Entities left in each gallery, with what their smoothed centroid begins with."""
    rows = gallery.final_galleries(galleried(spark, sf_dir), BOUNDED)
    return rows.select("gallery_id", "entity_id", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), "confidence", "frames_since_seen", "appearance_count", "avg_confidence")


BOUNDED_GALLERY_ENTITIES = f"""with recursive {FOLD}, e as (select gallery_id, prunes, unnest(held) as e from ended)
select gallery_id, e.id as entity_id, round(e.c[1], 6) as first, round(list_sum(e.c), 5) as total, e.conf as confidence, cast(prunes - e.since as int) as frames_since_seen, cast(e.n as int) as appearance_count, e.avg as avg_confidence from e"""


def bounded_gallery_stats(spark, sf_dir):
    """Counters of each gallery: what was decided, added and pruned, and its size; decisions in an empty gallery aren't counted."""
    rows = gallery.statistics(galleried(spark, sf_dir), BOUNDED)
    return rows.select("gallery_id", "gallery_size", "total_added", "total_pruned", "match_decisions", "uncertain_decisions", "new_decisions", "current_ttl", F.round("avg_confidence", 6).alias("avg_confidence"), "max_appearances")


BOUNDED_GALLERY_STATS = f"""with recursive {FOLD}
select gallery_id, cast(len(held) as int) as gallery_size, cast(added as int) as total_added, cast(pruned as int) as total_pruned, cast(matches as int) as match_decisions, cast(unsure as int) as uncertain_decisions, cast(fresh as int) as new_decisions, cast(ttl as int) as current_ttl,
       round(coalesce(list_avg(list_transform(held, lambda e: e.avg)), 0), 6) as avg_confidence, cast(list_max(list_transform(held, lambda e: e.n)) as int) as max_appearances from ended"""


def bounded_gallery_history(spark, sf_dir):
    """Size of each gallery at every 30th tick, at which frames without detections count."""
    return gallery.history(galleried(spark, sf_dir), BOUNDED)


BOUNDED_GALLERY_HISTORY = f"""with recursive {FOLD}, s as (select distinct gallery_id, first, newest from r), g as (select gallery_id, first, unnest(range(30, newest - first + 2, 30)) as tick from s)
select g.gallery_id, tick, cast(arg_max(len(f.held), f.k) as int) as gallery_size from g join fold f on f.gallery_id = g.gallery_id and f.frame_id <= g.first + g.tick - 1 group by g.gallery_id, tick"""


def worker_final_stats(spark, sf_dir):
    """A worker's last report of each camera: its counters, the persons tracked being those in its galleries."""
    sizes = gallery.statistics(galleried(spark, sf_dir), BOUNDED).groupBy((F.col("gallery_id") % 4).alias("camera_id")).agg(F.sum("gallery_size").alias("gallery_size"))
    rows = pipeline_counters(spark, sf_dir).drop("total_persons_tracked", "frames_displayed").join(sizes, "camera_id", "left")
    return rows.select("camera_id", "frames_captured", "frames_processed", "total_detections", F.coalesce("gallery_size", F.lit(0).cast("long")).alias("total_persons_tracked"))


WORKER_FINAL_STATS = f"""with recursive {FOLD}
select camera_id, frames_captured, frames_processed, total_detections, cast(sum(len(held)) as bigint) as total_persons_tracked from ({PIPELINE_COUNTERS}) c join ended on ended.gallery_id % 4 = c.camera_id group by all"""


def halves(spark, sf_dir):
    """Detections of the first and of the second half of the frames."""
    found = galleried(spark, sf_dir)
    half = found.approxQuantile("frame_id", [0.5], 0.001)[0]
    return found.where(F.col("frame_id") <= half), found.where(F.col("frame_id") > half)


def bounded_gallery_resume(spark, sf_dir):
    """The fold, stopped after half of the frames, saved and taken up again: what it assigns is what it does without a stop."""
    early, late = halves(spark, sf_dir)
    saved = written(gallery.saved_galleries(early, BOUNDED))
    return rounded(gallery.assign(early, BOUNDED).unionByName(gallery.assign(late, BOUNDED, saved)))


BOUNDED_GALLERY_RESUME = BOUNDED_GALLERY_ASSIGN


def bounded_gallery_stream(spark, sf_dir):
    """The same as a stream that is stopped after half of the frames; another begins with the state that it left.

    Entities expire by timers of event time too, as long as other cameras go on.
    """
    early, late = halves(spark, sf_dir)
    out = folder(spark)
    before = streaming.drained(streaming.assign_stream(streaming.stream_of(early, "frame_id"), BOUNDED, frame_seconds=FRAME_SECONDS), out=out)
    saved = written(streaming.saved_state(spark, f"{out}-state"))
    after = streaming.drained(streaming.assign_stream(streaming.stream_of(late, "frame_id"), BOUNDED, start=saved, frame_seconds=FRAME_SECONDS))
    return rounded(before.unionByName(after))


BOUNDED_GALLERY_STREAM = BOUNDED_GALLERY_ASSIGN


def bounded_gallery_epochs(spark, sf_dir):
    """The same with scoring dealt to many tasks: the galleries of all cameras, epoch by epoch."""
    n = max(1000, galleried(spark, sf_dir).count() // 4)
    return rounded(epochs.assign(galleried(spark, sf_dir), BOUNDED, epoch_rows=n)[0])


BOUNDED_GALLERY_EPOCHS = BOUNDED_GALLERY_ASSIGN
