"""Ticks of empty frames, saved and resumed galleries, epochs, and streams with initial state and timers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinvector.operators import epochs, gallery
from kinvector.sources.shared import folder
from kinvector.streaming import gallery as streaming

SCHEMA = "gallery_id long, camera_id long, frame_id long, event_id long, embedding array<double>, conf double, t double"
SETTINGS = {
    "never full": gallery.Settings(max_size=1000, ticks=False, admit=0.7),
    "full and ageing": gallery.Settings(max_size=12, admit=0.6, ttl_sparse=2, ttl_crowded=1),
    "from the buffer": gallery.Settings(max_size=12, admit=0.6, smooth=False, keep=3),
}


def tuples(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def found(spark):
    """Two galleries of seconds as frames, with gaps, ties of equal vectors and several rows a frame."""
    r = np.random.default_rng(2)
    base = r.normal(size=(14, 4))
    frame = np.cumsum(r.choice([0, 0, 0, 0, 1, 1, 2, 45], 500)) + 10
    rows = [(i % 2, i % 4, int(frame[i]), i, [float(x) for x in base[r.integers(14)] + 0.3 * (i % 5 > 0) * r.normal(size=4)], float(r.uniform(0.4, 1)), float(frame[i]) + (i % 10) / 16) for i in range(500)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def feed(g, frame, *rows):
    return g.frame([(np.array(v, float), c, float(frame), frame) for v, c in rows])


def test_new_ones_of_an_empty_gallery_are_no_decisions():
    g = gallery.Gallery(gallery.Settings())
    feed(g, 0, ((1, 0), 0.95), ((0, 1), 0.95))
    assert g.decisions == {"match": 0, "uncertain": 0, "new": 0} and g.added == 2
    feed(g, 1, ((1, 0), 0.95), ((-1, 0), 0.5), ((0.8, -0.8), 0.5))
    assert g.decisions == {"match": 2, "uncertain": 0, "new": 1}


def test_frames_without_detections_tick():
    g = gallery.Gallery(gallery.Settings(ttl_sparse=2))
    feed(g, 100, ((1, 0), 0.95))  # tick 1
    feed(g, 128, ((0, 1), 0.95))  # ticks 2 to 28, then 29: prunes at 10 and 20
    assert g.tick == 29 and sorted(g.entities) == [0, 1] and g.prunes == 2
    feed(g, 130, ((0, 1), 0.95))  # tick 30 is frame 129: the first one was unseen for three prunes
    assert sorted(g.entities) == [1] and g.pruned == 1 and g.sizes == [(30, 1, 1)]
    g.idle_until(10**9)
    assert not g.entities and g.tick == 10**9 - 99 and sum(n for _, n, _ in g.sizes) == g.tick // 30
    without = gallery.Gallery(gallery.Settings(ttl_sparse=2, gaps=False))
    feed(without, 100, ((1, 0), 0.95))
    feed(without, 900, ((0, 1), 0.95))
    assert without.tick == 2 and len(without.entities) == 2


def test_history(spark):
    df = spark.createDataFrame([(0, 0, 5, 1, [1.0, 0.0], 0.95, 5.0), (0, 0, 70, 2, [0.0, 1.0], 0.95, 70.0)], SCHEMA)
    got = gallery.history(df, gallery.Settings(ttl_sparse=3)).orderBy("tick").collect()
    assert [tuple(r) for r in got] == [(0, 30, 1), (0, 60, 0)]  # the first one goes at tick 40


@pytest.mark.parametrize("name", SETTINGS)
def test_epochs_equal_the_fold(found, name):
    want = tuples(gallery.assign(found, SETTINGS[name]))
    for rows, top in ((60, 2), (170, 32), (10_000, 4)):
        got, saved = epochs.assign(found, SETTINGS[name], rows, top)
        assert tuples(got) == want
        assert sorted(map(str, gallery.snapshot_of(saved).collect())) == sorted(map(str, gallery.final_galleries(found, SETTINGS[name]).collect()))
    assert epochs.epochs_of(found, 60)[1] >= 7


def test_epochs_of_few_and_of_many(spark, found):
    none, saved = epochs.assign(found.limit(0))
    assert none.count() == 0 and saved is None
    early, late = found.where("frame_id < 60"), found.where("frame_id >= 60")
    start = gallery.saved_galleries(early)
    assert tuples(epochs.assign(late, epoch_rows=90, start=start)[0]) == tuples(gallery.assign(late, start=start))
    with pytest.raises(ValueError):
        epochs.assign(found, gallery.Settings(max_size=10**7))


@pytest.mark.parametrize("name", SETTINGS)
def test_a_saved_gallery_goes_on(found, name):
    s, middle = SETTINGS[name], found.approxQuantile("frame_id", [0.5], 0)[0]
    early, late = found.where(F.col("frame_id") <= middle), found.where(F.col("frame_id") > middle)
    saved = gallery.saved_galleries(early, s)
    assert tuples(gallery.assign(early, s).unionByName(gallery.assign(late, s, saved))) == tuples(gallery.assign(found, s))
    assert tuples(gallery.statistics(late, s, saved)) == tuples(gallery.statistics(found, s))


def test_loaded_snapshots(spark, found):
    saved = gallery.saved_galleries(found, SETTINGS["from the buffer"])
    counters = {r.gallery_id: r for r in gallery.counters_of(saved).collect()}
    start = gallery.loaded(gallery.snapshot_of(saved), gallery.counters_of(saved))
    last = found.agg(F.max("frame_id")).first()[0]
    row = [(g, 0, last + 1, 9000 + g, [0.0, 0.0, 0.0, 1e-3], 0.3, float(last + 1)) for g in (0, 1)]
    after = {r.gallery_id: r for r in gallery.counters_of(gallery.saved_galleries(spark.createDataFrame(row, SCHEMA), SETTINGS["from the buffer"], start)).collect()}
    for g in (0, 1):  # the next id is not the largest and one, but what it was
        assert after[g].next_id == counters[g].next_id and after[g].tick == counters[g].tick + last + 1 - counters[g].newest_frame and after[g].total_added == counters[g].total_added
    held = [r for r in start.collect() if r.entity_id is not None]
    assert held and all(r.buffer == [r.centroid] and r.avg_confidence == 0 and r.last_frame_id == 0 for r in held)


def test_landing_files_come_in_order(spark, found):
    stream = streaming.stream_of(found.select("frame_id", "event_id"), "frame_id", rows=60)
    seen = []
    stream.writeStream.foreachBatch(lambda b, n: seen.append(b.agg(F.min("frame_id"), F.max("frame_id"), F.count("*")).first())).option("checkpointLocation", folder(spark)).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) >= 6 and sum(x[2] for x in seen) == 500 and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_stream_equals_fold_and_resumes(spark, found):
    s, middle = SETTINGS["full and ageing"], found.approxQuantile("frame_id", [0.5], 0)[0]
    early, late, out = found.where(F.col("frame_id") <= middle), found.where(F.col("frame_id") > middle), folder(spark)
    before = streaming.drained(streaming.assign_stream(streaming.stream_of(early, "frame_id", rows=90), s, frame_seconds=1), out=out)
    saved = streaming.saved_state(spark, f"{out}-state")
    assert {r.entity_id for r in gallery.snapshot_of(saved).collect()} <= {r.entity_id for r in gallery.final_galleries(early, s).collect()}
    after = streaming.drained(streaming.assign_stream(streaming.stream_of(late, "frame_id", rows=90), s, start=saved, frame_seconds=1))
    assert tuples(before.unionByName(after)) == tuples(gallery.assign(found, s))


def test_timers_age_a_camera_that_sends_nothing(spark):
    s = gallery.Settings(ttl_sparse=2)
    quiet = [(0, 0, 100, 1, [1.0, 0.0], 0.95, 100.5)]
    rows = quiet + [(1, 1, 100 + k, 10 + k, [0.0, 1.0], 0.95, 100.5 + k) for k in range(60)]
    stream = streaming.stream_of(spark.createDataFrame(rows, SCHEMA), "frame_id", rows=6)
    for seconds, left in ((None, 1), (1, 0)):
        out = folder(spark)
        got = streaming.drained(streaming.assign_stream(stream, s, frame_seconds=seconds), out=out)
        saved = streaming.saved_state(spark, f"{out}-state")
        assert got.count() == 61 and gallery.snapshot_of(saved).where("gallery_id = 0").count() == left
        if seconds:
            c = gallery.counters_of(saved).where("gallery_id = 0").first()
            assert (c.tick, c.total_pruned, c.prunes) == (30, 1, 3)  # gone at the third prune, the end of frame 129; no timer stands after it
