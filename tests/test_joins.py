"""Joins in blocks, by time buckets, by grid cells and by pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinvector.functions import vector
from kinvector.operators import regions, retrieval
from kinvector.plans import retrieval as plans

FOUND = "frame_id long, event_id long, camera_id long, t double, embedding array<double>"


@pytest.fixture(scope="module")
def rows():
    """A third of all rows in one frame and one time bucket; gaps of exactly 300 seconds; negative times."""
    r = np.random.default_rng(4)
    times = [*r.uniform(-2000, 9000, 120), *r.uniform(1200, 1500, 70), 3000.0, 3300.0, 3600.0, 3600.0, 300.0, 0.0, -300.0, -600.0]
    return [(0 if 1200 <= t < 1500 else int(t // 900), 1000 + int(k), int(k) % 3, float(t), [float(x) for x in r.normal(size=5)]) for k, t in zip(r.permutation(len(times)), times)]


@pytest.mark.parametrize("block", [4, 2000])
def test_pairs_across_cameras(spark, rows, block):
    df = spark.createDataFrame(rows, FOUND).repartition(3)

    def want(ok):
        out = {}
        for x in rows:
            for y in rows:
                if x[1] < y[1] and x[2] != y[2] and ok(x, y):
                    u, v = np.array(x[4]), np.array(y[4])
                    out[x[1], y[1]] = (y[3] - x[3], u @ v / ((np.linalg.norm(u) + 1e-8) * (np.linalg.norm(v) + 1e-8)))
        return out

    for got, ok in ((retrieval.across_cameras(df, block), lambda x, y: x[0] == y[0]), (retrieval.within_gap(df, 300.0, block), lambda x, y: abs(x[3] - y[3]) <= 300)):
        found = got.collect()
        pairs = {(r.event_id_a, r.event_id_b): (r.gap, r.cosine) for r in found}
        held = want(ok)
        assert len(found) == len(pairs) == len(held) and len(held) > 500
        assert all(pairs[k] == pytest.approx(v) for k, v in held.items())
    assert retrieval.within_gap(df.limit(0)).count() == 0


def test_overlapping_boxes(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(260):
        x, y = float(r.choice([0.0, 96.0, 192.0, -96.0, r.uniform(-200, 300)])), float(r.uniform(-100, 200))
        rows.append((int(i % 3 == 0), i % 2, i, x, y, x + float(r.choice([96, 40, 0, 180])), y + float(r.choice([96, 60, 100]))))
    rows += [(0, 0, 500 + i, 10.0, 10.0, 120.0, 130.0) for i in range(20)]  # copies
    df = spark.createDataFrame(rows, "camera_id long, frame_id long, event_id long, x1 double, y1 double, x2 double, y2 double")

    def iou(a, b):
        w, h = max(0.0, min(a[5], b[5]) - max(a[3], b[3])), max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
        union = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h
        return w * h / union if union > 0 else 0.0

    want = {(a[2], b[2]): iou(a, b) for a in rows for b in rows if a[:2] == b[:2] and a[2] < b[2] and iou(a, b) > 0.5}
    for cell in (17.0, 96.0, 5000.0):
        found = regions.overlapping_pairs(df, ["camera_id", "frame_id"], 0.5, cell).collect()
        assert len(found) == len(want) > 250 and {(p.a, p.b): p.iou for p in found} == pytest.approx(want)
    inside, outside = regions.overlapping(df, ["camera_id", "frame_id"], 0.5)
    ids = {i for p in want for i in p}
    assert {p.event_id for p in inside.collect()} == ids and {p.event_id for p in outside.collect()} == {x[2] for x in rows} - ids
    assert inside.columns == outside.columns == df.columns


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_pivots_skip_what_cannot_be_near(spark, metric, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE_BYTES", 8 * 6 * 16)  # 16 rows a side
    r = np.random.default_rng(6)
    base = 6 * r.normal(size=(25, 6))
    g = [(i, i, [float(x) for x in base[i % 25] + 0.05 * r.normal(size=6)]) for i in range(500)]
    g += [(500 + i, 500 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)] + [(600, 600, [0.0] * 6)]  # ties, and a vector of no length
    q = [(i, [float(x) for x in base[i % 25] + 0.05 * r.normal(size=6)]) for i in range(70)] + [(70, [0.0] * 6), (71, [2.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    queries, gallery = spark.createDataFrame(q, "q_id long, q array<double>"), spark.createDataFrame(g, "g_id long, seq long, g array<double>").repartition(4)
    exact = retrieval.scores(np.array([x[1] for x in q]), np.array([x[2] for x in g]), metric)
    for k in (1, 7, 1000):
        found, report = retrieval.pruned(queries, gallery, k, metric)
        best = {}
        for x in found.collect():
            best.setdefault(x.q_id, []).append((-round(x.score, 9), x.seq))
        for i in range(len(q)):
            want = sorted((-round(s, 9), j[1]) for s, j in zip(exact[i], g))[:k]
            assert sorted(best[i])[:k] == want
        told = report.first()
        assert told["met"] <= told["all"] and (k != 7 or told["skipped"] > 0.5)
    assert retrieval.pruned(queries, gallery.limit(0), 3, metric)[0].count() == 0
    assert retrieval.pruned(queries.limit(0), gallery, 3, metric)[0].count() == 0


def test_large_galleries_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(7)
    v = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    queries = spark.createDataFrame(v, "q_id long, q array<double>")
    gallery = spark.createDataFrame([(i, i, x) for i, x in v], "g_id long, seq long, g array<double>")
    rows = lambda: [tuple(x) for x in retrieval.top_k(queries, gallery, 5).withColumn("score", F.round("score", 9)).orderBy("q_id", "rank").collect()]
    once = rows()
    monkeypatch.setattr(retrieval, "SENT_BYTES", 0)
    assert rows() == once


def detected(spark, tmp_path, n):
    """A folder of 240 events and n vectors of numbers that need many digits, some events without their vectors."""
    r = np.random.default_rng(10)
    spark.createDataFrame([(i, [float(x) for x in np.float32(r.normal(size=4))], 0) for i in range(n) if i != 5], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    times = np.sort(r.uniform(0, 7200, 240))
    events = spark.createDataFrame([(int(i), float(t), int(u)) for i, t, u in zip(r.permutation(240), times, r.integers(0, 50, 240))], "event_id long, t double, user_id long")
    events.select("event_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).cast("timestamp_ntz").alias("ts"), "user_id", F.lit("x").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["cross_camera_pairs", "spatiotemporal_rerank"])
def test_pairs_travel_without_vectors(spark, tmp_path, monkeypatch, name):
    where, tiles, met = detected(spark, tmp_path, 40), [], retrieval.met
    monkeypatch.setattr(retrieval, "met", lambda rows, *a, **b: tiles.append(rows.columns) or met(rows, *a, **b))
    sent = sorted(map(tuple, getattr(plans, name)(spark, where).collect()))
    monkeypatch.setattr(retrieval, "SENT_BYTES", 0)  # vectors too many for one array are joined to the rows
    joined = sorted(map(tuple, getattr(plans, name)(spark, where).collect()))
    assert "v" not in tiles[0] and "v" in tiles[1]
    assert len(sent) > 200 and [x[:2] for x in sent] == [x[:2] for x in joined] and np.allclose([x[2:] for x in sent], [x[2:] for x in joined], atol=1.5e-6)


def test_rounded(spark):
    x = [0.0, -1e-9, 2.5e-6, -2.5e-6, 0.1234565, -0.1234565, 299.9999995, 1e300, float("nan"), float("-inf"), None]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(vector.rounded(F.col("x"), 6).alias("a"), F.round("x", 6).alias("b")).collect()
    assert [str(r.a) for r in rows] == [str(r.b) for r in rows]
