"""Hand-computed cases of the vector-identity operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinvector.functions import boxes, vector
from kinvector.operators import buffers, gallery, retrieval, tables
from kinvector.plans import catalogue
from kinvector.sources.config import PRESETS, Config
from kinvector.streaming import gallery as streaming


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_overlap(spark):
    names = [f"{s}{c}" for s in "ab" for c in ("x1", "y1", "x2", "y2")]
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], names)
    assert [round(r[0], 6) for r in df.select(boxes.overlap("a", "b")).collect()] == [0.142857, 0.0]


def test_strata(spark):
    df = spark.createDataFrame([(0.8,), (0.3,), (0.299,)], ["c"])
    assert [r[0] for r in df.select(boxes.stratum(F.col("c"))).collect()] == ["high", "medium", "low"]


def test_tiers(spark):
    df = spark.createDataFrame([(0.7,), (0.5,), (0.4999,)], ["s"])
    assert [r[0] for r in df.select(retrieval.decision(F.col("s"), 0.7, 0.5)).collect()] == ["match", "uncertain", "new"]
    df = spark.createDataFrame([(0.5,), (0.49,)], ["s"])
    assert [r[0] for r in df.select(retrieval.decision(F.col("s"), 0.5, 0.7)).collect()] == ["match", "new"]


def test_vectors(spark):
    assert value(spark, vector.cosine(vec(0, 0), vec(1, 2))) == 0.0
    assert value(spark, vector.unit(vec(0, 0))) == [0.0, 0.0]
    assert value(spark, vector.score("euclidean", vec(0, 0), vec(3, 4))) == pytest.approx(1 / 6)
    with pytest.raises(ValueError):
        vector.score("manhattan", vec(0), vec(1))
    gaps = [value(spark, vector.time_score(F.lit(g))) for g in (0.0, 60.0, 300.0, 300.1)]
    assert gaps == pytest.approx([1, 0.367879, 0.006738, 0], abs=1e-6)


def test_smoothing(spark):
    for conf, expected in ((0.9, (0.919145, 0.393919)), (0.7, (0.993884, 0.110432))):
        df = spark.createDataFrame([(1, 0, 0, 0.95, [1.0, 0.0]), (1, 1, 1, conf, [0.0, 1.0])], "id long, frame_id long, event_id long, conf double, embedding array<double>")
        assert buffers.smoothed(df, "id").first()["centroid"] == pytest.approx(expected, abs=1e-6)


def test_centroid(spark):
    df = spark.createDataFrame([(1, 0.9, [1.0, 0.0]), (1, 0.3, [0.0, 1.0])], "id long, conf double, embedding array<double>")
    got = lambda q: [r["val"] for r in buffers.centroid(df, "id", q, True).orderBy("pos").collect()]
    assert got(0.0) == pytest.approx([0.948683, 0.316228], abs=1e-6)
    assert got(0.7) == pytest.approx([1, 0]) and got(0.95) == []


def test_rerank(spark):
    v = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [3.0])], "id long, v array<double>")
    _, inside = retrieval.reciprocal(v, 2)
    pairs = spark.createDataFrame([(i, j, abs(float(x - y))) for i, x in enumerate((0, 1, 3)) for j, y in enumerate((0, 1, 3))], "q_id long, g_id long, d double")
    s = {(r.q_id, r.g_id): r.score for r in retrieval.reranked(pairs, inside).collect()}
    assert [s[0, 0], s[0, 1], s[0, 2], s[1, 2], s[2, 1]] == pytest.approx([1, 0.769231, 0.25, 0.333333, 0.333333], abs=1e-6)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_top_k_in_blocks(spark, metric, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(60)] + [(60 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(5)]
    q = spark.createDataFrame(rows, "q_id long, q array<double>")
    g = spark.createDataFrame([(i, i, x) for i, x in rows], "g_id long, seq long, g array<double>")
    once = sorted(map(tuple, retrieval.top_k(q, g, 4, metric).select("q_id", "rank", "g_id").collect()))
    monkeypatch.setattr(retrieval, "SENT_BYTES", 0)
    monkeypatch.setattr(retrieval, "TILE_BYTES", 224)
    assert sorted(map(tuple, retrieval.top_k(q, g, 4, metric).select("q_id", "rank", "g_id").collect())) == once


def feed(g, *rows):
    return g.frame([(np.array(v, float), c, float(t), t) for v, c, t in rows])


def test_gallery_admission_and_ties():
    g = gallery.Gallery(gallery.Settings())
    assert [(r[0], r[1], r[2]) for r in feed(g, ((1, 0), 0.95, 0), ((1, 0), 0.95, 0))] == [(0, "new", 0.0), (1, "new", 0.0)]
    assert feed(g, ((1, 0), 0.95, 1))[0][:2] == (0, "match") and g.entities[0].count == 1
    g = gallery.Gallery(gallery.Settings())
    labels = [r[0] for r in feed(g, ((1, 0), 0.5, 0), ((1, 0), 0.5, 0), ((0, 1), 0.95, 0))]
    assert labels == [0, 0, 0] and g.next_id == 1 and len(g.entities) == 1


def test_gallery_expiry_and_eviction():
    g = gallery.Gallery(gallery.Settings(ttl_sparse=2))
    feed(g, ((1, 0), 0.95, 0))
    seen = []
    for _ in range(29):
        g.end_frame()
        seen.append(len(g.entities))
    assert seen[27] == 1 and seen[28] == 0 and g.pruned == 1
    g = gallery.Gallery(gallery.Settings(max_size=1))
    feed(g, ((1, 0), 0.95, 0))
    feed(g, ((0, 1), 0.95, 1))
    assert list(g.entities) == [1] and g.pruned == 1 and g.ttl == 30


def test_stream_equals_batch(spark):
    r = np.random.default_rng(2)
    rows = [(i % 2, i % 2, i // 6, i, [float(x) for x in r.normal(size=3)], float(r.uniform(0.5, 1)), float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "gallery_id long, camera_id long, frame_id long, event_id long, embedding array<double>, conf double, t double")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(streaming.drained(streaming.assign_stream(streaming.stream_of(df)))) == key(gallery.assign(df))
    assert key(streaming.drained(streaming.assign_stream(streaming.stream_of(df, "frame_id", rows=40)))) == key(gallery.assign(df))
    half = df.where("frame_id < 10")
    saved = gallery.restored(gallery.final_galleries(half))
    later = gallery.final_galleries(df.where("frame_id >= 10"), start=saved)
    assert {(x.gallery_id, x.entity_id) for x in saved.collect()} <= {(x.gallery_id, x.entity_id) for x in later.collect()}
    stats = {x.gallery_id: x for x in gallery.statistics(df).collect()}
    sizes = {i: len([x for x in gallery.final_galleries(df).collect() if x.gallery_id == i]) for i in (0, 1)}
    assert all(stats[i].gallery_size == sizes[i] == stats[i].total_added - stats[i].total_pruned for i in (0, 1))
    assert sum(stats[i].match_decisions + stats[i].uncertain_decisions + stats[i].new_decisions for i in (0, 1)) == gallery.assign(df).where("score <> 0").count()  # those in an empty gallery, of score 0, aren't counted


def test_gallery_recomputes_forces_loads_and_clears():
    g = gallery.Gallery(gallery.Settings(smooth=False, keep=3, max_size=2))
    feed(g, ((1, 0), 0.95, 0))
    g.update(0, np.array([0.0, 1.0]), 0.3, 1.0, 1)  # below the quality of the buffer's centroid
    assert np.allclose(g.entities[0].centroid, (1, 0)) and round(g.entities[0].average, 6) == 0.625
    g.update(0, np.array([0.0, 1.0]), 0.95, 2.0, 2)
    assert np.allclose(g.entities[0].centroid, (0.5**0.5, 0.5**0.5))
    assert not g.insert(5, np.array([0.0, 1.0]), 0.5, 3.0, 3) and not g.is_full()
    forced = gallery.Gallery(gallery.Settings(force=True))
    assert forced.insert(5, np.array([0.0, 1.0]), 0.5, 3.0, 3) and forced.next_id == 6 and forced.added == 1
    forced.load(2, np.array([1.0, 0.0]), 0.9, 0.0, 1.0, 4)
    forced.load(5, np.array([1.0, 0.0]), 0.8, 0.0, 1.0, 7)
    assert list(forced.entities) == [5, 2] and forced.entities[5].count == 7 and forced.next_id == 6
    forced.clear()
    assert not forced.entities and forced.next_id == 0 and forced.added == 0


def test_crops(spark):
    low, high = boxes.crop(F.lit(-5.7), F.lit(20.0), 100)
    assert (value(spark, low), value(spark, high)) == (0, 20)
    assert value(spark, boxes.crop(F.lit(-30.0), F.lit(-10.0), 100)[1]) == -10
    assert value(spark, boxes.crop(F.lit(-30.0), F.lit(-10.0), 100, compat=True)[1]) == 90


def test_page_falls_back(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "job_id string, created long, progress double").withColumn("status", F.lit("x"))
    assert [r.job_id for r in tables.page(df, "nonsense", "DESC").collect()] == ["b", "a"]
    assert [r.job_id for r in tables.page(df, "progress", "desc").collect()] == ["a", "b"]


def test_config():
    c = Config.from_dict(PRESETS["xavier_nx"] | {"other": {}})
    assert c.gallery.max_size == 300 and c.gallery.match == 0.7 and c.problems() == []
    assert "gallery: max_size=300" in c.summary() and len(c.summary().split("\n")) >= 5
    with pytest.raises(TypeError):
        Config.from_dict({"gallery": {"nonsense": 1}})
    assert len(Config.from_dict({"detection": {"confidence": 2}, "reid": {"dimension": 3}}).problems()) == 2


def test_every_query_has_a_name_and_sql_refers_to_queries():
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    assert set(catalogue.NAMES) == set(queries) and set(sql) <= set(queries) and len(sql) >= 38


def test_file_listings(spark, tmp_path):
    from kinvector.sources import files

    for name in ("a.pth", "b_YOLO.engine", "c.engine", "d.onnx", "x.jpg", "w.png", "y.jpg"):
        (tmp_path / name).write_bytes(b"12345")
    kinds = {k: [r.filename for r in files.model_files(spark, str(tmp_path), k).collect()] for k in ("detector", "embedder")}
    assert kinds == {"detector": ["b_YOLO.engine", "c.engine", "d.onnx"], "embedder": ["a.pth", "c.engine"]}
    assert [r.filename for r in files.images(spark, str(tmp_path), 3).collect()] == ["x.jpg", "y.jpg", "w.png"]
    assert {(r.file_id, r.suffix) for r in files.uploads(spark, str(tmp_path)).collect()} >= {("a", ".pth"), ("x", ".jpg")}


def test_plugged_in_model(spark):
    from kinvector.sources import tables as sources

    def embed(batches):
        for b in batches:
            yield b.append_column("unit", b.column("x"))

    assert sources.embedded(spark.range(3).selectExpr("id as x"), "x long, unit long", embed).count() == 3


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    import os

    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("events", "embeddings", "orders", "customer", "supplier", "part", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()

    def rows(df):
        return sorted(tuple("" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    assert not math.isnan(len(got))
