"""What must not grow faster than the input: batches, state, copies, shuffled vectors, memory of a task."""

import numpy as np
from pyspark.sql import functions as F

from kinvector.operators import epochs, retrieval
from kinvector.operators import gallery as online
from kinvector.plans import retrieval as plans
from kinvector.streaming import gallery as streaming


def test_a_stream_runs_few_tasks_for_its_rows(spark, tmp_path):
    rows = spark.range(120_000).select((F.col("id") % 4).alias("camera_id"), F.col("id").alias("frame_id"), (F.lit(1.7e9) + F.col("id")).alias("t"))
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        stream = streaming.stream_of(rows, "frame_id")
        out = str(tmp_path / "out")
        query = streaming.begun(streaming.hourly_counts(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).option("checkpointLocation", f"{out}-state").trigger(availableNow=True), spark)
        query.awaitTermination()
        assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 1  # 120,000 rows are one micro-batch, of files written by several tasks
        parts = spark.read.format("state-metadata").load(f"{out}-state").agg(F.max("numPartitions")).first()[0]
        assert parts <= 2 * spark.sparkContext.defaultParallelism and spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)
    assert spark.read.parquet(out).groupBy("hour_start", "camera_id").agg(F.max("detections").alias("n")).agg(F.sum("n")).first()[0] == 120_000


def test_a_search_gives_only_the_best(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = [(i, [float(x) for x in r.normal(size=6)]) for i in range(200)]
    queries = spark.createDataFrame(v, "q_id long, q array<double>")
    gallery = spark.createDataFrame([(i, i, x) for i, x in v], "g_id long, seq long, g array<double>")
    monkeypatch.setattr(retrieval, "TILE_BYTES", 8 * 6 * 16)
    assert retrieval.pruned(queries, gallery, 3)[0].count() == 3 * 200  # not the best of each tile


def test_a_block_that_meets_itself_is_shipped_once(spark):
    rows = spark.range(50).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("frame_id"))
    for block, copies in ((100, 1), (25, 2)):
        held, _ = retrieval.homes(rows, "frame_id", block)
        assert retrieval.tiles_inside(held, "frame_id", [F.col("event_id").alias("id")]).count() == copies * 50


def test_fresh_entities_are_one_array():
    fresh, held, r = epochs.Fresh(), {}, np.random.default_rng(4)
    for step in range(600):
        i = int(r.integers(0, 150))
        if i in held and step % 3 == 0:
            del held[i]
            fresh.drop(i)
        else:
            held[i] = online.scaled(np.round(r.normal(size=3)))
            fresh.put(i, held[i])
        q = online.scaled(r.normal(size=3))
        want = max(((float(np.round(q @ u, 12)), -k, i) for k, (i, u) in enumerate(held.items())), default=(-3.0, 0, -1))
        assert fresh.nearest(q) == (want[2], want[0]) and (fresh.v is None or len(fresh.v) <= 64 + 4 * 150)


def test_a_gallery_is_sorted_by_many_tasks(spark, monkeypatch):
    r = np.random.default_rng(5)
    schema = "gallery_id long, camera_id long, frame_id long, event_id long, embedding array<double>, conf double, t double"
    rows = [(None if i % 3 == 0 else i % 3, i % 2, int(r.integers(0, 90)), i, [float(x) for x in r.normal(size=4)], float(r.uniform(0.4, 1)), i / 8) for i in range(600)]
    found = spark.createDataFrame(rows, schema).repartition(5)
    s = online.Settings(max_size=12, admit=0.6)
    early, late = found.where("frame_id < 40"), found.where("frame_id >= 40")
    whole = sorted(map(str, online.assign(found, s).collect()))  # a range holds all rows
    counted = sorted(map(str, online.statistics(found, online.Settings(smooth=False)).collect()))
    monkeypatch.setattr(online, "RUN_ROWS", 40)
    path, tasks = online.runs(late, online.saved_galleries(early, s))
    held = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()
    assert max(x.n for x in held) <= 80 and len(held) >= 8  # no task sorts a gallery
    for task in tasks:
        got = [tuple(x[c] for c in online.ORDER) for b in online.read_runs(path, task) for x in b.select(online.ORDER).to_pylist()]
        assert got == sorted(got, key=lambda x: [(v is not None, v or 0) for v in x]) and got
    assert sorted(map(str, online.assign(found, s).collect())) == whole
    assert sorted(map(str, online.assign(early, s).unionByName(online.assign(late, s, online.saved_galleries(early, s))).collect())) == whole
    assert sorted(map(str, online.statistics(found, online.Settings(smooth=False)).collect())) == counted
    assert online.assign(found.limit(0), s).count() == 0


def test_joins_before_a_gallery_are_dealt_by_rows(spark, monkeypatch):
    given = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for name, value in zip(given, ("2", "false", "-1")):
        spark.conf.set(name, value)
    try:
        monkeypatch.setattr(online, "RUN_ROWS", 50)
        events = spark.range(600).select(F.lit(1).cast("long").alias("gallery_id"), F.col("id").alias("frame_id"), F.col("id").alias("event_id"), F.lit(0.5).alias("conf"), F.lit(1.0).alias("t"))
        vectors = spark.range(600).select(F.col("id").alias("event_id"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("embedding"))
        path, _ = online.runs(events.join(vectors, "event_id").withColumn("camera_id", F.spark_partition_id().cast("long")))  # the task that joined a row
        rows = spark.read.parquet(path).groupBy("camera_id").count().collect()
        assert len(rows) == 12 and sum(r["count"] for r in rows) == 600 and max(r["count"] for r in rows) <= 100
        assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
    finally:
        for name, value in given.items():
            spark.conf.set(name, value)


def embeddings(spark, tmp_path, n, wide=64):
    """A folder with a table of so many random vectors of length one, some of them equal."""
    v = np.random.default_rng(8).normal(size=(n, wide))
    v[5], v[n - 1] = v[4], v[4]
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return v.astype(float)


def test_reranked_pairs_are_small_on_disk(spark, tmp_path):
    v = embeddings(spark, tmp_path, 1101)  # two blocks, not of whole squares
    out = f"{tmp_path}/out"
    plans.k_reciprocal_rerank(spark, str(tmp_path)).write.parquet(out)
    d = np.sqrt(((v[:, None] - v[None, :]) ** 2).sum(2))
    best = np.argsort(d, axis=1, kind="stable")[:, :20]
    near = np.zeros(d.shape, bool)
    np.put_along_axis(near, best, True, 1)
    near &= near.T
    m = np.where(near, d, np.inf).min(1)
    final = np.where(np.isinf(m)[:, None], 0.3 * d, np.where(near, 0.7 * m[:, None] + 0.3 * d, d))
    got = spark.read.parquet(out).toPandas()
    assert len(got) == 1101**2 and not got.duplicated(["q_id", "g_id"]).any()
    assert np.abs(got.score.to_numpy() - 1 / (1 + final[got.q_id, got.g_id])).max() < 6e-7
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 5 * len(got)  # each score was written with its eight bytes, in the order of the rows


def test_blocks_of_all_pairs_are_written_once(spark, monkeypatch):
    rows = spark.range(300).select("id", F.array(F.col("id") * 1.0).alias("v"))
    monkeypatch.setattr(retrieval, "TILE_BYTES", 8 * 60)
    path, n = retrieval.blocks(rows)
    assert n == 5 and spark.read.parquet(path).count() == 300  # not a copy for each other block

    def told(tiles):
        import pyarrow as pa

        for left, right, same in tiles:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (len(left["id"]) * len(right["id"]), int(same))], names=["n", "same"])

    tiles = retrieval.dense(rows, told, "n long, same long").collect()
    assert len(tiles) == 15 and sum(t.n for t in tiles if t.same) + 2 * sum(t.n for t in tiles if not t.same) == 300**2
    assert retrieval.dense(rows.limit(0), told, "n long, same long").count() == 0


def test_a_frame_is_matched_as_one_matrix():
    r = np.random.default_rng(9)
    base = r.normal(size=(12, 6))
    g = online.Gallery(online.Settings(max_size=25, admit=0.4, new=0.9, match=0.95, ticks=False))
    feed = lambda n, t: g.frame([(base[r.integers(12)] + 0.5 * r.normal(size=6), float(r.uniform(0.3, 1)), float(t), t) for _ in range(n)])
    for t in range(6):
        feed(30, t)
    hints = epochs.Hints(g)
    v = base[r.integers(12, size=60)] + 0.5 * r.normal(size=(60, 6))
    s = np.round(online.scaled(v) @ hints.start.T, 12)
    top = np.full((60, 3), -1)
    top[:, :1] = np.argsort(-s, 1, "stable")[:, :1]
    rows = [(x, k, np.where(k >= 0, s[i][k], -2.0), np.sort(s[i])[-2]) for i, (x, k) in enumerate(zip(v, top))]
    calls = []
    one = hints.nearest
    hints.nearest = lambda *x: calls.append(len(x[0])) or one(*x)
    for t in range(6, 10):
        assert hints.matched(rows) == g.match(v)
        feed(12, t)
    assert calls == [60] * 4  # not a call for each detection
    assert [hints.full > 0, hints.moved.any(), not hints.alive.all(), len(hints.fresh.row) > 0] == [True] * 4


def test_scores_are_counted_once_a_task(spark, tmp_path, monkeypatch):
    v = embeddings(spark, tmp_path, 1300, 8)
    held, dense = [], retrieval.dense
    monkeypatch.setattr(retrieval, "dense", lambda *a: held.append(dense(*a)) or held[-1])
    got = {round(1e6 * x.s): x.n for x in plans.score_histogram(spark, str(tmp_path)).collect()}
    at, n = np.unique(np.rint(1e6 * (online.scaled(v) @ online.scaled(v).T)).astype(int), return_counts=True)
    assert sum(got.values()) == 1300**2 and sum(abs(got.get(a, 0) - b) for a, b in zip(at.tolist(), n.tolist())) <= 20  # scores that lie between two
    most = held[0].groupBy(F.spark_partition_id(), "at").count().agg(F.max("count")).first()[0]
    assert most == 1  # a row for each block of scores was summed up later
