"""Sub-batched models, live tables and completion of streams."""

import pytest
from pyspark.sql import functions as F

from kinvector.operators import tables as ops
from kinvector.sources import batches
from kinvector.streaming import completion, live
from kinvector.streaming import gallery as streaming


@pytest.mark.parametrize("arrow_rows", [1, 3, 10_000])
def test_calls_of_a_model(spark, arrow_rows):
    def same(calls):  # a model that gives back its rows and the size of its call
        import pyarrow as pa

        for b in calls:
            yield pa.RecordBatch.from_arrays([b.column("who"), b.column("n"), pa.array([b.num_rows] * b.num_rows, pa.int64())], names=["who", "n", "size"])

    sizes = {0: 1, 1: 4, 2: 5, 3: 23, None: 8}
    df = spark.createDataFrame([(w, i) for w, k in sizes.items() for i in range(k)], "who long, n long").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow_rows))
    try:
        out, seen = batches.embedded(df, "who long, n long, size long", same, 4, ["who"], ["n"])
        rows = out.withColumn("at", F.monotonically_increasing_id()).collect()
        counters = seen.get
        whole, told = batches.embedded(df.coalesce(1), "who long, n long, size long", same, 7)
        assert whole.count() == 41 and told.get == {"inferences": 1, "calls": 6, "rows": 41, "largest": 7}
        none, nothing = batches.embedded(df.limit(0), "who long, n long, size long", same, 7)
        assert none.count() == 0 and nothing.get["calls"] == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert counters == {"inferences": 5, "calls": sum(-(-k // 4) for k in sizes.values()), "rows": 41, "largest": 4}
    for w, k in sizes.items():
        mine = sorted((r for r in rows if r.who == w), key=lambda r: r.at)
        assert [r.n for r in mine] == list(range(k))  # the order is kept
        assert [r.size for r in mine] == [min(4, k - i // 4 * 4) for i in range(k)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = live.Live(spark, str(tmp_path / "live"), "key string, status string, progress string, seq long", "key", "seq")
    frame = lambda *rows: spark.createDataFrame(list(rows), "key string, status string, progress string, seq long")
    now = lambda: {r.key: (r.status, r.progress) for r in table.read().collect()}
    assert now() == {}
    first = frame(("job:1", "running", "1", 1), ("job:1", "running", "5", 3), ("job:2", "pending", "0", 2))
    second = frame(("job:1", "completed", "100", 4), ("job:3", "running", "7", 5))
    table.upsert(first, 0)
    assert now() == {"job:1": ("running", "5"), "job:2": ("pending", "0")}
    table.upsert(second, 1)
    want = {"job:1": ("completed", "100"), "job:2": ("pending", "0"), "job:3": ("running", "7")}
    assert now() == want
    table.upsert(first, 0)
    table.upsert(second, 1)
    assert now() == want and table.read().count() == 3
    table.compact(0)
    table.compact(0)
    table.upsert(first, 0)  # below the base
    assert table.upto() == 0 and now() == want
    table.compact(1)
    again = live.Live(spark, str(tmp_path / "live"), table.columns, "key", "seq")
    assert again.upto() == 1 and {r.key: (r.status, r.progress) for r in again.read().collect()} == want
    jobs = spark.createDataFrame([("1", "running", 0.0), ("4", "pending", 2.0)], "job_id string, status string, progress double")
    assert {tuple(r) for r in ops.overlaid(jobs, table.read()).select("job_id", "status", "progress").collect()} == {("1", "completed", 100.0), ("4", "pending", 2.0)}


def test_no_tail_frames_are_lost(spark):
    """Job 1: markers first, frames last; job 2 lacks a frame of one stream; job 3 lacks a stream; job 4 has an empty one."""
    rows, at = [], 0
    for job, sent in ((1, {0: (3, 3), 1: (2, 2)}), (2, {0: (2, 2), 1: (1, 2)}), (3, {0: (4, 4)}), (4, {0: (1, 1), 1: (0, 0)})):
        for stream, (frames, announced) in sent.items():
            rows.append((job, stream, announced, at))
            rows += [(job, stream, None, at + 100 + i) for i in range(frames)]
            at += 1
    df = spark.createDataFrame(rows, "job_id long, stream_id long, announced long, at long")
    for size in (3, 1000):
        got = streaming.drained(completion.finished(streaming.stream_of(df, "at", rows=size), 2))
        assert sorted(map(tuple, got.collect())) == [(1, 2, 5), (4, 2, 1)]


def test_tables_are_created_once(spark, tmp_path):
    name = "kv_configs"
    assert ops.ensured(spark, name, ops.CONFIGS, str(tmp_path / "t")).count() == 0
    spark.sql(f"insert into {name} values (1, 'a', '{{}}', null, null)")
    assert ops.ensured(spark, name, ops.CONFIGS).count() == 1 and dict(ops.ensured(spark, name, ops.CONFIGS).dtypes)["updated_at"] == "timestamp"
    spark.sql(f"drop table {name}")
