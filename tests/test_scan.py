"""Two-level scans against plain Python on hot groups, nulls and ties."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinvector.operators import scan


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for i in range(400):
        who = None if i % 50 == 0 else 1 if i % 3 else r.randint(2, 5)  # one group holds most rows
        out.append((who, r.randint(0, 60), i, None if r.random() < 0.6 else r.randint(0, 9)))
    return out


@pytest.fixture(scope="module")
def placed(spark, rows):
    df = spark.createDataFrame(rows, "who long, at long, id long, v long").repartition(7)
    return scan.numbered(df, ["at", "id"], ["who"]).cache()


def groups(rows):
    out = {}
    for x in sorted(rows, key=lambda x: x[1:3]):
        out.setdefault(x[0], []).append(x)
    return out


def test_numbers(spark, rows, placed):
    want = {x[2]: k for g in groups(rows).values() for k, x in enumerate(g)}
    assert {r.id: r.place for r in placed.collect()} == want
    df = spark.createDataFrame(rows, "who long, at long, id long, v long")
    order = [x[2] for x in sorted(rows, key=lambda x: (-x[1], x[2]))]
    assert [r.id for r in scan.numbered(df, [F.desc("at"), "id"], name="n").orderBy("n").collect()] == order
    assert scan.numbered(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_sums_and_carried_values(rows, placed, block):
    total, last = {}, {}
    for g in groups(rows).values():
        s, held = 0, None
        for x in g:
            s += x[3] or 0
            held = x[3] if x[3] is not None else held
            total[x[2]], last[x[2]] = s, held
    assert {r.id: r.s for r in scan.running_sum(placed, {"s": F.col("v")}, ["who"], block=block).collect()} == total
    assert {r.id: r.v for r in scan.carried(placed, "v", ["who"], block=block).collect()} == last


@pytest.mark.parametrize("block", [6, 50])
def test_halo(rows, placed, block):
    w = Window.partitionBy("who", "_block").orderBy("place").rowsBetween(-5, 0)
    got = scan.with_halo(placed, 5, block=block).withColumn("m", F.max("at").over(w)).withColumn("n", F.count("*").over(w)).where("not _halo")
    want = {x[2]: (max(y[1] for y in g[max(0, k - 5) : k + 1]), min(k + 1, 6)) for g in groups(rows).values() for k, x in enumerate(g)}
    assert {r.id: (r.m, r.n) for r in got.collect()} == want
    with pytest.raises(ValueError):
        scan.with_halo(placed, 5, block=4)
