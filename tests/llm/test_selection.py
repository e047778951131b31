"""Importance resampling, Hilbert shards and the filter audit against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, key, sample

from kinvector.llm import filter_audit, importance, sharding


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    rare = [(1000 + i, "naïve Beta-2 " * r.randint(1, 40) + "x9", "de", "b") for i in range(20)]
    hot = [(2000 + i, "the same text, copied " * 30, "en", "a") for i in range(90)]  # a third of all rows
    return [*sample(), *[(i, t, lang, s, len(t), "x", "y", "z") for i, t, lang, s in rare + hot]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def features(text, order):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_importance(spark, docs, rows, none, order):
    target = [("naïve beta 2 naïve beta 2 x9",), ("the of and",), (None,), ("",)]
    buckets = 97
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(at(f) for r in rows for f in features(r[1], order)[1])
    t = Counter(at(f) for (x,) in target for f in features(x, order)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    want = []
    for i, text, *_ in rows:
        n, fs = features(text, order)
        weight = sum(gain[at(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], -1 if w[0] is None else w[0]))
    drawn = len(able) * 25 // 100
    out = importance.importance(docs, spark.createDataFrame(target, "text string"), order=order, buckets=buckets).collect()
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    ranked = sorted((r for r in out if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, drawn + 1)) and [r.score for r in ranked] == [w[4] for w in able[:drawn]]
    assert [r.doc_id for r in ranked] == [w[0] for w in able[:drawn]]
    kept = importance.resampled(docs, spark.createDataFrame(target, "text string"), order=order, buckets=buckets)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in able[:drawn]}
    if order == 2:
        assert importance.importance(none, none).count() == 0 and importance.importance(docs, none).count() == len(rows)


def test_dictionary_starts_over(monkeypatch):
    texts = [" ".join(f"w{i * j}" for j in range(30)).encode() for i in range(50)]
    whole = importance.buckets_of(texts, 3, 1000, importance.Words())
    words = importance.Words()
    parts = [importance.buckets_of(texts[i : i + 7], 3, 1000, words if i % 2 else importance.Words()) for i in range(0, 50, 7)]
    assert Counter(whole[2].tolist()) == sum((Counter(p[2].tolist()) for p in parts), Counter())


def test_curve_visits_neighbours(spark):
    for sides, bits in ((1, 3), (2, 4), (3, 3), (4, 2)):
        points = list(product(range(1 << bits), repeat=sides))
        df = spark.createDataFrame(points, ", ".join(f"c{i} int" for i in range(sides)))
        got = df.withColumn("h", sharding.curve([F.col(f"c{i}") for i in range(sides)], bits)).orderBy("h").collect()
        assert [r.h for r in got] == list(range(len(points)))
        assert all(sum(abs(a - b) for a, b in zip(x[:sides], y[:sides])) == 1 for x, y in zip(got, got[1:]))


def shard_bytes(t):
    return (t or "").encode()


def test_shards_by_rows(docs, rows, none):
    out = sharding.sharded(docs, 7).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=key) == sorted(((r[0], len(shard_bytes(r[1])) + 16, zlib.crc32(shard_bytes(r[1]))) for r in rows), key=key)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())
    ordered = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in ordered] == sorted(r.hilbert for r in out)
    copies = [k for k, r in enumerate(ordered) if r.doc_id is not None and r.doc_id >= 2000]
    assert copies == list(range(copies[0], copies[0] + 90))  # equal texts are neighbours
    assert sharding.sharded(none, 7).count() == 0
    few = sharding.sharded(docs.limit(3), 40).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_shards_by_bytes(docs, rows):
    out = sharding.sharded(docs, 5, law="bytes").collect()
    total = sum(r["size"] for r in out)
    heavy = Counter()
    for r in out:
        heavy[r.shard] += r["size"]
    assert max(abs(heavy[s] - total / 5) for s in range(5)) <= max(r["size"] for r in out)
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    with pytest.raises(ValueError):
        sharding.sharded(docs, 5, law="none")


def test_files_are_pruned(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, "w" * r.randint(1, 400), r.choice("abcd"), r.choice("wxyz"), 0, "own shard", "a.b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, `dotted.name` string")
    manifest = sharding.write_files(df, str(tmp_path / "curve"), 32).cache()
    back = spark.read.parquet(str(tmp_path / "curve"))
    assert sorted(x[:5] + x[6:7] for x in map(tuple, back.select("doc_id", "text", "lang", "source", "n_chars", "slot", "`dotted.name`").collect())) == sorted((*x[:5], x[6]) for x in rows)
    assert back.groupBy("shard", "slot").count().where("count > 1").count() == 0
    files = manifest.count()
    for ranges in ({"source": ("w", "w")}, {"lang": ("c", "c")}, {"size": (0, 100)}):
        name, (low, high) = next(iter(ranges.items()))
        some = sharding.pruned(manifest, **ranges)
        held = back.where(F.col(name).between(low, high)).select(F.col("_metadata.file_path").alias("file")).distinct()
        assert held.join(some, "file", "left_anti").count() == 0 and some.count() <= 0.6 * files
    assert sharding.pruned(manifest, source=("w", "w"), lang=("c", "c"), size=(0, 100)).count() <= 0.2 * files


def test_audit(spark, docs, rows, none):
    labels = [(i, i % 2, 1 if i % 5 == 0 else 0) for i in [*range(0, 60, 2), 2001, 2002, 2005]] + [(4, 1, 1), (None, 1, 1), (7, None, None)]
    told = {}
    for i, q, t in labels:
        told.setdefault(i, [False, False])
        told[i] = [told[i][0] or q == 1, told[i][1] or t == 1]
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    held = []
    for i, t, _, s, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        held.append((s or "", "".join(k for k, v in fails.items() if v), *(told.get(i, (False, False)) if i is not None else (False, False))))
    want, removed = {}, Counter()
    for part in {h[0] for h in held}:
        mine = [h for h in held if h[0] == part]
        for o in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(o, 1):
                here = [h for h in left if x in h[1]]
                left = [h for h in left if x not in h[1]]
                want[part, o, step] = [len(left), len(here), sum(x in h[1] for h in mine) - len(here), sum(h[1] == x for h in mine), sum(h[2] for h in here), sum(h[3] for h in here)]
                removed[part, x] += len(here)
    got = filter_audit.audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in got} == want
    assert len(got) == len(want) and all(r.shapley == removed[r.part, r["filter"]] for r in got)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(none, empty).count() == 0 and filter_audit.audited(docs, empty).where("good_lost + toxic_lost > 0").count() == 0


def test_replay_of_few_filters(spark):
    flags = spark.createDataFrame([("p", 3, True, False), ("p", 1, False, True), ("p", 0, False, False)], "part string, mask int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.replayed(flags, "XY").collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 1, 1, 3), ("XY", 2): (1, 0, 1, 0, 0, 0, 1), ("YX", 1): (2, 1, 0, 0, 1, 0, 1), ("YX", 2): (1, 1, 1, 1, 0, 1, 3)}
    for letters in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            filter_audit.replayed(flags, letters)
