"""Near-duplicate vectors by iterative quantisation.

1. Equal vectors of a label are one class; only classes are searched.
2. On a bounded sample (``sample_rows``) rotations are learned that make the
   signs of rotated unit vectors balanced binary codes: alternate the codes of
   the present rotation and the best rotation for these codes. Vectors are
   centred first, or not, whichever needs fewer comparisons. Rotations don't need
   each other: tasks read the sample's files and learn some of them each.
3. Every class is indexed in tables, each keyed by some bits of its codes. The
   number of bits follows the number of classes, so buckets stay small, and the
   number of tables follows from the chance that a pair at the threshold agrees
   on all bits of a key, for ``recall`` or more. Centring widens angles, so that
   chance is taken from the angles that pairs at the threshold have after it.
4. Pairs that share a bucket and lie within a Hamming radius are reranked by
   cosine in double precision with the original vectors. Buckets of at most
   ``SMALL`` classes are joined, so pairs grow with the rows; larger ones are
   dealt in tiles of bounded size, whose vectors are compared as matrix products
   in their tasks: only numbers of links and the edges of a spanning forest leave
   a tile. A pair that shares a large bucket is counted in the first such table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvector.llm.common import components, cut, open_shared, sliced

FILTER_WORDS = 3  # 64-bit words of code that the Hamming filter reads
MODEL = "d int, first int, mean binary, turns binary"
ANGLES = "d int, made array<double>, real array<double>, any_centred array<double>, any_plain array<double>"
PROBES = 2000  # sampled vectors whose angles are measured
MOST_TABLES = 2000  # more keys a vector are not worth centring
SMALL = 200  # classes of a bucket that is joined
TILE_ROWS = 1000
COLUMNS = 64  # of the codes, whose rotations a task learns; one rotation at least


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to about 1: exact, and no product of two overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(x: np.ndarray, rng, rounds: int = 30) -> np.ndarray:
    """Rotation of centred rows that brings them close to their signs."""
    d = x.shape[1]
    r = np.linalg.qr(rng.normal(size=(d, d)))[0]
    v = np.empty_like(x)  # one array for all rounds: to make new ones takes as long as the products
    for _ in range(rounds):
        np.matmul(x, r, out=v)
        np.multiply(v >= 0, 2.0, out=v)
        v -= 1.0
        u, _, w = np.linalg.svd(x.T @ v)
        r = u @ w
    return r


def learn_some(x: np.ndarray, first: int, end: int, rng) -> list[np.ndarray]:
    """Rotations ``first`` to ``end`` of those that one generator starts after each other; the starts of those before are drawn and left."""
    for _ in range(first):
        rng.normal(size=(x.shape[1], x.shape[1]))
    return [learn_rotation(x, rng) for _ in range(first, end)]


def sampled(files: list[str], d: int) -> np.ndarray:
    """Vectors of one size from the sample's files."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    found = []
    for fs, path in map(open_shared, files):
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1000, columns=["d", "v"]):
                found.append(np.asarray(batch.filter(pc.equal(batch.column("d"), d)).column("v").flatten()))
    return np.concatenate(found).reshape(-1, d)


def dealt(sizes: list[int], columns: int) -> list[tuple[int, int, int]]:
    """(size of vectors, first rotation, end) of each task, for codes of so many columns."""
    tasks = []
    for d in sizes:
        turns, each = -(-columns // d), max(1, COLUMNS // d)
        tasks += [(d, first, min(first + each, turns)) for first in range(0, turns, each)]
    return tasks


def apart_share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angle of rows as a share of pi: the chance that a bit differs; 1 where a row is zero."""
    size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return np.where(size > 1e-12, np.arccos(np.clip((x * y).sum(1) / np.maximum(size, 1e-12), -1, 1)) / np.pi, 1.0)


def measured(x: np.ndarray, mean: np.ndarray, threshold: float, rng) -> list[np.ndarray]:
    """Shares of pi of angles: after centring, of made and of real pairs near the threshold; of any pairs, centred and plain.

    A made pair is a sampled vector and one at the threshold from it in a random
    direction.
    """
    some = x[rng.permutation(len(x))[:PROBES]]
    u = rng.normal(size=some.shape)
    u -= (u * some).sum(1, keepdims=True) * some
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    made = apart_share(some - mean, threshold * some + np.sqrt(max(0.0, 1 - threshold**2)) * u - mean)
    real = [np.zeros(0)]
    for at in range(0, len(some), 250):
        cos = some[at : at + 250] @ x.T
        a, b = np.nonzero((cos >= threshold) & (cos < threshold + 0.2 * (1 - threshold)))
        pick = rng.permutation(len(a))[:PROBES]
        real.append(apart_share(some[at + a[pick]] - mean, x[b[pick]] - mean))
    other = x[rng.integers(0, len(x), len(some))]
    return [made, np.concatenate(real), apart_share(some - mean, other - mean), apart_share(some, other)]


def tables_for(differ: np.ndarray, bits: int, recall: float) -> float:
    """Tables with which pairs whose bits differ with these chances meet, in the mean, with ``recall``."""
    if not len(differ):
        return 1
    hit = (1 - differ) ** bits
    enough = lambda t: np.mean((1 - hit) ** t) <= 1 - recall
    high = 1
    while not enough(high):
        high *= 2
        if high > 2 * MOST_TABLES:
            return math.inf
    low = high // 2
    while high - low > 1:
        low, high = (low, mid) if enough(mid := (low + high) // 2) else (mid, high)
    return high


def plan(n: int, threshold: float, recall: float, angles) -> tuple[int, int, int, set[int]]:
    """(bits of a key, tables, Hamming radius, sizes of vectors to centre) for n classes; angles has ``measured`` by size."""
    bits = min(24, max(4, math.ceil(math.log2(max(n, 2))) - 4))
    plain = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    whole = max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - plain) ** bits)))
    tables, differ, centred = 1, 0.0, set()
    work = lambda t, q: t * (1 + n / 2 * np.mean((1 - q) ** bits))
    for d, (made, real, any_centred, any_plain) in angles.items():
        need = max(tables_for(made, bits, recall), tables_for(real, bits, recall))
        if need <= MOST_TABLES and work(need, any_centred) <= work(whole, any_plain):
            centred.add(d)
            tables, differ = max(tables, need), max(differ, made.max(), real.max(initial=0.0))
        else:
            tables, differ = max(tables, whole), max(differ, plain)
    return bits, tables, radius(differ, 64 * FILTER_WORDS), centred


def radius(differ: float, bits: int) -> int:
    return math.ceil(bits * differ + 7 * math.sqrt(bits * differ * (1 - differ)))


def usable(vector):
    """Not null, no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def linked(one: dict, two: dict, same: bool, t: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked pairs of rows that share no large bucket of a table before ``t``."""
    i, j = np.nonzero(one["x"] @ two["x"].T >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    new = np.ones(len(i), bool)
    for at in range(0, len(i), 50_000):
        a, b = one["keys"][i[at : at + 50_000], :t], two["keys"][j[at : at + 50_000], :t]
        new[at : at + 50_000] = ~((a == b) & (a >= 0)).any(1)
    return i[new], j[new]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches by pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def tiled(members: DataFrame, tables: int, threshold: float) -> DataFrame:
    """Rows (id, k, root) from large buckets: numbers of links k, and edges of a spanning forest (root is not null).

    A bucket's rows are dealt in ``TILE_ROWS``; a tile has two such parts.
    """
    parts = F.ceil(F.col("size") / TILE_ROWS).cast("int")
    home = F.pmod(F.xxhash64(F.lit(5), "id"), parts).cast("int")
    rows = members.withColumn("home", home).withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
    order = ["lh", "d", "t", "key", "lo", "hi"]
    rows = rows.select(F.xxhash64("label").alias("lh"), "d", "t", "key", F.least("home", "o").alias("lo"), F.greatest("home", "o").alias("hi"), "home", "id", "v", "copies", F.col("bigs.t").alias("ts"), F.col("bigs.key").alias("ks"))
    rows = rows.repartition(*order).sortWithinPartitions(*order)

    def read(batch):
        n = len(batch)
        x = unit_rows(np.asarray(batch.column("v").flatten()).reshape(n, -1)) if n else np.zeros((0, 1))
        keys, lengths = np.full((n, tables), -1, np.int64), np.asarray(batch.column("ts").value_lengths())
        keys[np.repeat(np.arange(n), lengths), np.asarray(batch.column("ts").flatten())] = np.asarray(batch.column("ks").flatten())
        return {"x": x, "keys": keys} | {c: np.asarray(batch.column(c)) for c in ("home", "id", "copies")}

    def compare(tile: tuple, pieces: list[dict]):
        import pyarrow as pa

        lo, hi = tile[-2:]
        whole = {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}
        side = [np.flatnonzero(whole["home"] == h) for h in (lo, hi)]
        one, two = ({c: x[s] for c, x in whole.items()} for s in side)
        i, j = linked(one, two, lo == hi, int(tile[2]), threshold)
        i, j = side[0][i], side[1][j]
        k = np.bincount(i, whole["copies"][j], len(whole["id"])) + np.bincount(j, whole["copies"][i], len(whole["id"]))
        root = roots(len(whole["id"]), i, j)
        some, tied = np.flatnonzero(k), np.flatnonzero(root != np.arange(len(root)))
        ids = np.concatenate([whole["id"][some], whole["id"][tied]])
        counts = np.concatenate([k[some].astype(np.int64), np.zeros(len(tied), np.int64)])
        ends = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(whole["id"][root[tied]], pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts), ends], names=["id", "k", "root"])

    def run(batches):
        import pyarrow as pa

        now, pieces = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in order])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                tile = tuple(keys[:, a].tolist())
                if tile != now and pieces:
                    yield from compare(now, pieces)
                    pieces = []
                now = tile
                pieces.append(read(pa.record_batch(batch.slice(a, b - a).columns, names=batch.schema.names)))
        if pieces:
            yield from compare(now, pieces)

    return rows.mapInArrow(run, "id long, k long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.9999, sample_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, they have one length,
    and their cosine is ``threshold`` or more. n_links counts the other vectors
    linked directly, copies included; a component is named by its smallest
    vec_id, which is kept. Magnitudes don't matter, however large or small.

    Defined cases: vectors that are null, zero, or hold null or non-finite
    components link with nothing, and so do null labels; repeated rows are
    copies and keep a row each; a null vec_id links with nothing; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(v)
    rows = cut(vectors.select("vec_id", "label", v.alias("v"), ok.alias("ok")).select("vec_id", "ok", F.when(F.col("ok"), F.col("label")).alias("label"), F.when(F.col("ok"), F.col("v")).alias("v"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2")))
    good = rows.where("ok")
    classes = good.groupBy("label", "h", "h2").agg(F.min(F.struct("vec_id", "v")).alias("m"), F.count("*").alias("copies"))
    classes = cut(classes.select("label", "h", "h2", "copies", F.col("m.vec_id").alias("id"), F.col("m.v").alias("v"), F.size("m.v").alias("d")))
    sizes = {r["d"]: r["count"] for r in classes.groupBy("d").count().collect()}
    n = sum(sizes.values())

    def angles_of(d):
        x = unit_rows(sampled(files, d))
        return measured(x, x.mean(0), threshold, np.random.default_rng(seed))

    def measure(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            for d in (order[i] for i in batch.column("id").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([x], pa.list_(pa.float64())) for x in angles_of(d))], names=["d", "made", "real", "any_centred", "any_plain"])

    def rotations(d, first, end):
        x = unit_rows(sampled(files, d))
        mean = x.mean(0) * (d in centred)
        return mean.tobytes(), np.concatenate(learn_some(x - mean, first, end, np.random.default_rng(seed)), 1).tobytes()

    def learn(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            for d, first, end in (tasks[i] for i in batch.column("id").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([first], pa.int32()), *(pa.array([x], pa.binary()) for x in rotations(d, first, end))], names=["d", "first", "mean", "turns"])

    share = min(1.0, sample_rows / max(1, n))
    sample = classes.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < share * (1 << 30))
    sample = sample.unionByName(classes.groupBy("d").agg(F.min(F.struct("id", "v")).alias("m")).select("d", F.col("m.id").alias("id"), F.col("m.v").alias("v")), allowMissingColumns=True)
    sample = cut(sample.select("d", "v").repartition("d"))  # so there are few files, whatever the input has
    files, order = sample.inputFiles(), sorted(sizes)
    each = lambda items: spark.range(0, len(items), 1, max(1, len(items)))  # noqa: E731  a task for each
    angles = {r["d"]: [np.array(r[c]) for c in ("made", "real", "any_centred", "any_plain")] for r in each(order).mapInArrow(measure, ANGLES).collect()}
    bits, tables, within, centred = plan(n, threshold, recall, angles)
    tasks = dealt(order, max(tables * bits, 64 * FILTER_WORDS))
    learned = {}
    for r in sorted(each(tasks).mapInArrow(learn, MODEL).collect(), key=lambda r: r["first"]):
        learned.setdefault(r["d"], []).append(r)
    models = {d: (np.frombuffer(rs[0]["mean"]), np.concatenate([np.frombuffer(r["turns"]).reshape(d, -1) for r in rs], 1)) for d, rs in learned.items()}
    sent = spark.sparkContext.broadcast(models)  # of the sizes of vectors, not of the rows
    words = [f"w{i}" for i in range(FILTER_WORDS)]

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            d = np.asarray(batch.column("d"))
            flat, ends = np.asarray(batch.column("v").flatten()), np.cumsum(d)
            keys, code = np.zeros((len(d), tables), np.int32), np.zeros((len(d), FILTER_WORDS), np.int64)
            for one in np.unique(d).tolist():
                mine = np.flatnonzero(d == one)
                x = np.stack([flat[ends[i] - one : ends[i]] for i in mine])
                mean, turns = sent.value[one]
                b = (unit_rows(x) - mean) @ turns >= 0
                keys[mine] = b[:, : tables * bits].reshape(len(mine), tables, bits) @ (1 << np.arange(bits))
                code[mine] = np.packbits(b[:, : 64 * FILTER_WORDS], axis=1).view(np.int64)
            rows = [pa.array(list(keys), pa.list_(pa.int32())), *(pa.array(c) for c in code.T)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("d"), *rows], names=["id", "label", "d", "keys", *words])

    kind = dict(vectors.dtypes)["label"]
    index = cut(classes.select("id", "label", "d", "v").mapInArrow(encode, f"id long, label {kind}, d int, keys array<int>, {', '.join(f'{w} long' for w in words)}"))
    table = index.select("id", "label", "d", *words, F.posexplode("keys").alias("t", "key"))
    place = ["label", "d", "t", "key"]
    sizes = cut(table.groupBy(*place).agg(F.count("*").alias("size")).where("size > 1"))
    big = sizes.where(F.col("size") > SMALL)
    table = table.join(sizes.where(F.col("size") <= SMALL), place, "left_semi")
    other = table.select(F.col("id").alias("id_b"), *place, *[F.col(w).alias(f"{w}_b") for w in words])
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    pairs = table.join(other, place).where((F.col("id") < F.col("id_b")) & (apart <= within)).select(F.col("id").alias("a"), F.col("id_b").alias("b"), "label").distinct()

    def rerank(batches):
        import pyarrow as pa

        for batch in batches:
            n = np.asarray(batch.column("x").value_lengths())
            ends, keep = np.cumsum(n), np.zeros(len(n), bool)
            x, y = (np.asarray(batch.column(c).flatten()) for c in "xy")
            for one in np.unique(n).tolist():
                mine = np.flatnonzero(n == one)
                at = (ends[mine] - one)[:, None] + np.arange(one)
                keep[mine] = (unit_rows(x[at]) * unit_rows(y[at])).sum(1) >= threshold
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    dense = big.limit(1).count() > 0
    members = index.select("id", "label", "d", F.posexplode("keys").alias("t", "key")).join(big, place)
    held = cut(members.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", "key"))).alias("bigs"))) if dense else None
    known = classes.join(held, "id", "left") if dense else classes.withColumn("bigs", F.lit(None))  # the tables of a class bound its list
    side = lambda k, w, c, g: known.select(F.col("id").alias(k), "label", F.col("v").alias(w), F.col("copies").alias(c), F.col("bigs").alias(g))
    both = pairs.join(side("a", "x", "ca", "ga"), ["a", "label"]).join(side("b", "y", "cb", "gb"), ["b", "label"])
    if dense:
        both = both.where(~F.coalesce(F.arrays_overlap("ga", "gb"), F.lit(False)))
    links = cut(both.select("a", "b", "ca", "cb", "x", "y").mapInArrow(rerank, "a long, b long, ca long, cb long"))
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    degree = links.select(F.col("a").alias("id"), F.col("cb").alias("k")).unionByName(links.select(F.col("b").alias("id"), F.col("ca").alias("k")))
    if dense:
        found = cut(tiled(members.select("id", *place, "size").join(known.select("id", "v", "copies", "bigs"), "id"), tables, threshold))
        edges = edges.unionByName(found.where("root is not null").select(F.col("id").alias("u"), F.col("root").alias("v")))
        degree = degree.unionByName(found.where("root is null").select("id", "k"))
    degree = degree.groupBy("id").agg(F.sum("k").alias("k"))
    label = components(edges)
    named = classes.join(degree, "id", "left").join(label, "id", "left").select("label", "h", "h2", (F.coalesce("k", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(named, ["label", "h", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
