"""Near-duplicate documents by SetSketch registers.

1. Tasks turn whole texts into sets of word-shingle hashes and the sets into
   SetSketch registers: minima of exponential variates, truncated to
   exponentially spaced values, so sketches of parts merge by maximum.
2. Documents of equal sets become one class; only its smallest id goes on.
3. Bands of registers propose pairs. A band's members are first paired with one
   leader, then, after components are formed, with members of other components
   of the band only: a group of thousands of copies never meets as all pairs,
   and no candidate link between different components is left untested. A large
   band is dealt in tiles of bounded size, each a task's work.
4. The joint likelihood of both sketches drops pairs that can't be similar
   enough, and so do, within a band, the smallest hashes of both sets; the
   others are verified on the full sets of their texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvector.llm.common import blocks, components, cut, mix, sliced

REGISTERS, BANDED, ROWS = 128, 96, 4
SMALLEST = 256
OUTER_ROWS, INNER_ROWS = 1000, 10_000
BASE, RATE = 1.02, 20.0
SKETCH = "doc_id long, n long, h1 long, h2 long, regs binary, low binary"
ODD_STEP = 0x9E3779B97F4A7C15


def tables() -> dict[str, np.ndarray]:
    """Values of bytes for word hashes, powers and inverse powers of the rolling base, register multipliers."""
    r = np.random.default_rng(20240229)
    lower = np.arange(256)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    byte = r.integers(0, 2**64, 256, np.uint64)[lower]
    byte[blank] = 0
    base = 0xD6E8FEB86659FD93
    n = 1 << 20
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    inverse = np.full(n, pow(base, -1, 2**64), np.uint64)
    inverse[0] = 1
    return {"byte": byte, "blank": blank, "power": np.multiply.accumulate(powers), "inverse": np.multiply.accumulate(inverse), "a": r.integers(0, 2**64, REGISTERS, np.uint64) | np.uint64(1), "b": r.integers(0, 2**64, REGISTERS, np.uint64)}


def word_hashes(raw: bytes, t: dict) -> np.ndarray:
    """Hash of each word of one text's bytes, in order; A-Z count as a-z."""
    b = np.frombuffer(raw, np.uint8)
    word = np.ones(len(b) + 2, bool)
    word[0] = word[-1] = False
    word[1:-1] = ~t["blank"][b]
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    size, total = len(t["power"]), np.zeros(len(b) + 1, np.uint64)
    at = np.arange(len(b)) % size if len(b) > size else slice(0, len(b))
    np.cumsum(t["byte"][b] * t["power"][at], out=total[1:])
    sums = total[end] - total[start]
    if len(b) > size:  # a word across the end of the table of powers is summed on its own
        for i in np.flatnonzero(start // size != (end - 1) // size):
            x = t["byte"][b[start[i] : end[i]]]
            sums[i : i + 1] = np.sum(x * t["power"][np.arange(len(x)) % size]) * t["power"][start[i : i + 1] % size]
    return mix(sums * t["inverse"][start % size] + (end - start).astype(np.uint64))


def shingle_set(raw: bytes, k: int, t: dict) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter."""
    w = word_hashes(raw, t)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(ODD_STEP) + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def registers(flat: np.ndarray, starts: np.ndarray, t: dict) -> np.ndarray:
    """SetSketch registers [sets, REGISTERS] as uint16 of sets laid end to end."""
    out = np.empty((len(starts), REGISTERS), np.uint16)
    for i in range(REGISTERS):
        least = np.minimum.reduceat((flat * t["a"][i] + t["b"][i]) ^ (flat >> np.uint64(29)) * t["a"][-1 - i], starts)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE  # the smallest exponential variate
        out[:, i] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, 65535)
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        t = tables()
        for batch in sliced(batches):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            for some in blocks(rows, lambda r: len(r[1] or ""), 2_000_000):
                ids, sets = [r[0] for r in some], [shingle_set((x or "").encode(), k, t) for _, x in some]
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                h1, h2, regs = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [None] * len(n)
                low = [(x[:SMALLEST] >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets]
                if len(full):
                    flat, starts = np.concatenate([sets[i] for i in full]), np.cumsum(n[full]) - n[full]
                    h1[full] = np.add.reduceat(mix(flat), starts).view(np.int64)
                    h2[full] = np.add.reduceat(mix(flat ^ np.uint64(ODD_STEP)), starts).view(np.int64)
                    for i, r in zip(full, registers(flat, starts, t)):
                        regs[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), pa.array(regs, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "n", "h1", "h2", "regs", "low"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def p_b(x):
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likely(na, nb, ra: np.ndarray, rb: np.ndarray, threshold: float, slack: float = 9.0) -> np.ndarray:
    """Whether a similarity of ``threshold`` or more is within ``slack`` log-likelihood of the best one.

    Joint estimation from the numbers of registers above, below and equal,
    given both cardinalities.
    """
    above, below = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    equal = REGISTERS - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0.0, 1.0, 201)[None, :] * np.minimum(u / v, v / u)
    up, down = np.maximum(p_b(np.maximum(u - v * j, 0)), 1e-9), np.maximum(p_b(np.maximum(v - u * j, 0)), 1e-9)
    log = above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-9))
    best = log.max(1)
    high = np.where(j >= threshold, log, -np.inf).max(1)
    return high >= best - slack


def overlapping(one: np.ndarray, n: float, others: list[np.ndarray], ns: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the others may reach the threshold by the smallest hashes of both sets: exact for small sets, else within four deviations."""
    top = lambda x, size: x[-1] if size > SMALLEST else np.uint32(2**32 - 1)
    edge = np.minimum(top(one, n), np.array([top(x, m) for x, m in zip(others, ns)]))
    sizes = np.array([len(x) for x in others])
    flat, owner = np.concatenate(others), np.repeat(np.arange(len(others)), sizes)
    below = flat <= edge[owner]
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.bincount(owner[below & (one[at] == flat)], minlength=len(others))
    all_of = np.bincount(owner[below], minlength=len(others)) + np.searchsorted(one, edge, "right") - both
    whole = (n <= SMALLEST) & (ns <= SMALLEST)
    return both >= np.where(whole, threshold - 1e-6, threshold - 4 * np.sqrt(threshold * (1 - threshold) / all_of)) * all_of


def estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that the sketches don't rule out."""
    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                na, nb = (np.asarray(batch.column(c)).astype(float) for c in ("na", "nb"))
                yield batch.select(["a", "b"]).filter(pa.array(np.concatenate([likely(na[i : i + 2000], nb[i : i + 2000], ra[i : i + 2000], rb[i : i + 2000], threshold) for i in range(0, len(na), 2000)])))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def tiles(members: DataFrame) -> DataFrame:
    """Members of mixed bands dealt to tiles (band, o, i), with ``main`` and ``role``.

    Rows outside a band's largest component are its outer side, dealt in
    ``OUTER_ROWS``; all rows are its inner side, dealt in ``INNER_ROWS``. A row
    stands in a tile for the outer side (role 0), the inner one (1), or both (2),
    so a small band is one tile with each row once, and a large one is many tiles.
    """
    per = members.groupBy("band", "c").agg(F.count("*").alias("k"))
    whole = per.groupBy("band").agg(F.max(F.struct("k", "c")).alias("m"), F.sum("k").alias("size"))
    whole = whole.select("band", F.col("m.c").alias("most"), F.ceil((F.col("size") - F.col("m.k")) / OUTER_ROWS).cast("int").alias("os"), F.ceil(F.col("size") / INNER_ROWS).cast("int").alias("is"))
    rows = members.join(whole, "band").withColumn("main", F.col("c") == F.col("most"))
    rows = rows.withColumn("oh", F.pmod(F.xxhash64(F.lit(1), "rep"), "os").cast("int")).withColumn("ih", F.pmod(F.xxhash64(F.lit(2), "rep"), "is").cast("int"))
    place = lambda o, i, role: F.struct(o.alias("o"), i.alias("i"), role.cast("int").alias("role"))
    inner = F.transform(F.sequence(F.lit(0), F.col("os") - 1), lambda o: place(o, F.col("ih"), F.when(~F.col("main") & (o == F.col("oh")), 2).otherwise(1)))
    outer = F.filter(F.transform(F.sequence(F.lit(0), F.col("is") - 1), lambda i: place(F.col("oh"), i, F.lit(0))), lambda t: ~F.col("main") & (t["i"] != F.col("ih")))
    return rows.select("band", "no", "rep", "c", "main", F.explode(F.concat(inner, outer)).alias("t")).select("band", "no", "rep", "c", "main", "t.*")


def apart(members: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Likely pairs (a, b) of one band and different components, each from the first band it shares.

    A tile's sketches are compared inside its task: the outer side, ``OUTER_ROWS``
    or so, is held and the inner side streams past it. Only pairs that the
    estimate keeps become rows.
    """
    width = 2 * ROWS
    order = ["band", "o", "i", "late"]
    rows = tiles(members).withColumn("late", F.col("role") == 1).join(reps.select("rep", "n", "regs", "low"), "rep")
    rows = rows.repartition("band", "o", "i").sortWithinPartitions(*order).select(*order, "role", "no", "rep", "c", "main", "n", "regs", "low")

    def read(batch):
        out = {c: np.asarray(batch.column(c)) if c not in ("late", "main") else np.array(batch.column(c).to_pylist(), bool) for c in (*order, "role", "no", "rep", "c", "main")}
        raw = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        bands = np.ascontiguousarray(raw[:, :BANDED]).view(f"V{width}").reshape(len(raw), -1)
        low = np.empty(len(raw), object)
        for k, x in enumerate(batch.column("low").to_pylist()):
            low[k] = np.frombuffer(x, np.uint32)
        return out | {"n": np.asarray(batch.column("n")).astype(float), "raw": raw, "bands": bands, "low": low}

    def compare(one: dict, others: dict):
        """Likely pairs of rows of the outer side with rows of the inner one."""
        import pyarrow as pa

        no, out = int(one["no"][0]), []
        for k in range(len(one["rep"])):
            n = one["n"][k]
            js = np.flatnonzero((others["c"] != one["c"][k]) & (others["main"] | (others["rep"] > one["rep"][k])) & (np.minimum(others["n"], n) >= threshold * np.maximum(others["n"], n) - 1e-9))
            if no and len(js):
                js = js[~(others["bands"][js, :no] == one["bands"][k, :no]).any(1)]
            if len(js):
                js = js[likely(np.full(len(js), n), others["n"][js], one["raw"][k][None, :], others["raw"][js], threshold)]
            if len(js):
                js = js[overlapping(one["low"][k], n, list(others["low"][js]), others["n"][js], threshold)]
            out.append(np.stack([np.minimum(one["rep"][k], others["rep"][js]), np.maximum(one["rep"][k], others["rep"][js])]))
        a, b = np.concatenate(out, 1)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        parts, outer, now = [], None, None

        def gathered():
            """The outer side of this tile, compared with itself: it is whole once the inner side begins."""
            one = {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
            return one, compare(one, {c: x[one["role"] == 2] for c, x in one.items()})

        for batch in sliced(batches):
            part = read(batch)
            keys = np.stack([part[c].astype(np.int64) for c in order])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges, edges[1:]):
                tile = keys[:3, x].tolist()
                if tile != now:
                    if parts:
                        yield from gathered()[1]
                    parts, outer, now = [], None, tile
                piece = {c: v[x:y] for c, v in part.items()}
                if not piece["late"][0]:
                    parts.append(piece)
                    continue
                if parts:
                    outer, own = gathered()
                    yield from own
                    parts = []
                if outer is not None:
                    yield from compare(outer, piece)
        if parts:
            yield from gathered()[1]

    return rows.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""
    percent = round(threshold * 100)
    texts = docs.select("doc_id", "text")

    def run(batches):
        import pyarrow as pa

        t = tables()
        for batch in sliced(batches, 200):
            keep, last, kept = [], None, None
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "xa", "xb"))):
                if last != (a, x):
                    last, kept = (a, x), shingle_set((x or "").encode(), k, t)
                other = shingle_set((y or "").encode(), k, t)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(kept) + len(other) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("xb")), "b")
    return with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("xa")), "a").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def grown(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after further links (a, b): only the components that these join, and new nodes, are gone through again."""
    name = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
    again = components(between)
    moved = again.select(F.col("id").alias("component"), F.col("component").alias("to"))
    old = label.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return cut(old.unionByName(again.join(label.select("id"), "id", "left_anti")))


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents link if the Jaccard similarity of their sets of
    ``shingle``-word shingles is ``threshold`` or more (whole percents); a
    component is all that links reach and is named by its smallest doc_id, the
    one that is kept.

    Defined cases: a null or blank text has an empty set and links with nothing;
    a text of fewer words is one shingle; rows that share a doc_id are one node
    of the graph and keep a row each; a null doc_id is its own component (null)
    and is kept; an empty table gives no rows.
    """
    sk = cut(sketches(docs, shingle))
    own = sk.where("n > 0 and doc_id is not null")
    reps = cut(own.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")))
    sketch = own.select(F.col("doc_id").alias("rep"), "n", "h1", "h2", "regs", "low")  # of all documents; pairs are of representatives only

    width = 2 * ROWS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDED // ROWS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * width + 1, F.lit(width))))
    rows = sketch.join(reps, ["rep", "h1", "h2"], "left_semi").select("rep", F.posexplode(band).alias("no", "band"))
    shared = rows.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    members = cut(rows.join(shared, "band").select("band", "no", "rep", "low"))

    # only texts that share a band with another class can be in a pair: they are written once, and no other text is read again
    texts = cut(docs.select("doc_id", "text").join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))

    def tested(pairs):
        return cut(verified(cut(pairs), texts, shingle, threshold))

    pairs = members.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    tried = cut(pairs)
    links = tested(estimated(tried, sketch, threshold))
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    for step in ("popular", "all"):
        now = members.join(label.select(F.col("id").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
        mixed = now.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size")).where("c0 < c1").select("band", "size")
        left = now.join(mixed, "band").select("band", "no", "rep", "c", "size")
        if step == "popular":  # the member that shares most bands with others is near the middle of its group
            score = left.groupBy("rep").agg(F.sum("size").alias("score"))
            left = cut(left.join(score, "rep"))
            lead = left.groupBy("band").agg(F.max(F.struct("score", "rep", "c")).alias("m")).select("band", F.col("m.rep").alias("lead"), F.col("m.c").alias("lc"))
            pairs = left.join(lead, "band").where("c <> lc").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
            links = tested(estimated(pairs.join(tried, ["a", "b"], "left_anti"), sketch, threshold))
        else:
            links = tested(apart(left.drop("size"), sketch, threshold))
        label = grown(label, links)

    classes = reps.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    nodes = own.select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select("doc_id", "component")
    whole = sk.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    if whole:  # rows that share a doc_id join their components
        again = components(nodes.select(F.col("doc_id").alias("u"), F.col("component").alias("v")))
        nodes = nodes.select("doc_id").distinct().join(again.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    out = sk.select("doc_id", "n").join(nodes.distinct(), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
