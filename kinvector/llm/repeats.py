"""Removal of long repeated byte strings within and across documents.

The dealt method, a run-length compressed Burrows-Wheeler index with sampled
run ends, needs the suffix order of the whole corpus, or an index per shard and
a pass of every document through every shard; neither is one bounded Spark job
(see the README). This operator gives the same marks by anchors:

1. In every window of ``length`` bytes the ``GRAM``-byte string of least hash is
   an anchor (the leftmost on ties). Equal windows have equal anchors, so two
   places can share a window only if they share the anchor in it.
2. An anchor's context is all bytes that windows with it can touch. Spark counts
   anchors and contexts by hash, with partial aggregation; where a whole context
   occurs twice all of it is repeated, and copies go no further.
3. For anchors with several contexts, one of each is fetched from the texts, and
   every window of ``length`` bytes around the anchor is hashed; windows that
   occur in two contexts are repeated.
4. Marked ranges are joined to their documents and the bytes taken out.

Passages are also found by their words: anchors among the ``SHARED``-word
strings of every window of ``words`` words tell which documents share a passage
that may be shorter than ``length`` bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvector.llm.common import blocks, cut, mix, sliced
from kinvector.llm.near_dedup import tables as word_tables
from kinvector.llm.near_dedup import word_hashes

GRAM = 160
SHARED = 36  # words of an anchor of shared passages
HOT_CONTEXTS = 20_000
BASE = 0xD6E8FEB86659FD93
ANCHOR = "doc_id long, th long, pos int, before int, after int, ah long, ch long, hs array<long>"
POSITION_BITS = 20


def tables() -> dict:
    r = np.random.default_rng(977)
    n = 1 << 16
    powers = np.full(n, BASE, np.uint64)
    powers[0] = 1
    inverse = np.full(n, pow(BASE, -1, 2**64), np.uint64)
    inverse[0] = 1
    return {"byte": r.integers(0, 2**64, 256, np.uint64), "power": np.multiply.accumulate(powers), "inverse": np.multiply.accumulate(inverse)}


def prefix(raw: bytes, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse): hash of bytes [i, j) is (sums[j] - sums[i]) * inverse[i]."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) >= len(t["power"]):
        n = 1 << int(len(b)).bit_length()
        for name, one in (("power", BASE), ("inverse", pow(BASE, -1, 2**64))):
            x = np.full(n, one, np.uint64)
            x[0] = 1
            t[name] = np.multiply.accumulate(x)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(t["byte"][b] * t["power"][: len(b)], out=sums[1:])
    return sums, t["inverse"][: len(b) + 1]


def anchors(raw: bytes, length: int, t: dict):
    """(positions, bytes before, bytes after, anchor hash, context hash) of one text."""
    n = len(raw)
    if n < length:
        return None
    sums, inverse = prefix(raw, t)
    grams = n - GRAM + 1
    h = mix((sums[GRAM:] - sums[:grams]) * inverse[:grams])
    w = length - GRAM + 1
    chosen = []
    top = np.uint64((1 << POSITION_BITS) - 1)
    step = (1 << POSITION_BITS) - w  # positions of one piece fit into the low bits
    for start in range(0, grams - w + 1, step):
        part = (h[start : start + step + w - 1] & ~top) | np.arange(min(step + w - 1, grams - start), dtype=np.uint64)
        full = -(-len(part) // w) * w
        padded = np.full(full, np.uint64(2**64 - 1))
        padded[: len(part)] = part
        rows = padded.reshape(-1, w)
        left = np.minimum.accumulate(rows, 1).ravel()
        right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(right[: len(part) - w + 1], left[w - 1 : len(part)])
        least = (least & top).astype(np.int64)
        chosen.append(start + least[np.concatenate([[True], least[1:] != least[:-1]])])
    at = np.unique(np.concatenate(chosen))
    before = np.minimum(at, length - GRAM)
    after = np.minimum(n - at, length)
    low, high = at - before, at + after
    context = mix((sums[high] - sums[low]) * inverse[low] + (before * 4096 + after).astype(np.uint64))
    return at, before, after, h[at], context


def window_keys(raw: bytes, before: int, anchor: np.uint64, length: int, t: dict) -> np.ndarray:
    """Hash of each window of a context, with its anchor and the anchor's place in it."""
    sums, inverse = prefix(raw, t)
    k = len(raw) - length + 1
    return mix((sums[length:] - sums[:k]) * inverse[:k] + mix(np.arange(before, before - k, -1).astype(np.uint64) ^ anchor))


def shared_windows(contexts: list[bytes], before: np.ndarray, owner: np.ndarray, length: int, t: dict):
    """(index, first, last) of ranges in contexts whose windows around the anchor occur in two of them.

    ``owner`` tells contexts of different anchors apart. First and last are
    window starts relative to the context.
    """
    keys, ids, starts = [], [], []
    for i, raw in enumerate(contexts):
        if len(raw) < length:
            continue
        keys.append(window_keys(raw, int(before[i]), owner[i], length, t))
        k = len(keys[-1])
        ids.append(np.full(k, i))
        starts.append(np.arange(k))
    if not keys:
        return np.zeros((3, 0), np.int64)
    key, i, s = np.concatenate(keys), np.concatenate(ids), np.concatenate(starts)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    i, s = i[hit], s[hit]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    return np.stack([i[first], s[first], s[last]]) if len(i) else np.zeros((3, 0), np.int64)


def find_anchors(docs: DataFrame, length: int, words: int) -> DataFrame:
    """Anchors by bytes, a row each (``hs`` is null), and a row for each text that has anchors by words (only ``hs``); one pass of the texts finds both."""

    def run(batches):
        import pyarrow as pa

        t, wt = tables(), word_tables()
        names = [x.split()[0] for x in ANCHOR.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

        def rows_of(n, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

        for batch in sliced(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text")))
            for some in blocks(rows, lambda r: len(r[2]), 4_000_000):
                doc, th, parts, held = [], [], [], []
                for d, h, text in some:
                    raw = text.encode()
                    if (found := anchors(raw, length, t)) is not None:
                        parts.append(found)
                        doc += [d] * len(found[0])
                        th += [h] * len(found[0])
                    if len(hs := word_anchors(raw, words, wt)):
                        held.append((d, h, hs.view(np.int64)))
                if parts:
                    at, before, after, ah, ch = (np.concatenate(x) for x in zip(*parts))
                    yield rows_of(len(at), doc_id=doc, th=th, pos=at, before=before, after=after, ah=ah.view(np.int64), ch=ch.view(np.int64))
                if held:
                    d, h, hs = zip(*held)
                    yield rows_of(len(held), doc_id=d, th=h, hs=hs)

    return docs.mapInArrow(run, ANCHOR)


def repeated_spans(docs: DataFrame, everything: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, start, stop): byte ranges that ``length``-byte strings occurring twice cover; they may overlap. ``everything`` has all anchors by bytes."""
    twice = cut(everything.groupBy("ah").agg(F.count("*").alias("n")).where("n > 1").select("ah"))  # written, so that a frequent anchor's side of the join can be split
    occurrences = cut(everything.join(twice, "ah", "left_semi"))
    classes = cut(occurrences.groupBy("ah", "ch", "before", "after").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("m")))
    whole = classes.where("n > 1 and before + after >= %d" % length).select("ah", "ch", "before", "after")
    copied = occurrences.join(whole, ["ah", "ch", "before", "after"]).select("doc_id", "th", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("stop"))

    several = classes.groupBy("ah").agg(F.count("*").alias("k")).where("k > 1")
    some = classes.join(several, "ah").select("ah", (F.col("k") > HOT_CONTEXTS).alias("hot"), "before", "after", "n", F.col("m.doc_id").alias("doc_id"), F.col("m.th").alias("th"), F.col("m.pos").alias("pos"))
    wanted = some.groupBy("doc_id", "th").agg(F.collect_list(F.struct("ah", "hot", "pos", "before", "after", "n")).alias("at")).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "at")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))

    def fetch(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            for d, h, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "at"))):
                raw = text.encode()
                out = [(x["ah"], x["hot"], d, h, x["pos"], x["before"], x["n"], raw[x["pos"] - x["before"] : x["pos"] + x["after"]]) for x in at]
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["ah", "hot", "doc_id", "th", "pos", "before", "n", "raw"])

    contexts = texts.select("doc_id", "th", "text", "at").mapInArrow(fetch, "ah long, hot boolean, doc_id long, th long, pos int, before int, n long, raw binary")

    def compare(batches):
        import pyarrow as pa

        t = tables()

        def marks(rows):
            """Rows of whole anchors."""
            ah, doc, th, pos, before, n, raw = zip(*rows)
            i, first, last = shared_windows(raw, np.array(before), np.array(ah, np.int64).view(np.uint64), length, t)
            out = [(doc[k], th[k], pos[k] - before[k] + a, pos[k] - before[k] + b + length) for k, a, b in zip(i.tolist(), first.tolist(), last.tolist()) if n[k] == 1]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "th", "start", "stop"])

        held, now = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now and len(held) >= 3000:
                    yield from marks(held)
                    held = []
                now = row[0]
                held.append(row)
        if held:
            yield from marks(held)

    def windows(batches):
        import pyarrow as pa

        t = tables()
        for batch in batches:
            for ah, doc, th, pos, before, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if len(raw) >= length:
                    key = window_keys(raw, before, np.uint64(ah % 2**64), length, t)
                    start = pos - before + np.arange(len(key), dtype=np.int32)
                    columns = key.view(np.int64), [doc] * len(key), np.full(len(key), th), start, start + np.int32(length), np.full(len(key), n)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "doc_id", "th", "start", "stop", "n"])

    # an anchor of very many contexts is not held in one task: its windows are counted as rows
    hot = several.where(F.col("k") > HOT_CONTEXTS).limit(1).count() > 0
    if hot:
        rows = cut(contexts.where("hot").drop("hot").mapInArrow(windows, "key long, doc_id long, th long, start int, stop int, n long"))
        twice = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        copied = copied.unionByName(rows.where("n = 1").join(twice, "key").select("doc_id", "th", "start", "stop"))
    varied = contexts.where("not hot").drop("hot").repartition("ah").sortWithinPartitions("ah").mapInArrow(compare, "doc_id long, th long, start int, stop int")
    return copied.unionByName(varied)


def word_anchors(raw: bytes, words: int, t: dict) -> np.ndarray:
    """Distinct hashes of the ``SHARED``-word strings that are least in some window of ``words`` words."""
    w = word_hashes(raw, t)
    grams = len(w) - SHARED + 1
    if len(w) < words:
        return w[:0]
    size = len(t["power"])
    if len(w) >= size:  # beyond the table of powers; as above for bytes
        size = 1 << int(len(w)).bit_length()
        for name, one in (("power", BASE), ("inverse", pow(BASE, -1, 2**64))):
            x = np.full(size, one, np.uint64)
            x[0] = 1
            t[name] = np.multiply.accumulate(x)
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * t["power"][: len(w)], out=sums[1:])
    least, span, width = mix((sums[SHARED:] - sums[:grams]) * t["inverse"][:grams]), 1, words - SHARED + 1
    while span < width:
        step = min(span, width - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    return np.unique(least)


def shared_passages(held: DataFrame) -> DataFrame:
    """(doc_id, th, n_shared) of texts with anchors by words, ``hs``, that other rows of ``held`` hold too.

    Every passage of ``words`` words or more that two documents share gives them
    an anchor in common; what they share is ``SHARED`` words at least. A-Z count
    as a-z, and white space only parts words.
    """
    each = held.select("doc_id", "th", F.explode("hs").alias("h"))
    several = cut(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    return each.join(several, "h").groupBy("doc_id", "th").agg(F.countDistinct("h").alias("n_shared"))


def drop_repeats(docs: DataFrame, length: int = 400, words: int = 51) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_shared and ``kept``, the remaining bytes.

    Every byte is removed that a string of ``length`` bytes covers which also
    starts anywhere else, in the same document or another; overlaps count, and
    strings are judged on the input. n_shared is above 0 for every document that
    shares a passage of ``words`` words with another one, however few bytes that
    is: it counts anchors of passages that are shared, of ``SHARED`` words or
    more, and removes nothing.

    Defined cases: a null text is empty; repeated rows repeat each other;
    different texts that share a doc_id are told apart by their hashes; an
    empty table gives no rows. ``length`` is at least twice ``GRAM``.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = cut(find_anchors(docs, length, words))
    spans = repeated_spans(docs, found.where("ah is not null").drop("hs"), length).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = spans.withColumn("n_shared", F.lit(0).cast("long"))
    shared = shared_passages(found.where("hs is not null").select("doc_id", "th", "hs")).withColumn("spans", F.lit(None).cast("array<struct<start:int,stop:int>>"))
    spans = spans.unionByName(shared).groupBy("doc_id", "th").agg(F.max("spans").alias("spans"), F.max("n_shared").alias("n_shared"))
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans", "n_shared")
    rows = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left").select("doc_id", "text", "spans", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))

    def take_out(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            out = []
            for doc_id, text, spans, shared in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "n_shared"))):
                raw = text.encode()
                kept, at, removed, runs, end = [], 0, 0, 0, -1
                for s in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if s[0] > end:
                        kept.append(raw[at : s[0]])
                        runs, end, at = runs + 1, s[1], s[1]
                        removed += s[1] - s[0]
                    elif s[1] > end:
                        removed += s[1] - end
                        end = at = s[1]
                kept.append(raw[at:])
                out.append((doc_id, len(raw), removed, runs, shared, b"".join(kept)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_shared", "kept"])

    return rows.mapInArrow(take_out, "doc_id long, n_bytes long, n_removed long, n_spans long, n_shared long, kept binary")
