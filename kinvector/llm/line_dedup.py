"""Line dedup: repeated lines are found once, kept in a sharded minimal perfect hash
with fingerprint and count arrays, and documents probe the arrays.

1. Lines are split, folded and hashed as Arrow columns, here and in step 3 alike.
   Spark counts the documents of every distinct line hash (partial aggregation
   first, so a line held by a third of all documents is one row per task).
2. The hashes of lines in at least ``min_docs`` documents go to shards by hash;
   each shard becomes a minimal perfect hash (levels of bitmaps with ranks), a
   64-bit fingerprint array, a count array and the largest holder's id, written
   as one row of a shared table.
3. Documents probe the arrays. While the index is small (``HELD_SHARDS``), each
   task reads it once and keeps it while it streams its documents, so lines are
   not shuffled again. A larger index is not read by every task: line hashes are
   dealt to their shards instead, each shard is read by as many tasks as its lines
   need by their counts (so those of a very common line are split), and the places
   of lines that go are joined to their documents. Both ways give the same.

The number of shards follows the number of repeated lines, so a shard stays at
``shard_keys`` keys at any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinvector.llm.common import cut, mix, open_shared, set_aside, shared_dir, sliced

SPACE = " \t\n\x0b\x0c\r"
SHARD = "shard long, n long, salt long, sizes array<long>, bits binary, prints binary, counts binary, last binary"
HELD_SHARDS = 4
#: Lines that a task looks up in one shard of a large index, and shards whose table of tasks is broadcast.
TASK_LINES, BROADCAST_SHARDS = 2_000_000, 100_000


def key_column(lines):
    """Stripped, A-Z lower-cased lines of an Arrow column."""
    import pyarrow.compute as pc

    return pc.ascii_lower(pc.utf8_trim(lines, characters=SPACE))


def lines_of(texts):
    """(lines of each text of an Arrow column, where each text's lines begin among all of them and where the last ones end)."""
    import pyarrow.compute as pc

    lines = pc.split_pattern(texts.fill_null(""), "\n")
    return lines, np.concatenate([[0], np.cumsum(np.asarray(lines.value_lengths(), np.int64))])


def keyed_lines(lines, starts: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """(text, place in the text, hash, fingerprint) of each line whose key has ``min_chars`` or more."""
    import pyarrow as pa
    import pyarrow.compute as pc

    keys = key_column(lines.flatten())
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars))
    raw = keys.take(pa.array(at)).cast(pa.binary()).to_pylist()
    h = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in raw), np.uint64, len(raw))
    prints = np.fromiter((xxhash.xxh64_intdigest(b"\n" + k, 42) for k in raw), np.uint64, len(raw))
    row = np.searchsorted(starts, at, "right") - 1
    return row, at - starts[row], h, prints


def without(lines, starts: np.ndarray, row: np.ndarray, place: np.ndarray):
    """(texts without the lines that stand at these places, numbers of lines left out)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    stays, gone = np.ones(starts[-1], bool), np.bincount(row, minlength=len(lines))
    stays[starts[row] + place] = False
    starts = starts - np.concatenate([[0], np.cumsum(gone)])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), lines.flatten().filter(pa.array(stays))), "\n"), gone


def repeated(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h, print, n, last): hash and fingerprint of each repeated line, its documents and the largest id."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            row, _, h, prints = keyed_lines(*lines_of(batch.column("text")), min_chars)
            once = pa.table({"row": row, "h": h.view(np.int64), "print": prints.view(np.int64)}).group_by(["row", "h", "print"], use_threads=False).aggregate([]).combine_chunks()
            yield from once.set_column(0, "doc_id", batch.column("doc_id").take(once.column("row").combine_chunks())).to_batches()

    lines = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, print long")
    return lines.groupBy("h", "print").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)


def keyed(h: np.ndarray, prints: np.ndarray, salt: int = 0) -> np.ndarray:
    """The 64-bit key of each line."""
    return mix(h ^ mix(prints + np.uint64(salt)))


def positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray, gamma: float = 1.5) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits of a minimal perfect hash over distinct uint64 keys."""
    sizes, bits = [], []
    while len(keys):
        size = max(64, int(gamma * len(keys)) // 64 * 64 + 64)
        at = positions(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        keys = keys[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def probe_mph(keys: np.ndarray, sizes, bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Index of each key, or -1 where no level holds it."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = base + positions(keys[left], level, size)
        hit = bits[at]
        out[left[hit]] = ranks[at[hit]]
        left, base = left[~hit], base + size
    return out


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's arrays; another salt is taken where two lines share their keys."""
    h, p = (pdf[c].to_numpy().view(np.uint64) for c in ("h", "print"))
    salt = 0
    while len(np.unique(keys := keyed(h, p, salt))) < len(keys):
        salt += 1
    sizes, bits = build_mph(keys)
    at = probe_mph(keys, sizes, bits, np.cumsum(bits) - 1)
    prints, counts, last = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
    prints[at], counts[at], last[at] = pdf["print"], np.minimum(pdf["n"], 2**32 - 1), pdf["last"].fillna(-(2**63)).astype("int64")
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(keys)], "salt": [salt], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "last": [last.tobytes()]})


class Shard:
    """A shard's arrays, ready to be probed."""

    def __init__(self, row: dict):
        self.salt, self.sizes = row["salt"], row["sizes"]
        self.bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(self.sizes)].astype(bool)
        self.ranks = np.cumsum(self.bits, dtype=np.int32) - np.int32(1)
        self.prints, self.counts, self.last = np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["last"], np.int64)

    def dropped(self, h: np.ndarray, prints: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which lines are held by ``min_docs`` documents or more and another one is the last."""
        at = probe_mph(keyed(h, prints, self.salt), self.sizes, self.bits, self.ranks)
        ok = np.flatnonzero(at >= 0)
        ok = ok[(self.prints[at[ok]] == prints[ok]) & (self.counts[at[ok]] >= min_docs)]
        out = np.zeros(len(h), bool)
        out[ok] = self.last[at[ok]] != ids[ok]
        return out


def shards(root: str, wanted: int | None = None):
    """Each shard of the index in turn, or the one that is wanted."""
    import pyarrow.parquet as pq

    fs, path = open_shared(root)
    from pyarrow.fs import FileSelector

    for info in sorted(fs.get_file_info(FileSelector(path)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                file = pq.ParquetFile(f)
                if wanted is None or wanted in file.read(columns=["shard"]).column(0).to_pylist():
                    for batch in file.iter_batches(batch_size=1):
                        yield from (x for x in batch.to_pylist() if wanted in (None, x["shard"]))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 500_000) -> DataFrame:
    """Documents without the lines found in ``min_docs`` documents or more.

    A line's key is the line stripped of blanks with A-Z lower-cased; keys of
    fewer than ``min_chars`` code points are left alone. The largest doc_id that
    holds a key keeps its lines. Returns the columns of ``docs`` with the new
    ``text``, and n_lines, n_dropped.

    Defined cases: a null or empty text is one empty line and becomes ''; rows
    with one doc_id count as separate documents, and each row with the largest
    id keeps its lines; a null doc_id is below all others; an empty table gives
    an empty table. Columns of ``docs`` named n_lines or n_dropped are replaced;
    others may have any name.
    """
    added = ("n_lines", "n_dropped")
    return set_aside(docs.drop(*added), ("doc_id", "text"), lambda held: without_lines(held, min_chars, min_docs, shard_keys), added)


def without_lines(docs: DataFrame, min_chars: int, min_docs: int, shard_keys: int) -> DataFrame:
    """As ``line_dedup``, of a table whose column names are known."""
    spark = docs.sparkSession
    found = cut(repeated(docs, min_chars, min_docs))
    n = found.count()
    n_shards = max(1, -(-n // shard_keys))
    root = shared_dir(spark)
    found.withColumn("shard", shard_of(n_shards)).groupBy("shard").applyInPandas(build_shard, SHARD).write.parquet(root)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at_text, place = docs.columns.index("text"), len(docs.columns)
    if n_shards > HELD_SHARDS:
        lines = routed(docs, found, root, n_shards, min_chars, min_docs).alias("r")
        docs = docs.alias("d").join(lines, F.col("d.doc_id").eqNullSafe(F.col("r._d")) & (F.xxhash64("d.text") == F.col("r._t")), "left").select("d.*", "r._gone")

    def lines_gone(lines, starts, ids, index):
        """Texts and places of the lines that the index drops."""
        row, where, h, p = keyed_lines(lines, starts, min_chars)
        drop = np.zeros(len(h), bool)
        for s in index if len(h) else ():
            drop |= s.dropped(h, p, ids[row], min_docs)
        return row[drop], where[drop]

    def probe(batches):
        import pyarrow as pa

        index = [Shard(x) for x in shards(root)] if n and n_shards <= HELD_SHARDS else []
        for batch in sliced(batches):
            lines, starts = lines_of(batch.column(at_text))
            if n_shards > HELD_SHARDS:
                found_gone = batch.column(place)
                gone = np.repeat(np.arange(batch.num_rows), found_gone.value_lengths().fill_null(0)), np.asarray(found_gone.flatten())
            else:
                gone = lines_gone(lines, starts, np.asarray(batch.column("doc_id").cast(pa.int64()).fill_null(-(2**63))), index)
            text, n_gone = without(lines, starts, *gone)
            columns = [text if i == at_text else c for i, c in enumerate(batch.columns[:place])]
            yield pa.RecordBatch.from_arrays([*columns, lines.value_lengths().cast(pa.int64()), pa.array(n_gone, pa.int64())], names=schema.names)

    return docs.mapInArrow(probe, schema)


def shard_of(n_shards: int):
    return F.pmod(F.xxhash64(F.lit("shard"), "h", "print"), F.lit(n_shards))


def tasks_of(found: DataFrame, n_shards: int) -> DataFrame:
    """(_shard, tasks): over how many tasks the lines of each shard are dealt, by the documents that hold its repeated lines."""
    return found.groupBy(shard_of(n_shards).alias("_shard")).agg(F.ceil(F.sum("n") / TASK_LINES).alias("tasks"))


def routed(docs: DataFrame, found: DataFrame, root: str, n_shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """(_d, _t, _gone): places of the lines that go, by doc_id and hash of the text.

    Lines that are not repeated are spread over the shards by hash; those that
    are count for the tasks of their shard.
    """

    def hashed(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            row, where, h, p = keyed_lines(*lines_of(batch.column("text")), min_chars)
            own = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(where, pa.int32()), pa.array(h.view(np.int64)), pa.array(p.view(np.int64))], names=["doc_id", "th", "j", "h", "print"])

    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(hashed, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, j int, h long, print long").withColumn("shard", shard_of(n_shards))

    def probe(batches):
        import pyarrow as pa

        now, shard = None, None
        for batch in sliced(batches, 20_000):
            at = np.asarray(batch.column("shard"))
            ids = np.asarray(batch.column("doc_id").fill_null(-(2**63)))
            h, p = (np.asarray(batch.column(c)).view(np.uint64) for c in ("h", "print"))
            drop = np.zeros(len(at), bool)
            for one in np.unique(at).tolist():
                if one != now:
                    now, shard = one, next((Shard(x) for x in shards(root, one)), None)
                mine = np.flatnonzero(at == one)
                if shard is not None:
                    drop[mine] = shard.dropped(h[mine], p[mine], ids[mine], min_docs)
            yield batch.select(["doc_id", "th", "j"]).filter(pa.array(drop))

    tasks = cut(tasks_of(found, n_shards))
    lines = lines.join(F.broadcast(tasks) if n_shards <= BROADCAST_SHARDS else tasks, F.col("shard") == F.col("_shard"), "left")
    lines = lines.repartition("shard", F.pmod(F.xxhash64("doc_id", "th"), F.coalesce("tasks", F.lit(1)))).sortWithinPartitions("shard").drop("_shard", "tasks")
    gone = lines.mapInArrow(probe, "doc_id long, th long, j int")
    return gone.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set("j").alias("_gone"))
