"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order:

    block*   entries of about 64 KB; an entry is the number of leading key bytes
             it shares with the entry before it, the other key bytes, the number
             of ids and the ids; a crc32 ends the block
    index    first key, offset and size of each block
    bloom    bits of a Bloom filter over the keys
    footer   fixed size: places of index and bloom, counts, id size, magic

Spark deals the documents by ranges of doc_id and of what their texts begin with; each task streams its range into
one file of the shared folder, under a name of its own that is listed only if
the task ends well, so lost executors and repeated attempts leave no trace in
the table of shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinvector.llm.common import blocks, cut, mix, open_shared, shared_dir, sliced
from kinvector.llm.tokens import encoder

MAGIC = b"KVSSTAB1"
FOOTER = "<QQQQQQHH8s"  # index at, index size, bloom at, bloom size, documents, ids, id size, probes, magic
ENTRY = "<BBI"
INDEX = "<9sQI"
#: Code points of a text by which documents that share a doc_id are dealt to shards.
HEAD = 32
SHARD = "shard int, path string, n_docs long, n_ids long"


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes whose order is that of the ids, null first."""
    return bytes(9) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - 2**63 if key[0] else None


def bloom_places(keys: np.ndarray, n_bits: int, probes: int) -> np.ndarray:
    a, b = mix(keys), mix(keys ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(n_bits) for i in range(probes)])


class Writer:
    """Streams (doc_id, ids) in ascending order into one file."""

    def __init__(self, sink, id_size: int, block_size: int = 65536, bits_per_key: int = 10, probes: int = 7):
        self.sink, self.id_size, self.block_size, self.bits, self.probes = sink, id_size, block_size, bits_per_key, probes
        self.at = self.n_ids = 0
        self.keys, self.index, self.block, self.last, self.size = [], [], [], b"", 0

    def add(self, doc_id: int | None, ids: np.ndarray):
        key = key_of(doc_id)
        if not self.block:
            self.first, self.last = key, b""
        shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), min(len(key), len(self.last)))
        entry = struct.pack(ENTRY, shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype(f"<u{self.id_size}").tobytes()
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(0 if doc_id is None else (doc_id + 2**63) % 2**64)
        self.n_ids += len(ids)
        if self.size >= self.block_size:
            self.flush()

    def flush(self):
        if self.block:
            raw = b"".join(self.block)
            self.index.append(struct.pack(INDEX, self.first, self.at, len(raw) + 4))
            self.sink.write(raw + struct.pack("<I", zlib.crc32(raw)))
            self.at += len(raw) + 4
            self.block, self.size = [], 0

    def close(self):
        self.flush()
        index = b"".join(self.index)
        n_bits = max(64, -(-len(self.keys) * self.bits // 64) * 64)
        bits = np.zeros(n_bits, bool)
        bits[bloom_places(np.array(self.keys, np.uint64), n_bits, self.probes).astype(np.int64).ravel()] = True
        bloom = np.packbits(bits).tobytes()
        footer = struct.pack(FOOTER, self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.n_ids, self.id_size, self.probes, MAGIC)
        self.sink.write(index + bloom + footer)
        self.sink.close()


class Reader:
    """One shard file: iteration in order, and lookup by binary search."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - struct.calcsize(FOOTER))
        at, size, bloom_at, bloom_size, self.n_docs, self.n_ids, self.id_size, self.probes, magic = struct.unpack(FOOTER, source.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        source.seek(at)
        self.index = list(struct.iter_unpack(INDEX, source.read(size)))
        self.bloom_at, self.bloom_size = bloom_at, bloom_size

    def entries(self, place):
        _, at, size = place
        self.source.seek(at)
        raw = self.source.read(size)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        p, key = 0, b""
        while p < size - 4:
            shared, own, n = struct.unpack_from(ENTRY, raw, p)
            p += struct.calcsize(ENTRY)
            key = key[:shared] + raw[p : p + own]
            p += own
            yield key, np.frombuffer(raw, f"<u{self.id_size}", n, p)
            p += n * self.id_size

    def __iter__(self):
        for place in self.index:
            for key, ids in self.entries(place):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document stored under the key."""
        self.source.seek(self.bloom_at)
        bits = np.unpackbits(np.frombuffer(self.source.read(self.bloom_size), np.uint8))
        places = bloom_places(np.array([0 if doc_id is None else (doc_id + 2**63) % 2**64], np.uint64), len(bits), self.probes)
        if not bits[places.astype(np.int64)].all():
            return []
        key, low, high = key_of(doc_id), 0, len(self.index)
        while low < high:  # the first block that starts at the key or after it
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.index[middle][0] < key else (low, middle)
        found = []
        for place in self.index[max(0, low - 1) :]:
            if place[0] > key:
                break
            found += [ids for k, ids in self.entries(place) if k == key]
        return found


def write_shards(docs: DataFrame, tokenizer: str, keeps_blanks: bool = True, root: str | None = None, shards: int | None = None, most_words: int = 1_200_000) -> DataFrame:
    """Encodes documents into shard files below ``root``; one row per shard: shard, path, n_docs, n_ids.

    Shards are ranges of doc_id, as many as the input has partitions, so a
    shard's size does not grow with the table. ``most_words`` bounds the table of
    words in each Python worker (see ``packing.pieces_of``).

    Defined cases: a null or empty text is the end id alone; null ids come first;
    rows that share a doc_id keep an entry each, side by side, by their texts, and
    may stand in several shards; a shard without documents has no
    file, so an empty table has none; only doc_id and text are read, so other
    columns may have any name.
    """
    spark = docs.sparkSession
    root = root or shared_dir(spark)
    shards = shards or max(1, docs.rdd.getNumPartitions())
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.substring("text", 1, HEAD)).repartitionByRange(shards, "doc_id", "head").sortWithinPartitions("doc_id", "text").drop("head")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        mine = encoder(tokenizer, keeps_blanks, most_words)
        id_size = 2 if mine.tokenizer.get_vocab_size() <= 65536 else 4
        fs, folder = open_shared(root)
        fs.create_dir(folder, recursive=True)
        writer = None
        for batch in sliced(batches, keep=True):
            pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            for some in blocks(pairs, lambda r: len(r[1]), 4_000_000):
                if writer is None:
                    path = f"{folder}/{uuid.uuid4().hex}.sst"
                    writer = Writer(fs.open_output_stream(path), id_size)
                for (doc_id, _), ids in zip(some, mine.encode([t for _, t in some])):
                    writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            row = [TaskContext.get().partitionId()], [path.rpartition("/")[2]], [len(writer.keys)], [writer.n_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "path", "n_docs", "n_ids"])

    done = cut(rows.mapInArrow(write, SHARD))
    return done.withColumn("path", F.concat(F.lit(f"{root}/"), "path"))


def read_shards(shards: DataFrame, digest) -> DataFrame:
    """Reads shard files back: doc_id, start, n_tokens and ``digest(ids)`` as ids_crc32 per document.

    ``start`` counts the ids of all documents before it, over all shards. Shards
    without files are no rows, so an empty table of shards gives no documents.
    """
    start = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")  # a row per shard, not per document
    places = shards.select("path", start.alias("start"), "shard")

    def read(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, name = open_shared(path)
                with fs.open_input_file(name) as source:
                    out = []
                    for doc_id, ids in Reader(source):
                        out.append((doc_id, start, len(ids), digest(ids)))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    n = max(1, shards.count())
    return places.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
