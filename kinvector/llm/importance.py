"""Target-distribution importance resampling over hashed word n-grams.

Features are runs of one to ``order`` words. Every task keeps an integer
dictionary of the words that it meets, so a run of words is a tuple of ids; a
tuple of more than one id is again an id (of its beginning) and a word's id,
packed into 64 bits. Distinct tuples of a slice of texts are found by sorting
integers; the bytes of each are put together and hashed once, and the buckets
are joined back to all places of the tuple.

Only sums leave the tasks: ``buckets`` counts of each task for the corpus and
for the target, and then a few numbers of each document. Words are not shuffled
and a dictionary never outgrows ``MOST_WORDS``; ids mean nothing outside a task.

Documents are drawn by the Gumbel-top-k rule: weight and noise of a hash are
added up, and the highest scores are numbered by ranges of the score.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvector.llm.common import blocks, cut, set_aside, sliced
from kinvector.operators.scan import numbered

#: A-Z in lower case; all but digits, letters and bytes of code points beyond ASCII become blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MOST_WORDS = 400_000
SLICE_BYTES = 6_000_000


class Words(dict):
    """Ids of words in the order in which they came."""

    def __init__(self):
        super().__init__()
        self.words = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def buckets_of(texts: list[bytes], order: int, buckets: int, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; of every feature the number of its text and its bucket)."""
    lists = [t.translate(FOLD).split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    ids = np.fromiter(map(words.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
    of, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
    texts_of, found = [], []
    gram, raw = ids, words.words  # the tuple that begins at each word: its id, and the bytes of each id
    for n in range(1, order + 1):
        if n > 1:
            at = np.flatnonzero(left >= n)
            tuples, gram_at = np.unique(gram[at] << 32 | ids[at + n - 1], return_inverse=True)
            raw = [raw[a] + b" " + words.words[b] for a, b in zip((tuples >> 32).tolist(), (tuples & 0xFFFFFFFF).tolist())]
            gram = np.zeros(len(ids), np.int64)
            gram[at] = gram_at
            hashed = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % buckets
            texts_of.append(of[at]), found.append(hashed[gram_at])
        else:
            here, at = np.unique(ids, return_inverse=True)
            hashed = np.fromiter((zlib.crc32(raw[i]) for i in here.tolist()), np.int64, len(here)) % buckets
            texts_of.append(of), found.append(hashed[at])
    return sizes, np.concatenate(texts_of), np.concatenate(found)


def slices(batches, column: str):
    """(rows of a batch, their texts as bytes) of bounded size; a null text is empty."""
    import pyarrow as pa

    for batch in sliced(batches):
        texts = batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()
        at = 0
        for some in blocks(texts, len, SLICE_BYTES):
            yield batch.slice(at, len(some)), some
            at += len(some)


def counted(docs: DataFrame, order: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; the driver gets one row for each bucket."""

    def count(batches):
        import pyarrow as pa

        words, total = Words(), np.zeros(buckets, np.int64)
        for _, texts in slices(batches, "text"):
            words = words if len(words) < MOST_WORDS else Words()
            total += np.bincount(buckets_of(texts, order, buckets, words)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed likelihood ratio of each bucket, rounded down."""
    n = len(corpus)
    many, few = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1) * many / ((s + 1) * few))) for s, t in zip(map(float, corpus), map(float, target))], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, order: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; ``weight`` is the mean gain, rounded down."""

    def weigh(batches):
        import pyarrow as pa

        words = Words()
        for rows, texts in slices(batches, "text"):
            words = words if len(words) < MOST_WORDS else Words()
            sizes, of, found = buckets_of(texts, order, len(gain), words)
            n = np.bincount(of, minlength=len(texts))
            sums = np.zeros(len(texts), np.int64)
            ends = np.flatnonzero(np.diff(of, append=-1))  # features come text by text, once for each length
            total = np.cumsum(gain[found])[ends]
            np.add.at(sums, of[ends], np.diff(total, prepend=0))
            weight = sums // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, (sizes, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int):
    """Thousandths of Gumbel noise from a hash of the id, rounded down; a null id is written as nothing."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance(docs: DataFrame, target: DataFrame, order: int = 2, buckets: int = 10_000, share: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; documents with a rank are drawn.

    Of the documents with ``least_words`` words or more, ``share`` per cent
    (rounded down) are drawn without replacement, in proportion to how much
    likelier their features are in the texts of ``target`` than in ``docs``.

    Defined cases: a null or empty text has no features and weight 0; an empty
    ``target`` or table of documents counts as no features; rows that share a
    doc_id get the same noise and a rank each; equal scores are ordered by
    doc_id, null first; only the columns doc_id and text are read, so others may have any name.
    """
    gain = gains(counted(docs, order, buckets), counted(target, order, buckets))
    rows = cut(weighted(docs, gain, order).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = rows.where(F.col("n_words") >= least_words)
    wanted = able.count() * share // 100
    ranked = numbered(able, [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")], name="rank")
    rank = F.when(F.col("rank") < wanted, F.col("rank") + 1)
    return ranked.withColumn("rank", rank).unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents with the columns of ``docs``; rows that share a doc_id come or go together (all come if one is drawn)."""
    ids = importance(docs, target, **settings).where("rank is not null").select(F.col("doc_id").alias("_d")).distinct()
    return set_aside(docs, ("doc_id", "text"), lambda held: held.join(ids, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi"))
