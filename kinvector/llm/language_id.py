"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all labelled training rows in Spark. The
classifier itself is fitted on a bounded sample of them (``sample_per_lang``
rows of each language, chosen by a hash of the id), by follow-the-regularised-
leader with L1 and L2 penalties in one task whose size that bound fixes; a
fifth of the sample is set aside to fit the temperature. Prediction reads every
whole text once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinvector.llm.common import cut, set_aside, sliced

BITS = 15
SAMPLE = "lang string, h long, cols array<int>, counts array<int>"
UNKNOWN = "und"


def letters() -> np.ndarray:
    """Which code points of the basic plane are letters; others are taken as letters by str.isalpha."""
    return np.array([chr(i).isalpha() for i in range(65536)])


def ngrams(text: str, is_letter: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of the 1- to 3-grams of lower-cased words; None without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(c, 65535)
    ok = is_letter[low]
    if (high := np.flatnonzero(c > 65535)).size:
        ok = ok.copy()
        ok[high] = [chr(i).isalpha() for i in c[high].tolist()]
    if not ok.any():
        return None
    c = np.where(ok, c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = ok[1:] | ok[:-1]
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
    shift = np.uint32(32 - bits)
    counts = np.bincount(np.concatenate([one >> shift, (two * np.uint32(0x27D4EB2F)) >> shift, (three * np.uint32(0x165667B1)) >> shift]), minlength=1 << bits)
    cols = np.flatnonzero(counts)
    return cols, counts[cols]


def weigh(cols: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of length one."""
    x = (1 + np.log(counts)) * idf[cols]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows, n_classes: int, size: int, alpha=1.0, beta=1.0, l1=1e-3, l2=1e-4, epochs=3) -> np.ndarray:
    """Weights [size + 1, classes], the last row the bias, from (cols, values, class) rows."""
    z, n, w = (np.zeros((size + 1, n_classes)) for _ in range(3))
    for _ in range(epochs):
        for cols, x, y in rows:
            at, v = np.append(cols, size), np.append(x, 1.0)
            p = softmax(v @ w[at])
            p[y] -= 1
            g = v[:, None] * p
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w[at]
            n[at] = new
            zz = z[at]
            w[at] = np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(new)) / alpha + l2))
    return w


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    low, high, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learn(train: DataFrame, sample_per_lang: int) -> dict:
    """Model from rows with doc_id, text and a non-null lang."""
    spark = train.sparkSession
    size = 1 << BITS
    langs = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    names = sorted(langs)
    if not names:
        return {"names": []}

    def frequencies(batches):
        import pyarrow as pa

        table, df, n = letters(), np.zeros(size, np.int64), 0
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                n += 1
                if text and (found := ngrams(text, table)):
                    df[found[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["bucket", "df"])

    df = np.zeros(size)
    n = 1
    for r in train.select("text").mapInArrow(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():  # a row per bucket
        if r["bucket"] < 0:
            n = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    idf = np.log((1 + n) / (1 + df)) + 1

    def sample(batches):
        import pyarrow as pa

        table = letters()
        for batch in sliced(batches):
            rows = zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), batch.column("text").to_pylist())
            out = [(lang, h, *found) for lang, h, text in rows if text and (found := ngrams(text, table))]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["lang", "h", "cols", "counts"])

    share = F.create_map(*[F.lit(x) for lang, count in langs.items() for x in (lang, min(1.0, sample_per_lang / count))])
    h = F.xxhash64(F.lit("sample"), "doc_id", F.substring("text", 1, 64))
    chosen = train.withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30))
    chosen = cut(chosen.select("lang", "h", "text").mapInArrow(sample, SAMPLE))

    def fit(batches):
        import pyarrow as pa

        rows = []
        for batch in sliced(batches):
            cols, counts = (np.array(batch.column(c).flatten(), np.int32) for c in (2, 3))
            ends = np.cumsum(np.asarray(batch.column(2).value_lengths())).tolist()
            for lang, h, i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [0, *ends], ends):
                rows.append((h, names.index(lang), cols[i:j], weigh(cols[i:j], counts[i:j], idf).astype(np.float32)))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        fold = [h % 5 == 0 and len(rows) >= 50 for h, *_ in rows]
        w = fit_ftrl([(c, x, y) for (_, y, c, x), f in zip(rows, fold) if not f], len(names), size)
        logits = np.array([np.append(x, 1.0) @ w[np.append(c, size)] for (_, y, c, x), f in zip(rows, fold) if f]).reshape(-1, len(names))
        t = fit_temperature(logits, np.array([y for (_, y, *_), f in zip(rows, fold) if f], int))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([t])], names=["w", "t"])

    model = chosen.repartition(1).mapInArrow(fit, "w binary, t double").first()
    return {"names": names, "idf": idf, "w": np.frombuffer(model["w"], np.float32).reshape(size + 1, len(names)), "t": model["t"]}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred and score."""
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent, at_text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        m, table = sent.value, letters()
        for batch in sliced(batches):
            names, scores = [], []
            for text in batch.column(at_text).to_pylist():
                found = ngrams(text, table) if text and m["names"] else None
                if found is None:
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                p = softmax((weigh(*found, m["idf"]) @ m["w"][found[0]] + m["w"][-1]) / m["t"])
                names.append(m["names"][int(p.argmax())]), scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out():
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, sample_per_lang: int = 1500) -> DataFrame:
    """``docs`` with lang_pred, score (calibrated probability) and held_out.

    Learns from text and lang of labelled documents outside the held-out third;
    ``sample_per_lang`` bounds the rows that the classifier is fitted on, and
    document frequencies cover all of them. Predictions use the text alone.

    Defined cases: a null text or one without a letter is ``und`` with score 0,
    and so is every text if no row is labelled; of equal probabilities the first
    name by order is taken; a null doc_id is not held out;
    repeated rows are predicted each; an empty table gives no rows. Columns of
    ``docs`` named lang_pred, score or held_out are replaced; others may have any name.
    """

    def told(held):
        held = held.withColumn("held_out", held_out())
        train = held.where(~F.col("held_out") & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
        return predict(held, learn(train, sample_per_lang))

    added = ("held_out", "lang_pred", "score")
    return set_aside(docs.drop(*added), ("doc_id", "text", "lang"), told, added)
