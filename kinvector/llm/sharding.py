"""Sharding along a Hilbert curve over document metadata, with DataFrame operations only.

Each dimension is cut into 2^bits cells of about equally many rows, whatever
its type; the cells of a row are a point of a grid, and its place on the
Hilbert curve through the grid is the key by which rows are ordered. Rows that
are near in every dimension are near on the curve, so a run of the curve spans
a small range of each of them, and the ranges of a file's columns tell most
files apart from a question. Runs are cut so that all shards hold as many rows,
or as many bytes.

Rows are ordered without their texts and numbered by ranges (``scan``), so a
cell that holds a third of all rows is spread over many tasks: within it, rows
are ordered by the checksum of the text, then by id, so equal texts are neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinvector.llm.common import bound, cut
from kinvector.operators.scan import numbered, running_sum

BITS = 5
DIMENSIONS = ("source", "lang", "size")
LAWS = ("rows", "bytes")


def edges(rows: DataFrame, name: str, bits: int, total: int) -> list[tuple[int, object]]:
    """(cell, least value) of the cells of a column, 2^bits at most, by rows below a value; a value lies in one cell."""
    values = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    summed = running_sum(numbered(values, [name]), {"upto": F.col("n")})
    nulls = F.lit(rows.where(F.col(name).isNull()).count())
    cell = F.floor((nulls + F.col("upto") - F.col("n")) * 2**bits / F.lit(max(total, 1))).cast("int")
    return [(r["cell"], r["low"]) for r in summed.groupBy(cell.alias("cell")).agg(F.min(name).alias("low")).orderBy("cell").collect()]


def cell_of(value: Column, cells: list[tuple[int, object]]) -> Column:
    """The cell of a value; nulls lie in the first."""
    return F.coalesce(*[F.when(value >= F.lit(low), F.lit(cell)) for cell, low in reversed(cells)], F.lit(0))


def curve(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point of a grid with 2^bits cells a side.

    Coordinates are turned and mirrored level by level, the coarsest first, then
    written as a Gray code whose bits are taken in turn from all of them.
    """
    n = len(cells)

    def turned(x, step):
        low = step["q"] - 1
        hit = x[step["i"]].bitwiseAND(step["q"]) != 0
        swap = F.when(hit, F.lit(0)).otherwise(x[0].bitwiseXOR(x[step["i"]]).bitwiseAND(low))
        mirror = F.when(hit, low).otherwise(F.lit(0))
        return bound(F.struct(swap.alias("s"), mirror.alias("m")), lambda b: F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(b["s"].bitwiseXOR(b["m"]))).when(j == step["i"], v.bitwiseXOR(b["s"])).otherwise(v)))

    def written(gray):
        flip = F.lit(0)
        for k in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(gray[n - 1].bitwiseAND(F.lit(1 << k)) != 0, F.lit((1 << k) - 1)).otherwise(F.lit(0)))
        return bound(flip, lambda t: sum((F.shiftright(gray[i].bitwiseXOR(t), k).bitwiseAND(F.lit(1)).cast("long") * F.lit(1 << (k * n + n - 1 - i)) for k in range(bits) for i in range(n)), F.lit(0).cast("long")))

    steps = [F.struct(F.lit(1 << k).alias("q"), F.lit(i).alias("i")) for k in range(bits - 1, 0, -1) for i in range(n)]
    point = F.array(*[c.cast("int") for c in cells])
    if steps:
        point = F.aggregate(F.array(*steps), point, turned)
    none = F.array().cast("array<int>")
    gray = bound(point, lambda x: F.aggregate(x, none, lambda s, v: F.concat(s, F.array(F.when(F.size(s) > 0, F.element_at(s, -1)).otherwise(F.lit(0)).bitwiseXOR(v)))))
    return bound(gray, written)


def measured(docs: DataFrame, dimensions: tuple[str, ...], *more: Column) -> DataFrame:
    """doc_id, size, text_crc32, dimension i as d<i>, and ``more``, written once."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    named = [F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions) if d != "size"]
    rows = cut(docs.select("doc_id", (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32"), *named, *more))
    return rows.select("*", *[F.col("size").alias(f"d{i}") for i, d in enumerate(dimensions) if d == "size"])


def dealt(rows: DataFrame, shards: int, dimensions: tuple[str, ...], bits: int, law: str) -> DataFrame:
    """``rows`` of ``measured`` with hilbert, shard and slot."""
    if law not in LAWS:
        raise ValueError(f"unknown law: {law}")
    total, heavy = rows.agg(F.count("*"), F.sum("size")).first()
    cells = [cell_of(F.col(f"d{i}"), edges(rows, f"d{i}", bits, total)) for i in range(len(dimensions))]
    rows = numbered(rows.withColumn("hilbert", curve(cells, bits)), ["hilbert", "text_crc32", "size", "doc_id"])
    if law == "rows":
        begins = lambda s: F.floor((s * F.lit(total) + (shards - 1)) / shards)
        rows = rows.withColumn("shard", F.floor(F.col("place") * shards / F.lit(max(total, 1))).cast("int"))
        return rows.withColumn("slot", F.col("place") - begins(F.col("shard").cast("long"))).drop("place")
    rows = running_sum(rows, {"upto": F.col("size")}).withColumn("shard", F.floor((F.col("upto") - F.col("size")) * shards / F.lit(heavy or 1)).cast("int"))
    first = rows.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return rows.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("first")).drop("place", "first", "upto")


def sharded(docs: DataFrame, shards: int = 40, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, law: str = "rows") -> DataFrame:
    """doc_id, size, text_crc32, the dimensions, hilbert (place on the curve), law, shard and slot (gapless from 0) of every document.

    ``size`` is the UTF-8 length of the text and 16. By the law ``rows`` the
    shards' counts are at most one apart; by ``bytes`` a shard begins where the
    sizes before it reach its share of all. Dimensions are columns of ``docs``
    that can be ordered, or size.

    Defined cases: a null text has no bytes; a null dimension lies in the first
    cell; equal texts are neighbours among the rows of one place on the curve;
    repeated rows get a slot each; an empty table gives no rows; columns that are
    no dimension are not read, so they may have any name.
    """
    rows = dealt(measured(docs, dimensions), shards, dimensions, bits, law)
    names = [F.col(f"d{i}").alias(d) for i, d in enumerate(dimensions) if d != "size"]
    return rows.select("doc_id", "size", "text_crc32", *names, "hilbert", F.lit(law).alias("law"), "shard", "slot")


def write_files(docs: DataFrame, root: str, shards: int = 40, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, law: str = "rows") -> DataFrame:
    """Writes the documents with size and slot below ``root``, a folder for each shard, and returns the manifest of the files.

    A task holds a run of the curve, so a shard of many rows has several files,
    each a run of its slots. Cases are those of ``sharded``; a column of ``docs``
    named size, shard or slot is replaced.
    """
    docs = docs.drop("shard", "slot", *({"size"} - set(dimensions)))
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "size"]).alias("row")
    rows = dealt(measured(docs, dimensions, row), shards, dimensions, bits, law)
    rows.select("row.*", "size", "shard", "slot").write.partitionBy("shard").parquet(root)
    return manifest(docs.sparkSession.read.parquet(root), dimensions)


def manifest(files: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(file, rows, and the least and largest value of every dimension) of written shards."""
    ranges = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return files.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *ranges)


def pruned(files: DataFrame, **ranges: tuple) -> DataFrame:
    """Files of a manifest that may hold rows with each named dimension between two values."""
    for d, (low, high) in ranges.items():
        files = files.where((F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high)))
    return files
