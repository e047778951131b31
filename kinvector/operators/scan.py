"""Numbering, running sums and carried values in an order, without a window over a whole group.

A window partitioned by a camera has as many tasks as there are cameras; one
without a partition has a single task. Here rows are dealt by ranges of the
order instead, so a group that holds a third of all rows is spread over many
tasks. Every range sums up what it holds (a row for each group and range); the
sums before a range are its offset, and what is left to do lies inside the range.

Windows that look back a bounded number of rows need no offset: each block of
neighbouring rows gets the last rows of the block before it (``with_halo``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinvector.sources.shared import written

BLOCK = 10_000


def _joined(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``few``; null keys are equal."""
    few = few.select(*[F.col(k).alias(f"_{k}_few") for k in keys], *[c for c in few.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}_few")) for k in keys])
    return rows.join(few, on, "left").drop(*[f"_{k}_few" for k in keys])


def numbered(rows: DataFrame, order: list[Column | str], by: list[str] | tuple = (), name: str = "place") -> DataFrame:
    """``rows`` with the column ``name``: their number in the order within their group, from 0, gapless.

    ``order`` should tell rows apart; rows that it doesn't are numbered in any
    order. Null group keys are one group; an empty table gives no rows. Columns
    named _id, _block, _at and _shift are not taken.
    """
    own, by = rows.columns, list(by)
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    held = written(dealt.withColumn("_id", F.monotonically_increasing_id()))  # the range, and the place in it
    held = held.select(*own, F.shiftright("_id", 33).alias("_block"), F.col("_id").bitwiseAND(F.lit(2**33 - 1)).alias("_at"))
    parts = held.groupBy(*by, "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select(*by, "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return _joined(held, parts, [*by, "_block"]).select(*own, (F.col("_at") + F.col("_shift")).alias(name))


def _blocks(rows: DataFrame, place: str, block: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col(place) / block))


def running_sum(rows: DataFrame, values: dict[str, Column], by: list[str] | tuple = (), place: str = "place", block: int = BLOCK) -> DataFrame:
    """``rows`` of ``numbered`` with the sums of ``values`` over all rows of their group up to them."""
    by = list(by)
    held = _blocks(rows.withColumns({f"_v_{n}": v for n, v in values.items()}), place, block)
    parts = held.groupBy(*by, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_block", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values])
    inside = Window.partitionBy(*by, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumns({f"_v_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    return _joined(held, parts, [*by, "_block"]).select(*rows.columns, *[(F.col(f"_v_{n}") + F.col(f"_s_{n}")).alias(n) for n in values])


def carried(rows: DataFrame, value: str, by: list[str] | tuple = (), place: str = "place", block: int = BLOCK) -> DataFrame:
    """``rows`` of ``numbered`` whose nulls in ``value`` are replaced by the last value before them, if there is any."""
    by = list(by)
    held = _blocks(rows, place, block)
    parts = held.groupBy(*by, "_block").agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(place))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_block", F.last("_last", ignorenulls=True).over(before).alias("_held"))
    inside = Window.partitionBy(*by, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn(value, F.last(value, ignorenulls=True).over(inside))
    return _joined(held, parts, [*by, "_block"]).select(*[F.coalesce(value, "_held").alias(value) if c == value else F.col(c) for c in rows.columns])


def with_halo(rows: DataFrame, reach: int, place: str = "place", block: int = BLOCK) -> DataFrame:
    """``rows`` of ``numbered`` with _block and _halo: each block also holds, marked, the ``reach`` rows before it.

    A window partitioned by the group and _block and ordered by ``place`` that
    looks back at most ``reach`` rows is right for all rows without the mark.
    """
    if reach > block:
        raise ValueError("a block holds fewer rows than the window looks back")
    at = F.floor(F.col(place) / block)
    late = F.col(place) % block >= block - reach
    copies = F.when(late, F.array(F.struct(at.alias("b"), F.lit(False).alias("h")), F.struct((at + 1).alias("b"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(at.alias("b"), F.lit(False).alias("h"))))
    return rows.withColumn("_c", F.explode(copies)).select(*rows.columns, F.col("_c.b").alias("_block"), F.col("_c.h").alias("_halo"))
