"""Joins of overlapping boxes."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvector.operators.retrieval import BLOCK_ROWS, SCORES, homes, itself, met, tiles_inside
from kinvector.sources.shared import written

CORNERS = ("x1", "y1", "x2", "y2")


def beside(least: float):
    """Pieces of a tile that hold all its pairs of an overlap above ``least``: the left sides of such boxes are near each other."""

    def pieces(left, right, key):
        same = right is left
        right = {c: x[np.argsort(right["v"][:, 0], kind="stable")] for c, x in right.items()}
        left = right if same else {c: x[np.argsort(left["v"][:, 0], kind="stable")] for c, x in left.items()}
        left, right = ({**side, "at": np.arange(len(side["id"]))} for side in (left, right))
        x = right["v"][:, 0]
        reach = (1 - max(0.0, least)) * max(0.0, *((s["v"][:, 2] - s["v"][:, 0]).max() for s in (left, right))) * (1 + 1e-9) + 1e-6
        for at in range(0, len(left["id"]), 64):
            some = {c: v[at : at + 64] for c, v in left.items()}
            low = at if same else np.searchsorted(x, some["v"][0, 0] - reach)  # of a block with itself, pairs in one order
            high = np.searchsorted(x, some["v"][-1, 0] + reach, "right")
            for start in range(low, high, SCORES // 64):
                yield some, {c: v[start : min(high, start + SCORES // 64)] for c, v in right.items()}

    return pieces


def met_boxes(found: DataFrame, by: list[str], least: float, block: float, fold, schema: str) -> tuple[DataFrame, DataFrame]:
    """(what ``fold(left ids, right ids, overlaps, key)`` makes of the tiles of each frame, each pair once; frames by their number _f).

    Boxes of a frame (``by``) are cut into blocks of some ``block`` rows, which
    meet in pairs as arrays: a task holds two blocks, however full a frame is, and
    a box is copied once for each block of its frame.
    """
    frames = written(found.select(*by).distinct().where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])).withColumn("_f", F.monotonically_increasing_id()))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in CORNERS])
    rows = found.where(whole & F.col("event_id").isNotNull()).select(*by, "event_id", F.array(*CORNERS).cast("array<double>").alias("box")).join(frames, by)
    rows, _ = homes(rows.select("_f", "event_id", "box"), "_f", block)
    tiles = tiles_inside(rows, "_f", [F.col("event_id").alias("id"), F.col("box").alias("v")])

    def run(a, b, s, key):
        s = np.where(a["at"][:, None] < b["at"][None, :], s, 0.0) if itself(key) else s
        yield from fold(a["id"], b["id"], s, key)

    return met(tiles, ["g", "kind", "a", "b"], [], run, schema, "overlap", alone=itself, pieces=beside(least)), frames


def overlapping_pairs(found: DataFrame, by: list[str], least: float = 0.6, block: float = BLOCK_ROWS) -> DataFrame:
    """(by, a, b, iou) of pairs of boxes of one frame (``by``), a below b by event_id, whose IoU is above ``least``."""

    def fold(left, right, s, key):
        import pyarrow as pa

        i, j = np.nonzero(s > least)
        low, high = np.minimum(left[i], right[j]), np.maximum(left[i], right[j])
        other = low < high
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(other.sum(), key[0]), low[other], high[other], s[i, j][other])], names=["_g", "a", "b", "iou"])

    pairs, frames = met_boxes(found, by, least, block, fold, "_g long, a long, b long, iou double")
    return pairs.join(frames, F.col("_g") == F.col("_f")).select(*by, "a", "b", "iou")


def overlapping(found: DataFrame, by: list[str], least: float = 0.6, block: float = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows that overlap another one of their frame, rows that don't): together all rows. Pairs stay in the tasks."""

    def fold(left, right, s, _):
        import pyarrow as pa

        hit = (s > least) & (left[:, None] != right[None, :])
        ids = np.union1d(left[hit.any(1)], right[hit.any(0)])
        yield pa.RecordBatch.from_arrays([pa.array(ids)], names=["_id"])

    ids = written(met_boxes(found, by, least, block, fold, "_id long")[0].distinct())
    return tuple(found.join(ids, F.col("event_id") == F.col("_id"), kind) for kind in ("left_semi", "left_anti"))
