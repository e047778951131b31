"""Box algebra and detection labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: str, b: str) -> Column:
    """Intersection over union of boxes with columns a_x1 ... and b_x1 ...; 0 for an empty union."""
    c = lambda side, name: F.col(f"{side}{name}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda s: (c(s, "x2") - c(s, "x1")) * (c(s, "y2") - c(s, "y1"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def crop(low: Column, high: Column, size: int, compat: bool = False) -> tuple[Column, Column]:
    """A side of a box cut to whole pixels of the image.

    ``compat`` lets a negative end count from the far side, as array slices do.
    """
    low, high = low.cast("int"), high.cast("int")
    if compat:
        high = F.when(high < 0, F.greatest(high + size, F.lit(0))).otherwise(high)
    return F.greatest(F.lit(0), low), F.least(F.lit(size), high)


def stratum(conf: Column) -> Column:
    return F.when(conf >= 0.8, "high").when(conf >= 0.3, "medium").otherwise("low")


def colour(track_id: Column, palette: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, palette)), (F.pmod(track_id, F.lit(len(palette))) + 1).cast("int"))
