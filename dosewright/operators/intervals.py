"""Interval joins as equi-joins on bins, and coverage of a span by consecutive blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence((start / width).cast("long"), (end / width).cast("long"))


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], point: tuple[str, str], span: tuple[str, str], width: int = 1 << 14) -> DataFrame:
    """Pairs of rows that share ``keys`` and overlap: [point] and [span] are inclusive (start, end) columns.

    Both sides are dealt to bins of ``width``; spans only to bins that hold a point, so that a span of
    many bins costs what it can match. A pair meets once, in the later of the two first bins.
    """
    p = points.withColumn("__b", F.explode(_bins(F.col(point[0]), F.col(point[1]), width)))
    s = spans.withColumn("__b", F.explode(_bins(F.col(span[0]), F.col(span[1]), width)))
    s = s.join(p.select(*keys, "__b").distinct(), [*keys, "__b"], "left_semi")
    later = F.greatest((F.col(point[0]) / width).cast("long"), (F.col(span[0]) / width).cast("long"))
    joined = p.join(s, [*keys, "__b"])
    return joined.where((F.col(span[0]) <= F.col(point[1])) & (F.col(span[1]) >= F.col(point[0])) & (F.col("__b") == later)).drop("__b")


def points_in_regions(points: DataFrame, regions: DataFrame, keys: list[str], pos: str = "pos", width: int = 1 << 20) -> DataFrame:
    """Pairs with start0 < pos <= end of half-open regions (start0, end_)."""
    own = regions.withColumn("__first", F.col("start0") + 1)
    return range_join(points.withColumn("__p", F.col(pos)), own, keys, (pos, "__p"), ("__first", "end_"), width).drop("__p", "__first")


def gapless(blocks: DataFrame, keys: list[str], start: str, end: str, low: str, high: str) -> DataFrame:
    """One row per key: whether its blocks cover [low, high] without a gap."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    own = blocks.withColumn("__gap", F.col(start) > F.coalesce(reach, F.col(low) - 1) + 1)
    return own.groupBy(*keys).agg((~F.bool_or("__gap") & (F.min(start) <= F.min(low)) & (F.max(end) >= F.max(high))).alias("covered"))
