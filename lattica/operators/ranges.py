"""Algebra of row ranges: DataFrames with columns part, offset and length.

Ranges are cut at multiples of ``bucketed.ROWS``, each bucket is swept for itself, and only ranges
that touch a bucket's edge are looked at again, two at most for each bucket: so the ranges of one
partition, or of a table without partitions, are never one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import bucketed


def islands(rows: DataFrame, part: str = "part", row: str = "row_no") -> DataFrame:
    """Contiguous ranges of row numbers."""
    b = F.floor(F.col(row) / bucketed.ROWS)
    w = Window.partitionBy(part, "__b").orderBy(row)
    marked = rows.select(part, row).withColumn("__b", b).withColumn("g", F.col(row) - F.row_number().over(w))
    local = marked.groupBy(part, "__b", "g").agg(F.min(row).cast("long").alias("offset"), F.count("*").alias("length"))
    return _stitched(local.select(part, "offset", "length"), part)


def _pieces(ranges: DataFrame) -> DataFrame:
    """part, bucket and [low, high) of each range within each of its buckets; equal pieces once."""
    size, end = bucketed.ROWS, F.col("offset") + F.col("length")
    buckets = F.sequence(F.floor(F.col("offset") / size), F.floor((end - 1) / size))
    cut = ranges.filter("length > 0").select("part", "offset", end.alias("end"), F.explode(buckets).alias("b"))
    return cut.select("part", "b", F.greatest("offset", F.col("b") * size).alias("low"), F.least("end", (F.col("b") + 1) * size).alias("high")).distinct()


def _joined(pieces: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """Joins [low, high) that overlap or touch, by key."""
    w = Window.partitionBy(*by).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("new", F.when(before >= F.col(low), 0).otherwise(1))
    marked = marked.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "g").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("g")


def _stitched(local: DataFrame, part: str = "part") -> DataFrame:
    """Joins ranges of neighbouring buckets that meet at their edge; others are whole already."""
    size, end = bucketed.ROWS, F.col("offset") + F.col("length")
    edge = (F.pmod("offset", F.lit(size)) == 0) | (F.pmod(end, F.lit(size)) == 0)
    rest = local.filter(~edge).select(part, "offset", "length")
    met = _joined(local.filter(edge).select(part, "offset", end.alias("end")), [part], "offset", "end")
    return rest.unionByName(met.select(part, "offset", (F.col("end") - F.col("offset")).alias("length")))


def merge(ranges: DataFrame) -> DataFrame:
    """Joins ranges that overlap or touch."""
    local = _joined(_pieces(ranges), ["part", "b"], "low", "high")
    return _stitched(local.select("part", F.col("low").cast("long").alias("offset"), (F.col("high") - F.col("low")).cast("long").alias("length")))


def clamp(ranges: DataFrame, bound: int) -> DataFrame:
    """Clips to [0, bound) and merges."""
    low = F.greatest(F.col("offset"), F.lit(0))
    high = F.least(F.col("offset") + F.col("length"), F.lit(bound))
    return merge(ranges.select("part", low.cast("long").alias("offset"), (high - low).cast("long").alias("length")))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that both lists hold, as merged ranges.

    A sweep over the ends of both lists within each bucket: no range join.
    """
    ends = None
    for ranges in (a, b):
        local = _joined(_pieces(ranges), ["part", "b"], "low", "high")
        for at, change in (("low", 1), ("high", -1)):
            part = local.select("part", "b", F.col(at).alias("at"), F.lit(change).alias("change"))
            ends = part if ends is None else ends.unionByName(part)
    w = Window.partitionBy("part", "b").orderBy("at")
    depth = ends.groupBy("part", "b", "at").agg(F.sum("change").alias("change"))
    depth = depth.withColumn("depth", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(w))
    # within a bucket, both lists are merged, so neighbouring stretches of depth two don't touch unless at an end of both
    both = _joined(depth.filter("depth = 2").select("part", "b", F.col("at").alias("low"), F.col("next").alias("high")), ["part", "b"], "low", "high")
    return _stitched(both.select("part", F.col("low").cast("long").alias("offset"), (F.col("high") - F.col("low")).cast("long").alias("length")))


def contains(ranges: DataFrame, part: str, row: int) -> bool:
    """Whether a row is in one of the ranges."""
    return bool(ranges.filter((F.col("part") == part) & (F.col("offset") <= row) & (F.col("offset") + F.col("length") > row)).take(1))
