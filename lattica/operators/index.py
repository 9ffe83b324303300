"""Index operations of a grid: DataFrames with part, sym and time.

The axis is numbered over distinct times and the row starts over one row for each symbol; times, and
rows of a symbol, are numbered in buckets of time.  So no step numbers all rows of a partition or of
a symbol in one task; the small tables are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import Invalid, KeyMissing
from lattica.operators import bucketed
from lattica.operators.ranges import islands


def time_axis(df: DataFrame) -> DataFrame:
    """part, time_index (from 0) and time."""
    return bucketed.row_number(df.select("part", "time").distinct(), ["part"], ["time"], bucketed.time_bucket(F.col("time")), "time_index")


def sym_dictionary(df: DataFrame) -> DataFrame:
    """part, sym_id (from 0) and sym, in the order of sym."""
    w = Window.partitionBy("part").orderBy("sym")
    return df.select("part", "sym").distinct().withColumn("sym_id", (F.row_number().over(w) - 1).cast("long"))


def axis_lower_bound(df: DataFrame, value) -> DataFrame:
    """part and the number of axis times before value."""
    return df.select("part", "time").distinct().groupBy("part").agg(F.sum((F.col("time") < value).cast("int")).cast("long").alias("index"))


def sym_index(df: DataFrame) -> DataFrame:
    """part, sym, sym_id, time_start, time_count and row_start of each symbol."""
    axis = time_axis(df)
    per = df.groupBy("part", "sym").agg(F.min("time").alias("time"), F.count("*").alias("time_count"))
    per = per.join(axis, ["part", "time"]).withColumnRenamed("time_index", "time_start").drop("time")
    w = Window.partitionBy("part").orderBy("sym")
    start = F.coalesce(F.sum("time_count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select("part", "sym", (F.row_number().over(w) - 1).cast("long").alias("sym_id"), "time_start", "time_count", start.cast("long").alias("row_start"))


def row_numbers(df: DataFrame) -> DataFrame:
    """df with row_no: its place within the partition by sym, then time."""
    inside = bucketed.row_number(df, ["part", "sym"], ["time"], bucketed.time_bucket(F.col("time")), "__at")
    per = df.groupBy("part", "sym").agg(F.count("*").alias("n"))
    w = Window.partitionBy("part").orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("part", "sym", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("row_start"))
    return inside.join(starts, ["part", "sym"]).withColumn("row_no", (F.col("row_start") + F.col("__at")).cast("long")).drop("__at", "row_start")


def violations(df: DataFrame) -> DataFrame:
    """Symbols that break the grid: gaps on the axis, repeated times, or no symbol at all."""
    axis = time_axis(df)
    times = df.groupBy("part", "sym", "time").agg(F.count("*").alias("c"))
    per = times.groupBy("part", "sym").agg(F.sum("c").alias("n_rows"), F.count("time").alias("n_times"), F.min("time").alias("t0"), F.max("time").alias("t1"))
    for t, name in (("t0", "i0"), ("t1", "i1")):
        per = per.join(axis.withColumnsRenamed({"time": t, "time_index": name}), ["part", t], "left")
    per = per.select("part", "sym", "n_rows", "n_times", (F.col("i1") - F.col("i0") + 1).alias("span"))
    return per.filter("sym is null or n_rows <> span or n_rows <> n_times")


def locate(df: DataFrame, keys: DataFrame, strict: bool = True) -> DataFrame:
    """Row ranges (part, offset, length) of the keys (part, sym, time); a key that is missing is an error."""
    if strict:
        if keys.groupBy("part", "sym", "time").count().filter("count > 1").take(1):
            raise Invalid("keys repeat")
        gone = missing(df, keys).take(1)
        if gone:
            raise KeyMissing(f"no row {gone[0]['sym']!r} at {gone[0]['time']}")
    return islands(row_numbers(df).join(keys, ["part", "sym", "time"], "left_semi"))


def missing(df: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(df.select("part", "sym", "time"), ["part", "sym", "time"], "left_anti")


def locate_row(df: DataFrame, rows: DataFrame) -> DataFrame:
    """part, row_no, sym_id and time_index for given (part, row_no)."""
    found = row_numbers(df).join(rows, ["part", "row_no"], "left_semi")
    return found.join(sym_dictionary(df), ["part", "sym"]).join(time_axis(df), ["part", "time"]).select("part", "row_no", "sym_id", "time_index")


def scan_ranges(df: DataFrame, condition) -> DataFrame:
    """Row ranges of the rows that meet the condition."""
    return islands(row_numbers(df).filter(condition))


def read_range(df: DataFrame, part: str, offset: int, length: int) -> DataFrame:
    return row_numbers(df).filter((F.col("part") == part) & (F.col("row_no") >= offset) & (F.col("row_no") < offset + length))


def index_info(df: DataFrame) -> DataFrame:
    """part, row_count, sym_count and time_count."""
    return df.groupBy("part").agg(F.count("*").alias("row_count"), F.countDistinct("sym").alias("sym_count"), F.countDistinct("time").alias("time_count"))
