"""Running computations cut into buckets, so that a large key (a symbol, an unpartitioned table) is no one task's.

A bucket is a stretch of the running order.  Each bucket is computed for itself, in one window by key
and bucket; what goes from one bucket to the next is one row for each bucket, and only those rows are
run through by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of row numbers spans; days that a bucket of times spans.
ROWS, DAYS = 1 << 20, 8


def time_bucket(time: Column) -> Column:
    """A number that grows with the time: the stretch of ``DAYS`` days that it is in."""
    return F.floor(F.unix_date(time.cast("date")) / DAYS)


def _within(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by, "__b").orderBy(*order)


def _all(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, value: Column, by: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row, in the order within ``by``."""
    given = df.withColumn("__b", bucket).withColumn("__v", value)
    totals = given.groupBy(*by, "__b").agg(F.sum("__v").alias("__own"))
    totals = totals.withColumn("__base", F.coalesce(F.sum("__own").over(_before(Window.partitionBy(*by).orderBy("__b"))), F.lit(0))).drop("__own")
    inside = given.withColumn("__in", F.sum("__v").over(_all(_within(by, order))))
    return _joined(inside, totals, by).withColumn(name, F.col("__base") + F.col("__in")).drop("__b", "__v", "__in", "__base")


def row_number(df: DataFrame, by: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Adds the place of each row within ``by``, from 0."""
    given = df.withColumn("__b", bucket)
    totals = given.groupBy(*by, "__b").agg(F.count("*").alias("__own"))
    totals = totals.withColumn("__base", F.coalesce(F.sum("__own").over(_before(Window.partitionBy(*by).orderBy("__b"))), F.lit(0))).drop("__own")
    inside = given.withColumn("__in", F.row_number().over(_within(by, order)) - 1)
    return _joined(inside, totals, by).withColumn(name, (F.col("__base") + F.col("__in")).cast("long")).drop("__b", "__in", "__base")


def last_value(df: DataFrame, value: Column, by: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Adds the last value that is not null, up to and with each row."""
    given = df.withColumn("__b", bucket).withColumn("__v", value)
    # buckets without a value of their own carry the one before on
    every = given.groupBy(*by, "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__end"))
    carried = every.withColumn("__base", F.last("__end", ignorenulls=True).over(_before(Window.partitionBy(*by).orderBy("__b")))).drop("__end")
    inside = given.withColumn("__in", F.last("__v", ignorenulls=True).over(_all(_within(by, order))))
    return _joined(inside, carried, by).withColumn(name, F.coalesce("__in", "__base")).drop("__b", "__v", "__in", "__base")


def previous(df: DataFrame, value: Column, by: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Adds a struct of the value (v) of the row before, null at the start; v itself may be null."""
    given = df.withColumn("__b", bucket).withColumn("__v", F.struct(value.alias("v")))
    ends = given.groupBy(*by, "__b").agg(F.max_by("__v", F.struct(*order)).alias("__end"))
    carried = ends.withColumn("__base", F.lag("__end").over(Window.partitionBy(*by).orderBy("__b"))).drop("__end")
    inside = given.withColumn("__in", F.lag("__v").over(_within(by, order)))
    return _joined(inside, carried, by).withColumn(name, F.coalesce("__in", "__base")).drop("__b", "__v", "__in", "__base")


def _joined(rows: DataFrame, buckets: DataFrame, by: list[str]) -> DataFrame:
    """Null keys are keys like any other."""
    return rows.join(buckets.withColumnsRenamed({c: f"__k_{c}" for c in (*by, "__b")}), [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*by, "__b")], "left").drop(*(f"__k_{c}" for c in (*by, "__b")))
