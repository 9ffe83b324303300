"""Encodings as logical queries, both ways: differences, runs and packed bits of a column in table order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import bucketed

#: Rows of a run that one task counts out.
CHUNK = 100_000


def _bucket(order: list[str], bucket: Column | None) -> Column:
    """Buckets of the order; by the time that it begins with, unless one is given."""
    return bucketed.time_bucket(F.col(order[0])) if bucket is None else bucket


def delta(df: DataFrame, value: str, by: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """Adds ``delta``: the difference to the row before, or the value itself at the start.

    ``bucket`` grows with the order, which begins with a time if it is not given.
    """
    found = bucketed.previous(df, F.col(value), by, order, _bucket(order, bucket), "__p")
    return found.withColumn("delta", F.col(value) - F.when(F.col("__p").isNull(), F.lit(0)).otherwise(F.coalesce(F.col("__p.v"), F.lit(0)))).drop("__p")


def delta_decode(df: DataFrame, by: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """Adds ``value``: running sums of ``delta``."""
    return bucketed.running_sum(df, F.col("delta"), by, order, _bucket(order, bucket), "value")


def runs(df: DataFrame, value: str, by: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """One row for each run of equal values: by, run (from 0), value and length."""
    b = _bucket(order, bucket)
    found = bucketed.previous(df, F.col(value), by, order, b, "__p")
    new = (F.col("__p").isNotNull() & ~F.col(value).eqNullSafe(F.col("__p.v"))).cast("long")
    marked = bucketed.running_sum(found.withColumn("__new", new), F.col("__new"), by, order, b, "run")
    return marked.groupBy(*by, "run").agg(F.first(value).alias("value"), F.count("*").alias("length"))


def runs_decode(encoded: DataFrame, by: list[str]) -> DataFrame:
    """by, place (from 0) and value of each row that the runs (run, value, length) stand for.

    A long run is counted out in chunks, by several tasks.
    """
    w = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    placed = encoded.withColumn("__at", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))
    chunks = placed.filter("length > 0").select(*by, "value", (F.col("__at") + F.col("length") - 1).alias("__last"), F.explode(F.sequence("__at", F.col("__at") + F.col("length") - 1, F.lit(CHUNK).cast("long"))).alias("__from"))
    return chunks.repartition(*by, "__from").select(*by, "value", F.explode(F.sequence("__from", F.least(F.col("__last"), F.col("__from") + CHUNK - 1))).alias("place"))


def zigzag(value: Column) -> Column:
    """Integers as ones without a sign: 0, -1, 1, -2 as 0, 1, 2, 3."""
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def zigzag_decode(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(1))


def zigzag_width(value: Column) -> Column:
    """Bits that the zigzag form of an integer takes; at least 1."""
    return F.greatest(F.length(F.bin(zigzag(value))), F.lit(1))


def pack(df: DataFrame, value: str, by: list[str], place: str, block: int = 1_024) -> DataFrame:
    """by, block, width, length and bits: the zigzag forms of each block in ``width`` bits each, as text of 0 and 1, in order."""
    given = df.withColumn("block", F.floor(F.col(place) / block)).withColumn("__z", F.bin(zigzag(F.col(value).cast("long"))))
    blocks = given.groupBy(*by, "block").agg(F.max(F.length("__z")).alias("width"), F.count("*").alias("length"), F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col("__z").alias("z")))).alias("__r"))
    return blocks.select(*by, "block", "width", "length", F.array_join(F.transform("__r", lambda r: F.lpad(r["z"], F.col("width"), F.lit("0"))), "").alias("bits"))


def unpack(packed: DataFrame, by: list[str], block: int = 1_024) -> DataFrame:
    """by, place and value of each row of packed blocks."""
    rows = packed.select(*by, "block", "width", "bits", F.explode(F.sequence(F.lit(0), F.col("length").cast("int") - 1)).alias("__i"))
    z = F.lpad(F.substring("bits", F.col("__i") * F.col("width") + 1, F.col("width")), 64, "0")
    # conv reads 64 bits without a sign; the cast back goes by halves, which a long holds
    high, low = (F.conv(F.substring(z, at, 32), 2, 10).cast("long") for at in (1, 33))
    return rows.select(*by, (F.col("block") * block + F.col("__i")).cast("long").alias("place"), zigzag_decode(F.shiftleft(high, 32).bitwiseOR(low)).alias("value"))


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column a checksum of its values that doesn't depend on their order.

    The sum, modulo 2 ** 63, of the first 60 bits of each value's MD5; nulls count as the text "null".
    """
    part = lambda c: F.conv(F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(*(F.coalesce(F.pmod(F.sum(part(c)), F.lit(str(1 << 63)).cast("decimal(38,0)")).cast("long"), F.lit(0)).alias(c) for c in columns))
