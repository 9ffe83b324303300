"""Operations beyond plain grids: as-of join and densifying."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import bucketed


#: Places of the axis that one task fills in.
CHUNK = 100_000


def asof_join(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left with the last non-null ``value`` of right at or before each time, by symbol.

    One union and windows within buckets of time, no range join; ties take right's row of the same time.
    """
    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__l", F.lit(1)).unionByName(
        right.select("sym", "time", F.col(value).alias("__v")).withColumn("__l", F.lit(0)), allowMissingColumns=True
    )
    found = bucketed.last_value(both.withColumnRenamed("__v", "__given"), F.col("__given"), ["sym"], ["time", "__l"], bucketed.time_bucket(F.col("time")), f"asof_{value}")
    return found.filter("__l = 1").drop("__given", "__l")


def densify(df: DataFrame) -> DataFrame:
    """Adds the axis times that a symbol lacks between its first and last, with null fields.

    Symbols count out their places on the numbered axis, in chunks, and meet it by number.
    """
    axis = bucketed.row_number(df.select("time").distinct(), [], ["time"], bucketed.time_bucket(F.col("time")), "__i")
    spans = df.groupBy("sym").agg(F.min("time").alias("__t0"), F.max("time").alias("__t1"))
    for t, name in (("__t0", "__i0"), ("__t1", "__i1")):
        spans = spans.join(axis.withColumnsRenamed({"time": t, "__i": name}), t)
    chunks = spans.select("sym", "__i1", F.explode(F.sequence("__i0", "__i1", F.lit(CHUNK).cast("long"))).alias("__from")).repartition("sym", "__from")
    places = chunks.select("sym", F.explode(F.sequence("__from", F.least(F.col("__i1"), F.col("__from") + CHUNK - 1))).alias("__i"))
    return places.join(axis, "__i").select("sym", "time").join(df, ["sym", "time"], "left")
