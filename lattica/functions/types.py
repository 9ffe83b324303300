"""Logical column types and their Spark types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.errors import Invalid

#: Logical type -> Spark type. Unsigned types are kept in the next wider one, with a range check.
TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float64": "double", "date32": "date", "timestamp_us": "timestamp_ntz", "date64": "timestamp_ntz", "utf8": "string",
}
ALIASES = {"boolean": "bool", "float": "float32", "double": "float64", "timestamp": "timestamp_us", "string": "utf8", "date": "date32", "long": "int64", "int": "int32"}
BITS = {"int8": 8, "int16": 16, "int32": 32, "int64": 64, "uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}
_FROM_SPARK = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "date": "date32", "timestamp_ntz": "timestamp_us", "timestamp": "timestamp_us", "string": "utf8", "decimal(20,0)": "uint64"}


def parse_type(name: str) -> str:
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in TYPES:
        raise Invalid(f"unknown type {name!r}")
    return key


def spark_type(name: str) -> str:
    return TYPES[parse_type(name)]


def logical_type(spark: str) -> str:
    if spark not in _FROM_SPARK:
        raise Invalid(f"no logical type for Spark type {spark!r}")
    return _FROM_SPARK[spark]


def in_range(c: Column, name: str) -> Column:
    """Whether values fit an unsigned type; null fits."""
    bits = BITS[name]
    top = F.lit(str((1 << bits) - 1)).cast("decimal(20,0)")
    return F.coalesce((c >= 0) & (c.cast("decimal(20,0)") <= top), F.lit(True))


def _as_i64(c: Column, source: str) -> Column:
    """Truncates and saturates at 64 bits; NaN gives 0."""
    if source == "bool":
        return c.cast("int").cast("bigint")
    if source in ("float32", "float64"):
        d = c.cast("double")
        top, low = F.lit((1 << 63) - 1), F.lit(-(1 << 63))
        return F.when(F.isnan(d), F.lit(0).cast("bigint")).when(d >= 9223372036854775807.0, top).when(d <= -9223372036854775808.0, low).otherwise(d.try_cast("bigint"))
    if source == "uint64":
        half = F.lit(str(1 << 63)).cast("decimal(20,0)")
        full = F.lit(str(1 << 64)).cast("decimal(21,0)")
        return F.when(c < half, c.try_cast("bigint")).otherwise((c.cast("decimal(21,0)") - full).try_cast("bigint"))
    return c.cast("bigint")


def cast_column(c: Column, source: str, target: str) -> Column:
    """Converts with the table's rules: narrow integers keep the low bytes, bool asks whether the
    low byte of the unsigned value is not 0. Null stays null; text does not convert."""
    source, target = parse_type(source), parse_type(target)
    if source == target:
        return c
    if "utf8" in (source, target) or source in ("date32", "timestamp_us", "date64") or target in ("date32", "timestamp_us", "date64"):
        raise Invalid(f"cannot cast {source} to {target}")
    if target in ("float32", "float64"):
        return (c.cast("int") if source == "bool" else c).cast(spark_type(target))
    if source in ("float32", "float64") and target in ("bool", "uint64"):
        d = c.cast("double")
        full = F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")
        u = F.when(d >= 1.8446744073709552e19, full).otherwise(d.try_cast("decimal(20,0)"))
        if target == "uint64":
            whole = F.when(d < 9007199254740992.0, F.floor(d).cast("decimal(20,0)")).otherwise(u)
            return F.when(c.isNull(), None).otherwise(F.when(F.isnan(d) | (d <= 0), F.lit(0).cast("decimal(20,0)")).otherwise(whole))
        small = F.when(F.isnan(d) | (d <= 0), F.lit(0).cast("bigint")).otherwise(F.floor(F.least(d, F.lit(4503599627370496.0))))
        byte = F.when(d >= 1.8446744073709552e19, F.lit(255).cast("bigint")).when(d >= 2305843009213693952.0, F.lit(0).cast("bigint")).when(d >= 4503599627370496.0, d.try_cast("bigint").bitwiseAND(255)).otherwise(small.bitwiseAND(255))
        return F.when(c.isNotNull(), byte != 0)
    x = _as_i64(c, source)
    if target == "bool":
        return x.bitwiseAND(255) != 0
    if target == "int64":
        return x
    if target == "uint64":
        wide = x.cast("decimal(21,0)")
        return F.when(x >= 0, x.cast("decimal(20,0)")).otherwise((wide + F.lit(str(1 << 64)).cast("decimal(21,0)")).cast("decimal(20,0)"))
    bits = BITS[target]
    low = x.bitwiseAND((1 << bits) - 1)
    if target.startswith("uint"):
        return low.cast(spark_type(target))
    sign = 1 << (bits - 1)
    return (low.bitwiseXOR(F.lit(sign).cast("bigint")) - sign).cast(spark_type(target))
