"""Partition schemes: names of time buckets, their bounds, and the Spark expression of a row's bucket."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.errors import Invalid

SCHEMES = ("none", "year", "month", "date")
_FORMAT = {"year": "yyyy", "month": "yyyy-MM", "date": "yyyy-MM-dd"}


def parse_scheme(name: str) -> str:
    key = {"day": "date"}.get(name.strip().lower(), name.strip().lower())
    if key not in SCHEMES:
        raise Invalid(f"unknown partition scheme {name!r}")
    return key


def partition_name(scheme: str, t: dt.date) -> str:
    if scheme == "none":
        return ""
    return f"{scheme}=" + {"year": f"{t.year:04d}", "month": f"{t.year:04d}-{t.month:02d}", "date": f"{t.year:04d}-{t.month:02d}-{t.day:02d}"}[scheme]


def partition_range(name: str) -> tuple[dt.datetime, dt.datetime]:
    """[first, next) of a partition's time."""
    scheme, _, value = name.partition("=")
    try:
        parts = [int(x) for x in value.split("-")]
        if scheme not in _FORMAT or len(parts) != ("year", "month", "date").index(scheme) + 1:
            raise ValueError
        low = dt.datetime(*(parts + [1, 1])[:3])
    except ValueError:
        raise Invalid(f"bad partition name {name!r}") from None
    if scheme == "date":
        return low, low + dt.timedelta(days=1)
    if scheme == "month":
        return low, dt.datetime(low.year + low.month // 12, low.month % 12 + 1, 1)
    return low, dt.datetime(low.year + 1, 1, 1)


def fits(scheme: str, name: str) -> bool:
    if scheme == "none":
        return name == ""
    try:
        return name.startswith(f"{scheme}=") and partition_name(scheme, partition_range(name)[0]) == name
    except Invalid:
        return False


def partition_column(scheme: str, time: Column) -> Column:
    """The partition name of each row; names order as times do."""
    if scheme == "none":
        return F.lit("")
    return F.concat(F.lit(f"{scheme}="), F.date_format(time, _FORMAT[scheme]))


def days_from_civil(y: int, m: int, d: int) -> int:
    return (dt.date(y, m, d) - dt.date(1970, 1, 1)).days


def civil_from_days(days: int) -> tuple[int, int, int]:
    t = dt.date(1970, 1, 1) + dt.timedelta(days=days)
    return t.year, t.month, t.day
