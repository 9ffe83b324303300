"""Predicate trees over columns, and their translation to Spark expressions.

Comparisons follow IEEE: a NaN matches ``!=`` alone. Null never matches, under NOT either.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.errors import Invalid, NotFound

OPS = ("=", "!=", "<", "<=", ">", ">=")


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Cmp(Predicate):
    field: str
    op: str
    value: object

    def __post_init__(self):
        if self.op not in OPS:
            raise Invalid(f"unknown comparison {self.op!r}")


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple = ()


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple = ()


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


def isin(field: str, values) -> Predicate:
    return Or(tuple(Cmp(field, "=", v) for v in values))


def between(field: str, low, high) -> Predicate:
    """Half-open: low <= field < high."""
    return And((Cmp(field, ">=", low), Cmp(field, "<", high)))


def fields(p: Predicate) -> set[str]:
    if isinstance(p, Cmp):
        return {p.field}
    if isinstance(p, Not):
        return fields(p.part)
    return set().union(*(fields(x) for x in p.parts))


def _compare(c: Column, op: str, v: Column) -> Column:
    return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def _cmp(p: Cmp, kind: str) -> Column:
    c, v = F.col(f"`{p.field}`"), p.value
    if (kind == "bool") != isinstance(v, bool) or (kind == "utf8") != isinstance(v, str):
        raise Invalid(f"{p.field}: {kind} can't be compared with {v!r}")
    if kind in ("date32", "timestamp_us", "date64") and not isinstance(v, (dt.date, dt.datetime)):
        raise Invalid(f"{p.field}: {kind} can't be compared with {v!r}")
    if isinstance(v, float) and math.isnan(v):
        return F.when(c.isNotNull(), F.lit(p.op == "!="))
    if isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63:
        v = Decimal(v)
    if isinstance(v, dt.datetime):
        lit = F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    elif isinstance(v, dt.date):
        lit = F.lit(v)
    else:
        lit = F.lit(v)
    out = _compare(c, p.op, lit)
    if kind in ("float32", "float64") and p.op in (">", ">="):
        out = out & ~F.isnan(c)
    return out


def to_column(p: Predicate, types: dict[str, str]) -> Column:
    """types: logical type of each column."""
    if isinstance(p, Cmp):
        if p.field not in types:
            raise NotFound(f"no column {p.field!r}")
        return _cmp(p, types[p.field])
    if isinstance(p, Not):
        return ~to_column(p.part, types)
    made = [to_column(x, types) for x in p.parts]
    if isinstance(p, And):
        return reduce(lambda a, b: a & b, made, F.lit(True)) if made else F.lit(True)
    return reduce(lambda a, b: a | b, made) if made else F.lit(False)


def conjuncts(p: Predicate | None) -> list[Predicate]:
    if p is None:
        return []
    if isinstance(p, And):
        return [y for x in p.parts for y in conjuncts(x)]
    return [p]
