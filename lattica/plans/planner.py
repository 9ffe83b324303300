"""Time bounds of a request, and the partitions that can hold rows within them."""

from __future__ import annotations

import datetime as dt

from lattica.functions.calendar import partition_range
from lattica.plans.predicate import Cmp, Predicate, conjuncts


def _moment(v) -> dt.datetime:
    return v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)


def bounds(start, end, predicate: Predicate | None) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Both inclusive; None for no bound. Takes [start, end) and each conjunct on time."""
    low = _moment(start) if start is not None else None
    high = _moment(end) - dt.timedelta(microseconds=1) if end is not None else None
    for c in conjuncts(predicate):
        if isinstance(c, Cmp) and c.field == "time" and isinstance(c.value, dt.date) and c.op != "!=":
            t = _moment(c.value) + dt.timedelta(microseconds={"<": -1, ">": 1}.get(c.op, 0))
            if c.op in ("=", ">=", ">"):
                low = t if low is None else max(low, t)
            if c.op in ("=", "<=", "<"):
                high = t if high is None else min(high, t)
    return low, high


def prune(names: list[str], low: dt.datetime | None, high: dt.datetime | None) -> list[str]:
    """Partition names, in order, that overlap the bounds; the one of a ``none`` table always stays."""
    out = []
    for name in sorted(names):
        if name:
            first, after = partition_range(name)
            if (low is not None and after <= low) or (high is not None and first > high):
                continue
        out.append(name)
    return out
