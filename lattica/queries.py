"""Queries over the test tables, one for each operator, and the same in DuckDB's SQL.

T: ticks, from events (sym = event_type, time = ts).  D: one row for each symbol and day of T.
Y: lines, summed by (l_returnflag, day).  L: the distinct keys of Y, which have gaps.
"""

from __future__ import annotations

import atexit
import contextlib
import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import codec
from lattica.functions.calendar import partition_column
from lattica.functions.types import cast_column
from lattica.operators import extensions, index, ranges
from lattica.plans.predicate import And, Cmp, Not, Or, between, isin, to_column
from lattica.sources import source
from lattica.sources.manifest import Files
from lattica.sources.reader import GridReader
from lattica.sources.writer import GridWriter
from lattica.streaming.ingest import bars, write_stream

LO, HI = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)
_tables: dict[tuple, str] = {}


# ---- inputs ----


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("sym"), F.col("ts").cast("timestamp_ntz").alias("time"), "value", "user_id", "event_id", "props")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.groupBy("sym", F.to_date("time").alias("time")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("user_id").alias("users"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.groupBy(F.col("l_returnflag").alias("sym"), F.to_date("l_shipdate").alias("time")).agg(F.sum("l_quantity").cast("long").alias("qty"), F.count("*").alias("n"))


def parted(df: DataFrame, scheme: str = "none") -> DataFrame:
    return df.withColumn("part", partition_column(scheme, F.col("time")))


def day_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parted(daily(spark, sf_dir), "month")


def scratch(spark: SparkSession) -> str:
    """A new folder for a table: in spark.checkpoint.dir, or our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(at)
    path = f"{at}/grid-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session is gone, and the folder is the cluster's to clean
        Files(spark, path).fs.delete(Files(spark, path).root, True)


def table(spark: SparkSession, sf_dir: str, kind: str, scheme: str) -> GridReader:
    """A table of the input, written once for a session and read by many queries."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, scheme)
    if key not in _tables:
        made = {"T": ticks, "D": daily}.get(kind)
        path = scratch(spark)
        if kind == "Y":
            # keys of Y have gaps, so each symbol's days are filled before they make a grid
            GridWriter(spark, path).init(extensions.densify(lines(spark, sf_dir)).withColumns({c: F.col(c).cast("double") for c in ("qty", "n")}), scheme)
        elif kind == "T":
            GridWriter(spark, path).init(made(spark, sf_dir), scheme, rule="ticks")
        else:
            GridWriter(spark, path).init(made(spark, sf_dir), scheme)
        _tables[key] = path
    return GridReader(spark, _tables[key])


T_COLS = ["value", "user_id", "event_id"]
TICKS = "t AS (SELECT event_type AS sym, ts AS time, value, user_id, event_id, props FROM events)"
DAILY = "d AS (SELECT event_type AS sym, CAST(ts AS DATE) AS time, count(*) AS n, min(value) AS lo, max(value) AS hi, CAST(sum(user_id) AS BIGINT) AS users, 'month=' || strftime(CAST(ts AS DATE), '%Y-%m') AS part FROM events GROUP BY ALL)"
LINES = "y AS (SELECT l_returnflag AS sym, CAST(l_shipdate AS DATE) AS time, CAST(sum(l_quantity) AS BIGINT) AS qty, count(*) AS n FROM lineitem GROUP BY ALL)"
FULL = LINES + ", f AS (SELECT g.sym, g.time, qty, n FROM (SELECT s.sym, a.time FROM (SELECT DISTINCT time FROM y) a JOIN (SELECT sym, min(time) lo, max(time) hi FROM y GROUP BY sym) s ON a.time BETWEEN s.lo AND s.hi) g LEFT JOIN y USING (sym, time))"
ROWNO = DAILY + ", r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY sym, time) - 1 AS row_no FROM d)"
NULLED = "x AS (SELECT *, nullif(user_id % 7, 0) AS a, CASE WHEN user_id % 5 = 0 THEN 'NaN'::DOUBLE WHEN user_id % 5 = 1 THEN NULL ELSE value END AS b FROM t)"

CLICK = "sym = 'click'"

_made: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None, dates: tuple[str, ...] = ()):
    """Registers a query. dates: its date columns, which both sides show as timestamps."""

    def add(f):
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("timestamp_ntz") for c in dates}) if dates else f(spark, sf_dir)

        shown.__name__, shown.__doc__ = f.__name__, f.__doc__
        swap = ", ".join(f"CAST({c} AS TIMESTAMP) AS {c}" for c in dates)
        _made[f.__name__] = (shown, f"SELECT * REPLACE ({swap}) FROM ({sql})" if dates else sql)
        return f

    return add


def _t(spark, sf_dir, **request) -> DataFrame:
    return table(spark, sf_dir, "T", "month").scan(**request)


# ---- 2.1, 2.3, 2.4, 2.6: scans ----


@query(f"WITH {TICKS} SELECT sym, time, event_id, props, user_id, value FROM t")
def scan_full(spark, sf_dir):
    return _t(spark, sf_dir)


@query(f"WITH {TICKS} SELECT sym, time, value FROM t")
def scan_projection(spark, sf_dir):
    return _t(spark, sf_dir, columns=["sym", "value", "value"])


@query(f"WITH {TICKS} SELECT sym, time, value FROM t WHERE sym = 'click'")
def scan_sym_eq(spark, sf_dir):
    return _t(spark, sf_dir, symbols="click", columns=["value"])


@query(f"WITH {TICKS} SELECT sym, time, value FROM t WHERE sym IN ('click', 'view')")
def scan_sym_in(spark, sf_dir):
    return _t(spark, sf_dir, symbols=["click", "view"], columns=["value"])


@query(f"WITH {TICKS} SELECT sym, time, value FROM t WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-12'")
def scan_time_range(spark, sf_dir):
    return _t(spark, sf_dir, start=LO, end=HI, columns=["value"])


@query(f"WITH {TICKS} SELECT sym, time, value FROM t WHERE time >= TIMESTAMP '2024-01-20'")
def scan_time_open(spark, sf_dir):
    return _t(spark, sf_dir, start=dt.datetime(2024, 1, 20), columns=["value"])


@query(f"WITH {TICKS} SELECT sym, time, value, user_id FROM t WHERE sym = 'click' AND time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-12' AND value > 50")
def scan_sym_time(spark, sf_dir):
    return _t(spark, sf_dir, symbols="click", start=LO, end=HI, predicate=Cmp("value", ">", 50.0), columns=["value", "user_id"])


@query(f"WITH {TICKS} SELECT sym, time, value FROM t ORDER BY sym, time LIMIT 25")
def scan_limit_ordered(spark, sf_dir):
    return _t(spark, sf_dir, columns=["value"], limit=25)


@query(f"WITH {FULL} SELECT sym, time, CAST(qty AS DOUBLE) AS qty FROM f WHERE time >= DATE '1997-01-01' AND time < DATE '1998-01-01'", dates=("time",))
def scan_pruned_year(spark, sf_dir):
    return table(spark, sf_dir, "Y", "year").scan(start=dt.date(1997, 1, 1), end=dt.date(1998, 1, 1), columns=["qty"])


@query(f"WITH {FULL} SELECT sym, time, CAST(n AS DOUBLE) AS n, CAST(qty AS DOUBLE) AS qty FROM f WHERE time >= DATE '1997-03-05' AND time < DATE '1997-04-20' AND sym = 'R'", dates=("time",))
def scan_pruned_month(spark, sf_dir):
    return table(spark, sf_dir, "Y", "month").scan(symbols="R", start=dt.date(1997, 3, 5), end=dt.date(1997, 4, 20))


@query(f"WITH {DAILY} SELECT sym, time, n FROM d WHERE time >= DATE '2024-01-10' AND time <= DATE '2024-01-12'", dates=("time",))
def scan_pruned_date(spark, sf_dir):
    p = And((Cmp("time", ">=", dt.date(2024, 1, 10)), Cmp("time", "<=", dt.date(2024, 1, 12))))
    return table(spark, sf_dir, "D", "date").scan(predicate=p, columns=["n"])


@query(f"WITH {DAILY} SELECT sym, time, n FROM d WHERE sym = 'view' AND time < DATE '2024-01-05'", dates=("time",))
def scan_unpartitioned(spark, sf_dir):
    return table(spark, sf_dir, "D", "none").scan(symbols=["view"], end=dt.date(2024, 1, 5), columns=["n"])


# ---- 2.4: predicates, with injected null and NaN ----

KINDS = {"sym": "utf8", "time": "timestamp_us", "value": "float64", "user_id": "int64", "event_id": "int64", "a": "int64", "b": "float64"}


def nulled(spark, sf_dir) -> DataFrame:
    t = ticks(spark, sf_dir)
    b = F.when(F.col("user_id") % 5 == 0, F.lit(float("nan"))).when(F.col("user_id") % 5 == 1, None).otherwise(F.col("value"))
    return t.withColumn("a", F.nullif(F.col("user_id") % 7, F.lit(0))).withColumn("b", b)


def _where(spark, sf_dir, p) -> DataFrame:
    return nulled(spark, sf_dir).filter(to_column(p, KINDS)).select("event_id")


def _pred(where: str) -> str:
    return f"WITH {TICKS}, {NULLED} SELECT event_id FROM x WHERE {where}"


@query(_pred("(value > 20 AND value < 80 AND NOT (user_id < 30)) OR event_id < 50"))
def pred_and_or_not(spark, sf_dir):
    return _where(spark, sf_dir, Or((And((Cmp("value", ">", 20.0), Cmp("value", "<", 80.0), Not(Cmp("user_id", "<", 30)))), Cmp("event_id", "<", 50))))


@query(_pred("a <> 3"))
def pred_ne_null(spark, sf_dir):
    return _where(spark, sf_dir, Cmp("a", "!=", 3))


@query(_pred("NOT (a < 3)"))
def pred_not_null(spark, sf_dir):
    return _where(spark, sf_dir, Not(Cmp("a", "<", 3)))


@query(_pred("b > 50 AND NOT isnan(b)"))
def pred_nan(spark, sf_dir):
    return _where(spark, sf_dir, Cmp("b", ">", 50.0))


@query(_pred("b IS NOT NULL AND (isnan(b) OR NOT (b > 50))"))
def pred_not_nan(spark, sf_dir):
    return _where(spark, sf_dir, Not(Cmp("b", ">", 50.0)))


@query(_pred("b IS NOT NULL"))
def pred_nan_literal(spark, sf_dir):
    return _where(spark, sf_dir, Cmp("b", "!=", float("nan")))


@query(_pred("sym = 'click' OR value > 90"))
def pred_cross_field_or(spark, sf_dir):
    return _where(spark, sf_dir, Cmp("sym", "=", "click") | Cmp("value", ">", 90.0))


@query(_pred("NOT (sym = 'click') AND sym < 'view'"))
def pred_not_sym(spark, sf_dir):
    return _where(spark, sf_dir, And((~Cmp("sym", "=", "click"), Cmp("sym", "<", "view"))))


@query(_pred("sym = 'click' AND sym IN ('view', 'purchase', 'click')"))
def pred_sym_intersection(spark, sf_dir):
    return _where(spark, sf_dir, And((Cmp("sym", "=", "click"), isin("sym", ["view", "purchase", "click"]))))


@query(_pred("time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-12' AND time <> TIMESTAMP '2024-01-11'"))
def pred_between_time(spark, sf_dir):
    return _where(spark, sf_dir, And((between("time", LO, HI), Cmp("time", "!=", dt.datetime(2024, 1, 11)))))


@query(_pred("user_id < 18446744073709551615::UBIGINT AND user_id > 100"))
def pred_wide_literal(spark, sf_dir):
    return _where(spark, sf_dir, And((Cmp("user_id", "<", (1 << 64) - 1), Cmp("user_id", ">", 100))))


@query(_pred("false"))
def pred_empty_or(spark, sf_dir):
    return _where(spark, sf_dir, Or(()))


# ---- 2.1: index ----


@query(f"WITH {DAILY} SELECT part, time, row_number() OVER (PARTITION BY part ORDER BY time) - 1 AS time_index FROM (SELECT DISTINCT part, time FROM d)", dates=("time",))
def time_axis(spark, sf_dir):
    return index.time_axis(day_grid(spark, sf_dir))


@query(f"WITH {DAILY} SELECT part, count(*) FILTER (time < DATE '2024-01-15') AS index FROM (SELECT DISTINCT part, time FROM d) GROUP BY part")
def axis_lower_bound(spark, sf_dir):
    return index.axis_lower_bound(day_grid(spark, sf_dir), dt.date(2024, 1, 15))


@query(f"WITH {DAILY} SELECT part, sym, row_number() OVER (PARTITION BY part ORDER BY sym) - 1 AS sym_id FROM (SELECT DISTINCT part, sym FROM d)")
def sym_dict(spark, sf_dir):
    return index.sym_dictionary(day_grid(spark, sf_dir))


@query(f"WITH {DAILY}, a AS (SELECT *, dense_rank() OVER (PARTITION BY part ORDER BY time) - 1 AS ti FROM d), s AS (SELECT part, sym, min(ti) AS time_start, count(*) AS time_count FROM a GROUP BY ALL) SELECT part, sym, row_number() OVER (PARTITION BY part ORDER BY sym) - 1 AS sym_id, time_start, time_count, CAST(coalesce(sum(time_count) OVER (PARTITION BY part ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_start FROM s")
def sym_index(spark, sf_dir):
    return index.sym_index(day_grid(spark, sf_dir))


@query(f"WITH {ROWNO} SELECT part, sym, time, row_no FROM r", dates=("time",))
def row_numbers(spark, sf_dir):
    return index.row_numbers(day_grid(spark, sf_dir)).select("part", "sym", "time", "row_no")


def _keys(spark, sf_dir):
    return day_grid(spark, sf_dir).filter("day(time) in (3, 4, 9)").select("part", "sym", "time")


def _islands(where: str, by: str = "r") -> str:
    return f"SELECT part, min(row_no) AS offset, count(*) AS length FROM (SELECT part, row_no, row_no - row_number() OVER (PARTITION BY part ORDER BY row_no) AS g FROM {by} WHERE {where}) GROUP BY part, g"


@query(f"WITH {ROWNO} {_islands('day(time) IN (3, 4, 9)')}")
def locate_keys(spark, sf_dir):
    return index.locate(day_grid(spark, sf_dir), _keys(spark, sf_dir))


@query(f"WITH {DAILY} SELECT part, sym, time + 1000 AS time FROM d WHERE day(time) = 3", dates=("time",))
def locate_missing(spark, sf_dir):
    keys = day_grid(spark, sf_dir).filter("day(time) = 3").select("part", "sym", F.date_add("time", 1000).alias("time"))
    return index.missing(day_grid(spark, sf_dir), keys)


@query(f"WITH {ROWNO} SELECT part, row_no, dense_rank() OVER (PARTITION BY part ORDER BY sym) - 1 AS sym_id, dense_rank() OVER (PARTITION BY part ORDER BY time) - 1 AS time_index FROM r QUALIFY row_no % 10 = 3")
def locate_row(spark, sf_dir):
    g = day_grid(spark, sf_dir)
    return index.locate_row(g, index.row_numbers(g).filter("row_no % 10 = 3").select("part", "row_no"))


@query(f"WITH {ROWNO} {_islands('n % 3 = 0')}")
def scan_ranges(spark, sf_dir):
    return index.scan_ranges(day_grid(spark, sf_dir), F.col("n") % 3 == 0)


@query(f"WITH {ROWNO} SELECT sym, time, n FROM r WHERE part = 'month=2024-01' AND row_no >= 20 AND row_no < 55", dates=("time",))
def read_range(spark, sf_dir):
    return table(spark, sf_dir, "D", "month").read_range("month=2024-01", 20, 35, ["n"])


@query(f"WITH {DAILY} SELECT part, count(*) AS row_count, count(DISTINCT sym) AS sym_count, count(DISTINCT time) AS time_count FROM d GROUP BY part")
def index_info(spark, sf_dir):
    return index.index_info(day_grid(spark, sf_dir))


@query(f"WITH {ROWNO} {_islands(CLICK)}")
def table_scanner(spark, sf_dir):
    return table(spark, sf_dir, "D", "month").scan_ranges(symbols="click")


# ---- 2.5: ranges ----


def _spans(spark, sf_dir):
    g = index.row_numbers(day_grid(spark, sf_dir))
    return g.select("part", (F.col("row_no") - 3).alias("offset"), (F.col("n") % 5).alias("length"))


SPANS = ROWNO + ", s AS (SELECT part, row_no - 3 AS off, n % 5 AS len FROM r), p AS (SELECT DISTINCT part, unnest(range(off, off + len)) AS row_no FROM s), q AS (SELECT DISTINCT part, row_no FROM r WHERE row_no % 4 > 0)"


@query(f"WITH {SPANS} {_islands('true', 'p')}")
def ranges_merge(spark, sf_dir):
    return ranges.merge(_spans(spark, sf_dir))


@query(f"WITH {SPANS} {_islands('row_no >= 0 AND row_no < 100', 'p')}")
def ranges_clamp(spark, sf_dir):
    return ranges.clamp(_spans(spark, sf_dir), 100)


@query(f"WITH {SPANS}, i AS (SELECT part, row_no FROM p INTERSECT SELECT part, row_no FROM q) {_islands('true', 'i')}")
def ranges_intersect(spark, sf_dir):
    other = index.scan_ranges(day_grid(spark, sf_dir), F.col("row_no") % 4 > 0)
    return ranges.intersect(_spans(spark, sf_dir), other)


# ---- 1.4, 2.8, 2.10: the grid's rules, statistics, partitions ----


@query(f"WITH {LINES}, a AS (SELECT *, dense_rank() OVER (ORDER BY time) AS ti FROM y) SELECT '' AS part, sym, count(*) AS n_rows, count(DISTINCT time) AS n_times, max(ti) - min(ti) + 1 AS span FROM a GROUP BY sym HAVING count(*) <> max(ti) - min(ti) + 1")
def grid_violations(spark, sf_dir):
    return index.violations(parted(lines(spark, sf_dir)))


@query(f"WITH {DAILY} SELECT part, sym, 0::BIGINT AS n_rows, 0::BIGINT AS n_times, 0::BIGINT AS span FROM d WHERE false")
def grid_valid(spark, sf_dir):
    return index.violations(day_grid(spark, sf_dir))


@query("SELECT DISTINCT 'month=' || strftime(l_shipdate, '%Y-%m') AS name FROM lineitem")
def partition_names(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select(partition_column("month", F.col("l_shipdate")).alias("name")).distinct()


@query(f"WITH {FULL} SELECT DISTINCT 'year=' || year(time) AS name, CAST(date_trunc('year', time) AS TIMESTAMP) AS time_min, CAST(date_trunc('year', time) + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND AS TIMESTAMP) AS time_max FROM f")
def partition_bounds(spark, sf_dir):
    rows = table(spark, sf_dir, "Y", "year").metadata()["partitions"]
    return spark.createDataFrame([(r["name"], r["time_min"], r["time_max"]) for r in rows], "name string, time_min timestamp_ntz, time_max timestamp_ntz")


@query(f"WITH {TICKS} SELECT count(*) AS row_count, count(DISTINCT date_trunc('month', time)) AS partition_count, min(time) AS time_min, max(time) AS time_max, min(sym) AS sym_min, max(sym) AS sym_max FROM t")
def table_stats(spark, sf_dir):
    s = table(spark, sf_dir, "T", "month").statistics()
    row = spark.createDataFrame([tuple(s[k] for k in ("row_count", "partition_count", "time_min", "time_max", "sym_min", "sym_max"))], "row_count long, partition_count long, time_min string, time_max string, sym_min string, sym_max string")
    return row.withColumn("time_min", F.col("time_min").cast("timestamp_ntz")).withColumn("time_max", F.col("time_max").cast("timestamp_ntz"))


@query(f"WITH {FULL} SELECT 'year=' || year(time) AS name, count(*) AS row_count, count(DISTINCT sym) AS sym_count, count(DISTINCT time) AS time_count, min(sym) AS sym_min, max(sym) AS sym_max, min(time) AS time_min, max(time) AS time_max FROM f GROUP BY ALL", dates=("time_min", "time_max"))
def partition_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "Y", "year").partition_statistics()
    keys = ("name", "row_count", "sym_count", "time_count", "sym_min", "sym_max", "time_min", "time_max")
    df = spark.createDataFrame([tuple(r[k] for k in keys) for r in rows], "name string, row_count long, sym_count long, time_count long, sym_min string, sym_max string, time_min string, time_max string")
    return df.withColumn("time_min", F.col("time_min").cast("date")).withColumn("time_max", F.col("time_max").cast("date"))


@query(f"WITH {FULL} SELECT count(*) FILTER (sym IS NULL) AS sym, count(*) FILTER (time IS NULL) AS time, count(*) FILTER (n IS NULL) AS n, count(*) FILTER (qty IS NULL) AS qty FROM f")
def null_counts(spark, sf_dir):
    return table(spark, sf_dir, "Y", "year").null_counts()


# ---- 2.2: writes ----


def _fresh(spark, sf_dir, scheme: str = "month") -> GridWriter:
    return GridWriter(spark, scratch(spark)).init(daily(spark, sf_dir), scheme)


def _patch(spark, sf_dir, where: str) -> DataFrame:
    return daily(spark, sf_dir).filter(where)


@query(f"WITH {DAILY} SELECT sym, time, lo, hi, users, CASE WHEN day(time) = 5 THEN n + 1000 ELSE n END AS n FROM d", dates=("time",))
def write_patch(spark, sf_dir):
    w = _fresh(spark, sf_dir).write(_patch(spark, sf_dir, "day(time) = 5").select("sym", "time", (F.col("n") + 1000).alias("n")))
    return w.as_reader().scan()


@query(f"WITH {DAILY} SELECT sym, time, n, CASE WHEN sym = 'click' THEN NULL ELSE hi END AS hi FROM d", dates=("time",))
def write_patch_null(spark, sf_dir):
    w = _fresh(spark, sf_dir).write(_patch(spark, sf_dir, "sym = 'click'").select("sym", "time", F.lit(None).cast("double").alias("hi")))
    return w.as_reader().scan(columns=["n", "hi"])


@query(f"""WITH {DAILY} SELECT sym, time, n, CASE WHEN day(time) < 4 THEN n * 2.0::DOUBLE END AS "factor.mom" FROM d""", dates=("time",))
def write_new_column(spark, sf_dir):
    w = _fresh(spark, sf_dir).write(_patch(spark, sf_dir, "day(time) < 4").select("sym", "time", (F.col("n") * 2.0).alias("factor.mom")))
    return w.as_reader().scan(columns=["n", "factor.mom"])


@query(f"WITH {DAILY} SELECT sym, time, CASE WHEN time = DATE '2024-01-07' THEN 7 ELSE n END AS n FROM d WHERE NOT (time = DATE '2024-01-07' AND sym > 'd')", dates=("time",))
def update_partition(spark, sf_dir):
    new = _patch(spark, sf_dir, "time = date'2024-01-07' and sym <= 'd'").select("sym", "time", F.lit(7).cast("long").alias("n"))
    return _fresh(spark, sf_dir, "date").update(new).as_reader().scan(columns=["n"])


@query(f"WITH {DAILY} SELECT sym, time, n, users FROM d UNION ALL SELECT sym, time + 366, n, users FROM d", dates=("time",))
def update_new_partition(spark, sf_dir):
    moved = daily(spark, sf_dir).withColumn("time", F.date_add("time", 366))
    return _fresh(spark, sf_dir).update(moved).as_reader().scan(columns=["n", "users"])


@query(f"WITH {DAILY} SELECT sym, time, n FROM d WHERE day(time) = 1", dates=("time",))
def update_unpartitioned(spark, sf_dir):
    return _fresh(spark, sf_dir, "none").update(_patch(spark, sf_dir, "day(time) = 1").select("sym", "time", "n")).as_reader().scan()


@query(f"WITH {DAILY} SELECT sym, time, n FROM d WHERE time <> DATE '2024-01-09'", dates=("time",))
def delete_partition(spark, sf_dir):
    return _fresh(spark, sf_dir, "date").delete_partition("date=2024-01-09").as_reader().scan(columns=["n"])


@query(f"WITH {DAILY} SELECT sym, time, n FROM d UNION ALL SELECT sym, time + 31, n FROM d WHERE time = DATE '2024-01-09'", dates=("time",))
def create_partition(spark, sf_dir):
    new = _patch(spark, sf_dir, "time = date'2024-01-09'").withColumn("time", F.date_add("time", 31))
    return _fresh(spark, sf_dir, "date").create_partition("date=2024-02-09", new).as_reader().scan(columns=["n"])


@query(f"WITH {ROWNO} SELECT sym, time, CASE WHEN row_no BETWEEN 10 AND 14 THEN row_no - 10 ELSE n END AS n FROM r", dates=("time",))
def write_rows(spark, sf_dir):
    new = spark.range(5).select(F.col("id").alias("row_no"), F.col("id").alias("n"))
    return _fresh(spark, sf_dir).write_rows("month=2024-01", 10, new).as_reader().scan(columns=["n"])


@query(f"WITH {DAILY} SELECT sym, time, n FROM d UNION ALL SELECT sym, time + 60, n FROM d", dates=("time",))
def stream_writer(spark, sf_dir):
    w = GridWriter(spark, scratch(spark)).create({"n": "int64"}, "month", "date32")
    d = daily(spark, sf_dir).select("sym", "time", "n")
    s = w.stream().write_partition(d).write_partition(d.withColumn("time", F.date_add("time", 60)))
    return s.finish().as_reader().scan()


@query(f"WITH {DAILY} SELECT sym, time, n FROM d", dates=("time",))
def sink_auto_init(spark, sf_dir):
    return GridWriter(spark, scratch(spark)).sink(daily(spark, sf_dir).select("sym", "time", "n"), scheme="month").as_reader().scan()


@query(f"WITH {DAILY} SELECT sym, time, CASE WHEN day(time) = 2 THEN -n ELSE n END AS n FROM d", dates=("time",))
def sink_auto_write(spark, sf_dir):
    return _fresh(spark, sf_dir).sink(_patch(spark, sf_dir, "day(time) = 2").select("sym", "time", (-F.col("n")).alias("n"))).as_reader().scan(columns=["n"])


@query(f"WITH {DAILY} SELECT 'new' AS sym, time, n FROM d WHERE sym = 'view'", dates=("time",))
def sink_auto_update(spark, sf_dir):
    new = _patch(spark, sf_dir, "sym = 'view'").select(F.lit("new").alias("sym"), "time", "n")
    return _fresh(spark, sf_dir).sink(new).as_reader().scan(columns=["n"])


@query(f"WITH {DAILY} SELECT sym, time, n FROM d UNION ALL SELECT 'new', time, n FROM d WHERE sym = 'view'", dates=("time",))
def ext_upsert(spark, sf_dir):
    new = _patch(spark, sf_dir, "sym = 'view'").select(F.lit("new").alias("sym"), "time", "n")
    return _fresh(spark, sf_dir).sink(new, mode="upsert").as_reader().scan(columns=["n"])


# ---- 2.11: columns ----


@query(f"WITH {DAILY} SELECT sym, time, hi, lo, n AS count, users FROM d", dates=("time",))
def ddl_rename(spark, sf_dir):
    return _fresh(spark, sf_dir).rename_field("n", "count").as_reader().scan()


@query(f"WITH {DAILY} SELECT sym, time, lo, n, users FROM d", dates=("time",))
def ddl_delete(spark, sf_dir):
    return _fresh(spark, sf_dir).delete_field("hi").as_reader().scan()


@query(f"WITH {DAILY} SELECT sym, time, n, CAST(NULL AS DOUBLE) AS signal FROM d", dates=("time",))
def ddl_init_null(spark, sf_dir):
    return _fresh(spark, sf_dir).init_field("signal", "double").as_reader().scan(columns=["n", "signal"])


@query(f"WITH {DAILY} SELECT sym, time, CAST(trunc(hi) AS BIGINT) AS hi FROM d", dates=("time",))
def cast_f64_i64(spark, sf_dir):
    return _fresh(spark, sf_dir).cast_field("hi", "int64").as_reader().scan(columns=["hi"])


@query(f"WITH {DAILY} SELECT sym, time, CAST(xor(users & 255, 128) - 128 AS TINYINT) AS users FROM d", dates=("time",))
def cast_wrap_i8(spark, sf_dir):
    return _fresh(spark, sf_dir).cast_field("users", "int8").as_reader().scan(columns=["users"])


@query(f"WITH {DAILY} SELECT sym, time, (users & 255) <> 0 AS users FROM d", dates=("time",))
def cast_bool(spark, sf_dir):
    return _fresh(spark, sf_dir).cast_field("users", "bool").as_reader().scan(columns=["users"])


@query(f"WITH {TICKS} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 9223372036854775807 WHEN event_id % 3 = 1 THEN 0 ELSE CAST(trunc(value) AS BIGINT) END AS x FROM t")
def cast_saturate(spark, sf_dir):
    t = ticks(spark, sf_dir)
    v = F.when(F.col("event_id") % 3 == 0, F.lit(1e30)).when(F.col("event_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return t.select("event_id", cast_column(v, "float64", "int64").alias("x"))


@query(f"""WITH {DAILY} SELECT sym, time, CAST(NULL AS DOUBLE) AS vol, n FROM d UNION ALL SELECT sym, time + 60, CAST(n AS DOUBLE), n FROM d""", dates=("time",))
def fix_heal(spark, sf_dir):
    d = daily(spark, sf_dir).select("sym", "time", "n")
    later = d.withColumn("time", F.date_add("time", 60)).withColumn("vol", F.col("n").cast("double"))
    return GridWriter(spark, scratch(spark)).init(d, "month").update(later).fix().as_reader().scan()


@query(f"WITH {DAILY} SELECT sym, time, n FROM d", dates=("time",))
def compress_decompress(spark, sf_dir):
    return _fresh(spark, sf_dir).decompress().compress("lz4").as_reader().scan(columns=["n"])


# ---- 2.7, 2.8, 2.9, 2.12: the host's operations over grids ----


@query(f"WITH {TICKS} SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, round(sum(value), 2) AS total FROM t")
def agg_count_sum(spark, sf_dir):
    return _t(spark, sf_dir, columns=["user_id", "value"]).agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {FULL} SELECT count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM f WHERE year(time) = 1998")
def agg_count_sum_year(spark, sf_dir):
    return table(spark, sf_dir, "Y", "year").scan(start=dt.date(1998, 1, 1), end=dt.date(1999, 1, 1), columns=["qty"]).agg(F.count("*").alias("n"), F.sum("qty").cast("long").alias("qty"))


@query(f"WITH {TICKS} SELECT sym, round(avg(value), 6) AS mean FROM t GROUP BY sym")
def agg_by_sym(spark, sf_dir):
    return _t(spark, sf_dir, columns=["value"]).groupBy("sym").agg(F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {TICKS} SELECT sym, count(*) AS n FROM t WHERE value > 50 GROUP BY sym")
def sql_view(spark, sf_dir):
    name = f"v_{uuid.uuid4().hex}"
    table(spark, sf_dir, "T", "month").register(name)
    return spark.sql(f"SELECT sym, count(*) AS n FROM {name} WHERE value > 50 GROUP BY sym")


@query(f"WITH {TICKS} SELECT sym, time, value FROM t ORDER BY value DESC, event_id LIMIT 10")
def topk_value(spark, sf_dir):
    return _t(spark, sf_dir, columns=["value", "event_id"]).orderBy(F.desc("value"), "event_id").limit(10).select("sym", "time", "value")


@query("SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_dimensions(spark, sf_dir):
    o, c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("orders"))


@query(f"WITH {DAILY} SELECT sym, time, n FROM d WHERE n % 2 = 0 EXCEPT SELECT sym, time, n FROM d WHERE day(time) > 20", dates=("time",))
def set_except(spark, sf_dir):
    d = daily(spark, sf_dir).select("sym", "time", "n")
    return d.filter("n % 2 = 0").exceptAll(d.filter("day(time) > 20"))


@query(f"WITH {DAILY} SELECT sym, time, n, n - coalesce(lag(n) OVER (PARTITION BY sym ORDER BY time), 0) AS delta FROM d", dates=("time",))
def codec_delta(spark, sf_dir):
    return codec.delta(daily(spark, sf_dir).select("sym", "time", "n"), "n", ["sym"], ["time"])


@query(f"WITH {DAILY} SELECT sym, time, n AS value FROM d", dates=("time",))
def codec_delta_decode(spark, sf_dir):
    made = codec.delta(daily(spark, sf_dir).select("sym", "time", "n"), "n", ["sym"], ["time"])
    return codec.delta_decode(made, ["sym"], ["time"]).select("sym", "time", "value")


@query(f"WITH {DAILY}, v AS (SELECT sym, time, n % 2 AS v FROM d), c AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY sym ORDER BY time) AND row_number() OVER (PARTITION BY sym ORDER BY time) > 1 THEN 1 ELSE 0 END AS c FROM v), g AS (SELECT *, CAST(sum(c) OVER (PARTITION BY sym ORDER BY time) AS BIGINT) AS run FROM c) SELECT sym, run, min(v) AS value, count(*) AS length FROM g GROUP BY sym, run")
def codec_rle(spark, sf_dir):
    d = daily(spark, sf_dir).select("sym", "time", (F.col("n") % 2).alias("v"))
    return codec.runs(d, "v", ["sym"], ["time"]).withColumn("run", F.col("run").cast("long"))


@query(f"WITH {DAILY}, z AS (SELECT sym, CASE WHEN n - 30 < 0 THEN -2 * (n - 30) - 1 ELSE 2 * (n - 30) END AS z FROM d) SELECT sym, CAST(max(greatest(length(bin(z)), 1)) AS INTEGER) AS bits FROM z GROUP BY sym")
def codec_bitwidth(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("sym").agg(F.max(codec.zigzag_width(F.col("n") - 30)).alias("bits"))


@query(f"WITH {TICKS} SELECT l.sym, l.time, l.event_id, r.value AS asof_value FROM (SELECT * FROM t WHERE user_id % 2 = 0) l ASOF LEFT JOIN (SELECT * FROM t WHERE user_id % 2 = 1) r ON l.sym = r.sym AND l.time >= r.time")
def ext_asof(spark, sf_dir):
    t = ticks(spark, sf_dir)
    left = t.filter("user_id % 2 = 0").select("sym", "time", "event_id")
    return extensions.asof_join(left, t.filter("user_id % 2 = 1").select("sym", "time", "value"), "value")


@query(f"WITH {FULL} SELECT sym, time, CAST(qty AS DOUBLE) AS qty, CAST(n AS DOUBLE) AS n FROM f", dates=("time",))
def ext_densify(spark, sf_dir):
    return extensions.densify(lines(spark, sf_dir)).select("sym", "time", F.col("qty").cast("double").alias("qty"), F.col("n").cast("double").alias("n"))


@query(f"WITH {TICKS} SELECT sym, time_bucket(INTERVAL 1 HOUR, time) AS time, arg_min(value, time) AS open, max(value) AS high, min(value) AS low, arg_max(value, time) AS close, count(*) AS n FROM t GROUP BY ALL")
def ext_bars(spark, sf_dir):
    return bars(ticks(spark, sf_dir), "1 hour", "value")


# ---- batches, scans looked at, table function ----


def _frame(spark, reader, columns: str) -> DataFrame:
    return spark.createDataFrame(reader.read_all().to_pandas(), columns)


@query(f"WITH {DAILY} SELECT sym, time, n FROM d", dates=("time",))
def arrow_read_all(spark, sf_dir):
    with table(spark, sf_dir, "D", "month").batches(columns=["n"]) as r:
        return _frame(spark, r, "sym string, time date, n long")


@query(f"WITH {ROWNO} SELECT CAST(row_no // 7 AS BIGINT) AS batch, count(*) AS rows, min(sym) AS first_sym, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL")
def arrow_batches(spark, sf_dir):
    rows = []
    for k, b in enumerate(table(spark, sf_dir, "D", "month").batches(7, columns=["n"])):
        rows.append((k, b.num_rows, min(b.column("sym").to_pylist()), sum(b.column("n").to_pylist())))
    return spark.createDataFrame(rows, "batch long, rows long, first_sym string, n long")


@query(f"WITH {DAILY} SELECT sym, time, n FROM d WHERE sym = 'click'", dates=("time",))
def arrow_round_trip(spark, sf_dir):
    t = table(spark, sf_dir, "D", "month").to_arrow(symbols="click", columns=["n"])
    return GridWriter(spark, scratch(spark)).init(t, "month").as_reader().scan()


@query(f"WITH {FULL} SELECT count(DISTINCT year(time)) AS partitions, count(*) AS remaining, 'qty' AS projection, 5 AS max_rows, 'year' AS scheme FROM f WHERE year(time) >= 1996")
def scan_introspection(spark, sf_dir):
    r = table(spark, sf_dir, "Y", "year").request(start=dt.date(1996, 3, 1), columns=["qty"], limit=5)
    return spark.createDataFrame([(len(r.partitions), r.remaining, ",".join(r.projection), r.limit, r.table_scheme)], "partitions long, remaining long, projection string, max_rows int, scheme string")


@query(f"WITH {FULL} SELECT sym, time, CAST(qty AS DOUBLE) AS qty FROM f ORDER BY year(time), sym, time LIMIT 9", dates=("time",))
def scan_limit_first_partitions(spark, sf_dir):
    return table(spark, sf_dir, "Y", "year").scan(columns=["qty"], limit=9)


@query(f"WITH {TICKS} SELECT sym, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM t WHERE value > 50 AND time >= TIMESTAMP '2024-01-10' GROUP BY sym")
def table_function(spark, sf_dir):
    source.register(spark)
    at = table(spark, sf_dir, "T", "month").path
    t = spark.read.format("lattica").option("start", "2024-01-10").load(at)
    return t.filter("value > 50").groupBy("sym").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


# ---- more writes and columns ----


@query(f"WITH {DAILY} SELECT sym, time, n, CASE WHEN day(time) < 9 THEN n * 0.5::DOUBLE END AS half FROM d", dates=("time",))
def init_field_data(spark, sf_dir):
    half = _patch(spark, sf_dir, "day(time) < 9").select("sym", "time", (F.col("n") * 0.5).alias("half"))
    return _fresh(spark, sf_dir).init_field("half", "double", half).as_reader().scan(columns=["n", "half"])


@query(f"WITH {DAILY} SELECT sym, time, n, CASE WHEN sym < 'p' THEN CAST(0.25 AS DOUBLE) * n END AS hi FROM d", dates=("time",))
def update_field(spark, sf_dir):
    new = _patch(spark, sf_dir, "sym < 'p'").select("sym", "time", (F.col("n") * 0.25).alias("hi"))
    return _fresh(spark, sf_dir).update_field("hi", new).as_reader().scan(columns=["n", "hi"])


@query(f"WITH {DAILY} SELECT sym, time, n, CASE WHEN time <> DATE '2024-01-09' THEN users END AS users FROM d", dates=("time",))
def delete_field_partition(spark, sf_dir):
    return _fresh(spark, sf_dir, "date").delete_field("users", "date=2024-01-09").as_reader().scan(columns=["n", "users"])


@query(f"WITH {DAILY} SELECT sym, time, n FROM d", dates=("time",))
def decompress_partition(spark, sf_dir):
    return _fresh(spark, sf_dir, "date").decompress("date=2024-01-09").as_reader().scan(columns=["n"])


@query(f"WITH {DAILY} SELECT sym, time, n FROM d", dates=("time",))
def rename_table(spark, sf_dir):
    return _fresh(spark, sf_dir).rename(f"renamed-{uuid.uuid4().hex}").as_reader().scan(columns=["n"])


@query(f"WITH {DAILY} SELECT sym, time, CAST(n AS SMALLINT) AS small, CAST(users AS BIGINT) AS wide FROM d", dates=("time",))
def unsigned_types(spark, sf_dir):
    """Unsigned types as wide as the result's: uint16 for counts of SMALLINT, uint64 for the 64 bits of BIGINT sums, negative ones too."""
    d = daily(spark, sf_dir).select("sym", "time", F.col("n").cast("smallint").alias("small"), cast_column(F.col("users"), "int64", "uint64").alias("wide"))
    rows = GridWriter(spark, scratch(spark)).init(d, "month", kinds={"small": "uint16", "wide": "uint64"}).as_reader().scan()
    return rows.withColumns({"small": F.col("small").cast("smallint"), "wide": cast_column(F.col("wide"), "uint64", "int64")})


@query(f"WITH {DAILY}, s AS (SELECT sym, time, n, row_number() OVER (PARTITION BY sym, time ORDER BY k DESC) AS r FROM (SELECT sym, time, n, 1 AS k FROM d UNION ALL SELECT sym, time, -n, 2 FROM d WHERE day(time) % 2 = 0)) SELECT sym, time, n FROM s WHERE r = 1", dates=("time",))
def stream_ingest(spark, sf_dir):
    """A file stream through foreachBatch; of repeated keys the row of the greatest k stays."""
    d, at = daily(spark, sf_dir).select("sym", "time", "n"), scratch(spark)
    both = d.withColumn("k", F.lit(1)).unionByName(d.filter("day(time) % 2 = 0").select("sym", "time", (-F.col("n")).alias("n")).withColumn("k", F.lit(2)))
    both.coalesce(1).write.parquet(f"{at}/in")
    w = GridWriter(spark, f"{at}/table")
    stream = spark.readStream.schema(both.schema).parquet(f"{at}/in")
    write_stream(stream, w, f"{at}/checkpoint", order="k").trigger(availableNow=True).start().awaitTermination()
    return w.as_reader().scan()


# ---- more of the host's operations ----


@query(f"WITH {DAILY} SELECT sym, time, n FROM d WHERE n % 2 = 0 UNION SELECT sym, time, n FROM d WHERE day(time) > 20", dates=("time",))
def set_union(spark, sf_dir):
    d = daily(spark, sf_dir).select("sym", "time", "n")
    return d.filter("n % 2 = 0").union(d.filter("day(time) > 20")).distinct()


@query(f"WITH {DAILY} SELECT sym, time, n FROM d WHERE n % 2 = 0 INTERSECT SELECT sym, time, n FROM d WHERE day(time) > 20", dates=("time",))
def set_intersect(spark, sf_dir):
    d = daily(spark, sf_dir).select("sym", "time", "n")
    return d.filter("n % 2 = 0").intersect(d.filter("day(time) > 20"))


@query(f"WITH {DAILY} SELECT DISTINCT time, year(time) AS y, month(time) AS m, day(time) AS d, CAST(datediff('day', DATE '1970-01-01', time) AS INTEGER) AS days FROM d", dates=("time",))
def civil_calendar(spark, sf_dir):
    t = daily(spark, sf_dir).select("time").distinct()
    return t.select("time", F.year("time").alias("y"), F.month("time").alias("m"), F.day("time").alias("d"), F.unix_date("time").alias("days"))


@query(f"WITH {DAILY}, v AS (SELECT sym, n % 2 AS v, row_number() OVER (PARTITION BY sym ORDER BY time) - 1 AS place FROM d) SELECT sym, place, v AS value FROM v")
def codec_rle_decode(spark, sf_dir):
    d = daily(spark, sf_dir).select("sym", "time", (F.col("n") % 2).alias("v"))
    return codec.runs_decode(codec.runs(d, "v", ["sym"], ["time"]), ["sym"])


PLACED = DAILY + ", v AS (SELECT sym, n - 30 AS value, row_number() OVER (PARTITION BY sym ORDER BY time) - 1 AS place FROM d)"


def _placed(spark, sf_dir) -> DataFrame:
    d = daily(spark, sf_dir).select("sym", "time", (F.col("n") - 30).alias("value"))
    return index.bucketed.row_number(d, ["sym"], ["time"], index.bucketed.time_bucket(F.col("time")), "place").select("sym", "place", "value")


@query(f"WITH {PLACED}, z AS (SELECT sym, place // 8 AS block, place, CASE WHEN value < 0 THEN -2 * value - 1 ELSE 2 * value END AS z FROM v), w AS (SELECT sym, block, max(length(bin(z))) AS width FROM z GROUP BY ALL) SELECT sym, CAST(block AS BIGINT) AS block, CAST(any_value(width) AS INTEGER) AS width, count(*) AS length, string_agg(lpad(bin(z), CAST(width AS INTEGER), '0'), '' ORDER BY place) AS bits FROM z JOIN w USING (sym, block) GROUP BY sym, block")
def codec_bitpack(spark, sf_dir):
    return codec.pack(_placed(spark, sf_dir), "value", ["sym"], "place", 8)


@query(f"WITH {PLACED} SELECT sym, place, value FROM v")
def codec_bitpack_decode(spark, sf_dir):
    return codec.unpack(codec.pack(_placed(spark, sf_dir), "value", ["sym"], "place", 8), ["sym"], 8)


def _md5_sum(c: str) -> str:
    return f"CAST(sum(CAST('0x' || substr(md5(coalesce(CAST({c} AS VARCHAR), 'null')), 1, 15) AS HUGEINT)) % 9223372036854775808::HUGEINT AS BIGINT) AS {c}"


@query(f"WITH {DAILY} SELECT {_md5_sum('sym')}, {_md5_sum('n')}, {_md5_sum('users')} FROM d")
def checksum_columns(spark, sf_dir):
    return codec.checksum(table(spark, sf_dir, "D", "month").scan(), ["sym", "n", "users"])


@query(f"WITH {TICKS} SELECT event_id, json_extract_string(props, '$.k') AS k, upper(sym) AS loud, [substr(sym, 1, 1), sym][2] AS second FROM t")
def string_json_array(spark, sf_dir):
    return _t(spark, sf_dir, columns=["event_id", "props"]).select("event_id", F.get_json_object("props", "$.k").alias("k"), F.upper("sym").alias("loud"), F.get(F.array(F.substring("sym", 1, 1), F.col("sym")), F.lit(1)).alias("second"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _made.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _made.items() if s}
