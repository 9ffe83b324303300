import datetime as dt
import uuid

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica import errors, queries
from lattica.functions.calendar import civil_from_days, days_from_civil, fits, parse_scheme, partition_name, partition_range
from lattica.functions.types import cast_column
from lattica.functions import codec
from lattica.operators import bucketed, index, ranges
from lattica.plans.planner import prune
from lattica.plans.predicate import And, Cmp, Not, Or, to_column
from lattica.sources import source
from lattica.sources.reader import GridReader, open_table
from lattica.sources.writer import GridWriter
from lattica.streaming.ingest import write_stream


def d(m, day):
    return dt.date(2026, m, day)


# The surveyed example's rows.
ROWS = [("AAPL", d(8, 3), 10.0), ("AAPL", d(8, 4), 11.0), ("MSFT", d(8, 3), 20.0), ("MSFT", d(8, 4), 21.0), ("AAPL", d(9, 1), 12.0), ("AAPL", d(9, 2), 13.0), ("MSFT", d(9, 1), 22.0), ("MSFT", d(9, 2), 23.0)]
SCHEMA = "sym string, time date, price double"


@pytest.fixture
def table(spark, tmp_path):
    return GridWriter(spark, str(tmp_path / "t")).init(spark.createDataFrame(ROWS, SCHEMA), "month")


def prices(w, **request):
    return [r["price"] for r in w.as_reader().ordered(**request).collect()]


def test_scan_and_statistics(table):
    r = table.as_reader()
    assert r.plan() == ["month=2026-08", "month=2026-09"]
    assert prices(table) == [10, 11, 20, 21, 12, 13, 22, 23]
    assert r.scan(start=d(9, 1), end=d(10, 1)).count() == 4
    assert r.plan(start=d(9, 1)) == ["month=2026-09"]
    assert all("2026-09" in f for f in r.scan(start=d(9, 1)).inputFiles())
    assert r.plan(predicate=Cmp("time", "<", d(9, 1))) == ["month=2026-08"]
    assert r.scan(symbols="MSFT").count() == 4
    assert prices(table, limit=5) == [10, 11, 20, 21, 12]
    s = r.statistics()
    assert (s["row_count"], s["partition_count"], s["sym_min"], s["sym_max"]) == (8, 2, "AAPL", "MSFT")
    assert r.scan(columns=["price", "sym", "price"]).columns == ["sym", "time", "price"]
    with pytest.raises(errors.NotFound):
        r.scan(columns=["nope"])


def test_write_patches_and_fails_whole(spark, table):
    table.write(spark.createDataFrame([("AAPL", d(8, 3), 111.0), ("MSFT", d(8, 3), None)], SCHEMA))
    assert prices(table) == [111, 11, None, 21, 12, 13, 22, 23]
    before = table.as_reader().manifest()
    for bad, error in (
        ([("AAPL", d(8, 3), 1.0), ("AAPL", d(8, 9), 1.0)], errors.KeyMissing),
        ([("AAPL", d(8, 3), 1.0), ("AAPL", d(8, 3), 2.0)], errors.Invalid),
    ):
        with pytest.raises(error):
            table.write(spark.createDataFrame(bad, SCHEMA))
    with pytest.raises(errors.Invalid):
        table.write(spark.createDataFrame([("AAPL", d(8, 3), 1)], "sym string, time date, price long"))
    assert table.as_reader().manifest() == before


def test_new_columns_are_null_elsewhere(spark, table):
    table.write(spark.createDataFrame([("AAPL", d(8, 3), 111), ("MSFT", d(8, 3), 222)], "sym string, time date, volume long"))
    got = [r["volume"] for r in table.as_reader().ordered().collect()]
    assert got == [111, None, 222, None, None, None, None, None]
    assert prices(table) == [10, 11, 20, 21, 12, 13, 22, 23]


def test_update_and_delete(spark, table):
    table.update(spark.createDataFrame([("AAPL", d(8, 1), 99.0), ("GOOG", d(10, 1), 77.0)], SCHEMA))
    assert prices(table) == [99, 12, 13, 22, 23, 77]
    table.delete_partition("month=2026-08")
    assert table.as_reader().plan() == ["month=2026-09", "month=2026-10"]
    with pytest.raises(errors.NotFound):
        table.delete_partition("month=2026-08")
    with pytest.raises(errors.Invalid):
        table.delete_partition("date=2026-08-01")


def test_batches(spark, tmp_path):
    rows = [("A", d(m, k), float(i)) for i, (m, k) in enumerate((m, k) for m in (7, 8, 9) for k in (1, 2, 3))]
    r = GridWriter(spark, str(tmp_path / "b")).init(spark.createDataFrame(rows, SCHEMA), "month").as_reader()
    assert [b.num_rows for b in r.batches(4)] == [4, 4, 1]
    assert [b.num_rows for b in r.batches()] == [3, 3, 3]
    assert sum(b.num_rows for b in r.batches(2, limit=5)) == 5
    with pytest.raises(errors.Invalid):
        list(r.batches(0))


def test_grid_rules(spark, tmp_path):
    for rows in ([("A", d(1, 1), 1.0), ("A", d(1, 3), 1.0), ("B", d(1, 2), 1.0)], [("A", d(1, 1), 1.0), ("A", d(1, 1), 2.0)]):
        with pytest.raises(errors.NonContiguousTime):
            GridWriter(spark, str(tmp_path / "g")).init(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(errors.Invalid):
        GridWriter(spark, str(tmp_path / "g")).init(spark.createDataFrame([(None, d(1, 1), 1.0)], SCHEMA))


def test_index(spark):
    rows = [("A", d(1, 1)), ("A", d(1, 2)), ("A", d(1, 3)), ("B", d(1, 2)), ("B", d(1, 3)), ("B", d(1, 4)), ("C", d(1, 10))]
    df = spark.createDataFrame(rows, "sym string, time date").withColumn("part", F.lit(""))
    got = sorted((r["sym"], r["time_start"], r["time_count"], r["row_start"]) for r in index.sym_index(df).collect())
    assert got == [("A", 0, 3, 0), ("B", 1, 3, 3), ("C", 4, 1, 6)]
    assert [(r["offset"], r["length"]) for r in index.locate(df, df).collect()] == [(0, 7)]
    with pytest.raises(errors.KeyMissing):
        index.locate(df, spark.createDataFrame([("", "D", d(1, 1))], "part string, sym string, time date"))


def test_ranges(spark):
    make = lambda rows: spark.createDataFrame([("", *r) for r in rows], "part string, offset long, length long")
    pairs = lambda df: sorted((r["offset"], r["length"]) for r in df.collect())
    assert pairs(ranges.merge(make([(100, 30), (50, 10), (130, 20), (200, 5)]))) == [(50, 10), (100, 50), (200, 5)]
    assert pairs(ranges.clamp(make([(5, 40), (100, 5)]), 30)) == [(5, 25)]
    assert pairs(ranges.intersect(make([(0, 10), (20, 10)]), make([(5, 20)]))) == [(5, 5), (20, 5)]


@pytest.mark.parametrize(
    ("p", "want"),
    [(Cmp("x", "!=", 999.0), [0, 2, 4, 5]), (Not(Cmp("x", "<", 50.0)), [2, 5]), (Or((Cmp("x", ">", 100.0), Cmp("x", "<", 20.0))), [0, 4]), (Cmp("x", ">", 2.0), [0, 2, 4]), (And(()), [0, 1, 2, 3, 4, 5]), (Or(()), []), (Cmp("x", "!=", float("nan")), [0, 2, 4, 5])],
)
def test_predicates(spark, p, want):
    df = spark.createDataFrame([(0, 10.0), (1, None), (2, 60.0), (3, None), (4, 5.0), (5, float("nan"))], "i int, x double")
    assert sorted(r["i"] for r in df.filter(to_column(p, {"x": "float64"})).collect()) == want
    with pytest.raises(errors.Invalid):
        to_column(Cmp("x", "=", "a"), {"x": "float64"})


def test_casts(spark):
    one = lambda v, a, b: spark.createDataFrame([(v,)], f"x {'double' if a == 'float64' else 'long'}").select(cast_column(F.col("x"), a, b).alias("y")).first()["y"]
    assert [one(v, "float64", "int32") for v in (1.0, 2.5, -3.0)] == [1, 2, -3]
    assert (one(300.0, "float64", "int8"), one(3e9, "float64", "int8"), one(1e30, "float64", "int64"), one(float("nan"), "float64", "int64")) == (44, 0, (1 << 63) - 1, 0)
    assert [one(v, "int64", "bool") for v in (256, 1, 0)] == [False, True, False]
    assert (one(0.5, "float64", "bool"), one(-1, "int64", "uint8"), int(one(-1, "int64", "uint64"))) == (False, 255, (1 << 64) - 1)


def test_unsigned_counts_and_sums_of_any_size(spark, tmp_path):
    # more rows a day than a byte counts, up to SMALLINT's most; sums above 32 bits, below 0, null, and at both ends of BIGINT
    days = [(300, 20_000_000), (32_767, 1), (1, -7), (1, None), (1, (1 << 63) - 1), (1, -(1 << 63))]
    spark.createDataFrame([(n, u, dt.datetime(2024, 1, k + 1, 12)) for k, (n, u) in enumerate(days)], "n int, user_id long, ts timestamp_ntz").select(
        F.lit("a").alias("event_type"), "ts", "user_id", F.lit(0.5).alias("value"), F.explode(F.sequence(F.lit(1), "n")).alias("event_id"), F.lit("{}").alias("props")
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = queries.queries()["unsigned_types"](spark, str(tmp_path))
    assert got.dtypes[2:] == [("small", "smallint"), ("wide", "bigint")]
    got = [tuple(r) for r in got.orderBy("time").collect()]
    assert [r[2:] for r in got] == [(n, None if u is None else n * u) for n, u in days]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == db.execute(f"SELECT * FROM ({queries.oracle_sql()['unsigned_types']}) ORDER BY time").fetchall()


@pytest.mark.parametrize("bits", [8, 16, 32, 64])
def test_unsigned_bounds(spark, tmp_path, bits):
    kind, top = f"uint{bits}", (1 << bits) - 1
    rows = lambda *v: spark.createDataFrame([("A", d(1, k + 1), str(x)) for k, x in enumerate(v)], "sym string, time date, x string").withColumn("x", F.col("x").cast("decimal(20,0)"))
    w = GridWriter(spark, str(tmp_path / "t")).init(rows(0, top), kinds={"x": kind})
    assert [int(r["x"]) for r in w.as_reader().ordered().collect()] == [0, top]
    for k, bad in enumerate((-1, top + 1)[: 1 if bits == 64 else 2]):
        with pytest.raises(errors.Invalid):
            GridWriter(spark, str(tmp_path / f"bad{k}")).init(rows(bad), kinds={"x": kind})


def test_columns(spark, table):
    table.init_field("signal", "double").rename_field("price", "factor.close")
    assert list(table.as_reader().schema()) == ["sym", "time", "factor.close", "signal"]
    with pytest.raises(errors.AlreadyExists):
        table.init_field("signal", "double")
    table.cast_field("factor.close", "int8").delete_field("signal").init_field("signal", "int64")
    assert [r["factor.close"] for r in table.as_reader().ordered().collect()] == [10, 11, 20, 21, 12, 13, 22, 23]
    assert table.as_reader().scan().filter("signal is not null").count() == 0
    with pytest.raises(errors.InvalidState):
        table.compress()
    table.decompress()
    assert not table.as_reader().field_is_compressed()


def test_lock_and_arrow_and_sink(spark, tmp_path):
    w = GridWriter(spark, str(tmp_path / "s"))
    t = pa.table({"sym": pa.array(["A", "G"]).dictionary_encode(), "time": pa.array([1_000_000, 1_000_000], pa.timestamp("us")), "open": [1.0, 2.0], "close": [3.0, 4.0]})
    w.sink(t)
    assert w.as_reader().to_arrow(columns=["sym", "close"]).column_names == ["sym", "time", "close"]
    with w.store.lock(), pytest.raises(errors.InvalidState):
        w.sink(t)
    w.sink(t.append_column("factor_alpha", pa.array([0.1, 0.2])))
    assert w.as_reader().scan().columns == ["sym", "time", "close", "factor_alpha", "open"]
    w.sink(pa.table({"sym": ["Z"], "time": pa.array([2_000_000], pa.timestamp("us")), "open": [9.0], "close": [9.0]}))
    assert GridReader(spark, str(tmp_path / "s")).statistics()["row_count"] == 1
    w.drop()
    with pytest.raises(errors.NotFound):
        w.as_reader()


def test_calendar():
    assert civil_from_days(days_from_civil(1969, 12, 31)) == (1969, 12, 31)
    assert partition_name("month", d(9, 2)) == "month=2026-09"
    assert partition_range("month=2026-12") == (dt.datetime(2026, 12, 1), dt.datetime(2027, 1, 1))
    assert fits("date", "date=2026-09-02") and not fits("date", "date=2026-9-2") and parse_scheme("day") == "date"
    assert prune(["month=2026-08", "month=2026-09"], dt.datetime(2026, 9, 1), None) == ["month=2026-09"]
    with pytest.raises(errors.Invalid):
        partition_range("month=2026-13")


def test_limit_and_symbols_prune(spark, table):
    r = table.as_reader()
    opened = lambda **request: {f.split("__part=")[1].split("/")[0] for f in r.scan(**request).inputFiles()}
    assert opened(limit=3) == {"month-2026-08"} and opened(limit=5) == {"month-2026-08", "month-2026-09"}
    assert r.plan(symbols="NONE") == [] or r.plan(symbols="ZZZ") == []
    assert r.scan(symbols="ZZZ").count() == 0 and r.scan(limit=0).count() == 0
    with pytest.raises(errors.Invalid):
        r.scan(limit=-1)


def test_request_shows_what_it_reads(spark, table):
    s = GridReader(spark, table.path, max_parallelism=1).request(start=d(9, 1), columns=["price"], limit=3)
    assert (s.partitions, s.remaining, s.projection, s.limit, s.table_scheme, s.max_parallelism) == (["month=2026-09"], 4, ["price"], 3, "month", 1)
    assert s.frame().count() == 3 and [b.num_rows for b in s.into_reader(2)] == [2, 1]
    assert GridReader(spark, table.path, 1).scan().rdd.getNumPartitions() == 1


def test_batch_reader(spark, table):
    r = table.as_reader().batches(3, columns=["price"])
    assert r.next().num_rows == 3
    rest = r.read_all()
    assert rest.column("price").to_pylist() == [21, 12, 13, 22, 23] and rest.schema.names == ["sym", "time", "price"]
    assert r.next() is None
    with table.as_reader().batches() as b:
        first = next(b)
    assert first.num_rows > 0
    with pytest.raises(errors.InvalidState):
        next(b)
    assert table.as_reader().batches(symbols="ZZZ").read_all().num_rows == 0


def test_open_modes_and_errors(spark, table, tmp_path):
    assert isinstance(open_table(spark, table.path, "w"), GridWriter) and isinstance(open_table(spark, table.path), GridReader)
    for path, mode, error in ((str(tmp_path / "none"), "w", errors.NotFound), (table.path, "x", errors.Invalid)):
        with pytest.raises(error):
            open_table(spark, path, mode)
    with pytest.raises(errors.Codec):
        table.compress("rar")
    store = table.store
    store.files.create(store.files.path(store.grid, "v99999999.json"), "{broken")
    with pytest.raises(errors.Format):
        table.as_reader()


def jobs(spark, work):
    """How many Spark jobs ``work`` runs."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    work()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_write_takes_few_jobs(spark, table):
    patch = spark.createDataFrame(ROWS[:2], SCHEMA)
    assert jobs(spark, lambda: table.write(patch)) < 20
    assert jobs(spark, lambda: table.update(patch)) < 12


def test_failed_writes_leave_nothing(spark, table):
    folders = lambda: table.store.files.names(table.store.files.path(table.store.files.root, "data"))
    before = folders()
    for bad, error in (([("AAPL", d(8, 9), 1.0)], errors.KeyMissing), ([(None, d(8, 3), 1.0)], errors.Invalid), ([("NEW", d(8, 30), 1.0), ("NEW", d(8, 28), 1.0), ("B", d(8, 29), 1.0)], errors.KeyMissing)):
        with pytest.raises(error):
            table.write(spark.createDataFrame(bad, SCHEMA))
    with pytest.raises(errors.NonContiguousTime):
        table.update(spark.createDataFrame([("A", d(8, 1), 1.0), ("A", d(8, 3), 1.0), ("B", d(8, 2), 1.0)], SCHEMA))
    assert folders() == before and prices(table) == [10, 11, 20, 21, 12, 13, 22, 23]


def test_ticks_share_no_axis(spark, tmp_path):
    rows = [("A", d(1, 1), 1.0), ("A", d(1, 3), 1.0), ("B", d(1, 2), 1.0), ("B", d(1, 2), 2.0)]
    w = GridWriter(spark, str(tmp_path / "t")).init(spark.createDataFrame(rows, SCHEMA), rule="ticks")
    assert w.as_reader().scan().count() == 4 and w.as_reader().meta()["rule"] == "ticks"
    with pytest.raises(errors.Invalid):
        GridWriter(spark, str(tmp_path / "u")).init(spark.createDataFrame(rows, SCHEMA), rule="none")


def test_stream_aborts(spark, table):
    s = table.stream().write_partition(spark.createDataFrame([("A", d(11, 1), 1.0)], SCHEMA))
    with pytest.raises(errors.InvalidState):
        s.write_partition(spark.createDataFrame([("B", d(11, 2), 1.0)], SCHEMA))
    s.abort()
    assert prices(table) == [10, 11, 20, 21, 12, 13, 22, 23]
    with table.stream() as s:
        s.write_partition(spark.createDataFrame([("A", d(11, 1), 1.0)], SCHEMA))
    assert prices(table)[-1] == 1
    with pytest.raises(ValueError), table.stream() as s:
        raise ValueError
    table.update(spark.createDataFrame([("A", d(11, 1), 2.0)], SCHEMA))


def test_vacuum_spares_young_folders(spark, table):
    old = table.as_reader().scan()
    table.update(spark.createDataFrame(ROWS[:1], SCHEMA))
    table.fix()
    assert old.count() == 8
    table.fix(age_s=0)
    assert prices(table) == [10, 12, 13, 22, 23]


def test_empty_partitions(spark, table):
    table.create_partition("month=2027-01").rename_partition("month=2027-01", "month=2027-02")
    assert table.as_reader().plan()[-1] == "month=2027-02" and table.as_reader().statistics()["partition_count"] == 2
    with pytest.raises(errors.Invalid):
        table.rename_partition("month=2026-08", "month=2026-07")
    table.update(spark.createDataFrame([("A", d(2, 1).replace(year=2027), 5.0)], SCHEMA))
    assert prices(table)[-1] == 5
    table.decompress("month=2026-08")
    assert {p.name: p.codec for p in table.as_reader().manifest().partitions}["month=2026-08"] == "none"


def test_buckets_meet(spark, monkeypatch):
    """Ranges over many buckets, against sets of rows."""
    monkeypatch.setattr(bucketed, "ROWS", 4)
    make = lambda rows: spark.createDataFrame([("", *r) for r in rows], "part string, offset long, length long")
    got = lambda df: sorted((r["offset"], r["length"]) for r in df.collect())

    def islands_of(rows):
        rows, out = sorted(rows), []
        for x in rows:
            if out and out[-1][0] + out[-1][1] == x:
                out[-1][1] += 1
            else:
                out.append([x, 1])
        return [tuple(x) for x in out]

    cover = lambda ranges: {x for o, n in ranges for x in range(o, o + n)}
    a, b = [(-7, 5), (0, 3), (3, 1), (8, 20), (10, 2), (30, 4), (40, 0), (41, 1), (43, 9)], [(-3, 9), (11, 1), (16, 4), (20, 13), (44, 1), (46, 30)]
    assert got(ranges.merge(make(a))) == islands_of(cover(a))
    assert got(ranges.intersect(make(a), make(b))) == islands_of(cover(a) & cover(b))
    assert got(ranges.clamp(make(a), 25)) == islands_of({x for x in cover(a) if 0 <= x < 25})
    rows = spark.createDataFrame([("", x) for x in cover(b)], "part string, row_no long")
    assert got(ranges.islands(rows)) == islands_of(cover(b))
    assert ranges.contains(make(b), "", 19) and not ranges.contains(make(b), "", 10)


def test_running_in_buckets(spark):
    rows = [("A" if i % 3 else None, d(1 + i // 20, 1 + i % 20), i * 7 % 5 if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "sym string, time date, v long")
    b = bucketed.time_bucket(F.col("time"))
    assert df.select(b).distinct().count() > 3
    w = "OVER (PARTITION BY sym ORDER BY time"
    df.createOrReplaceTempView("running")
    want = spark.sql(f"SELECT sym, time, v, last(v, true) {w}) AS l, sum(v) {w}) AS s, row_number() {w}) - 1 AS n, lag(v) {w}) AS p FROM running")
    got = bucketed.last_value(df, F.col("v"), ["sym"], ["time"], b, "l")
    got = bucketed.row_number(bucketed.running_sum(got, F.coalesce("v", F.lit(0)), ["sym"], ["time"], b, "s"), ["sym"], ["time"], b, "n")
    got = bucketed.previous(got, F.col("v"), ["sym"], ["time"], b, "p").withColumn("p", F.col("p.v"))
    key = lambda r: repr((r["sym"], r["time"]))
    for x, y in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert (x["l"], x["s"], x["n"], x["p"]) == (y["l"], y["s"] or 0, y["n"], y["p"])


def test_codecs_round_trip(spark):
    values = [0, -1, 5, 5, 5, (1 << 62), -(1 << 62), 3, -(1 << 63), (1 << 63) - 1, 0, 0]
    df = spark.createDataFrame([("A", d(1, 1 + i), i, v) for i, v in enumerate(values)], "sym string, time date, place long, v long")
    packed = codec.pack(df, "v", ["sym"], "place", 4)
    assert packed.count() == 3 and max(r["width"] for r in packed.collect()) == 64
    assert [r["value"] for r in codec.unpack(packed, ["sym"], 4).orderBy("place").collect()] == values
    encoded = codec.runs(df, "v", ["sym"], ["time"])
    assert [r["value"] for r in codec.runs_decode(encoded, ["sym"]).orderBy("place").collect()] == values


def test_stream_keeps_the_latest(spark, tmp_path):
    shape = "sym string, time date, price double, seq long"
    feed = lambda rows, name: spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    w = GridWriter(spark, str(tmp_path / "t"))

    def run():
        stream = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        write_stream(stream, w, str(tmp_path / "c"), order="seq").trigger(availableNow=True).start().awaitTermination()

    feed([("A", d(1, 1), 9.0, 1), ("A", d(1, 1), 2.0, 2), ("A", d(1, 2), 3.0, 1)], "a")
    run()
    assert prices(w) == [2, 3]
    feed([("A", d(1, 2), 4.0, 3), ("A", d(1, 3), 5.0, 1)], "b")
    run()
    assert prices(w) == [2, 4, 5]


def test_data_source(spark, table):
    source.register(spark)
    table.init_field("late", "int64")
    df = spark.read.format("lattica").load(table.path)
    assert df.columns == ["sym", "time", "late", "price"] and df.count() == 8
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW v USING lattica OPTIONS (path '{table.path}', start '2026-08-04')")
    assert [r[0] for r in spark.sql("SELECT price FROM v WHERE time < DATE'2026-09-02' ORDER BY price").collect()] == [11, 12, 21, 22]
