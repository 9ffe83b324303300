"""Reading grid tables: lazy DataFrames, pruned to the partitions that can matter."""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.errors import Invalid, InvalidState, NotFound
from lattica.functions.calendar import partition_column, partition_range
from lattica.functions.types import spark_type
from lattica.operators import index
from lattica.plans.planner import bounds, prune
from lattica.plans.predicate import Predicate, to_column
from lattica.sources.manifest import Manifest, Store


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def parse(kind: str) -> T.DataType:
    """The Spark type of a logical type."""
    return T.StructType.fromDDL(f"x {spark_type(kind)}").fields[0].dataType


def open_table(spark: SparkSession, path: str, mode: str = "r", max_parallelism: int | None = None):
    """A reader (mode "r") or a writer ("w") of a table.  A reader doesn't change its table."""
    if mode == "r":
        return GridReader(spark, path, max_parallelism)
    if mode != "w":
        raise Invalid(f"unknown mode {mode!r}")
    from lattica.sources.writer import GridWriter

    w = GridWriter(spark, path)
    w.store.load()
    return w


def _to_ipc():
    """Made within, so that workers get it by value and need no package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["ipc"])

    return run


class BatchReader:
    """Arrow batches in table order, one Spark partition of a table's partition at a time.

    batch_size: that many rows in each batch but the last; None: batches as they come, and none reaches
    over two partitions of the table.  Iterates, or gives ``next()`` (None at the end), the rest by
    ``read_all()``, and nothing after ``close()``.
    """

    def __init__(self, reader: GridReader, batch_size: int | None, request: dict):
        if batch_size is not None and batch_size <= 0:
            raise Invalid("batch size must be positive")
        self.batch_size, self.closed = batch_size, False
        self.schema = reader.scan(**request | {"limit": 0}).toArrow().schema
        self._source = self._sized(self._pieces(reader, dict(request)))

    def _pieces(self, reader: GridReader, request: dict) -> Iterator[pa.RecordBatch]:
        left = request.pop("limit", None)
        chosen = reader.plan(request.get("start"), request.get("end"), request.get("predicate"), request.get("partitions"), request.get("symbols"))
        for p in chosen:
            if left is not None and left <= 0:
                return
            df = reader.ordered(**request | {"partitions": [p], "limit": left})
            for row in df.mapInArrow(_to_ipc(), "ipc binary").toLocalIterator():
                with pa.ipc.open_stream(pa.py_buffer(row["ipc"])) as source:
                    for batch in source:
                        if batch.num_rows:
                            left = None if left is None else left - batch.num_rows
                            yield batch.cast(self.schema)

    def _sized(self, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if self.batch_size is None:
            yield from pieces
            return
        held: list[pa.RecordBatch] = []
        rows = 0
        for piece in pieces:
            while piece.num_rows:
                part = piece.slice(0, self.batch_size - rows)
                piece = piece.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == self.batch_size:
                    yield pa.concat_batches(held)
                    held, rows = [], 0
        if rows:
            yield pa.concat_batches(held)

    def __iter__(self) -> BatchReader:
        return self

    def __next__(self) -> pa.RecordBatch:
        if self.closed:
            raise InvalidState("the reader is closed")
        return next(self._source)

    def next(self) -> pa.RecordBatch | None:
        return next(self, None)

    def read_all(self) -> pa.Table:
        """What is left, as one table."""
        return pa.Table.from_batches(list(self), self.schema)

    def close(self) -> None:
        self.closed = True
        self._source.close()

    def __enter__(self) -> BatchReader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Scan:
    """A request of a table, and what it will read: properties, then ``frame()``, ``ranges()`` or ``into_reader()``."""

    def __init__(self, reader: GridReader, request: dict):
        self._reader, self._request = reader, request
        self.projection = reader._columns(request.get("columns"))
        self.predicate, self.limit = request.get("predicate"), request.get("limit")
        self.table_root, self.table_scheme, self.max_parallelism = reader.path, reader.scheme, reader.max_parallelism
        self.partitions = reader.plan(request.get("start"), request.get("end"), self.predicate, request.get("partitions"), request.get("symbols"))
        rows = reader.manifest().named()
        #: Rows of the partitions that will be opened: no fewer than the scan gives.
        self.remaining = sum(rows[p].rows for p in self.partitions)

    def frame(self) -> DataFrame:
        return self._reader.scan(**self._request)

    def ranges(self) -> DataFrame:
        return self._reader.scan_ranges(**self._request)

    def into_reader(self, batch_size: int | None = None) -> BatchReader:
        return BatchReader(self._reader, batch_size, self._request)


class GridReader:
    """A table opened for reading. Each call sees the newest version.

    max_parallelism: tasks that a scan is cut into at most; None leaves that to Spark.
    """

    def __init__(self, spark: SparkSession, path: str, max_parallelism: int | None = None):
        if max_parallelism is not None and max_parallelism <= 0:
            raise Invalid("max_parallelism must be positive")
        self.spark, self.store, self.max_parallelism = spark, Store(spark, path), max_parallelism
        self.manifest()

    def manifest(self) -> Manifest:
        return self.store.load()

    @property
    def path(self) -> str:
        return self.store.path

    @property
    def scheme(self) -> str:
        return self.manifest().scheme

    def schema(self) -> dict[str, str]:
        """Logical type of each column: sym, time, then the fields by name."""
        m = self.manifest()
        return {"sym": "utf8", "time": m.time_kind} | {f.name: f.kind for f in sorted(m.fields, key=lambda f: f.name)}

    # ---- scans ----

    def plan(self, start=None, end=None, predicate: Predicate | None = None, partitions: list[str] | None = None, symbols=None) -> list[str]:
        """Names of the partitions that a scan opens, in order: by time, and by their least and greatest symbol."""
        m = self.manifest()
        names = list(m.named())
        if partitions is not None:
            gone = set(partitions) - set(names)
            if gone:
                raise NotFound(f"no partition {sorted(gone)[0]!r}")
            names = partitions
        names = prune(names, *bounds(start, end, predicate))
        if symbols is None:
            return names
        wanted = [symbols] if isinstance(symbols, str) else list(symbols)
        # Spark, which took the bounds, orders text by its bytes
        known = lambda p, s: p.sym_min is None or p.sym_min.encode() <= s.encode() <= p.sym_max.encode()
        return [n for n in names if any(known(m.named()[n], s) for s in wanted)]

    def _columns(self, columns: list[str] | None) -> list[str]:
        known = self.schema()
        if columns is None:
            return [c for c in known if c not in ("sym", "time")]
        out = []
        for c in columns:
            if c not in known:
                raise NotFound(f"no column {c!r}")
            if c not in ("sym", "time") and c not in out:
                out.append(c)
        return out

    def scan(self, symbols=None, start=None, end=None, predicate: Predicate | None = None, columns: list[str] | None = None, limit: int | None = None, partitions: list[str] | None = None, with_partition: bool = False) -> DataFrame:
        """sym, time and the columns asked for, of rows with start <= time < end.

        Lazy. A limit takes the first rows by partition, sym and time; where nothing else selects rows, it
        opens only the first partitions that hold so many.
        """
        m = self.manifest()
        chosen = self.plan(start, end, predicate, partitions, symbols)
        if limit is not None and limit < 0:
            raise Invalid("limit is negative")
        if limit is not None and start is None and end is None and predicate is None and symbols is None:
            rows = list(itertools.accumulate((m.named()[p].rows for p in chosen), initial=0))
            chosen = chosen[: next((i for i, n in enumerate(rows) if n >= limit), len(chosen))]
        types = m.types()
        shape = T.StructType([T.StructField("sym", T.StringType()), T.StructField("time", parse(m.time_kind)), *(T.StructField(f.physical, parse(f.kind)) for f in m.fields)])
        folders = [f"{self.path}/{m.named()[p].folder}" for p in chosen if m.named()[p].rows]
        df = self.spark.read.schema(shape).parquet(*folders) if folders else self.spark.createDataFrame([], shape)
        df = df.select("sym", "time", *(quoted(f.physical).alias(f.name) for f in m.fields))
        wanted = self._columns(columns)
        if isinstance(symbols, str):
            symbols = [symbols]
        if symbols is not None:
            df = df.filter(F.col("sym").isin(list(symbols)) if symbols else F.lit(False))
        moment = (lambda v: F.lit(v)) if m.time_kind == "date32" else (lambda v: F.lit(str(v)).cast("timestamp_ntz"))
        if start is not None:
            df = df.filter(F.col("time") >= moment(start))
        if end is not None:
            df = df.filter(F.col("time") < moment(end))
        if predicate is not None:
            df = df.filter(to_column(predicate, types))
        part = partition_column(m.scheme, F.col("time"))
        if limit is not None:
            df = df.orderBy(part, "sym", "time").limit(limit)
        elif self.max_parallelism is not None:
            df = df.coalesce(self.max_parallelism)
        extra = [part.alias("part")] if with_partition else []
        return df.select(*extra, "sym", "time", *(quoted(c) for c in wanted))

    read = scan

    def request(self, **request) -> Scan:
        """The same, to be looked at before it is read."""
        return Scan(self, request)

    def ordered(self, **request) -> DataFrame:
        """A scan in table order."""
        df = self.scan(**request)
        return df.orderBy(partition_column(self.scheme, F.col("time")), "sym", "time")

    def read_range(self, part: str, offset: int, length: int, columns: list[str] | None = None) -> DataFrame:
        """Rows offset to offset + length of one partition."""
        found = index.read_range(self.scan(columns=columns, partitions=[part], with_partition=True), part, offset, length)
        return found.orderBy("row_no").drop("part", "row_no")

    def scan_ranges(self, **request) -> DataFrame:
        """(part, offset, length) of the rows that a request selects, numbered over their whole partitions."""
        chosen = self.plan(request.get("start"), request.get("end"), request.get("predicate"), request.get("partitions"), request.get("symbols"))
        whole = self.scan(columns=[], partitions=chosen, with_partition=True)
        picked = self.scan(**request | {"columns": []})
        return index.islands(index.row_numbers(whole).join(picked, ["sym", "time"], "left_semi"))

    def indexed(self) -> DataFrame:
        """part, sym and time: what the functions of operators.index take."""
        return self.scan(columns=[], with_partition=True)

    # ---- Arrow and SQL ----

    def to_arrow(self, **request) -> pa.Table:
        return self.ordered(**request).toArrow()

    def batches(self, batch_size: int | None = None, **request) -> BatchReader:
        """Arrow batches in table order, read as they are asked for."""
        return BatchReader(self, batch_size, request)

    read_batches = batches

    def register(self, view: str) -> DataFrame:
        """A temporary SQL view of the whole table."""
        df = self.scan()
        df.createOrReplaceTempView(view)
        return df

    # ---- metadata; no job ----

    def statistics(self) -> dict:
        parts = [p for p in self.manifest().partitions if p.rows]
        pick = lambda f, k: f((getattr(p, k) for p in parts), default=None)
        return {"row_count": sum(p.rows for p in parts), "partition_count": len(parts), "time_min": pick(min, "time_min"), "time_max": pick(max, "time_max"), "sym_min": pick(min, "sym_min"), "sym_max": pick(max, "sym_max")}

    def partition_statistics(self) -> list[dict]:
        return [{"name": p.name, "row_count": p.rows, "sym_count": p.syms, "time_count": p.times, "sym_min": p.sym_min, "sym_max": p.sym_max, "time_min": p.time_min, "time_max": p.time_max} for p in self.manifest().partitions]

    def metadata(self) -> dict:
        m = self.manifest()
        parts = []
        for p in m.partitions:
            if p.name:
                low, after = partition_range(p.name)
                parts.append({"name": p.name, "time_min": low, "time_max": after - dt.timedelta(microseconds=1)})
        return {"scheme": m.scheme, "ordering": ["sym", "time"], "partitions": parts, "projection_pushdown": True, "predicate_pushdown": True, "limit_pushdown": True}

    def null_counts(self, columns: list[str] | None = None) -> DataFrame:
        df = self.scan(columns=columns)
        return df.agg(*(F.sum(quoted(c).isNull().cast("int")).cast("long").alias(c) for c in df.columns))

    def field_is_compressed(self) -> bool:
        return self.manifest().codec != "none"

    def meta(self) -> dict:
        """Version of the table, kind of its time, and counts; no job."""
        m, s = self.manifest(), self.statistics()
        return {"version": m.version, "time_type": m.time_kind, "scheme": m.scheme, "codec": m.codec, "rule": m.properties.get("rule", "grid"), "field_count": len(m.fields), "partition_count": s["partition_count"], "row_count": s["row_count"]}

    def close(self) -> None:
        """Nothing is held open."""
