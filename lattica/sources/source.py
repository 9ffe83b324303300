"""Grid tables as a data source: ``spark.read.format("lattica").load(path)``, in SQL too.

``SELECT * FROM lattica.`path``` needs a catalog; ``CREATE TEMPORARY VIEW v USING lattica OPTIONS
(path '...', start '...', end '...')`` does with any session.  Partitions of the table are pruned by the
options start and end, and by filters on time; each partition's data files are read by a task of
their own, by Arrow, with the columns that the table has now.  For large scans ``GridReader.scan`` is the faster way: it
is Spark's own Parquet reader.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


@dataclass
class Files(InputPartition):
    """Data files of one partition of the table."""

    paths: list[str]


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(made(spark))




def made(spark: SparkSession) -> type[DataSource]:
    """The source's class. Workers plan a read, and have no session; so what a table holds is looked up
    through Arrow's file systems, by the path alone."""

    def folder(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def manifest(path: str) -> dict:
        from pyarrow import fs

        at, root = folder(path)
        names = sorted(f.base_name for f in at.get_file_info(fs.FileSelector(f"{root}/_grid")) if f.base_name.startswith("v"))
        if not names:
            raise ValueError(f"no table at {path}")
        with at.open_input_stream(f"{root}/_grid/{names[-1]}") as f:
            return json.loads(f.read())

    types = {
        "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
        "float32": "float", "float64": "double", "date32": "date", "timestamp_us": "timestamp_ntz", "date64": "timestamp_ntz", "utf8": "string",
    }

    def moment(text: str | dt.date | None) -> dt.datetime | None:
        if text is None or isinstance(text, dt.datetime):
            return text
        return dt.datetime.fromisoformat(text) if isinstance(text, str) else dt.datetime(text.year, text.month, text.day)

    def span(name: str) -> tuple[dt.datetime, dt.datetime]:
        scheme, _, value = name.partition("=")
        low = dt.datetime(*([int(x) for x in value.split("-")] + [1, 1])[:3])
        days = {"date": 1, "month": 32, "year": 367}[scheme]
        after = low + dt.timedelta(days=days)
        return low, after.replace(day=1) if scheme == "month" else after.replace(month=1, day=1) if scheme == "year" else after

    class Reader(DataSourceReader):
        def __init__(self, path: str, schema: StructType, start: str | None, end: str | None):
            self.path, self.schema, self.start, self.end = path, schema, moment(start), moment(end)
            self.low, self.high = self.start, self.end

        def pushFilters(self, filters: list[Filter]):  # noqa: N802
            """Takes note of bounds on time, to leave partitions out; Spark applies every filter again."""
            for f in filters:
                if getattr(f, "attribute", None) != ("time",) or not isinstance(getattr(f, "value", None), dt.date):
                    continue
                at = moment(f.value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = at if self.low is None else max(self.low, at)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    at += dt.timedelta(microseconds=1)
                    self.high = at if self.high is None else min(self.high, at)
            yield from filters

        def partitions(self) -> list[Files]:
            from pyarrow import fs

            at, root = folder(self.path)
            out = []
            for p in manifest(self.path)["partitions"]:
                if not p["rows"]:
                    continue
                if p["name"]:
                    first, after = span(p["name"])
                    if (self.low is not None and after <= self.low) or (self.high is not None and first >= self.high):
                        continue
                found = at.get_file_info(fs.FileSelector(f"{root}/{p['folder']}"))
                out.append(Files(sorted(f.path for f in found if f.base_name.endswith(".parquet"))))
            return out or [Files([])]

        def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute as pc
            import pyarrow.parquet as pq
            from pyspark.sql.pandas.types import to_arrow_schema

            at, _ = folder(self.path)
            m = manifest(self.path)
            physical = {"sym": "sym", "time": "time"} | {f["name"]: f["physical"] for f in m["fields"]}
            target = to_arrow_schema(self.schema)
            for path in partition.paths:
                with pq.ParquetFile(at.open_input_file(path)) as f:
                    have = set(f.schema_arrow.names)
                    for batch in f.iter_batches(columns=[physical[n] for n in target.names if physical[n] in have]):
                        for bound, keep in ((self.start, pc.greater_equal), (self.end, pc.less)):
                            if bound is not None:
                                time = batch.column("time")
                                batch = batch.filter(keep(time, pa.scalar(bound, pa.timestamp("us")).cast(time.type)))
                        cols = [batch.column(physical[n]).cast(target.field(n).type) if physical[n] in have else pa.nulls(batch.num_rows, target.field(n).type) for n in target.names]
                        yield pa.RecordBatch.from_arrays(cols, schema=target)

    class GridSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "lattica"

        def schema(self) -> str:
            m = manifest(self.options["path"])
            return ", ".join(["sym string", f"time {types[m['time_kind']]}", *(f"`{f['name']}` {types[f['kind']]}" for f in sorted(m["fields"], key=lambda f: f["name"]))])

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(self.options["path"], schema, self.options.get("start"), self.options.get("end"))

    return GridSource
