"""Writing grid tables: create, keyed overwrite, partition replacement, and changes of columns.

New data goes to folders of its own, and one manifest commit makes it visible.  The input is
evaluated once: what can be told row by row is counted while it is written, and keys, statistics
and the grid's rule are read from what was written, columns sym and time alone.  If a check
fails, the new folder is removed and nothing has changed.

A table's ``rule`` is "grid" (each symbol's times are a contiguous part of its partition's axis, each
once) or "ticks" (any times).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lattica.errors import AlreadyExists, Codec, GridError, Invalid, InvalidState, KeyMissing, NonContiguousTime, NotFound
from lattica.functions.calendar import fits, parse_scheme, partition_column
from lattica.functions.types import cast_column, in_range, logical_type, parse_type, spark_type
from lattica.operators import index
from lattica.sources.manifest import Field, Manifest, Partition, Store
from lattica.sources.reader import GridReader, quoted

CODECS = {"zstd": "zstd", "lz4": "lz4_raw", "snappy": "snappy", "none": "none", "plain": "none"}


def parse_codec(name: str | None) -> str:
    key = (name or "zstd").strip().lower()
    if key not in CODECS:
        raise Codec(f"unknown compression {name!r}")
    return "none" if key == "plain" else key


def check_field(name: str) -> None:
    if not name or name.startswith(".") or "/" in name or "\\" in name or name in ("sym", "time"):
        raise Invalid(f"bad column name {name!r}")


def as_frame(spark: SparkSession, data) -> DataFrame:
    """Takes a DataFrame, an Arrow table, batch, or stream of batches, or a pandas frame."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, Iterator):
        data = pa.Table.from_batches(list(data))
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    if isinstance(data, pa.Table):
        # dictionaries are decoded, and time zones and finer units dropped to microseconds
        cols = []
        for name, c in zip(data.column_names, data.columns, strict=True):
            if pa.types.is_dictionary(c.type):
                c = c.cast(c.type.value_type)
            if pa.types.is_timestamp(c.type) or pa.types.is_date64(c.type):
                c = c.cast(pa.timestamp("us"))
            cols.append((name, c))
        return spark.createDataFrame(pa.table(dict(cols)))
    if isinstance(data, pd.DataFrame):
        return as_frame(spark, pa.Table.from_pandas(data, preserve_index=False))
    raise Invalid(f"can't read {type(data).__name__}")


class GridWriter:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    @property
    def path(self) -> str:
        return self.store.path

    def as_reader(self) -> GridReader:
        return GridReader(self.spark, self.path)

    # ---- helpers ----

    def _input(self, data) -> tuple[DataFrame, dict[str, str]]:
        """The input with its time in a kind that tables keep, and the logical types of its columns."""
        df = as_frame(self.spark, data)
        if not {"sym", "time"} <= set(df.columns):
            raise Invalid("input needs columns sym and time")
        kinds = dict(df.dtypes)
        if kinds["time"] == "int":
            df = df.withColumn("time", F.date_from_unix_date("time"))
        elif kinds["time"] == "bigint":
            df = df.withColumn("time", F.timestamp_micros("time").cast("timestamp_ntz"))
        elif kinds["time"] == "timestamp":
            df = df.withColumn("time", F.col("time").cast("timestamp_ntz"))
        elif kinds["time"] not in ("date", "timestamp_ntz"):
            raise Invalid(f"time can't be {kinds['time']}")
        types = {n: logical_type(k) for n, k in df.dtypes}
        for n in types:
            if n not in ("sym", "time"):
                check_field(n)
        return df.withColumn("sym", F.col("sym").cast("string")), types

    def _bad_kinds(self, df: DataFrame, fields: tuple[Field, ...]) -> Column:
        """Whether a value is out of its unsigned type's range."""
        return ~_all(in_range(quoted(f.name), f.kind) for f in fields if f.kind.startswith("uint") and f.name in df.columns)

    def _remove(self, folder: str) -> None:
        self.store.files.fs.delete(self.store.files.path(f"{self.path}/{folder}"), True)

    def _write(self, df: DataFrame, m: Manifest, checks: dict[str, tuple[Column, GridError]] | None = None) -> dict[str, Partition]:
        """Writes df (part, sym, time, fields by logical name) to new folders; the partitions as written.

        checks: conditions that no row may meet, and what to raise if one does.  A table of partitions with
        a codec of their own keeps them.
        """
        checks = {"null": (F.col("sym").isNull() | F.col("time").isNull(), Invalid("sym and time must not be null")), **(checks or {})}
        if any(f.kind.startswith("uint") and f.name in df.columns for f in m.fields):
            checks["kind"] = (self._bad_kinds(df, m.fields), Invalid("a value is out of its unsigned type's range"))
        folder, seen = f"data/{uuid.uuid4().hex}", Observation()
        counted = df.observe(seen, *(F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, (c, _) in checks.items()))
        out = counted.select("part", "sym", "time", *(quoted(f.name).cast(spark_type(f.kind)).alias(f.physical) for f in m.fields if f.name in df.columns))
        # ranges rather than a hash: a large partition is cut by symbols and times, so it is never one task's
        laid = out.repartitionByRange("part", "sym", "time").sortWithinPartitions("part", "sym", "time")
        at = f"{self.path}/{folder}"
        try:
            laid.withColumn("__part", F.regexp_replace("part", "=", "-")).drop("part").write.partitionBy("__part").option("compression", CODECS[m.codec]).parquet(at)
            for k, (_, error) in checks.items():
                if seen.get[k]:
                    raise error
            return self._seen(folder, m)
        except BaseException:
            self._remove(folder)
            raise

    def _seen(self, folder: str, m: Manifest) -> dict[str, Partition]:
        """The partitions of a folder with their statistics; raises where the grid's rule is broken."""
        shape = f"sym string, time {spark_type(m.time_kind)}, __part string"
        keys = self.spark.read.schema(shape).parquet(f"{self.path}/{folder}").withColumnRenamed("__part", "p").withColumn("p", F.coalesce("p", F.lit("")))
        grid = m.properties.get("rule", "grid") == "grid"
        stats = keys.groupBy("p").agg(
            F.count("*").alias("rows"), F.countDistinct("sym").alias("syms"), F.countDistinct("time").alias("times"), F.countDistinct("sym", "time").alias("keys"), F.min("sym").alias("s0"), F.max("sym").alias("s1"), F.min("time").cast("string").alias("t0"), F.max("time").cast("string").alias("t1")
        )
        out, ragged = {}, []
        for r in stats.collect():  # one row for each partition
            name = "" if m.scheme == "none" else r["p"].replace("-", "=", 1)
            leaf = "__HIVE_DEFAULT_PARTITION__" if m.scheme == "none" else r["p"]
            out[name] = Partition(name, f"{folder}/__part={leaf}", r["rows"], r["syms"], r["times"], r["s0"], r["s1"], r["t0"], r["t1"])
            if grid and not r["rows"] == r["keys"] == r["syms"] * r["times"]:  # not each symbol at each time, so it takes a closer look
                ragged.append(r["p"])
        if ragged:
            bad = index.violations(keys.filter(F.col("p").isin(ragged)).withColumnRenamed("p", "part")).take(1)
            if bad:
                raise NonContiguousTime(f"symbol {bad[0]['sym']!r} in {bad[0]['part']!r}")
        return out

    def _parted(self, df: DataFrame, m: Manifest) -> DataFrame:
        return df.withColumn("part", partition_column(m.scheme, F.col("time")))

    # ---- life of a table ----

    def create(self, schema: dict[str, str], scheme: str = "none", time: str = "timestamp_us", compression: str | None = None) -> GridWriter:
        """An empty table with the given columns."""
        for n in schema:
            check_field(n)
        with self.store.lock():
            if self.store.exists():
                raise AlreadyExists(f"{self.path} exists")
            kinds = {n: parse_type(k) for n, k in schema.items()}
            self.store.commit(Manifest(parse_scheme(scheme), parse_type(time), tuple(Field(n, k, n) for n, k in sorted(kinds.items())), codec=parse_codec(compression)))
        return self

    def init(self, data, scheme: str = "none", compression: str | None = None, kinds: dict[str, str] | None = None, rule: str = "grid") -> GridWriter:
        """A new table with data. kinds: logical types of columns that Spark's don't tell (unsigned, date64).

        rule "ticks" (an extension): symbols need not share an axis of times.
        """
        if rule not in ("grid", "ticks"):
            raise Invalid(f"unknown rule {rule!r}")
        df, types = self._input(data)
        types |= {n: parse_type(k) for n, k in (kinds or {}).items()}
        m = Manifest(parse_scheme(scheme), types["time"], tuple(Field(n, types[n], n) for n in sorted(types) if n not in ("sym", "time")), codec=parse_codec(compression), properties={"rule": rule})
        with self.store.lock():
            if self.store.exists():
                raise AlreadyExists(f"{self.path} exists")
            self.store.commit(m.with_partitions(self._write(self._parted(df, m), m)))
        return self

    def drop(self) -> None:
        self.store.drop()

    remove = drop

    def rename(self, name: str) -> GridWriter:
        return GridWriter(self.spark, self.store.rename(name))

    # ---- rows ----

    def _new_fields(self, m: Manifest, types: dict[str, str]) -> Manifest:
        have = m.types()
        added = []
        for n, k in types.items():
            if n not in have:
                added.append(Field(n, k, n if n not in {f.physical for f in m.fields} | set(m.properties.get("retired", [])) else f"{n}#{uuid.uuid4().hex[:8]}"))
            elif n not in ("sym", "time") and spark_type(have[n]) != spark_type(k):
                raise Invalid(f"column {n!r} is {have[n]}, not {k}")
        if types["time"] != m.time_kind:
            raise Invalid(f"time is {m.time_kind}, not {types['time']}")
        return replace(m, fields=tuple(sorted([*m.fields, *added], key=lambda f: f.name)))

    def write(self, data, strict: bool = True) -> GridWriter:
        """Overwrites cells of rows that exist; whole new partitions are added.

        A null in the input makes the cell null. Columns the table lacks are added, null in rows
        that the input leaves out. A key missing from a partition that exists is an error
        (strict=False, an extension: adds the row instead). Nothing is changed on an error.
        """
        df, types = self._input(data)
        with self.store.lock():
            self._patch(self.store.load(), df, types, strict)
        return self

    def _patch(self, m: Manifest, df: DataFrame, types: dict[str, str], strict: bool) -> None:
        """What ``write`` does, under the lock."""
        m = self._new_fields(m, types)
        given = [n for n in types if n not in ("sym", "time")]
        staged = f"data/{uuid.uuid4().hex}"
        try:
            # the input is evaluated here, once
            self._parted(df, m).write.parquet(f"{self.path}/{staged}")
            patch = self.spark.read.schema(self._parted(df, m).schema).parquet(f"{self.path}/{staged}")
            found = patch.groupBy("part", "sym", "time").agg(F.count("*").alias("c")).groupBy("part").agg(F.max("c").alias("most"), F.sum((F.col("sym").isNull() | F.col("time").isNull()).cast("int")).alias("nulls")).collect()
            if any(r["nulls"] for r in found):
                raise Invalid("sym and time must not be null")
            if any(r["most"] > 1 for r in found):
                raise Invalid("keys repeat")
            have = m.named()
            old = sorted(r["part"] for r in found if r["part"] in have and have[r["part"]].rows)
            base = self._base(m, old)
            right = patch.select("sym", "time", F.lit(True).alias("__hit"), *(quoted(n).alias(f"__new_{n}") for n in given))
            cells = [(F.when(F.col("__hit"), quoted(f"__new_{f.name}")).otherwise(quoted(f.name)) if f.name in given else quoted(f.name)).alias(f.name) for f in m.fields]
            whole = base.drop("part").withColumn("__had", F.lit(True)).join(right, ["sym", "time"], "full")
            whole = self._parted(whole.select("sym", "time", "__had", *cells), m)
            gone = F.col("__had").isNull() & F.col("part").isin(old)
            try:
                new = self._write(whole, m, {"lost": (gone, KeyMissing("a row that is not there"))} if strict and old else None)
            except KeyMissing:
                lost = index.missing(base, patch.filter(F.col("part").isin(old)).select("part", "sym", "time")).first()
                raise KeyMissing(f"no row {lost['sym']!r} at {lost['time']}") from None
            self.store.commit(m.with_partitions(have | new))
        finally:
            self._remove(staged)

    def _base(self, m: Manifest, names: list[str]) -> DataFrame:
        """Rows of the named partitions, with the columns of m (which may be newer than the files)."""
        have = m.named()
        folders = [f"{self.path}/{have[p].folder}" for p in names]
        shape = ["sym string", f"time {spark_type(m.time_kind)}", *(f"`{f.physical}` {spark_type(f.kind)}" for f in m.fields)]
        df = self.spark.read.schema(", ".join(shape)).parquet(*folders) if folders else self.spark.createDataFrame([], ", ".join(shape))
        return self._parted(df.select("sym", "time", *(quoted(f.physical).alias(f.name) for f in m.fields)), m)

    def update(self, data) -> GridWriter:
        """Replaces the partitions that the input touches, and adds new ones; others stay.

        Of a table without partitions, everything is replaced and columns the input lacks go.
        """
        df, types = self._input(data)
        with self.store.lock():
            m = self.store.load()
            if m.scheme == "none":
                m = replace(m, fields=(), partitions=())
            m = self._new_fields(m, types)
            self.store.commit(m.with_partitions(m.named() | self._write(self._parted(df, m), m)))
        return self

    def create_partition(self, name: str, data=None) -> GridWriter:
        """A new partition with data, or an empty one."""
        df, types = self._input(data) if data is not None else (None, {})
        with self.store.lock():
            m = self.store.load()
            m = m if df is None else self._new_fields(m, types)
            if not fits(m.scheme, name):
                raise Invalid(f"{name!r} does not fit scheme {m.scheme}")
            if name in m.named():
                raise AlreadyExists(f"partition {name!r} exists")
            new = {name: Partition(name, f"data/{uuid.uuid4().hex}")}
            if df is not None:
                new |= self._write(self._parted(df, m), m, {"outside": (F.col("part") != name, Invalid(f"a row does not belong to {name!r}"))})
            self.store.commit(m.with_partitions(m.named() | new))
        return self

    def rename_partition(self, old: str, new: str) -> GridWriter:
        """Renames an empty partition. One with rows has the name of their times."""
        with self.store.lock():
            m = self.store.load()
            have = m.named()
            if old not in have:
                raise NotFound(f"no partition {old!r}")
            if new in have:
                raise AlreadyExists(f"partition {new!r} exists")
            if not fits(m.scheme, new) or have[old].rows:
                raise Invalid(f"the rows of {old!r} do not fit {new!r}")
            self.store.commit(m.with_partitions({k: v for k, v in have.items() if k != old} | {new: replace(have[old], name=new)}))
        return self

    def delete_partition(self, name: str) -> GridWriter:
        with self.store.lock():
            m = self.store.load()
            if not fits(m.scheme, name):
                raise Invalid(f"{name!r} does not fit scheme {m.scheme}")
            if name not in m.named():
                raise NotFound(f"no partition {name!r}")
            self.store.commit(m.with_partitions({k: v for k, v in m.named().items() if k != name}))
        return self

    drop_partition = delete_partition

    def write_rows(self, part: str, offset: int, data) -> GridWriter:
        """Overwrites fields by position: the input's n rows, by its column row_no from 0, at offset."""
        placed = as_frame(self.spark, data).withColumn("row_no", F.col("row_no") + offset)
        with self.store.lock():  # rows are numbered as they are when they are written
            m = self.store.load()
            if part not in m.named():
                raise NotFound(f"no partition {part!r}")
            rows = index.row_numbers(self._base(m, [part])).select("sym", "time", "row_no")
            if index_missing := placed.join(rows, "row_no", "left_anti").take(1):
                raise Invalid(f"row {index_missing[0]['row_no']} is outside {part!r}")
            self._patch(m, *self._input(placed.join(rows, "row_no").drop("row_no")), True)
        return self

    def max_parallelism(self) -> int:
        """Tasks of a write's exchanges."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def sink(self, data, mode: str = "auto", scheme: str = "none", compression: str | None = None) -> GridWriter:
        """auto: init if there is no table, else write, and update where keys are missing.

        An update drops rows of the touched partitions that the input lacks; mode "upsert" (an
        extension) keeps them.
        """
        if mode not in ("auto", "write", "update", "upsert"):
            raise Invalid(f"unknown mode {mode!r}")
        df = as_frame(self.spark, data)
        if df.isEmpty():
            return self
        if not self.store.exists():
            return self.init(df, scheme, compression)
        if mode == "update":
            return self.update(df)
        if mode == "upsert":
            return self.write(df, strict=False)
        try:
            return self.write(df)
        except KeyMissing:
            if mode == "write":
                raise
            return self.update(df)

    # ---- columns ----

    def _edit(self, change) -> GridWriter:
        with self.store.lock():
            self.store.commit(change(self.store.load()))
        return self

    def init_field(self, name: str, kind: str, data=None) -> GridWriter:
        """A new column, null everywhere; no data is rewritten. With data (sym, time and the column, as a
        frame, table or stream of Arrow batches), its values, and null in rows that the data leave out."""
        check_field(name)
        if data is not None:
            if name in self.store.load().types():
                raise AlreadyExists(f"column {name!r} exists")
            df = as_frame(self.spark, data)
            return self.write(df.select("sym", "time", quoted(name).cast(spark_type(kind)).alias(name)))

        def change(m: Manifest) -> Manifest:
            if name in m.types():
                raise AlreadyExists(f"column {name!r} exists")
            physical = name if name not in m.properties.get("retired", []) else f"{name}#{uuid.uuid4().hex[:8]}"
            return replace(m, fields=tuple(sorted([*m.fields, Field(name, parse_type(kind), physical)], key=lambda f: f.name)))

        return self._edit(change)

    def update_field(self, name: str, data) -> GridWriter:
        """Replaces a whole column: the data's values (sym, time and the column), null in all other rows."""
        df = as_frame(self.spark, data)

        def change(m: Manifest) -> Manifest:
            f = m.field(name)
            new, seen = df.select("sym", "time", quoted(name).cast(spark_type(f.kind)).alias("__new"), F.lit(True).alias("__hit")), F.lit(True).alias("__had")
            base = self._base(m, [p.name for p in m.partitions if p.rows]).drop("part", name)
            whole = base.select("*", seen).join(new, ["sym", "time"], "full").withColumnRenamed("__new", name)
            lost = {"lost": (F.col("__had").isNull(), KeyMissing(f"a value of {name!r} has no row"))}
            return m.with_partitions(m.named() | self._write(self._parted(whole, m), m, lost))

        return self._edit(change)

    def delete_field(self, name: str, partition: str | None = None) -> GridWriter:
        """Drops a column; files keep its values until their partition is rewritten.

        In one partition: rewrites it, and the column is null there.
        """
        if name in ("sym", "time"):
            raise Invalid(f"{name} can't be deleted")
        if partition is not None:
            return self._rewrite(partition, lambda m, df: df.withColumn(name, F.lit(None).cast(spark_type(m.field(name).kind))))

        def change(m: Manifest) -> Manifest:
            gone = m.field(name)
            retired = sorted({*m.properties.get("retired", []), gone.physical})
            return replace(m, fields=tuple(f for f in m.fields if f != gone), properties=m.properties | {"retired": retired})

        return self._edit(change)

    def rename_field(self, old: str, new: str) -> GridWriter:
        check_field(new)

        def change(m: Manifest) -> Manifest:
            f = m.field(old)
            if new in m.types():
                raise AlreadyExists(f"column {new!r} exists")
            return replace(m, fields=tuple(sorted([replace(x, name=new) if x == f else x for x in m.fields], key=lambda x: x.name)))

        return self._edit(change)

    def cast_field(self, name: str, kind: str) -> GridWriter:
        """Rewrites a column in another type, by the rules of functions.types.cast_column."""
        target = parse_type(kind)

        def change(m: Manifest) -> Manifest:
            f = m.field(name)
            if f.kind == target:
                return m
            base = self._base(m, [p.name for p in m.partitions if p.rows])
            new = replace(m, fields=tuple(replace(x, kind=target) if x == f else x for x in m.fields))
            return new.with_partitions(m.named() | self._write(base.withColumn(name, cast_column(quoted(name), f.kind, target)), new))

        return self._edit(change)

    def _rewrite(self, partition: str, change, codec: str | None = None) -> GridWriter:
        """Writes one partition anew."""

        def edit(m: Manifest) -> Manifest:
            if partition not in m.named():
                raise NotFound(f"no partition {partition!r}")
            own = codec or m.named()[partition].codec
            if codec is not None:
                self._check_codec(m.named()[partition].codec or m.codec, codec)
            made = self._write(change(m, self._base(m, [partition])), replace(m, codec=own or m.codec)) if m.named()[partition].rows else m.named()
            return m.with_partitions(m.named() | {partition: replace(made[partition], codec=own)})

        return self._edit(edit)

    def _check_codec(self, now: str, codec: str) -> None:
        if now == codec or (codec != "none" and now != "none"):
            raise InvalidState("the table is in that state already")

    def _recode(self, codec: str, partition: str | None) -> GridWriter:
        if partition is not None:
            return self._rewrite(partition, lambda m, df: df, codec)

        def change(m: Manifest) -> Manifest:
            self._check_codec(m.codec, codec)
            new = replace(m, codec=codec)
            return new.with_partitions(m.named() | self._write(self._base(m, [p.name for p in m.partitions if p.rows]), new))

        return self._edit(change)

    def compress(self, codec: str = "zstd", partition: str | None = None) -> GridWriter:
        """Rewrites the table, or one partition, with a codec; files are compressed as wholes, not by column."""
        return self._recode(parse_codec(codec), partition)

    def decompress(self, partition: str | None = None) -> GridWriter:
        return self._recode("none", partition)

    def set_properties(self, **properties) -> GridWriter:
        return self._edit(lambda m: replace(m, properties=m.properties | properties))

    def fix(self, age_s: float = 7 * 86_400) -> GridWriter:
        """Columns are the table's, so every partition shows all of them; removes folders that the present
        version doesn't use and that are older than ``age_s`` seconds, so none of a running reader's."""
        with self.store.lock():
            self.store.vacuum(age_s)
        return self

    def stream(self) -> StreamWriter:
        return StreamWriter(self)


class StreamWriter:
    """Ingest of one whole partition after another; each may come once. Holds the lock until finish()."""

    def __init__(self, writer: GridWriter):
        self.writer, self.done, self.closed = writer, {}, False
        self._lock = writer.store.lock()
        self._lock.__enter__()
        try:
            self.manifest = writer.store.load()
        except Exception:
            self._lock.__exit__(None, None, None)
            raise

    def write_partition(self, data) -> StreamWriter:
        if self.closed:
            raise InvalidState("finished")
        df, types = self.writer._input(data)
        m = self.writer._new_fields(self.manifest, types)
        new = self.writer._write(self.writer._parted(df, m), m)
        if again := sorted(set(new) & set(self.done)):
            self.writer._remove(new[again[0]].folder.rpartition("/")[0])
            raise InvalidState(f"partition {again[0]!r} was written before")
        self.manifest = m
        self.done |= new
        return self

    write_batch = write_partition

    def finish(self) -> GridWriter:
        if not self.closed:
            self.closed = True
            try:
                self.writer.store.commit(self.manifest.with_partitions(self.manifest.named() | self.done))
            finally:
                self._lock.__exit__(None, None, None)
        return self.writer

    def abort(self) -> None:
        """Ends the ingest; nothing of it is seen."""
        if not self.closed:
            self.closed = True
            try:
                for folder in {p.folder.rpartition("/")[0] for p in self.done.values()}:
                    self.writer._remove(folder)
            finally:
                self._lock.__exit__(None, None, None)

    def __enter__(self) -> StreamWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.finish()
        else:
            self.abort()


def _all(columns):
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out
