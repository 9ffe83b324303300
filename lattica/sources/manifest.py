"""A table's manifest: one JSON file for each version, in ``_grid`` under the table's folder.

A version lists the scheme, the columns and each partition's data folder.  Data folders are
never changed; a commit writes the next version under a temporary name and renames it, so
readers see all of a change or none of it.  All file work goes through Hadoop's file system,
so tables may lie wherever Spark can write.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from lattica.errors import AlreadyExists, Format, Invalid, InvalidState, Io, NotFound


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        Path = self.jvm.org.apache.hadoop.fs.Path
        out = parts[0] if not isinstance(parts[0], str) else Path(parts[0])
        for p in parts[1:]:
            out = Path(out, p)
        return out

    def names(self, p) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, p) -> str:
        s = self.fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def create(self, p, text: str) -> None:
        """Fails if the file is there."""
        s = self.fs.create(p, False)
        try:
            s.write(bytearray(text.encode()))
        finally:
            s.close()


@dataclass(frozen=True)
class Field:
    """A column: its name, logical type, and its name in the data files."""

    name: str
    kind: str
    physical: str


@dataclass(frozen=True)
class Partition:
    """A time bucket: data folder, and statistics taken when it was written."""

    name: str
    folder: str
    rows: int = 0
    syms: int = 0
    times: int = 0
    sym_min: str | None = None
    sym_max: str | None = None
    time_min: str | None = None
    time_max: str | None = None
    #: Compression, where it isn't the table's.
    codec: str | None = None


@dataclass(frozen=True)
class Manifest:
    scheme: str
    time_kind: str
    fields: tuple[Field, ...] = ()
    partitions: tuple[Partition, ...] = ()
    codec: str = "zstd"
    version: int = 0
    properties: dict = field(default_factory=dict)

    def types(self) -> dict[str, str]:
        return {"sym": "utf8", "time": self.time_kind} | {f.name: f.kind for f in self.fields}

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise NotFound(f"no column {name!r}")

    def named(self) -> dict[str, Partition]:
        return {p.name: p for p in self.partitions}

    def with_partitions(self, new: dict[str, Partition]) -> Manifest:
        return replace(self, partitions=tuple(new[k] for k in sorted(new)))


class Store:
    """Reads and commits manifests of one table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.grid = self.files.path(self.files.root, "_grid")

    def versions(self) -> list[str]:
        return [n for n in self.files.names(self.grid) if n.startswith("v") and n.endswith(".json")]

    def exists(self) -> bool:
        return bool(self.versions())

    def load(self) -> Manifest:
        found = self.versions()
        if not found:
            raise NotFound(f"no table at {self.path}")
        try:
            text = self.files.read(self.files.path(self.grid, found[-1]))
        except Py4JJavaError as e:
            raise Io(str(e.java_exception)) from None
        try:
            d = json.loads(text)
        except ValueError as e:
            raise Format(f"{found[-1]} of {self.path}: {e}") from None
        if not isinstance(d, dict) or not {"scheme", "time_kind", "fields", "partitions"} <= set(d):
            raise Format(f"{found[-1]} of {self.path} is no manifest")
        return Manifest(**d | {"fields": tuple(Field(**f) for f in d["fields"]), "partitions": tuple(Partition(**p) for p in d["partitions"])})

    def commit(self, m: Manifest) -> Manifest:
        new = replace(m, version=m.version + 1)
        self.files.fs.mkdirs(self.grid)
        temp, final = self.files.path(self.grid, f".{uuid.uuid4().hex}"), self.files.path(self.grid, f"v{new.version:08d}.json")
        if self.files.fs.exists(final):
            raise InvalidState(f"version {new.version} was committed by someone else")
        self.files.create(temp, json.dumps(asdict(new)))
        if not self.files.fs.rename(temp, final):
            raise InvalidState(f"version {new.version} was committed by someone else")
        return new

    @contextlib.contextmanager
    def lock(self):
        """Every change holds ``.lock``; one left behind by a dead writer has to be removed by hand."""
        p = self.files.path(self.files.root, ".lock")
        self.files.fs.mkdirs(self.files.root)
        try:
            self.files.create(p, "")
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise InvalidState(f"{self.path} is locked") from None
            raise
        try:
            yield
        finally:
            self.files.fs.delete(p, False)

    def drop(self) -> None:
        if not self.files.fs.exists(self.files.root):
            raise NotFound(f"no table at {self.path}")
        self.files.fs.delete(self.files.root, True)

    def rename(self, name: str) -> str:
        if not name or name.startswith(".") or any(c in name for c in "/\\="):
            raise Invalid(f"bad table name {name!r}")
        to = self.files.path(self.files.root.getParent(), name)
        if self.files.fs.exists(to):
            raise AlreadyExists(f"{name!r} exists")
        self.load()
        self.files.fs.rename(self.files.root, to)
        return to.toString()

    def vacuum(self, age_s: float = 7 * 86_400) -> list[str]:
        """Removes data folders that the present version does not list and that are older than ``age_s`` seconds.

        Readers of older versions, and writers that have not committed, use younger ones.
        """
        used = {p.folder.split("/")[1] for p in self.load().partitions}
        data = self.files.path(self.files.root, "data")
        if not self.files.fs.exists(data):
            return []
        oldest = time.time() * 1000 - age_s * 1000
        gone = [x.getPath().getName() for x in self.files.fs.listStatus(data) if x.getModificationTime() <= oldest and x.getPath().getName() not in used]
        for n in gone:
            self.files.fs.delete(self.files.path(data, n), True)
        return gone
