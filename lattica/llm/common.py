"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes outside this set; ``bytes.split()`` uses the same one.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Sorts a null document id behind every other one.
LAST_ID = (1 << 63) - 1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset, and only on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and the folder is the cluster's to clean
        pass


def pin(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage so that a lost executor costs no recomputation, and gives
    the planner the true size, on which it decides whether to broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pinned_at = path
    return out


def free(*pinned: DataFrame) -> None:
    """Removes the files of pinned frames that nothing reads any more; of other frames, nothing."""
    for df in pinned:
        if path := getattr(df, "_pinned_at", None):
            _remove(df.sparkSession, path)


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows that repeat a doc_id apart; equal rows share it."""
    return F.xxhash64(doc_id, text)


# ---- Arrow and numpy ------------------------------------------------------------------


def texts(arr: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return pc.fill_null(pc.cast(arr, pa.large_binary()), b"").to_pylist()


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer of all texts, and where each begins and ends (null as empty)."""
    arr = pc.fill_null(pc.cast(arr, pa.large_binary()), b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2**64, and of its inverse, for at least n steps."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        back = np.uint64(pow(int(_STEP), -1, 1 << 64))
        one = np.ones(1, np.uint64)
        _powers[size] = tuple(
            np.concatenate([one, np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (_STEP, back)
        )
    return _powers[size]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, by prefix sums: no loop over spans."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word, and the first word's number for each text (one more at the end)."""
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE[data], starts, ends)


def slices(batch: pa.RecordBatch, size: Column | None = None, limit: int = 4 << 20):
    """Parts of a batch whose texts (column "text") have about ``limit`` bytes, so that numpy's
    temporaries stay small; a longer text is a part of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
    total, at = np.cumsum(lengths), 0
    while at < len(lengths):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


# ---- bounded filters ------------------------------------------------------------------

#: Bits of a prefilter bitmap: 2 MB to 32 MB, whatever the data's size.
MIN_BITS, MAX_BITS = 24, 28


def bitmap(hashes: DataFrame, name: str, n: int) -> np.ndarray:
    """A bitmap of 64-bit hashes, built on the executors; at most 2**MAX_BITS bits reach the driver.

    A full bitmap only lets more rows pass to the exact stage behind it.
    """
    bits = min(MAX_BITS, max(MIN_BITS, (64 * max(1, n)).bit_length()))
    slot = F.col(name).bitwiseAND((1 << bits) - 1)
    rows = (
        hashes.select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(63).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.expr("bit_or(shiftleft(1L, b))").alias("m"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


#: Bits of a key filter: at most 2**20 rows of two numbers are broadcast (some 40 MB), whatever there is.
FILTER_BITS = 26


def may_hold(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Splits ``rows`` into those whose ``key`` (long) may be in column ``name`` of ``keys``, and the others, which aren't.

    DataFrame functions only: the filter is a table of 64-bit words that each row looks its bit up in.
    So the rows that can't match take no part in the exact join behind it.  A filter that is full (of
    more keys than about ``2**FILTER_BITS``) only lets more rows pass.  Null keys are in neither.
    """
    n = keys.count()
    bits = min(FILTER_BITS, max(16, (64 * max(1, n)).bit_length()))
    slot = F.col(name).bitwiseAND((1 << bits) - 1)
    words = keys.select(F.shiftright(slot, 6).alias("__w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("__b"))
    words = pin(words.groupBy("__w").agg(F.bit_or("__b").alias("__m")))
    own = key.bitwiseAND((1 << bits) - 1)
    marked = rows.withColumn("__slot", own).join(F.broadcast(words), F.shiftright("__slot", 6) == F.col("__w"), "left")
    bit = F.call_function("getbit", F.coalesce("__m", F.lit(0).cast("long")), F.col("__slot").bitwiseAND(63).cast("int"))
    some, none = (marked.filter(bit == b).select(*(column(c) for c in rows.columns)) for b in (1, 0))
    return some, none


# ---- connected components -------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long): root is the component's smallest node.

    Alternates large-star and small-star steps, each a grouped minimum and a join, so no
    neighbour list is ever gathered; needs O(log n) rounds, and only counts reach the driver.
    """
    now = pin(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = pin(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = pin(large)
        least = pin(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        new = pin(small)
        done = new.count() == now.count() and new.exceptAll(now).isEmpty()
        free(now, low, large, least)
        if done:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = new
