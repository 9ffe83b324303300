"""Near-duplicate vectors by p-stable hashing (operator 4).

Normalised vectors are projected on Gaussian directions, shifted and cut into steps of
``STEP`` times the linking distance; ``k`` steps make a bucket key, and there are ``tables``
keys.  k grows with log n, so that unrelated vectors share few buckets at any n, and tables
follow from ``miss``, the chance that a pair just at the threshold shares no bucket.  What
meets in a bucket is compared exactly, in double precision.  Equal vectors are one class
from the start.  Buckets over ``TILE`` classes are cut into tiles whose pairs are compared
apart, with every pair kept.  A pair counts in the first table in which it meets, and a tile
pair reports each class's number of links and a spanning forest, never the pairs.

Null and zero vectors, and those with null or non-finite components, link with nothing.  The
same holds for vectors whose length differs: they never meet.  Vectors are scaled by a power of two
first, so that no finite one is too long or too short to compare.  Classes have numbers of their own:
rows with a null vec_id take part, and rows that share a vec_id are compared each by its own vector;
a component goes by the smallest vec_id among its rows, null if all are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import column, components, free, mix, pin
from lattica.llm.simhash import forest

STEP, TILE = 6.0, 2_048
#: Buckets of up to this many classes are compared many to a group.
SMALL = 256
LINKS = "a long, b long, links long"


def collision(ratio: float) -> float:
    """Chance that one step is shared by two points, for step width / distance = ratio."""
    below = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def plan(n: int, cosine: float, miss: float) -> tuple[int, int, float]:
    """(steps in a key, tables, step width) for n vectors."""
    near = math.sqrt(max(1e-12, 2 - 2 * cosine))
    width = STEP * near
    p1, p2 = collision(STEP), collision(width / math.sqrt(2))
    k = max(1, math.ceil(math.log(max(2, n)) / -math.log(p2)))
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - p1**k))), width


def _keys(unit: np.ndarray, k: int, tables: int, width: float, only: int | None = None) -> np.ndarray:
    """Bucket keys, one row for each vector and one column for each table, or for the first ``only``."""
    tables = tables if only is None else only
    rng = np.random.default_rng(11)
    dim = unit.shape[1]
    out = np.empty((len(unit), tables), np.int64)
    for t in range(tables):
        a, b = rng.standard_normal((dim, k)), rng.uniform(0, width, k)
        steps = np.floor((unit @ a + b) / width).astype(np.int64).view(np.uint64)
        h = np.full(len(unit), t + 1, np.uint64)
        for j in range(k):
            h = mix(h ^ steps[:, j] + np.uint64(0x9E3779B97F4A7C15))
        out[:, t] = h.view(np.int64)
    return out


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """The same directions, with largest components of 0.5 to 1; exact but for what vanishes beside them."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _deal(k: int, tables: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for _, part in frame.groupby(frame["v"].map(len)):
                keys = _keys(_unit(np.stack(part["v"].to_numpy()).astype(np.float64)), k, tables, width)
                row = np.repeat(np.arange(len(part)), tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(keys.ravel()), *(pa.array(part[c].to_numpy()[row]) for c in ("id", "m"))],
                    names=["t", "key", "id", "m"],
                )

    return run


class _Links:
    """Links among the vectors of one group, each pair counted in the first table in which it meets."""

    def __init__(self, group: pd.DataFrame, table: int, k: int, tables: int, width: float, cosine: float):
        self.ids, self.m = group["id"].to_numpy(), group["m"].to_numpy()
        self.v = _scaled(np.stack(group["v"].to_numpy()).astype(np.float64))
        self.norm, self.cosine = np.linalg.norm(self.v, axis=1), cosine
        self.earlier = _keys(self.v / self.norm[:, None], k, tables, width, table) if table else np.empty((len(self.v), 0), np.int64)
        order = np.argsort(self.ids, kind="stable")
        self.sorted = self.ids[order]
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.got, self.labels = np.zeros(len(order), np.int64), np.arange(len(order))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs that reach the threshold."""
        for t in range(self.earlier.shape[1]):
            keep = self.earlier[a, t] != self.earlier[b, t]
            a, b = a[keep], b[keep]
        np.add.at(self.got, a, self.m[b])
        np.add.at(self.got, b, self.m[a])
        self.labels = forest(len(self.ids), self.rank[a], self.rank[b], self.labels)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.v[a], self.v[b]) / (self.norm[a] * self.norm[b]) >= self.cosine

    def result(self) -> pd.DataFrame:
        hit, joined = self.got > 0, np.flatnonzero(self.labels != np.arange(len(self.ids)))
        return pd.concat(
            [
                pd.DataFrame({"a": self.ids[hit], "b": np.int64(-1), "links": self.got[hit]}),
                pd.DataFrame({"a": self.sorted[joined], "b": self.sorted[self.labels[joined]], "links": np.int64(0)}),
            ]
        )


def _by_length(group: pd.DataFrame):
    for _, part in group.groupby(group["v"].map(len)):
        yield part.reset_index(drop=True)


def _buckets(k: int, tables: int, width: float, cosine: float):
    """A group of whole small buckets of one table."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in _by_length(group):
            part = part.sort_values(["key", "id"], kind="stable").reset_index(drop=True)
            found = _Links(part, int(part["t"].iloc[0]), k, tables, width, cosine)
            key, step = part["key"].to_numpy(), 1
            a = np.arange(len(key))
            while len(a := a[a + step < len(key)]) and len(a := a[key[a] == key[a + step]]):
                near = found.near(a, a + step)
                found.add(a[near], a[near] + step)
                step += 1
            out.append(found.result())
        return pd.concat(out)

    return run


def _tile(k: int, tables: int, width: float, cosine: float):
    """Two tiles of a large bucket, or one tile with itself."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in _by_length(group):
            found = _Links(part, int(part["t"].iloc[0]), k, tables, width, cosine)
            side = part["side"].to_numpy()  # 0: one tile with itself, 1: left, 2: right
            left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
            for i in range(0, len(left), 512):
                rows = left[i : i + 512]
                cos = (found.v[rows] @ found.v[right].T) / (found.norm[rows][:, None] * found.norm[right][None, :])
                a, b = np.nonzero(cos >= cosine)
                a, b = rows[a], right[b]
                keep = (found.ids[a] < found.ids[b]) | (side[a] == 1)
                found.add(a[keep], b[keep])
            out.append(found.result())
        return pd.concat(out)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, miss: float = 0.001) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row with columns vec_id and embedding."""
    v = column("embedding")
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(column("vec_id").alias("vec_id"), F.when(F.coalesce(whole, F.lit(False)), v).alias("v"))
    # pinned, so that the numbers stay what they are
    classes = pin(rows.filter("v is not null").groupBy("v").agg(F.count("*").alias("m"), F.min("vec_id").alias("own")).withColumn("id", F.monotonically_increasing_id()))
    k, tables, width = plan(classes.count(), cosine, miss)
    dealt = pin(classes.select("v", "id", "m").mapInArrow(_deal(k, tables, width), "t int, key long, id long, m long"))
    shared = pin(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = dealt.join(shared, ["t", "key"]).join(classes.select("id", "v"), "id")
    groups = max(1, dealt.count() // (tables * SMALL * 8))
    small = met.filter(F.col("n") <= SMALL).withColumn("g", F.pmod("key", F.lit(groups))).groupBy("t", "g").applyInPandas(_buckets(k, tables, width, cosine), LINKS)
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    large = met.filter(F.col("n") > SMALL).withColumn("tiles", tiles)
    large = large.withColumn("o", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    large = large.select("t", "key", "id", "m", "v", F.least("o", "other").alias("x"), F.greatest("o", "other").alias("y"), F.when(F.col("o") == F.col("other"), 0).when(F.col("o") < F.col("other"), 1).otherwise(2).alias("side"))
    met = pin(small.unionByName(large.groupBy("t", "key", "x", "y").applyInPandas(_tile(k, tables, width, cosine), LINKS)))
    counts = met.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(met.filter("b >= 0").select("a", "b"))
    found = classes.join(counts, classes["id"] == counts["a"], "left").join(roots, classes["id"] == roots["node"], "left")
    found = found.select("v", "own", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    named = found.groupBy("root").agg(F.min("own").alias("component_id"))
    found = pin(found.join(named, "root").select("v", "n_links", "component_id", F.lit(True).alias("known")))
    free(classes, dealt, shared, met)
    out = rows.join(found, "v", "left")
    component = F.when(F.coalesce("known", F.lit(False)), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
