"""SimHash near-duplicate groups found with vantage-point trees (operator 7).

Fingerprints: bit i of a document is set if it is set in over half of its shingles' hashes.
Equal fingerprints form one class first, so copies never meet in pairs.  A tree over a
bounded sample of the classes (``SAMPLE``) splits them by Hamming distance to a vantage
point.  A class goes to its own leaf as a member, and as a query to each leaf that the
triangle bound |d(x, v) - mu| <= radius doesn't exclude; so any two classes within the
radius meet in a leaf, and what meets is compared exactly.  A node that so few queries could
skip that splitting costs more than it saves becomes a leaf.  Leaves over ``TILE`` members are
cut into tiles, and each pair of tiles is a task row group of bounded size.  A leaf reports a
spanning forest of its links, not the links, so a group of m copies yields under m rows.

``near_sets``, for near-duplicates by the Jaccard similarity of their sets of shingles: a shingle
that repeats counts once, in the fingerprint too, and a class is one set of shingles.  Fingerprints
of 64 * ``WORDS`` bits of sets of similarity 0.8 differ by some 15 % of their bits, against half for unrelated ones; no
vantage point prunes at such a radius over a whole corpus.  So classes are dealt to shards first, by
``BANDS`` keys of ``ROWS`` least hashes of the set each, of which two sets of similarity s share none with
probability (1 - s ** ROWS) ** BANDS, 0.2 % at 0.8.  Trees are built within shards, where
fingerprints are clustered; shards beyond ``TILE`` members are cut into tiles whose pairs are queried
apart.  Fingerprints select candidates only, within five standard deviations over what the similarity
makes: classes link only if their sets (of 64-bit hashes), compared within each component of the
candidates, have the similarity.  Large components are cut into tiles too.

Null or empty texts have the fingerprint zero and are linked like any other.  Texts of fewer
words than a shingle are one shingle.  Classes have numbers of their own, so any id may be null or
repeat: rows that repeat a doc_id are each compared by their own text, and a component goes by the
smallest doc_id among its rows, null if all are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bitmap, column, components, free, in_bitmap, mix, pin, row_key, slices, texts

SEED = 42
#: Fingerprints that the driver builds the tree's upper part from, and members of a leaf aimed at.
SAMPLE, LEAF, TILE = 32_768, 2_048, 4_096
#: Sets, and shingles in them, of a tile of a component; bins that share the small components.
SETS, SHINGLES, BINS = 1_024, 1 << 20, 64
#: Words of a fingerprint of near_sets; shards' keys, and least hashes in each.
WORDS, BANDS, ROWS = 4, 16, 5
#: Shards of up to this many classes are compared many to a group; larger ones by trees with such leaves.
SMALL = 128
#: A node is split only if under this share of queries would go both ways.
OVERLAP = 0.7


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    return np.array([digest(joined[s : e - 1], SEED) for s, e in zip(at, at[shingle:], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """64 * words bits; the first 64 from the hashes as they are, the others from remixed ones."""
    out = []
    for k in range(words):
        h = hashes if k == 0 else mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        votes = np.zeros(64, np.int64)
        for i in range(0, len(h), 16_384):
            part = h[i : i + 16_384].astype(">u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big"))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_ODD = np.random.default_rng(13).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """Keys of the shards of a set of shingles, by its least hashes under several permutations."""
    if not len(hashes):
        return [0] * BANDS
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4_096):
        np.minimum(least, (hashes[i : i + 4_096][None, :] * _ODD[:, None]).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(key ^ row)
    return key.view(np.int64).tolist()


def _fingerprints(shingle: int, words: int, sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_shingle_hashes(t, shingle) for t in texts(batch.column("text"))]
            hashes = [np.unique(h) for h in hashes] if sets else hashes
            made = [fingerprint(h, words) for h in hashes]
            cols = {"doc_id": batch.column("doc_id"), "rk": batch.column("rk"), "n": pa.array([len(h) for h in hashes], pa.int64())}
            if sets:
                cols["own_set"] = pa.array([_signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)) for h in hashes], pa.int64())
                keys = [band_keys(h) for h in hashes]
                cols |= {f"b{k}": pa.array([x[k] for x in keys], pa.int64()) for k in range(BANDS)}
            cols |= {f"f{k}": pa.array([_signed(f[k]) for f in made], pa.int64()) for k in range(words)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, sets: bool = False) -> DataFrame:
    """doc_id, rk (the row's key), n (shingles) and f0.. (the fingerprint, as signed longs) of each row.

    With ``sets`` each shingle counts once, own_set is a hash of the set, and b0.. are its shards' keys.
    """
    names = ["doc_id", "rk", "n", *(["own_set", *(f"b{k}" for k in range(BANDS))] if sets else []), *(f"f{k}" for k in range(words))]
    doc_id, text = column("doc_id"), column("text")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), row_key(doc_id, text).alias("rk")).mapInArrow(_fingerprints(shingle, words, sets), ", ".join(f"{n} long" for n in names))


# ---- the tree -------------------------------------------------------------------------


def distance(points: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bits by which fingerprints, of one word or a row of several, differ from ``v``."""
    bits = np.bitwise_count(points ^ v).astype(np.int64)
    return bits if bits.ndim == 1 else bits.sum(axis=1)


def grow(points: np.ndarray, radius: int, leaf: int) -> list[tuple]:
    """Nodes (vantage point, mu, inner child, outer child); a leaf is a negative child, -1 - its number.

    Inner: distance <= mu.  Node 0 is the root; no nodes means one leaf.
    """
    nodes: list[tuple] = []
    leaves = [0]
    rng = np.random.default_rng(7)

    def build(own: np.ndarray) -> int:
        if len(own) > leaf:
            best = None
            for v in own[rng.integers(0, len(own), 4)]:  # of a few vantage points, the one that spreads most
                d = distance(own, v)
                mu = int(np.median(d))
                inner = d <= mu
                both = float((np.abs(d - mu - 0.5) <= radius + 0.5).mean())
                if inner.any() and not inner.all() and both < OVERLAP and (best is None or both < best[0]):
                    best = (both, v, mu, inner)
            if best:
                me = len(nodes)
                nodes.append(())
                _, v, mu, inner = best
                nodes[me] = (v, mu, build(own[inner]), build(own[~inner]))
                return me
        leaves[0] += 1
        return -leaves[0]

    build(points)
    return nodes


def route(nodes: list[tuple], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point number, leaf, is its own leaf) for each leaf that a point must be compared in."""
    out, todo = [], [(0 if nodes else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, own, home = todo.pop()
        if not len(own):
            continue
        if node < 0:
            out.append((own, np.full(len(own), -1 - node), home))
            continue
        v, mu, inner, outer = nodes[node]
        d = distance(points[own], v)
        into = d <= mu + radius
        todo.append((inner, own[into], (home & (d <= mu))[into]))
        into = d > mu - radius
        todo.append((outer, own[into], (home & (d > mu))[into]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def forest(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Labels of n points after joining a[i] with b[i]: each point's label is the smallest of its group."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def _compare(radius: int):
    """Members and queries of one leaf of the corpus's tree, or of a tile of it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable").drop_duplicates(["id", "home"])
        ids, code = np.unique(group["id"].to_numpy(), return_inverse=True)
        f = group["f0"].to_numpy().view(np.uint64)
        home = group["home"].to_numpy()
        mine, asks = np.flatnonzero(home), np.flatnonzero(~home)
        labels = np.arange(len(ids))
        step = max(1, (1 << 21) // max(1, len(mine)))
        for i in range(0, len(asks), step):
            q = asks[i : i + step]
            near = np.bitwise_count(f[q][:, None] ^ f[mine][None, :]) <= radius
            a, b = np.nonzero(near & (labels[code[q]][:, None] != labels[code[mine]][None, :]))
            labels = forest(len(ids), code[q[a]], code[mine[b]], labels)
        found = np.flatnonzero(labels != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[found], "b": ids[labels[found]]})

    return run


def _prints(group: pd.DataFrame) -> np.ndarray:
    return np.stack([group[f"f{k}"].to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)


def alike(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of such sizes can have the similarity."""
    return np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9


def _shards(radius: int, similarity: float):
    """Links of candidates in a group of whole small shards."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "id"], kind="stable")
        ids, code = np.unique(group["id"].to_numpy(), return_inverse=True)
        key, n, f = group["key"].to_numpy(), group["n"].to_numpy(), _prints(group)
        labels, step, a = np.arange(len(ids)), 1, np.arange(len(key))
        while len(a := a[a + step < len(key)]) and len(a := a[key[a] == key[a + step]]):
            b = a + step
            near = (distance(f[a], f[b]) <= radius) & alike(n[a], n[b], similarity)
            labels = forest(len(ids), code[a[near]], code[b[near]], labels)
            step += 1
        found = np.flatnonzero(labels != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[found], "b": ids[labels[found]]})

    return run


def _shard_tiles(radius: int, similarity: float):
    """Links of candidates of one tile of a large shard, or across two, found by a tree over the first."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable").reset_index(drop=True)
        ids, n, f = group["id"].to_numpy(), group["n"].to_numpy(), _prints(group)
        side = group["side"].to_numpy()  # 0: one tile with itself, 1: left, 2: right
        mine, asks = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
        labels, nodes = np.arange(len(ids)), grow(f[mine], radius, SMALL)
        own, own_leaf, home = route(nodes, f[mine], radius)
        ask, ask_leaf, _ = route(nodes, f[asks], radius)
        own, own_leaf = own[home], own_leaf[home]
        for leaf in np.unique(own_leaf):
            m, qs = mine[own[own_leaf == leaf]], asks[ask[ask_leaf == leaf]]
            step = max(1, (1 << 19) // len(m))
            for i in range(0, len(qs), step):
                q = qs[i : i + step]
                bits = sum(np.bitwise_count(f[q, k][:, None] ^ f[m, k][None, :]).astype(np.int16) for k in range(WORDS))
                near = (bits <= radius) & alike(n[q][:, None], n[m][None, :], similarity)
                a, b = np.nonzero(near & (labels[q][:, None] != labels[m][None, :]))
                labels = forest(len(ids), q[a], m[b], labels)
        found = np.flatnonzero(labels != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[found], "b": ids[labels[found]]})

    return run


# ---- exact similarity -----------------------------------------------------------------


def similar(sets: list[np.ndarray], tile: np.ndarray, similarity: float, prints: np.ndarray | None = None, radius: int = 0) -> np.ndarray:
    """Labels of ``sets`` (sorted, distinct) after joining those that have the Jaccard similarity.

    Of two tiles, only pairs of one set from each are compared; pairs joined already are not, nor those
    whose fingerprints, if given, differ by more than ``radius``.
    """
    n = np.array([len(x) for x in sets])
    labels = np.arange(len(sets))
    cross = tile.min() != tile.max()
    codes = ends = docs = None
    enough = lambda both, a, b: both >= similarity * (a + b - both) - 1e-9

    def differ(q: int) -> np.ndarray:
        may = (tile != tile[q]) if cross else np.arange(len(sets)) < q
        left = np.flatnonzero(may & (labels != labels[q]) & alike(n, n[q], similarity))
        return left if prints is None or not len(left) else left[distance(prints[left], prints[q]) <= radius]

    for q in np.flatnonzero(tile == tile.min()):
        left = differ(q)
        # one set of a few groups first: where all are alike, one comparison joins a set to them
        for b in left[np.unique(labels[left], return_index=True)[1][:3]]:
            if labels[b] != labels[q] and enough(len(np.intersect1d(sets[q], sets[b], assume_unique=True)), n[q], n[b]):
                labels = forest(len(sets), np.array([q]), np.array([b]), labels)
        left = differ(q)
        if not len(left):
            continue
        if len(left) <= 8:
            a = [b for b in left if enough(len(np.intersect1d(sets[q], sets[b], assume_unique=True)), n[q], n[b])]
            labels = forest(len(sets), np.full(len(a), q), np.array(a, np.int64), labels)
            continue
        if codes is None:  # for each shingle, the sets that hold it
            every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            docs = np.repeat(np.arange(len(sets)), n)[np.argsort(inverse, kind="stable")]
            ends = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(every)))])
            codes = np.split(inverse, np.cumsum(n)[:-1])
        first, size = ends[codes[q]], ends[codes[q] + 1] - ends[codes[q]]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        both = np.bincount(docs[at], minlength=len(sets))[left]
        left = left[enough(both, n[q], n[left])]
        labels = forest(len(sets), np.full(len(left), q), left, labels)
    return labels


def _confirm(similarity: float, radius: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in group.groupby("root"):
            part = part.sort_values("id", kind="stable")
            ids = part["id"].to_numpy()
            labels = similar([np.asarray(x).view(np.uint64) for x in part["shingles"]], part["tile"].to_numpy(), similarity, _prints(part), radius)
            found = np.flatnonzero(labels != np.arange(len(ids)))
            a.append(ids[found])
            b.append(ids[labels[found]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _sets(bits: np.ndarray, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(in_bitmap(bits, whole.column("rk").to_numpy().view(np.uint64))))
            for batch in slices(whole):
                made = [np.unique(_shingle_hashes(t, shingle)).view(np.int64) for t in texts(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("rk"), pa.array(made, pa.list_(pa.int64()))], names=["d", "rk", "shingles"])

    return run


def confirmed(docs: DataFrame, members: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) of classes in one component whose sets of shingles have the similarity, as a spanning forest of each tile pair.

    members: id and root of a class, its fingerprint, n, and d and rk of one row of it.
    """
    names = [f"f{k}" for k in range(WORDS)]
    members = pin(members)
    n = members.count()
    bits = bitmap(members, "rk", n)
    doc_id, text = column("doc_id"), column("text")
    given = docs.select(F.coalesce(doc_id, F.lit(-1)).alias("d"), row_key(doc_id, text).alias("rk"), text.alias("text"))
    sets = given.mapInArrow(_sets(bits, shingle), "d long, rk long, shingles array<long>").dropDuplicates(["d", "rk"])
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / SETS, F.sum("n") / SHINGLES)).cast("int").alias("t"))
    bins = max(BINS, (members.agg(F.sum("n")).first()[0] or 0) // SHINGLES)
    small = F.col("t") <= 1
    tile = F.pmod(F.xxhash64("id", F.lit(3)), F.col("t")).cast("int")
    placed = pin(members.join(sizes, "root").select("id", "root", "d", "rk", *names, small.alias("small"), "t", tile.alias("tile"), F.when(small, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("g")))
    placed = placed.join(sets, ["d", "rk"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    placed = placed.select("id", "root", *names, "small", "g", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "shingles")
    return placed.groupBy("small", "g", "low", "high").applyInPandas(_confirm(similarity, radius), "a long, b long")


def _grouped(rows: DataFrame, classes: DataFrame, key: list[str], joined: DataFrame) -> DataFrame:
    """The rows with their components: doc_id, component_id, rk, root and head, and the key's columns."""
    roots = classes.join(joined, classes["id"] == joined["node"], "left").select(*key, "own", F.coalesce("root", "id").alias("root"))
    named = roots.groupBy("root").agg(F.min("own").alias("component_id"))
    roots = pin(roots.join(named, "root").select(*key, "root", "component_id"))
    free(classes)
    head = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return rows.join(roots, key).withColumn("head", head)


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, rk (the row's key), root and head of each row.

    root tells components apart; head is true for the component's rows of its smallest id.
    Classes link at ``radius`` or fewer differing bits.
    """
    rows = pin(fingerprints(docs, shingle))
    # pinned, so that the numbers stay what they are
    classes = pin(rows.groupBy("f0").agg(F.min("doc_id").alias("own")).withColumn("id", F.monotonically_increasing_id()))
    total = classes.count()
    leaves = max(1.0, total / LEAF)
    share = min(1.0, SAMPLE / max(1, total))
    # the sample is a hash range, so it is the same in each run, and bounded whatever total is
    chosen = classes.filter(F.pmod(F.xxhash64("f0", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("f0")
    points = chosen.toArrow().column("f0").to_numpy().view(np.uint64)
    tree = grow(np.unique(points), radius, max(8, int(len(points) / leaves)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["f0", "id", "leaf", "home"]
        for batch in batches:
            own, leaf, home = route(tree, batch.column("f0").to_numpy().view(np.uint64), radius)
            part = batch.take(pa.array(own))
            take, leaf, h = [part.column(k) for k in ("f0", "id")], pa.array(leaf.astype(np.int32)), pa.array(home)
            yield pa.RecordBatch.from_arrays([*take, leaf, pa.array(np.zeros(len(own), bool))], names=names)
            yield pa.RecordBatch.from_arrays([*(x.filter(h) for x in (*take, leaf)), pa.array(np.ones(int(home.sum()), bool))], names=names)

    dealt = classes.select("f0", "id").mapInArrow(deal, "f0 long, id long, leaf int, home boolean")
    sizes = dealt.groupBy("leaf").agg(F.sum(F.col("home").cast("int")).alias("m"), F.sum((~F.col("home")).cast("int")).alias("q"))
    # tiles of members and of queries: a task row group has at most about 2 * TILE members and 16 * TILE queries
    tiles = pin(sizes.filter("m > 0 and m + q > 1").select("leaf", F.ceil(F.col("m") / TILE).cast("int").alias("tm"), F.ceil(F.col("q") / (8 * TILE)).cast("int").alias("tq")))
    spread = F.xxhash64("id", F.lit(2))
    placed = dealt.join(tiles, "leaf").withColumn(
        "task",
        F.explode(
            F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("tq") - 1), lambda t: F.pmod(spread, F.col("tm")).cast("int") * F.col("tq") + t)).otherwise(
                F.transform(F.sequence(F.lit(0), F.col("tm") - 1), lambda t: t * F.col("tq") + F.pmod(spread, F.col("tq")).cast("int"))
            )
        ),
    )
    edges = placed.select("f0", "id", "home", "leaf", "task").groupBy("leaf", "task").applyInPandas(_compare(radius), "a long, b long")
    out = _grouped(rows, classes, ["f0"], components(edges))
    free(tiles)
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id", "rk", "root", "head")


def near_radius(similarity: float) -> int:
    """Bits by which fingerprints of sets of the similarity may differ: five standard deviations over the mean."""
    share, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * WORDS
    return math.ceil(bits * share + 5 * math.sqrt(bits * share * (1 - share)))


def near_sets(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id, rk (the row's key), root and head of each row, linked by their sets of shingles."""
    names, shards, radius = [f"f{k}" for k in range(WORDS)], [f"b{k}" for k in range(BANDS)], near_radius(similarity)
    rows = pin(fingerprints(docs, shingle, WORDS, True))
    key = [*names, "own_set", "n"]
    classes = pin(rows.groupBy(*key).agg(F.min("doc_id").alias("own"), *(F.max(b).alias(b) for b in shards)).withColumn("id", F.monotonically_increasing_id()))
    # a set has another one of the similarity only if one shingle more leaves it so similar
    some = classes.filter(F.col("n") >= similarity * (F.col("n") + 1) - 1e-9)
    dealt = some.select("id", F.explode(F.array(*shards)).alias("key"))
    sizes = pin(dealt.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    met = pin(dealt.join(sizes, "key").join(some.select("id", "n", *names), "id"))
    groups = max(1, met.count() // 4_096)
    small = met.filter(F.col("m") <= SMALL).withColumn("g", F.pmod("key", F.lit(groups))).groupBy("g").applyInPandas(_shards(radius, similarity), "a long, b long")
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    large = met.filter(F.col("m") > SMALL).withColumn("o", F.pmod(F.xxhash64("id"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    large = large.select("key", "id", "n", *names, F.least("o", "other").alias("x"), F.greatest("o", "other").alias("y"), F.when(F.col("o") == F.col("other"), 0).when(F.col("o") < F.col("other"), 1).otherwise(2).alias("side"))
    large = large.groupBy("key", "x", "y").applyInPandas(_shard_tiles(radius, similarity), "a long, b long")
    joined = components(small.unionByName(large))
    maybe = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    maybe = classes.join(maybe, classes["id"] == maybe["node"]).select(*key, "id", "root")
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("d"), "rk")).alias("one")
    members = rows.join(maybe, key).groupBy("id", "root", "n", *names).agg(one).select("id", "root", "n", *names, "one.d", "one.rk")
    out = _grouped(rows, classes, key, components(confirmed(docs, members, shingle, similarity, radius)))
    free(sizes, met)
    return out.select("doc_id", "component_id", "rk", "root", "head")
