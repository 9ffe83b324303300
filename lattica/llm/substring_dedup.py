"""Removal of word passages that repeat an earlier document (operator 3).

Prefix-partitioned suffix trees.  A suffix begins at each word and is read as deep as decides,
``window`` words.  Suffixes are dealt to subtrees by prefixes of two lengths: by an anchor of
``prefix`` words, and where many documents have the anchor, by all of the window.  (The anchor is the
run of ``prefix`` words that hashes lowest within the window, the prefix of the suffix that starts
there.  Equal windows share it at the same place; and as neighbouring windows mostly share it too,
they go to a subtree together, as one segment of text, which takes a fifth of the space.)  Anchors
that one document alone has are leaves, and left out.

A subtree is built as sorted suffixes with the lengths of their common prefixes: words are
numbered, not hashed, so comparison is exact.  Its nodes at depth ``window`` and deeper are the
repeats; of a node's documents, all but the smallest repeat it, and what they repeat at consecutive
places joins to maximal repeats.  Hashes only decide where a suffix goes.

Each task first builds the subtrees of its own documents: all but the smallest member of a
node are decided there, and one member goes on.  So a passage that a third of all
documents share sends one row per task.

Null text: no words.  Fewer words than a window: nothing removed.  A null doc_id counts as
larger than any other.  Rows that repeat a doc_id are judged each for itself and never
against each other.  The filter of shared anchors has a bounded size; of more anchors than it holds,
suffixes that repeat nothing go to subtrees as well: more work, the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import (
    LAST_ID,
    bitmap,
    column,
    flat,
    free,
    in_bitmap,
    may_hold,
    mix,
    pin,
    row_key,
    slices,
    span_hashes,
    texts,
    word_hashes,
    word_spans,
)

#: An anchor in more documents than this is lengthened to the whole window.
HEAVY = 1000
#: Suffixes that a task sorts at once.
HELD = 600_000
SEGMENTS = "p long, seg binary, nid long, rk long, at int, n int"


def _windows(batch: pa.RecordBatch, window: int, prefix: int):
    """Spans of the words of a batch, and (text number, first word, place in the text, anchor) of each window."""
    data, offsets = flat(batch.column("text"))
    starts, ends, first = word_spans(data, offsets)
    n = len(starts)
    if n < window:
        none = np.zeros(0, np.int64)
        return (data, starts, ends), (none, none, none, none.astype(np.uint64)), none.astype(np.uint64)
    words = word_hashes(data, starts, ends)
    at = np.arange(n - prefix + 1)
    runs = span_hashes(words, at, at + prefix)
    wide, low = window - prefix + 1, runs
    step = 1
    while step * 2 <= wide:  # the minimum of wide runs, by doubling
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(low) - (wide - step)], low[wide - step :]) if wide > step else low
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    return (data, starts, ends), (text[at], at, at - first[text[at]], low[at]), words


def suffix_tree(ids: np.ndarray, starts: np.ndarray, window: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of ``ids`` (word numbers) at ``starts``, read ``window`` deep, and for each the
    length of the prefix that it has in common with the one before; suffixes of a ``group`` are kept together."""
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)[starts] if len(starts) else np.zeros((0, window), ids.dtype)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    per = max(1, 63 // bits)
    keys = []
    for i in range(0, window, per):  # several words in one number, the first in the highest place
        key = np.zeros(len(rows), np.int64)
        for j in range(i, min(window, i + per)):
            key = (key << bits) | rows[:, j]
        keys.append(key)
    if group is not None:
        keys.insert(0, group)
    order = np.lexsort(keys[::-1])
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.where(same.all(axis=1), window, same.argmin(axis=1)) if len(same) else np.zeros(0, np.int64)
    if group is not None:
        common[group[order[1:]] != group[order[:-1]]] = 0
    return order, np.concatenate([np.zeros(min(1, len(order)), np.int64), common])


def repeats(order: np.ndarray, common: np.ndarray, depth: int, nid: np.ndarray) -> np.ndarray:
    """Which suffixes stand below a node of that depth with a document smaller than theirs."""
    out = np.zeros(len(order), bool)
    if len(order):
        head = common < depth
        low = np.minimum.reduceat(nid[order], np.flatnonzero(head))
        out[order] = nid[order] > low[np.cumsum(head) - 1]
    return out


def _runs(hit: np.ndarray, *same: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs among the suffixes numbered ``hit``: consecutive places, equal in ``same``."""
    if not len(hit):
        return hit, hit
    new = np.ones(len(hit), bool)
    new[1:] = (at[hit][1:] != at[hit][:-1] + 1) | np.logical_or.reduce([x[hit][1:] != x[hit][:-1] for x in same])
    head = np.flatnonzero(new)
    return hit[head], np.append(head[1:], len(hit)) - head


def _prefixes(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                _, (text, _, _, low), _ = _windows(batch, window, prefix)
                ids = batch.column("nid").to_numpy()[text]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (ids[1:] != ids[:-1])
                low, ids = low[new], ids[new]
                order = np.lexsort((ids, low))
                low, ids = low[order], ids[order]
                head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else order
                tail = np.append(head[1:], len(low)) - 1 if len(low) else order
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(low[head].view(np.int64)),
                        pa.array(ids[head]),
                        pa.array(ids[tail]),
                        pa.array(tail - head + 1),
                    ],
                    names=["p", "low", "high", "n"],
                )

    return run


def _batch(p, seg, nid, rk, at, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(p.view(np.int64)), seg, pa.array(nid), pa.array(rk), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
        names=["p", "seg", "nid", "rk", "at", "n"],
    )


def _segments(words: pa.Array, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Words first to first + size, joined by a space."""
    ends = np.cumsum(size)
    index = np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), words.take(pa.array(index)))
    return pc.cast(pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())), pa.binary())


def _suffixes(window: int, prefix: int, shared, heavy):
    """Rows (p, seg, nid, rk, at, n): a segment of n windows to compare, or without seg, n windows already found to repeat."""

    def settle(parts):
        arrays, begin, low, whole, nid, rk, at = zip(*parts, strict=True)
        sizes = np.array([len(x) for x in arrays])
        begin = np.concatenate([b + o for b, o in zip(begin, np.cumsum(sizes) - sizes, strict=True)])
        low, whole, nid, rk, at = (np.concatenate(x) for x in (low, whole, nid, rk, at))
        words = pa.concat_arrays(arrays)
        ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        later = repeats(*suffix_tree(ids, begin, window), window, nid)
        hit, n = _runs(np.flatnonzero(later), rk, nid, at=at)
        if len(hit):
            yield _batch(rk[hit].view(np.uint64), pa.nulls(len(hit), pa.binary()), nid[hit], rk[hit], at[hit], n)
        key = np.where(in_bitmap(heavy.value, low), mix(low ^ whole), low)
        first, n = _runs(np.flatnonzero(~later), rk, nid, key, at=at)
        for i in range(0, len(first), 50_000):
            f, m = first[i : i + 50_000], n[i : i + 50_000]
            yield _batch(key[f], _segments(words, begin[f], m + window - 1), nid[f], rk[f], at[f], m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for whole in batches:
            for batch in slices(whole):
                (data, starts, ends), (text, first, at, low), hashes = _windows(batch, window, prefix)
                keep = in_bitmap(shared.value, low)
                if not keep.any():
                    continue
                text, first, at, low = text[keep], first[keep], at[keep], low[keep]
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                # the words without what parts them, end to end
                sizes = ends - starts
                solid = np.zeros(len(data) + 1, np.int8)
                solid[starts] += 1
                solid[ends] -= 1
                body = data[np.cumsum(solid[:-1], dtype=np.int8) > 0]
                words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
                begin = (np.cumsum(covered) - 1)[first]
                parts.append((words.filter(pa.array(covered)), begin, low, span_hashes(hashes, first, first + window), batch.column("nid").to_numpy()[text], batch.column("rk").to_numpy()[text], at))
                held += len(first)
                if held >= HELD:
                    yield from settle(parts)
                    parts, held = [], 0
        if held:
            yield from settle(parts)

    return run


def _subtrees(window: int):
    """Reads segments sorted by prefix; gives the runs of windows that repeat a smaller document."""

    def grown(batch: pa.RecordBatch):
        p, nid, rk, at, n = (batch.column(k).to_numpy() for k in ("p", "nid", "rk", "at", "n"))
        lists = pc.split_pattern(batch.column("seg"), pattern=b" ")
        ids = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        seg = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        begin = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
        group = np.cumsum(np.concatenate([[0], p[1:] != p[:-1]]))
        later = repeats(*suffix_tree(ids, begin[seg] + place, window, group[seg]), window, nid[seg])
        hit, m = _runs(np.flatnonzero(later), seg, at=place)
        return pa.RecordBatch.from_arrays([pa.array(rk[seg[hit]]), pa.array(nid[seg[hit]]), pa.array((at[seg[hit]] + place[hit]).astype(np.int32)), pa.array(m.astype(np.int32))], names=["rk", "nid", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            found = pc.is_null(whole.column("seg"))
            yield whole.filter(found).select(["rk", "nid", "at", "n"])
            batch = whole.filter(pc.invert(found))
            # a group ends where the next one begins
            while batch.num_rows:
                p = batch.column("p").to_numpy()
                if held and held[-1].column("p")[-1].as_py() != p[0]:
                    yield grown(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                last = int(np.argmax(p == p[-1]))
                if last and not held:
                    yield grown(batch.slice(0, last))
                    batch = batch.slice(last)
                    continue
                cut = int(np.argmax(p != p[0])) or len(p)
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
        if held:
            yield grown(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _keep(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_gone, digests, kept = [], [], [], []
            for text, at, n in zip(texts(batch.column("text")), batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                gone = 0
                if at:
                    edge = np.zeros(len(words) + 1, np.int32)
                    start = np.asarray(at, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + np.maximum(1, np.asarray(n, np.int64)) + window - 1, -1)
                    out = np.cumsum(edge[:-1]) > 0
                    gone = int(out.sum())
                    words = [words[i] for i in np.flatnonzero(~out)]
                n_gone.append(gone)
                kept.append(b" ".join(words))
                digests.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string()), pa.array([k.decode() for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 13, prefix: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of each row of ``docs``."""
    spark = docs.sparkSession
    doc_id, text = column("doc_id"), column("text")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("nid"), row_key(doc_id, text).alias("rk"))
    found = (
        rows.select("nid", "text")
        .mapInArrow(_prefixes(window, prefix), "p long, low long, high long, n long")
        .groupBy("p")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        .filter("low < high")
        .select("p", "n")
    )
    found = pin(found)
    total = found.count()
    long = found.filter(F.col("n") > HEAVY)
    shared = spark.sparkContext.broadcast(bitmap(found, "p", total))
    heavy = spark.sparkContext.broadcast(bitmap(long, "p", long.count()))
    free(found)
    hits = (
        rows.select("nid", "rk", "text")
        .mapInArrow(_suffixes(window, prefix, shared, heavy), SEGMENTS)
        .repartition("p")
        .sortWithinPartitions("p")
        .mapInArrow(_subtrees(window), "rk long, nid long, at int, n int")
        .groupBy("rk", "nid")
        .agg(F.collect_list(F.struct("at", "n")).alias("hits"))
        .select("rk", "nid", F.col("hits.at").alias("at"), F.col("hits.n").alias("n"))
    )
    hits = pin(hits)
    # only texts that may have lost words meet the list in a join
    some, none = may_hold(rows, F.col("rk"), hits, "rk")
    none = none.select("doc_id", "text", F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<int>").alias("n"))
    return (
        some.join(hits, ["rk", "nid"], "left")
        .select("doc_id", "text", "at", "n")
        .unionByName(none)
        .mapInArrow(_keep(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    )
