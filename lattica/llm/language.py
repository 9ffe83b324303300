"""Language identification (operator 1).

Averaged hashed subword embeddings with a linear softmax: a text is the mean of the
embeddings of its letter n-grams (1 to 4 letters with word borders, hashed to ``BUCKETS``
rows), followed by one linear layer.  Both are trained together by stochastic gradient
descent in numpy, then a temperature is fitted on rows kept apart, and a rejection threshold
is set there so that ``REJECT`` of the rightly classified rows fall below it.

The model is fitted on about ``TRAIN_ROWS`` rows, an equal number for each language as far
as there are that many, chosen by a hash of doc_id and text, so rows that repeat count once, and taken in
the order of that hash, so reruns agree; each contributes the counts of all its n-grams, so a long text
costs at most BUCKETS counts.  Every lang value is a class; over ``MOST_LANGS`` of them raise ValueError.
Prediction reads whole texts; rows that repeat a doc_id are predicted each by its own text.

Null texts, and texts without a letter, give ``und`` with score 0.  With no labelled row at
all, or one language alone, every text with a letter gets that language (or ``und``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import column, flat, mix, row_key, slices

BUCKETS, DIM, TRAIN_ROWS, REJECT, MOST_LANGS = 1 << 15, 16, 3_000, 0.01, 2_000
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x30000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each n-gram, in the order of texts for each n."""
    data, offsets = flat(batch.column("text"))
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(data) + 1, np.int64)  # code points before each byte
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    begins = first[offsets]
    x = letters()[points]
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    # one border for each run of other characters, and one between texts
    border = x == 0
    new = np.concatenate([[True], text[1:] != text[:-1]]) if len(x) else border
    keep = ~border | np.concatenate([[True], ~border[:-1]]) if len(x) else border
    at = np.flatnonzero(keep)
    x, text, new = x[at].astype(np.uint64), text[at], new[at]
    spot = np.flatnonzero(new)
    x, text = np.insert(x, spot, 0), np.insert(text, spot, text[spot])
    docs, ids, h = [], [], np.zeros(len(x), np.uint64)
    inner = x == 0
    for n in range(1, 5):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = mix(h[:m] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(n))
        # within one text; a border only at either end
        ok = text[:m] == text[n - 1 :]
        for j in range(1, n - 1):
            ok &= ~inner[j : j + m]
        ok &= ~(inner[:m] & inner[n - 1 :])
        docs.append(text[:m][ok])
        ids.append((h[ok] & np.uint64(BUCKETS - 1)).astype(np.int32))
    return (np.concatenate(docs), np.concatenate(ids)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            doc, ids = grams(batch)
            key, n = np.unique(doc * BUCKETS + ids, return_counts=True)
            cut = np.searchsorted(key, np.arange(1, batch.num_rows) * BUCKETS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("rk"), *(pa.array([k.astype(np.int32).tobytes() for k in np.split(x, cut)], pa.binary()) for x in (key % BUCKETS, n))],
                names=["lang", "rk", "ids", "n"],
            )


class Model:
    """Per-bucket logits: the embedding and the linear layer multiplied out after training."""

    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float, floor: float):
        self.langs, self.logits, self.bias, self.temperature, self.floor = langs, logits.astype(np.float32), bias, temperature, floor

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        doc, ids = grams(batch)
        n = np.bincount(doc, minlength=batch.num_rows)
        sums = np.stack([np.bincount(doc, self.logits[ids, k], batch.num_rows) for k in range(len(self.langs))], axis=1)
        return softmax((sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(langs: list[str], rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 4, rate: float = 2.0) -> Model:
    """rows: (label, buckets, counts)."""
    rng = np.random.default_rng(3)
    rows = [r for r in rows if len(r[1])]
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) // 5)
    apart, own = order[:cut], order[cut:] if len(rows) > 5 else order
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    layer, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for r in rng.permutation(own):
            label, ids, n = rows[r]
            w = n / n.sum()
            mean = w @ embed[ids]
            p = softmax((mean @ layer + bias)[None, :])[0]
            p[label] -= 1
            back = layer @ p
            layer -= step * 0.5 * np.outer(mean, p)
            bias -= step * 0.05 * p
            embed[ids] -= step * 8 * np.outer(w, back)
    model = Model(langs, embed @ layer, bias, 1.0, 0.0)
    z = np.array([(rows[r][2] / rows[r][2].sum()) @ model.logits[rows[r][1]] + bias for r in apart])
    y = np.array([rows[r][0] for r in apart])
    if len(y):
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.01, 20, 80), key=loss))
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.floor = float(np.quantile(right, REJECT)) if len(right) else 0.0
    return model


def fit(docs: DataFrame, allowed: Column, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from text and lang of the rows of ``docs`` that ``allowed`` admits."""
    doc_id, text = column("doc_id"), column("text")
    rows = docs.filter(allowed & column("lang").isNotNull() & text.isNotNull()).select(column("lang").alias("lang"), text.alias("text"), row_key(doc_id, text).alias("rk"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGS + 1)
    sizes = {r["lang"]: r["n"] for r in counts.collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages")
    if not sizes:
        return None
    each = train_rows / len(sizes)
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, each / n))) for k, n in sizes.items()), F.lit(0.0))
    picked = rows.filter(F.pmod(F.xxhash64("rk", F.lit(17)), F.lit(1 << 24)) < share * (1 << 24)).dropDuplicates(["rk"])
    got = picked.mapInArrow(_count, "lang string, rk long, ids binary, n binary").toArrow().sort_by([("rk", "ascending"), ("lang", "ascending")])
    langs = sorted(sizes)
    return train(langs, [(langs.index(a), np.frombuffer(b, np.int32), np.frombuffer(c, np.int32)) for a, b, c in zip(*(got.column(k).to_pylist() for k in ("lang", "ids", "n")), strict=True)])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for batch in slices(whole):
                spoken = batch.column("spoken").to_numpy(zero_copy_only=False)
                best, top = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
                if m is not None:
                    p = m.scores(batch)
                    best, top = np.where(spoken, p.argmax(axis=1), -1), np.where(spoken, p.max(axis=1), 0.0)
                names = [m.langs[k] if k >= 0 else "und" for k in best]
                rejected = top < (m.floor if m is not None else 1.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    text = column("text")
    return docs.select(column("doc_id").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("spoken")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
