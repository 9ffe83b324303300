"""Classifiers by compression against zstandard dictionaries (operators 2 and 9).

Two dictionaries, one from texts of either label, are both given to the compressor; what a
dictionary has seen compresses shorter.  A window of a text is compressed against each, and
the difference of the two lengths says which text it is more like.  A text's differences make
a few features, and a logistic curve fitted on rows kept apart from the dictionaries turns
them into a calibrated score.

Toxicity looks for passages.  Most of a toxic text is ordinary language, and a dictionary of whole
texts would hold hardly anything else.  So the dictionaries are trained in rounds, by compression
alone: the pair trained on one half of the toxic and ordinary texts measures the windows of the other
half, and the next pair is trained on the windows that the toxic dictionary saves the most on, each
cut down to the words that the saving comes from: toxic ones, and as hard negatives the ordinary ones
that look most toxic.  Which saving counts is calibrated in each round so that a share of ``RATE`` of
ordinary windows reaches it.  Beneath, both dictionaries hold the same trained ordinary text, so shared
language costs the same in both.  A text's features are how many of its windows (of ``WORDS`` words)
reach each saving, and the savings' mean and maximum.

Quality looks at the whole: one dictionary from good and one from bad texts, and the differences
of the compressed sizes of all windows, normalised by the windows' lengths and by their compressed sizes:
their means, and how they are spread over the text.

Learning takes at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of doc_id, whose
texts have ``TRAIN_CHARS`` characters or fewer.  Scoring reads whole texts.

Null and empty texts get the score of a text without any difference.  Labels other than 0
and 1 are ignored; of repeated labels the largest counts, and of texts that repeat a doc_id the
least is learned from.  Rows that repeat a doc_id are scored each by its own text.  Without rows of
both labels, every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import column, texts

TRAIN_ROWS, TRAIN_CHARS = 4_000, 20_000
#: Trained bytes of good or bad text.
TRAINED = 65_536
LEVEL = 6


def _dictionary(samples: list[bytes], size: int, **given: int) -> bytes:
    """Trained with zstandard; where there is too little for its trainer, the samples themselves."""
    samples = [s for s in samples if len(s) >= 8]
    total = sum(map(len, samples))
    if len(samples) >= 10 and total >= (size if given else 8 * 1024):
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 4)), samples, **given).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


#: Ends each window of words.  Both dictionaries end with it, so a window is always stored
#: compressed, never raw, and each byte that a dictionary saves on the word counts.  It is also
#: longer than the 8 bytes before a block's end in which the compressor looks for no match.
PREAMBLE = b"=<window>=~preamble~=<#>=" * 2


class Pair:
    """Two compressors that differ in their dictionaries alone; made anew in each process."""

    def __init__(self, zero: bytes, one: bytes, strategy: int, source: int):
        self.parts = (zero, one, strategy, source)
        self._made: list = []

    def __getstate__(self):
        return self.parts

    def __setstate__(self, parts):
        self.parts, self._made = parts, []

    def lengths(self, window: bytes) -> tuple[int, int]:
        """Bytes that a window takes under the first dictionary, and under the second."""
        if not self._made:
            *parts, strategy, source = self.parts
            for part in parts:
                d = zstandard.ZstdCompressionDict(part or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=max(map(len, parts)), source_size=source, min_match=4, strategy=strategy, write_content_size=False, write_dict_id=False, write_checksum=False)
                d.precompute_compress(compression_params=p)
                self._made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
        zero, one = self._made
        return len(zero(window)), len(one(window))


def word_windows(text: bytes, n: int) -> list[bytes]:
    words = text.lower().split()
    return [b" %b " % b" ".join(words[i : i + n]) for i in range(0, len(words), n)]


def byte_windows(text: bytes, n: int) -> list[bytes]:
    return [text[i : i + n] for i in range(0, len(text), n)]


def apart_texts(found: list[bytes], shingle: int = 4) -> list[bytes]:
    """One text of each group of near copies (of equal least shingle hash, in any of three hashes),
    so that words of a text that was copied often don't pass for typical ones."""
    seen, out = set(), []
    for t in found:
        words = t.lower().split()
        parts = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
        keys = {(seed, min(xxhash.xxh64_intdigest(p, seed) for p in parts)) for seed in (1, 2, 3)}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


class Toxicity:
    #: Words of a window, when a text is scored and when the dictionaries are trained; rounds of training;
    #: share of ordinary windows that may reach the saving that counts; bytes of either dictionary of its own,
    #: and of the one that they share.
    WORDS, MINED, ROUNDS, RATE, OWN, SHARED = 3, 2, 6, 0.001, 16_384, 4_096
    RIDGE = 3.0

    def __init__(self, zero: list[bytes], one: list[bytes]):
        zero, one = apart_texts(zero), apart_texts(one)
        third = max(1, len(zero) // 3)
        self.base = _dictionary([w for t in zero[:third] for w in word_windows(t, 16)], self.SHARED)
        # each half is measured by the pair that was trained on the other
        halves = [[[w for t in ts[k::2] for w in word_windows(t, self.MINED)] for k in (0, 1)] for ts in (zero[third:], one)]
        ordinary, toxic = halves
        mined0, mined1 = [x[: max(map(len, toxic))] for x in ordinary], toxic
        for turn in range(self.ROUNDS):
            pairs = [self._pair(*(self._own(mined[k], turn) for mined in (mined0, mined1))) for k in (1, 0)]
            gain0, gain1 = ([self._gains(p, ws) for p, ws in zip(pairs, both, strict=True)] for both in halves)
            mined0, mined1 = [], []
            for k in (0, 1):
                least = self._cut(gain0[k])
                found = [w for w, g in zip(toxic[k], gain1[k], strict=True) if g >= least]
                hard = np.argsort(-gain0[k], kind="stable")[: max(len(found), 200)]
                mined1.append(self._trimmed(pairs[k], found))
                mined0.append(self._trimmed(pairs[k], [ordinary[k][i] for i in hard]))
        self.pair = self._pair(*(self._own([w for half in mined for w in half], self.ROUNDS) for mined in (mined0, mined1)))

    def __getstate__(self):
        return self.pair

    def __setstate__(self, pair):
        self.pair = pair

    def _own(self, windows: list[bytes], turn: int) -> bytes:
        """What one dictionary holds of its own: of the first round's windows, or of passages cut down."""
        if not turn:
            return _dictionary(windows, self.OWN)
        return _dictionary([b"".join(windows[i : i + 16]) for i in range(0, len(windows), 16)], self.OWN, k=24, d=6)

    def _pair(self, zero: bytes, one: bytes) -> Pair:
        size = max(len(zero), len(one))
        return Pair(*(x.rjust(size, b"\0") + self.base + PREAMBLE for x in (zero, one)), zstandard.STRATEGY_LAZY, 256)

    @staticmethod
    def _gains(pair: Pair, windows: list[bytes]) -> np.ndarray:
        lengths = pair.lengths
        return np.array([a - b for a, b in (lengths(b"=<#>=" + w + PREAMBLE) for w in windows)], np.int64)

    def _cut(self, gains: np.ndarray) -> int:
        """The least saving that at most a share of RATE of ordinary windows reaches."""
        return next(k for k in range(1, 1 << 20) if (gains >= k).sum() <= self.RATE * len(gains))

    def _trimmed(self, pair: Pair, windows: list[bytes]) -> list[bytes]:
        """Of each window the words that most of the saving comes from."""
        out = []
        for w in windows:
            words = [b" %b " % x for x in w.split()]
            gains = self._gains(pair, words)
            out += [x for x, g in zip(words, gains, strict=False) if g >= max(2, 0.6 * gains.max())]
        return out

    def features(self, text: bytes) -> list[float]:
        # a long run without spaces is cut, each piece being a window
        windows = [w[i : i + 256] for w in word_windows(text, self.WORDS) for i in range(0, len(w), 256)]
        gains = self._gains(self.pair, windows) if windows else np.zeros(1, np.int64)
        reach = len(gains) - np.searchsorted(np.sort(gains), np.arange(1, 13))
        return [*np.log1p(reach), math.log1p(len(gains)), float(gains.mean()), float(gains.max())]


class Quality:
    """Windows of two lengths, whole passages and lines, each with a pair of dictionaries of its own."""

    RIDGE = 1.0
    #: Bytes of a window, and of the samples that its dictionaries are trained on.
    SCALES = ((1_024, 512), (128, 128))
    #: Normalised differences that shares of the short windows are counted below.
    STEPS = (-0.5, -0.3, -0.2, -0.1, -0.05, 0.0, 0.05, 0.1, 0.2, 0.3)

    def __init__(self, zero: list[bytes], one: list[bytes]):
        self.pairs = [Pair(*(_dictionary([w for t in ts for w in byte_windows(t, sample)], TRAINED) for ts in (zero, one)), zstandard.STRATEGY_DFAST, size) for size, sample in self.SCALES]

    def features(self, text: bytes) -> list[float]:
        out: list[float] = []
        for (size, _), pair in zip(self.SCALES, self.pairs, strict=True):
            made = [(*pair.lengths(w), len(w)) for w in byte_windows(text, size)] or [(1, 1, 1)]
            a, b, n = (np.array(x, float) for x in zip(*made, strict=True))
            least = np.minimum(a, b)
            out += [100 * (a - b).sum() / n.sum(), 100 * (a - b).sum() / least.sum()]
            for each in ((a - b) / n, (a - b) / least):
                out += [100 * x for x in (each.min(), each.max(), *np.quantile(each, (0.1, 0.5, 0.9)), each.std())]
        return [float(x) for x in (*out, *(each[:, None] < np.array(self.STEPS)).mean(axis=0))]


class Model:
    """A classifier of a kind above with its logistic curve."""

    def __init__(self, kind, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.kind, self.mean, self.scale, self.weights = kind, mean, scale, weights

    def score(self, batch: list[bytes]) -> np.ndarray:
        if not batch:
            return np.zeros(0)
        if self.kind is None:
            return np.full(len(batch), 1 / (1 + math.exp(-self.weights[0])))
        x = np.array([self.kind.features(t) for t in batch])
        # summed row by row, so that a score doesn't depend on the batch
        return 1 / (1 + np.exp(-((((x - self.mean) / self.scale) * self.weights[1:]).sum(axis=1) + self.weights[0])))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant first, by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, kind: type, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns label ``label`` from rows of ``docs`` and ``labels`` whose doc_id ``allowed`` admits."""
    spark = docs.sparkSession
    value = column(label).cast("int")
    marked = labels.select(column("doc_id").alias("doc_id"), value.alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    marked = marked.filter(allowed).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*(F.when(F.col("y") == k, F.lit(min(1.0, train_rows / 2 / n))) for k, n in counts.items()), F.lit(0.0))
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 24)) < share * (1 << 24))
    body = docs.select(column("doc_id").alias("doc_id"), column("text").alias("text")).filter(F.length("text") <= TRAIN_CHARS)
    # chosen is bounded by train_rows, so it is what is broadcast
    got = body.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toArrow().sort_by("doc_id")
    y, body = got.column("y").to_numpy(), texts(got.column("text"))
    prior = math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    # rows alternate between the dictionaries and the curve, so that neither sees the other's
    order = np.random.default_rng(5).permutation(len(y))
    own, apart = order[: len(y) * 2 // 3], order[len(y) * 2 // 3 :]
    if len(set(y[own])) < 2 or len(set(y[apart])) < 2:
        return Model(None, np.zeros(1), np.ones(1), np.array([prior]))
    made = kind([body[i] for i in own if y[i] == 0], [body[i] for i in own if y[i] == 1])
    x = np.array([made.features(body[i]) for i in apart])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    w = logistic((x - mean) / scale, y[apart].astype(float), kind.RIDGE)
    # the sample has other shares of the labels than the corpus: move the constant back
    w[0] += prior - math.log(max(1, (y[apart] == 1).sum()) / max(1, (y[apart] == 0).sum()))
    return Model(made, mean, scale, w)


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """doc_id, score and predicted of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.score(texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(column("doc_id").alias("doc_id"), column("text").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns and order of columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.score(texts(batch.column("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)
