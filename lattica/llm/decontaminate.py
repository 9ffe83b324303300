"""Benchmark decontamination by a prefix-filtered set join (operator 10); DataFrame functions only.

The benchmark's windows are sets of words with positions.  Words are ordered by rarity, as
counted over all documents; a document that holds a window holds its rarest word, so that
word is the window's prefix and the documents' words are joined with prefixes alone.  The
word's place in the window and the document bound where the window can begin, and windows
that would overrun the document go.  What remains is compared by a hash where it stands, and what
agrees then word for word.

Texts and their words take part in no exchange: prefixes are dealt to blocks of ``BLOCK`` rows, each
small enough to be broadcast, and documents are read once for each block (for one, as a rule).

Null and empty texts have no words and no hits; items without words are never found.  A
repeated item_id counts once, a null one counts in n_hit only.  Rows that repeat a doc_id
are judged each by its own text.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import ascii_lower, column, free, may_hold, pin, row_key

#: What parts words, before A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A word, before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Prefix rows, or words of the benchmark, that are broadcast at once: some 50 MB.
BLOCK = 500_000


def words_of(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), GAPS), "")


def _blocks(small: DataFrame) -> list[DataFrame]:
    """Parts of a pinned table by a hash of its words, each to be broadcast."""
    k = max(1, math.ceil(small.count() / BLOCK))
    return [F.broadcast(small.filter(F.pmod(F.xxhash64("word"), F.lit(k)) == b)) for b in range(k)]


def _union(parts) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and rk (the row's key)."""
    doc_id, text = column("doc_id"), column("text")
    rows = docs.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("rk"), words_of(text).alias("words"))
    items = benchmark.select(column("item_id").cast("string").alias("item"), words_of(column("text")).alias("words")).filter("size(words) > 0")
    windows = pin(
        items.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0))), lambda i: F.slice("words", i + 1, window))).alias("win"))
        .withColumn("wid", F.xxhash64("win"))
        .distinct()
    )
    # a hash can stand for two windows: each keeps its words, and the last join compares those
    distinct = windows.select("wid", "win").distinct()
    own = distinct.select("wid", "win", F.posexplode("win").alias("at", "word"))
    said = rows.select(F.explode("words").alias("word"))
    counted = pin(_union(said.join(b, "word").groupBy("word").agg(F.count("*").alias("n")) for b in _blocks(pin(own.select("word").distinct()))))
    # windows with a word that no document has can't occur
    rarest = (
        own.join(counted, "word", "left")
        .groupBy("wid", "win")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("r"))
        .filter("r.n > 0")
    )
    prefixes = pin(rarest.select(F.col("r.word").alias("word"), F.col("r.at").alias("off"), "wid", F.size("win").alias("len")).distinct())
    # the words stay where they are until the hash has decided: nothing is copied for a word that meets no prefix
    placed = rows.select("doc_id", "rk", "words", F.posexplode("words").alias("at", "word"))
    inside = "at >= off and at - off + len <= size(words)"
    here = F.slice("words", F.col("at") - F.col("off") + 1, F.col("len"))
    met = _union(placed.join(b, "word").filter(inside).filter(F.xxhash64(here) == F.col("wid")).select(F.coalesce("doc_id", F.lit(-1)).alias("d"), "rk", (F.col("at") - F.col("off")).alias("start"), "wid", here.alias("win")) for b in _blocks(prefixes))
    found = pin(met.distinct())
    true = pin(found.join(distinct, ["wid", "win"]).select("d", "rk", "start", "wid", F.size("win").alias("len")))
    hit = true.groupBy("d", "rk").agg(F.collect_set(F.struct("start", "len")).alias("spans"))
    hit = hit.select("d", "rk", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))).cast("long").alias("n_hit"))
    of = (
        true.select("d", "rk", "wid")
        .distinct()
        .join(windows.select("wid", "item").filter("item is not null").distinct(), "wid")
        .groupBy("d", "rk")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    n_words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    free(counted, prefixes, found)
    return (
        docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-1)).alias("d"), row_key(doc_id, text).alias("rk"), n_words.alias("n_words"))
        .join(hit, ["d", "rk"], "left")
        .join(of, ["d", "rk"], "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
            "rk",
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns.  Rows are told apart by doc_id and text."""
    names = docs.columns
    bad = contamination(docs, benchmark, window).filter("contaminated").select(F.coalesce("doc_id", F.lit(-1)).alias("__d"), F.col("rk").alias("__rk")).distinct()
    bad = pin(bad)
    doc_id, text = column("doc_id"), column("text")
    some, none = may_hold(docs, row_key(doc_id, text), bad, "__rk")
    some = some.join(bad, (F.coalesce(doc_id, F.lit(-1)) == F.col("__d")) & (row_key(doc_id, text) == F.col("__rk")), "left_anti")
    return none.unionByName(some).select(*(column(c) for c in names))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_aggregate(w[i:i + 9], 'string_agg', ' ') AS win, len(w[i:i + 9]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
h AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw USING (win) WHERE dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
