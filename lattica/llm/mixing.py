"""Mixing sources to target weights by weighted fair queueing (operator 6); DataFrame functions only.

Each source's documents stand in a shuffled order (by the MD5 of their id and text), up to ``epochs``
times over.  The virtual finish time of a document is its source's words up to its end,
divided by the source's weight.  All are taken in the order of finish times until the
budget (all words once) is spent.  So each unexhausted source gets words in proportion to
its weight, and a source that has been taken ``epochs`` times over gives its rest to the others.

The running sums are made of range buckets: sums for each bucket first, then a running sum
over the buckets' totals, then one inside each bucket; no source and no global order is ever
sorted in one task.  Beyond a provable finish time nothing can be taken, so that part is not
dealt out.  Only the budget and the cut reach the driver.

What a source gives in one epoch is a beginning of its order, so ``take_mix`` needs only the last
document of each source and epoch: texts take part in no exchange.

Null text: size 0.  A null source is a source, the last.  Rows that repeat a doc_id count each; rows
that are wholly the same follow each other, and in ``take_mix`` all get the copies of the last of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import WORD_RE, column, free, pin, row_key

#: Parts of a source's shuffled order (16 ** 3, the first three digits of an MD5), and ranges of
#: finish time up to the point at which the budget is spent.
PARTS, RANGES = 4096, 4096
KINDS = 3  # weights 1, 2, 3, repeating
#: Cuts (a few numbers for each source) that may be broadcast; of more sources, cuts are joined by source.
CUTS = 200_000


def _digest(doc_id: Column, text: Column, seed: str) -> Column:
    """A place in the shuffled order; the text is in it, so that ids that are null or repeat spread as well."""
    given = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.md5(given.cast("binary"))


def _placed(docs: DataFrame, epochs: int, seed: str) -> tuple[DataFrame, list[Column]]:
    """Each row with its place in its source's order, and for each epoch whether it is taken then."""
    doc_id, text, source = column("doc_id"), column("text"), column("source")
    rows = pin(
        docs.select(
            doc_id.alias("doc_id"),
            source.cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"),
            _digest(doc_id, text, seed).alias("digest"),
            row_key(doc_id, text).alias("rk"),
        )
    )
    given = rows
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("longest"))
    # one row for each source from here on
    sources = sums.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", (F.col("s") - 1) % KINDS + 1)
    by_fill = Window.orderBy(F.col("source_size") * epochs / F.col("weight"), "s")
    filled = sources.withColumn("cap", F.col("source_size") * epochs).withColumn("budget", F.sum("source_size").over(Window.partitionBy()))
    filled = filled.withColumn("before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    filled = filled.withColumn("rest", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    filled = filled.withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    filled = pin(filled)
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    got = filled.agg(F.max("budget").alias("budget"), F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("r"), "s", "level")))["level"].alias("level"), F.max(F.col("longest") / F.col("weight")).alias("slack")).first()
    budget, level, slack = got["budget"] or 0, got["level"] or 0.0, got["slack"] or 0.0
    step = level / RANGES if level > 0 else 1.0
    targets = filled.select("source", "s", "weight", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))

    part = F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"]), "left").drop(targets["source"]).withColumn("part", part)
    offsets = rows.groupBy("s", "part").agg(F.sum("size").alias("own"))
    offsets = offsets.withColumn("offset", F.sum("own").over(Window.partitionBy("s").orderBy("part")) - F.col("own")).drop("own")
    inside = Window.partitionBy("s", "part").orderBy("digest", "doc_id", "size", "rk").rowsBetween(Window.unboundedPreceding, 0)
    placed = pin(rows.join(offsets, ["s", "part"]).withColumn("end", F.col("offset") + F.sum("size").over(inside)))
    free(given, filled)

    finish = (F.col("epoch") * F.col("source_size") + F.col("end")) / F.col("weight")
    passes = placed.withColumn("epoch", F.explode(F.array(*(F.lit(e) for e in range(epochs))))).withColumn("finish", finish)
    near = passes.filter(F.col("finish") <= level + slack).withColumn("range", F.floor(F.col("finish") / step))
    totals = near.groupBy("range").agg(F.sum("size").alias("own"))
    totals = totals.withColumn("upto", F.sum("own").over(Window.orderBy("range")))
    over = totals.filter(F.col("upto") > budget).agg(F.min(F.struct("range", (F.col("upto") - F.col("own")).alias("before"))).alias("r")).first()["r"]
    if over is None:
        return placed, [F.lit(True)] * epochs
    # the range in which the budget ends holds about one in RANGES of the words taken
    order = ["finish", "s", "digest", "doc_id", "end"]
    last = near.filter(F.col("range") == over["range"]).withColumn("upto", F.lit(over["before"]) + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    cut = last.filter(F.col("upto") <= budget).agg(F.max(F.struct(*order)).alias("c")).first()["c"]

    def is_taken(e: int) -> Column:
        at = (F.lit(e) * F.col("source_size") + F.col("end")) / F.col("weight")
        earlier = F.floor(at / step) < over["range"]
        if cut is not None:
            here = F.floor(at / step) == over["range"]
            given = F.struct(at.alias("finish"), *(F.col(k) for k in order[1:]))
            upto = F.struct(*(F.lit(cut[k]).cast(t).alias(k) for k, t in zip(order, ("double", "int", "string", "long", "long"), strict=True)))
            earlier = earlier | (here & (given <= upto))
        return earlier

    return placed, [is_taken(e) for e in range(epochs)]


def mix_sources(docs: DataFrame, epochs: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, and rk (the row's key) of each row."""
    placed, taken = _placed(docs, epochs, seed)
    times = sum((t.cast("int") for t in taken[1:]), taken[0].cast("int"))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), "rk")


def take_mix(docs: DataFrame, epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their columns and how many times over (copies, int).

    A column of docs that is called copies gives way to the new one.  Rows without words are never taken.
    """
    names = [c for c in docs.columns if c != "copies"]
    placed, taken = _placed(docs, epochs, seed)
    key = F.struct("digest", F.coalesce("doc_id", F.lit(-1)).alias("d"), "size", "rk")
    cuts = placed.filter("size > 0").groupBy(F.col("source").alias("__source")).agg(*(F.max(F.when(t, key)).alias(f"__cut{e}") for e, t in enumerate(taken)))
    cuts = pin(cuts)
    free(placed)
    cuts = F.broadcast(cuts) if cuts.count() <= CUTS else cuts
    doc_id, text = column("doc_id"), column("text")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")
    mine = F.struct(_digest(doc_id, text, seed).alias("digest"), F.coalesce(doc_id, F.lit(-1)).alias("d"), size.alias("size"), row_key(doc_id, text).alias("rk"))
    keyed = docs.select(*(column(c) for c in names), column("source").cast("string").alias("__s"), mine.alias("__k")).filter("__k.size > 0")
    met = keyed.join(cuts, keyed["__s"].eqNullSafe(cuts["__source"]))
    copies = sum((F.coalesce(F.col("__k") <= F.col(f"__cut{e}"), F.lit(False)).cast("int") for e in range(epochs)), F.lit(0))
    return met.withColumn("__n", copies).filter("__n > 0").select(*(column(c) for c in names), F.col("__n").alias("copies"))


ORACLE = r"""
WITH r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM r GROUP BY source),
s1 AS (SELECT *, (s - 1) % 3 + 1 AS weight, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM s0),
s2 AS (SELECT *, (budget - coalesce(CAST(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0)) / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl FROM s1),
v AS (SELECT lvl FROM s2 WHERE lvl <= CAST(cap AS DOUBLE) / weight ORDER BY CAST(cap AS DOUBLE) / weight, s LIMIT 1),
t AS (SELECT s2.*, least(CAST(cap AS DOUBLE), weight * v.lvl) AS target FROM s2, v),
p AS (SELECT doc_id, size, digest, t.*EXCLUDE (source), CAST(sum(size) OVER (PARTITION BY s ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS endw FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CAST(epoch * source_size + endw AS DOUBLE) / weight AS finish FROM p, (SELECT unnest([0, 1, 2]) AS epoch)),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, s, digest, doc_id, endw ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, size, source_size, target, CAST(coalesce(sum(size) FILTER (upto <= budget), 0) AS BIGINT) AS taken FROM g GROUP BY doc_id, size, source_size, target
"""
