"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import compression, decontaminate, mixing, pii, simhash
from lattica.llm.common import free, load, may_hold, pin, row_key
from lattica.llm.queries import fold

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: the Jaccard similarity of sets of five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity scores 0.7 or more."""
    model = compression.fit(docs, load(spark, sf_dir, "labels"), "toxic", fold(3) != 1, compression.Toxicity)
    return compression.keep_ordinary(docs.select(COLUMNS), model, 0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: the one of smallest id, a null id being the last.

    Of rows that repeat that id, the one of the smallest row key stays, once.
    """
    groups = simhash.near_sets(docs, SHINGLE, SIMILARITY)
    groups = groups.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), "rk", "root", "head")
    heads = groups.filter("head")
    repeated = pin(heads.groupBy("root").agg(F.min(F.struct("rk", "d")).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    again = heads.join(repeated, "root").filter("rk <> first.rk or d <> first.d")
    gone = pin(groups.filter("not head").select("d", "rk").unionByName(again.select("d", "rk")).distinct())
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(-1)).alias("d"), row_key(docs["doc_id"], docs["text"]).alias("rk"))
    # only rows that may be listed meet the lists in a join
    twice = repeated.select("first.d", "first.rk")
    listed, out = may_hold(keyed, F.col("rk"), gone.select("rk").unionByName(twice.select("rk")), "rk")
    kept = listed.join(gone, ["d", "rk"], "left_anti")
    if not repeated.isEmpty():
        once = kept.join(twice, ["d", "rk"], "left_semi").dropDuplicates(["d", "rk"])
        kept = kept.join(twice, ["d", "rk"], "left_anti").unionByName(once)
    return out.select(COLUMNS).unionByName(kept.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item."""
    return decontaminate.keep_clean(docs.select(COLUMNS), load(spark, sf_dir, "benchmark"))


def surrogate_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in the texts."""
    return pii.replace_pii(docs.select(COLUMNS)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many times (copies); rows wholly the same get as many each."""
    return mixing.take_mix(docs.select(COLUMNS))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", surrogate_pii), ("mixing", mix)]
#: Toxicity and fingerprints can't be told in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, pin(stage(spark, docs, sf_dir))
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
