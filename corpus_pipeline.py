"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

All stages but the last return the columns of documents. Documents are whole rows throughout: a stage drops rows, or, in
the mix, repeats them; it changes no text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import decontaminate, minhash, mixing, quality, sharding
from evidra.llm.shared import new_folder, stored, table


def around(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs`` whose columns called like ``names``, which the stage adds of its own, are set aside until it is done."""
    aside = {c: f"__kept_{c}" for c in docs.columns if c in names}
    found = stage(docs.withColumnsRenamed(aside))
    return found.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels`` outside the held-out fold, does not reject (score >= 0.5). Null and
    empty texts have a score, too."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return around(docs, ("quality_score",), lambda d: quality.scored(d, model).where("quality_score >= 0.5"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the least id; where rows repeat its id and text, the one with the least
    other columns in their order. Rows with a null text all stay, for they are like no other; so do rows with a null id whose
    text has no other (one of each text)."""
    found = minhash.near_duplicates(docs)
    heads = found.where("node IS NOT NULL AND representative").select(F.col("id").alias("__id"), F.col("node").alias("__node")).distinct()
    own = docs.where("text IS NOT NULL").withColumn("__own", F.unhex(F.md5("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__node"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = own.join(heads, same, "left_semi").groupBy("doc_id", "__own").agg(F.any_value("text").alias("text"), F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__rest"))
    kept = least.select(*[F.col("__rest")[c].alias(c) if c in rest else F.col(c) for c in docs.columns])
    return kept.unionByName(docs.where("text IS NULL"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; a null text has none."""
    benchmark = table(spark, sf_dir, "benchmark")
    return around(docs, ("n_words", "n_hit", "items"), lambda d: decontaminate.find_passages(d, benchmark).where("n_hit = 0"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard of the compacted store that holds them."""
    return sharding.sharded(docs, new_folder(spark, "shards"))


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: A learned classifier and sampled signatures are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
