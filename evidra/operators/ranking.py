"""Orders, versions and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_places(rows: DataFrame, label: str, key: str) -> DataFrame:
    """(key, place): labels ordered with digit runs as numbers (the text before, and the first and last run), missing last."""
    x = F.col(label)
    number = lambda p, k: F.nullif(F.regexp_extract(x, p, k), F.lit("")).try_cast("long")
    ranked = rows.select(key, F.regexp_extract(x, r"^(\D*)", 1).alias("head"), number(r"(\d+)", 1).alias("first"), number(r"-(\d+)$", 1).alias("last"))
    order = [F.asc_nulls_last("head"), F.asc_nulls_last("first"), F.asc_nulls_last("last"), F.asc(key)]
    return global_places(ranked, order).select(key, "place")


def global_places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in ``order``: counted in ranges of that order, so that no task gets all rows."""
    from evidra.sources.shared import stored

    dealt = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(offsets, "__part").withColumn("place", F.col("__offset") + F.col("__own")).drop("__part", "__own", "__offset")


def review_score(title: Column, text: Column, terms: list[str], year: Column, size: Column, today: int) -> Column:
    """Relevance (title 1, text one half, for each term, twice weighted), recency over 15 years and size, each from 0 to 1."""
    hits = None
    for term in terms:
        one = F.when(F.lower(title).contains(term), 1.0).when(F.lower(text).contains(term), 0.5).otherwise(0.0)
        hits = one if hits is None else hits + one
    recency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (today - year) / 15.0))
    return 2.0 * hits / len(terms) + recency + F.least(F.lit(1.0), F.log1p(size) / F.log(F.lit(51.0)))


def superseded(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``superseded``: whether a later row of the key exists."""
    return rows.withColumn("superseded", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])) > 1)


def opposite_share(rows: DataFrame) -> DataFrame:
    """(analysis_id, opposite, advice): percent of weight with a significant effect against the pooled one; serious from 10."""
    se = 1.959963984540054 * F.sqrt("vi")
    own = F.when(F.col("yi") - se > 0, 1).when(F.col("yi") + se < 0, -1).otherwise(0)
    against = (own != 0) & (own == -F.signum("estimate"))
    m = rows.groupBy("analysis_id").agg((100.0 * F.sum(F.when(against, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("opposite"))
    return m.withColumn("advice", F.when(F.col("opposite") >= 10, "serious").otherwise("not serious"))


def three_way(base: Column, theirs: Column, mine: Column) -> Column:
    same = lambda a, b: a.eqNullSafe(b)
    return F.when(same(theirs, mine) & same(mine, base), "same").when(same(theirs, mine), "both alike").when(same(theirs, base), "mine").when(same(mine, base), "theirs").otherwise("conflict")


def stale(runs: DataFrame, current: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, code): X001 where the latest run's digest is not the current one."""
    latest = superseded(runs, [key], order).where("NOT superseded").select(key, F.col("sha").alias("run_sha"))
    return latest.join(current, key).where(F.col("run_sha") != F.col("sha")).select(key, F.lit("X001").alias("code"))


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(found): nodes a that share a target b with a seed and are none."""
    reached = edges.join(seeds, "a", "left_semi").select("b").distinct()
    return edges.join(reached, "b", "left_semi").select("a").distinct().join(seeds, "a", "left_anti").withColumnRenamed("a", "found")
