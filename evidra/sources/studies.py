"""Study tables derived from the sample tables: one row per study (a supplier or a part), and the same in SQL.

``analysis_id`` is the region of the study's supplier (or the part's brand), ``row_index`` the study's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table


def _n(condition: Column) -> Column:
    return F.sum(F.when(condition, 1.0).otherwise(0.0))


def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_index, analysis_id, label, moderator): each supplier with its region, name and account balance."""
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select(F.col("s_suppkey").alias("row_index"), F.col("n_regionkey").alias("analysis_id"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("moderator"), F.col("n_name").alias("subgroup"))


def arms2x2(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """(row_index, e1, n1, e2, n2): returned lines among those with and without a discount of at least 0.05."""
    one, event = F.col("l_discount") >= 0.05, F.col("l_returnflag") == "R"
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col(key).alias("row_index")).agg(_n(one & event).alias("e1"), _n(one).alias("n1"), _n(~one & event).alias("e2"), _n(~one).alias("n2"))


def arms_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_index, m1, sd1, n1, m2, sd2, n2) of the quantity by arm, suppliers with two lines in either arm."""
    one = F.col("l_discount") >= 0.05
    a, b = F.when(one, F.col("l_quantity")), F.when(~one, F.col("l_quantity"))
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row_index")).agg(
        F.avg(a).alias("m1"), F.stddev_samp(a).alias("sd1"), F.count(a).cast("double").alias("n1"), F.avg(b).alias("m2"), F.stddev_samp(b).alias("sd2"), F.count(b).cast("double").alias("n2")
    )
    return made.where("n1 >= 2 AND n2 >= 2")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_index, m1, m2, sd1, sd2, r, n): quantity and price in thousands of the same lines."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice") / 1000.0
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row_index")).agg(
        F.avg(q).alias("m1"), F.avg(p).alias("m2"), F.stddev_samp(q).alias("sd1"), F.stddev_samp(p).alias("sd2"), F.corr(q, p).alias("r"), F.count(F.lit(1)).cast("double").alias("n")
    )
    return made.where("n >= 4")


def generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_index, yi, vi): mean discount and its squared standard error."""
    d = F.col("l_discount")
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row_index")).agg(F.avg(d).alias("yi"), (F.var_samp(d) / F.count(d)).alias("vi"))
    return made.where("vi > 0")


SUPPLIERS = "sr AS (SELECT s_suppkey AS row_index, n_regionkey AS analysis_id, s_name AS label, s_acctbal AS moderator, n_name AS subgroup FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def arms2x2_sql(key: str = "l_suppkey") -> str:
    one, event = "l_discount >= 0.05", "l_returnflag = 'R'"
    return f"arms AS (SELECT {key} AS row_index, (count(*) FILTER ({one} AND {event}))::DOUBLE AS e1, (count(*) FILTER ({one}))::DOUBLE AS n1, (count(*) FILTER (NOT ({one}) AND {event}))::DOUBLE AS e2, (count(*) FILTER (NOT ({one})))::DOUBLE AS n2 FROM lineitem GROUP BY {key})"


CONTINUOUS = "arms AS (SELECT l_suppkey AS row_index, avg(l_quantity) FILTER (l_discount >= 0.05) AS m1, stddev_samp(l_quantity) FILTER (l_discount >= 0.05) AS sd1, (count(*) FILTER (l_discount >= 0.05))::DOUBLE AS n1, avg(l_quantity) FILTER (l_discount < 0.05) AS m2, stddev_samp(l_quantity) FILTER (l_discount < 0.05) AS sd2, (count(*) FILTER (l_discount < 0.05))::DOUBLE AS n2 FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_discount >= 0.05) >= 2 AND count(*) FILTER (l_discount < 0.05) >= 2)"
PAIRED = "arms AS (SELECT l_suppkey AS row_index, avg(l_quantity) AS m1, avg(l_extendedprice / 1000.0) AS m2, stddev_samp(l_quantity) AS sd1, stddev_samp(l_extendedprice / 1000.0) AS sd2, corr(l_quantity, l_extendedprice / 1000.0) AS r, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 4)"
GENERIC = "st0 AS (SELECT l_suppkey AS row_index, avg(l_discount) AS yi, var_samp(l_discount) / count(*) AS vi FROM lineitem GROUP BY l_suppkey)"
