"""Queries of the remaining validation rules over the sample tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import effect_tables, validate
from evidra.sources import studies as S
from evidra.sources.shared import table

from .catalog import query
from .catalog_effects import _CELLS, _PAIRS, paired_rows

_COR = f"{S.PAIRED}, co AS (SELECT row_index, CASE WHEN row_index % 9 = 0 THEN NULL WHEN row_index % 7 = 0 THEN 1.2 ELSE r END AS r, CASE WHEN row_index % 5 = 0 THEN 3 WHEN row_index % 6 = 0 THEN n + 0.5 ELSE n END AS n FROM arms)"


@query("validate_correlation", f"WITH {_COR} SELECT row_index, 'V002' AS code, 'error' AS severity, '' AS detail FROM co WHERE r IS NULL UNION ALL SELECT row_index, 'V010', 'error', '' FROM co WHERE r <= -1 OR r >= 1 UNION ALL SELECT row_index, 'V004', 'error', '' FROM co WHERE r IS NOT NULL AND (n < 4 OR n <> floor(n))")
def validate_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_index")
    r = F.when(k % 9 == 0, None).when(k % 7 == 0, 1.2).otherwise(F.col("r"))
    n = F.when(k % 5 == 0, 3.0).when(k % 6 == 0, F.col("n") + 0.5).otherwise(F.col("n"))
    return validate.correlation_rows(S.paired(spark, sf_dir).select("row_index", r.alias("r"), n.alias("n")))


_SD = "CASE WHEN sd_diff IS NOT NULL THEN sd_diff WHEN sd1 IS NOT NULL AND sd2 IS NOT NULL AND r IS NOT NULL THEN CASE WHEN r BETWEEN -1 AND 1 AND sd1 * sd1 + sd2 * sd2 - 2 * r * sd1 * sd2 > 0 THEN sqrt(sd1 * sd1 + sd2 * sd2 - 2 * r * sd1 * sd2) END WHEN sum_sq_dev_d >= 0 THEN sqrt(sum_sq_dev_d / (n - 1)) END"


@query(
    "validate_paired",
    f"WITH {_PAIRS}, c AS (SELECT *, {_SD} AS sd, coalesce(sd_diff IS NULL AND sd1 IS NOT NULL AND sd2 IS NOT NULL AND (r < -1 OR r > 1), false) AS wr FROM pin) SELECT row_index, 'V002' AS code, 'error' AS severity, '' AS detail FROM c WHERE sd IS NULL AND NOT wr UNION ALL SELECT row_index, 'V010', 'error', '' FROM c WHERE wr UNION ALL SELECT row_index, 'V020', 'info', '' FROM c WHERE n < 10",
)
def validate_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.paired_rows(paired_rows(spark, sf_dir))


_GEN = f"{S.GENERIC}, {S.SUPPLIERS}, ge AS (SELECT st0.row_index, analysis_id, CASE WHEN st0.row_index % 11 = 0 THEN NULL ELSE yi END AS yi, CASE WHEN st0.row_index % 4 = 0 THEN NULL WHEN st0.row_index % 13 = 0 THEN 1e-80 ELSE vi END AS vi, CASE WHEN st0.row_index % 8 = 0 THEN -1.0 ELSE 0.5 END AS sei FROM st0 JOIN sr ON st0.row_index = sr.row_index WHERE st0.vi > 0)"


@query("validate_generic", f"WITH {_GEN} SELECT row_index, 'V002' AS code, 'error' AS severity, '' AS detail FROM ge WHERE yi IS NULL UNION ALL SELECT row_index, 'V005', 'error', '' FROM ge WHERE sei < 0 UNION ALL SELECT row_index, 'V030', 'error', '' FROM ge WHERE coalesce(vi, sei * sei) < 1e-70")
def validate_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_index")
    rows = S.generic(spark, sf_dir).join(S.supplier_regions(spark, sf_dir).select("row_index", "analysis_id"), "row_index")
    vi = F.when(k % 4 == 0, None).when(k % 13 == 0, 1e-80).otherwise(F.col("vi"))
    return validate.generic_rows(rows.select("row_index", "analysis_id", F.when(k % 11 != 0, F.col("yi")).alias("yi"), vi.alias("vi"), F.when(k % 8 == 0, -1.0).otherwise(0.5).alias("sei")))


_FLAG = "fl AS (SELECT s_suppkey AS row_index, CASE s_suppkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' ' WHEN 3 THEN 'maybe' END AS estimated, CASE s_nationkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'some concerns' WHEN 2 THEN 'low' ELSE '??x' END AS rob FROM supplier)"


@query("validate_flags", f"WITH {_FLAG} SELECT row_index, 'V018' AS code, 'info' AS severity, '' AS detail FROM fl WHERE estimated = 'Yes' UNION ALL SELECT row_index, 'V019', 'info', CASE rob WHEN 'High' THEN 'high' ELSE 'some' END FROM fl WHERE rob IN ('High', 'some concerns') UNION ALL SELECT row_index, 'V027', 'warning', '' FROM fl WHERE estimated = 'maybe' OR rob = '??x'")
def validate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey") % 5, F.col("s_nationkey") % 4
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("row_index"), F.when(k == 0, "Yes").when(k == 1, "no").when(k == 2, " ").when(k == 3, "maybe").alias("estimated"),
        F.when(n == 0, "High").when(n == 1, "some concerns").when(n == 2, "low").otherwise("??x").alias("rob"),
    )
    return validate.flag_rows(rows, {"high": "high", "some concerns": "some", "low": "low"}, ["yes", "y", "1"], ["no", "n", "0"])


@query("validate_labels", "SELECT s_suppkey AS row_index, 'V029' AS code, 'warning' AS severity, '' AS detail FROM supplier WHERE s_suppkey % 3 <> 1")
def validate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    return validate.label_rows(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_index"), F.when(k == 0, "  ").when(k == 1, F.col("s_name")).alias("label")))


_UNIT = f"{S.CONTINUOUS}, {S.SUPPLIERS}, un AS (SELECT arms.row_index, analysis_id, CASE WHEN arms.row_index % 17 = 0 THEN m1 * 100 ELSE m1 END AS m1, CASE WHEN arms.row_index % 17 = 0 THEN sd1 * 100 ELSE sd1 END AS sd1, CASE WHEN arms.row_index % 19 = 0 THEN m2 / 100 ELSE m2 END AS m2, CASE WHEN arms.row_index % 19 = 0 THEN sd2 / 100 ELSE sd2 END AS sd2 FROM arms JOIN sr ON arms.row_index = sr.row_index)"


@query(
    "unit_mismatch",
    f"WITH {_UNIT}, c AS (SELECT row_index, analysis_id, 'arm 1' AS detail, abs(m1) AS m, sd1 AS s FROM un UNION ALL SELECT row_index, analysis_id, 'arm 2', abs(m2), sd2 FROM un), t AS (SELECT analysis_id, median(m) AS mm, median(s) AS ms, count(*) / 2 AS k FROM c GROUP BY analysis_id) SELECT row_index, 'V012' AS code, 'warning' AS severity, detail FROM c JOIN t USING (analysis_id) WHERE k >= 3 AND ((m / mm >= 10 AND s / ms >= 3) OR (m / mm <= 0.1 AND s / ms <= 1.0 / 3))",
)
def unit_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_index")
    grown = lambda c, n, f: F.when(k % n == 0, F.col(c) * f).otherwise(F.col(c)).alias(c)
    rows = S.arms_continuous(spark, sf_dir).join(S.supplier_regions(spark, sf_dir).select("row_index", "analysis_id"), "row_index")
    return validate.unit_mismatch(rows.select("row_index", "analysis_id", grown("m1", 17, 100.0), grown("sd1", 17, 100.0), grown("m2", 19, 0.01), grown("sd2", 19, 0.01)))


_SHARED = f"{S.arms2x2_sql('l_partkey')}, sc AS (SELECT row_index, row_index // 4 AS study_id, e2, n2, row_index % 7 = 0 AS split, round(e2 / n2, 4) AS key FROM arms WHERE n2 > 0)"


@query("shared_control", f"WITH {_SHARED}, w AS (SELECT *, count(*) OVER (PARTITION BY study_id, key) AS n, bool_or(split) OVER (PARTITION BY study_id, key) AS sp FROM sc) SELECT row_index, 'V017' AS code, 'warning' AS severity, study_id::VARCHAR AS detail FROM w WHERE n > 1 AND NOT sp")
def shared_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.arms2x2(spark, sf_dir, "l_partkey").where("n2 > 0").withColumns({"study_id": F.expr("row_index div 4"), "control_split": F.col("row_index") % 7 == 0})
    return validate.shared_control(rows)


@query("excluded_rows", f"WITH {_CELLS} SELECT row_index, 'V022' AS code, 'warning' AS severity, CASE WHEN e1 IS NULL THEN 'missing value' ELSE 'no effect size' END AS detail FROM w WHERE e1 IS NULL OR n1 <= 0 OR n2 <= 0 OR (e1 = 0 AND e2 = 0) OR (e1 = n1 AND e2 = n2)")
def excluded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.arms2x2(spark, sf_dir, "l_partkey").withColumn("e1", F.when(F.col("row_index") % 50 == 0, None).otherwise(F.col("e1")))
    return validate.excluded_rows(effect_tables.compute(rows, "OR"))


_V = f"WITH {S.arms2x2_sql('l_partkey')}, v AS (SELECT row_index, 'V020' AS code, 'info' AS severity FROM arms WHERE least(n1, n2) < 10 UNION ALL SELECT row_index, 'V004', 'error' FROM arms WHERE n1 < 1 OR n2 < 1 UNION ALL SELECT row_index, 'V008', 'warning' FROM arms WHERE (e1 = 0 AND e2 = 0) OR (e1 = n1 AND e2 = n2) UNION ALL SELECT row_index, 'V009', 'info' FROM arms WHERE NOT ((e1 = 0 AND e2 = 0) OR (e1 = n1 AND e2 = n2)) AND (e1 = 0 OR e2 = 0 OR e1 = n1 OR e2 = n2))"


@query("validation_summary", _V + ' SELECT code, severity, count(*) AS n, count(DISTINCT row_index) AS rows, min(row_index) AS "first" FROM v GROUP BY ALL')
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(validate.binary_rows(S.arms2x2(spark, sf_dir, "l_partkey")))


@query("acknowledged_findings", _V + ", d AS (SELECT 'V020' AS code, l_partkey AS row_index, l_quantity > 10 AS active, l_orderkey * 10 + l_linenumber AS ts FROM lineitem), h AS (SELECT code, row_index FROM d QUALIFY row_number() OVER (PARTITION BY code, row_index ORDER BY ts DESC) = 1 AND active) SELECT v.row_index, v.code, h.code IS NOT NULL AS acknowledged FROM v LEFT JOIN h ON v.code = h.code AND v.row_index = h.row_index")
def acknowledged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = table(spark, sf_dir, "lineitem").select(F.lit("V020").alias("code"), F.col("l_partkey").alias("row_index"), (F.col("l_quantity") > 10).alias("active"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ts"))
    return validate.acknowledged(validate.binary_rows(S.arms2x2(spark, sf_dir, "l_partkey")), decisions).select("row_index", "code", "acknowledged")


@query("option_findings", "WITH o AS (SELECT o_orderkey AS run, CASE o_orderkey % 3 WHEN 0 THEN 'tau2' WHEN 1 THEN 'ci' ELSE 'colour' END AS name, CASE o_orderstatus WHEN 'F' THEN 'DL' WHEN 'O' THEN 'z' ELSE 'hksj' END AS value FROM orders) SELECT run, name, CASE WHEN name = 'colour' THEN 'unknown option' ELSE 'value not allowed' END AS problem FROM o WHERE name = 'colour' OR (name = 'tau2' AND value <> 'DL') OR (name = 'ci' AND value = 'DL')")
def option_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    options = table(spark, sf_dir, "orders").select(k.alias("run"), F.when(k % 3 == 0, "tau2").when(k % 3 == 1, "ci").otherwise("colour").alias("name"), F.when(s == "F", "DL").when(s == "O", "z").otherwise("hksj").alias("value"))
    return validate.option_findings(options, {"tau2": ["DL", "REML", "PM"], "ci": ["z", "t", "hksj"]})
