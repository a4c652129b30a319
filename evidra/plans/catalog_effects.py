"""Queries of exact small-sample factors, variance conventions, paired inputs, conversions and labels, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import effects as E
from evidra.functions import parse as P
from evidra.functions import special as X
from evidra.operators import effect_tables, regression
from evidra.sources import studies as S
from evidra.sources.shared import table

from .catalog import C, cols, query, r, rounded
from .catalog_more import _Q, _quantiles

_SP = "sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2))"
_JX = "exp(lgamma({m} / 2) - 0.5 * ln({m} / 2) - lgamma(({m} - 1) / 2))"

# Standardised differences ---------------------------------------------------------------------------------------------


@query(
    "es_smd_exact",
    f"WITH {S.CONTINUOUS}, d AS (SELECT *, (m1 - m2) / nullif({_SP}, 0) AS d, {_JX.format(m='(n1 + n2 - 2)')} AS j, n1 + n2 AS n, n1 + n2 - 2 AS m FROM arms), g AS (SELECT *, j * d AS g, (1 - 3 / (4 * m - 1)) * d AS h FROM d) SELECT row_index, "
    + r(d="d", g="g", v_ls="1 / n1 + 1 / n2 + g * g / (2 * n)", v_ls2="j * j * (n / (n1 * n2) + d * d / (2 * n))", v_ub="1 / n1 + 1 / n2 + (1 - (m - 2) / (m * j * j)) * g * g", v_cohen="n / (n1 * n2) + d * d / (2 * (n - 2))", g_metan="h", v_metan="CASE WHEN n > 3.94 THEN n / (n1 * n2) + h * h / (2 * (n - 3.94)) END")
    + " FROM g",
)
def es_smd_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {f"v_{t.lower()}": E.smd(*cols(*C), vtype=t)[1] for t in ("LS", "LS2", "UB")}
    d, v_cohen = E.smd(*cols(*C), vtype="METAN_COHEN", correct=False)
    g_metan, v_metan = E.smd(*cols(*C), vtype="METAN_HEDGES")
    made = {"d": d, "g": E.smd(*cols(*C))[0], **own, "v_cohen": v_cohen, "g_metan": g_metan, "v_metan": v_metan}
    return rounded(S.arms_continuous(spark, sf_dir).select("row_index", *[v.alias(k) for k, v in made.items()]))


@query(
    "es_glass_variants",
    f"WITH {S.CONTINUOUS}, d AS (SELECT *, (m1 - m2) / nullif(sd2, 0) AS delta, CASE WHEN n2 > 2 THEN {_JX.format(m='(n2 - 1)')} END AS c FROM arms), g AS (SELECT *, c * delta AS y FROM d) SELECT row_index, "
    + r(delta="delta", v_metan="(n1 + n2) / (n1 * n2) + delta * delta / (2 * (n2 - 1))", y="y", v_ls="1 / n1 + 1 / n2 + y * y / (2 * n2)", v_ls2="c * c * (1 / n1 + 1 / n2 + delta * delta / (2 * n2))", v_ub="1 / n1 + 1 / n2 + (1 - (n2 - 3) / ((n2 - 1) * c * c)) * y * y", v_smd1h="sd1 * sd1 / nullif(sd2 * sd2, 0) / n1 + 1 / n2 + y * y / (2 * n2)")
    + " FROM g",
)
def es_glass_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta, v = E.glass(*cols(*C))
    made = {"delta": delta, "v_metan": v, "y": E.glass(*cols(*C), vtype="LS")[0]} | {f"v_{t.lower()}": E.glass(*cols(*C), vtype=t)[1] for t in ("LS", "LS2", "UB", "SMD1H")}
    return rounded(S.arms_continuous(spark, sf_dir).select("row_index", *[v.alias(k) for k, v in made.items()]))


@query(
    "es_smcc_exact",
    f"WITH {S.PAIRED}, d AS (SELECT *, m1 - m2 AS mc, sqrt(sd1 * sd1 + sd2 * sd2 - 2 * r * sd1 * sd2) AS sdd, {_JX.format(m='(n - 1)')} AS j FROM arms), g AS (SELECT *, mc / nullif(sdd, 0) AS d FROM d) SELECT row_index, "
    + r(mc="CASE WHEN sdd > 0 THEN mc END", v_mc="CASE WHEN sdd > 0 THEN sdd * sdd / n END", y="j * d", v_ls="1 / n + j * d * j * d / (2 * n)", v_ls2="j * j * (1 / n + d * d / (2 * n))") + " FROM g",
)
def es_smcc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.paired(spark, sf_dir).withColumns({"mdiff": F.col("m1") - F.col("m2"), "sdd": E.sd_diff(*cols("sd1", "sd2", "r"))})
    (mc, v_mc), (y, v_ls), (_, v_ls2) = E.mean_change(*cols("mdiff", "sdd", "n")), E.smcc(*cols("mdiff", "sdd", "n")), E.smcc(*cols("mdiff", "sdd", "n"), vtype="LS2")
    return rounded(d.select("row_index", mc.alias("mc"), v_mc.alias("v_mc"), y.alias("y"), v_ls.alias("v_ls"), v_ls2.alias("v_ls2")))


_PAIRS = (
    f"{S.PAIRED}, pin AS (SELECT row_index, n, CASE WHEN row_index % 2 = 0 THEN m1 END AS m1, m2, CASE WHEN row_index % 3 = 0 THEN m1 - m2 END AS mdiff, (m1 - m2) * n AS sum_d, CASE WHEN row_index % 5 = 0 THEN sd1 END AS sd_diff, "
    "CASE WHEN row_index % 7 = 0 THEN NULL ELSE sd1 END AS sd1, sd2, CASE WHEN row_index % 11 = 0 THEN 1.5 ELSE r END AS r, CASE WHEN row_index % 13 = 0 THEN NULL ELSE sd1 * n END AS sum_sq_dev_d FROM arms)"
)


def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired summaries of which some lack the means, the SDs, the correlation, or have an impossible one."""
    k = F.col("row_index")
    only = lambda n, c: F.when(k % n == 0, F.col(c))
    return S.paired(spark, sf_dir).select(
        "row_index", "n", only(2, "m1").alias("m1"), "m2", F.when(k % 3 == 0, F.col("m1") - F.col("m2")).alias("mdiff"), ((F.col("m1") - F.col("m2")) * F.col("n")).alias("sum_d"), only(5, "sd1").alias("sd_diff"),
        F.when(k % 7 != 0, F.col("sd1")).alias("sd1"), "sd2", F.when(k % 11 == 0, 1.5).otherwise(F.col("r")).alias("r"), F.when(k % 13 != 0, F.col("sd1") * F.col("n")).alias("sum_sq_dev_d"),
    )


@query(
    "paired_inputs",
    f"WITH {_PAIRS} SELECT row_index, "
    + r(mean="coalesce(m1 - m2, mdiff, sum_d / n)", sd="CASE WHEN sd_diff IS NOT NULL THEN sd_diff WHEN sd1 IS NOT NULL AND sd2 IS NOT NULL AND r IS NOT NULL THEN CASE WHEN r BETWEEN -1 AND 1 AND sd1 * sd1 + sd2 * sd2 - 2 * r * sd1 * sd2 > 0 THEN sqrt(sd1 * sd1 + sd2 * sd2 - 2 * r * sd1 * sd2) END WHEN sum_sq_dev_d >= 0 THEN sqrt(sum_sq_dev_d / (n - 1)) END")
    + " FROM pin",
)
def paired_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paired_rows(spark, sf_dir)
    mean, sd = E.paired_inputs({c: F.col(c) for c in rows.columns})
    return rounded(rows.select("row_index", mean.alias("mean"), sd.alias("sd")))


# Dispatch -------------------------------------------------------------------------------------------------------------

_CELLS = f"{S.arms2x2_sql('l_partkey')}, z AS (SELECT row_index, CASE WHEN row_index % 50 = 0 THEN NULL ELSE e1 END AS e1, n1, e2, n2 FROM arms), y AS (SELECT *, CASE WHEN e1 = 0 OR e1 = n1 OR e2 = 0 OR e2 = n2 THEN 0.5 ELSE 0.0 END AS cc FROM z), w AS (SELECT *, e1 + cc AS a, n1 - e1 + cc AS b, e2 + cc AS c, n2 - e2 + cc AS d FROM y)"


@query(
    "es_compute",
    f"WITH {_CELLS}, o AS (SELECT *, CASE WHEN e1 IS NULL OR e2 IS NULL OR n1 IS NULL OR n2 IS NULL THEN 'missing value' WHEN n1 <= 0 OR n2 <= 0 OR ((e1 = 0 AND e2 = 0) OR (e1 = n1 AND e2 = n2)) THEN 'no effect size' END AS excluded FROM w) "
    "SELECT row_index, '#' || row_index AS label, excluded, " + r(yi="CASE WHEN excluded IS NULL THEN ln(a * d / (b * c)) END", vi="CASE WHEN excluded IS NULL THEN 1 / a + 1 / b + 1 / c + 1 / d END") + " FROM o",
)
def es_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.arms2x2(spark, sf_dir, "l_partkey").withColumn("e1", F.when(F.col("row_index") % 50 == 0, None).otherwise(F.col("e1"))).withColumn("study", F.lit("  "))
    return rounded(effect_tables.compute(rows, "OR").select("row_index", "label", "excluded", "yi", "vi"))


@query(
    "pft_back",
    f"WITH {S.arms2x2_sql('l_partkey')}, p AS (SELECT row_index, e1 + e2 AS x, n1 + n2 AS n FROM arms), t AS (SELECT *, 0.5 * (asin(sqrt(x / (n + 1))) + asin(sqrt((x + 1) / (n + 1)))) AS t FROM p), s AS (SELECT *, sin(2 * t) AS s, cos(2 * t) AS c FROM t) SELECT row_index, "
    + r(back=f"CASE WHEN t <= 0.5 * asin(sqrt(1 / (n + 1))) THEN 0 WHEN t >= 0.5 * (asin(sqrt(n / (n + 1))) + {math.pi / 2!r}) THEN 1 ELSE 0.5 * (1 - sign(c) * sqrt(greatest(0, 1 - (s + (s - 1 / s) / n) * (s + (s - 1 / s) / n)))) END") + " FROM s",
)
def pft_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.arms2x2(spark, sf_dir, "l_partkey").select("row_index", (F.col("e1") + F.col("e2")).alias("x"), (F.col("n1") + F.col("n2")).alias("n"))
    return rounded(rows.select("row_index", E.back_transform("PFT", E.proportion("PFT", *cols("x", "n"))[0], F.col("n")).alias("back")))


# Conversions ----------------------------------------------------------------------------------------------------------


@query(
    "conversions_more",
    f"WITH {S.CONTINUOUS}, c AS (SELECT *, m1 - m2 AS md, sqrt(sd1 * sd1 / n1 + sd2 * sd2 / n2) AS se, (n1 + n2) * (n1 + n2) / (n1 * n2) AS a FROM arms), t AS (SELECT *, md / nullif(se, 0) AS t, md / nullif({_SP}, 0) AS d FROM c) SELECT row_index, "
    + r(d_from_t="t * sqrt(1 / n1 + 1 / n2)", sd_from_t="abs(md / nullif(t, 0)) / sqrt(1 / n1 + 1 / n2)", log_or=f"d * {math.pi / math.sqrt(3)!r}", v_log_or=f"se * se * {math.pi**2 / 3!r}", r="d / sqrt(d * d + a)", v_r="a * a * se * se / pow(d * d + a, 3)", mean_d="sd1 / n1", sd_d="sqrt(sd2 / (n1 - 1))",
        corr="CASE WHEN (sd1 * sd1 + sd2 * sd2 - md * md) / nullif(2 * sd1 * sd2, 0) BETWEEN -1 AND 1 THEN (sd1 * sd1 + sd2 * sd2 - md * md) / nullif(2 * sd1 * sd2, 0) END")
    + " FROM t",
)
def conversions_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.arms_continuous(spark, sf_dir).withColumns({"md": F.col("m1") - F.col("m2"), "se": F.sqrt(F.expr("sd1 * sd1 / n1 + sd2 * sd2 / n2"))})
    c = c.withColumns({"t": F.expr("md / nullif(se, 0)"), "d": E.smd(*cols(*C), correct=False)[0], "v": F.col("se") * F.col("se")})
    (log_or, v_log_or), (corr, v_corr), (mean_d, sd_d) = E.d_to_logor(*cols("d", "v")), E.d_to_r(*cols("d", "v", "n1", "n2")), E.paired_from_sums(*cols("n1", "sd1", "sd2"))
    made = {
        "d_from_t": E.d_from_t(*cols("t", "n1", "n2")), "sd_from_t": E.sd_diff_from_t(*cols("t", "n1", "n2", "md")), "log_or": log_or, "v_log_or": v_log_or, "r": corr, "v_r": v_corr,
        "mean_d": mean_d, "sd_d": sd_d, "corr": E.corr_from_change(*cols("sd1", "sd2", "md")),
    }
    return rounded(c.select("row_index", *[v.alias(k) for k, v in made.items()]))


@query("sd_from_median", f"WITH {_Q} SELECT row_index, " + r(from_range=f"(hi - lo) / (2 * {X.norm_ppf('((n - 0.375e0) / (n + 0.25e0))')})", from_quartiles=f"(q3 - q1) / (2 * {X.norm_ppf('((0.75e0 * n - 0.125e0) / (n + 0.25e0))')})") + " FROM q WHERE n >= 2")
def sd_from_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.sds_from_medians(_quantiles(spark, sf_dir)))


@query("se_from_p", f"WITH {S.GENERIC}, p AS (SELECT row_index, yi, 0.001 + (row_index % 97) / 100.0 AS p, CASE WHEN yi > 0 THEN ln(yi) END AS l FROM st0 WHERE vi > 0) SELECT row_index, " + r(se=f"abs(yi) / {X.norm_ppf('(1e0 - p::DOUBLE / 2e0)')}", se_log=f"abs(l) / {X.norm_ppf('(1e0 - p::DOUBLE / 2e0)')}") + " FROM p")
def se_from_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.generic(spark, sf_dir).select("row_index", "yi", (0.001 + (F.col("row_index") % 97) / 100.0).alias("p")).withColumn("l", E.log(F.col("yi")))
    critical = F.expr(X.norm_ppf("(1e0 - p / 2e0)"))
    return rounded(rows.select("row_index", (F.abs("yi") / critical).alias("se"), (F.abs("l") / critical).alias("se_log")))


# Labels and levels ----------------------------------------------------------------------------------------------------


@query("study_id_labels", "WITH s AS (SELECT s_suppkey AS row_index, 'N' || s_nationkey AS study_id, s_nationkey % 3 = 0 AS gap FROM supplier), n AS (SELECT *, count(*) OVER (PARTITION BY study_id) AS c, row_number() OVER (PARTITION BY study_id ORDER BY row_index) AS k FROM s) SELECT row_index, CASE WHEN gap THEN '#' || row_index WHEN c > 1 THEN study_id || ' (' || k || ')' ELSE study_id END AS label FROM n")
def study_id_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_index"), F.when(n % 3 != 0, F.concat(F.lit("N"), n)).alias("study_id"))
    return effect_tables.labels_from_ids(rows)


@query(
    "level_texts",
    "SELECT c_custkey, CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END AS level, CASE WHEN lv > 1 THEN round(lv / 100, 6) ELSE round(lv, 6) END AS conf, CASE WHEN se = 0 AND x = 0 THEN 'nan' WHEN se = 0 AND x > 0 THEN 'inf' WHEN se = 0 THEN '-inf' ELSE 'finite' END AS ratio "
    "FROM (SELECT c_custkey, (c_nationkey / 2.0)::DOUBLE AS x, (CASE WHEN c_custkey % 2 = 0 THEN 95 ELSE 0.9 END)::DOUBLE AS lv, (c_custkey % 3)::DOUBLE AS se FROM customer)",
)
def level_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, (F.col("c_nationkey") / 2.0).alias("x"), F.when(k % 2 == 0, 95.0).otherwise(0.9).alias("lv"), (k % 3).cast("double").alias("se"))
    ratio = E.ratio_stat(F.col("x"), F.col("se"))
    kind = F.when(F.isnan(ratio), "nan").when(ratio == float("inf"), "inf").when(ratio == float("-inf"), "-inf").otherwise("finite")
    return rows.select("c_custkey", effect_tables.level_text(F.col("x")).alias("level"), F.round(E.normal_level(F.col("lv")), 6).alias("conf"), kind.alias("ratio"))


@query("common_decimals", f"WITH {S.GENERIC}, m AS (SELECT row_index, greatest(abs(yi), abs(sqrt(vi))) AS top FROM st0 WHERE vi > 0), d AS (SELECT row_index, least(6, greatest(2, 1 - floor(log10(nullif(top, 0)))))::INT AS decimals FROM m) SELECT row_index, coalesce(decimals, 2) AS decimals FROM d")
def common_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.generic(spark, sf_dir).select("row_index", E.common_decimals([F.col("yi"), F.sqrt("vi")]).alias("decimals"))


@query(
    "row_uid",
    "WITH t AS (SELECT s_suppkey AS row_index, s_name || '|' || s_suppkey AS t FROM supplier), x AS (SELECT *, ('0x' || substr(sha1(t), 1, 8))::BIGINT >> 2 AS x FROM t), "
    "u AS (SELECT *, 'r' || " + " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz234567', ((x >> {5 * (5 - k)}) & 31)::INT + 1, 1)" for k in range(6)) + " AS row_uid FROM x), n AS (SELECT *, count(*) OVER (PARTITION BY row_uid) AS c FROM u) SELECT row_index, row_uid FROM n WHERE c = 1",
)
def row_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uids that no two rows meet in; those that do are in the tests."""
    rows = P.row_uids(S.supplier_regions(spark, sf_dir), "label", "row_index")
    return rows.where("NOT met").select("row_index", "row_uid")


# Power ----------------------------------------------------------------------------------------------------------------

_GRID = "g AS (SELECT p_partkey, (2 + p_size % 40)::DOUBLE AS k, 0.05::DOUBLE * (1 + p_partkey % 19) AS effect, (10 + p_size)::DOUBLE AS n1, (10 + p_partkey % 50)::DOUBLE AS n2 FROM part), v AS (SELECT *, ((n1 + n2) / (n1 * n2) + effect * effect / (2 * (n1 + n2))) AS v FROM g)"


def _power_sql(factor: str) -> str:
    return f"{X.norm_cdf(f'(effect / sqrt({factor} * v / k) - 1.959963984540054e0)')} + {X.norm_cdf(f'(-effect / sqrt({factor} * v / k) - 1.959963984540054e0)')}"


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, k, effect, n1, n2): a planned synthesis for each part."""
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (2 + size % 40).cast("long").alias("k"), (0.05 * (1 + key % 19)).alias("effect"), (10 + size).cast("double").alias("n1"), (10 + key % 50).cast("double").alias("n2"))


@query("power_grid", f"WITH {_GRID} SELECT p_partkey, k::BIGINT AS k, round(effect, 6) + 0.0 AS effect, n1, n2, " + r(fixed=_power_sql("1.0e0"), low=_power_sql("1.33e0"), moderate=_power_sql("1.67e0"), high=_power_sql("2.0e0")) + " FROM v")
def power_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regression.power(designs(spark, sf_dir)))


@query(
    "studies_needed",
    f"WITH {_GRID.rpartition(', v AS')[0]}, t AS (SELECT p_partkey, effect, unnest(range(1, 4097))::DOUBLE AS k, n1, n2 FROM g), v AS (SELECT *, ((n1 + n2) / (n1 * n2) + effect * effect / (2 * (n1 + n2))) AS v FROM t) SELECT p_partkey, round(effect, 6) + 0.0 AS effect, min(k) FILTER ({_power_sql('1.67e0')} >= 0.8)::BIGINT AS k FROM v GROUP BY ALL",
)
def studies_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regression.studies_needed(designs(spark, sf_dir).drop("k"), "moderate", most=4096).select("p_partkey", "effect", "k"))


@query("typical_sd", f"WITH {S.CONTINUOUS}, {S.SUPPLIERS}, t AS (SELECT analysis_id, n1 + n2 - 2 AS w, (sd1 * sd1 / n1 + sd2 * sd2 / n2) / (1 / n1 + 1 / n2) AS s2 FROM arms JOIN sr ON arms.row_index = sr.row_index) SELECT analysis_id, " + r(sd="sqrt(sum(w * s2) / sum(w))") + " FROM t GROUP BY analysis_id")
def typical_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.arms_continuous(spark, sf_dir).join(S.supplier_regions(spark, sf_dir).select("row_index", "analysis_id"), "row_index")
    return rounded(effect_tables.typical_sd(rows.withColumn("vi", E.md(*cols(*C))[1])))


@query("recommended_tests", f"WITH {S.arms2x2_sql()}, m AS (SELECT row_index, CASE row_index % 5 WHEN 0 THEN 'OR' WHEN 1 THEN 'SMD' WHEN 2 THEN 'PLO' WHEN 3 THEN 'MD' ELSE 'RD' END AS measure, e1::INT AS k FROM arms) SELECT row_index, measure, CASE WHEN measure = 'PLO' THEN '' WHEN measure IN ('OR', 'RD') THEN 'harbord,peters' ELSE 'egger' END AS tests, CASE WHEN k < 3 THEN 'not run' WHEN k < 10 THEN 'few studies' ELSE 'run' END AS gate FROM m")
def recommended_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_index") % 5
    measure = F.when(k == 0, "OR").when(k == 1, "SMD").when(k == 2, "PLO").when(k == 3, "MD").otherwise("RD")
    rows = S.arms2x2(spark, sf_dir).select("row_index", measure.alias("measure"), F.col("e1").cast("int").alias("k"))
    return rows.select("row_index", "measure", effect_tables.recommended_tests(F.col("measure")).alias("tests"), effect_tables.bias_gate(F.col("k")).alias("gate"))

