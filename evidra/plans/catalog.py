"""Queries of the statistical core over the sample tables, each with its SQL for an independent engine.

Numbers are rounded to six digits on both sides; -0.0 is made 0.0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import effects as E
from evidra.operators import bias, pooling
from evidra.sources import studies as S
from evidra.sources.shared import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, other columns as they are."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(**columns: str) -> str:
    """SQL of rounded columns."""
    return ", ".join(f"round({x}, 6) + 0.0 AS {c}" for c, x in columns.items())


C = ("m1", "sd1", "n1", "m2", "sd2", "n2")
B = ("e1", "n1", "e2", "n2")


def cols(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


# Effect sizes -----------------------------------------------------------------------------------------------------------

_SP = "sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2))"
_J = "(1 - 3.0 / (4.0 * (n1 + n2 - 2) - 1))"


@query("es_md", f"WITH {S.CONTINUOUS} SELECT row_index, " + r(md="m1 - m2", v_unequal="sd1 * sd1 / n1 + sd2 * sd2 / n2", v_pooled=f"{_SP} * {_SP} * (1 / n1 + 1 / n2)") + " FROM arms")
def es_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, v = E.md(*cols(*C))
    return rounded(S.arms_continuous(spark, sf_dir).select("row_index", y.alias("md"), v.alias("v_unequal"), E.md(*cols(*C), pooled=True)[1].alias("v_pooled")))


@query(
    "es_smd_variants",
    f"WITH {S.CONTINUOUS}, d AS (SELECT *, (m1 - m2) / {_SP} AS d, {_J} AS j, n1 + n2 AS n, n1 + n2 - 2 AS m FROM arms), g AS (SELECT *, j * d AS g FROM d) SELECT row_index, "
    + r(g="g", v_ls="1 / n1 + 1 / n2 + g * g / (2 * n)", v_ls2="j * j * (n / (n1 * n2) + d * d / (2 * n))", v_ub="1 / n1 + 1 / n2 + (1 - (m - 2) / (m * j * j)) * g * g") + " FROM g",
)
def es_smd_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {f"v_{t.lower()}": E.smd(*cols(*C), vtype=t, j_method="approx")[1] for t in ("LS", "LS2", "UB")}
    return rounded(S.arms_continuous(spark, sf_dir).select("row_index", E.smd(*cols(*C), j_method="approx")[0].alias("g"), *[v.alias(k) for k, v in own.items()]))


@query("es_glass", f"WITH {S.CONTINUOUS}, d AS (SELECT *, (m1 - m2) / nullif(sd2, 0) AS y FROM arms) SELECT row_index, " + r(y="y", v="(n1 + n2) / (n1 * n2) + y * y / (2 * (n2 - 1))") + " FROM d")
def es_glass(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, v = E.glass(*cols(*C))
    return rounded(S.arms_continuous(spark, sf_dir).select("row_index", y.alias("y"), v.alias("v")))


@query("es_rom", f"WITH {S.CONTINUOUS} SELECT row_index, " + r(y="ln(m1 / m2)", v="sd1 * sd1 / (n1 * m1 * m1) + sd2 * sd2 / (n2 * m2 * m2)", ratio="exp(ln(m1 / m2))") + " FROM arms WHERE m1 > 0 AND m2 > 0")
def es_rom(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, v = E.rom(*cols(*C))
    return rounded(S.arms_continuous(spark, sf_dir).where("m1 > 0 AND m2 > 0").select("row_index", y.alias("y"), v.alias("v"), E.back_transform("ROM", y).alias("ratio")))


@query(
    "es_smcc",
    f"WITH {S.PAIRED}, d AS (SELECT *, m1 - m2 AS mc, sqrt(sd1 * sd1 + sd2 * sd2 - 2 * r * sd1 * sd2) AS sdd FROM arms), g AS (SELECT *, (1 - 3.0 / (4 * (n - 1) - 1)) * mc / nullif(sdd, 0) AS y FROM d) SELECT row_index, "
    + r(mc="mc", v_mc="sdd * sdd / n", smcc="y", v_smcc="1 / n + y * y / (2 * n)") + " FROM g",
)
def es_smcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.paired(spark, sf_dir).withColumns({"mc": F.col("m1") - F.col("m2"), "sdd": E.sd_diff(*cols("sd1", "sd2", "r"))})
    y, v = E.smcc(*cols("mc", "sdd", "n"), j_method="approx")
    return rounded(d.select("row_index", "mc", (F.col("sdd") * F.col("sdd") / F.col("n")).alias("v_mc"), y.alias("smcc"), v.alias("v_smcc")))


_CC = "b4 AS (SELECT *, CASE WHEN e1 = 0 OR e1 = n1 OR e2 = 0 OR e2 = n2 THEN 0.5 ELSE 0.0 END AS cc, (e1 = 0 AND e2 = 0) OR (e1 = n1 AND e2 = n2) AS dz FROM arms), t AS (SELECT *, e1 + cc AS a, n1 - e1 + cc AS b, e2 + cc AS c, n2 - e2 + cc AS d, e1 / n1 * (1 - e1 / n1) / n1 + e2 / n2 * (1 - e2 / n2) / n2 AS vp FROM b4)"
_BINARY = "SELECT row_index, " + r(
    log_or="CASE WHEN NOT dz THEN ln(a * d / (b * c)) END", v_or="CASE WHEN NOT dz THEN 1 / a + 1 / b + 1 / c + 1 / d END", log_rr="CASE WHEN NOT dz THEN ln(a / (a + b) / (c / (c + d))) END", v_rr="CASE WHEN NOT dz THEN 1 / a - 1 / (a + b) + 1 / c - 1 / (c + d) END",
    rd="e1 / n1 - e2 / n2", v_rd="CASE WHEN vp > 0 THEN vp ELSE a / (a + b) * (1 - a / (a + b)) / (a + b) + c / (c + d) * (1 - c / (c + d)) / (c + d) END",
) + " FROM t"


def _binary(arms: DataFrame) -> DataFrame:
    made = []
    for measure, y_name, v_name in (("OR", "log_or", "v_or"), ("RR", "log_rr", "v_rr"), ("RD", "rd", "v_rd")):
        y, v = E.two_by_two(measure, *cols(*B))
        made += [y.alias(y_name), v.alias(v_name)]
    return rounded(arms.select("row_index", *made))


@query("es_or_rr_rd", f"WITH {S.arms2x2_sql()}, {_CC} {_BINARY}")
def es_or_rr_rd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary(S.arms2x2(spark, sf_dir))


@query("es_sparse_cc", f"WITH {S.arms2x2_sql('l_partkey')}, {_CC} {_BINARY} WHERE n1 > 0 AND n2 > 0")
def es_sparse_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary(S.arms2x2(spark, sf_dir, "l_partkey").where("n1 > 0 AND n2 > 0"))


@query(
    "es_prop",
    f"WITH {S.arms2x2_sql('l_partkey')}, p0 AS (SELECT row_index, e1 + e2 AS x0, n1 + n2 AS n0 FROM arms), p AS (SELECT *, x0 + CASE WHEN x0 = 0 OR x0 = n0 THEN 0.5 ELSE 0 END AS x, n0 + CASE WHEN x0 = 0 OR x0 = n0 THEN 1.0 ELSE 0 END AS n FROM p0) SELECT row_index, "
    + r(pr="x / n", v_pr="x / n * (1 - x / n) / n", pln="ln(x / n)", v_pln="1 / x - 1 / n", plo="ln(x / (n - x))", v_plo="1 / x + 1 / (n - x)", pas="asin(sqrt(x0 / n0))", v_pas="1 / (4 * n0)", pft="0.5 * (asin(sqrt(x0 / (n0 + 1))) + asin(sqrt((x0 + 1) / (n0 + 1))))", v_pft="1 / (4 * n0 + 2)") + " FROM p",
)
def es_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.arms2x2(spark, sf_dir, "l_partkey").select("row_index", (F.col("e1") + F.col("e2")).alias("x"), (F.col("n1") + F.col("n2")).alias("n"))
    made = []
    for m in ("PR", "PLN", "PLO", "PAS", "PFT"):
        y, v = E.proportion(m, *cols("x", "n"))
        made += [y.alias(m.lower()), v.alias(f"v_{m.lower()}")]
    return rounded(rows.select("row_index", *made))


@query("es_cor", f"WITH {S.PAIRED} SELECT row_index, " + r(cor="r", v_cor="(1 - r * r) * (1 - r * r) / (n - 1)", zcor="0.5 * ln((1 + r) / (1 - r))", v_zcor="1 / (n - 3)", back="tanh(0.5 * ln((1 + r) / (1 - r)))") + " FROM arms WHERE n > 3 AND r > -1 AND r < 1")
def es_cor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.paired(spark, sf_dir).where("n > 3 AND r > -1 AND r < 1")
    (y, v), (z, vz) = (E.correlation(m, *cols("r", "n")) for m in ("COR", "ZCOR"))
    return rounded(rows.select("row_index", y.alias("cor"), v.alias("v_cor"), z.alias("zcor"), vz.alias("v_zcor"), E.back_transform("ZCOR", z).alias("back")))


@query("es_generic", f"WITH {S.GENERIC} SELECT row_index, " + r(yi="yi", vi="vi * 1000", ci_low=f"yi - {E.Z975} * sqrt(vi)", ci_high=f"yi + {E.Z975} * sqrt(vi)") + " FROM st0 WHERE vi > 0")
def es_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, se = F.col("yi"), F.sqrt("vi")
    return rounded(S.generic(spark, sf_dir).select("row_index", "yi", (F.col("vi") * 1000).alias("vi"), (y - E.Z975 * se).alias("ci_low"), (y + E.Z975 * se).alias("ci_high")))


@query(
    "conversions_basic",
    f"WITH {S.CONTINUOUS}, {S.PAIRED.replace('arms AS', 'pr AS')} SELECT a.row_index, "
    + r(n="a.n1 + a.n2", m="(a.n1 * a.m1 + a.n2 * a.m2) / (a.n1 + a.n2)", sd="sqrt(((a.n1 - 1) * a.sd1 * a.sd1 + (a.n2 - 1) * a.sd2 * a.sd2 + a.n1 * a.n2 / (a.n1 + a.n2) * (a.m1 - a.m2) * (a.m1 - a.m2)) / (a.n1 + a.n2 - 1))", d_of_r="2 * r / sqrt(1 - r * r)", v_d="4 * ((1 - r * r) * (1 - r * r) / (n - 1)) / pow(1 - r * r, 3)", d_of_or=f"(a.m1 - a.m2) * {math.sqrt(3) / math.pi}")
    + " FROM arms a JOIN pr ON a.row_index = pr.row_index WHERE r > -1 AND r < 1",
)
def conversions_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.paired(spark, sf_dir).where("r > -1 AND r < 1").select("row_index", "r", "n")
    both = S.arms_continuous(spark, sf_dir).join(p, "row_index")
    n, m, sd = E.combine_groups(*cols("n1", "m1", "sd1", "n2", "m2", "sd2"))
    d, v = E.r_to_d(F.col("r"), E.correlation("COR", *cols("r", "n"))[1])
    return rounded(both.select("row_index", n.alias("n"), m.alias("m"), sd.alias("sd"), d.alias("d_of_r"), v.alias("v_d"), E.logor_to_d(F.col("m1") - F.col("m2"), F.lit(1.0))[0].alias("d_of_or")))


# Pooling ----------------------------------------------------------------------------------------------------------------


def binary_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(analysis_id, row_index, label, moderator, subgroup, yi, vi, e1, n1, e2, n2): log odds ratios of suppliers by region, written
    once, for most queries take several passes over them."""
    y, v = E.two_by_two("OR", *cols(*B))
    return stored(S.arms2x2(spark, sf_dir).withColumns({"yi": y, "vi": v}).join(S.supplier_regions(spark, sf_dir), "row_index"), "studies")


def bounded_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``binary_studies`` in analyses of at most fifty neighbouring suppliers: refits of an analysis without each of its studies
    take the square of its size, so they are asked for on analyses of bounded size."""
    block = F.expr("analysis_id * 1000000 + row_index div 50")
    return binary_studies(spark, sf_dir).withColumn("analysis_id", block)


_ST = f"{S.arms2x2_sql()}, {S.SUPPLIERS}, {_CC}, st AS (SELECT sr.*, e1, n1, e2, n2, ln(a * d / (b * c)) AS yi, 1 / a + 1 / b + 1 / c + 1 / d AS vi FROM t JOIN sr ON t.row_index = sr.row_index WHERE NOT dz)"
_STB = _ST.replace("SELECT sr.*, e1", "SELECT sr.row_index, sr.analysis_id * 1000000 + sr.row_index // 50 AS analysis_id, sr.label, sr.moderator, sr.subgroup, e1")
_M = "m1 AS (SELECT analysis_id, count(*) AS k, sum(1 / vi) AS sw, sum(1 / (vi * vi)) AS sw2, sum(yi / vi) / sum(1 / vi) AS mu, avg(yi) AS my, avg(vi) AS mv FROM st GROUP BY analysis_id), m AS (SELECT m1.*, q, ss, sw - sw2 / sw AS c FROM m1 JOIN (SELECT st.analysis_id, sum((yi - mu) * (yi - mu) / vi) AS q, sum((yi - my) * (yi - my)) AS ss FROM st JOIN m1 ON st.analysis_id = m1.analysis_id GROUP BY st.analysis_id) USING (analysis_id))"
_TAU = {
    "FE": "SELECT analysis_id, k, 0.0::DOUBLE AS tau2 FROM m",
    "DL": "SELECT analysis_id, k, coalesce(greatest(0, (q - (k - 1)) / nullif(c, 0)), 0) AS tau2 FROM m",
    "HE": "SELECT analysis_id, k, coalesce(greatest(0, ss / nullif(k - 1, 0) - mv), 0) AS tau2 FROM m",
    "SJ": "SELECT analysis_id, any_value(k) AS k, coalesce(any_value(ss / k) * sum((yi - mu0) * (yi - mu0) / (vi + ss / k)) / nullif(any_value(k) - 1, 0), 0) AS tau2 FROM (SELECT st.analysis_id, yi, vi, k, ss, sum(yi / (vi + ss / k)) OVER w / sum(1 / (vi + ss / k)) OVER w AS mu0 FROM st JOIN m ON st.analysis_id = m.analysis_id WINDOW w AS (PARTITION BY st.analysis_id)) GROUP BY analysis_id",
}


def _pool_sql(method: str) -> str:
    return f"WITH {_ST}, {_M}, t2 AS ({_TAU[method]}), p AS (SELECT st.analysis_id, any_value(k) AS k, any_value(tau2) AS tau2, sum(yi / (vi + tau2)) / sum(1 / (vi + tau2)) AS mu, sqrt(1 / sum(1 / (vi + tau2))) AS se FROM st JOIN t2 ON st.analysis_id = t2.analysis_id GROUP BY st.analysis_id)"


_POOL_OUT = " SELECT analysis_id, k, " + r(tau2="tau2", estimate="mu", se="se", ci_low=f"mu - {E.Z975} * se", ci_high=f"mu + {E.Z975} * se", z="mu / se") + " FROM p"
for _method, _name in (("FE", "pool_fixed"), ("DL", "pool_dl"), ("HE", "pool_he"), ("SJ", "pool_sj")):
    query(_name, _pool_sql(_method) + _POOL_OUT)(lambda spark, sf_dir, method=_method: rounded(pooling.pooled(binary_studies(spark, sf_dir), method)))


@query("pool_hksj", _pool_sql("DL") + ", h AS (SELECT st.analysis_id, sum((yi - mu) * (yi - mu) / (vi + tau2)) / nullif(any_value(k) - 1, 0) AS scale FROM st JOIN p ON st.analysis_id = p.analysis_id GROUP BY st.analysis_id) SELECT analysis_id, k, " + r(tau2="tau2", estimate="mu", se="se * sqrt(scale)", ci_low=f"mu - {E.Z975} * se * sqrt(scale)", ci_high=f"mu + {E.Z975} * se * sqrt(scale)", z="mu / nullif(se * sqrt(scale), 0)") + " FROM p JOIN h USING (analysis_id)")
def pool_hksj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.pooled(binary_studies(spark, sf_dir), "DL", "HKSJ"))


@query("pool_ivhet", f"WITH {_ST}, {_M}, t2 AS ({_TAU['DL']}), v AS (SELECT st.analysis_id, any_value(t2.k) AS k, any_value(tau2) AS tau2, any_value(mu) AS mu, sqrt(sum(1 / (vi * sw) * 1 / (vi * sw) * (vi + tau2))) AS se FROM st JOIN m ON st.analysis_id = m.analysis_id JOIN t2 ON st.analysis_id = t2.analysis_id GROUP BY st.analysis_id) SELECT analysis_id, k, " + r(tau2="tau2", estimate="mu", se="se", ci_low=f"mu - {E.Z975} * se", ci_high=f"mu + {E.Z975} * se") + " FROM v")
def pool_ivhet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.ivhet(binary_studies(spark, sf_dir)))


@query(
    "het_block",
    f"WITH {_ST}, {_M}, h0 AS (SELECT *, (k - 1)::DOUBLE AS df, sqrt(q / nullif(k - 1, 0)) AS h, CASE WHEN q > k THEN 0.5 * (ln(CASE WHEN q > k THEN q END) - ln(CASE WHEN k > 1 THEN k - 1 END)) / (sqrt(2 * q) - sqrt(greatest(2 * k - 3, 0))) ELSE sqrt(CASE WHEN k > 2 THEN 1.0 / (2 * (k - 2)) * (1 - 1.0 / (3.0 * (k - 2) * (k - 2))) END) END AS se FROM m), "
    f"h1 AS (SELECT *, greatest(exp(ln(greatest(h, 1)) - {E.Z975} * se), 1) AS lo, exp(ln(greatest(h, 1)) + {E.Z975} * se) AS hi FROM h0) SELECT analysis_id, k, "
    + r(q="q", df="df", i2="CASE WHEN k > 1 AND q > 0 THEN greatest(0, (q - df) / q) ELSE 0 END", h="h", c="c", tau2_dl="coalesce(greatest(0, (q - df) / nullif(c, 0)), 0)", i2_low="CASE WHEN k >= 3 THEN (lo * lo - 1) / (lo * lo) END", i2_high="CASE WHEN k >= 3 THEN greatest(0, (hi * hi - 1) / (hi * hi)) END") + " FROM h1",
)
def het_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.heterogeneity(binary_studies(spark, sf_dir)))


@query("study_weights", _pool_sql("DL") + " SELECT st.analysis_id, row_index, " + r(weight="100 * (1 / (vi + tau2)) / (1 / (se * se))") + " FROM st JOIN p ON st.analysis_id = p.analysis_id")
def study_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.weights(binary_studies(spark, sf_dir)))


_SG = f"WITH {_ST}, g1 AS (SELECT analysis_id, subgroup, count(*) AS k, sum(1 / vi) AS sw, sum(1 / (vi * vi)) AS sw2, sum(yi / vi) / sum(1 / vi) AS mu FROM st GROUP BY ALL), g2 AS (SELECT g1.*, coalesce(greatest(0, (q - (k - 1)) / nullif(sw - sw2 / sw, 0)), 0) AS tau2 FROM g1 JOIN (SELECT st.analysis_id, st.subgroup, sum((yi - mu) * (yi - mu) / vi) AS q FROM st JOIN g1 ON st.analysis_id = g1.analysis_id AND st.subgroup = g1.subgroup GROUP BY ALL) USING (analysis_id, subgroup)), g AS (SELECT st.analysis_id, st.subgroup, any_value(k) AS k, any_value(tau2) AS tau2, sum(yi / (vi + tau2)) / sum(1 / (vi + tau2)) AS estimate, sqrt(1 / sum(1 / (vi + tau2))) AS se FROM st JOIN g2 ON st.analysis_id = g2.analysis_id AND st.subgroup = g2.subgroup GROUP BY ALL)"


@query("subgroup_estimates", _SG + " SELECT analysis_id, subgroup, k, " + r(tau2="tau2", estimate="estimate", se="se") + " FROM g")
def subgroup_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.subgroups(binary_studies(spark, sf_dir), "subgroup")[0])


@query("subgroup_qb", _SG + ", mm AS (SELECT analysis_id, count(*) AS groups, sum(estimate / (se * se)) / sum(1 / (se * se)) AS mean FROM g GROUP BY analysis_id) SELECT g.analysis_id, any_value(groups) AS groups, " + r(q_between="sum((estimate - mean) * (estimate - mean) / (se * se))") + ", any_value(groups) - 1 AS df FROM g JOIN mm ON g.analysis_id = mm.analysis_id GROUP BY g.analysis_id")
def subgroup_qb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.subgroups(binary_studies(spark, sf_dir), "subgroup")[1])


_PARTS = f"{S.arms2x2_sql('l_partkey')}, pa AS (SELECT p_brand AS analysis_id, arms.* FROM arms JOIN part ON row_index = p_partkey WHERE n1 > 0 AND n2 > 0)"
_NZ = "NOT (e1 = 0 AND e2 = 0) AND NOT (e1 = n1 AND e2 = n2)"


def sparse_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse tables of parts, one analysis for each brand."""
    brands = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), F.col("p_brand").alias("analysis_id"))
    return S.arms2x2(spark, sf_dir, "l_partkey").join(brands, "row_index")


@query("mh_or", f"WITH {_PARTS}, z AS (SELECT *, n1 + n2 AS n, e1 * (n2 - e2) / (n1 + n2) AS r, (n1 - e1) * e2 / (n1 + n2) AS s, (e1 + n2 - e2) / (n1 + n2) AS p, (n1 - e1 + e2) / (n1 + n2) AS q FROM pa WHERE {_NZ}) SELECT analysis_id, count(*) AS k, " + r(estimate="ln(sum(r) / sum(s))", se="sqrt(sum(p * r) / (2 * sum(r) * sum(r)) + sum(p * s + q * r) / (2 * sum(r) * sum(s)) + sum(q * s) / (2 * sum(s) * sum(s)))") + " FROM z GROUP BY analysis_id")
def mh_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.mantel_haenszel(sparse_arms(spark, sf_dir), "OR"))


@query("mh_rr", f"WITH {_PARTS} SELECT analysis_id, count(*) AS k, " + r(estimate="ln(sum(e1 * n2 / (n1 + n2)) / sum(e2 * n1 / (n1 + n2)))", se="sqrt(sum((n1 * n2 * (e1 + e2) - e1 * e2 * (n1 + n2)) / ((n1 + n2) * (n1 + n2))) / (sum(e1 * n2 / (n1 + n2)) * sum(e2 * n1 / (n1 + n2))))") + f" FROM pa WHERE {_NZ} GROUP BY analysis_id")
def mh_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.mantel_haenszel(sparse_arms(spark, sf_dir), "RR"))


@query(
    "mh_rd",
    f"WITH {_PARTS}, z AS (SELECT analysis_id, count(*) AS k, sum((e1 * n2 - e2 * n1) / (n1 + n2)) / sum(n1 * n2 / (n1 + n2)) AS rd, sum(n1 * n2 / (n1 + n2)) AS den, sum((n1 * n1 * e2 - n2 * n2 * e1 + n1 * n2 * (n2 - n1) / 2) / ((n1 + n2) * (n1 + n2))) AS p, sum((e1 * (n2 - e2) + e2 * (n1 - e1)) / (2 * (n1 + n2))) AS q FROM pa GROUP BY analysis_id) SELECT analysis_id, k, "
    + r(estimate="rd", se="sqrt(greatest(0, (rd * p + q) / (den * den)))") + " FROM z",
)
def mh_rd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.mantel_haenszel(sparse_arms(spark, sf_dir), "RD"))


@query("peto", f"WITH {_PARTS}, z AS (SELECT analysis_id, e1 - n1 * (e1 + e2) / (n1 + n2) AS gap, n1 * n2 * (e1 + e2) * (n1 + n2 - e1 - e2) / ((n1 + n2) * (n1 + n2) * nullif(n1 + n2 - 1, 0)) AS v FROM pa) SELECT analysis_id, count(*) AS k, " + r(estimate="sum(gap) / sum(v)", se="1 / sqrt(sum(v))") + " FROM z WHERE v > 0 GROUP BY analysis_id")
def peto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.peto(sparse_arms(spark, sf_dir)))


@query("totals_abs", _pool_sql("DL") + ", s AS (SELECT analysis_id, sum(e1) AS e1, sum(n1) AS n1, sum(e2) AS e2, sum(n2) AS n2 FROM st GROUP BY analysis_id) SELECT analysis_id, " + r(participants="n1 + n2", events="e1 + e2", risk1="e1 / n1", risk2="e2 / n2", per_1000="1000 * (exp(mu) * (e2 / n2) / (1 - e2 / n2 + exp(mu) * (e2 / n2)) - e2 / n2)") + " FROM s JOIN p USING (analysis_id)")
def totals_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir).where("vi IS NOT NULL")
    return rounded(pooling.totals(own, pooling.pooled(own, "DL")))


# Small-study effects and sensitivity ----------------------------------------------------------------------------------------


def _line_sql(source: str, x: str, y: str, w: str = "1.0") -> str:
    return (
        f", l0 AS (SELECT analysis_id, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y, ({w})::DOUBLE AS w FROM {source}), l1 AS (SELECT analysis_id, count(*) AS k, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM l0 GROUP BY analysis_id), "
        "l2 AS (SELECT l1.*, sxx, sxy, syy, CASE WHEN k >= 3 AND sxx > 1e-12 THEN sxy / sxx END AS slope FROM l1 JOIN (SELECT l0.analysis_id, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy, sum(w * (y - my) * (y - my)) AS syy FROM l0 JOIN l1 ON l0.analysis_id = l1.analysis_id GROUP BY l0.analysis_id) USING (analysis_id)), "
        "l3 AS (SELECT *, greatest(0, syy - slope * sxy) / (CASE WHEN k > 2 THEN k - 2.0 END) AS s2 FROM l2) SELECT analysis_id, k, "
        + r(intercept="my - slope * mx", slope="slope", se_intercept="CASE WHEN slope IS NOT NULL THEN sqrt(s2 * (1 / sw + mx * mx / sxx)) END", se_slope="CASE WHEN slope IS NOT NULL THEN sqrt(s2 / sxx) END") + " FROM l3"
    )


@query("egger", f"WITH {_ST}" + _line_sql("st", "1 / sqrt(vi)", "yi / sqrt(vi)"))
def egger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.egger(binary_studies(spark, sf_dir)))


@query("harbord", f"WITH {_ST}, hb AS (SELECT analysis_id, e1 - n1 * (e1 + e2) / (n1 + n2) AS gap, n1 * n2 * (e1 + e2) * (n1 + n2 - e1 - e2) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1)) AS v FROM st)" + _line_sql("hb WHERE v > 0", "sqrt(v)", "gap / sqrt(v)"))
def harbord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.harbord(binary_studies(spark, sf_dir).where("vi IS NOT NULL")))


@query("peters", f"WITH {_ST}" + _line_sql("st WHERE e1 + e2 > 0 AND e1 + e2 < n1 + n2", "1 / (n1 + n2)", "yi", "1 / (1 / (e1 + e2) + 1 / (n1 + n2 - e1 - e2))").replace("sxx > 1e-12", "sxx > 1e-12"))
def peters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir)
    return rounded(bias.peters(own.select("analysis_id", "row_index", *B), own.select("analysis_id", "row_index", "yi", "vi")))


@query(
    "begg_tau",
    f"WITH {_STB}, {_M}, z AS (SELECT st.analysis_id, row_index, vi, (yi - mu) / sqrt(vi - 1 / sw) AS z FROM st JOIN m ON st.analysis_id = m.analysis_id WHERE vi - 1 / sw > 0), pr AS (SELECT a.analysis_id, sign(a.z - b.z) AS dz, sign(a.vi - b.vi) AS dv FROM z a JOIN z b ON a.analysis_id = b.analysis_id AND a.row_index < b.row_index), n AS (SELECT analysis_id, count(*) AS k FROM z GROUP BY analysis_id) "
    "SELECT analysis_id, any_value(k) AS k, " + r(s="sum(dz * dv)", tau_b="sum(dz * dv) / nullif(sqrt(sum(abs(dz)) * sum(abs(dv))), 0)") + " FROM pr JOIN n USING (analysis_id) GROUP BY analysis_id",
)
def begg_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.begg(bounded_studies(spark, sf_dir)))


@query("failsafe", f"WITH {_ST} SELECT analysis_id, count(*) AS k, " + r(sum_z="sum(yi / sqrt(vi))", n_failsafe=f"greatest(0, sum(yi / sqrt(vi)) * sum(yi / sqrt(vi)) / {bias.Z95_ONE_SIDED**2} - count(*))") + " FROM st GROUP BY analysis_id")
def failsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.failsafe(binary_studies(spark, sf_dir)))


_REFIT = (
    "f1 AS (SELECT analysis_id, pos, count(*) AS k, sum(1 / vi) AS sw, sum(1 / (vi * vi)) AS sw2, sum(yi / vi) / sum(1 / vi) AS mu FROM fr GROUP BY ALL), f2 AS (SELECT f1.*, coalesce(greatest(0, (q - (k - 1)) / nullif(sw - sw2 / sw, 0)), 0) AS tau2 FROM f1 JOIN (SELECT fr.analysis_id, fr.pos, sum((yi - mu) * (yi - mu) / vi) AS q FROM fr JOIN f1 ON fr.analysis_id = f1.analysis_id AND fr.pos = f1.pos GROUP BY ALL) USING (analysis_id, pos)), "
    "f3 AS (SELECT fr.analysis_id, fr.pos AS row_index, any_value(k) AS k, any_value(tau2) AS tau2, sum(yi / (vi + tau2)) / sum(1 / (vi + tau2)) AS estimate, 1 / sqrt(sum(1 / (vi + tau2))) AS se FROM fr JOIN f2 ON fr.analysis_id = f2.analysis_id AND fr.pos = f2.pos GROUP BY ALL)"
)


@query("loo_dl", f"WITH {_STB}, fr AS (SELECT a.analysis_id, a.row_index AS pos, b.yi, b.vi FROM st a JOIN st b ON a.analysis_id = b.analysis_id AND a.row_index <> b.row_index), {_REFIT} SELECT analysis_id, row_index, " + r(tau2="tau2", estimate="estimate", se="se") + " FROM f3 WHERE k >= 2")
def loo_dl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.leave_one_out(bounded_studies(spark, sf_dir)))


@query("cumulative_dl", f"WITH {_ST}, fr AS (SELECT a.analysis_id, a.row_index AS pos, b.yi, b.vi FROM st a JOIN st b ON a.analysis_id = b.analysis_id AND (b.moderator, b.row_index) <= (a.moderator, a.row_index)), {_REFIT} SELECT analysis_id, row_index, k, " + r(tau2="tau2", estimate="estimate", se="se") + " FROM f3")
def cumulative_dl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.cumulative(binary_studies(spark, sf_dir), "moderator"))


@query("outliers", _pool_sql("DL") + f" SELECT st.analysis_id, row_index, CASE WHEN yi - {E.Z975} * sqrt(vi) > mu + {E.Z975} * se THEN 'above' ELSE 'below' END AS side FROM st JOIN p ON st.analysis_id = p.analysis_id WHERE yi - {E.Z975} * sqrt(vi) > mu + {E.Z975} * se OR yi + {E.Z975} * sqrt(vi) < mu - {E.Z975} * se")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bias.outliers(binary_studies(spark, sf_dir))


@query(
    "metareg_fe",
    f"WITH {_ST}, a AS (SELECT analysis_id, count(*) AS k, sum(moderator / vi) / sum(1 / vi) AS mx, sum(yi / vi) / sum(1 / vi) AS my FROM st GROUP BY analysis_id), b AS (SELECT st.analysis_id, any_value(k) AS k, any_value(mx) AS mx, any_value(my) AS my, sum((moderator - mx) * (moderator - mx) / vi) AS sxx, sum((moderator - mx) * (yi - my) / vi) AS sxy, sum((yi - my) * (yi - my) / vi) AS syy FROM st JOIN a ON st.analysis_id = a.analysis_id GROUP BY st.analysis_id), "
    "c AS (SELECT *, CASE WHEN k >= 3 AND sxx > 0 THEN sxy / sxx END AS slope FROM b) SELECT analysis_id, k, " + r(intercept="my - slope * mx", slope="slope", z_slope="slope * sqrt(sxx)", qe="syy - slope * sxy") + " FROM c",
)
def metareg_fe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.meta_regression(binary_studies(spark, sf_dir), "moderator"))
