"""Queries of iterative estimators, intervals, tests and refits, with their SQL.

Variances are solved in SQL by recursion (Newton's and Fisher's steps), Student's t by its finite sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import effects as E
from evidra.functions import special as X
from evidra.operators import bias, iterative, pooling, profiles, regression

from .catalog import _M, _ST, _STB, _pool_sql, binary_studies, bounded_studies, query, r, rounded

# Variances by iteration ---------------------------------------------------------------------------------------------

_STEP = {
    "PM": "greatest(0, t + (sum(w * (y - mu) * (y - mu)) - (count(*) - 1)) / sum(w * w * (y - mu) * (y - mu)))",
    "ML": "greatest(0, t + (sum(w * w * (y - mu) * (y - mu)) - sum(w)) / sum(w * w))",
    "REML": "greatest(0, t + (sum(w * w * (y - mu) * (y - mu)) - sum(w) + sum(w * w) / sum(w)) / (sum(w * w) - 2 * sum(w * w * w) / sum(w) + (sum(w * w) / sum(w)) * (sum(w * w) / sum(w))))",
}


def _solved_sql(method: str, rounds: int = 80) -> str:
    start = "0.0::DOUBLE" if method == "PM" else "greatest(0, ss / nullif(k - 1, 0) - mv)"
    return (
        f"it AS (SELECT analysis_id, 0 AS n, {start} AS t FROM m WHERE k > 1 UNION ALL SELECT analysis_id, n + 1, {_STEP[method]} FROM (SELECT it.analysis_id, n, t, yi AS y, 1 / (vi + t) AS w, sum(yi / (vi + t)) OVER g / sum(1 / (vi + t)) OVER g AS mu "
        f"FROM it JOIN st ON it.analysis_id = st.analysis_id WHERE n < {rounds} WINDOW g AS (PARTITION BY it.analysis_id)) GROUP BY analysis_id, n, t), "
        f"t2 AS (SELECT m.analysis_id, m.k, coalesce(t, 0) AS tau2 FROM m LEFT JOIN (SELECT * FROM it WHERE n = {rounds}) i ON i.analysis_id = m.analysis_id), "
        "p AS (SELECT st.analysis_id, any_value(k) AS k, any_value(tau2) AS tau2, sum(yi / (vi + tau2)) / sum(1 / (vi + tau2)) AS mu, sqrt(1 / sum(1 / (vi + tau2))) AS se FROM st JOIN t2 ON st.analysis_id = t2.analysis_id GROUP BY st.analysis_id), "
        "h AS (SELECT st.analysis_id, sum((yi - mu) * (yi - mu) / (vi + tau2)) / nullif(any_value(k) - 1, 0) AS scale FROM st JOIN p ON st.analysis_id = p.analysis_id GROUP BY st.analysis_id)"
    )


_BY_NAME = (("pool_reml", "REML"), ("pool_ml", "ML"), ("pool_pm", "PM"))
for _name, _method in _BY_NAME:
    query(
        _name,
        f"WITH RECURSIVE {_ST}, {_M}, {_solved_sql(_method)} SELECT analysis_id, k, "
        + r(tau2="tau2", estimate="mu", se="se", se_hksj="se * sqrt(scale)", p_value=f"2 * {X.norm_cdf('(-abs(mu / se))')}") + " FROM p JOIN h USING (analysis_id)",
    )(lambda spark, sf_dir, method=_method: rounded(profiles.random_effects(binary_studies(spark, sf_dir), method, limits=False).select("analysis_id", "k", "tau2", "estimate", "se", "se_hksj", "p_value")))

_HALF_LOG_PI = "0.5723649429247001"


def t_p_sql(t: str, df: str) -> str:
    """P(|T| >= |t|) for whole degrees of freedom."""
    c2, theta = f"({df} / ({df} + ({t}) * ({t})))", f"atan(abs({t}) / sqrt({df}))"
    odd = f"1 - (2 / pi()) * ({theta} + CASE WHEN {df} > 1 THEN sin({theta}) * cos({theta}) * list_sum(list_transform(range(0, (({df} - 1) / 2)::BIGINT), lambda i: exp(lgamma(i + 1) - lgamma(i + 1.5) + {_HALF_LOG_PI} - ln(2) + i * ln({c2})))) ELSE 0 END)"
    even = f"1 - sin({theta}) * list_sum(list_transform(range(0, ({df} / 2)::BIGINT), lambda i: exp(lgamma(i + 0.5) - lgamma(i + 1) - {_HALF_LOG_PI} + i * ln({c2}))))"
    return f"CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END"


_Z_P = f"2 * {X.norm_cdf('(-abs(z))')}"  # one study has no spread and is tested by z


@query(
    "meta_hksj",
    f"WITH RECURSIVE {_ST}, {_M}, {_solved_sql('REML')}, o AS (SELECT *, mu / nullif(se * sqrt(scale), 0) AS stat, (k - 1)::DOUBLE AS df, se * sqrt(scale) AS se1, mu / (se * sqrt(greatest(1, scale))) AS stat_adhoc, mu / se AS z, se AS se0 FROM p JOIN h USING (analysis_id)) "
    "SELECT analysis_id, k, " + r(estimate="mu", **{c: f"CASE WHEN k = 1 THEN {one} ELSE {more} END" for c, one, more in (("se", "se0", "se1"), ("stat", "z", "stat"), ("df", "NULL", "df"), ("p", _Z_P, t_p_sql("stat", "df")), ("p_adhoc", _Z_P, t_p_sql("stat_adhoc", "df")))}) + " FROM o",
)
def meta_hksj(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir)
    adhoc = profiles.meta_analysis(own, "REML", "hksj_adhoc").select("analysis_id", F.col("p").alias("p_adhoc"))
    return rounded(profiles.meta_analysis(own, "REML", "hksj").select("analysis_id", "k", "estimate", "se", "stat", "df", "p").join(adhoc, "analysis_id"))


@query("meta_z", _pool_sql("DL") + " SELECT analysis_id, k, " + r(tau2="tau2", estimate="mu", se="se", p=f"2 * {X.norm_cdf('(-abs(mu / se))')}", ci_low=f"mu - {E.Z975} * se", ci_high=f"mu + {E.Z975} * se", pi_low=f"mu - {E.Z975} * sqrt(tau2 + se * se)", pi_high=f"mu + {E.Z975} * sqrt(tau2 + se * se)") + " FROM p")
def meta_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.meta_analysis(binary_studies(spark, sf_dir), "DL", "z", "z").drop("stat", "df"))


def _h_sql(centre: str, form: str) -> str:
    middle = "ln(greatest(1, sqrt(q / (k - 1))))" if centre == "truncated" else "0.5 * ln(q / (k - 1))"
    narrow = "sqrt(1.0 / (2 * (k - 2) * (1 - 1.0 / (3.0 * (k - 2) * (k - 2)))))" if form == "borenstein" else "sqrt((1 - 1.0 / (3.0 * (k - 2) * (k - 2))) / (2 * (k - 2)))"
    return f"exp({middle} {{sign}} {E.Z975} * CASE WHEN q > k THEN 0.5 * (ln(q) - ln(k - 1)) / (sqrt(2 * q) - sqrt(2 * k - 3)) ELSE {narrow} END)"


_HT, _BOOK = _h_sql("truncated", "higgins_thompson"), _h_sql("untruncated", "borenstein")


@query(
    "het_intervals",
    f"WITH {_ST}, {_M}, h AS (SELECT analysis_id, k, q, c, k - 1 AS df, coalesce(greatest(0, (q - (k - 1)) / nullif(c, 0)), 0) AS tau2, {_HT.format(sign='-')} AS lo, {_HT.format(sign='+')} AS hi, {_BOOK.format(sign='-')} AS blo, {_BOOK.format(sign='+')} AS bhi FROM m WHERE k >= 3) SELECT analysis_id, k, "
    + r(h="greatest(1, sqrt(q / df))", h2="q / df", h2_modified="greatest(0, q / df - 1)", i2_from_tau2="100 * tau2 / (tau2 + df / c)", h_low="greatest(1, lo)", h_high="greatest(1, hi)", tau2_low="greatest(0, df * (lo * lo - 1) / c)", tau2_high="greatest(0, df * (hi * hi - 1) / c)", tau2_low_book="greatest(0, df * (blo * blo - 1) / c)", tau2_high_book="greatest(0, df * (bhi * bhi - 1) / c)")
    + " FROM h",
)
def het_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.heterogeneity_intervals(binary_studies(spark, sf_dir)).where("k >= 3"))


@query("q_profile")
def q_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.q_profile(binary_studies(spark, sf_dir)))


# Tests ----------------------------------------------------------------------------------------------------------------

_EG = "x AS (SELECT analysis_id, 1 / sqrt(vi) AS x, yi / sqrt(vi) AS y FROM st), f AS (SELECT analysis_id, count(*) AS k, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM x GROUP BY analysis_id), e AS (SELECT *, b0 / sqrt(greatest(0, syy - b1 * b1 * sxx) / (k - 2) * (1.0 / k + mx * mx / sxx)) AS t, (k - 2)::DOUBLE AS df FROM f WHERE k >= 3)"


@query("egger_test", f"WITH {_ST}, {_EG} SELECT analysis_id, k, " + r(estimate="b0", t="t", df="df", p=t_p_sql("t", "df")) + " FROM e")
def egger_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.line_test(bias.egger(binary_studies(spark, sf_dir)), "intercept").drop("se"))


_BG = (
    "z AS (SELECT st.analysis_id, row_index, vi, (yi - mu) / sqrt(vi - 1 / sw) AS z FROM st JOIN m ON st.analysis_id = m.analysis_id WHERE vi - 1 / sw > 0), pr AS (SELECT a.analysis_id, sum(sign(a.z - b.z) * sign(a.vi - b.vi)) AS s FROM z a JOIN z b ON a.analysis_id = b.analysis_id AND a.row_index < b.row_index GROUP BY a.analysis_id), "
    "tz AS (SELECT analysis_id, sum(c * (c - 1) * (2 * c + 5)) AS t3, sum(c * (c - 1)) AS t1, sum(c * (c - 1) * (c - 2)) AS t2 FROM (SELECT analysis_id, z, count(*)::DOUBLE AS c FROM z GROUP BY ALL) GROUP BY analysis_id), "
    "tv AS (SELECT analysis_id, sum(c * (c - 1) * (2 * c + 5)) AS t3, sum(c * (c - 1)) AS t1, sum(c * (c - 1) * (c - 2)) AS t2 FROM (SELECT analysis_id, vi, count(*)::DOUBLE AS c FROM z GROUP BY ALL) GROUP BY analysis_id), "
    "n AS (SELECT analysis_id, count(*)::DOUBLE AS k FROM z GROUP BY analysis_id), "
    "b AS (SELECT n.analysis_id, k, s, sqrt((k * (k - 1) * (2 * k + 5) - tz.t3 - tv.t3) / 18 + tz.t1 * tv.t1 / (2 * k * (k - 1)) + CASE WHEN k > 2 THEN tz.t2 * tv.t2 / (9 * k * (k - 1) * (k - 2)) ELSE 0 END) AS sd FROM n JOIN pr USING (analysis_id) JOIN tz USING (analysis_id) JOIN tv USING (analysis_id))"
)


@query("begg_test", f"WITH {_STB}, {_M}, {_BG} SELECT analysis_id, k::BIGINT AS k, " + r(s="s", sd_s="sd", z="s / sd", p=f"least(1, 2 * {X.norm_cdf('(-abs(s / sd))')})") + " FROM b WHERE sd > 0")
def begg_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.begg_normal(bounded_studies(spark, sf_dir)).drop("tau_b").where("sd_s > 0"))


@query(
    "lfk_index",
    f"WITH {_STB}, n AS (SELECT analysis_id, row_index, yi, 100 * max(vi) OVER (PARTITION BY analysis_id) / vi AS n, count(*) OVER (PARTITION BY analysis_id) AS k FROM st), c AS (SELECT *, (sum(n) OVER (PARTITION BY analysis_id ORDER BY yi, row_index ROWS UNBOUNDED PRECEDING) - n / 2 - 0.5) / sum(n) OVER (PARTITION BY analysis_id) AS p FROM n), "
    f"s AS (SELECT *, {X.norm_ppf('p')} AS z FROM c), a AS (SELECT analysis_id, any_value(k) AS k, arg_min(yi, (abs(z), yi, row_index)) AS apex, sum(z) AS sz, sum(yi) AS sy, (max(z) - min(z)) / nullif(max(yi) - min(yi), 0) AS slope FROM s GROUP BY analysis_id), "
    "l AS (SELECT analysis_id, k, CASE WHEN k >= 3 THEN 5.0 / (2 * k) * (sz + slope * (sy - k * apex)) END AS v FROM a) SELECT analysis_id, k, " + r(lfk="v") + ", CASE WHEN abs(v) <= 1 THEN 'none' WHEN abs(v) <= 2 THEN 'minor' WHEN v IS NOT NULL THEN 'major' END AS asymmetry FROM l",
)
def lfk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.lfk(bounded_studies(spark, sf_dir)))


# Refits ---------------------------------------------------------------------------------------------------------------


@query("trim_and_fill")
def trim_and_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(iterative.trim_and_fill(bounded_studies(spark, sf_dir)))


_LOO = (
    "fr AS (SELECT a.analysis_id, a.row_index AS pos, b.yi, b.vi FROM st a JOIN st b ON a.analysis_id = b.analysis_id AND a.row_index <> b.row_index), f1 AS (SELECT analysis_id, pos, count(*) AS k1, sum(1 / vi) AS sw, sum(1 / (vi * vi)) AS sw2, sum(yi / vi) / sum(1 / vi) AS mu1 FROM fr GROUP BY ALL), "
    "f2 AS (SELECT f1.*, q, coalesce(greatest(0, (q - (k1 - 1)) / nullif(sw - sw2 / sw, 0)), 0) AS t FROM f1 JOIN (SELECT fr.analysis_id, fr.pos, sum((yi - mu1) * (yi - mu1) / vi) AS q FROM fr JOIN f1 ON fr.analysis_id = f1.analysis_id AND fr.pos = f1.pos GROUP BY ALL) USING (analysis_id, pos)), "
    "f3 AS (SELECT fr.analysis_id, fr.pos, any_value(t) AS t, any_value(q) AS q, sum(yi / (vi + t)) / sum(1 / (vi + t)) AS mu1, 1 / sum(1 / (vi + t)) AS var1 FROM fr JOIN f2 ON fr.analysis_id = f2.analysis_id AND fr.pos = f2.pos GROUP BY ALL), "
    "o AS (SELECT st.analysis_id, st.row_index, (yi - mu1) / sqrt(vi + t + var1) AS rstudent, (mu - mu1) / sqrt(1 / (vi + tau2) * se * se * (vi + t)) AS dffits, (mu - mu1) * (mu - mu1) / (se * se) AS cook, var1 / (se * se) AS cov_ratio, t AS tau2_del, q AS q_del, se * se / (vi + tau2) AS hat, (mu - mu1) / sqrt(var1) AS dfbetas, k "
    "FROM st JOIN p ON st.analysis_id = p.analysis_id JOIN f3 ON f3.analysis_id = st.analysis_id AND f3.pos = st.row_index WHERE k >= 3)"
)


@query("influence", _pool_sql("DL").replace(_ST, _STB) + f", {_LOO} SELECT analysis_id, row_index, " + r(rstudent="rstudent", dffits="dffits", cook="cook", cov_ratio="cov_ratio", tau2_del="tau2_del", q_del="q_del", hat="hat", dfbetas="dfbetas") + ", abs(dffits) > 3 * sqrt(1.0 / (k - 1)) OR cook > 0.4549364231195724 OR hat > 3.0 / k OR abs(dfbetas) > 1 AS flagged FROM o")
def influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(iterative.influence(bounded_studies(spark, sf_dir), "DL"))


_CHILD = "c AS (SELECT * FROM st WHERE moderator >= 5000), c1 AS (SELECT analysis_id, count(*) AS k, sum(1 / vi) AS sw, sum(yi / vi) / sum(1 / vi) AS mu FROM c GROUP BY analysis_id), b1 AS (SELECT analysis_id, count(*) AS k, sum(1 / vi) AS sw, sum(yi / vi) / sum(1 / vi) AS mu FROM st GROUP BY analysis_id)"


@query("child_runs", f"WITH {_ST}, {_CHILD} SELECT b1.analysis_id, b1.k AS k_base, c1.k AS k_child, sign(b1.mu) <> sign(c1.mu) AS other_side, (abs(b1.mu) > {E.Z975} / sqrt(b1.sw)) <> (abs(c1.mu) > {E.Z975} / sqrt(c1.sw)) AS other_crossing FROM b1 JOIN c1 USING (analysis_id)")
def child_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir)
    return bias.child_run(pooling.pooled(own, "FE"), pooling.pooled(own.where("moderator >= 5000"), "FE"))


@query("loo_fixed", f"WITH {_ST}, w AS (SELECT analysis_id, row_index, sum(1 / vi) OVER a - 1 / vi AS sw, sum(yi / vi) OVER a - yi / vi AS swy, count(*) OVER a AS k FROM st WINDOW a AS (PARTITION BY analysis_id)) SELECT analysis_id, row_index, " + r(estimate="swy / sw", se="1 / sqrt(sw)") + " FROM w WHERE k >= 3")
def loo_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.leave_one_out_fixed(binary_studies(spark, sf_dir)))


@query("cumulative_fixed", f"WITH {_STB}, w AS (SELECT analysis_id, row_index, sum(1 / vi) OVER a AS sw, sum(yi / vi) OVER a AS swy, count(*) OVER a AS k FROM st WINDOW a AS (PARTITION BY analysis_id ORDER BY moderator, row_index ROWS UNBOUNDED PRECEDING)) SELECT analysis_id, row_index, k, " + r(estimate="swy / sw", se="1 / sqrt(sw)") + " FROM w")
def cumulative_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.cumulative_fixed(bounded_studies(spark, sf_dir), "moderator"))


# Regression -----------------------------------------------------------------------------------------------------------


@query("metareg_robust")
def metareg_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical and numeric moderators, Knapp-Hartung tests and HC1 errors beside them."""
    own = bounded_studies(spark, sf_dir).withColumn("half", F.when(F.col("row_index") % 2 == 0, "even").otherwise("odd"))
    return rounded(regression.meta_regression(own, ["moderator"], categories=["half"], test="knha"))

