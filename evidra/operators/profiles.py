"""Random-effects models of analyses of any size.

The variances of PM, ML and REML are looked up in sums at shared points (``refits``), the limits of the Q profile found in rounds
of aggregates: a round lays a grid over the interval that still holds the variance, and takes the sums of all studies at all its points
at once: partial sums in the tasks that hold the studies, one row for each analysis and point behind them. Six rounds of a
hundred points find it to about ten digits. No task gets the studies of an analysis.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evidra.functions import distributions as D
from evidra.functions.effects import Z975
from evidra.functions.special import norm_cdf
from evidra.sources.shared import stored

from . import refits
from .pooling import KEY, tau2, usable, weighted

POINTS, ROUNDS = 100, 6


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """The two-sided p value of a t statistic; null without one or without degrees of freedom."""
    ok = t.notna() & (df > 0)
    out = pd.Series(np.full(len(t), np.nan))
    if ok.any():
        out[ok] = D.t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
    return out.where(ok, None)


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(D.t_quantiles(p.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(D.each(lambda a, n: D.chi2_ppf(a, n) if n > 0 else np.nan, p, df))


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([1 - D.chi2_cdf(a, n) if n > 0 else None for a, n in zip(x, df, strict=True)], dtype="float64")


def _sums(studies: DataFrame, points: DataFrame) -> DataFrame:
    """(analysis_id, goal, wanted, t, q): Q at each point, from centred effects (yc)."""
    at = F.when(F.col("log"), F.when(F.col("i") == 0, 0.0).otherwise(F.col("high") * F.pow(F.lit(10.0), -10.0 * (1 - F.col("i") / POINTS)))).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / POINTS)
    rows = studies.join(points, KEY).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(POINTS)))).withColumn("t", at)
    w, y = 1.0 / (F.col("vi") + F.col("t")), F.col("yc")
    m = rows.groupBy(KEY, "goal", "i").agg(F.first("t").alias("t"), F.first("wanted").alias("wanted"), *[F.sum(v).alias(k) for k, v in {"w": w, "wy": w * y, "wyy": w * y * y}.items()])
    return m.select(KEY, "goal", "wanted", "t", F.greatest(F.lit(0.0), F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")).alias("q"))


def solved(studies: DataFrame, goals: DataFrame) -> DataFrame:
    """(analysis_id, goal, t): where the generalised Q is ``wanted``, 0 where it starts below. ``studies`` (analysis_id, yc, vi) hold
    centred effects, ``goals`` (analysis_id, goal, wanted, high) an upper bound of t."""
    points = goals.select(KEY, "goal", "wanted", F.lit(0.0).alias("low"), "high", F.lit(True).alias("log"))
    studies = stored(studies, "centred")
    for _ in range(ROUNDS):
        m = _sums(studies, points)
        ends = m.groupBy(KEY, "goal", "wanted").agg(F.max(F.when(F.col("q") > F.col("wanted"), F.col("t"))).alias("low"), F.min("t").alias("first"), F.max("t").alias("last"), F.array_sort(F.collect_list("t")).alias("ts"))
        # The next point behind the last one at which Q is above; above at none: the first point is the answer.
        after = F.element_at(F.filter("ts", lambda t: t > F.col("low")), 1)
        points = ends.select(KEY, "goal", "wanted", F.coalesce("low", "first").alias("low"), F.coalesce(F.when(F.col("low").isNotNull(), F.coalesce(after, "last")), F.col("first")).alias("high"), F.lit(False).alias("log"))
    return points.select(KEY, "goal", ((F.col("low") + F.col("high")) / 2).alias("t"))


def centred(studies: DataFrame, moments: DataFrame) -> DataFrame:
    return usable(studies).join(moments.select(KEY, "mean_y"), KEY).select(KEY, (F.col("yi") - F.col("mean_y")).alias("yc"), "vi")


def estimate_tau2(studies: DataFrame, method: str = "REML") -> DataFrame:
    """(analysis_id, k, tau2) by FE (0), DL, HE, SJ, PM, ML or REML; 0 for one study."""
    moments = weighted(studies)
    if method in ("FE", "DL", "HE", "SJ"):
        return tau2(moments, method, studies).select(KEY, "k", "tau2")
    found = refits.estimated(studies, moments, method)
    return moments.select(KEY, "k").join(found, KEY, "left").select(KEY, "k", F.coalesce("tau2", F.lit(0.0)).alias("tau2"))


def q_profile(studies: DataFrame, level: float = 0.95) -> DataFrame:
    """(analysis_id, tau2_low, tau2_high): the variances at which Q meets the quantiles of chi-square; analyses of two or more."""
    moments = weighted(studies).where("k > 1")
    tail = (1 - level) / 2
    sides = F.explode(F.array(*[F.struct(F.lit(g).alias("goal"), F.lit(p).alias("p")) for g, p in ((0, 1 - tail), (1, tail))]))
    goals = moments.select(KEY, "k", "ss", sides.alias("s")).select(KEY, "s.goal", chi2_quantile(F.col("s.p"), F.col("k") - 1.0).alias("wanted"), "ss")
    found = solved(centred(studies, moments), goals.select(KEY, "goal", "wanted", (F.col("ss") / F.col("wanted")).alias("high")))
    return found.groupBy(KEY).agg(F.max(F.when(F.col("goal") == 0, F.col("t"))).alias("tau2_low"), F.max(F.when(F.col("goal") == 1, F.col("t"))).alias("tau2_high"))


def at_tau2(studies: DataFrame, taus: DataFrame) -> DataFrame:
    """(analysis_id, k, tau2, estimate, se_wald, q_scaled): the mean at each analysis's variance, and Q over k - 1 there."""
    rows = usable(studies).join(taus, KEY).withColumn("w", 1.0 / (F.col("vi") + F.col("tau2")))
    means = rows.groupBy(KEY).agg(F.first("k").alias("k"), F.first("tau2").alias("tau2"), F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("yi")) / F.sum("w")).alias("mu"))
    gap = F.col("yi") - F.col("mu")
    q = rows.drop("k", "tau2").join(means.select(KEY, "mu"), KEY).groupBy(KEY).agg(F.sum(F.col("w") * gap * gap).alias("q"))
    return means.join(q, KEY).select(KEY, "k", "tau2", F.col("mu").alias("estimate"), F.sqrt(1.0 / F.col("sw")).alias("se_wald"), (F.col("q") / F.nullif(F.col("k") - 1.0, F.lit(0.0))).alias("q_scaled"))


def meta_analysis(studies: DataFrame, method: str = "REML", ci: str = "hksj", pi: str = "t_k-2", level: float = 0.95) -> DataFrame:
    """(analysis_id, k, tau2, estimate, se, stat, df, p, ci_low, ci_high, pi_low, pi_high).

    ``ci``: z, t (k - 1 degrees of freedom), hksj (the standard error scaled by Q at tau2 over k - 1) or hksj_adhoc (never scaled
    down); one study always gets z. ``pi`` (not for FE): t_k-2, t_k-1 or z, with the reported standard error; null where there
    are too few studies.
    """
    taus = stored(estimate_tau2(studies, method), "taus") if method not in ("FE", "DL", "HE") else estimate_tau2(studies, method)
    m = at_tau2(studies, taus)
    single = F.col("k") < 2
    scale = {"z": F.lit(1.0), "t": F.lit(1.0), "hksj": F.col("q_scaled"), "hksj_adhoc": F.greatest(F.lit(1.0), F.col("q_scaled"))}[ci]
    se = F.when(single, F.col("se_wald")).otherwise(F.col("se_wald") * F.sqrt(scale))
    df = F.when(~single & F.lit(ci != "z"), F.col("k") - 1.0)
    m = m.withColumns({"se": se, "df": df}).withColumn("stat", F.col("estimate") / F.nullif(F.col("se"), F.lit(0.0)))
    upper = 1 - (1 - level) / 2
    z = float(D.norm_ppf(upper)) if level != 0.95 else Z975
    crit = F.when(F.col("df").isNull(), z).otherwise(t_quantile(F.lit(upper), F.col("df")))
    p = F.when(F.col("df").isNull(), 2 * F.expr(norm_cdf("(-abs(stat))"))).otherwise(t_p(F.col("stat"), F.col("df")))
    pi_df = F.col("k") - {"t_k-2": 2.0, "t_k-1": 1.0, "z": 0.0}[pi]
    spread = (F.lit(z) if pi == "z" else F.when(pi_df > 0, t_quantile(F.lit(upper), pi_df))) * F.sqrt(F.col("tau2") + F.col("se") * F.col("se"))
    m = m.withColumns({"crit": crit, "p": p, "spread": F.lit(None).cast("double") if method == "FE" else spread})
    y, se = F.col("estimate"), F.col("se")
    return m.select(KEY, "k", "tau2", "estimate", "se", "stat", "df", "p", (y - F.col("crit") * se).alias("ci_low"), (y + F.col("crit") * se).alias("ci_high"), (y - F.col("spread")).alias("pi_low"), (y + F.col("spread")).alias("pi_high"))


def random_effects(studies: DataFrame, method: str = "REML", level: float = 0.95, limits: bool = True) -> DataFrame:
    """(analysis_id, k, tau2, tau2_low, tau2_high, estimate, se, se_hksj, ci_low, ci_high, pi_low, pi_high, p_value, q_p): limits of
    tau2 of the Q profile, Hartung-Knapp's interval with t(k - 1), the prediction interval with t(k - 2), the normal test and
    that of Q. What too few studies leave undefined is null. Limits of tau2 take as many rounds as two more estimates; without
    ``limits`` they are null."""
    taus = stored(estimate_tau2(studies, method), "taus")
    fit = at_tau2(studies, taus)
    several = F.col("k") > 1
    upper = 1 - (1 - level) / 2
    se, hk = F.col("se_wald"), F.when(several, F.col("se_wald") * F.sqrt("q_scaled"))
    q0 = weighted(studies).select(KEY, F.col("q").alias("q0"))
    none = F.lit(None).cast("double")
    fit = fit.join(q_profile(studies, level), KEY, "left") if limits else fit.withColumns({"tau2_low": none, "tau2_high": none})
    m = fit.join(q0, KEY).withColumns({"hk": hk, "stat": F.col("estimate") / se})
    t1, t2 = (F.when(F.col("k") > n, t_quantile(F.lit(upper), F.col("k") - float(n))) for n in (1, 2))
    m = m.withColumns({"half": t1 * F.col("hk"), "spread": t2 * F.sqrt(F.col("tau2") + se * se)})
    y = F.col("estimate")
    return m.select(
        KEY, "k", "tau2", "tau2_low", "tau2_high", "estimate", se.alias("se"), F.col("hk").alias("se_hksj"), (y - F.col("half")).alias("ci_low"), (y + F.col("half")).alias("ci_high"),
        (y - F.col("spread")).alias("pi_low"), (y + F.col("spread")).alias("pi_high"), (2 * F.expr(norm_cdf("(-abs(stat))"))).alias("p_value"), F.when(several, chi2_tail(F.col("q0"), F.col("k") - 1.0)).alias("q_p"),
    )


def h_interval(k: Column, q: Column, centre: str = "truncated", form: str = "higgins_thompson") -> tuple[Column, Column]:
    """Limits of H, not cut at 1, from three studies on. ``centre``: truncated takes H of 1 at least, untruncated as it is.
    ``form``: of the standard error where Q is at most k, higgins_thompson or borenstein (the correction in the denominator)."""
    k, df = k.cast("double"), k.cast("double") - 1
    more = F.when(q > k, q)
    wide = 0.5 * (F.log(more) - F.log(F.when(df > 0, df))) / (F.sqrt(2 * more) - F.sqrt(F.greatest(2 * k - 3, F.lit(0.0))))
    n = F.when(k > 2, k - 2)
    part = 1 - 1.0 / (3 * n * n)
    narrow = F.sqrt(1.0 / (2 * n * part)) if form == "borenstein" else F.sqrt(part / (2 * n))
    se = F.when(q > k, wide).otherwise(narrow)
    h = F.sqrt(q / F.nullif(df, F.lit(0.0)))
    middle = F.log(F.greatest(h, F.lit(1.0))) if centre == "truncated" else F.log(F.when(h > 0, h))
    ok = k >= 3
    return F.when(ok, F.exp(middle - Z975 * se)), F.when(ok, F.exp(middle + Z975 * se))


def heterogeneity_intervals(studies: DataFrame) -> DataFrame:
    """(analysis_id, k, h, h2, h2_modified, i2_from_tau2, h_low, h_high, tau2_low, tau2_high, tau2_low_book, tau2_high_book): H and its
    limits, I2 from the DL variance and the typical variance, and limits of tau2 from those of H, with the standard error of
    Higgins and Thompson and as printed in Borenstein's book."""
    m = tau2(weighted(studies), "DL")
    df = F.col("k") - 1.0
    s2 = df / F.nullif(F.col("c"), F.lit(0.0))
    low, high = h_interval(F.col("k"), F.col("q"))
    low_book, high_book = h_interval(F.col("k"), F.col("q"), "untruncated", "borenstein")
    limit = lambda x: F.when(F.col("c") > 0, F.greatest(F.lit(0.0), df * (x * x - 1) / F.col("c")))
    ratio = F.col("q") / F.nullif(df, F.lit(0.0))
    return m.select(
        KEY, "k", F.greatest(F.lit(1.0), F.sqrt(ratio)).alias("h"), ratio.alias("h2"), F.greatest(F.lit(0.0), ratio - 1).alias("h2_modified"), (100 * F.col("tau2") / (F.col("tau2") + s2)).alias("i2_from_tau2"),
        F.greatest(F.lit(1.0), low).alias("h_low"), F.greatest(F.lit(1.0), high).alias("h_high"), limit(low).alias("tau2_low"), limit(high).alias("tau2_high"), limit(low_book).alias("tau2_low_book"), limit(high_book).alias("tau2_high_book"),
    )


def sd_from_interval(rows: DataFrame, level: float = 0.95) -> DataFrame:
    """``rows`` (lower, upper, n) with sd, of one group's mean: the root of n times the width over twice t(n - 1)."""
    t = t_quantile(F.lit(1 - (1 - level) / 2), F.col("n") - 1.0)
    return rows.withColumn("sd", F.sqrt("n") * (F.col("upper") - F.col("lower")) / (2 * t))
