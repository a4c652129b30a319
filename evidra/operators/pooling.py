"""Pooling of studies within analyses, as grouped aggregates: any number of analyses in one job.

Studies are rows (analysis_id, row_index, yi, vi). Rows with a null, or a variance that is not positive, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.effects import Z975

KEY = "analysis_id"


def usable(studies: DataFrame) -> DataFrame:
    return studies.where("yi IS NOT NULL AND vi > 0 AND vi < double('Infinity') AND NOT isnan(yi)")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def weighted(studies: DataFrame) -> DataFrame:
    """Per analysis: k, sums of weights, fixed-effect mean mu, Q about it, C, mean and variance of yi and mean of vi."""
    rows = usable(studies).withColumn("w", 1.0 / F.col("vi"))
    first = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("yi")).alias("swy"), F.avg("yi").alias("mean_y"), F.avg("vi").alias("mean_v"))
    first = first.withColumn("mu", F.col("swy") / F.col("sw"))
    gap = F.col("yi") - F.col("mu")
    plain = F.col("yi") - F.col("mean_y")
    second = rows.join(first.select(KEY, "mu", "mean_y"), KEY).groupBy(KEY).agg(F.sum(F.col("w") * gap * gap).alias("q"), F.sum(plain * plain).alias("ss"))
    return first.join(second, KEY).withColumn("c", F.col("sw") - F.col("sw2") / F.col("sw"))


def tau2(moments: DataFrame, method: str, studies: DataFrame | None = None) -> DataFrame:
    """``moments`` with the column tau2: FE (0), DL, HE or SJ, all in closed form."""
    k = F.col("k").cast("double")
    if method == "FE":
        return moments.withColumn("tau2", F.lit(0.0))
    if method == "DL":
        return moments.withColumn("tau2", F.coalesce(F.greatest(F.lit(0.0), _ratio(F.col("q") - (k - 1), F.col("c"))), F.lit(0.0)))
    if method == "HE":
        return moments.withColumn("tau2", F.coalesce(F.greatest(F.lit(0.0), _ratio(F.col("ss"), k - 1) - F.col("mean_v")), F.lit(0.0)))
    if method == "SJ":
        start = moments.withColumn("t0", F.col("ss") / k)
        q = generalised_q(studies, start.select(KEY, F.col("t0").alias("tau2"))).withColumnRenamed("q_tau2", "q0")
        return start.join(q.select(KEY, "q0"), KEY).withColumn("tau2", F.coalesce(_ratio(F.col("t0") * F.col("q0"), k - 1), F.lit(0.0))).drop("t0", "q0")
    raise ValueError(f"no closed form for {method}")


def generalised_q(studies: DataFrame, taus: DataFrame) -> DataFrame:
    """(analysis_id, mu, sw_star, q_tau2): mean, weight and Q with weights 1 / (vi + tau2)."""
    rows = usable(studies).join(taus.select(KEY, "tau2"), KEY).withColumn("w", 1.0 / (F.col("vi") + F.col("tau2")))
    means = rows.groupBy(KEY).agg(F.sum("w").alias("sw_star"), (F.sum(F.col("w") * F.col("yi")) / F.sum("w")).alias("mu"))
    gap = F.col("yi") - F.col("mu")
    return rows.join(means, KEY).groupBy(KEY).agg(F.first("mu").alias("mu"), F.first("sw_star").alias("sw_star"), F.sum(F.col("w") * gap * gap).alias("q_tau2"))


def pooled(studies: DataFrame, method: str = "DL", ci: str = "z") -> DataFrame:
    """(analysis_id, k, tau2, estimate, se, ci_low, ci_high, z): fixed (FE) or random effects.

    With ``ci`` HKSJ the standard error is scaled by Q at tau2 over k - 1 (null for one study); bounds stay normal ones, and
    ``evidra.operators.iterative`` gives those of t.
    """
    taus = tau2(weighted(studies), method, studies).select(KEY, "k", "tau2")
    out = taus.join(generalised_q(studies, taus), KEY)
    se = F.sqrt(1.0 / F.col("sw_star"))
    if ci == "HKSJ":
        se = F.sqrt(_ratio(F.col("q_tau2"), F.col("k") - F.lit(1.0)) / F.col("sw_star"))
    return out.select(KEY, "k", "tau2", F.col("mu").alias("estimate"), se.alias("se")).withColumns({"ci_low": F.col("estimate") - Z975 * F.col("se"), "ci_high": F.col("estimate") + Z975 * F.col("se"), "z": _ratio(F.col("estimate"), F.col("se"))})


def ivhet(studies: DataFrame) -> DataFrame:
    """Fixed-effect weights with the variance of each study widened by tau2 (DL)."""
    m = tau2(weighted(studies), "DL").select(KEY, "k", "sw", "mu", "tau2")
    share = 1.0 / F.col("vi") / F.col("sw")
    v = usable(studies).join(m, KEY).groupBy(KEY).agg(F.sum(share * share * (F.col("vi") + F.col("tau2"))).alias("v"))
    out = m.join(v, KEY).select(KEY, "k", "tau2", F.col("mu").alias("estimate"), F.sqrt("v").alias("se"))
    return out.withColumns({"ci_low": F.col("estimate") - Z975 * F.col("se"), "ci_high": F.col("estimate") + Z975 * F.col("se")})


def heterogeneity(studies: DataFrame) -> DataFrame:
    """(analysis_id, k, q, df, i2, h, c, tau2_dl, i2_low, i2_high): Q, I2 and H with Higgins-Thompson limits (k of 3 at least)."""
    m = tau2(weighted(studies), "DL")
    k, q = F.col("k").cast("double"), F.col("q")
    df = k - 1
    h = F.sqrt(_ratio(q, df))
    q_safe = F.when(q > k, q)
    se = F.when(q > k, 0.5 * (F.log(q_safe) - F.log(F.when(df > 0, df))) / (F.sqrt(2 * q_safe) - F.sqrt(F.greatest(2 * k - 3, F.lit(0.0))))).otherwise(
        F.sqrt(F.when(k > 2, 1.0 / (2 * F.nullif(k - 2, F.lit(0.0))) * (1 - 1.0 / (3 * F.nullif((k - 2) * (k - 2), F.lit(0.0))))))
    )
    ln_h = F.log(F.greatest(h, F.lit(1.0)))
    low, high = F.greatest(F.exp(ln_h - Z975 * se), F.lit(1.0)), F.exp(ln_h + Z975 * se)
    i2 = F.when((k > 1) & (q > 0), F.greatest(F.lit(0.0), (q - df) / F.nullif(q, F.lit(0.0)))).otherwise(0.0)
    share = lambda x: F.when(k >= 3, (x * x - 1) / (x * x))
    return m.select(KEY, "k", "q", df.alias("df"), i2.alias("i2"), h.alias("h"), "c", F.col("tau2").alias("tau2_dl"), share(low).alias("i2_low"), F.when(k >= 3, F.greatest(F.lit(0.0), (high * high - 1) / (high * high))).alias("i2_high"))


def weights(studies: DataFrame, method: str = "DL") -> DataFrame:
    """(analysis_id, row_index, weight): each study's share of the total weight in percent."""
    taus = tau2(weighted(studies), method, studies).select(KEY, "tau2")
    rows = usable(studies).join(taus, KEY).withColumn("w", 1.0 / (F.col("vi") + F.col("tau2")))
    total = rows.groupBy(KEY).agg(F.sum("w").alias("all"))
    return rows.join(total, KEY).select(KEY, "row_index", (100.0 * F.col("w") / F.col("all")).alias("weight"))


def subgroups(studies: DataFrame, group: str, method: str = "DL") -> tuple[DataFrame, DataFrame]:
    """(estimates by analysis and group, Q between by analysis): groups of one study are taken as fixed."""
    key = F.struct(KEY, group)
    inner = studies.withColumn("__outer", F.col(KEY)).withColumn(KEY, key)
    by_group = pooled(inner.select(KEY, "yi", "vi"), method).select(F.col(f"{KEY}.{KEY}").alias(KEY), F.col(f"{KEY}.{group}").alias(group), "k", "tau2", "estimate", "se")
    w = 1.0 / (F.col("se") * F.col("se"))
    means = by_group.groupBy(KEY).agg(F.count(F.lit(1)).alias("groups"), (F.sum(w * F.col("estimate")) / F.sum(w)).alias("mean"))
    gap = F.col("estimate") - F.col("mean")
    between = by_group.join(means, KEY).groupBy(KEY).agg(F.first("groups").alias("groups"), F.sum(w * gap * gap).alias("q_between")).withColumn("df", F.col("groups") - 1)
    return by_group, between


def mantel_haenszel(arms: DataFrame, measure: str = "OR") -> DataFrame:
    """(analysis_id, k, estimate, se) from rows (analysis_id, e1, n1, e2, n2); logs for OR and RR. No continuity correction.

    Empty tables take no part, nor do double zero and double full ones in ratios. Variances: Robins-Breslow-Greenland (OR),
    Greenland-Robins (RR), Sato (RD).
    """
    a, c, n1, n2 = F.col("e1"), F.col("e2"), F.col("n1"), F.col("n2")
    b, d, n = n1 - a, n2 - c, n1 + n2
    rows = arms.where("n1 > 0 AND n2 > 0")
    if measure != "RD":
        rows = rows.where("NOT (e1 = 0 AND e2 = 0) AND NOT (e1 = n1 AND e2 = n2)")
    if measure == "OR":
        r, s, p, q = a * d / n, b * c / n, (a + d) / n, (b + c) / n
        m = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("k"), F.sum(r).alias("r"), F.sum(s).alias("s"), F.sum(p * r).alias("pr"), F.sum(p * s + q * r).alias("mixed"), F.sum(q * s).alias("qs"))
        ok = (F.col("r") > 0) & (F.col("s") > 0)
        v = F.col("pr") / (2 * F.col("r") * F.col("r")) + F.col("mixed") / (2 * F.col("r") * F.col("s")) + F.col("qs") / (2 * F.col("s") * F.col("s"))
        return m.select(KEY, "k", F.when(ok, F.log(F.when(ok, F.col("r") / F.col("s")))).alias("estimate"), F.when(ok, F.sqrt(F.when(ok, v))).alias("se"))
    if measure == "RR":
        m = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("k"), F.sum(a * n2 / n).alias("r"), F.sum(c * n1 / n).alias("s"), F.sum((n1 * n2 * (a + c) - a * c * n) / (n * n)).alias("p"))
        ok = (F.col("r") > 0) & (F.col("s") > 0)
        return m.select(KEY, "k", F.when(ok, F.log(F.when(ok, F.col("r") / F.col("s")))).alias("estimate"), F.when(ok, F.sqrt(F.when(ok, F.col("p") / (F.col("r") * F.col("s"))))).alias("se"))
    m = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("k"), F.sum((a * n2 - c * n1) / n).alias("num"), F.sum(n1 * n2 / n).alias("den"),
        F.sum((n1 * n1 * c - n2 * n2 * a + n1 * n2 * (n2 - n1) / 2) / (n * n)).alias("p"), F.sum((a * (n2 - c) + c * (n1 - a)) / (2 * n)).alias("q"),
    )
    rd = F.col("num") / F.col("den")
    return m.select(KEY, "k", rd.alias("estimate"), F.sqrt(F.greatest(F.lit(0.0), (rd * F.col("p") + F.col("q")) / (F.col("den") * F.col("den")))).alias("se"))


def peto(arms: DataFrame) -> DataFrame:
    """(analysis_id, k, estimate, se) of the log odds ratio from observed minus expected events and hypergeometric variances."""
    n, e = F.col("n1") + F.col("n2"), F.col("e1") + F.col("e2")
    gap = F.col("e1") - F.col("n1") * e / n
    v = F.col("n1") * F.col("n2") * e * (n - e) / (n * n * F.nullif(n - 1, F.lit(0.0)))
    m = arms.where("n1 > 0 AND n2 > 0").withColumns({"gap": gap, "v": v}).where("v > 0").groupBy(KEY).agg(F.count(F.lit(1)).alias("k"), F.sum("gap").alias("gap"), F.sum("v").alias("v"))
    return m.select(KEY, "k", (F.col("gap") / F.col("v")).alias("estimate"), (1.0 / F.sqrt("v")).alias("se"))


def totals(arms: DataFrame, estimates: DataFrame) -> DataFrame:
    """Participants, events, raw risks and the absolute effect per 1000 that the odds ratio ``estimate`` means at the control risk."""
    t = arms.groupBy(KEY).agg(*[F.sum(c).alias(c) for c in ("e1", "n1", "e2", "n2")])
    risk = _ratio(F.col("e2"), F.col("n2"))
    odds = F.exp("estimate")
    treated = odds * risk / (1 - risk + odds * risk)
    return t.join(estimates.select(KEY, "estimate"), KEY).select(KEY, (F.col("n1") + F.col("n2")).alias("participants"), (F.col("e1") + F.col("e2")).alias("events"), _ratio(F.col("e1"), F.col("n1")).alias("risk1"), risk.alias("risk2"), (1000 * (treated - risk)).alias("per_1000"))
