"""Small-study tests and sensitivity frames within analyses, as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.effects import Z975
from evidra.functions.special import norm_cdf, norm_ppf
from evidra.sources.shared import stored

from . import refits
from .pooling import KEY, pooled, usable, weighted
from .ranks import EXACT_MOST, concordance, exact_p

Z95_ONE_SIDED = 1.6448536269514722


def regression(rows: DataFrame, x: Column, y: Column, w: Column | None = None) -> DataFrame:
    """(analysis_id, k, intercept, slope, se_intercept, se_slope) of y on x, weighted by ``w``; null where x does not vary or
    fewer than three rows remain. Sums are taken about the means."""
    own = rows.select(KEY, x.alias("x"), y.alias("y"), (w if w is not None else F.lit(1.0)).alias("w")).where("x IS NOT NULL AND y IS NOT NULL AND w > 0")
    means = own.groupBy(KEY).agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = own.join(means, KEY).groupBy(KEY).agg(F.sum(F.col("w") * dx * dx).alias("sxx"), F.sum(F.col("w") * dx * dy).alias("sxy"), F.sum(F.col("w") * dy * dy).alias("syy"))
    made = means.join(sums, KEY)
    ok = (F.col("k") >= 3) & (F.col("sxx") > 1e-12)
    sxx = F.when(ok, F.col("sxx"))
    slope = F.col("sxy") / sxx
    s2 = F.greatest(F.lit(0.0), F.col("syy") - slope * F.col("sxy")) / F.when(F.col("k") > 2, F.col("k") - 2.0)
    return made.select(KEY, "k", (F.col("my") - slope * F.col("mx")).alias("intercept"), slope.alias("slope"), F.sqrt(s2 * (1.0 / F.col("sw") + F.col("mx") * F.col("mx") / sxx)).alias("se_intercept"), F.sqrt(s2 / sxx).alias("se_slope"))


def egger(studies: DataFrame) -> DataFrame:
    """Standardised effect on precision; the intercept shows asymmetry."""
    se = F.sqrt("vi")
    return regression(usable(studies), 1.0 / se, F.col("yi") / se)


def harbord(arms: DataFrame) -> DataFrame:
    """Score over root information on root information, from 2x2 tables."""
    n, e = F.col("n1") + F.col("n2"), F.col("e1") + F.col("e2")
    rows = arms.withColumns({"gap": F.col("e1") - F.col("n1") * e / n, "v": F.col("n1") * F.col("n2") * e * (n - e) / (n * n * F.nullif(n - 1, F.lit(0.0)))}).where("v > 0")
    return regression(rows, F.sqrt("v"), F.col("gap") / F.sqrt("v"))


def peters(arms: DataFrame, studies: DataFrame) -> DataFrame:
    """Log odds ratio on inverse size, weighted by the harmonic mean of events and non-events; the slope shows asymmetry."""
    e, n = F.col("e1") + F.col("e2"), F.col("n1") + F.col("n2")
    rows = usable(studies).join(arms.drop(KEY), "row_index").where((e > 0) & (e < n))
    return regression(rows, 1.0 / n, F.col("yi"), 1.0 / (1.0 / e + 1.0 / F.nullif(n - e, F.lit(0.0))))


def deviates(studies: DataFrame) -> DataFrame:
    """(analysis_id, row_index, vi, z): effects less the fixed mean over their standard errors about it."""
    m = weighted(studies).select(KEY, "mu", "sw")
    rows = usable(studies).join(m, KEY).withColumn("v_star", F.col("vi") - 1.0 / F.col("sw")).where("v_star > 0")
    return rows.select(KEY, "row_index", "vi", ((F.col("yi") - F.col("mu")) / F.sqrt("v_star")).alias("z"))


def begg(studies: DataFrame) -> DataFrame:
    """(analysis_id, k, s, tau_b): Kendall's rank correlation of standardised deviates with variances, of analyses of two or more; no
    pairs are formed, so an analysis may have any size."""
    return _tau(concordance(deviates(studies), "z", "vi").where("k > 1"))


def _tau(m: DataFrame) -> DataFrame:
    return m.select(KEY, "k", "s", (F.col("s") / F.nullif(F.sqrt((F.col("pairs") - F.col("ties_x")) * (F.col("pairs") - F.col("ties_y"))), F.lit(0.0))).alias("tau_b"))


def begg_exact(studies: DataFrame) -> DataFrame:
    """(analysis_id, k, s, tau_b, p, method) of analyses of three or more: the chance of an s as far from 0 by its exact distribution
    where nothing is tied and there are at most 170 studies, else by ``begg_normal``; null where all effects or variances are one. Deviates and their concordance are written once, so
    that no task holds the sorts of all steps at a time."""
    rows = stored(deviates(studies), "deviates")
    m = stored(concordance(rows, "z", "vi").where("k >= 3"), "concordance")
    free = (F.col("ties_x") + F.col("ties_y") == 0) & (F.col("k") <= EXACT_MOST)
    normal = _normal(rows, _tau(m)).select(KEY, "tau_b", F.col("p").alias("p_normal"))
    out = m.join(normal, KEY, "left").withColumns({"method": F.when(free, "exact").otherwise("normal"), "p_exact": exact_p(F.col("s"), F.col("k"))})
    return out.select(KEY, "k", "s", "tau_b", F.when(F.col("tau_b").isNotNull(), F.when(free, F.col("p_exact")).otherwise(F.col("p_normal"))).alias("p"), "method")


def begg_normal(studies: DataFrame, continuity: bool = False) -> DataFrame:
    """(analysis_id, k, s, tau_b, sd_s, z, p): ``begg`` with the variance of s corrected for ties and the normal test; with
    ``continuity``, s is moved by one towards 0."""
    return _normal(deviates(studies), begg(studies), continuity)


def _normal(rows: DataFrame, taus: DataFrame, continuity: bool = False) -> DataFrame:
    def ties(column: str, name: str) -> DataFrame:
        c = F.col("c").cast("double")
        one = rows.groupBy(KEY, column).agg(F.count(F.lit(1)).alias("c"))
        return one.groupBy(KEY).agg(F.sum(c * (c - 1) * (2 * c + 5)).alias(f"{name}3"), F.sum(c * (c - 1)).alias(f"{name}1"), F.sum(c * (c - 1) * (c - 2)).alias(f"{name}2"))

    both = taus.join(ties("z", "a"), KEY).join(ties("vi", "b"), KEY)
    k = F.col("k").cast("double")
    v = (k * (k - 1) * (2 * k + 5) - F.col("a3") - F.col("b3")) / 18 + F.col("a1") * F.col("b1") / (2 * k * (k - 1)) + F.when(k > 2, F.col("a2") * F.col("b2") / (9 * k * (k - 1) * F.nullif(k - 2, F.lit(0.0)))).otherwise(0.0)
    sd = F.sqrt(F.when(v > 0, v))
    s = F.signum("s") * F.greatest(F.lit(0.0), F.abs("s") - 1) if continuity else F.col("s")
    made = both.withColumns({"sd_s": sd, "z": s / sd})
    return made.select(KEY, "k", "s", "tau_b", "sd_s", "z", F.least(F.lit(1.0), 2 * F.expr(norm_cdf("(-abs(z))"))).alias("p"))


def line_test(fit: DataFrame, coefficient: str) -> DataFrame:
    """(analysis_id, k, estimate, se, t, df, p) of the intercept or slope of ``regression``: t(k - 2). An analysis of fewer than three
    studies has no test and no row."""
    from .profiles import t_p

    m = fit.where("k >= 3").select(KEY, "k", F.col(coefficient).alias("estimate"), F.col(f"se_{coefficient}").alias("se"))
    m = m.withColumns({"t": F.col("estimate") / F.nullif(F.col("se"), F.lit(0.0)), "df": F.col("k") - 2.0})
    return m.withColumn("p", t_p("t", "df"))


def lfk(studies: DataFrame) -> DataFrame:
    """(analysis_id, k, lfk, asymmetry): areas on both sides of the Doi plot's apex; to 1 none, to 2 minor, else major. Effects in
    order have N = 100 max v / v each, their normal scores are those of the running mid-ranks less 0.5, and the apex is the
    score nearest 0. Fewer than three studies, or equal effects, have none."""
    whole = Window.partitionBy(KEY)
    order = whole.orderBy("yi", "row_index")
    rows = usable(studies).withColumns({"k": F.count(F.lit(1)).over(whole), "n": 100.0 * F.max("vi").over(whole) / F.col("vi")})
    rows = rows.withColumns({"mid": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2, "all": F.sum("n").over(whole)}).withColumn("p", (F.col("mid") - 0.5) / F.col("all"))
    rows = rows.withColumn("z", F.expr(norm_ppf("p")))
    m = rows.groupBy(KEY).agg(F.first("k").alias("k"), F.sum("z").alias("sz"), F.sum("yi").alias("sy"), (F.max("z") - F.min("z")).alias("rz"), (F.max("yi") - F.min("yi")).alias("ry"), F.min(F.struct(F.abs("z").alias("a"), "yi", "row_index")).alias("apex"))
    k = F.col("k").cast("double")
    slope = F.col("rz") / F.nullif(F.col("ry"), F.lit(0.0))
    value = F.when(k >= 3, 5 / (2 * k) * (F.col("sz") + slope * (F.col("sy") - k * F.col("apex.yi"))))
    m = m.withColumn("lfk", value)
    kind = F.when(F.abs("lfk") <= 1, "none").when(F.abs("lfk") <= 2, "minor").when(F.col("lfk").isNotNull(), "major")
    return m.select(KEY, "k", "lfk", kind.alias("asymmetry"))


def failsafe(studies: DataFrame) -> DataFrame:
    """Rosenthal's number of null studies that would undo significance at 0.05 (one-sided)."""
    m = usable(studies).groupBy(KEY).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("yi") / F.sqrt("vi")).alias("sum_z"))
    return m.select(KEY, "k", "sum_z", F.greatest(F.lit(0.0), F.col("sum_z") * F.col("sum_z") / Z95_ONE_SIDED**2 - F.col("k")).alias("n_failsafe"))


def _dl(sw: Column, sw2: Column, swy: Column, swy2: Column, k: Column) -> Column:
    q = swy2 - swy * swy / sw
    made = F.greatest(F.lit(0.0), (q - (k - 1)) / F.nullif(sw - sw2 / sw, F.lit(0.0)))
    # Of one study, Q and C are 0 but for rounding, and their ratio is anything.
    return F.coalesce(F.when(k >= 2, made), F.lit(0.0))


def leave_one_out(studies: DataFrame) -> DataFrame:
    """(analysis_id, row_index, tau2, estimate, se): DL random effects without each study, analyses of three or more.

    Each study's refit needs the others again with its own tau2, so the pairs of one analysis are met once.
    """
    rows = usable(studies).withColumn("w", 1.0 / F.col("vi"))
    whole = Window.partitionBy(KEY)
    centred = rows.withColumn("yc", F.col("yi") - F.avg("yi").over(whole))
    w, y = F.col("w"), F.col("yc")
    left = lambda x: F.sum(x).over(whole) - x
    taus = centred.withColumn("k", F.count(F.lit(1)).over(whole) - 1.0).withColumn("tau2", _dl(left(w), left(w * w), left(w * y), left(w * y * y), F.col("k"))).where("k >= 2")
    out, other = taus.select(KEY, F.col("row_index").alias("left_out"), "tau2"), rows.select(KEY, "row_index", "yi", "vi")
    pairs = out.join(other, KEY).where("row_index <> left_out").withColumn("ws", 1.0 / (F.col("vi") + F.col("tau2")))
    made = pairs.groupBy(KEY, "left_out", "tau2").agg(F.sum("ws").alias("sw"), F.sum(F.col("ws") * F.col("yi")).alias("swy"))
    return made.select(KEY, F.col("left_out").alias("row_index"), "tau2", (F.col("swy") / F.col("sw")).alias("estimate"), (1.0 / F.sqrt("sw")).alias("se"))


def cumulative(studies: DataFrame, order: str) -> DataFrame:
    """(analysis_id, row_index, k, tau2, estimate, se): DL refits over growing prefixes in the order of ``order``; an analysis may have
    any size."""
    return refits.cumulative(studies, order, "DL")


def leave_one_out_fixed(studies: DataFrame) -> DataFrame:
    """(analysis_id, row_index, estimate, se): fixed-effect fits without each study, from the sums of all; analyses of three or more."""
    w = 1.0 / F.col("vi")
    rows = usable(studies)
    sums = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * F.col("yi")).alias("swy")).where("k >= 3")
    left = rows.join(sums, KEY)
    return left.select(KEY, "row_index", ((F.col("swy") - w * F.col("yi")) / (F.col("sw") - w)).alias("estimate"), (1.0 / F.sqrt(F.col("sw") - w)).alias("se"))


def cumulative_fixed(studies: DataFrame, order: str) -> DataFrame:
    """(analysis_id, row_index, k, estimate, se): fixed-effect fits of growing prefixes, in one pass over each analysis."""
    growing = Window.partitionBy(KEY).orderBy(F.asc_nulls_last(order), "row_index").rowsBetween(Window.unboundedPreceding, 0)
    w = 1.0 / F.col("vi")
    rows = usable(studies).withColumns({"k": F.count(F.lit(1)).over(growing), "sw": F.sum(w).over(growing), "swy": F.sum(w * F.col("yi")).over(growing)})
    return rows.select(KEY, "row_index", "k", (F.col("swy") / F.col("sw")).alias("estimate"), (1.0 / F.sqrt("sw")).alias("se"))


def child_run(base: DataFrame, child: DataFrame) -> DataFrame:
    """(analysis_id, k_base, k_child, other_side, other_crossing): whether a run on some of the rows has its estimate on the other side
    of 0, or its interval crosses 0 where the base run's does not, or the reverse."""
    crosses = lambda s: (F.col(f"ci_low_{s}") <= 0) & (F.col(f"ci_high_{s}") >= 0)
    own = [df.select(KEY, *[F.col(c).alias(f"{c}_{s}") for c in ("k", "estimate", "ci_low", "ci_high")]) for df, s in ((base, "base"), (child, "child"))]
    both = own[0].join(own[1], KEY)
    return both.select(KEY, "k_base", "k_child", (F.signum("estimate_base") != F.signum("estimate_child")).alias("other_side"), (crosses("base") != crosses("child")).alias("other_crossing"))


def outliers(studies: DataFrame, method: str = "DL") -> DataFrame:
    """(analysis_id, row_index, side): studies whose own interval lies wholly above or below the pooled one."""
    p = pooled(studies, method).select(KEY, "ci_low", "ci_high")
    rows = usable(studies).join(p, KEY).withColumns({"low": F.col("yi") - Z975 * F.sqrt("vi"), "high": F.col("yi") + Z975 * F.sqrt("vi")})
    side = F.when(F.col("low") > F.col("ci_high"), "above").when(F.col("high") < F.col("ci_low"), "below")
    return rows.withColumn("side", side).where("side IS NOT NULL").select(KEY, "row_index", "side")


def meta_regression(studies: DataFrame, moderator: str) -> DataFrame:
    """(analysis_id, k, intercept, slope, z_slope, qe): fixed-effect weights, one moderator; variances are taken as known."""
    rows = usable(studies).where(F.col(moderator).isNotNull()).withColumn("w", 1.0 / F.col("vi"))
    x, y, w = F.col(moderator), F.col("yi"), F.col("w")
    means = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("k"), (F.sum(w * x) / F.sum(w)).alias("mx"), (F.sum(w * y) / F.sum(w)).alias("my"))
    dx, dy = x - F.col("mx"), y - F.col("my")
    sums = rows.join(means, KEY).groupBy(KEY, "k", "mx", "my").agg(F.sum(w * dx * dx).alias("sxx"), F.sum(w * dx * dy).alias("sxy"), F.sum(w * dy * dy).alias("syy"))
    sxx = F.when((F.col("k") >= 3) & (F.col("sxx") > 0), F.col("sxx"))
    slope = F.col("sxy") / sxx
    return sums.select(KEY, "k", (F.col("my") - slope * F.col("mx")).alias("intercept"), slope.alias("slope"), (slope * F.sqrt(sxx)).alias("z_slope"), (F.col("syy") - slope * F.col("sxy")).alias("qe"))
