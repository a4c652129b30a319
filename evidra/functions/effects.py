"""Effect sizes and variances as column expressions; a row that cannot give one gets nulls, never an error."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z975 = 1.959963984540054


def _if(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0: eight steps of the recurrence, then Stirling's series."""
    y, steps = x + 8.0, x
    for k in range(1, 8):
        steps = steps * (x + float(k))
    series = 1.0 / (12.0 * y) - 1.0 / (360.0 * F.pow(y, 3)) + 1.0 / (1260.0 * F.pow(y, 5)) - 1.0 / (1680.0 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def hedges_j(m: Column, method: str = "exact") -> Column:
    """The small-sample factor of ``m`` > 1 degrees of freedom: exact, or the usual approximation 1 - 3 / (4 m - 1)."""
    if method == "approx":
        return _if(m > 1, 1.0 - 3.0 / (4.0 * m - 1.0))
    own = F.when(m > 1, m)
    return F.exp(log_gamma(own / 2.0) - 0.5 * F.log(own / 2.0) - log_gamma((own - 1.0) / 2.0))


def pooled_sd(sd1: Column, n1: Column, sd2: Column, n2: Column) -> Column:
    return _if(n1 + n2 > 2, F.sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / F.nullif(n1 + n2 - 2, F.lit(0.0))))


def md(m1, sd1, n1, m2, sd2, n2, pooled: bool = False) -> tuple[Column, Column]:
    if pooled:
        sp = pooled_sd(sd1, n1, sd2, n2)
        return m1 - m2, sp * sp * (1.0 / n1 + 1.0 / n2)
    return m1 - m2, sd1 * sd1 / n1 + sd2 * sd2 / n2


def smd_variance(y, n1, n2, vtype: str = "LS", j: Column | None = None, j_method: str = "exact", d: Column | None = None) -> Column:
    """The sampling variance of a standardised mean difference from its estimate and the arms' sizes: LS, LS2, UB, METAN_COHEN or
    METAN_HEDGES. LS2 takes the factor ``j`` of the estimate and the uncorrected ``d`` where they are given."""
    n, m = n1 + n2, n1 + n2 - 2
    if vtype == "LS":
        return 1.0 / n1 + 1.0 / n2 + y * y / (2.0 * n)
    if vtype == "METAN_COHEN":
        return _if(n > 2, n / (n1 * n2) + y * y / (2.0 * F.nullif(n - 2.0, F.lit(0.0))))
    if vtype == "METAN_HEDGES":
        return _if(n > 3.94, n / (n1 * n2) + y * y / (2.0 * F.nullif(n - 3.94, F.lit(0.0))))
    own = hedges_j(m, j_method)
    if vtype == "LS2":
        j = own if j is None else j
        d = y / j if d is None else d
        return j * j * (n / (n1 * n2) + d * d / (2.0 * n))
    if vtype == "UB":
        return 1.0 / n1 + 1.0 / n2 + (1.0 - (m - 2) / (F.nullif(m, F.lit(0.0)) * own * own)) * y * y
    raise ValueError(f"no variance {vtype}")


def smd(m1, sd1, n1, m2, sd2, n2, vtype: str = "LS", correct: bool = True, j_method: str = "exact") -> tuple[Column, Column]:
    """Hedges' g, or Cohen's d without ``correct``. METAN_HEDGES always takes the approximate factor."""
    d = (m1 - m2) / F.nullif(pooled_sd(sd1, n1, sd2, n2), F.lit(0.0))
    j = hedges_j(n1 + n2 - 2, "approx" if vtype == "METAN_HEDGES" else j_method) if correct else F.lit(1.0)
    return j * d, smd_variance(j * d, n1, n2, vtype, j, j_method, d)


def glass(m1, sd1, n1, m2, sd2, n2, vtype: str = "METAN", correct: bool | None = None, j_method: str = "exact") -> tuple[Column, Column]:
    """Glass' delta by the second arm's SD: METAN (uncorrected), LS, LS2, UB or SMD1H (unequal SDs)."""
    m, delta = n2 - 1.0, (m1 - m2) / F.when(sd2 > 0, sd2)
    c = hedges_j(m, j_method) if (vtype != "METAN" if correct is None else correct) else F.lit(1.0)
    y = c * delta
    made = {
        "METAN": lambda: (n1 + n2) / (n1 * n2) + y * y / (2.0 * F.nullif(m, F.lit(0.0))),
        "LS": lambda: 1.0 / n1 + 1.0 / n2 + y * y / (2.0 * n2),
        "LS2": lambda: c * c * (1.0 / n1 + 1.0 / n2 + delta * delta / (2.0 * n2)),
        "UB": lambda: 1.0 / n1 + 1.0 / n2 + (1.0 - (m - 2) / (F.nullif(m, F.lit(0.0)) * c * c)) * y * y,
        "SMD1H": lambda: sd1 * sd1 / (F.when(sd2 > 0, sd2) * sd2) / n1 + 1.0 / n2 + y * y / (2.0 * n2),
    }
    return y, made[vtype]()


def rom(m1, sd1, n1, m2, sd2, n2) -> tuple[Column, Column]:
    ok = (m1 > 0) & (m2 > 0)
    return _if(ok, F.log(F.when(ok, m1 / m2))), _if(ok, sd1 * sd1 / (n1 * m1 * m1) + sd2 * sd2 / (n2 * m2 * m2))


def mean_change(mdiff, sd_diff, n) -> tuple[Column, Column]:
    ok = (n >= 2) & (sd_diff > 0)
    return _if(ok, mdiff), _if(ok, sd_diff * sd_diff / n)


def smcc(mdiff, sd_diff, n, vtype: str = "LS", correct: bool = True, j_method: str = "exact") -> tuple[Column, Column]:
    """The mean change by the SD of the changes, corrected with n - 1 degrees of freedom; the variance LS or LS2."""
    d = mdiff / F.when(sd_diff > 0, sd_diff)
    j = hedges_j(n - 1, j_method) if correct else F.lit(1.0)
    y = j * d
    return y, 1.0 / n + y * y / (2.0 * n) if vtype == "LS" else j * j * (1.0 / n + d * d / (2.0 * n))


def paired_inputs(row: dict[str, Column]) -> tuple[Column, Column]:
    """(mean change, SD of the changes): the first complete of m1 - m2, mdiff and sum_d / n, and of sd_diff, both SDs with r, and
    the root of sum_sq_dev_d / (n - 1)."""
    r = row["r"]
    v = row["sd1"] * row["sd1"] + row["sd2"] * row["sd2"] - 2.0 * r * row["sd1"] * row["sd2"]
    by_r = F.sqrt(F.when((r >= -1) & (r <= 1) & (row["sd1"] >= 0) & (row["sd2"] >= 0) & (v > 0), v))
    by_sum = F.sqrt(F.when((row["n"] >= 2) & (row["sum_sq_dev_d"] >= 0), row["sum_sq_dev_d"] / (row["n"] - 1.0)))
    given = row["sd1"].isNotNull() & row["sd2"].isNotNull() & r.isNotNull()
    sd = F.when(row["sd_diff"].isNotNull(), row["sd_diff"]).when(given, by_r).otherwise(by_sum)
    return F.coalesce(row["m1"] - row["m2"], row["mdiff"], row["sum_d"] / row["n"]), sd


def sd_diff(sd1, sd2, r) -> Column:
    return F.sqrt(sd1 * sd1 + sd2 * sd2 - 2.0 * r * sd1 * sd2)


def two_by_two(measure: str, e1, n1, e2, n2, cc: float = 0.5) -> tuple[Column, Column]:
    """OR, RR (logs) or RD. ``cc`` is added to all cells where one is zero; a double zero or double full table gives none for
    ratios. RD is corrected only where its variance would be zero."""
    a, b, c, d = e1, n1 - e1, e2, n2 - e2
    zero = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    both = ((a == 0) & (c == 0)) | ((b == 0) & (d == 0))
    add = F.when(zero, cc).otherwise(0.0)
    a, b, c, d = a + add, b + add, c + add, d + add
    if measure == "OR":
        return _if(~both, F.log(F.when(~both, a * d / (b * c)))), _if(~both, 1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)
    if measure == "RR":
        return _if(~both, F.log(F.when(~both, a / (a + b) / (c / (c + d))))), _if(~both, 1.0 / a - 1.0 / (a + b) + 1.0 / c - 1.0 / (c + d))
    plain = e1 / n1 * (1 - e1 / n1) / n1 + e2 / n2 * (1 - e2 / n2) / n2
    p1, p2 = a / (a + b), c / (c + d)
    return e1 / n1 - e2 / n2, F.when(plain > 0, plain).otherwise(p1 * (1 - p1) / (a + b) + p2 * (1 - p2) / (c + d))


def proportion(measure: str, x, n, cc: float = 0.5) -> tuple[Column, Column]:
    """PR, PLN, PLO, PAS, PFT; (cc, 2 cc) is added where x is 0 or n, for the first three."""
    if measure == "PAS":
        return F.asin(F.sqrt(x / n)), 1.0 / (4.0 * n)
    if measure == "PFT":
        return 0.5 * (F.asin(F.sqrt(x / (n + 1))) + F.asin(F.sqrt((x + 1) / (n + 1)))), 1.0 / (4.0 * n + 2.0)
    edge = (x == 0) | (x == n)
    x, n = x + F.when(edge, cc).otherwise(0.0), n + F.when(edge, 2 * cc).otherwise(0.0)
    p = x / n
    return {"PR": (p, p * (1 - p) / n), "PLN": (log(p), 1.0 / x - 1.0 / n), "PLO": (log(x / (n - x)), 1.0 / x + 1.0 / (n - x))}[measure]


def correlation(measure: str, r, n) -> tuple[Column, Column]:
    ok = (n > 3) & (r > -1) & (r < 1)
    if measure == "COR":
        return _if(ok, r), _if(ok, (1 - r * r) * (1 - r * r) / (n - 1))
    return _if(ok, 0.5 * F.log(F.when(ok, (1 + r) / (1 - r)))), _if(ok, 1.0 / (n - 3))


def pft_inverse(t: Column, n: Column) -> Column:
    """Miller's inverse of the double arcsine (half the sum) at the size ``n``: 0 and 1 at and beyond the ends of its range."""
    low, high = 0.5 * F.asin(F.sqrt(1.0 / (n + 1))), 0.5 * (F.asin(F.sqrt(n / (n + 1))) + math.pi / 2)
    s, c = F.sin(2.0 * t), F.cos(2.0 * t)
    inner = s + (s - 1.0 / s) / n
    made = 0.5 * (1.0 - F.signum(c) * F.sqrt(F.greatest(F.lit(0.0), 1.0 - inner * inner)))
    return F.when(t <= low, 0.0).when(t >= high, 1.0).otherwise(made)


def back_transform(measure: str, y: Column, n: Column | None = None) -> Column:
    """From the scale of analysis to that of display; PFT needs a size ``n`` (the harmonic mean, or 1 / (4 se^2))."""
    if measure == "PFT":
        return pft_inverse(y, n)
    if measure in ("OR", "RR", "ROM", "PLN"):
        return F.exp(y)
    if measure == "PLO":
        return 1.0 / (1.0 + F.exp(-y))
    if measure == "PAS":
        return F.sin(y) * F.sin(y)
    if measure == "ZCOR":
        return F.tanh(y)
    return y


def logor_to_d(y: Column, v: Column) -> tuple[Column, Column]:
    return y * (math.sqrt(3) / math.pi), v * (3 / math.pi**2)


def r_to_d(r: Column, v: Column) -> tuple[Column, Column]:
    ok = (r > -1) & (r < 1)
    return _if(ok, 2 * r / F.sqrt(F.when(ok, 1 - r * r))), _if(ok, 4 * v / F.pow(F.when(ok, 1 - r * r), 3))


def d_to_logor(d: Column, v: Column) -> tuple[Column, Column]:
    return d * (math.pi / math.sqrt(3)), v * (math.pi**2 / 3)


def d_to_r(d: Column, v: Column, n1: Column, n2: Column) -> tuple[Column, Column]:
    """r = d / sqrt(d^2 + a) with a = (n1 + n2)^2 / (n1 n2), and its variance by the delta method."""
    a = (n1 + n2) * (n1 + n2) / (n1 * n2)
    return d / F.sqrt(d * d + a), a * a * v / F.pow(d * d + a, 3)


def d_from_t(t: Column, n1: Column, n2: Column) -> Column:
    return t * F.sqrt(1.0 / n1 + 1.0 / n2)


def sd_diff_from_t(t: Column, n1: Column, n2: Column, mean_diff: Column) -> Column:
    """The common SD that a t statistic of a mean difference means."""
    return F.abs(mean_diff / F.nullif(t, F.lit(0.0))) / F.sqrt(1.0 / n1 + 1.0 / n2)


def paired_from_sums(n: Column, sum_d: Column, sum_sq_dev: Column) -> tuple[Column, Column]:
    return sum_d / n, F.sqrt(F.when((n > 1) & (sum_sq_dev >= 0), sum_sq_dev / (n - 1.0)))


def corr_from_change(sd_baseline: Column, sd_final: Column, sd_change: Column) -> Column:
    """The correlation that three SDs mean; null where they break the triangle inequality."""
    r = (sd_baseline * sd_baseline + sd_final * sd_final - sd_change * sd_change) / F.nullif(2.0 * sd_baseline * sd_final, F.lit(0.0))
    return F.when((r >= -1) & (r <= 1), r)


def ratio_stat(estimate: Column, se: Column) -> Column:
    """estimate / se: not a number for 0 / 0, infinite with the estimate's sign where only se is 0."""
    inf = float("inf")
    zero = F.when(estimate == 0, F.lit(float("nan"))).otherwise(F.signum(estimate) * F.lit(inf))
    return F.when(se == 0, zero).otherwise(estimate / F.nullif(se, F.lit(0.0)))


def normal_level(level: Column) -> Column:
    """Confidence levels above 1 are percent; null outside 0 to 1."""
    x = F.when(level > 1, level / 100.0).otherwise(level)
    return F.when((x > 0) & (x < 1), x)


def common_decimals(values: list[Column], least: int = 2, most: int = 6) -> Column:
    """Decimals for values shown together, from ``least`` to ``most``: two significant digits of the greatest."""
    top = F.greatest(*[F.abs(x) for x in values])
    need = 1 - F.floor(F.log10(F.when(top > 0, top)))
    return F.coalesce(F.least(F.lit(most), F.greatest(F.lit(least), need)), F.lit(least)).cast("int")


def combine_groups(n1, m1, sd1, n2, m2, sd2) -> tuple[Column, Column, Column]:
    """Size, mean and SD of two groups taken together."""
    n = n1 + n2
    m = (n1 * m1 + n2 * m2) / n
    return n, m, F.sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2 + n1 * n2 / n * (m1 - m2) * (m1 - m2)) / (n - 1))
