"""Mixed-effects meta-regression with several moderators, and power of a random-effects test."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions import distributions as D
from evidra.functions.special import norm_cdf

from .iterative import _grouped
from .pooling import usable


def _wls(x, y, w):
    root = np.sqrt(w)[:, None]
    q, r = np.linalg.qr(x * root)
    inverse = np.linalg.inv(r)
    b = inverse @ (q.T @ (y * root[:, 0]))
    return b, inverse @ inverse.T


def residual_tau2(x, y, v) -> float:
    """The method-of-moments variance that remains beside the moderators."""
    w = 1 / v
    b, _ = _wls(x, y, w)
    qe = float((w * (y - x @ b) ** 2).sum())
    xtwx = x.T @ (x * w[:, None])
    trace = float(w.sum() - np.trace(np.linalg.solve(xtwx, x.T @ (x * (w * w)[:, None]))))
    return max(0.0, (qe - (y.size - x.shape[1])) / trace) if trace > 0 else 0.0


def design(values: dict[str, np.ndarray], categories: list[str], intercept: bool = True) -> tuple[list[str], np.ndarray]:
    """(terms, columns): the intercept, numeric moderators, and a column for each level of a category but its first in the order of
    rows. Columns that don't vary are left out."""
    n = len(next(iter(values.values())))
    names, columns = (["intercept"], [np.ones(n)]) if intercept else ([], [])
    for name, x in values.items():
        if name in categories:
            levels = list(dict.fromkeys(x.tolist()))
            made = [(f"{name}={level}", (x == level).astype(float)) for level in levels[1:]]
        else:
            made = [(name, x.astype(float))]
        for term, column in made:
            if np.ptp(column) > 0:
                names.append(term)
                columns.append(column)
    return names, np.column_stack(columns)


def perfect_fit(rss: float, tss: float, swy2: float) -> bool:
    """Whether what is left is rounding: then tests by it mean nothing."""
    return rss <= 1e-26 * tss or rss <= 1e-28 * swy2


def fit(y, v, names: list[str], x, test: str = "z") -> list[tuple]:
    """Rows (term, estimate, se, stat, df, p, se_robust, p_robust, tau2, qe, qm, k) of one analysis; none where there are not more
    studies than terms or the columns depend on each other. ``test``: z, or knha (scaled by the weighted residuals, with t);
    the robust errors are those of HC1, with t. A perfect fit has no tests."""
    k, p = x.shape
    scale = np.maximum(np.abs(x).max(axis=0), 1e-300)
    if k < p + 1 or np.linalg.matrix_rank(x / scale, tol=1e-7) < p:
        return []
    x = x / scale
    tau2 = residual_tau2(x, y, v)
    w = 1 / (v + tau2)
    b, cov = _wls(x, y, w)
    e = y - x @ b
    centre = float((w * y).sum() / w.sum())
    fixed, _c = _wls(x, y, 1 / v)
    sums = {"rss": float((w * e * e).sum()), "tss": float((w * (y - centre) ** 2).sum()), "swy2": float((w * y * y).sum()), "qe": float(((y - x @ fixed) ** 2 / v).sum())}
    return term_rows(names, b, cov, x.T @ (x * (w * w * e * e)[:, None]), sums, scale, k, tau2, test)


def term_rows(names: list[str], b, cov, meat, sums: dict[str, float], scale, k: int, tau2: float, test: str) -> list[tuple]:
    """The rows of ``fit`` from coefficients of scaled columns, their covariance, the HC1 middle and the sums of squares."""
    p = len(names)
    exact = perfect_fit(sums["rss"], sums["tss"], sums["swy2"])
    rest = [i for i, name in enumerate(names) if name != "intercept"]
    qm = float(b[rest] @ np.linalg.solve(cov[np.ix_(rest, rest)], b[rest])) if rest else 0.0
    robust = cov @ meat @ cov * k / (k - p)
    grown = sums["rss"] / (k - p) if test == "knha" else 1.0
    out = []
    for i, name in enumerate(names):
        se, hc1 = float(np.sqrt(cov[i, i] * grown)), float(np.sqrt(robust[i, i]))
        stat = float(b[i] / se) if se > 0 and not exact else None
        df = float(k - p) if test == "knha" else None
        chance = None if stat is None else float(D.t_two_sided(np.array([stat]), np.array([df]))[0]) if df else 2 * float(D.norm_cdf(-abs(stat)))
        p_robust = None if exact or hc1 == 0 else float(D.t_two_sided(np.array([b[i] / hc1]), np.array([float(k - p)]))[0])
        out.append((name, float(b[i] / scale[i]), se / float(scale[i]), stat, df, chance, hc1 / float(scale[i]), p_robust, tau2, sums["qe"], qm, k))
    return out


_FIT = "term string, estimate double, se double, stat double, df double, p double, se_robust double, p_robust double, tau2 double, qe double, qm double, k long"


def meta_regression(studies: DataFrame, moderators: list[str], categories: list[str] | None = None, test: str = "z") -> DataFrame:
    """(analysis_id, term, ...) of ``fit``, with the moment estimate of the residual variance: numeric ``moderators`` and
    ``categories``. Moderators that don't vary within an analysis are left out of it; rows with a null moderator take no part.
    An analysis is one group, so its size must be bounded."""
    categories = categories or []
    own = usable(studies)
    for m in [*moderators, *categories]:
        own = own.where(F.col(m).isNotNull())

    def run(_, y, v, *columns):
        names, x = design(dict(zip([*moderators, *categories], columns, strict=True)), categories)
        return fit(y, v, names, x, test)

    return _grouped(own, run, _FIT, ("row_index", "yi", "vi", *moderators, *categories))


def predicted(coefficients: DataFrame, points: DataFrame, level: float = 0.95) -> DataFrame:
    """(analysis_id, point, estimate): the sums of coefficients (analysis_id, term, estimate) times values of ``points`` (point, term,
    value); the intercept's value is 1 where a point does not give it."""
    every = points.select("point").distinct().withColumns({"term": F.lit("intercept"), "value": F.lit(1.0)})
    given = points.union(every.join(points.where("term = 'intercept'").select("point"), "point", "left_anti").select(*points.columns))
    return coefficients.join(given, "term").groupBy("analysis_id", "point").agg(F.sum(F.col("estimate") * F.col("value")).alias("estimate"))


#: Factors of the pooled variance for heterogeneity in words: rounded, and as exact thirds.
FACTORS = {"rounded": {"fixed": 1.0, "low": 1.33, "moderate": 1.67, "high": 2.0}, "exact": {"fixed": 1.0, "low": 4 / 3, "moderate": 5 / 3, "high": 2.0}}


def _power(factor: float, alpha: float = 0.05) -> str:
    """The two-sided z test's power for columns k, effect and v, as SQL text."""
    critical, ratio = D.norm_ppf(1 - alpha / 2), f"effect / sqrt({factor!r}e0 * v / k)"
    return f"({norm_cdf(f'({ratio} - {critical!r}e0)')} + {norm_cdf(f'(-{ratio} - {critical!r}e0)')})"


def with_variance(designs: DataFrame) -> DataFrame:
    """``designs`` (effect, n1, n2) with v, the variance of one study's standardised mean difference."""
    n1, n2, d = F.col("n1"), F.col("n2"), F.col("effect")
    return designs.withColumn("v", (n1 + n2) / (n1 * n2) + d * d / (2 * (n1 + n2)))


def power(grid: DataFrame, factors: str = "rounded", alpha: float = 0.05) -> DataFrame:
    """``grid`` (k, effect, n1, n2) with the power of the pooled effect's test at each degree of heterogeneity."""
    return with_variance(grid).withColumns({name: F.expr(_power(f, alpha)) for name, f in FACTORS[factors].items()}).drop("v")


def studies_needed(designs: DataFrame, heterogeneity: str = "fixed", target: float = 0.8, most: int = 1 << 17, factors: str = "rounded", alpha: float = 0.05) -> DataFrame:
    """``designs`` with k, the least number of studies that reaches the target power, null beyond ``most``: by halving, for power
    grows with k."""
    test, rows = _power(FACTORS[factors][heterogeneity], alpha), with_variance(designs).withColumns({"low": F.lit(0.0), "high": F.lit(float(most))})
    for _ in range(most.bit_length() - 1):
        rows = rows.withColumn("k", F.floor((F.col("low") + F.col("high")) / 2).cast("double"))
        reached = F.expr(test) >= target
        rows = rows.withColumns({"low": F.when(reached, F.col("low")).otherwise(F.col("k")), "high": F.when(reached, F.col("k")).otherwise(F.col("high"))})
    rows = rows.withColumn("k", F.col("high"))
    return rows.withColumn("k", F.when(F.expr(test) >= target, F.col("high")).cast("long")).drop("low", "high", "v")
