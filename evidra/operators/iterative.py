"""Estimates that refit an analysis many times, in one grouped map: trim and fill, and influence.

An analysis is a group in one task, so its size must be bounded (some thousands of studies); the number of analyses is
not. Single fits, whatever the size, are in ``evidra.operators.profiles``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidra.functions import distributions as D

from .pooling import KEY, usable
from .titles import many_parts


def _mean(y, v, tau2):
    w = 1 / (v + tau2)
    return float((w * y).sum() / w.sum()), w


def q_at(y, v, tau2) -> float:
    mu, w = _mean(y, v, tau2)
    return float((w * (y - mu) ** 2).sum())


def _root_of_q(y, v, goal: float) -> float:
    """The tau2 at which Q, which falls with it, is ``goal``; 0 where it starts below."""
    if q_at(y, v, 0.0) <= goal:
        return 0.0
    high = max(1e-6, float(np.var(y)))
    while q_at(y, v, high) > goal and high < 1e12:
        high *= 2
    low = 0.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if q_at(y, v, middle) > goal else (low, middle)
    return (low + high) / 2


def tau2_pm(y, v) -> float:
    return _root_of_q(y, v, y.size - 1) if y.size > 1 else 0.0


def loglik(y, v, tau2, restricted: bool) -> float:
    mu, w = _mean(y, v, tau2)
    out = -0.5 * float(np.log(v + tau2).sum() + (w * (y - mu) ** 2).sum())
    return out - 0.5 * math.log(float(w.sum())) if restricted else out


def tau2_likelihood(y, v, restricted: bool = True) -> float:
    """The global maximum: a logarithmic grid and zero, then golden section about the best point."""
    if y.size < 2:
        return 0.0
    scale = max(float(np.var(y, ddof=1)), float(v.mean()), 1e-12)
    grid = np.concatenate(([0.0], scale * np.logspace(-8, 3, 100)))
    values = [loglik(y, v, t, restricted) for t in grid]
    k = int(np.argmax(values))
    low, high = grid[max(0, k - 1)], grid[min(grid.size - 1, k + 1)]
    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = loglik(y, v, a, restricted), loglik(y, v, b, restricted)
    for _ in range(150):
        if fa >= fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = loglik(y, v, a, restricted)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = loglik(y, v, b, restricted)
    best = (low + high) / 2
    return 0.0 if values[0] >= loglik(y, v, best, restricted) else best


def tau2_dl(y, v) -> float:
    w = 1 / v
    c = w.sum() - (w * w).sum() / w.sum()
    return max(0.0, (q_at(y, v, 0.0) - (y.size - 1)) / c) if y.size > 1 and c > 0 else 0.0


METHODS = {"FE": lambda y, v: 0.0, "DL": tau2_dl, "PM": tau2_pm, "REML": lambda y, v: tau2_likelihood(y, v), "ML": lambda y, v: tau2_likelihood(y, v, False)}


def _grouped(studies: DataFrame, fn, schema: str, columns: tuple[str, ...] = ("row_index", "yi", "vi")) -> DataFrame:
    """``fn(arrays by column) -> rows`` for each analysis, in the order of row_index."""
    rows = usable(studies).select(KEY, *columns)
    kind = dict(rows.dtypes)[KEY]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("row_index")
        found = fn(*[group.column(c).to_numpy() for c in columns])
        return pa.Table.from_pylist([{KEY: key[0].as_py()} | dict(zip(names, row, strict=True)) for row in found], schema=target)

    full = f"{KEY} {kind}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(full))
    # The work of an analysis is not in its bytes, so its partitions are not to be put together by their size.
    return rows.repartition(many_parts(rows), KEY).groupBy(KEY).applyInArrow(run, full)


def side_slope(y, v, method: str) -> float:
    """The slope of y on the root of v in a meta-regression whose residual variance ``method`` estimates (0 for FE, else moments for
    DL, restricted likelihood for others)."""
    x = np.column_stack([np.ones(y.size), np.sqrt(v)])

    def fit(tau2):
        w = 1 / (v + tau2)
        xtwx = x.T @ (x * w[:, None])
        return np.linalg.solve(xtwx, x.T @ (w * y)), xtwx, w

    if method == "FE":
        return float(fit(0.0)[0][1])
    if method == "DL":
        b, xtwx, w = fit(0.0)
        trace = w.sum() - np.trace(np.linalg.solve(xtwx, x.T @ (x * (w * w)[:, None])))
        return float(fit(max(0.0, (float((w * (y - x @ b) ** 2).sum()) - (y.size - 2)) / trace) if trace > 0 else 0.0)[0][1])

    def likelihood(tau2):
        b, xtwx, w = fit(tau2)
        return -0.5 * (np.log(v + tau2).sum() + np.linalg.slogdet(xtwx)[1] + (w * (y - x @ b) ** 2).sum())

    low, high = 0.0, 2 * float(((y - y.mean()) ** 2).sum()) + 2 * float(v.max())
    grid = np.concatenate(([0.0], high * np.logspace(-10, 0, 200)))
    for _ in range(8):
        k = int(np.argmax([likelihood(t) for t in grid]))
        low, high = grid[max(0, k - 1)], grid[min(grid.size - 1, k + 1)]
        grid = np.linspace(low, high, 21)
    return float(fit((low + high) / 2)[0][1])


def missing_studies(z, v, method: str, estimator: str) -> tuple[int, float]:
    """(k0, centre) of effects sorted so that studies are missing below: the number to trim from the top, by L0 or R0."""
    k, k0, before, tol = z.size, 0, -1, 1e-12 * float(np.abs(z).max())
    centre = 0.0
    for _turn in range(100):
        if k0 == before:
            break
        before = k0
        kept = slice(0, max(k - k0, 1))
        centre, _w = _mean(z[kept], v[kept], METHODS[method](z[kept], v[kept]))
        gaps = z - centre
        ranks = np.empty(k)
        ranks[np.argsort(np.abs(gaps), kind="stable")] = np.arange(1, k + 1)
        above = gaps > tol
        if estimator == "R0":
            top = np.flatnonzero(~above[np.argsort(-ranks)])
            found = (int(top[0]) if top.size else k) - 1
        else:
            found = (4 * ranks[above].sum() - k * (k + 1)) / (2 * k - 1)
        k0 = min(k - 1, max(0, round(float(found))))
    return k0, centre


def trim_and_fill(studies: DataFrame, method: str = "REML", estimator: str = "L0", trim_method: str | None = None) -> DataFrame:
    """(analysis_id, k, k0, side, estimate, filled_estimate, filled_se): the missing studies, mirrored about the trimmed mean, and the
    model refitted with them. The side is right where the slope of effects on standard errors is negative, with the residual
    variance of the trimming model (``trim_method``, the model's own if null). Fewer than three studies, equal effects or equal
    variances have no side."""
    own = trim_method or method

    def fit(_, y, v):
        k = y.size
        mu, w = _mean(y, v, METHODS[method](y, v))
        if k < 3 or np.ptp(y) <= 1e-12 * float(np.abs(y).max()) or np.ptp(v) <= 1e-12 * float(v.max()):
            return [(k, None, None, mu, None, None)]
        side = "right" if side_slope(y, v, own) < 0 else "left"
        sign = -1.0 if side == "right" else 1.0
        order = np.argsort(sign * y, kind="stable")
        z, u = sign * y[order], v[order]
        k0, centre = missing_studies(z, u, own, estimator)
        full_y, full_v = np.concatenate([y, sign * (2 * centre - z[k - k0 :])]), np.concatenate([v, u[k - k0 :]])
        filled, w = _mean(full_y, full_v, METHODS[method](full_y, full_v))
        return [(k, k0, side, mu, filled, math.sqrt(1 / w.sum()))]

    return _grouped(studies, fit, "k long, k0 long, side string, estimate double, filled_estimate double, filled_se double")


def influence(studies: DataFrame, method: str = "REML") -> DataFrame:
    """(analysis_id, row_index, rstudent, dffits, cook, cov_ratio, tau2_del, q_del, hat, dfbetas, flagged) of each study, from
    refits without it; analyses of three studies or more."""

    def fit(rows, y, v):
        k = y.size
        if k < 3:
            return []
        tau2 = METHODS[method](y, v)
        mu, w = _mean(y, v, tau2)
        out = []
        for i in range(k):
            keep = np.arange(k) != i
            t_del = METHODS[method](y[keep], v[keep])
            mu_del, w_del = _mean(y[keep], v[keep], t_del)
            var_del = 1 / w_del.sum()
            hat = w[i] / w.sum()
            student = (y[i] - mu_del) / math.sqrt(v[i] + t_del + var_del)
            shift = mu - mu_del
            dffits = shift / math.sqrt(hat * (v[i] + t_del))
            cook = shift * shift * w.sum()
            flagged = abs(dffits) > 3 * math.sqrt(1 / (k - 1)) or cook > 0.4549364231195724 or hat > 3 / k or abs(shift / math.sqrt(var_del)) > 1
            out.append((int(rows[i]), student, dffits, cook, var_del * w.sum(), t_del, q_at(y[keep], v[keep], 0.0), hat, shift / math.sqrt(var_del), bool(flagged)))
        return out

    return _grouped(studies, fit, "row_index long, rstudent double, dffits double, cook double, cov_ratio double, tau2_del double, q_del double, hat double, dfbetas double, flagged boolean")
