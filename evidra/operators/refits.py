"""Leave-one-out and cumulative random-effects fits of analyses of any size, for variances that need iteration, and cumulative DL fits.

The sums that a fit needs are taken for all studies of an analysis at shared points of the variance, part by part: the sums of a
fit without one study are those of all less its own, the sums of a growing prefix those of the parts before and of its part
up to there. Each fit then looks up where its score changes sign between points, with a polynomial through six of them, so the
work is the number of studies times the number of points, never the square of an analysis. The variance of DL is in the sums at 0, and
the sums at that variance in a polynomial through Chebyshev's points.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.sources.shared import stored

from .pooling import KEY, usable, weighted
from .ranking import global_places

#: Points of the variance, besides 0, over ten decades; studies of a part.
POINTS, PART_ROWS, NODES = 240, 2048, 6
#: Chebyshev's points of DL: sums differ by about 1e-12 of their size where the variance is up to 1e12 times the least one of a study.
DL_POINTS = 128
_SUMS = 7  # of w, wy, wyy, ww, wwy, wwyy and log variance


def grid(high: float) -> np.ndarray:
    return np.concatenate(([0.0], high * np.logspace(-10, 0, POINTS)))


def dl_grid(low: float, high: float) -> np.ndarray:
    """0 and Chebyshev's points, on the scale of log(tau2 + low), of variances up to ``high``; ``low`` is the least one of a study."""
    at = np.cos((2 * np.arange(DL_POINTS) + 1) * np.pi / (2 * DL_POINTS))
    return np.concatenate(([0.0], low * np.expm1((at + 1) / 2 * math.log1p(high / low))))


def terms(y: np.ndarray, v: np.ndarray, points: np.ndarray) -> np.ndarray:
    """float[studies, points, sums]: what each study adds."""
    w = 1.0 / (v[:, None] + points)
    y = y[:, None]
    return np.stack([w, w * y, w * y * y, w * w, w * w * y, w * w * y * y, -np.log(w)], axis=2)


def _functions(s: np.ndarray, k: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """(score, likelihood) at sums [..., 7]; for PM the score is Q less k - 1."""
    w, wy, wyy, ww, wwy, wwyy, log = np.moveaxis(s, -1, 0)
    mu = wy / w
    q = np.maximum(wyy - mu * wy, 0.0)
    square = wwyy - 2 * mu * wwy + mu * mu * ww
    if method == "PM":
        return q - (k - 1), q
    score = square - w + (ww / w if method == "REML" else 0.0)
    return score, -0.5 * (log + q + (np.log(w) if method == "REML" else 0.0))


def _weights(nodes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """float[rows, nodes]: Lagrange's coefficients of nodes [rows, nodes] at one place each."""
    out = np.ones(nodes.shape)
    for i in range(nodes.shape[1]):
        for j in range(nodes.shape[1]):
            if i != j:
                out[:, i] *= (at - nodes[:, j]) / (nodes[:, i] - nodes[:, j])
    return out


def solve(sums: np.ndarray, k: np.ndarray, points: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tau2, mean, weight) of fits with sums [fits, points, 7] of ``k`` studies each."""
    n, rows = points.size, np.arange(k.size)
    score, value = _functions(sums, k[:, None], method)
    if method == "PM":
        last = n - 1 - np.argmax((score > 0)[:, ::-1], axis=1)
        none = ~(score > 0).any(axis=1)
        left = np.where(none, 0, np.minimum(last, n - 2))
    else:
        best = np.argmax(value, axis=1)
        left = np.clip(np.where(score[rows, best] > 0, best, best - 1), 0, n - 2)
        none = (best == 0) & (score[:, 0] <= 0)
    none |= k < 2
    zero = none | (left == 0)  # below the first point, 1e-10 of the bound, it counts as 0
    first = np.clip(left - NODES // 2 + 1, 1, n - NODES)
    index = first[:, None] + np.arange(NODES)
    nodes, held = np.log(points[index]), np.take_along_axis(score, index, axis=1)
    low, high = np.log(points[np.maximum(left, 1)]), np.log(points[np.maximum(left, 1) + 1 - (left == n - 1)])
    for _ in range(60):
        middle = (low + high) / 2
        rises = (_weights(nodes, middle) * held).sum(axis=1) > 0
        low, high = np.where(rises, middle, low), np.where(rises, high, middle)
    at = (low + high) / 2
    share = _weights(nodes, at)
    tau2 = np.where(zero, 0.0, np.exp(at))
    w, wy = (np.where(zero, sums[:, 0, c], (share * np.take_along_axis(sums[:, :, c], index, axis=1)).sum(axis=1)) for c in (0, 1))
    return tau2, wy / w, w


def solve_dl(sums: np.ndarray, k: np.ndarray, points: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tau2, mean, weight) of DL fits with sums [fits, points, 7] of ``k`` studies each, at the points of ``dl_grid``."""
    w, wy, wyy, ww = np.moveaxis(sums[:, 0, :4], -1, 0)
    q, c = np.maximum(wyy - wy * wy / w, 0.0), w - ww / w
    some = (k > 1) & (c > 0)
    tau2 = np.where(some, np.maximum(q - (k - 1), 0.0) / np.where(some, c, 1.0), 0.0)
    w, wy = w.copy(), wy.copy()
    rows = np.flatnonzero(tau2 > 0)
    if rows.size:
        # (tau2 + low) times a sum is smooth on this scale, whatever the studies' variances.
        turn = np.arange(DL_POINTS)
        share = (-1.0) ** turn * np.sin((2 * turn + 1) * np.pi / (2 * DL_POINTS))
        gap = np.log1p(tau2[rows] / low)[:, None] - np.log1p(points[1:] / low)
        share = share / np.where(gap == 0, 1e-300, gap)
        share /= share.sum(axis=1)[:, None]
        scale = points[1:] + low
        w[rows], wy[rows] = ((share * sums[rows, 1:, c] * scale).sum(axis=1) / (tau2[rows] + low) for c in (0, 1))
    return tau2, wy / w, w


def _bounds(studies: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    most = usable(studies).groupBy(KEY).agg(F.max("vi").alias("v"))
    moments = weighted(studies) if moments is None else moments
    return moments.join(most, KEY).select(KEY, F.col("k").alias("n_all"), "mean_y", (2 * F.col("ss") + 2 * F.col("v")).alias("high"))


def estimated(studies: DataFrame, moments: DataFrame, method: str) -> DataFrame:
    """(analysis_id, tau2) by PM, ML or REML of analyses of two or more: one pass over parts of PART_ROWS studies, and one over the
    sums of those analyses that have several parts. ``moments`` are those of ``pooling.weighted``."""
    bounds = _bounds(studies, moments).where("n_all > 1")
    rows = usable(studies).join(bounds, KEY).withColumn("part", F.pmod(F.xxhash64("row_index"), F.ceil(F.col("n_all") / PART_ROWS)))
    rows = rows.select(KEY, "part", (F.col("yi") - F.col("mean_y")).alias("yc"), "vi", "n_all", "high")
    kind = dict(rows.dtypes)[KEY]
    schema = f"{KEY} {kind}, n long, high double, tau2 double, sums array<double>"

    def total(key: tuple, group: pa.Table) -> pa.Table:
        high, n = group.column("high")[0].as_py(), group.column("n_all")[0].as_py()
        points = grid(high)
        sums = np.zeros((points.size, _SUMS))
        y, v = (group.column(c).to_numpy() for c in ("yc", "vi"))
        for i in range(0, y.size, 256):
            sums += terms(y[i : i + 256], v[i : i + 256], points).sum(axis=0)
        whole = y.size == n
        found = [float(solve(sums[None], np.array([n]), points, method)[0][0])] if whole else [None]
        return pa.table({KEY: pa.array([key[0].as_py()], group.schema.field(KEY).type), "n": [n], "high": [high], "tau2": pa.array(found, pa.float64()), "sums": pa.array([None if whole else sums.reshape(-1)], pa.list_(pa.float64()))})

    def together(key: tuple, group: pa.Table) -> pa.Table:
        points = grid(group.column("high")[0].as_py())
        sums = sum(np.array(x.as_py()) for x in group.column("sums")).reshape(1, points.size, _SUMS)
        tau2 = solve(sums, np.array([group.column("n")[0].as_py()]), points, method)[0]
        return pa.table({KEY: pa.array([key[0].as_py()], group.schema.field(KEY).type), "tau2": tau2})

    parts = stored(rows.groupBy(KEY, "part").applyInArrow(total, schema), "part-sums")
    several = parts.where("tau2 IS NULL").select(KEY, "n", "high", "sums").groupBy(KEY).applyInArrow(together, f"{KEY} {kind}, tau2 double")
    return parts.where("tau2 IS NOT NULL").select(KEY, "tau2").union(several)


def _fitted(studies: DataFrame, method: str, order: str | None) -> DataFrame:
    if method not in ("PM", "ML", "REML") and (method, order is None) != ("DL", False):
        raise ValueError(f"{method} has a closed form")
    rows = usable(studies)
    if method == "DL":
        # No prefix has a greater variance: Q / C is a mean of the halved squares of its effects' differences.
        gap = F.max("yi") - F.min("yi")
        bounds = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_all"), F.avg("yi").alias("mean_y"), (gap * gap / 2).alias("high"), F.min("vi").alias("low"))
    else:
        bounds = _bounds(studies).withColumn("low", F.lit(0.0))
    if order is None:
        rows = rows.join(bounds, KEY).withColumn("part", F.pmod(F.xxhash64("row_index"), F.ceil(F.col("n_all") / PART_ROWS))).withColumn("place", F.lit(0).cast("long"))
    else:
        numbered = global_places(rows.select(KEY, "row_index", "yi", "vi", F.col(order).alias("at")), [F.asc(KEY), F.asc_nulls_last("at"), F.asc("row_index")])
        rows = numbered.withColumn("part", F.floor(F.col("place") / PART_ROWS)).join(bounds, KEY)
    rows = stored(rows.select(KEY, "part", "place", "row_index", (F.col("yi") - F.col("mean_y")).alias("yc"), "vi", "n_all", "mean_y", "high", "low"), "refits")
    kind = dict(rows.dtypes)[KEY]
    names = [f"s{c}" for c in range(_SUMS)]

    def points_of(group: pa.Table) -> np.ndarray:
        low, high = (group.column(c)[0].as_py() for c in ("low", "high"))
        return dl_grid(low, high) if method == "DL" else grid(high)

    def solved(sums: np.ndarray, k: np.ndarray, points: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return solve_dl(sums, k, points, low) if method == "DL" else solve(sums, k, points, method)

    def total(key: tuple, group: pa.Table) -> pa.Table:
        points = points_of(group)
        sums = np.zeros((points.size, _SUMS))
        y, v = (group.column(c).to_numpy() for c in ("yc", "vi"))
        for i in range(0, y.size, 256):
            sums += terms(y[i : i + 256], v[i : i + 256], points).sum(axis=0)
        size = [y.size] * points.size
        return pa.table({KEY: pa.array([key[0].as_py()] * points.size, group.schema.field(KEY).type), "part": pa.array([key[1].as_py()] * points.size, pa.int64()), "g": np.arange(points.size, dtype=np.int32), "n": pa.array(size, pa.int64()), **{names[c]: sums[:, c] for c in range(_SUMS)}})

    sums = ", ".join(f"{c} double" for c in names)
    parts = stored(rows.groupBy(KEY, "part").applyInArrow(total, f"{KEY} {kind}, part long, g int, n long, {sums}"), "part-sums")
    every = [F.sum(c).alias(c) for c in ("n", *names)]
    if order is None:
        base = parts.select(KEY, "part").distinct().join(parts.groupBy(KEY, "g").agg(*every), KEY)
    else:
        before = Window.partitionBy(KEY, "g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = parts.select(KEY, "part", "g", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", *names)])

    def fit(key: tuple, group: pa.Table, held: pa.Table) -> pa.Table:
        group, held = group.sort_by([("place", "ascending"), ("row_index", "ascending")]), held.sort_by("g")
        points, low = points_of(group), group.column("low")[0].as_py()
        y, v = (group.column(c).to_numpy() for c in ("yc", "vi"))
        start = np.column_stack([held.column(c).to_numpy() for c in names])
        n, made = held.column("n")[0].as_py(), []
        for i in range(0, y.size, 256):
            own = terms(y[i : i + 256], v[i : i + 256], points)
            if order is None:
                sums, k = start - own, np.full(own.shape[0], n - 1)
                sums[k == 0] = own[k == 0]  # nothing is left: the study itself, which the caller leaves out
            else:
                sums = start + np.cumsum(own, axis=0)
                start, k = sums[-1], n + 1 + i + np.arange(own.shape[0])
            made.append((k, *solved(sums, k, points, low)))
        k, tau2, mean, weight = (np.concatenate(x) for x in zip(*made, strict=True))
        return pa.table({KEY: group.column(KEY), "row_index": group.column("row_index"), "k": pa.array(k, pa.int64()), "tau2": tau2, "estimate": mean + group.column("mean_y")[0].as_py(), "se": 1 / np.sqrt(weight)})

    index = dict(rows.dtypes)["row_index"]
    return rows.groupBy(KEY, "part").cogroup(base.groupBy(KEY, "part")).applyInArrow(fit, f"{KEY} {kind}, row_index {index}, k long, tau2 double, estimate double, se double")


def leave_one_out(studies: DataFrame, method: str = "REML") -> DataFrame:
    """(analysis_id, row_index, tau2, estimate, se): fits by PM, ML or REML without each study, of analyses of three or more."""
    return _fitted(studies, method, None).where("k >= 2").drop("k")


def cumulative(studies: DataFrame, order: str, method: str = "REML") -> DataFrame:
    """(analysis_id, row_index, k, tau2, estimate, se): fits by PM, ML, REML or DL of growing prefixes in the order of ``order`` (nulls
    last, then row_index); the first has a variance of 0."""
    return _fitted(studies, method, order)
