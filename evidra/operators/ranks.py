"""Kendall's rank correlation of analyses of any size, by counting inversions in cells instead of forming pairs.

The studies of a large analysis are cut along both variables at its percentiles; a value that is a cut is a part of its own, so
equal values never part. A pair in one part of y is counted within that part, a pair in one part of x, but not of y, within
that one, and all others by the counts of the cells alone. Within a part pairs are counted bit by bit, in n log n.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .pooling import KEY

#: Analyses up to this size are one cell; larger ones are cut at PARTS - 1 percentiles.
CELL_ROWS, PARTS = 4096, 256
#: Studies up to which the exact distribution is used.
EXACT_MOST = 170


def inversions(x: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Pairs i < j with x[i] > x[j], each counted weight[i] * weight[j] times."""
    _, rank = np.unique(x, return_inverse=True)
    w = np.ones(rank.size) if weight is None else weight.astype(np.float64)
    total = 0.0
    for shift in range(max(1, int(rank.max(initial=0)).bit_length()) - 1, -1, -1):
        # Rows stand in groups of equal higher bits; within one, the ones that stand before a zero are inverted.
        one = (rank >> shift) & 1
        upto = np.concatenate(([0.0], np.cumsum(one * w)))
        high = rank >> (shift + 1)
        first = np.searchsorted(high, high)
        zero = one == 0
        total += float(((upto[:-1] - upto[first]) * w)[zero].sum())
        order = np.argsort(rank >> shift, kind="stable")
        rank, w = rank[order], w[order]
    return total


def sign_sum(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The sum over pairs of sign(x_i - x_j) sign(y_i - y_j): concordant pairs less discordant ones, ties count nothing."""
    w = np.ones(x.size) if weight is None else weight
    up, down = np.lexsort((y, x)), np.lexsort((-y, x))
    return inversions(-y[down], w[down]) - inversions(y[up], w[up])


def _part(cuts: str, value: str) -> Column:
    return F.expr(f"2 * size(filter({cuts}, c -> c < {value})) + int(array_contains({cuts}, {value}))")


def concordance(rows: DataFrame, x: str, y: str, cell_rows: int = CELL_ROWS, parts: int = PARTS) -> DataFrame:
    """(analysis_id, k, s, pairs, ties_x, ties_y) of rows (analysis_id, x, y): concordant less discordant pairs, all pairs, and pairs
    tied in x and in y. Rows with a null take no part."""
    own = rows.select(KEY, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    steps = ", ".join(repr((i + 1) / parts) for i in range(parts - 1))
    sizes = own.groupBy(KEY).agg(F.count(F.lit(1)).alias("k"), *[F.expr(f"percentile_approx({v}, array({steps}))").alias(f"cuts_{v}") for v in ("x", "y")])
    empty = F.array().cast("array<double>")
    sizes = sizes.select(KEY, "k", *[F.when(F.col("k") > cell_rows, F.array_distinct(f"cuts_{v}")).otherwise(empty).alias(f"cuts_{v}") for v in ("x", "y")])
    placed = own.join(sizes, KEY).select(KEY, "x", "y", _part("cuts_x", "x").alias("px"), _part("cuts_y", "y").alias("py"))
    kind = dict(own.dtypes)[KEY]

    def summed(a: str, b: str, w: str | None = None):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            columns = [group.column(c).to_numpy() for c in (a, b)]
            s = sign_sum(*columns, group.column(w).to_numpy() if w else None)
            return pa.table({KEY: pa.array([key[0].as_py()], group.schema.field(KEY).type), "s": [s]})

        return run

    schema = f"{KEY} {kind}, s double"
    # A part of one value has no pairs that count.
    mixed = placed.groupBy(KEY, "py").agg((F.min("y") < F.max("y")).alias("mixed")).where("mixed").select(KEY, "py")
    found = placed.join(mixed, [KEY, "py"], "left_semi").groupBy(KEY, "py").applyInArrow(summed("x", "y"), schema)
    several = placed.groupBy(KEY, "px").agg(((F.min("x") < F.max("x")) & (F.min("py") < F.max("py"))).alias("mixed")).where("mixed").select(KEY, "px")
    counts = placed.groupBy(KEY, "px", "py").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_row = placed.join(several, [KEY, "px"], "left_semi").groupBy(KEY, "px").applyInArrow(summed("x", "py"), schema)
    by_cell = counts.join(sizes.where(F.size("cuts_x") > 0).select(KEY), KEY, "left_semi").groupBy(KEY).applyInArrow(summed("px", "py", "n"), schema)
    s = found.union(by_row).union(by_cell).groupBy(KEY).agg(F.sum("s").alias("s"))
    half = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    out = sizes.select(KEY, "k").join(s, KEY, "left").select(KEY, "k", F.coalesce("s", F.lit(0.0)).alias("s"), half("k").alias("pairs"))
    for v in ("x", "y"):
        tied = own.groupBy(KEY, v).agg(F.count(F.lit(1)).alias("c")).groupBy(KEY).agg(F.sum(half("c")).alias(f"ties_{v}"))
        out = out.join(tied, KEY)
    return out


@functools.lru_cache(maxsize=256)
def inversion_chances(k: int) -> np.ndarray:
    """Chances of 0, 1, ... inversions in a random order of ``k``: the k-th element adds 0 to k - 1, each as likely."""
    chances = np.ones(1)
    for m in range(2, k + 1):
        upto = np.concatenate(([0.0], np.cumsum(chances)))
        i = np.arange(chances.size + m - 1)
        chances = (upto[np.minimum(i + 1, chances.size)] - upto[np.clip(i - m + 1, 0, chances.size)]) / m
    return chances


def exact_chance(s: float, k: int) -> float:
    """P(|S| >= |s|) for ``k`` studies without ties."""
    most = k * (k - 1) // 2
    chances = inversion_chances(k)
    return float(min(1.0, chances[np.abs(most - 2 * np.arange(most + 1)) >= abs(s) - 1e-9].sum()))


@F.pandas_udf(DoubleType())
def exact_p(s: pd.Series, k: pd.Series) -> pd.Series:
    """``exact_chance`` where k is 2 to EXACT_MOST; else null."""
    return pd.Series([exact_chance(a, int(n)) if a == a and 2 <= n <= EXACT_MOST else None for a, n in zip(s, k, strict=True)], dtype="float64")
