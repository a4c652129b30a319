"""Meta-regression of analyses of any size, by QR of row blocks.

A block of studies is reduced to the triangle of its weighted design and effects; triangles are stacked and reduced again, some
of them at a time, until an analysis has one. A triangle holds all that a weighted fit needs. For PM, ML and REML the blocks are
reduced at shared points of the residual variance, whose score is looked up between points as in ``refits``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.sources.shared import stored

from .pooling import KEY, usable
from .refits import NODES, grid
from .regression import _FIT, term_rows

PART_ROWS, FANOUT = 2048, 16
#: Triangles besides those of the points: of the design alone, and weighted by squared weights.
_PLAIN, _SQUARED = -2, -1


def _block(columns: np.ndarray, v: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, triangles, log weights) of a block: the design with the effects as its last column."""
    w = 1.0 / (v + points[:, None])
    roots = np.vstack([np.ones(v.size), 1.0 / v, np.sqrt(w)])
    return np.concatenate(([_PLAIN, _SQUARED], np.arange(points.size))), _reduced(roots[:, :, None] * columns), np.concatenate(([0.0, 0.0], np.log(w).sum(axis=1)))


def _reduced(stack: np.ndarray) -> np.ndarray:
    """The triangle of each of the matrices, padded with rows of zeros if they have fewer rows than columns."""
    rows, columns = stack.shape[1:]
    if rows < columns:
        stack = np.concatenate([stack, np.zeros((stack.shape[0], columns - rows, columns))], axis=1)
    return np.linalg.qr(stack, mode="r")


def _triangles(rows: DataFrame, moderators: list[str], at: str | None) -> DataFrame:
    """(analysis_id, number, n, log, r): the triangle of each analysis at the points of the grid, or at 0 and ``at``, flattened."""
    kind, width = dict(rows.dtypes)[KEY], len(moderators) + 2
    schema = f"{KEY} {kind}, part long, number int, n long, log double, r array<double>"

    def rows_of(key, part, numbers, n, logs, made, like) -> pa.Table:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(numbers.size + 1, dtype=np.int32) * width * width), pa.array(made.reshape(-1)))
        return pa.table({KEY: pa.array([key] * numbers.size, like), "part": pa.array([part] * numbers.size, pa.int64()), "number": numbers.astype(np.int32), "n": pa.array([n] * numbers.size, pa.int64()), "log": logs, "r": flat})

    def reduce(key: tuple, group: pa.Table) -> pa.Table:
        first = {c: group.column(c)[0].as_py() for c in group.column_names}
        scale = np.array([first[f"scale_{m}"] for m in moderators])
        columns = np.column_stack([np.ones(group.num_rows), *(group.column(m).to_numpy() / s for m, s in zip(moderators, scale, strict=True)), group.column("yi").to_numpy()])
        points = grid(first["high"]) if at is None else np.array([0.0, first[at]])
        numbers, made, logs = _block(columns, group.column("vi").to_numpy(), points)
        return rows_of(key[0].as_py(), key[1].as_py(), numbers, group.num_rows, logs, made, group.schema.field(KEY).type)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("number", "ascending"), ("part", "ascending")])
        numbers, counts = np.unique(group.column("number").to_numpy(), return_counts=True)
        r = np.concatenate([c.values.to_numpy() for c in group.column("r").chunks]) if group.num_rows else np.zeros(0)
        stack = r.reshape(numbers.size, counts[0] * width, width)
        logs = group.column("log").to_numpy().reshape(numbers.size, -1).sum(axis=1)
        n = int(group.column("n").to_numpy()[: counts[0]].sum())
        return rows_of(key[0].as_py(), key[1].as_py(), numbers, n, logs, _reduced(stack), group.schema.field(KEY).type)

    made = stored(rows.groupBy(KEY, "part").applyInArrow(reduce, schema), "triangles")
    last = made.agg(F.max("part")).first()[0] or 0
    while last > 0:
        made = stored(made.withColumn("part", F.floor(F.col("part") / FANOUT)).groupBy(KEY, "part").applyInArrow(merge, schema), "triangles")
        last //= FANOUT
    return made


def _solved(r: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, inverse of the cross products, residual sum of squares) of a triangle over ``p`` terms and the effects."""
    inverse = np.linalg.inv(r[:p, :p])
    return inverse @ r[:p, p], inverse @ inverse.T, float(r[p, p] ** 2)


def _tau2(triangles: dict[int, np.ndarray], logs: dict[int, float], k: int, keep: list[int], high: float, method: str) -> float:
    """The residual variance of one analysis from its triangles, over the columns ``keep`` (the last is the effects)."""
    p = len(keep) - 1
    own = {n: _reduced(t[:, keep][None])[0] for n, t in triangles.items()}
    if method == "FE":
        return 0.0
    if method == "DL":
        _, inverse, qe = _solved(own[0], p)
        squared = own[_SQUARED][: p + 1, :p]
        trace = float((own[0][:, 0] ** 2).sum()) - float(np.trace(inverse @ (squared.T @ squared)))  # the first column is the intercept
        return max(0.0, (qe - (k - p)) / trace) if trace > 0 else 0.0
    points = grid(high)
    rss = np.array([own[n][p, p] ** 2 for n in range(points.size)])
    if method == "PM":
        value, goal = rss, k - p
        if value[0] <= goal:
            return 0.0
        left = int(np.flatnonzero(value > goal)[-1])
        if left in (0, points.size - 1):
            return 0.0 if left == 0 else high
        held = value - goal
        f = lambda u, nodes, values: float((_share(nodes, u) * values).sum())
    else:
        det = np.array([2 * np.log(np.abs(np.diag(own[n])[:p])).sum() for n in range(points.size)])
        held = 0.5 * (np.array([logs[n] for n in range(points.size)]) - rss - (det if method == "REML" else 0.0))
        left = int(np.argmax(held))
        if left == 0 or (left == 1 and held[0] >= held[1]):
            return 0.0
        left = min(left, points.size - 2)
        f = lambda u, nodes, values: float((_slope(nodes, u) * values).sum())
    u = np.log(points[1:])
    first = min(max(left - 1 - NODES // 2 + (method == "PM"), 0), u.size - NODES)
    nodes, values = u[first : first + NODES], held[1:][first : first + NODES]
    low, top = (u[left - 1], u[left]) if method == "PM" else (u[max(left - 2, 0)], u[left])
    for _ in range(60):
        middle = (low + top) / 2
        low, top = (middle, top) if f(middle, nodes, values) > 0 else (low, middle)
    return math.exp((low + top) / 2)


def _share(nodes: np.ndarray, at: float) -> np.ndarray:
    return np.array([np.prod([(at - nodes[j]) / (nodes[i] - nodes[j]) for j in range(nodes.size) if j != i]) for i in range(nodes.size)])


def _slope(nodes: np.ndarray, at: float) -> np.ndarray:
    """Coefficients of the derivative of the polynomial through the nodes."""
    out = np.zeros(nodes.size)
    for i in range(nodes.size):
        for m in range(nodes.size):
            if m != i:
                out[i] += np.prod([(at - nodes[j]) / (nodes[i] - nodes[j]) for j in range(nodes.size) if j not in (i, m)]) / (nodes[i] - nodes[m])
    return out


def meta_regression(studies: DataFrame, moderators: list[str], method: str = "DL", test: str = "z") -> DataFrame:
    """(analysis_id, term, ...) of ``regression.fit`` on numeric ``moderators``, with the residual variance by FE, DL, PM, ML or REML.
    Moderators that don't vary within an analysis are left out of it; rows with a null moderator take no part; analyses whose
    columns depend on each other, or with no more studies than terms, have no rows. An analysis may have any size."""
    if method not in ("FE", "DL", "PM", "ML", "REML"):
        raise ValueError(f"unknown method {method}")
    own = usable(studies)
    for m in moderators:
        own = own.where(F.col(m).isNotNull())
    own = own.select(KEY, "row_index", "yi", "vi", *[F.col(m).cast("double").alias(m) for m in moderators])
    facts = own.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("k"), (2 * F.var_pop("yi") * F.count(F.lit(1)) + 2 * F.max("vi")).alias("high"), *[F.greatest(F.max(F.abs(m)), F.lit(1e-300)).alias(f"scale_{m}") for m in moderators],
        *[(F.max(m) > F.min(m)).alias(f"varies_{m}") for m in moderators],
    )
    facts = stored(facts, "facts")
    rows = stored(own.join(facts, KEY).withColumn("part", F.pmod(F.xxhash64("row_index"), F.ceil(F.col("k") / PART_ROWS))), "regression")
    # Parts are numbered without gaps, or an empty one would do no harm: triangles are merged by what is there.
    width, kind = len(moderators) + 2, dict(rows.dtypes)[KEY]

    def read(group: pa.Table) -> tuple[dict, dict]:
        numbers, logs = group.column("number").to_pylist(), group.column("log").to_pylist()
        return {n: np.array(r).reshape(width, width) for n, r in zip(numbers, group.column("r").to_pylist(), strict=True)}, dict(zip(numbers, logs, strict=True))

    def kept(fact: pa.Table) -> list[int]:
        return [0, *(i + 1 for i, m in enumerate(moderators) if fact.column(f"varies_{m}")[0].as_py()), width - 1]

    def residual(key: tuple, group: pa.Table, fact: pa.Table) -> pa.Table:
        triangles, logs = read(group)
        keep, k = kept(fact), fact.column("k")[0].as_py()
        p = len(keep) - 1
        plain = _reduced(triangles[_PLAIN][:, keep][None])[0][:p, :p]
        if k < p + 1 or np.linalg.matrix_rank(plain, tol=1e-7) < p:
            found = []
        else:
            found = [_tau2(triangles, logs, k, keep, fact.column("high")[0].as_py(), method)]
        return pa.table({KEY: pa.array([key[0].as_py()] * len(found), fact.schema.field(KEY).type), "tau2": pa.array(found, pa.float64())})

    def fitted(key: tuple, group: pa.Table, fact: pa.Table) -> pa.Table:
        triangles, _ = read(group)
        keep = kept(fact)
        p = len(keep) - 1
        at_0, at = (_reduced(triangles[n][:, keep][None])[0] for n in (0, 1))
        b, cov, rss = _solved(at, p)
        full = np.zeros(width - 1)
        full[keep[:-1]] = b
        y = at[:, p]
        found = {KEY: key[0].as_py(), "tau2": fact.column("tau2")[0].as_py(), "b": full.tolist(), "cov": cov.reshape(-1).tolist(), "rss": rss, "tss": float((y[1:] ** 2).sum()), "swy2": float((y**2).sum()), "qe": _solved(at_0, p)[2]}
        return pa.Table.from_pylist([found], schema=pa.schema([pa.field(KEY, fact.schema.field(KEY).type), *(pa.field(c, t) for c, t in (("tau2", pa.float64()), ("b", pa.list_(pa.float64())), ("cov", pa.list_(pa.float64())), ("rss", pa.float64()), ("tss", pa.float64()), ("swy2", pa.float64()), ("qe", pa.float64())))]))

    first = _triangles(rows, moderators, None) if method not in ("FE", "DL") else _triangles(rows.withColumn("zero", F.lit(0.0)), moderators, "zero")
    taus = stored(first.groupBy(KEY).cogroup(facts.groupBy(KEY)).applyInArrow(residual, f"{KEY} {kind}, tau2 double"), "taus")
    second = _triangles(rows.join(taus, KEY), moderators, "tau2")
    fits = second.groupBy(KEY).cogroup(facts.join(taus, KEY).groupBy(KEY)).applyInArrow(fitted, f"{KEY} {kind}, tau2 double, b array<double>, cov array<double>, rss double, tss double, swy2 double, qe double")
    fits = stored(fits, "fits")

    def middle(key: tuple, group: pa.Table) -> pa.Table:
        b, tau2 = np.array(group.column("b")[0].as_py()), group.column("tau2")[0].as_py()
        x = np.column_stack([np.ones(group.num_rows), *(group.column(m).to_numpy() / group.column(f"scale_{m}")[0].as_py() for m in moderators)])
        weighed = (group.column("yi").to_numpy() - x @ b) / (group.column("vi").to_numpy() + tau2)
        made = ((x * weighed[:, None]).T @ (x * weighed[:, None])).reshape(-1)
        return pa.table({KEY: pa.array([key[0].as_py()] * made.size, group.schema.field(KEY).type), "at": pa.array(np.arange(made.size, dtype=np.int32)), "m": made})

    meat = rows.join(fits.select(KEY, "tau2", "b"), KEY).groupBy(KEY, "part").applyInArrow(middle, f"{KEY} {kind}, at int, m double").groupBy(KEY, "at").agg(F.sum("m").alias("m"))
    meat = meat.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("e")).select(KEY, F.transform("e", lambda e: e.m).alias("meat"))
    names = [c.split()[0] for c in _FIT.split(", ")]

    def tested(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                keep = [0, *(i + 1 for i, m in enumerate(moderators) if row[f"varies_{m}"])]
                p = len(keep)
                scale = np.array([1.0, *(row[f"scale_{m}"] for m in moderators)])[keep]
                middle_of = np.array(row["meat"]).reshape(width - 1, width - 1)[np.ix_(keep, keep)]
                made = term_rows([["intercept", *moderators][i] for i in keep], np.array(row["b"])[keep], np.array(row["cov"]).reshape(p, p), middle_of, row, scale, row["k"], row["tau2"], test)
                out += [{KEY: row[KEY], **dict(zip(names, r, strict=True))} for r in made]
            kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
            fields = [pa.field(KEY, batch.schema.field(KEY).type), *(pa.field(c.split()[0], kinds[c.split()[1]]) for c in _FIT.split(", "))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    return facts.join(fits, KEY).join(meat, KEY).mapInArrow(tested, f"{KEY} {kind}, {_FIT}")
