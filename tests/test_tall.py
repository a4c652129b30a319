import math

import numpy as np
import pytest

from evidra.operators import regression, tall

SCHEMA = "analysis_id string, row_index long, yi double, vi double, dose double, size double"


def made(seed=2):
    rng = np.random.default_rng(seed)
    data = []
    for name, n, spread in (("a", 90, 0.6), ("b", 25, 0.0), ("flat", 12, 0.3), ("few", 3, 0.3), ("bent", 10, 0.2)):
        dose, size = rng.normal(5, 3, n), rng.gamma(2, 40, n)
        if name == "flat":
            dose = np.full(n, 2.0)
        if name == "bent":
            size = 3 * dose
        v = rng.gamma(2, 0.05, n)
        y = 0.2 + 0.1 * dose - 0.002 * size + rng.normal(0, np.sqrt(v)) + rng.normal(0, spread or 1e-9, n)
        data += [(name, i, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(y, v, dose, size, strict=True))]
    return [*data, ("a", 999, 1.0, 0.1, None, 1.0)]


@pytest.mark.parametrize("test", ["z", "knha"])
def test_blocks_give_the_fit_of_one_task(spark, monkeypatch, test):
    monkeypatch.setattr(tall, "PART_ROWS", 8)
    monkeypatch.setattr(tall, "FANOUT", 3)
    frame = spark.createDataFrame(made(), SCHEMA)
    expected = {(r["analysis_id"], r["term"]): r for r in regression.meta_regression(frame, ["dose", "size"], test=test).collect()}
    found = {(r["analysis_id"], r["term"]): r for r in tall.meta_regression(frame, ["dose", "size"], "DL", test).collect()}
    assert set(found) == set(expected) and {a for a, _ in found} == {"a", "b", "flat"}
    for key, row in expected.items():
        for c in expected[key].asDict():
            if c not in ("analysis_id", "term"):
                assert found[key][c] == (pytest.approx(row[c], rel=1e-8, abs=1e-10) if row[c] is not None else None), (key, c)


def one(y, v, x, method):
    """The residual variance by a direct search."""
    p = x.shape[1]

    def parts(t):
        w = 1 / (v + t)
        xtwx = x.T @ (x * w[:, None])
        b = np.linalg.solve(xtwx, x.T @ (w * y))
        return float((w * (y - x @ b) ** 2).sum()), np.log(w).sum(), np.linalg.slogdet(xtwx)[1]

    if method == "PM":
        if parts(0)[0] <= y.size - p:
            return 0.0
        low, high = 0.0, 1e4
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if parts(middle)[0] > y.size - p else (low, middle)
        return low
    value = lambda t: 0.5 * (parts(t)[1] - parts(t)[0] - (parts(t)[2] if method == "REML" else 0))
    best = max([0.0, *np.logspace(-9, 2, 400)], key=value)
    if best == 0:
        return 0.0
    low, high = best / 1.2, best * 1.2
    g = (math.sqrt(5) - 1) / 2
    for _ in range(100):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if value(a) >= value(b) else (a, high)
    return (low + high) / 2


@pytest.mark.parametrize("method", ["PM", "ML", "REML"])
def test_residual_variance_by_points(spark, monkeypatch, method):
    monkeypatch.setattr(tall, "PART_ROWS", 20)
    data = made(5)
    found = {(r["analysis_id"], r["term"]): r for r in tall.meta_regression(spark.createDataFrame(data, SCHEMA), ["dose", "size"], method).collect()}
    for name in ("a", "b", "flat"):
        own = [r for r in data if r[0] == name and None not in r]
        y, v = (np.array([r[c] for r in own]) for c in (2, 3))
        columns = [np.ones(y.size), *(np.array([r[c] for r in own]) for c in ((5,) if name == "flat" else (4, 5)))]
        x = np.column_stack(columns)
        tau2 = one(y, v, x / np.abs(x).max(axis=0), method)
        assert found[name, "intercept"]["tau2"] == pytest.approx(tau2, rel=1e-5, abs=1e-7 * v.mean()), name
        w = 1 / (v + tau2)
        b = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * y))
        assert found[name, "size"]["estimate"] == pytest.approx(b[-1], rel=1e-5)


def test_no_studies(spark):
    assert tall.meta_regression(spark.createDataFrame([], SCHEMA), ["dose"]).count() == 0
