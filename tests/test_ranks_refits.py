from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import bias, iterative, ranks, refits
from evidra.plans import catalog, load_all

from .conftest import SF
from .test_statistics import rows

load_all()


def brute_s(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    return float((np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / 2)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 200])
def test_signs_without_pairs(n):
    rng = np.random.default_rng(n)
    for _ in range(5):
        x, y = rng.integers(0, max(1, n // 2), n), rng.normal(size=n).round(1)
        assert ranks.sign_sum(x, y) == brute_s(x, y)
    if n:
        w = rng.integers(1, 4, n)
        assert ranks.sign_sum(x, y, w) == brute_s(np.repeat(x, w), np.repeat(y, w))


@pytest.mark.parametrize("k", range(2, 9))
def test_exact_chances_are_those_of_all_orders(k):
    sums = [brute_s(range(k), o) for o in permutations(range(k))]
    for s in sorted(set(sums)):
        assert ranks.exact_chance(s, k) == pytest.approx(np.mean(np.abs(sums) >= abs(s)))
    assert ranks.inversion_chances(170).sum() == pytest.approx(1) and ranks.exact_chance(0, 170) == pytest.approx(1)


def test_concordance_in_cells(spark):
    """Large analyses in many parts, one value in a third of all rows, ties on both sides, and small ones beside them."""
    rng = np.random.default_rng(1)
    data = []
    for name, n in (("large", 3000), ("tied", 1500), ("small", 40), ("one", 1), ("same", 30)):
        x, y = rng.normal(size=n), rng.normal(size=n)
        if name == "tied":
            x, y = np.where(rng.random(n) < 0.35, 0.25, x.round(1)), np.where(rng.random(n) < 0.4, -1.0, y.round(1))
        if name == "same":
            x = np.zeros(n)
        y = y + 0.3 * x
        data += [(name, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    frame = spark.createDataFrame([*data, ("small", None, 1.0)], "analysis_id string, a double, b double")
    found = {r["analysis_id"]: r for r in ranks.concordance(frame, "a", "b", cell_rows=100, parts=8).collect()}
    for name in ("large", "tied", "small", "one", "same"):
        x, y = (np.array([row[c] for row in data if row[0] == name]) for c in (1, 2))
        tied = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
        row = found[name]
        assert (row["k"], row["s"], row["ties_x"], row["ties_y"]) == (x.size, brute_s(x, y), tied(x), tied(y)), name


def test_begg_exact_and_normal(spark):
    y, v = [0.1, 0.5, -0.2, 0.9, 0.3, 1.4], [0.1, 0.2, 0.05, 0.4, 0.15, 0.8]
    found = {r["analysis_id"]: r for r in bias.begg_exact(rows(spark, {"a": (y, v), "ties": ([0.1, 0.2, 0.4, 0.8], [0.1, 0.1, 0.2, 0.3]), "flat": ([0.1, 0.2, 0.3], [0.5] * 3), "two": (y[:2], v[:2])})).collect()}
    assert set(found) == {"a", "ties", "flat"} and found["a"]["method"] == "exact" and found["ties"]["method"] == "normal" and found["flat"]["p"] is None
    assert found["a"]["p"] == pytest.approx(ranks.exact_chance(found["a"]["s"], 6))


@pytest.mark.parametrize("method", ["REML", "ML", "PM"])
def test_refits_are_those_of_each_subset(spark, monkeypatch, method):
    monkeypatch.setattr(refits, "PART_ROWS", 10)
    rng = np.random.default_rng(3)
    own = {"a": (rng.normal(0.3, 0.6, 35), rng.gamma(2, 0.05, 35)), "b": (rng.normal(0, 0.1, 12), rng.gamma(2, 0.1, 12)), "three": ([0.1, 0.9, 0.2], [0.01, 0.02, 0.05]), "two": ([0.1, 0.9], [0.01, 0.02]), "same": ([0.5] * 4, [0.1] * 4)}
    frame = rows(spark, own).withColumn("year", -F.col("row_index") % 5)
    fit = iterative.METHODS[method]
    found = {(r["analysis_id"], r["row_index"]): r for r in refits.leave_one_out(frame, method).collect()}
    assert {a for a, _ in found} == {"a", "b", "three", "same"}
    grown = {(r["analysis_id"], r["row_index"]): r for r in refits.cumulative(frame, "year", method).collect()}
    for name, (y, v) in own.items():
        y, v = np.asarray(y, float), np.asarray(v, float)
        order = sorted(range(y.size), key=lambda i: (-(i % 5), i))
        for place, i in enumerate(order, 1):
            checks = [(grown[name, i], order[:place])] + ([(found[name, i], [j for j in range(y.size) if j != i])] if y.size > 2 else [])
            for row, part in checks:
                tau2 = fit(y[part], v[part]) if len(part) > 1 else 0.0
                w = 1 / (v[part] + tau2)
                scale = max(tau2, float(v[part].mean()))
                assert abs(row["tau2"] - tau2) <= 2e-6 * scale, (name, i, len(part), row["tau2"], tau2)
                assert row["estimate"] == pytest.approx((w * y[part]).sum() / w.sum(), abs=2e-6) and row["se"] == pytest.approx(w.sum() ** -0.5, rel=2e-6)
            assert grown[name, i]["k"] == place


def test_dl_prefixes_are_those_of_whole_analyses(spark, monkeypatch):
    """More than fifty studies in one analysis, and variances of many sizes."""
    monkeypatch.setattr(refits, "PART_ROWS", 10)
    rng = np.random.default_rng(5)
    own = {"a": (rng.normal(0.3, 0.6, 120), rng.gamma(2, 0.05, 120)), "wide": (rng.normal(0, 30, 40), 10.0 ** rng.uniform(-6, 2, 40)), "flat": ([0.5] * 4, [0.1, 0.2, 0.3, 0.4]), "two": ([0.1, 0.9], [0.01, 0.02]), "one": ([0.1], [0.01])}
    frame = rows(spark, own).withColumn("year", -F.col("row_index") % 5)
    grown = {(r["analysis_id"], r["row_index"]): r for r in bias.cumulative(frame, "year").collect()}
    for name, (y, v) in own.items():
        y, v = np.asarray(y, float), np.asarray(v, float)
        order = sorted(range(y.size), key=lambda i: (-(i % 5), i))
        for place, i in enumerate(order, 1):
            row, part = grown[name, i], order[:place]
            tau2 = iterative.tau2_dl(y[part], v[part])
            w = 1 / (v[part] + tau2)
            assert row["k"] == place and row["tau2"] == pytest.approx(tau2, rel=1e-7, abs=1e-9)
            assert row["estimate"] == pytest.approx((w * y[part]).sum() / w.sum(), rel=1e-7, abs=1e-8) and row["se"] == pytest.approx(w.sum() ** -0.5, rel=1e-8)


def test_cumulative_dl_takes_whole_regions(spark):
    of = lambda name: {r["analysis_id"] for r in catalog.QUERIES[name](spark, SF).collect()}
    assert of("cumulative_dl") == of("pool_dl")
