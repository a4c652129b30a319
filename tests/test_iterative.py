"""Estimators without SQL against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions import distributions as D
from evidra.functions import parse as P
from evidra.operators import bias, iterative, profiles, regression

from .test_statistics import V, Y, rows

RNG = np.random.default_rng(7)
Y2, V2 = RNG.normal(0.3, 0.5, 24), RNG.gamma(2, 0.05, 24)


def q(y, v, t):
    w = 1 / (v + t)
    return float((w * (y - (w * y).sum() / w.sum()) ** 2).sum())


def test_q_profile_meets_the_quantiles(spark):
    found = {r["analysis_id"]: r for r in profiles.q_profile(rows(spark, {"a": (Y, V), "b": (Y2, V2), "one": ([0.1], [0.2])})).collect()}
    assert set(found) == {"a", "b"}
    for name, y, v in (("a", np.array(Y), np.array(V)), ("b", Y2, V2)):
        for side, p in (("tau2_low", 0.975), ("tau2_high", 0.025)):
            goal = D.chi2_ppf(p, len(y) - 1)
            assert q(y, v, found[name][side]) == pytest.approx(goal, rel=1e-6) or (found[name][side] == 0 and q(y, v, 0) <= goal)


@pytest.mark.parametrize("method", ["REML", "ML", "PM", "DL", "HE", "SJ"])
def test_tau2_by_rounds_is_that_of_one_task(spark, method):
    found = {r["analysis_id"]: r["tau2"] for r in profiles.estimate_tau2(rows(spark, {"a": (Y, V), "b": (Y2, V2), "same": ([0.5] * 4, [0.1] * 4)}), method).collect()}
    assert found["same"] == pytest.approx(0, abs=1e-12)
    if method in iterative.METHODS:
        for name, y, v in (("a", np.array(Y), np.array(V)), ("b", Y2, V2)):
            assert found[name] == pytest.approx(iterative.METHODS[method](y, v), rel=1e-5, abs=1e-9)


def test_intervals_of_the_published_table(spark):
    """The thirteen trials of a vaccine, log risk ratios: REML with Knapp and Hartung's interval."""
    y = [-0.8893, -1.5854, -1.3481, -1.4416, -0.2175, -0.7861, -1.6209, 0.0120, -0.4694, -1.3713, -0.3394, 0.4459, -0.0173]
    v = [0.3256, 0.1946, 0.4154, 0.0200, 0.0512, 0.0069, 0.2230, 0.0040, 0.0564, 0.0730, 0.0124, 0.5325, 0.0714]
    row = profiles.meta_analysis(rows(spark, {"a": (y, v)}), "REML", "hksj").first()
    assert row["tau2"] == pytest.approx(0.3132, abs=2e-3) and row["estimate"] == pytest.approx(-0.7145, abs=2e-3)
    assert row["df"] == 12 and row["ci_low"] == pytest.approx(row["estimate"] - D.t_ppf(0.975, 12) * row["se"], rel=1e-9)
    wide = profiles.meta_analysis(rows(spark, {"a": (y, v)}), "REML", "hksj_adhoc").first()
    assert wide["se"] >= row["se"] and row["pi_low"] < row["ci_low"]


def test_trim_and_fill_by_both_estimators(spark):
    y, v = np.array([0.1, 0.15, 0.2, 0.3, 0.5, 0.8, 1.2]), np.array([0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4])
    for sign, side in ((1, "left"), (-1, "right")):
        for estimator in ("L0", "R0"):
            row = iterative.trim_and_fill(rows(spark, {"a": (sign * y, v)}), "FE", estimator).first()
            assert row["side"] == side and sign * row["filled_estimate"] <= sign * row["estimate"]
    z, order = y, np.argsort(y)
    k0, centre = iterative.missing_studies(z[order], v[order], "FE", "L0")
    w = 1 / v[: 7 - k0]
    assert centre == pytest.approx((w * y[: 7 - k0]).sum() / w.sum())
    ranks = np.argsort(np.argsort(np.abs(y - centre))) + 1
    assert k0 == max(0, round((4 * ranks[y > centre].sum() - 56) / 13))
    flat = {r["analysis_id"]: r for r in iterative.trim_and_fill(rows(spark, {"same_v": (y, np.full(7, 0.1)), "same_y": (np.full(7, 0.2), v)})).collect()}
    assert all(r["side"] is None and r["k0"] is None for r in flat.values())


def test_influence_is_a_refit(spark):
    y, v = np.array(Y), np.array(V)
    found = {r["row_index"]: r for r in iterative.influence(rows(spark, {"a": (Y, V)}), "REML").collect()}
    whole = iterative.tau2_likelihood(y, v)
    for i in (0, 5, 12):
        keep = np.arange(y.size) != i
        t = iterative.tau2_likelihood(y[keep], v[keep])
        w, w0 = 1 / (v[keep] + t), 1 / (v + whole)
        mu, mu0 = (w * y[keep]).sum() / w.sum(), (w0 * y).sum() / w0.sum()
        assert found[i]["rstudent"] == pytest.approx((y[i] - mu) / math.sqrt(v[i] + t + 1 / w.sum()), rel=1e-6)
        assert found[i]["cook"] == pytest.approx((mu0 - mu) ** 2 * w0.sum(), rel=1e-5)


def test_lfk_of_a_symmetric_set_and_of_equal_effects(spark):
    y = np.array([-0.6, -0.3, 0.0, 0.3, 0.6])
    v = np.array([0.4, 0.1, 0.01, 0.1, 0.4])
    found = {r["analysis_id"]: r for r in bias.lfk(rows(spark, {"even": (y, v), "same": (np.zeros(4), np.ones(4)), "few": ([0, 1], [1, 1])})).collect()}
    n = 100 * v.max() / v
    z = np.array([D.norm_ppf(p) for p in (np.cumsum(n) - n / 2 - 0.5) / n.sum()])
    apex = int(np.argmin(np.abs(z)))
    expected = 5 / 10 * (z + np.ptp(z) / np.ptp(y) * (y - y[apex])).sum()
    assert found["even"]["lfk"] == pytest.approx(expected, rel=1e-9)
    assert found["same"]["lfk"] is None and found["few"]["asymmetry"] is None


def test_regression_against_normal_equations(spark):
    x = np.arange(13.0)
    group = np.array(["a", "b", "c"] * 4 + ["a"])
    data = spark.createDataFrame([("k", i, float(Y[i]), float(V[i]), float(x[i]), str(group[i])) for i in range(13)], "analysis_id string, row_index long, yi double, vi double, dose double, arm string")
    found = {r["term"]: r for r in regression.meta_regression(data, ["dose"], ["arm"], "knha").collect()}
    assert set(found) == {"intercept", "dose", "arm=b", "arm=c"}
    m = np.column_stack([np.ones(13), x, group == "b", group == "c"]).astype(float)
    y, v = np.array(Y), np.array(V)
    w = 1 / (v + found["dose"]["tau2"])
    cov = np.linalg.inv(m.T @ (m * w[:, None]))
    b = cov @ m.T @ (w * y)
    e = y - m @ b
    s2 = float((w * e * e).sum()) / 9
    robust = cov @ (m.T @ (m * (w * e)[:, None] ** 2)) @ cov * 13 / 9
    for i, term in enumerate(["intercept", "dose", "arm=b", "arm=c"]):
        assert found[term]["estimate"] == pytest.approx(b[i], rel=1e-8)
        assert found[term]["se"] == pytest.approx(math.sqrt(cov[i, i] * s2), rel=1e-8)
        assert found[term]["se_robust"] == pytest.approx(math.sqrt(robust[i, i]), rel=1e-8)
        assert found[term]["p"] == pytest.approx(2 * (1 - D.t_cdf(abs(b[i]) / math.sqrt(cov[i, i] * s2), 9)), rel=1e-6)
    points = spark.createDataFrame([(1, "dose", 2.0), (1, "arm=b", 1.0), (2, "dose", 4.0)], "point long, term string, value double")
    made = {r["point"]: r["estimate"] for r in regression.predicted(spark.createDataFrame([("k", t, r["estimate"]) for t, r in found.items()], "analysis_id string, term string, estimate double"), points).collect()}
    assert made[1] == pytest.approx(b[0] + 2 * b[1] + b[2]) and made[2] == pytest.approx(b[0] + 4 * b[1])


def test_constant_moderators_are_left_out(spark):
    data = rows(spark, {"a": (Y, V)}).withColumns({"same": F.lit(3.0), "dose": F.col("row_index").cast("double")})
    assert [r["term"] for r in regression.meta_regression(data, ["same", "dose"]).collect()] == ["intercept", "dose"]


def test_uids_that_meet_are_hashed_again(spark):
    data = spark.createDataFrame([("x", 1), ("x", 1), (None, 2)], "label string, k long")
    found = P.row_uids(data, "label", "k").collect()
    assert len({r["row_uid"] for r in found}) == 3 and sum(r["met"] for r in found) == 2


def test_interval_gives_back_the_sd(spark):
    t = D.t_ppf(0.975, 19)
    half = t * 3.0 / math.sqrt(20)
    row = profiles.sd_from_interval(spark.createDataFrame([(5 - half, 5 + half, 20.0)], "lower double, upper double, n double")).first()
    assert row["sd"] == pytest.approx(3.0)


def test_array_forms_of_distributions():
    t, df = np.array([0.0, 1.0, -2.5, 40.0]), np.array([1.0, 3.0, 17.0, 200.0])
    assert np.allclose(D.t_two_sided(t, df), [2 * (1 - D.t_cdf(abs(a), n)) for a, n in zip(t, df, strict=True)], atol=1e-12)
    assert D.f_tail(np.array([3.0]), np.array([2.0]), np.array([10.0]))[0] == pytest.approx(1 - D.f_cdf(3.0, 2, 10))


def test_small_tables_of_many_analyses_are_many_tasks(spark):
    """Refits cost by the analysis, so few bytes are no reason for one task."""
    rows = [(a, r, float((7 * a + r) % 11), 1.0 + r % 3) for a in range(200) for r in range(3)]
    studies = spark.createDataFrame(rows, "analysis_id long, row_index long, yi double, vi double")
    made = iterative._grouped(studies, lambda rows, y, v: [(len(y),)], "k long")
    assert made.count() == 200 and made.select(F.spark_partition_id()).distinct().count() > 10
