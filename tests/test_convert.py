"""Requests for conversions: outputs, and what is wrong with a request."""

import math

import numpy as np
import pytest

from evidra.functions import distributions as D
from evidra.operators import convert

ROWS = "row_index int, kind string, inputs map<string,double>, outputs int"


def test_outputs_and_problems(spark):
    nan = float("nan")
    asked = [
        ("se_to_sd", {"se": 2.0, "n": 16.0}, {"sd": 8.0}),
        ("ci_to_sd", {"lower": -1.0, "upper": 1.0, "n": 2.0}, {"sd": math.sqrt(2) / D.t_ppf(0.975, 1)}),
        ("ci_to_se", {"lower": 1.0, "upper": math.e, "log": 1.0}, {"se": 1 / (2 * 1.959963984540054)}),
        ("split_shared_control", {"n": 11.0, "arms": 3.0, "events": 4.0}, {"n_1": 4.0, "n_2": 4.0, "n_3": 3.0, "events_1": 2.0, "events_2": 1.0, "events_3": 1.0}),
        ("median_to_mean_sd", {"n": 50.0, "median": 5.0, "q1": 4.0, "q3": 7.0, "min": 1.0, "max": 12.0}, None),
        ("se_to_sd", {"se": -2.0, "n": 16.0}, "value"), ("se_to_sd", {"se": nan, "n": 16.0}, "missing"), ("se_to_sd", None, "missing"),
        ("se_to_sd", {"se": 1.0, "n": 16.0, "arms": 2.0}, "input"), (None, {"se": 1.0}, "kind"), ("", {}, "kind"), ("r_to_d", {"y": 1.0, "v": 1.0}, "value"),
        ("ci_to_se", {"lower": 2.0, "upper": 1.0}, "value"), ("ci_to_se", {"lower": 0.0, "upper": 1.0, "log": 1.0}, "value"), ("ci_to_se", {"lower": 0.0, "upper": 1.0, "df": 0.0}, "value"),
        ("ci_to_sd", {"lower": 0.0, "upper": 1.0, "n": 1.0}, "value"), ("split_shared_control", {"n": 2.0, "arms": 3.0}, "value"),
        ("split_shared_control", {"n": 20.0, "arms": 2.5}, "value"), ("split_shared_control", {"n": 20.0, "arms": 2.0, "events": 30.0}, "value"),
        ("median_to_mean_sd", {"n": 50.0, "median": 5.0, "q1": 6.0, "q3": 7.0}, "value"), ("p_to_se", {"estimate": 0.0, "p": 0.5}, "value"),
    ]
    rows = spark.createDataFrame([(i, k, x, 0) for i, (k, x, _) in enumerate(asked)], ROWS)
    found = {r.row_index: r for r in convert.converted(rows).collect()}
    assert len(found) == len(asked)
    for i, (kind, _, wanted) in enumerate(asked):
        row = found[i]
        if isinstance(wanted, str):
            assert (row.problem, row.outputs, row.estimated) == (wanted, None, None), asked[i]
        else:
            assert row.problem is None and row.estimated == convert.KINDS[kind][2]
            if wanted is not None:
                assert row.outputs == pytest.approx(wanted, rel=1e-9)
    both = found[4].outputs
    p = 50**0.75
    assert both["mean"] == pytest.approx(2.2 / (2.2 + p) * 6.5 + (0.7 - 0.72 / 50**0.55) * 5.5 + (1 - 2.2 / (2.2 + p) - 0.7 + 0.72 / 50**0.55) * 5)
    assert both["sd"] == pytest.approx(11 / (4 * D.norm_ppf(49.625 / 50.25)) + 3 / (4 * D.norm_ppf(37.375 / 50.25)))


def test_no_requests_and_repeated_rows(spark):
    assert convert.converted(spark.createDataFrame([], ROWS)).collect() == []
    twice = spark.createDataFrame([(1, "se_to_sd", {"se": 1.0, "n": 4.0}, 0)] * 2, ROWS)
    assert [r.outputs for r in convert.converted(twice).collect()] == [{"sd": 2.0}] * 2


def test_t_quantiles_of_arrays():
    p, n = np.array([0.975, 0.025, 0.5, 0.9, 0.0, 1.0, 0.7, np.nan, 0.999]), np.array([10.0, 10.0, 3.0, 1.0, 5.0, 5.0, 0.0, 4.0, 2.5])
    found = D.t_quantiles(p, n)
    assert np.isnan(found[[4, 5, 6, 7]]).all() and found[2] == 0
    assert found[[0, 1, 3, 8]] == pytest.approx([D.t_ppf(a, b) for a, b in zip(p[[0, 1, 3, 8]], n[[0, 1, 3, 8]], strict=True)], abs=1e-8)
    assert D.t_quantiles(np.zeros(0), np.zeros(0)).size == 0
