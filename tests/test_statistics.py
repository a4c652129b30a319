import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.functions import distributions as D
from evidra.operators import bias, effect_tables, iterative, pooling, profiles, validate
from evidra.plans import catalog, load_all

from .compare import norm

Y = [-0.8893, -1.5854, -1.3481, -1.4416, -0.2175, -0.7861, -1.6209, 0.0120, -0.4694, -1.3713, -0.3394, 0.4459, -0.0173]
V = [0.3256, 0.1946, 0.4154, 0.0200, 0.0512, 0.0069, 0.2230, 0.0040, 0.0564, 0.0730, 0.0124, 0.5325, 0.0714]


def rows(spark, analyses):
    return spark.createDataFrame([(a, i, float(y), float(v)) for a, (ys, vs) in analyses.items() for i, (y, v) in enumerate(zip(ys, vs, strict=True))], "analysis_id string, row_index long, yi double, vi double")


def test_quantiles():
    assert D.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert D.t_ppf(0.975, 10) == pytest.approx(2.228138851964939, abs=1e-9)
    assert D.chi2_ppf(0.95, 3) == pytest.approx(7.814727903251179, abs=1e-9)
    assert D.f_cdf(3.0, 2, 10) == pytest.approx(1 - (1 + 2 * 3.0 / 10) ** -5, abs=1e-12)
    assert D.t_cdf(1.0, 1) == pytest.approx(0.75, abs=1e-12)


def test_random_effects_maximises_the_restricted_likelihood(spark):
    row = profiles.random_effects(rows(spark, {"a": (Y, V)}), "REML").first()
    y, v = np.array(Y), np.array(V)
    best = iterative.loglik(y, v, row["tau2"], True)
    assert all(best >= iterative.loglik(y, v, t, True) - 1e-10 for t in np.linspace(0, 3, 3001))
    assert row["tau2_low"] < row["tau2"] < row["tau2_high"]
    assert row["pi_low"] < row["ci_low"] < row["estimate"] < row["ci_high"] < row["pi_high"]


def test_paule_mandel_meets_its_equation(spark):
    row = profiles.random_effects(rows(spark, {"a": (Y, V)}), "PM").first()
    assert iterative.q_at(np.array(Y), np.array(V), row["tau2"]) == pytest.approx(len(Y) - 1, rel=1e-7)


def test_one_and_two_studies(spark):
    data = rows(spark, {"one": ([0.5], [0.1]), "two": ([0.5, 0.7], [0.1, 0.2])})
    found = {r["analysis_id"]: r for r in profiles.random_effects(data, "REML").collect()}
    assert found["one"]["estimate"] == 0.5 and found["one"]["ci_low"] is None
    assert found["two"]["pi_low"] is None and found["two"]["ci_low"] is not None
    pooled = {r["analysis_id"]: r for r in pooling.pooled(data, "DL").collect()}
    assert pooled["one"]["estimate"] == pytest.approx(0.5) and pooled["one"]["tau2"] == 0
    het = {r["analysis_id"]: r for r in pooling.heterogeneity(data).collect()}
    assert het["one"]["i2_low"] is None and het["two"]["i2_high"] is None


def test_rows_that_cannot_be_used_take_no_part(spark):
    data = spark.createDataFrame([("a", 0, 0.2, 0.1), ("a", 1, None, 0.1), ("a", 2, 0.3, 0.0), ("a", 3, 0.3, None)], "analysis_id string, row_index long, yi double, vi double")
    assert pooling.pooled(data, "DL").first()["k"] == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(-3, 3), st.floats(0.01, 2)), min_size=3, max_size=8))
def test_leave_one_out_is_a_refit(spark, studies):
    y, v = (np.array(x) for x in zip(*studies, strict=True))
    found = {r["row_index"]: r for r in bias.leave_one_out(rows(spark, {"a": (y, v)})).collect()}
    for i in range(y.size):
        keep = np.arange(y.size) != i
        tau2 = iterative.tau2_dl(y[keep], v[keep])
        w = 1 / (v[keep] + tau2)
        assert found[i]["estimate"] == pytest.approx((w * y[keep]).sum() / w.sum(), abs=1e-6)
        assert found[i]["se"] == pytest.approx(math.sqrt(1 / w.sum()), rel=1e-5)


def test_trim_and_fill_mirrors_the_missing_side(spark):
    y = [0.1, 0.15, 0.2, 0.3, 0.5, 0.8, 1.2]
    v = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4]
    row = iterative.trim_and_fill(rows(spark, {"a": (y, v)}), "DL").first()
    assert row["side"] == "left" and row["k0"] > 0 and row["filled_estimate"] < row["estimate"]


def test_an_empty_arm_has_no_effect_size(spark):
    arms = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 4.0), (2, 1.0, 3.0, 0.0, 0.0), (3, 0.0, 3.0, 1.0, 4.0)], "row_index long, e1 double, n1 double, e2 double, n2 double")
    for measure in ("OR", "RR", "RD"):
        found = {r["row_index"]: (r["excluded"], r["yi"], r["vi"]) for r in effect_tables.compute(arms, measure).collect()}
        assert found[1] == found[2] == ("no effect size", None, None)
        assert found[3][0] is None and found[3][2] > 0
    nobody = spark.createDataFrame([(1, 0.0, 0.0)], "row_index long, x double, n double")
    assert effect_tables.compute(nobody, "PLO").first()["excluded"] == "no effect size"


def test_rows_of_empty_arms_are_reported(spark):
    arms = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 4.0), (2, 1.0, 3.0, 2.0, 4.0)], "row_index long, e1 double, n1 double, e2 double, n2 double")
    found = [(r["row_index"], r["code"], r["detail"]) for r in validate.excluded_rows(effect_tables.compute(arms, "OR")).collect()]
    assert found == [(1, "V022", "no effect size")]


def test_a_prefix_of_one_study_has_no_tau2(spark):
    rng = np.random.default_rng(3)
    data = rows(spark, {f"a{k}": (rng.normal(0, 0.5, 2), rng.uniform(0.02, 0.4, 2)) for k in range(200)}).withColumn("at", F.col("row_index"))
    first = [r for r in bias.cumulative(data, "at").collect() if r["k"] == 1]
    assert len(first) == 200 and all(r["tau2"] == 0 for r in first)


def test_lines_without_a_part_are_as_in_sql(spark, tmp_path):
    """The key of a study may be null: its row is as complete as any."""
    load_all()
    lines = [(None, 0.05, "R"), (None, 0.01, "N"), (None, 0.07, "N"), (1, 0.06, "R"), (1, 0.02, "R"), (2, 0.01, "N"), (50, 0.06, "R"), (50, 0.02, "N")]
    spark.createDataFrame(lines, "l_partkey long, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("excluded_rows", "es_compute"):
        ours = catalog.QUERIES[name](spark, str(tmp_path))
        found = duckdb.connect()
        found.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        theirs = found.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in theirs.description]
        assert sorted((tuple(norm(r[c]) for c in names) for r in ours.collect()), key=repr) == sorted((tuple(map(norm, r)) for r in theirs.fetchall()), key=repr)
