"""Requests for conversions, one a row, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import special as X
from evidra.operators import convert
from evidra.sources import studies as S

from .catalog import query, rounded
from .catalog_effects import _JX

#: Requests that every supplier with two arms makes: kind, inputs as SQL, outputs as SQL, the condition under which they exist.
_T10 = "2.2281388519649385"  # the quantile 0.975 of t with ten degrees of freedom
_A = "((n1 + n2) * (n1 + n2) / (n1 * n2))"
_LO, _HI = X.norm_ppf("((n1 - 0.375e0) / (n1 + 0.25e0))"), X.norm_ppf("((0.75e0 * n1 - 0.125e0) / (n1 + 0.25e0))")
_P3 = "pow(n1, 0.75)"
_G = "(m1 - m2) / 10"
_J = _JX.format(m="(n1 + n2 - 2)")
_GT = f"({_J} * (m1 - m2) * sqrt(1 / n1 + 1 / n2))"
REQUESTS: list[tuple[str, dict[str, str], dict[str, str], str]] = [
    ("median_to_mean_sd", {"n": "n1", "median": "m1", "min": "m1 - 3 * sd1", "max": "m1 + 2 * sd1"}, {"mean": f"(4 / (4 + {_P3})) * (2 * m1 - sd1) / 2 + (1 - 4 / (4 + {_P3})) * m1", "sd": f"5 * sd1 / (2 * {_LO})"}, "n1 >= 2"),
    ("median_to_mean_sd", {"n": "n1", "median": "m1", "q1": "m1 - sd1", "q3": "m1 + 2 * sd1"}, {"mean": "(0.7 + 0.39 / n1) * (2 * m1 + sd1) / 2 + (0.3 - 0.39 / n1) * m1", "sd": f"3 * sd1 / (2 * {_HI})"}, "n1 >= 2"),
    ("median_to_mean_sd", {"n": "n1", "median": "m1"}, {}, "false"),
    ("se_to_sd", {"se": "sd1", "n": "n1"}, {"sd": "sd1 * sqrt(n1)"}, "true"),
    ("ci_to_sd", {"lower": "m1 - 1", "upper": "m1 + sd1", "n": "11e0"}, {"sd": f"sqrt(11e0) * (sd1 + 1) / (2 * {_T10})"}, "sd1 > -1"),
    ("ci_to_se", {"lower": "m1", "upper": "m1 + sd1", "level": "95e0", "df": "10e0"}, {"se": f"sd1 / (2 * {_T10})"}, "sd1 > 0"),
    ("ci_to_se", {"lower": "n1", "upper": "n1 + n2", "log": "1e0"}, {"se": "ln((n1 + n2) / n1) / (2 * 1.959963984540054)"}, "true"),
    ("p_to_se", {"estimate": "m1 - m2", "p": "0.05e0"}, {"se": "abs(m1 - m2) / 1.959963984540054"}, "m1 <> m2"),
    ("p_to_se", {"estimate": "m1 - m2", "p": "0.05e0", "df": "10e0"}, {"se": f"abs(m1 - m2) / {_T10}"}, "m1 <> m2"),
    ("smd_variance", {"g": _G, "n1": "n1", "n2": "n2"}, {"vi": f"1 / n1 + 1 / n2 + pow({_G}, 2) / (2 * (n1 + n2))", "sei": f"sqrt(1 / n1 + 1 / n2 + pow({_G}, 2) / (2 * (n1 + n2)))"}, "n1 + n2 > 3"),
    ("combine_groups", {c: c for c in ("n1", "m1", "sd1", "n2", "m2", "sd2")}, {"n": "n1 + n2", "mean": "(n1 * m1 + n2 * m2) / (n1 + n2)", "sd": "sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2 + n1 * n2 / (n1 + n2) * pow(m1 - m2, 2)) / (n1 + n2 - 1))"}, "true"),
    ("change_sd", {"sd_baseline": "sd1", "sd_final": "sd2", "corr": "0.5e0"}, {"sd_change": "sqrt(sd1 * sd1 + sd2 * sd2 - sd1 * sd2)"}, "true"),
    ("change_sd", {"sd_baseline": "sd1", "sd_final": "sd2", "corr": "1.5e0"}, {}, "false"),
    ("corr_from_change", {"sd_baseline": "sd1 + 1", "sd_final": "sd2 + 1", "sd_change": "1e0"}, {"corr": "(pow(sd1 + 1, 2) + pow(sd2 + 1, 2) - 1) / (2 * (sd1 + 1) * (sd2 + 1))"}, "(pow(sd1 + 1, 2) + pow(sd2 + 1, 2) - 1) / (2 * (sd1 + 1) * (sd2 + 1)) <= 1"),
    ("split_shared_control", {"n": "n1 + 3", "arms": "3e0"}, {f"n_{k + 1}": f"floor((n1 + 3) / 3) + CASE WHEN (n1 + 3) - 3 * floor((n1 + 3) / 3) > {k} THEN 1 ELSE 0 END" for k in range(3)}, "true"),
    ("paired_sums", {"n": "n1", "sum_d": "m1", "sum_sq_dev": "sd1"}, {"mdiff": "m1 / n1", "sd_diff": "sqrt(sd1 / (n1 - 1))", "n": "n1"}, "true"),
    ("t_to_d", {"t": "m1 - m2", "n1": "n1", "n2": "n2"}, {"d": "(m1 - m2) * sqrt(1 / n1 + 1 / n2)", "g": _GT, "J": _J, "vi": f"1 / n1 + 1 / n2 + pow({_GT}, 2) / (2 * (n1 + n2))", "sei": f"sqrt(1 / n1 + 1 / n2 + pow({_GT}, 2) / (2 * (n1 + n2)))"}, "n1 + n2 > 3"),
    ("logor_to_d", {"y": "m1 - m2", "v": "sd1"}, {"y": f"(m1 - m2) * {math.sqrt(3) / math.pi!r}", "v": f"sd1 * {3 / math.pi**2!r}"}, "true"),
    ("d_to_logor", {"y": "m1 - m2", "v": "sd1"}, {"y": f"(m1 - m2) * {math.pi / math.sqrt(3)!r}", "v": f"sd1 * {math.pi**2 / 3!r}"}, "true"),
    ("r_to_d", {"y": "(m1 - m2) / 40", "v": "sd1"}, {"y": "(m1 - m2) / 20 / sqrt(1 - pow((m1 - m2) / 40, 2))", "v": "4 * sd1 / pow(1 - pow((m1 - m2) / 40, 2), 3)"}, "abs(m1 - m2) < 40"),
    ("d_to_r", {"y": "m1 - m2", "v": "sd1", "n1": "n1", "n2": "n2"}, {"y": f"(m1 - m2) / sqrt(pow(m1 - m2, 2) + {_A})", "v": f"{_A} * {_A} * sd1 / pow(pow(m1 - m2, 2) + {_A}, 3)"}, "n1 + n2 > 3"),
]
FAULTS = [("hatch", {"n": "n1"}, "kind"), ("se_to_sd", {"se": "sd1", "n": "n1", "level": "1e0"}, "input"), ("se_to_sd", {"se": "sd1"}, "missing"), ("d_to_r", {"y": "m1", "v": "-1e0", "n1": "n1", "n2": "n2"}, "value")]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request of every supplier, numbered ``place`` behind the supplier's key."""

    def one(place: int, kind: str, inputs: dict[str, str]) -> Column:
        pairs = [x for name, sql in inputs.items() for x in (F.lit(name), F.expr(f"double({sql})"))]
        return F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.create_map(*pairs).alias("inputs"))

    asked = [(k, i) for k, i, *_ in REQUESTS] + [(k, i) for k, i, _ in FAULTS]
    rows = S.arms_continuous(spark, sf_dir).select(F.col("row_index").alias("study"), F.explode(F.array(*[one(p, *a) for p, a in enumerate(asked)])).alias("a"))
    return rows.select(F.struct("study", "a.place").alias("row_index"), "a.kind", "a.inputs")


def _sql() -> str:
    parts = []
    for place, (kind, _, outputs, when) in enumerate(REQUESTS):
        estimated = str(convert.KINDS[kind][2]).lower()
        for name, value in outputs.items():
            parts.append(f"SELECT row_index AS study, {place} AS place, '{kind}' AS kind, '{name}' AS output, ({value})::DOUBLE AS value, {estimated} AS estimated, NULL AS problem FROM arms WHERE {when}")
        parts.append(f"SELECT row_index, {place}, '{kind}', NULL, NULL, NULL, 'value' FROM arms WHERE NOT ({when})")
    for place, (kind, _, problem) in enumerate(FAULTS, len(REQUESTS)):
        parts.append(f"SELECT row_index, {place}, '{kind}', NULL, NULL, NULL, '{problem}' FROM arms")
    return f"WITH {S.CONTINUOUS}, o AS ({' UNION ALL '.join(parts)}) SELECT study, place, kind, output, round(value, 6) + 0.0 AS value, estimated, problem FROM o"


@query("convert_requests", _sql())
def convert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = convert.converted(requests(spark, sf_dir))
    return rounded(made.select(F.col("row_index.study").alias("study"), F.col("row_index.place").alias("place"), "kind", F.explode_outer("outputs").alias("output", "value"), "estimated", "problem"))
