"""Requests for a conversion, one a row: the kind by name, the inputs as a map, the outputs as a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import effects as E
from evidra.functions import special as X
from evidra.functions.parse import means_from_medians

from .profiles import t_quantile

#: What each kind takes (in brackets: may be missing), gives, and whether its result is an estimate.
KINDS: dict[str, tuple[str, str, bool]] = {
    "median_to_mean_sd": ("n median [q1] [q3] [min] [max]", "mean sd", True),
    "se_to_sd": ("se n", "sd", False),
    "ci_to_sd": ("lower upper n [level]", "sd", False),
    "ci_to_se": ("lower upper [level] [df] [log]", "se", False),
    "p_to_se": ("estimate p [df] [log]", "se", False),
    "smd_variance": ("g n1 n2", "vi sei", False),
    "combine_groups": ("n1 m1 sd1 n2 m2 sd2", "n mean sd", False),
    "change_sd": ("sd_baseline sd_final corr", "sd_change", True),
    "corr_from_change": ("sd_baseline sd_final sd_change", "corr", False),
    "split_shared_control": ("n arms [events]", "n [events]", True),
    "paired_sums": ("n sum_d sum_sq_dev", "mdiff sd_diff n", False),
    "t_to_d": ("t n1 n2", "d g J vi sei", False),
    "logor_to_d": ("y v", "y v", True),
    "d_to_logor": ("y v", "y v", True),
    "r_to_d": ("y v", "y v", True),
    "d_to_r": ("y v n1 n2", "y v", True),
}

MOST_ARMS = 1000
PAIRS = "array<struct<key:string,value:double>>"


def _inputs(kind: str) -> tuple[list[str], list[str]]:
    """Names that must be there and all names."""
    words = KINDS[kind][0].split()
    return [w for w in words if w[0] != "["], [w.strip("[]") for w in words]


def converted(requests: DataFrame) -> DataFrame:
    """(row_index, kind, outputs, estimated, problem) of requests (row_index, kind, inputs: map of text to double), other columns left
    out.

    ``problem`` is null or the first of: kind (none, or unknown), input (a name that the kind doesn't take), missing (one that it
    needs, or its value is null or no finite number) and value (outside the conversion's domain); then ``outputs`` and
    ``estimated`` are null. Levels above 1 are percent, 0.95 where missing; ``log`` other than 0 means that limits or estimate are
    ratios; with ``df`` the critical value is that of t. A control group gives each of its arms, MOST_ARMS at most, a share n_1, n_2
    and so on, the remainder to the first arms, and so for its events where they are given."""
    kinds = requests.select("row_index", "kind", F.col("inputs").alias("x"))
    sql = X.norm_ppf
    made = kinds.select("row_index", "kind", "x", *[F.try_element_at("x", F.lit(n)).alias(f"i_{n}") for n in sorted({n for k in KINDS for n in _inputs(k)[1]})])

    def i(name: str) -> Column:
        return F.col(f"i_{name}")

    level = E.normal_level(F.coalesce(i("level"), F.lit(0.95)))
    ratio = F.coalesce(i("log") != 0, F.lit(False))
    needs_t = (F.col("kind") == "ci_to_sd") | F.col("kind").isin("ci_to_se", "p_to_se") & i("df").isNotNull()
    df = F.when(F.col("kind") == "ci_to_sd", i("n") - 1).otherwise(i("df"))
    tail = F.when(F.col("kind") == "p_to_se", 1 - i("p") / 2).otherwise(0.5 + level / 2)
    able = needs_t & (df > 0) & (tail > 0.5) & (tail < 1)
    made = made.withColumn("tail", F.when((tail > 0.5) & (tail < 1), tail)).withColumn("df", F.when(able, df))
    # Only rows that need a t quantile go through the one vectorised function; their share of the batch is what it computes.
    made = made.withColumn("t", t_quantile(F.coalesce("tail", F.lit(0.5)), F.coalesce("df", F.lit(0.0))))
    crit = F.col("crit")
    # What several outputs share is a column of its own, so it is evaluated, and planned, once.
    made = made.withColumns({
        "chance": F.when(F.col("kind") == "median_to_mean_sd", (i("n") - 0.375) / (i("n") + 0.25)).otherwise(F.col("tail")),
        "quarter": (0.75 * i("n") - 0.125) / (i("n") + 0.25),
        "j": E.hedges_j(i("n1") + i("n2") - 2), "d": E.d_from_t(i("t"), i("n1"), i("n2")),
    })
    made = made.withColumn("xi", F.expr(sql("chance"))).withColumn("eta", F.expr(sql("quarter")))
    made = made.withColumn("crit", F.when(needs_t, F.when(F.col("df").isNotNull(), F.col("t"))).otherwise(F.col("xi")))
    y = F.when(F.col("kind") == "t_to_d", F.col("d") * F.col("j")).otherwise(i("g"))
    made = made.withColumn("g", y)
    made = made.withColumn("vi", E.smd_variance(F.col("g"), i("n1"), i("n2")))

    low, high = F.when(ratio, E.log(i("lower"))).otherwise(i("lower")), F.when(ratio, E.log(i("upper"))).otherwise(i("upper"))
    estimate = F.when(ratio, E.log(i("estimate"))).otherwise(i("estimate"))
    width = F.when(high > low, high - low)
    n, n1, n2 = i("n"), i("n1"), i("n2")
    d, j, g, vi = (F.col(c) for c in ("d", "j", "g", "vi"))
    arms = F.when((i("arms") >= 1) & (i("arms") <= MOST_ARMS) & (F.floor("i_arms") == i("arms")), i("arms").cast("int"))

    out: dict[str, tuple[Column, ...]] = {
        "median_to_mean_sd": _from_median(),
        "se_to_sd": (F.when((i("se") >= 0) & (n >= 1), i("se") * F.sqrt(n)),),
        "ci_to_sd": (F.when(n >= 2, F.sqrt(n) * F.when(i("upper") > i("lower"), i("upper") - i("lower")) / (2 * crit)),),
        "ci_to_se": (width / (2 * crit),),
        "p_to_se": (F.when((i("p") > 0) & (i("p") < 1) & (estimate != 0), F.abs(estimate) / crit),),
        "smd_variance": _positive(n1, n2, (vi, F.sqrt(vi))),
        "combine_groups": _positive(n1, n2, E.combine_groups(n1, i("m1"), i("sd1"), n2, i("m2"), i("sd2"))),
        "change_sd": (F.when((F.abs("i_corr") <= 1) & (i("sd_baseline") >= 0) & (i("sd_final") >= 0), E.sd_diff(i("sd_baseline"), i("sd_final"), i("corr"))),),
        "corr_from_change": (E.corr_from_change(i("sd_baseline"), i("sd_final"), i("sd_change")),),
        "paired_sums": tuple(F.when((n >= 2) & (i("sum_sq_dev") >= 0), v) for v in (*E.paired_from_sums(n, i("sum_d"), i("sum_sq_dev")), n)),
        "t_to_d": _positive(n1, n2, (d, g, j, vi, F.sqrt(vi))),
        "logor_to_d": _variance(i("v"), E.logor_to_d(i("y"), i("v"))),
        "d_to_logor": _variance(i("v"), E.d_to_logor(i("y"), i("v"))),
        "r_to_d": tuple(F.when(F.abs("i_y") < 1, v) for v in _variance(i("v"), E.r_to_d(i("y"), i("v")))),
        "d_to_r": _positive(n1, n2, _variance(i("v"), E.d_to_r(i("y"), i("v"), n1, n2))),
    }
    split = F.concat(_shares("n", n, arms), F.coalesce(_shares("events", i("events"), arms), F.array().cast(PAIRS)))
    fits = arms.isNotNull() & (n >= arms) & F.coalesce((i("events") >= 0) & (i("events") <= n), F.lit(True))
    each = F.when(F.col("kind") == "split_shared_control", F.when(fits, split))
    need = known = estimated = F.when(F.lit(False), None)
    for kind, (_, names, estimate_only) in KINDS.items():
        here = F.col("kind") == kind
        wanted, taken = _inputs(kind)
        need, known = need.when(here, F.array(*map(F.lit, wanted))), known.when(here, F.array(*map(F.lit, taken)))
        estimated = estimated.when(here, F.lit(estimate_only))
        if kind in out:
            pairs = [F.struct(F.lit(name).alias("key"), value.cast("double").alias("value")) for name, value in zip(names.split(), out[kind], strict=True)]
            each = each.when(here, F.array(*pairs))

    def number(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    made = made.select("row_index", "kind", "x", each.alias("each"), need.alias("need"), known.alias("known"), estimated.alias("estimated"))
    absent = F.col("x").isNull() | F.exists("need", lambda name: ~number(F.try_element_at("x", name)))
    problem = (
        F.when(F.col("known").isNull(), "kind")
        .when(F.size(F.array_except(F.map_keys("x"), F.col("known"))) > 0, "input")
        .when(absent, "missing")
        .when(~F.coalesce(F.forall("each", lambda p: number(p["value"])), F.lit(False)), "value")
    )
    made = made.withColumn("problem", problem)
    sound = F.col("problem").isNull()
    return made.select(
        "row_index", "kind", F.when(sound, F.map_from_entries(F.when(sound, F.col("each")))).alias("outputs"),
        F.when(sound, F.col("estimated")).alias("estimated"), "problem",
    )


def _shares(name: str, total: Column, arms: Column) -> Column:
    """(key, value) of each arm: equal parts of a total, the remainder to the first arms."""
    base = F.floor(total / arms)
    share = lambda k: (base + F.when(k <= total - base * arms, 1).otherwise(0)).cast("double")
    numbered = F.transform(F.sequence(F.lit(1), arms), lambda k: F.struct(F.concat(F.lit(f"{name}_"), k).alias("key"), share(k).alias("value")))
    return F.when(total.isNotNull(), numbered)


def _positive(n1: Column, n2: Column, values: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(F.when((n1 >= 1) & (n2 >= 1) & (n1 + n2 > 3), v) for v in values)


def _variance(v: Column, values: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(F.when(v >= 0, x) for x in values)


def _from_median() -> tuple[Column, Column]:
    """Mean by Luo and SD by Wan, from quartiles and range where both are there, else from the one that is."""
    n, m, q1, q3, a, b = (F.col(f"i_{c}") for c in ("n", "median", "q1", "q3", "min", "max"))
    means = means_from_medians(n, m, q1, q3, a, b)
    quartiles, extremes = q1.isNotNull() & q3.isNotNull(), a.isNotNull() & b.isNotNull()
    ordered = (n >= 2) & F.coalesce(q1 <= m, F.lit(True)) & F.coalesce(m <= q3, F.lit(True)) & F.coalesce(a <= F.coalesce(q1, m), F.lit(True)) & F.coalesce(F.coalesce(q3, m) <= b, F.lit(True))
    by_range = (b - a) / (2 * F.col("xi"))
    by_quartiles = (q3 - q1) / (2 * F.col("eta"))
    mean = F.when(quartiles & extremes, means["s3"]).when(quartiles, means["s2"]).when(extremes, means["s1"])
    sd = F.when(quartiles & extremes, (by_range + by_quartiles) / 2).when(quartiles, by_quartiles).when(extremes, by_range)
    return F.when(ordered, mean), F.when(ordered, sd)
