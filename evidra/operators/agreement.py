"""Agreement of two raters or two extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cohen_kappa(ratings: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, po, pe, kappa, se, label): kappa with the large-sample standard error of Fleiss, Cohen and Everitt; null where
    n is 0 or chance agreement is 1. Rows with a null rating take no part."""
    if not by:
        return cohen_kappa(ratings.withColumn("__all", F.lit(1)), a, b, ["__all"]).drop("__all")
    cells = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    n = cells.groupBy(*by).agg(F.sum("c").alias("n"))
    p = cells.join(n, by).select(*by, "a", "b", "n", (F.col("c") / F.col("n")).alias("p"))
    row = p.groupBy(*by, "a").agg(F.sum("p").alias("row_p"))
    col = p.groupBy(*by, "b").agg(F.sum("p").alias("col_p"))
    # The marginal of a category on the other side is 0 where that side never used it.
    rows_as_b, cols_as_a = row.select(*by, F.col("a").alias("b"), F.col("row_p").alias("row_of_b")), col.select(*by, F.col("b").alias("a"), F.col("col_p").alias("col_of_a"))
    full = p.join(rows_as_b, [*by, "b"], "left").join(cols_as_a, [*by, "a"], "left").na.fill(0.0, ["row_of_b", "col_of_a"])
    pe = row.join(col.withColumnRenamed("b", "a"), [*by, "a"]).groupBy(*by).agg(F.sum(F.col("row_p") * F.col("col_p")).alias("pe"))
    po = p.groupBy(*by).agg(F.first("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("p")).otherwise(0.0)).alias("po"))
    base = po.join(pe, by, "left").na.fill(0.0, ["pe"])
    kappa = F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0)))
    base = base.withColumn("kappa", kappa)
    k = full.join(base.select(*by, "kappa"), by)
    same = F.when(F.col("a") == F.col("b"), F.col("p") * F.pow(1 - (F.col("col_of_a") + F.col("row_of_b")) * (1 - F.col("kappa")), 2)).otherwise(0.0)
    off = F.when(F.col("a") != F.col("b"), F.col("p") * F.pow(F.col("col_of_a") + F.col("row_of_b"), 2)).otherwise(0.0)
    parts = k.groupBy(*by).agg(F.sum(same).alias("s1"), F.sum(off).alias("s2"))
    out = base.join(parts, by)
    shift = F.col("kappa") - F.col("pe") * (1 - F.col("kappa"))
    v = F.col("s1") + F.pow(1 - F.col("kappa"), 2) * F.col("s2") - shift * shift
    label = F.when(F.col("kappa") < 0, "poor").when(F.col("kappa") <= 0.2, "slight").when(F.col("kappa") <= 0.4, "fair").when(F.col("kappa") <= 0.6, "moderate").when(F.col("kappa") <= 0.8, "substantial").when(F.col("kappa").isNotNull(), "almost perfect")
    return out.select(*by, F.col("n").cast("long").alias("n"), "po", "pe", "kappa", (F.sqrt(F.greatest(v, F.lit(0.0))) / F.nullif((1 - F.col("pe")) * F.sqrt("n"), F.lit(0.0))).alias("se"), label.alias("label"))


def icc(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, icc): ICC(A,1) of two measurements of the same subjects, absolute agreement."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    count, mean_a, mean_b = rows.agg(F.count(F.lit(1)), F.avg("a"), F.avg("b")).first()
    grand, subject = F.lit(((mean_a or 0.0) + (mean_b or 0.0)) / 2), (F.col("a") + F.col("b")) / 2
    between = count * ((mean_a or 0.0) - (mean_b or 0.0)) ** 2 / 2
    sums = rows.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(2 * F.pow(subject - grand, 2)).alias("ssr"), F.lit(between).alias("ssc"),
        F.sum(F.pow(F.col("a") - grand, 2) + F.pow(F.col("b") - grand, 2)).alias("sst"),
    )
    n = F.col("n")
    msr, msc, mse = F.col("ssr") / F.nullif(n - 1, F.lit(0.0)), F.col("ssc"), (F.col("sst") - F.col("ssr") - F.col("ssc")) / F.nullif(n - 1, F.lit(0.0))
    return sums.select(n.cast("long").alias("n"), ((msr - mse) / F.nullif(msr + mse + 2 * (msc - mse) / F.nullif(n, F.lit(0.0)), F.lit(0.0))).alias("icc"))


def bland_altman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_diff, sd, low, high, max_abs) of a minus b."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    m = pairs.select(d.alias("d")).where("d IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.max(F.abs("d")).alias("max_abs"))
    return m.select("n", "mean_diff", "sd", (F.col("mean_diff") - 1.96 * F.col("sd")).alias("low"), (F.col("mean_diff") + 1.96 * F.col("sd")).alias("high"), "max_abs")


def table_diff(left: DataFrame, right: DataFrame, key: list[str], fields: list[str], rtol: float = 1e-3, atol: float = 1e-9) -> DataFrame:
    """(key, field, a, b, status) of each cell of two numeric tables: equal, within_tolerance, differs, missing_a, missing_b or
    both_empty. Repeated keys meet in the order of their values."""
    from pyspark.sql import Window

    def numbered(df: DataFrame, side: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(*fields)
        return df.select(*key, F.row_number().over(order).alias("__n"), *[F.col(f).cast("double").alias(f"{side}_{f}") for f in fields])

    both = numbered(left, "a").join(numbered(right, "b"), [*key, "__n"], "full")
    cells = both.select(*key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in fields])).alias("c")).select(*key, "c.*")
    a, b = F.col("a"), F.col("b")
    gap = F.abs(a - b)
    status = F.when(a.isNull() & b.isNull(), "both_empty").when(a.isNull(), "missing_a").when(b.isNull(), "missing_b").when(a == b, "equal").when(gap <= F.greatest(F.lit(atol), rtol * F.greatest(F.abs(a), F.abs(b))), "within_tolerance").otherwise("differs")
    return cells.withColumn("status", status)


def cause_hints(cells: DataFrame) -> DataFrame:
    """Hints why two numbers differ: a power of ten (2 percent), the sign, swapped digits of whole numbers, or rounding."""
    a, b = F.col("a"), F.col("b")
    ratio = F.abs(a / F.nullif(b, F.lit(0.0)))
    near = lambda x: F.abs(ratio / x - 1) <= 0.02
    digits = lambda x: F.array_join(F.array_sort(F.split(F.abs(x).cast("long").cast("string"), "")), "")
    hint = F.when(a == -b, "sign").when(near(10.0) | near(0.1), "factor 10").when(near(100.0) | near(0.01), "factor 100").when((a == F.floor(a)) & (b == F.floor(b)) & (digits(a) == digits(b)), "digits swapped").when(F.round(a, 1) == F.round(b, 1), "rounding")
    return cells.where("status = 'differs'").withColumn("hint", hint)


def icc_label(x: Column) -> Column:
    return F.when(x < 0.5, "poor").when(x < 0.75, "moderate").when(x < 0.9, "good").when(x.isNotNull(), "excellent")


def agreement_summary(cells: DataFrame) -> DataFrame:
    """(field, compared, agree, disagree, missing, percent) of ``table_diff`` cells: equal and within tolerance agree."""
    n = lambda *v: F.sum(F.col("status").isin(*v).cast("long"))
    m = cells.groupBy("field").agg(n("equal", "within_tolerance").alias("agree"), n("differs").alias("disagree"), n("missing_a", "missing_b").alias("missing"))
    return m.select("field", (F.col("agree") + F.col("disagree")).alias("compared"), "agree", "disagree", "missing", (100.0 * F.col("agree") / F.nullif(F.col("agree") + F.col("disagree"), F.lit(0))).alias("percent"))


def appraisal_agreement(pairs: DataFrame) -> DataFrame:
    """(level, name, n, kappa, label) of two appraisers' answers (level, name, a, b): by item, by domain and overall."""
    return cohen_kappa(pairs, "a", "b", ["level", "name"]).select("level", "name", "n", "kappa", "label")


def field_types(cells: DataFrame) -> DataFrame:
    """(field, type) of text cells (field, value): numeric if all are numbers, categorical with ten values at most that are no more than
    the larger of two and half the cells, else text. Blank cells don't count."""
    value = F.nullif(F.trim("value"), F.lit(""))
    number = F.replace(value, F.lit(","), F.lit(".")).try_cast("double")
    m = cells.select("field", value.alias("v"), number.alias("x")).where("v IS NOT NULL").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("numbers"), F.countDistinct("v").alias("values"))
    return m.select("field", F.when(F.col("numbers") == F.col("n"), "numeric").when((F.col("values") <= 10) & (F.col("values") <= F.greatest(F.lit(2.0), F.col("n") / 2)), "categorical").otherwise("text").alias("type"))


def reconciled(cells: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, value, state) of ``table_diff`` cells: agreeing ones keep a's value; others take a decision (key, field, chosen,
    value, seen_a, seen_b): a, b or other, stale if the cells are no longer those it saw, open without one."""
    both = cells.join(decisions.withColumnRenamed("value", "other"), [*key, "field"], "left")
    agree = F.col("status").isin("equal", "within_tolerance", "both_empty")
    stale = ~F.col("a").eqNullSafe(F.col("seen_a")) | ~F.col("b").eqNullSafe(F.col("seen_b"))
    state = F.when(agree, "agreed").when(F.col("chosen").isNull(), "open").when(stale, "stale").otherwise("decided")
    value = F.when(state == "agreed", F.col("a")).when(state == "decided", F.when(F.col("chosen") == "a", F.col("a")).when(F.col("chosen") == "b", F.col("b")).otherwise(F.col("other")))
    return both.select(*key, "field", value.alias("value"), state.alias("state"))


def impact(studies: DataFrame, disputed: DataFrame) -> DataFrame:
    """(analysis_id, row_index, base, other, shift, material): the fixed-effect estimate of each analysis (analysis_id, row_index, yi, vi)
    with one study as the other extraction has it (analysis_id, row_index, yi_b, vi_b), from the sums of all; material from 0.05
    standard errors on."""
    w = 1.0 / F.col("vi")
    sums = studies.groupBy("analysis_id").agg(F.sum(w).alias("sw"), F.sum(w * F.col("yi")).alias("swy"))
    both = studies.join(disputed, ["analysis_id", "row_index"]).join(sums, "analysis_id")
    wb = 1.0 / F.col("vi_b")
    base, other = F.col("swy") / F.col("sw"), (F.col("swy") - w * F.col("yi") + wb * F.col("yi_b")) / (F.col("sw") - w + wb)
    made = both.select("analysis_id", "row_index", base.alias("base"), other.alias("other"), "sw")
    return made.select("analysis_id", "row_index", "base", "other", (F.col("other") - F.col("base")).alias("shift"), (F.abs(F.col("other") - F.col("base")) * F.sqrt("sw") >= 0.05).alias("material"))


def rob_changes(table: DataFrame, finals: DataFrame) -> DataFrame:
    """(study, now, proposed): cells of a study table (study, rob) that the final judgement (study, level) would change."""
    return table.join(finals, "study").where("level IS NOT NULL AND NOT (rob <=> level)").select("study", F.col("rob").alias("now"), F.col("level").alias("proposed"))
