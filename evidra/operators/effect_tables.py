"""Tables of effect sizes: one expression for any measure, what is excluded and why, labels, and small rules about measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import effects as E

BINARY, PROPORTIONS, CORRELATIONS = ("OR", "RR", "RD"), ("PR", "PLN", "PLO", "PAS", "PFT"), ("COR", "ZCOR")
SIZES = ("n1", "n2", "n")
#: The columns that a measure needs.
NEEDS = {m: ("e1", "n1", "e2", "n2") for m in BINARY} | {m: ("x", "n") for m in PROPORTIONS} | {m: ("r", "n") for m in CORRELATIONS}
NEEDS |= {m: ("m1", "sd1", "n1", "m2", "sd2", "n2") for m in ("MD", "SMD", "D", "GLASS", "ROM")} | {m: ("mdiff", "sd_diff", "n") for m in ("MC", "SMCC")} | {"GEN": ("yi", "vi")}


def effect(measure: str, **options: object) -> tuple[Column, Column]:
    """(yi, vi) of a row as expressions of the columns that ``NEEDS`` lists; none of an empty arm or sample."""
    given = [F.when(F.col(c) > 0, F.col(c)) if c in SIZES else F.col(c) for c in NEEDS[measure]]
    if measure in BINARY:
        return E.two_by_two(measure, *given, **options)
    if measure in PROPORTIONS:
        return E.proportion(measure, *given, **options)
    if measure in CORRELATIONS:
        return E.correlation(measure, *given)
    if measure == "D":
        return E.smd(*given, correct=False, **options)
    made = {"MD": E.md, "SMD": E.smd, "GLASS": E.glass, "ROM": E.rom, "MC": E.mean_change, "SMCC": E.smcc, "GEN": lambda y, v: (y, v)}
    return made[measure](*given, **options)


def row_label(label: Column, index: Column) -> Column:
    """The label, or ``#index`` where it is blank."""
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), F.concat(F.lit("#"), index.cast("string")))


def compute(rows: DataFrame, measure: str, blocked: DataFrame | None = None, **options: object) -> DataFrame:
    """``rows`` with label, yi, vi and excluded: null, or why a row takes no part: blocked by a finding (row_index in ``blocked``),
    a missing value, or no finite effect size with a positive variance, as that of an empty arm or sample. Excluded rows have
    neither yi nor vi."""
    missing = F.lit(False)
    for c in NEEDS[measure]:
        missing = missing | F.col(c).isNull()
    y, v = effect(measure, **options)
    own = rows if blocked is None else rows.join(blocked.select("row_index").distinct().withColumn("__blocked", F.lit(True)), "row_index", "left")
    stop = F.coalesce(F.col("__blocked"), F.lit(False)) if blocked is not None else F.lit(False)
    inf = float("inf")
    fine = F.coalesce((F.abs("__y") < inf) & (F.col("__v") > 0) & (F.col("__v") < inf), F.lit(False))
    made = own.withColumns({"__y": y, "__v": v})
    why = F.when(stop, "blocked").when(missing, "missing value").when(~fine, "no effect size")
    label = row_label(F.col("study"), F.col("row_index")) if "study" in rows.columns else row_label(F.lit(""), F.col("row_index"))
    out = made.withColumns({"label": label, "excluded": why})
    return out.withColumns({"yi": F.when(F.col("excluded").isNull(), F.col("__y")), "vi": F.when(F.col("excluded").isNull(), F.col("__v"))}).drop("__y", "__v", "__blocked")


def labels_from_ids(rows: DataFrame) -> DataFrame:
    """(row_index, label): the study's id, with a number behind it where several rows share it; ``#index`` without one."""
    same = Window.partitionBy("study_id")
    marked = rows.withColumns({"__n": F.count(F.lit(1)).over(same), "__k": F.row_number().over(same.orderBy("row_index"))})
    own = F.when(F.col("__n") > 1, F.concat("study_id", F.lit(" ("), "__k", F.lit(")"))).otherwise(F.col("study_id"))
    return marked.select("row_index", F.when(F.col("study_id").isNull(), row_label(F.lit(""), F.col("row_index"))).otherwise(own).alias("label"))


def level_text(x: Column) -> Column:
    """A number as a group's name: whole numbers without decimals."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def typical_sd(studies: DataFrame) -> DataFrame:
    """(analysis_id, sd): the root of the variances v / (1 / n1 + 1 / n2), weighted by n1 + n2 - 2."""
    w = F.col("n1") + F.col("n2") - 2
    s2 = F.col("vi") / (1.0 / F.col("n1") + 1.0 / F.col("n2"))
    return studies.where("vi > 0 AND n1 + n2 > 2").groupBy("analysis_id").agg(F.sqrt(F.sum(w * s2) / F.sum(w)).alias("sd"))


def recommended_tests(measure: Column) -> Column:
    """The tests of small-study effects that suit a measure, joined by commas: those of 2x2 tables for binary ones, nothing for
    proportions."""
    return F.when(measure.isin(*PROPORTIONS), "").when(measure.isin(*BINARY), "harbord,peters").otherwise("egger")


def bias_gate(k: Column, least: int = 10) -> Column:
    return F.when(k < 3, "not run").when(k < least, "few studies").otherwise("run")
