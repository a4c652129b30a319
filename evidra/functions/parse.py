"""Parsing of cells, citations and dates, conversions from medians, and small rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .special import norm_ppf

_NUM = r"[-+]?\d+(?:\.\d+)?"


def cell_values(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, kind, a, b) of cells like ``m (sd)``, ``m ± sd`` (mean_sd) and ``e/n (p%)`` (events); others give nothing."""
    x = F.trim(F.col(column))
    events, mean = rf"^(\d+)\s*/\s*(\d+)(?:\s*\({_NUM}\s*%\))?$", rf"^({_NUM})\s*(?:\(({_NUM})\)|±\s*({_NUM}))$"
    part = lambda p, k: F.nullif(F.regexp_extract(x, p, k), F.lit("")).cast("double")
    kind = F.when(x.rlike(events), "events").when(x.rlike(mean), "mean_sd")
    a = F.when(x.rlike(events), part(events, 1)).otherwise(part(mean, 1))
    b = F.when(x.rlike(events), part(events, 2)).otherwise(F.coalesce(part(mean, 2), part(mean, 3)))
    return rows.select(key, kind.alias("kind"), a.alias("a"), b.alias("b")).where("kind IS NOT NULL")


def author_year(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, surname, year, suffix) of labels like ``Smith et al. (2010a)``."""
    pattern = r"^([^\s,(]+)(?:\s+(?:et al\.?|and|&)[^(]*)?\s*[(,]?\s*((?:19|20)\d{2})([a-z]?)\)?$"
    x = F.col(column)
    return rows.where(x.rlike(pattern)).select(key, F.regexp_extract(x, pattern, 1).alias("surname"), F.regexp_extract(x, pattern, 2).cast("int").alias("year"), F.nullif(F.regexp_extract(x, pattern, 3), F.lit("")).alias("suffix"))


def reference_ranges(rows: DataFrame, key: str, column: str, most: int = 10_000) -> DataFrame:
    """(key, ref) of each number in brackets, ranges like 24–28 expanded; a range of more than ``most`` numbers is taken for
    something else."""
    inside = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"\[([\d,\s–-]+)\]"), 1))
    parts = rows.select(key, inside.alias("p")).select(key, F.explode(F.split("p", r"\s*,\s*")).alias("p"))
    first, last = F.regexp_extract("p", r"^\s*(\d+)", 1).try_cast("int"), F.regexp_extract("p", r"[–-]\s*(\d+)\s*$", 1).try_cast("int")
    ends = parts.select(key, first.alias("a"), F.coalesce(last, first).alias("b")).where(f"a IS NOT NULL AND b BETWEEN a AND a + {most - 1}")
    return ends.select(key, F.explode(F.sequence("a", "b")).alias("ref"))


def partial_date(text: Column) -> tuple[Column, Column]:
    """(first day, precision) of Y, Y-M and Y-M-D."""
    year, month = text.rlike(r"^\d{4}$"), text.rlike(r"^\d{4}-\d{2}$")
    full = F.when(year, F.concat(text, F.lit("-01-01"))).when(month, F.concat(text, F.lit("-01"))).otherwise(text)
    day = full.try_cast("date")
    return day, F.when(day.isNull(), None).when(year, "year").when(month, "month").otherwise("day")


def means_from_medians(n: Column, m: Column, q1: Column, q3: Column, a: Column, b: Column) -> dict[str, Column]:
    """Luo's weights for min-median-max (s1), quartiles (s2) and all five (s3), and Hozo's mean."""
    p = F.pow(n, 0.75)
    w1, w2, w3, w4 = 4 / (4 + p), 0.7 + 0.39 / n, 2.2 / (2.2 + p), 0.7 - 0.72 / F.pow(n, 0.55)
    return {"s1": w1 * (a + b) / 2 + (1 - w1) * m, "s2": w2 * (q1 + q3) / 2 + (1 - w2) * m, "s3": w3 * (a + b) / 2 + w4 * (q1 + q3) / 2 + (1 - w3 - w4) * m, "hozo": (a + 2 * m + b) / 4}


def sds_from_medians(rows: DataFrame) -> DataFrame:
    """(row_index, from_range, from_quartiles) by Wan's divisors."""
    q = {"a": norm_ppf("((n - 0.375e0) / (n + 0.25e0))"), "b": norm_ppf("((0.75e0 * n - 0.125e0) / (n + 0.25e0))")}
    return rows.where("n >= 2").select("row_index", F.expr(f"(hi - lo) / (2e0 * {q['a']})").alias("from_range"), F.expr(f"(q3 - q1) / (2e0 * {q['b']})").alias("from_quartiles"))


def split_shared_control(rows: DataFrame, key: str, arms: str, n: str) -> DataFrame:
    """(key, arm, n): a control group's size split among the arms that share it, the remainder to the first ones."""
    each = rows.select(key, F.col(n).alias("all"), F.col(arms).alias("arms"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(arms))).alias("arm"))
    return each.select(key, "arm", (F.expr("all div arms") + F.when(F.col("arm") <= F.col("all") % F.col("arms"), 1).otherwise(0)).alias("n"))


def absolute_risk(measure: str, effect: Column, risk: Column) -> Column:
    """The treated risk at a control risk; null outside 0 to 1."""
    made = {"OR": F.exp(effect) * risk / (1 - risk + F.exp(effect) * risk), "RR": F.exp(effect) * risk, "RD": risk + effect}[measure]
    return F.when((made >= 0) & (made <= 1), made)


def nice_step(raw: Column) -> Column:
    """The least of 1, 2, 2.5, 5 and 10 times a power of ten that is not below ``raw``."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    x = raw / p
    return p * F.when(x <= 1, 1.0).when(x <= 2, 2.0).when(x <= 2.5, 2.5).when(x <= 5, 5.0).otherwise(10.0)


def _uid(text: Column) -> Column:
    """r and the first six letters of the base-32 form of the text's SHA-1: thirty bits of it, five to a letter."""
    bits = F.shiftright(F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long"), 2)
    letters = [F.substring(F.lit("abcdefghijklmnopqrstuvwxyz234567"), F.shiftright(bits, 5 * (5 - k)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(6)]
    return F.concat(F.lit("r"), *letters)


def row_uids(rows: DataFrame, label: str, index: str) -> DataFrame:
    """(index, row_uid, met): the uid of ``label|index``; rows that meet get ``|1``, ``|2`` and so on behind the hashed text, in the
    order of their index."""
    plain = F.concat_ws("|", F.coalesce(F.col(label), F.lit("")), F.col(index))
    first = rows.select(index, plain.alias("__t")).withColumn("__u", _uid(F.col("__t")))
    same = Window.partitionBy("__u")
    met = first.withColumns({"__n": F.row_number().over(same.orderBy(index)) - 1, "met": F.count(F.lit(1)).over(same) > 1})
    return met.select(index, F.when(F.col("__n") == 0, F.col("__u")).otherwise(_uid(F.concat_ws("|", "__t", "__n"))).alias("row_uid"), "met")
