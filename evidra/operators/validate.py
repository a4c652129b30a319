"""Validation rules as predicates that emit findings; rows are never dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.effects import paired_inputs
from evidra.functions.text import folded


def _finding(code: str, severity: str, condition: Column, detail: Column | str = "") -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail")))


def _emit(rows: DataFrame, findings: list[Column], key: str = "row_index") -> DataFrame:
    listed = rows.select(key, F.explode(F.array_compact(F.array(*findings))).alias("f"))
    return listed.select(key, "f.code", "f.severity", "f.detail")


def binary_rows(arms: DataFrame) -> DataFrame:
    """(row_index, code, severity, detail) of tables e1, n1, e2, n2: missing values (V002), sizes (V004), events (V006),
    double zero and double full tables (V008), zero cells (V009) and tiny arms (V020)."""
    a, n1, c, n2 = (F.col(x) for x in ("e1", "n1", "e2", "n2"))
    there = a.isNotNull() & n1.isNotNull() & c.isNotNull() & n2.isNotNull()
    whole = lambda x: x == F.floor(x)
    sizes = there & ((n1 < 1) | (n2 < 1) | ~whole(n1) | ~whole(n2))
    events = there & ((a < 0) | (c < 0) | (a > n1) | (c > n2) | ~whole(a) | ~whole(c))
    double = there & (((a == 0) & (c == 0)) | ((a == n1) & (c == n2)))
    zero = there & ~double & ((a == 0) | (c == 0) | (a == n1) | (c == n2))
    return _emit(arms, [_finding("V002", "error", ~there), _finding("V004", "error", sizes), _finding("V006", "error", events), _finding("V008", "warning", double), _finding("V009", "info", zero), _finding("V020", "info", there & (F.least(n1, n2) < 10))])


def continuous_rows(arms: DataFrame) -> DataFrame:
    """Findings of m1, sd1, n1, m2, sd2, n2: V002, V004 (two at least), V005 (SD not positive), V013 (skew) and V020."""
    m1, s1, n1, m2, s2, n2 = (F.col(x) for x in ("m1", "sd1", "n1", "m2", "sd2", "n2"))
    there = F.lit(True)
    for x in (m1, s1, n1, m2, s2, n2):
        there = there & x.isNotNull()
    skew = there & (((m1 >= 0) & (m1 < 2 * s1)) | ((m2 >= 0) & (m2 < 2 * s2)))
    return _emit(arms, [_finding("V002", "error", ~there), _finding("V004", "error", there & ((n1 < 2) | (n2 < 2) | (n1 != F.floor(n1)) | (n2 != F.floor(n2)))), _finding("V005", "error", there & ((s1 <= 0) | (s2 <= 0))), _finding("V013", "info", skew), _finding("V020", "info", there & (F.least(n1, n2) < 10))])


def cross_rows(studies: DataFrame) -> DataFrame:
    """Findings that compare rows of one analysis: repeated labels (V007), extreme log ratios beyond ln 20 (V014), and few
    studies (V015 below 5, V016 below 10), the last two on the analysis's first row. Labels meet case- and accent-blind."""
    usable = F.col("vi") > 0
    same = Window.partitionBy("analysis_id", folded(F.col("label")))
    whole = Window.partitionBy("analysis_id")
    rows = studies.withColumns({"__same": F.count(F.lit(1)).over(same), "__k": F.sum(F.when(usable, 1).otherwise(0)).over(whole), "__first": F.min("row_index").over(whole)})
    first = F.col("row_index") == F.col("__first")
    return _emit(rows, [_finding("V007", "warning", F.col("__same") > 1, F.col("label")), _finding("V014", "warning", usable & (F.abs("yi") > 2.995732273553991)), _finding("V015", "warning", first & (F.col("__k") < 5)), _finding("V016", "info", first & (F.col("__k") >= 5) & (F.col("__k") < 10)), _finding("V026", "error", first & (F.col("__k") == 0))])


def suspected_se(arms: DataFrame) -> DataFrame:
    """V011: an SD below 0.3 of its analysis's median that times root n is near the median, as a standard error would be."""
    whole = Window.partitionBy("analysis_id")
    out = None
    for s, n, other in (("sd1", "n1", "sd2"), ("sd2", "n2", "sd1")):
        sd, med = F.col(s), F.median(s).over(whole)
        size = F.col(n)
        odd = (sd < 0.3 * med) & (sd * F.sqrt(size) >= 0.5 * med) & (sd * F.sqrt(size) <= 2 * med) & ((F.col(other) < 0.3 * med) | (F.col(other) / sd >= F.sqrt(size) / 2))
        found = arms.withColumn("__odd", odd).where("__odd").select("row_index", F.lit("V011").alias("code"), F.lit("warning").alias("severity"), F.lit(s).alias("detail"))
        out = found if out is None else out.union(found)
    return out


def blocking(findings: DataFrame) -> DataFrame:
    """(row_index, codes): the error codes of each row that has any, sorted and joined."""
    return findings.where("severity = 'error'").groupBy("row_index").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def filtered(rows: DataFrame, include: list[tuple[str, str]], exclude: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, report of (filter, removed)): all includes, then all excludes; text meets folded, numbers within 1e-9
    relative."""

    def equal(column: str, value: str) -> Column:
        kind = dict(rows.dtypes)[column]
        if kind in ("double", "float", "int", "bigint", "smallint"):
            x = F.lit(value).try_cast("double")
            return F.coalesce(F.abs(F.col(column) - x) <= 1e-9 * F.greatest(F.abs(F.col(column)), F.abs(x), F.lit(1e-300)), F.lit(False))
        return F.coalesce(folded(F.col(column)) == folded(F.lit(value)), F.lit(False))

    stay = F.lit(True)
    removed = []
    for kind, pairs in (("include", include), ("exclude", exclude)):
        for column, value in pairs:
            hit = equal(column, value) if kind == "include" else ~equal(column, value)
            removed.append(F.sum((stay & ~hit).cast("long")).alias(f"{kind} {column}={value}"))
            stay = stay & hit
    if not removed:
        return rows, rows.sparkSession.createDataFrame([], "filter string, removed long")
    counted = rows.agg(*removed)
    report = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("filter"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("removed")) for c in counted.columns])).alias("r")).select("r.*")
    return rows.where(stay), report


def correlation_rows(rows: DataFrame) -> DataFrame:
    """Findings of r and n: V002, V010 (r not between -1 and 1), V004 (n not whole or below four)."""
    r, n = F.col("r"), F.col("n")
    there = r.isNotNull() & n.isNotNull()
    return _emit(rows, [_finding("V002", "error", ~there), _finding("V010", "error", there & ((r <= -1) | (r >= 1))), _finding("V004", "error", there & ((n < 4) | (n != F.floor(n))))])


def paired_rows(rows: DataFrame) -> DataFrame:
    """Findings of paired summaries: V002 where no set of inputs gives a mean or an SD of the changes, V004 (n below two or not
    whole), V005 (an SD of the changes that is not positive), V010 (r outside -1 to 1) and V020 (n below ten)."""
    n, r = F.col("n"), F.col("r")
    mean, sd = paired_inputs({c: F.col(c) for c in rows.columns})
    wrong_r = F.col("sd_diff").isNull() & F.col("sd1").isNotNull() & F.col("sd2").isNotNull() & ((r < -1) | (r > 1))
    missing = n.isNull() | mean.isNull() | (sd.isNull() & ~F.coalesce(wrong_r, F.lit(False)))
    return _emit(rows, [_finding("V002", "error", missing), _finding("V004", "error", (n < 2) | (n != F.floor(n))), _finding("V005", "error", sd <= 0), _finding("V010", "error", wrong_r), _finding("V020", "info", n < 10)])


def generic_rows(rows: DataFrame) -> DataFrame:
    """Findings of yi with vi or sei: V001 is for the header (``missing_columns``); V002, V005 (sei below 0), V030 (a variance so
    small that k^2 / vi^4 overflows, k the analysis's studies)."""
    k = F.count(F.lit(1)).over(Window.partitionBy("analysis_id")).cast("double")
    v = F.coalesce(F.col("vi"), F.col("sei") * F.col("sei"))
    whole = rows.withColumns({"__k": k, "__v": v})
    size = 2 * F.log10("__k") - 4 * F.log10(F.when(F.col("__v") > 0, F.col("__v")))
    return _emit(whole, [_finding("V002", "error", F.col("yi").isNull() | F.col("__v").isNull()), _finding("V005", "error", F.col("sei") < 0), _finding("V030", "error", size > 308)])


def flag_rows(rows: DataFrame, rob: dict[str, str], yes: list[str], no: list[str]) -> DataFrame:
    """Findings of the columns estimated and rob: V018 (estimated is a word for yes), V019 (a level of risk that ``rob`` maps to
    high or some), V027 (a word for neither, or an unknown level). Blank cells say nothing."""
    estimated, level = F.nullif(folded(F.col("estimated")), F.lit("")), F.nullif(folded(F.col("rob")), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in rob.items() for x in pair])
    kind = F.try_element_at(known, level)
    unknown = (estimated.isNotNull() & ~estimated.isin(*yes, *no)) | (level.isNotNull() & kind.isNull())
    return _emit(rows, [_finding("V018", "info", estimated.isin(*yes)), _finding("V019", "info", kind.isin("high", "some"), kind), _finding("V027", "warning", unknown)])


def label_rows(rows: DataFrame) -> DataFrame:
    """V029: rows with a blank label."""
    return _emit(rows, [_finding("V029", "warning", F.coalesce(F.trim("label"), F.lit("")) == "")])


def unit_mismatch(arms: DataFrame) -> DataFrame:
    """V012: a mean ten times the median of its analysis and an SD three times it, or a tenth and a third, from three complete rows
    on; detail names the arm."""
    complete = arms.where("m1 IS NOT NULL AND sd1 IS NOT NULL AND m2 IS NOT NULL AND sd2 IS NOT NULL")
    each = complete.select("analysis_id", F.explode(F.array(*[F.struct(F.abs(f"m{k}").alias("m"), F.col(f"sd{k}").alias("s")) for k in (1, 2)])).alias("c"))
    typical = each.groupBy("analysis_id").agg(F.median("c.m").alias("mm"), F.median("c.s").alias("ms"), (F.count(F.lit(1)) / 2).alias("k")).where("k >= 3 AND mm > 0 AND ms > 0")
    rows = complete.join(typical, "analysis_id")
    found = []
    for k in (1, 2):
        m, s = F.abs(f"m{k}") / F.col("mm"), F.col(f"sd{k}") / F.col("ms")
        found.append(_finding("V012", "warning", ((m >= 10) & (s >= 3)) | ((m <= 0.1) & (s <= 1 / 3)), f"arm {k}"))
    return _emit(rows, found)


def shared_control(arms: DataFrame) -> DataFrame:
    """V017: rows of one study_id whose control arm is the same (m2 and sd2, or the risk to four digits), unless control_split."""
    key = F.concat_ws("|", F.round("m2", 6), F.round("sd2", 6)) if "m2" in arms.columns else F.round(F.col("e2") / F.col("n2"), 4).cast("string")
    rows = arms.where("study_id IS NOT NULL").withColumn("__key", key)
    same = Window.partitionBy("study_id", "__key")
    marked = rows.withColumns({"__n": F.count(F.lit(1)).over(same), "__split": F.max(F.coalesce(F.col("control_split"), F.lit(False)).cast("int")).over(same)})
    return _emit(marked, [_finding("V017", "warning", (F.col("__n") > 1) & (F.col("__split") == 0), F.col("study_id").cast("string"))])


def excluded_rows(effects: DataFrame) -> DataFrame:
    """V022: rows without an effect size, with the reason."""
    return _emit(effects, [_finding("V022", "warning", F.col("excluded").isNotNull(), F.col("excluded"))])


def missing_columns(header: list[str], alternatives: list[list[str]]) -> list[str]:
    """The columns that V001 reports: those that the nearest of several sets of required columns lacks; none if any set is there."""
    lacking = [[c for c in need if c not in header] for need in alternatives]
    return min(lacking, key=len)


def acknowledged(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """``findings`` with acknowledged: whether the last decision (code, row_index, active, ts) on the same code and row holds."""
    last = Window.partitionBy("code", "row_index").orderBy(F.desc("ts"))
    held = decisions.withColumn("__n", F.row_number().over(last)).where("__n = 1 AND active").select("code", "row_index", F.lit(True).alias("acknowledged"))
    return findings.join(held, ["code", "row_index"], "left").withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))


def summary(findings: DataFrame) -> DataFrame:
    """(code, severity, n, rows, first): findings by code, with the number of rows and the first of them."""
    return findings.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_index").alias("rows"), F.min("row_index").alias("first"))


def option_findings(options: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """(run, name, problem) of options (run, name, value): unknown names, and values that a name does not allow."""
    listed = F.create_map(*[x for name, values in allowed.items() for x in (F.lit(name), F.array(*[F.lit(v) for v in values]))])
    own = F.try_element_at(listed, F.col("name"))
    problem = F.when(own.isNull(), "unknown option").when(~F.array_contains(own, F.col("value")), "value not allowed")
    return options.select("run", "name", problem.alias("problem")).where("problem IS NOT NULL")
