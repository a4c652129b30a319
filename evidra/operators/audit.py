"""Audit of artefacts against each other: every rule is a join, an anti join or a comparison of counts, and gives findings.

A rule that lacks what it compares reports nothing for that row; ``skipped`` lists what could not be checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__n", place).where("__n = 1").drop("__n")


def figure_findings(figures: DataFrame, runs: DataFrame) -> DataFrame:
    """(figure, code) of figures (figure, spec, run, qc): X002 where the run is not its spec's latest (spec, run, ts), X018 where the
    quality check is not clean."""
    last = latest(runs, ["spec"], ["ts", "run"]).select("spec", F.col("run").alias("last"))
    both = figures.join(last, "spec")
    codes = F.array_compact(F.array(F.when(F.col("run") != F.col("last"), "X002"), F.when(F.coalesce(F.col("qc"), F.lit("")) != "clean", "X018")))
    return both.select("figure", F.explode(codes).alias("code"))


def judgement_findings(table: DataFrame, finals: DataFrame) -> DataFrame:
    """(study, code) of a study table (study, rob): X003 where the final judgement (study, level) differs, X004 where there is none."""
    both = table.join(finals, "study", "left")
    code = F.when(F.col("level").isNull(), "X004").when(~F.col("level").eqNullSafe(F.col("rob")), "X003")
    return both.select("study", code.alias("code")).where("code IS NOT NULL")


def sensitivity_findings(flags: DataFrame, removed: DataFrame, runs: DataFrame) -> DataFrame:
    """(outcome, flag, code): X005 for estimated rows, X006 for others, where rows (outcome, row_index, flag) exist and no run leaves
    all of them out while it keeps some row. ``removed`` (run, row_index) lists what a run leaves out, ``runs`` (run, outcome, kept)
    how many rows it keeps."""
    need = flags.groupBy("outcome", "flag").agg(F.count(F.lit(1)).alias("need"))
    hit = flags.join(runs.where("kept > 0").select("run", "outcome"), "outcome").join(removed, ["run", "row_index"])
    done = hit.groupBy("outcome", "flag", "run").agg(F.count(F.lit(1)).alias("got")).join(need, ["outcome", "flag"]).where("got = need").select("outcome", "flag").distinct()
    return need.join(done, ["outcome", "flag"], "left_anti").select("outcome", "flag", F.when(F.col("flag") == "estimated", "X005").otherwise("X006").alias("code"))


def number_findings(reported: DataFrame, runs: DataFrame, code: str, tolerance: float = 1e-6) -> DataFrame:
    """(outcome, field, code) where a reported number (outcome, field, value) is not that of the run (outcome, field, value)."""
    both = reported.join(runs.withColumnRenamed("value", "own"), ["outcome", "field"])
    off = F.abs(F.col("value") - F.col("own")) > tolerance * F.greatest(F.lit(1.0), F.abs("own"))
    return both.where(F.coalesce(off, F.col("value").isNull() != F.col("own").isNull())).select("outcome", "field", F.lit(code).alias("code"))


def unresolved(cells: DataFrame, decisions: DataFrame) -> DataFrame:
    """(key, field, code): X009 for cells that differ and have no decision (key, field)."""
    open_cells = cells.where("status IN ('differs', 'missing_a', 'missing_b')")
    return open_cells.join(decisions.select("key", "field").distinct(), ["key", "field"], "left_anti").select("key", "field", F.lit("X009").alias("code"))


def provenance_findings(cells: DataFrame, provenance: DataFrame) -> DataFrame:
    """(row_uid, field, code) of analysed cells (row_uid, field, value, estimated) and their provenance (row_uid, field, entered,
    estimated, locator): X010 without a place in a source, X013 where the flags of estimation differ, X022 where the cell is no
    longer what was entered."""
    p = provenance.select("row_uid", "field", "entered", F.col("estimated").alias("was_estimated"), "locator", F.lit(True).alias("there"))
    both = cells.join(p, ["row_uid", "field"], "left")
    known = F.coalesce("there", F.lit(False))
    rules = [
        ("X010", ~known | (F.coalesce(F.trim("locator"), F.lit("")) == "")), ("X013", known & ~F.col("estimated").eqNullSafe(F.col("was_estimated"))),
        ("X022", known & ~same_value(F.col("value"), F.col("entered"))),
    ]
    return both.select("row_uid", "field", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules]))).alias("code"))


def same_value(value: Column, entered: Column) -> Column:
    """Whether a number is what a cell's text says, with a comma or a point."""
    number = F.replace(F.trim(entered), F.lit(","), F.lit(".")).try_cast("double")
    near = F.abs(value - number) <= 1e-9 * F.greatest(F.abs(value), F.abs(number), F.lit(1e-300))
    return F.coalesce(near, value.isNull() & number.isNull())


def appraisal_findings(entries: DataFrame, appraisals: DataFrame) -> DataFrame:
    """(unit, code) of entries (unit, design) and appraisals (unit, tool, rating, implied, override, reason, bias): X011 a prediction
    model without PROBAST, X012 a review whose rating is not the implied one, X017 an override without a reason, X019 a
    suspected bias left open."""
    models = entries.where("design = 'prediction model'").join(appraisals.where("tool = 'PROBAST'"), "unit", "left_anti").select("unit", F.lit("X011").alias("code"))
    rules = [
        ("X012", (F.col("tool") == "AMSTAR 2") & (F.col("rating") != F.col("implied")) & F.col("override").isNull()),
        ("X017", F.col("override").isNotNull() & (F.col("override") != F.col("implied")) & (F.coalesce(F.trim("reason"), F.lit("")) == "")),
        ("X019", F.col("bias") == "suspected"),
    ]
    rest = appraisals.select("unit", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules]))).alias("code"))
    return models.union(rest)


def count_findings(flow: DataFrame, studies: DataFrame, runs: DataFrame) -> DataFrame:
    """(outcome, code): X014 where an outcome's table has more studies (outcome, study) than the flow (outcome, included,
    included_meta) includes, X015 where its run (outcome, k) has another number than included_meta."""
    n = studies.groupBy("outcome").agg(F.countDistinct("study").alias("n"))
    both = flow.join(n, "outcome", "left").join(runs, "outcome", "left")
    codes = F.array_compact(F.array(F.when(F.col("n") > F.col("included"), "X014"), F.when(F.col("k") != F.col("included_meta"), "X015")))
    return both.select("outcome", F.explode(codes).alias("code"))


def deviations(planned: DataFrame, used: DataFrame, decisions: DataFrame) -> DataFrame:
    """(outcome, option, planned, used): X016, options (outcome, option, value) of the primary run that are not the planned ones and
    have no decision (outcome, option)."""
    both = planned.withColumnRenamed("value", "planned").join(used.withColumnRenamed("value", "used"), ["outcome", "option"], "full")
    return both.where("NOT (planned <=> used)").join(decisions.select("outcome", "option").distinct(), ["outcome", "option"], "left_anti")


def screening_findings(records: DataFrame, decisions: DataFrame, reported: DataFrame) -> DataFrame:
    """(subject, code): X020, records without a decision (record, value, reason); X021, reasons whose number of exclusions is not the
    one ``reported`` (reason, n)."""
    open_records = records.join(decisions.select("record"), "record", "left_anti").select(F.col("record").cast("string").alias("subject"), F.lit("X020").alias("code"))
    counted = decisions.where("value = 'exclude'").groupBy("reason").agg(F.count(F.lit(1)).alias("own"))
    both = counted.join(reported, "reason", "full").where("coalesce(own, 0) <> coalesce(n, 0)")
    return open_records.union(both.select(F.col("reason").alias("subject"), F.lit("X021").alias("code")))


def project_findings(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """(rec, code) of included records (rec, doi, retracted, evidence_id, n_claimed, n_found): H002 evidence that does not exist, H003
    an identifier of the wrong form, H005 a retracted report, H006 fewer found than claimed, H018 claims that differ."""
    both = records.join(evidence.select("evidence_id", F.lit(True).alias("there")), "evidence_id", "left")
    rules = [
        ("H002", F.col("evidence_id").isNotNull() & F.col("there").isNull()), ("H003", F.col("doi").isNotNull() & ~F.col("doi").rlike(r"^10\.\d{4,9}/\S+$")),
        ("H005", F.col("retracted")), ("H006", F.col("n_found") < F.col("n_claimed")),
    ]
    return both.select("rec", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules]))).alias("code"))


def escalated(findings: DataFrame, stages: dict[str, str], stage: str) -> DataFrame:
    """``findings`` (code, severity) with the severity that holds at ``stage``: warnings of codes that ``stages`` maps to a stage become
    blockers from that stage on (stages by their names' order)."""
    since = F.try_element_at(F.create_map(*[F.lit(x) for pair in stages.items() for x in pair]), F.col("code"))
    return findings.withColumn("severity", F.when((F.col("severity") == "warning") & (since <= stage), "blocker").otherwise(F.col("severity")))


def gate(findings: DataFrame) -> DataFrame:
    """(scope, blockers, verdict): FAIL with any blocker, else PASS."""
    m = findings.groupBy("scope").agg(F.sum((F.col("severity") == "blocker").cast("long")).alias("blockers"))
    return m.withColumn("verdict", F.when(F.col("blockers") > 0, "FAIL").otherwise("PASS"))
