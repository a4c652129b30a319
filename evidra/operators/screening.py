"""Screening decisions, flow counts, certainty and appraisal rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import folded


def effective(decisions: DataFrame, target: list[str], order: list[str]) -> DataFrame:
    """The last decision of each target in the order given."""
    last = Window.partitionBy(*target).orderBy(*[F.desc(c) for c in order])
    return decisions.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def dual_status(decisions: DataFrame, order: list[str]) -> DataFrame:
    """(record, status, n_reviewers) from rows (record, reviewer, value): each reviewer's last decision counts; decided if two or
    more agree, conflict if they differ, partial if there is one."""
    last = effective(decisions, ["record", "reviewer"], order)
    m = last.groupBy("record").agg(F.count(F.lit(1)).alias("n_reviewers"), F.countDistinct("value").alias("values"), F.min("value").alias("value"))
    status = F.when(F.col("n_reviewers") < 2, "partial").when(F.col("values") > 1, "conflict").otherwise(F.concat(F.lit("decided "), F.col("value")))
    return m.select("record", status.alias("status"), "n_reviewers")


def branch_counts(records: DataFrame) -> DataFrame:
    """(route, identified, duplicates, screened, excluded, included): flow boxes of each route, and of all under route null."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    status, copy = F.col("status"), F.col("is_duplicate")
    m = records.rollup("route").agg(F.count(F.lit(1)).alias("identified"), one(copy).alias("duplicates"), one(~copy).alias("screened"), one(~copy & (status == "excluded")).alias("excluded"), one(~copy & (status == "included")).alias("included"))
    return m


#: Names that flow boxes go by, and what they are called here.
BOXES = {
    "identified_databases": ("databases", "a1"), "identified_registers": ("registers", "a2"), "identified_other": ("other_sources",), "duplicates_removed": ("duplicates", "d1"),
    "automation_removed": ("d2",), "other_removed": ("d3",), "screened": ("records_screened", "b"), "excluded_screening": ("records_excluded", "c"), "sought": ("e",), "not_retrieved": ("f",),
    "assessed": ("g",), "excluded_eligibility": ("h",), "included_reports": ("j",), "included_studies": ("i",), "included_meta": ("meta",), "awaiting": (), "reasons_total": (),
    "other_methods_identified": (), "other_methods_sought": (), "other_methods_not_retrieved": (), "other_methods_assessed": (), "other_methods_included": (),
    "previous_studies": (), "new_studies": (), "total_studies": (),
}


def normal_flow(flow: DataFrame, key: str = "flow") -> DataFrame:
    """``flow`` with all boxes by their own names: the first of a box's names that a row fills in; null where none is there."""
    columns = [F.coalesce(*[F.col(c).cast("double") for c in (box, *others) if c in flow.columns], F.lit(None).cast("double")).alias(box) for box, others in BOXES.items()]
    return flow.select(key, *columns)


def flow_findings(flow: DataFrame, key: str = "flow") -> DataFrame:
    """(flow, code, severity) of ``normal_flow`` rows: P001 a box that is no whole number from 0 on; P002 to P005 boxes that don't
    follow from those before them (screened, sought, assessed, included reports); P006 more studies than reports; P007 reasons
    that don't add up to the exclusions; P008 exclusions without reasons; P009 the other methods' assessed reports; P010 more
    studies in the synthesis than included; P011 removals that are only derived; P012 a box that is missing; P013 records that
    wait; P015 totals of an update; P016 more sought by other methods than identified. Unknown boxes break nothing."""
    x = {c: F.col(c) for c in BOXES}
    none = lambda c: F.coalesce(x[c], F.lit(0.0))
    identified = F.when(F.coalesce(x["identified_databases"], x["identified_registers"], x["identified_other"]).isNotNull(), none("identified_databases") + none("identified_registers") + none("identified_other"))
    removed = F.coalesce(x["duplicates_removed"], x["automation_removed"], x["other_removed"])
    after = identified - none("duplicates_removed") - none("automation_removed") - none("other_removed")
    wrong = F.lit(False)
    for c in x.values():
        wrong = wrong | F.coalesce((c < 0) | (c != F.floor(c)), F.lit(False))
    derived = removed.isNull() & (identified >= x["screened"])
    reports = x["assessed"] - x["excluded_eligibility"] + none("other_methods_included")
    missing = F.lit(False)
    for c in ("screened", "excluded_screening", "sought", "not_retrieved", "assessed", "excluded_eligibility"):
        missing = missing | x[c].isNull()
    rules = [
        ("P001", "error", wrong), ("P002", "error", ~F.coalesce(derived, F.lit(False)) & (x["screened"] != after)), ("P003", "error", x["sought"] != x["screened"] - x["excluded_screening"]),
        ("P004", "error", x["assessed"] != x["sought"] - x["not_retrieved"]), ("P005", "error", x["included_reports"] != reports), ("P006", "error", x["included_studies"] > x["included_reports"]),
        ("P007", "error", x["reasons_total"] != x["excluded_eligibility"]), ("P008", "warning", (x["excluded_eligibility"] > 0) & x["reasons_total"].isNull()),
        ("P009", "error", x["other_methods_assessed"] != x["other_methods_sought"] - x["other_methods_not_retrieved"]), ("P010", "error", x["included_meta"] > x["included_studies"]),
        ("P011", "info", derived), ("P012", "info", missing), ("P013", "warning", x["awaiting"] > 0), ("P015", "error", x["total_studies"] != x["previous_studies"] + x["new_studies"]),
        ("P016", "warning", x["other_methods_sought"] > x["other_methods_identified"]),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in rules]))
    return flow.select(key, F.explode(found).alias("f")).select(key, "f.code", "f.severity")


def sources_differ(boxes: DataFrame) -> DataFrame:
    """(flow, box, low, high): P017, boxes (flow, source, box, n) for which sources give different numbers."""
    m = boxes.where("n IS NOT NULL").groupBy("flow", "box").agg(F.countDistinct("source").alias("sources"), F.min("n").alias("low"), F.max("n").alias("high"))
    return m.where("sources > 1 AND low <> high").select("flow", "box", "low", "high")


def studies_counts(members: DataFrame) -> DataFrame:
    """(outcome, studies, reports) of rows (outcome, study, report), and of all under outcome null: distinct ones."""
    m = members.rollup("outcome").agg(F.countDistinct("study").alias("studies"), F.countDistinct("report").alias("reports"))
    return m.select("outcome", "studies", "reports")


def exclusion_reasons(decisions: DataFrame, order: list[str]) -> DataFrame:
    """(reason, n): full-text exclusions by reason, from each record's last decision (record, level, value, reason); blank reasons
    are "no reason"."""
    last = effective(decisions.where("level = 'full_text'"), ["record"], order).where("value = 'exclude'")
    return last.groupBy(F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("no reason")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def machine_proposals(records: DataFrame, years: tuple[int, int], languages: list[str], types: list[str], title_terms: list[str]) -> DataFrame:
    """(rec, rule, suggestion) of records (rec, title, year, language, type, animal_only, retracted): exclusion for the retracted, for
    types, years and languages outside the criteria, for animal studies; unclear for titles with an excluding term. Inclusion is
    never proposed, and what a record lacks proposes nothing."""
    title = F.concat(F.lit(" "), folded(F.coalesce("title", F.lit(""))), F.lit(" "))
    term = F.lit(False)
    for t in title_terms:
        term = term | title.contains(f" {t} ")
    rules = [
        ("M-retracted", "exclude", F.col("retracted")), ("M-pub-type", "exclude", F.lower("type").isin(*types)), ("M-year", "exclude", ~F.col("year").between(*years)),
        ("M-language", "exclude", ~F.lower("language").isin(*languages)), ("M-animal", "exclude", F.col("animal_only")), ("M-title-terms", "unclear", term),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("suggestion"))) for r, v, c in rules]))
    return records.select("rec", F.explode(found).alias("f")).select("rec", "f.rule", "f.suggestion")


def accepted_proposals(proposals: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(rec, accepted, reason) of proposals (rec, quote, has_ids): accepted only with a quote that stands in the abstract (rec,
    abstract), blanks aside, and without identifiers of their own."""
    flat = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s+", " "))
    both = proposals.join(abstracts, "rec", "left")
    quote = F.coalesce(flat("quote"), F.lit(""))
    reason = F.when(F.col("has_ids"), "identifiers given").when(quote == "", "no quote").when(~F.coalesce(F.contains(flat("abstract"), quote), F.lit(False)), "quote not found")
    return both.select("rec", reason.isNull().alias("accepted"), reason.alias("reason"))


def open_items(items: DataFrame) -> DataFrame:
    """(checkpoint, pending) of rows (checkpoint, state): what waits at each checkpoint."""
    return items.groupBy("checkpoint").agg(F.sum((F.col("state") == "pending").cast("long")).alias("pending"))


def canonical_answers(answers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(unit, item, value, polarity) of answers (unit, item, answer), by the alias table (alias, value, polarity) of folded words,
    some hundreds of rows; unknown words have neither."""
    known = aliases.select(folded(F.col("alias")).alias("__word"), "value", "polarity").dropDuplicates(["__word"])
    return answers.withColumn("__word", folded(F.col("answer"))).join(known, "__word", "left").select("unit", "item", "value", "polarity")


def override_findings(domains: DataFrame) -> DataFrame:
    """(unit, domain): X017, judgements (unit, domain, implied, judged, reason) that differ from the implied one without a reason."""
    differs = F.col("judged").isNotNull() & F.col("implied").isNotNull() & (F.col("judged") != F.col("implied"))
    return domains.where(differs & (F.coalesce(F.trim("reason"), F.lit("")) == "")).select("unit", "domain")


def check_answers(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(unit, missing, invalid) of appraisals (unit, item, value) against the instrument's items (item, allowed array), a small table:
    items without an answer, and answers that an item does not allow."""
    n = items.count()
    both = answers.join(F.broadcast(items), "item", "left") if n <= 10_000 else answers.join(items, "item", "left")
    given = F.col("value").isNotNull() & F.col("allowed").isNotNull()
    m = both.groupBy("unit").agg(F.countDistinct(F.when(given, F.col("item"))).alias("given"), F.sum((F.col("value").isNotNull() & ~F.coalesce(F.array_contains("allowed", F.col("value")), F.lit(False))).cast("long")).alias("invalid"))
    return m.select("unit", (F.lit(n) - F.col("given")).alias("missing"), "invalid")


def consensus(first: DataFrame, second: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(unit, item, value, state) of two appraisals (unit, item, value): equal answers agree, others take the resolution (unit, item,
    value) if there is one, else they are open."""
    both = first.withColumnRenamed("value", "a").join(second.withColumnRenamed("value", "b"), ["unit", "item"], "full").join(resolutions.withColumnRenamed("value", "r"), ["unit", "item"], "left")
    agree = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    return both.select("unit", "item", F.when(agree, F.col("a")).otherwise(F.col("r")).alias("value"), F.when(agree, "agreed").when(F.col("r").isNotNull(), "resolved").otherwise("open").alias("state"))


#: Designs in words and the instrument that suits them, the first that fits.
ROUTES = (
    (r"systematic review|meta.?analys", "AMSTAR 2"), (r"prediction|prognostic model", "PROBAST"), (r"diagnos", "QUADAS-2"), (r"cluster|crossover|randomi[sz]ed|\brct\b", "RoB 2"),
    (r"non.?randomi[sz]ed|interrupted time|before.?after", "ROBINS-I"), (r"cohort|case.?control", "NOS"), (r"cross.?sectional|prevalence|case (series|report)", "JBI"),
)


def instrument_route(design: Column) -> Column:
    """The instrument for a design in words; null if none fits. Non-randomised is looked for before randomised."""
    low = F.lower(design)
    out = F.when(low.rlike(ROUTES[4][0]), ROUTES[4][1])
    for pattern, tool in ROUTES:
        out = out.when(low.rlike(pattern), tool)
    return out


def grade(start: Column, downs: list[Column], ups: list[Column]) -> Column:
    """Certainty 1 to 4: ``start`` less what the domains take, plus upgrades only where none takes."""
    down = downs[0]
    for d in downs[1:]:
        down = down + d
    up = ups[0]
    for u in ups[1:]:
        up = up + u
    return F.least(F.lit(4), F.greatest(F.lit(1), start - down + F.when(down == 0, up).otherwise(0)))


def imprecision(low: Column, high: Column, mid: float, null: float = 0.0) -> Column:
    """2 if the interval crosses both thresholds of minimal importance, 1 if it crosses any threshold or the null, else 0."""
    below, above = (low < null - mid) & (high > null - mid), (low < null + mid) & (high > null + mid)
    return F.when(below & above, 2).when(below | above | ((low < null) & (high > null)), 1).otherwise(0)


def amstar2(answers: DataFrame, critical: list[str]) -> DataFrame:
    """(unit, critical_flaws, weaknesses, rating) from rows (unit, item, answer): several critical flaws make critically low, one
    low, more than one other weakness moderate."""
    bad = F.col("answer") == "no"
    is_critical = F.col("item").isin(critical)
    m = answers.groupBy("unit").agg(F.sum((bad & is_critical).cast("long")).alias("critical_flaws"), F.sum((bad & ~is_critical).cast("long")).alias("weaknesses"))
    rating = F.when(F.col("critical_flaws") > 1, "critically low").when(F.col("critical_flaws") == 1, "low").when(F.col("weaknesses") > 1, "moderate").otherwise("high")
    return m.withColumn("rating", rating)


def weight_shares(judgements: DataFrame) -> DataFrame:
    """(analysis_id, level, share): percent of an analysis's weight at each level of risk of bias; null levels are no_info."""
    level = F.coalesce("level", F.lit("no_info"))
    total = judgements.groupBy("analysis_id").agg(F.sum("weight").alias("all"))
    return judgements.groupBy("analysis_id", level.alias("level")).agg(F.sum("weight").alias("w")).join(total, "analysis_id").select("analysis_id", "level", (100.0 * F.col("w") / F.col("all")).alias("share"))


def implied(answers: DataFrame) -> DataFrame:
    """(unit, overall): the worst domain, with unknown answers as SQL's null: any high is high; else any unknown leaves the
    overall null; else some or low."""
    value = F.col("answer")
    m = answers.groupBy("unit").agg(F.max((value == "high").cast("int")).alias("high"), F.max(value.isNull().cast("int")).alias("unknown"), F.max((value == "some").cast("int")).alias("some"))
    return m.select("unit", F.when(F.col("high") == 1, "high").when(F.col("unknown") == 1, None).when(F.col("some") == 1, "some").otherwise("low").alias("overall"))


def chained(events: DataFrame, order: list[str], scope: str, fields: list[str]) -> DataFrame:
    """``events`` with ``digest`` of each event and ``prev`` that of the one before it in its scope."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)
    return events.withColumn("digest", digest).withColumn("prev", F.lag("digest").over(Window.partitionBy(scope).orderBy(*order)))


def broken_links(chain: DataFrame, order: list[str], scope: str) -> DataFrame:
    """Events whose recorded ``prev`` is not the digest of the event before."""
    before = F.lag("digest").over(Window.partitionBy(scope).orderBy(*order))
    return chain.withColumn("__before", before).where(~F.col("prev").eqNullSafe(F.col("__before"))).drop("__before")


# Certainty and summaries ----------------------------------------------------------------------------------------------


def mid_thresholds(measure: Column, value: Column) -> tuple[Column, Column]:
    """(lower, upper) on the scale of analysis from one minimal important difference in the scale of display: a ratio and its inverse
    as logs, a difference to both sides; null for proportions, for a ratio not above 0 or of 1, and for 0."""
    ratio, single = measure.isin("OR", "RR", "ROM"), measure.isin("PR", "PLN", "PLO", "PAS", "PFT")
    size = F.when(single, None).when(ratio, F.abs(F.log(F.when((value > 0) & (value != 1), value)))).when(measure == "ZCOR", F.atanh(F.when(F.abs(value) < 1, F.abs(value)))).otherwise(F.abs(value))
    size = F.nullif(size, F.lit(0.0))
    return -size, size


def publication_bias(k: Column, p: Column, measure: Column, least: int = 10, alpha: float = 0.1) -> Column:
    """not assessable for few studies or proportions, unknown without a test, suspected below ``alpha``, else undetected."""
    usable = (k >= least) & ~measure.isin("PR", "PLN", "PLO", "PAS", "PFT")
    return F.when(~F.coalesce(usable, F.lit(False)), "not assessable").when(p.isNull(), "unknown").when(p < alpha, "suspected").otherwise("undetected")


def large_effect(estimate: Column, low: Column, high: Column, randomised: Column) -> tuple[Column, Column]:
    """(step, suggested) for a ratio in the scale of display: 1 beyond 2 or 0.5, 2 beyond 5 or 0.2; suggested only for designs that
    are not randomised, with an interval wholly beyond 2 or 0.5."""
    far = F.greatest(estimate, 1.0 / F.when(estimate > 0, estimate))
    step = F.when(estimate > 0, F.when(far > 5, 2).when(far > 2, 1).otherwise(0))
    return step, F.coalesce((step > 0) & ~randomised & ((high < 0.5) | (low > 2.0)), F.lit(False))


def information_size(risk: Column, reduction: float = 0.25) -> Column:
    """Participants that a trial needs to find a relative reduction of the control risk, 5 percent two-sided with power 0.8."""
    z = 1.959963984540054 + 0.8416212335729143
    treated = risk * (1 - reduction)
    mean = (risk + treated) / 2
    return 2 * F.ceil(2 * z * z * mean * (1 - mean) / F.pow(risk - treated, 2))


def certainty_words(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("very low", "low", "moderate", "high")]), level.cast("int"))


def sof_rows(estimates: DataFrame, risks: DataFrame) -> DataFrame:
    """(analysis_id, risk_name, assumed, corresponding, difference, low, high, wording): per 1000, of odds ratios (analysis_id, estimate,
    ci_low, ci_high, certainty) at assumed risks (analysis_id, risk_name, risk)."""
    both = estimates.join(risks, "analysis_id")
    at = lambda c: F.exp(c) * F.col("risk") / (1 - F.col("risk") + F.exp(c) * F.col("risk"))
    verb = F.element_at(F.array(*[F.lit(x) for x in ("is very uncertain", "may", "probably", "does")]), F.col("certainty").cast("int"))
    way = F.when(F.col("estimate") < 0, "fewer").when(F.col("estimate") > 0, "more").otherwise("as many")
    thousand = lambda c: F.round(1000 * c)
    return both.select("analysis_id", "risk_name", thousand(F.col("risk")).alias("assumed"), thousand(at(F.col("estimate"))).alias("corresponding"), (thousand(at(F.col("estimate"))) - thousand(F.col("risk"))).alias("difference"), thousand(at(F.col("ci_low"))).alias("low"), thousand(at(F.col("ci_high"))).alias("high"), F.concat_ws(" ", verb, way).alias("wording"))
