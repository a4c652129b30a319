"""Queries of flows, screening, appraisal, certainty and dual extraction over the sample tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import agreement, bias, pooling, rules, screening
from evidra.sources import studies as S
from evidra.sources.shared import table

from .catalog import _ST, ORACLE_SQL, _pool_sql, binary_studies, query, rounded
from .catalog_records import _AB, _FLOW, _flow, _second_extraction
from .catalog_stats import _EG, t_p_sql

# Flows ----------------------------------------------------------------------------------------------------------------

_BOX = (
    "fx AS (SELECT coalesce(route, 'all') AS flow, identified AS databases, CASE WHEN route = 'src3' THEN NULL WHEN route = 'src1' THEN duplicates + 1 ELSE duplicates END AS duplicates_removed, screened, excluded AS excluded_screening, "
    "CASE WHEN route = 'src2' THEN included - 1 ELSE included END AS sought, 0 AS not_retrieved, included AS assessed, included // 2 AS excluded_eligibility, included - included // 2 AS included_reports, "
    "CASE WHEN route = 'src0' THEN included + 5 ELSE included - included // 2 END AS included_studies, CASE WHEN route = 'src4' THEN NULL ELSE included // 2 + CASE WHEN route = 'src5' THEN 1 ELSE 0 END END AS reasons_total, CASE WHEN route = 'src1' THEN 2 ELSE 0 END AS awaiting FROM fl)"
)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r = _flow(spark, sf_dir), F.col("route")
    half = F.expr("included div 2")
    return f.select(
        F.coalesce(r, F.lit("all")).alias("flow"), F.col("identified").alias("databases"), F.when(r == "src3", None).when(r == "src1", F.col("duplicates") + 1).otherwise(F.col("duplicates")).alias("d1"), "screened",
        F.col("excluded").alias("excluded_screening"), F.when(r == "src2", F.col("included") - 1).otherwise(F.col("included")).alias("sought"), F.lit(0).alias("not_retrieved"), F.col("included").alias("assessed"),
        half.alias("excluded_eligibility"), (F.col("included") - half).alias("included_reports"), F.when(r == "src0", F.col("included") + 5).otherwise(F.col("included") - half).alias("included_studies"),
        F.when(r.isNull() | (r != "src4"), half + F.when(r == "src5", 1).otherwise(0)).alias("reasons_total"), F.when(r == "src1", 2).otherwise(0).alias("awaiting"),
    )


@query(
    "prisma_check",
    f"WITH {_FLOW}, {_BOX} SELECT flow, u.code AS code, u.severity AS severity FROM (SELECT flow, unnest([CASE WHEN duplicates_removed IS NOT NULL AND screened <> databases - duplicates_removed THEN {{'code': 'P002', 'severity': 'error'}} END, CASE WHEN sought <> screened - excluded_screening THEN {{'code': 'P003', 'severity': 'error'}} END, "
    "CASE WHEN assessed <> sought - not_retrieved THEN {'code': 'P004', 'severity': 'error'} END, CASE WHEN included_reports <> assessed - excluded_eligibility THEN {'code': 'P005', 'severity': 'error'} END, CASE WHEN included_studies > included_reports THEN {'code': 'P006', 'severity': 'error'} END, "
    "CASE WHEN reasons_total <> excluded_eligibility THEN {'code': 'P007', 'severity': 'error'} END, CASE WHEN excluded_eligibility > 0 AND reasons_total IS NULL THEN {'code': 'P008', 'severity': 'warning'} END, CASE WHEN duplicates_removed IS NULL AND databases >= screened THEN {'code': 'P011', 'severity': 'info'} END, CASE WHEN awaiting > 0 THEN {'code': 'P013', 'severity': 'warning'} END]) AS u FROM fx) WHERE u IS NOT NULL",
)
def prisma_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.flow_findings(screening.normal_flow(_boxes(spark, sf_dir)))


@query("prisma_sources", f"WITH {_FLOW}, b AS (SELECT coalesce(route, 'all') AS flow, identified AS n, CASE WHEN route IN ('src1', 'src2') THEN identified + 3 ELSE identified END AS m FROM fl) SELECT flow, 'identified' AS box, least(n, m) AS low, greatest(n, m) AS high FROM b WHERE n <> m")
def prisma_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flow(spark, sf_dir).select(F.coalesce("route", F.lit("all")).alias("flow"), F.lit("identified").alias("box"), F.col("identified").alias("n"))
    other = f.withColumn("n", F.when(F.col("flow").isin("src1", "src2"), F.col("n") + 3).otherwise(F.col("n")))
    return screening.sources_differ(f.withColumn("source", F.lit("table")).unionByName(other.withColumn("source", F.lit("notes"))))


@query("studies_counts", "SELECT o_orderpriority AS outcome, count(DISTINCT o_custkey) AS studies, count(DISTINCT o_orderkey) AS reports FROM orders GROUP BY ROLLUP (o_orderpriority)")
def studies_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.studies_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("outcome"), F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("report")))


@query("exclusion_reasons", "WITH d AS (SELECT o_custkey AS record, CASE WHEN o_orderkey % 3 = 0 THEN 'title' ELSE 'full_text' END AS level, CASE WHEN o_orderkey % 2 = 0 THEN 'exclude' ELSE 'include' END AS value, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END AS reason, o_orderkey AS seq FROM orders), l AS (SELECT * FROM d WHERE level = 'full_text' QUALIFY row_number() OVER (PARTITION BY record ORDER BY seq DESC) = 1) SELECT coalesce(nullif(trim(reason), ''), 'no reason') AS reason, count(*) AS n FROM l WHERE value = 'exclude' GROUP BY 1")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.when(k % 3 == 0, "title").otherwise("full_text").alias("level"), F.when(k % 2 == 0, "exclude").otherwise("include").alias("value"), F.when(k % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("reason"), k.alias("seq"))
    return screening.exclusion_reasons(d, ["seq"])


# Screening ------------------------------------------------------------------------------------------------------------

_SC = f"sc AS (SELECT doc_id AS rec, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 1980 + doc_id % 45 END AS year, lang AS language, CASE doc_id % 4 WHEN 0 THEN 'Editorial' WHEN 1 THEN 'Trial' END AS type, doc_id % 17 = 0 AS animal_only, doc_id % 23 = 0 AS retracted FROM documents), st1 AS (SELECT *, ' ' || {T.folded_sql('coalesce(title, chr(32))')} || ' ' AS ft FROM sc)"


@query("machine_screening", f"WITH {_SC} SELECT rec, 'M-retracted' AS rule, 'exclude' AS suggestion FROM st1 WHERE retracted UNION ALL SELECT rec, 'M-pub-type', 'exclude' FROM st1 WHERE type = 'Editorial' UNION ALL SELECT rec, 'M-year', 'exclude' FROM st1 WHERE year < 1990 OR year > 2020 UNION ALL SELECT rec, 'M-language', 'exclude' FROM st1 WHERE language NOT IN ('en', 'de') UNION ALL SELECT rec, 'M-animal', 'exclude' FROM st1 WHERE animal_only UNION ALL SELECT rec, 'M-title-terms', 'unclear' FROM st1 WHERE contains(ft, ' the ') OR contains(ft, ' und ')")
def machine_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(k.alias("rec"), F.split("text", "\n")[0].alias("title"), F.when(k % 10 != 0, 1980 + k % 45).alias("year"), F.col("lang").alias("language"), F.when(k % 4 == 0, "Editorial").when(k % 4 == 1, "Trial").alias("type"), (k % 17 == 0).alias("animal_only"), (k % 23 == 0).alias("retracted"))
    return screening.machine_proposals(rows, (1990, 2020), ["en", "de"], ["editorial"], ["the", "und"])


@query("agent_proposals", "WITH d AS (SELECT doc_id AS rec, text, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'zz never zz' ELSE substr(text, 5, 40) END AS quote, doc_id % 9 = 0 AS has_ids FROM documents WHERE text IS NOT NULL), f AS (SELECT *, trim(regexp_replace(quote, '\\s+', ' ', 'g')) AS q, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM d), r AS (SELECT rec, CASE WHEN has_ids THEN 'identifiers given' WHEN q = '' THEN 'no quote' WHEN NOT contains(t, q) THEN 'quote not found' END AS reason FROM f) SELECT rec, reason IS NULL AS accepted, reason FROM r")
def agent_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    proposals = d.select(k.alias("rec"), F.when(k % 4 == 0, "").when(k % 4 == 1, "zz never zz").otherwise(F.substring("text", 5, 40)).alias("quote"), (k % 9 == 0).alias("has_ids"))
    return screening.accepted_proposals(proposals, d.select(k.alias("rec"), F.col("text").alias("abstract")))


@query("open_items", "SELECT 'EP' || (1 + user_id % 6) AS checkpoint, count(*) FILTER (event_type = 'view') AS pending FROM events GROUP BY 1")
def open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("EP"), 1 + F.col("user_id") % 6).alias("checkpoint"), F.when(F.col("event_type") == "view", "pending").otherwise("done").alias("state"))
    return screening.open_items(e)


# Appraisal ------------------------------------------------------------------------------------------------------------

ALIASES = [("F", "yes", "fine"), ("finished", "yes", "fine"), ("O", "no", "problem"), ("P!", "unclear", "unknown")]


@query("answer_values", "SELECT o_custkey AS unit, o_orderkey AS item, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' WHEN 'P' THEN 'unclear' END AS value, CASE o_orderstatus WHEN 'F' THEN 'fine' WHEN 'O' THEN 'problem' WHEN 'P' THEN 'unknown' END AS polarity FROM orders")
def answer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("item"), F.concat(F.lit(" "), F.lower("o_orderstatus")).alias("answer"))
    return screening.canonical_answers(answers, spark.createDataFrame(ALIASES, "alias string, value string, polarity string"))


@query("override_check", "SELECT o_custkey AS unit, o_orderkey AS domain FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0 AND (o_orderstatus = 'F') <> (o_orderkey % 2 = 0)")
def override_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), k.alias("domain"), F.when(k % 2 == 0, "high").otherwise("low").alias("implied"), F.when((k % 3 == 0) & s.isin("F", "O"), F.when(s == "F", "high").otherwise("low")).alias("judged"), F.when(k % 4 == 0, "because").otherwise(" ").alias("reason"))
    return screening.override_findings(d)


@query("appraisal_check", "WITH a AS (SELECT o_custkey AS unit, 'q' || o_orderkey % 6 AS item, o_orderstatus AS value FROM orders) SELECT unit, (5 - count(DISTINCT item) FILTER (item <> 'q5'))::BIGINT AS missing, count(*) FILTER (value = 'P' OR item = 'q5') AS invalid FROM a GROUP BY unit")
def appraisal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.concat(F.lit("q"), F.col("o_orderkey") % 6).alias("item"), F.col("o_orderstatus").alias("value"))
    return screening.check_answers(answers, spark.createDataFrame([(f"q{k}", ["F", "O"]) for k in range(5)], "item string, allowed array<string>"))


_TWO = "a AS (SELECT c_custkey AS unit, 'q' AS item, c_nationkey % 3 AS value FROM customer WHERE c_custkey % 7 > 0), b AS (SELECT c_custkey AS unit, 'q' AS item, c_nationkey % 4 AS value FROM customer WHERE c_custkey % 11 > 0), rs AS (SELECT c_custkey AS unit, 'q' AS item, 9 AS value FROM customer WHERE c_custkey % 2 = 0)"


@query("appraisal_consensus", f"WITH {_TWO} SELECT coalesce(a.unit, b.unit) AS unit, 'q' AS item, CASE WHEN a.value = b.value THEN a.value ELSE rs.value END::INT AS value, CASE WHEN a.value = b.value THEN 'agreed' WHEN rs.value IS NOT NULL THEN 'resolved' ELSE 'open' END AS state FROM a FULL JOIN b ON a.unit = b.unit LEFT JOIN rs ON rs.unit = coalesce(a.unit, b.unit)")
def appraisal_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    own = lambda n, m: c.where(f"c_custkey % {n} > 0").select(F.col("c_custkey").alias("unit"), F.lit("q").alias("item"), (F.col("c_nationkey") % m).cast("int").alias("value"))
    return screening.consensus(own(7, 3), own(11, 4), c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("unit"), F.lit("q").alias("item"), F.lit(9).alias("value")))


DESIGNS = ("A randomised trial", "Non-randomised study", "Cohort study", "Systematic review", "Prediction model", "Diagnostic accuracy", "Case report", "Essay")


@query("instrument_routes", "SELECT c_custkey, ['RoB 2', 'ROBINS-I', 'NOS', 'AMSTAR 2', 'PROBAST', 'QUADAS-2', 'JBI', NULL][c_custkey % 8 + 1] AS tool FROM customer")
def instrument_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = F.element_at(F.array(*[F.lit(d) for d in DESIGNS]), (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", screening.instrument_route(design).alias("tool"))


@query("rob_changes", "WITH f AS (SELECT o_custkey AS study, CASE WHEN max(o_totalprice) > 300000 THEN 'high' ELSE 'low' END AS level FROM orders GROUP BY o_custkey) SELECT study, CASE WHEN study % 4 = 0 THEN 'high' WHEN study % 4 = 1 THEN 'low' END AS now, level AS proposed FROM f WHERE level IS DISTINCT FROM CASE WHEN study % 4 = 0 THEN 'high' WHEN study % 4 = 1 THEN 'low' END")
def rob_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    finals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("study")).agg(F.when(F.max("o_totalprice") > 300000, "high").otherwise("low").alias("level"))
    return agreement.rob_changes(table(spark, sf_dir, "customer").select(k.alias("study"), F.when(k % 4 == 0, "high").when(k % 4 == 1, "low").alias("rob")), finals)


_JUDGE = "j AS (SELECT l_partkey AS study, CASE WHEN l_quantity >= 50 THEN 'consensus' WHEN l_quantity <= 2 THEN 'human' WHEN l_quantity <= 4 THEN 'approved' ELSE 'draft' END AS kind, CASE WHEN l_discount > 0.07 THEN 'high' WHEN l_discount > 0.03 THEN 'some' ELSE 'low' END AS level FROM lineitem)"


@query("rob_final", f"WITH {_JUDGE}, m AS (SELECT study, max(level) FILTER (kind = 'consensus') AS c, min(level) FILTER (kind = 'human') AS h0, max(level) FILTER (kind = 'human') AS h1, max(level) FILTER (kind = 'approved') AS p FROM j GROUP BY study), b AS (SELECT *, CASE WHEN c IS NOT NULL THEN 'consensus' WHEN h0 <> h1 THEN 'conflict' WHEN h0 IS NOT NULL THEN 'human' WHEN p IS NOT NULL THEN 'approved' END AS basis FROM m) SELECT study, CASE basis WHEN 'consensus' THEN c WHEN 'human' THEN h0 WHEN 'approved' THEN p END AS level, basis FROM b WHERE basis IS NOT NULL")
def rob_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("l_quantity"), F.col("l_discount")
    kind = F.when(n >= 50, "consensus").when(n <= 2, "human").when(n <= 4, "approved").otherwise("draft")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("study"), kind.alias("kind"), F.when(d > 0.07, "high").when(d > 0.03, "some").otherwise("low").alias("level"))
    return rules.final_judgement(rows)



# Certainty ------------------------------------------------------------------------------------------------------------


@query("grade_publication_bias", f"WITH {_ST}, {_EG}, q AS (SELECT analysis_id, k, {t_p_sql('t', 'df')} AS p FROM e) SELECT analysis_id, CASE WHEN k < 10 THEN 'not assessable' WHEN p IS NULL THEN 'unknown' WHEN p < 0.1 THEN 'suspected' ELSE 'undetected' END AS advice FROM q")
def grade_publication_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = bias.line_test(bias.egger(binary_studies(spark, sf_dir)), "intercept")
    return tests.select("analysis_id", screening.publication_bias(F.col("k"), F.col("p"), F.lit("OR")).alias("advice"))


@query("grade_upgrades", "WITH x AS (SELECT c_custkey AS id, exp((c_custkey % 9 - 4) / 2.0)::DOUBLE AS e, 0.05 + (c_custkey % 4) * 0.2 AS h, c_nationkey % 2 = 0 AS rct FROM customer), s AS (SELECT *, greatest(e, 1 / e) AS far, e * exp(-h) AS lo, e * exp(h) AS hi FROM x) SELECT id, CASE WHEN far > 5 THEN 2 WHEN far > 2 THEN 1 ELSE 0 END::INT AS step, far > 2 AND NOT rct AND (hi < 0.5 OR lo > 2) AS suggested FROM s")
def grade_upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x = table(spark, sf_dir, "customer").select(k.alias("id"), F.exp((k % 9 - 4) / 2.0).alias("e"), (0.05 + (k % 4) * 0.2).alias("h"), (F.col("c_nationkey") % 2 == 0).alias("rct"))
    step, suggested = screening.large_effect(F.col("e"), F.col("e") * F.exp(-F.col("h")), F.col("e") * F.exp("h"), F.col("rct"))
    return x.select("id", step.cast("int").alias("step"), suggested.alias("suggested"))


@query("mid_thresholds", "WITH m AS (SELECT c_custkey AS id, ['OR', 'MD', 'PLO'][c_custkey % 3 + 1] AS measure, (c_custkey % 5) / 2.0 AS v FROM customer), s AS (SELECT *, CASE measure WHEN 'PLO' THEN NULL WHEN 'OR' THEN CASE WHEN v > 0 AND v <> 1 THEN abs(ln(CASE WHEN v > 0 THEN v END)) END ELSE nullif(abs(v), 0) END AS t FROM m) SELECT id, round(-t, 6) + 0.0 AS lower, round(t, 6) + 0.0 AS upper FROM s")
def mid_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    measure = F.element_at(F.array(F.lit("OR"), F.lit("MD"), F.lit("PLO")), (k % 3 + 1).cast("int"))
    low, high = screening.mid_thresholds(F.col("measure"), F.col("v"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), measure.alias("measure"), ((k % 5) / 2.0).alias("v"))
    return rounded(rows.select("id", low.cast("double").alias("lower"), high.cast("double").alias("upper")))


@query("information_size", f"WITH {S.arms2x2_sql()}, q AS (SELECT row_index, e2 / n2 AS r FROM arms WHERE n2 > 0 AND e2 > 0), t AS (SELECT *, r * 0.75 AS t, (r + r * 0.75) / 2 AS m FROM q) SELECT row_index, (2 * ceil(2 * (1.959963984540054 + 0.8416212335729143) * (1.959963984540054 + 0.8416212335729143) * m * (1 - m) / pow(r - t, 2)))::BIGINT AS n FROM t")
def information_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = S.arms2x2(spark, sf_dir).where("n2 > 0 AND e2 > 0")
    return arms.select("row_index", screening.information_size(F.col("e2") / F.col("n2")).cast("long").alias("n"))


@query("sof_rows", _pool_sql("DL") + ", g AS (SELECT analysis_id, mu, mu - 1.959963984540054 * se AS lo, mu + 1.959963984540054 * se AS hi, unnest([{'n': 'low', 'r': 0.05}, {'n': 'high', 'r': 0.3}]) AS u FROM p), v AS (SELECT analysis_id, mu, lo, hi, u.n AS risk_name, u.r::DOUBLE AS r FROM g) SELECT analysis_id, risk_name, round(1000 * r) AS assumed, round(1000 * (exp(mu) * r / (1 - r + exp(mu) * r))) AS corresponding, round(1000 * (exp(mu) * r / (1 - r + exp(mu) * r))) - round(1000 * r) AS difference, round(1000 * (exp(lo) * r / (1 - r + exp(lo) * r))) AS low, round(1000 * (exp(hi) * r / (1 - r + exp(hi) * r))) AS high, 'probably ' || CASE WHEN mu < 0 THEN 'fewer' ELSE 'more' END AS wording FROM v")
def sof_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pooling.pooled(binary_studies(spark, sf_dir), "DL").withColumn("certainty", F.lit(3))
    risks = e.select("analysis_id", F.explode(F.array(F.struct(F.lit("low").alias("n"), F.lit(0.05).alias("r")), F.struct(F.lit("high").alias("n"), F.lit(0.3).alias("r")))).alias("u")).select("analysis_id", F.col("u.n").alias("risk_name"), F.col("u.r").alias("risk"))
    return screening.sof_rows(e, risks)


# Dual extraction ------------------------------------------------------------------------------------------------------


@query("ab_summary", f"WITH {_AB}, m AS (SELECT field, count(*) FILTER (status IN ('equal', 'within_tolerance')) AS agree, count(*) FILTER (status = 'differs') AS disagree, count(*) FILTER (status IN ('missing_a', 'missing_b')) AS missing FROM st9 GROUP BY field) SELECT field, agree + disagree AS compared, agree, disagree, missing, round(100.0 * agree / (agree + disagree)::DOUBLE, 6) + 0.0 AS percent FROM m")
def ab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.agreement_summary(_cells(spark, sf_dir)))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = S.arms2x2(spark, sf_dir).select("row_index", "e1", "n1")
    return agreement.table_diff(arms, _second_extraction(arms), ["row_index"], ["e1", "n1"])


@query("ab_reconciled", f"WITH {_AB}, dc AS (SELECT row_index, field, CASE row_index % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'other' END AS chosen, 77.0 AS value, a AS seen_a, CASE WHEN row_index % 4 = 0 THEN -1 ELSE b END AS seen_b FROM st9 WHERE row_index % 2 = 0), s AS (SELECT st9.*, chosen, value, CASE WHEN status IN ('equal', 'within_tolerance', 'both_empty') THEN 'agreed' WHEN chosen IS NULL THEN 'open' WHEN seen_a IS DISTINCT FROM a OR seen_b IS DISTINCT FROM b THEN 'stale' ELSE 'decided' END AS state FROM st9 LEFT JOIN dc USING (row_index, field)) SELECT row_index, field, round(CASE WHEN state = 'agreed' THEN a WHEN state = 'decided' THEN CASE chosen WHEN 'a' THEN a WHEN 'b' THEN b ELSE value END END, 6) + 0.0 AS value, state FROM s")
def ab_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, k = _cells(spark, sf_dir), F.col("row_index")
    chosen = F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("other")
    decisions = cells.where("row_index % 2 = 0").select("row_index", "field", chosen.alias("chosen"), F.lit(77.0).alias("value"), F.col("a").alias("seen_a"), F.when(k % 4 == 0, -1.0).otherwise(F.col("b")).alias("seen_b"))
    return rounded(agreement.reconciled(cells, decisions, ["row_index"]))


@query("ab_impact", f"WITH {_ST}, s AS (SELECT analysis_id, sum(1 / vi) AS sw, sum(yi / vi) AS swy FROM st GROUP BY analysis_id), d AS (SELECT st.*, yi + 0.5 AS yb, vi * 2 AS vb FROM st WHERE row_index % 3 = 0), b AS (SELECT d.analysis_id, row_index, swy / sw AS base, (swy - yi / vi + yb / vb) / (sw - 1 / vi + 1 / vb) AS other, sw FROM d JOIN s ON s.analysis_id = d.analysis_id) SELECT analysis_id, row_index, round(base, 6) + 0.0 AS base, round(other, 6) + 0.0 AS other, round(other - base, 6) + 0.0 AS shift, abs(other - base) * sqrt(sw) >= 0.05 AS material FROM b")
def ab_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pooling.usable(binary_studies(spark, sf_dir)).select("analysis_id", "row_index", "yi", "vi")
    disputed = own.where("row_index % 3 = 0").select("analysis_id", "row_index", (F.col("yi") + 0.5).alias("yi_b"), (F.col("vi") * 2).alias("vi_b"))
    return rounded(agreement.impact(own, disputed))


@query("field_types", "WITH c AS (SELECT unnest([{'field': 'balance', 'value': c_acctbal::VARCHAR}, {'field': 'segment', 'value': c_mktsegment}, {'field': 'name', 'value': c_name}, {'field': 'mixed', 'value': CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 7 = 0 THEN 'NR' ELSE c_custkey::VARCHAR END}]) AS u FROM customer), d AS (SELECT u.field AS field, nullif(trim(u.value), '') AS v FROM c), m AS (SELECT field, count(v) AS n, count(TRY_CAST(replace(v, ',', '.') AS DOUBLE)) AS x, count(DISTINCT v) AS u FROM d WHERE v IS NOT NULL GROUP BY field) SELECT field, CASE WHEN x = n THEN 'numeric' WHEN u <= 10 AND u <= greatest(2, n / 2.0) THEN 'categorical' ELSE 'text' END AS type FROM m")
def field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pairs = [("balance", F.col("c_acctbal").cast("string")), ("segment", F.col("c_mktsegment")), ("name", F.col("c_name")), ("mixed", F.when(k % 5 == 0, " ").when(k % 7 == 0, "NR").otherwise(k.cast("string")))]
    cells = table(spark, sf_dir, "customer").select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in pairs])).alias("c")).select("c.*")
    return agreement.field_types(cells)


_KP = "pr AS (SELECT 'item' AS level, 'q' || c_custkey % 3 AS name, (c_nationkey % 3)::VARCHAR AS a, (CASE WHEN c_custkey % 4 = 0 THEN c_nationkey % 2 ELSE c_nationkey % 3 END)::VARCHAR AS b FROM customer UNION ALL SELECT 'overall', 'overall', (c_nationkey % 3)::VARCHAR, (CASE WHEN c_custkey % 4 = 0 THEN c_nationkey % 2 ELSE c_nationkey % 3 END)::VARCHAR FROM customer)"


@query("appraisal_agreement", f"WITH {_KP}, c AS (SELECT level, name, a, b, count(*)::DOUBLE AS c FROM pr GROUP BY ALL), n AS (SELECT level, name, sum(c) AS n FROM c GROUP BY ALL), ra AS (SELECT level, name, a, sum(c) AS c FROM c GROUP BY ALL), cb AS (SELECT level, name, b, sum(c) AS c FROM c GROUP BY ALL), s AS (SELECT n.level, n.name, n, (SELECT coalesce(sum(c), 0) FROM c WHERE c.level = n.level AND c.name = n.name AND a = b) / n AS po, (SELECT coalesce(sum(ra.c * cb.c), 0) FROM ra JOIN cb ON ra.a = cb.b AND ra.level = cb.level AND ra.name = cb.name WHERE ra.level = n.level AND ra.name = n.name) / (n * n) AS pe FROM n), k AS (SELECT *, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM s) SELECT level, name, n::BIGINT AS n, round(kappa, 6) + 0.0 AS kappa, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' WHEN kappa IS NOT NULL THEN 'almost perfect' END AS label FROM k")
def appraisal_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    b = F.when(k % 4 == 0, n % 2).otherwise(n % 3).cast("string").alias("b")
    c, a = table(spark, sf_dir, "customer"), (n % 3).cast("string").alias("a")
    items = c.select(F.lit("item").alias("level"), F.concat(F.lit("q"), k % 3).alias("name"), a, b)
    return rounded(agreement.appraisal_agreement(items.union(c.select(F.lit("overall"), F.lit("overall"), a, b))))
