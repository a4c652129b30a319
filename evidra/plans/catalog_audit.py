"""Queries of audit rules over the sample tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import audit
from evidra.sources.shared import table

from .catalog import query

_RUNS = "ru AS (SELECT user_id AS spec, event_id AS run, ts FROM events), la AS (SELECT spec, run AS last FROM ru QUALIFY row_number() OVER (PARTITION BY spec ORDER BY ts DESC, run DESC) = 1)"


@query("audit_figures", f"WITH {_RUNS}, fg AS (SELECT event_id AS figure, user_id AS spec, event_id AS run, CASE event_type WHEN 'view' THEN 'clean' WHEN 'click' THEN 'warnings' END AS qc FROM events WHERE event_id % 3 = 0) SELECT figure, 'X002' AS code FROM fg JOIN la USING (spec) WHERE run <> last UNION ALL SELECT figure, 'X018' FROM fg JOIN la USING (spec) WHERE coalesce(qc, '') <> 'clean'")
def audit_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    figures = e.where("event_id % 3 = 0").select(F.col("event_id").alias("figure"), F.col("user_id").alias("spec"), F.col("event_id").alias("run"), F.when(F.col("event_type") == "view", "clean").when(F.col("event_type") == "click", "warnings").alias("qc"))
    return audit.figure_findings(figures, e.select(F.col("user_id").alias("spec"), F.col("event_id").alias("run"), "ts"))


@query("audit_judgements", "WITH t AS (SELECT c_custkey AS study, CASE WHEN c_custkey % 4 = 0 THEN 'high' ELSE 'low' END AS rob FROM customer), f AS (SELECT o_custkey AS study, CASE WHEN max(o_totalprice) > 300000 THEN 'high' ELSE 'low' END AS level FROM orders GROUP BY o_custkey) SELECT t.study, CASE WHEN level IS NULL THEN 'X004' ELSE 'X003' END AS code FROM t LEFT JOIN f ON t.study = f.study WHERE level IS NULL OR level <> rob")
def audit_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study"), F.when(F.col("c_custkey") % 4 == 0, "high").otherwise("low").alias("rob"))
    finals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("study")).agg(F.when(F.max("o_totalprice") > 300000, "high").otherwise("low").alias("level"))
    return audit.judgement_findings(rows, finals)


_SENS = "fl AS (SELECT DISTINCT s_nationkey AS outcome, s_suppkey AS row_index, CASE WHEN s_suppkey % 2 = 0 THEN 'estimated' ELSE 'high risk' END AS flag FROM supplier WHERE s_suppkey % 3 = 0), rn AS (SELECT n_nationkey AS outcome, n_nationkey * 10 + k AS run, CASE WHEN n_nationkey = 4 THEN 0 ELSE 5 END AS kept, k FROM nation, range(2) t(k)), rm AS (SELECT run, s_suppkey AS row_index FROM rn JOIN supplier ON s_nationkey = outcome WHERE s_suppkey % 3 = 0 AND (k = 0 AND s_suppkey % 2 = 0 OR k = 1 AND s_suppkey % 9 = 0))"


@query("audit_sensitivity", f"WITH {_SENS}, nd AS (SELECT outcome, flag, count(*) AS need FROM fl GROUP BY ALL), hit AS (SELECT fl.outcome, flag, rn.run, count(*) AS got FROM fl JOIN rn ON fl.outcome = rn.outcome AND kept > 0 JOIN rm ON rm.run = rn.run AND rm.row_index = fl.row_index GROUP BY ALL), dn AS (SELECT DISTINCT hit.outcome, hit.flag FROM hit JOIN nd ON hit.outcome = nd.outcome AND hit.flag = nd.flag WHERE got = need) SELECT nd.outcome, nd.flag, CASE nd.flag WHEN 'estimated' THEN 'X005' ELSE 'X006' END AS code FROM nd LEFT JOIN dn ON nd.outcome = dn.outcome AND nd.flag = dn.flag WHERE dn.flag IS NULL")
def audit_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0")
    flags = s.select(F.col("s_nationkey").alias("outcome"), F.col("s_suppkey").alias("row_index"), F.when(F.col("s_suppkey") % 2 == 0, "estimated").otherwise("high risk").alias("flag")).distinct()
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("outcome"), F.when(F.col("n_nationkey") == 4, 0).otherwise(5).alias("kept"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("run", F.col("outcome") * 10 + F.col("k"))
    removed = s.join(runs, F.col("s_nationkey") == F.col("outcome")).where("(k = 0 AND s_suppkey % 2 = 0) OR (k = 1 AND s_suppkey % 9 = 0)").select("run", F.col("s_suppkey").alias("row_index"))
    return audit.sensitivity_findings(flags, removed, runs.select("run", "outcome", "kept"))


@query("audit_numbers", "WITH o AS (SELECT o_custkey AS outcome, count(*)::DOUBLE AS k, sum(o_totalprice) AS n FROM orders GROUP BY o_custkey) SELECT outcome, 'k' AS field, 'X007' AS code FROM o WHERE outcome % 5 = 0 UNION ALL SELECT outcome, 'n', 'X007' FROM o WHERE outcome % 7 = 0")
def audit_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("outcome")).agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("o_totalprice").alias("n"))
    fields = lambda k, n: F.explode(F.array(F.struct(F.lit("k").alias("field"), k.alias("value")), F.struct(F.lit("n").alias("field"), n.alias("value"))))
    runs = own.select("outcome", fields(F.col("k"), F.col("n")).alias("f")).select("outcome", "f.*")
    changed = own.select("outcome", fields(F.when(F.col("outcome") % 5 == 0, F.col("k") + 1).otherwise(F.col("k")), F.when(F.col("outcome") % 7 == 0, F.col("n") * 1.01).otherwise(F.col("n"))).alias("f"))
    return audit.number_findings(changed.select("outcome", "f.*"), runs, "X007")


@query("audit_unresolved", "WITH c AS (SELECT l_orderkey AS key, 'f' || l_linenumber AS field, CASE WHEN l_discount > 0.08 THEN 'differs' WHEN l_tax = 0 THEN 'missing_b' ELSE 'equal' END AS status, l_quantity FROM lineitem) SELECT key, field, 'X009' AS code FROM c a WHERE status <> 'equal' AND NOT EXISTS (SELECT 1 FROM c b WHERE b.key = a.key AND b.field = a.field AND b.l_quantity < 25)")
def audit_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("f"), "l_linenumber").alias("field"), F.when(F.col("l_discount") > 0.08, "differs").when(F.col("l_tax") == 0, "missing_b").otherwise("equal").alias("status"), "l_quantity")
    return audit.unresolved(lines, lines.where("l_quantity < 25"))


_PROV = "ce AS (SELECT 'r' || c_custkey AS row_uid, 'bal' AS field, c_acctbal AS value, c_custkey % 3 = 0 AS estimated, c_custkey AS k FROM customer), pv AS (SELECT row_uid, field, CASE WHEN k % 5 = 0 THEN '1,5' ELSE replace(value::VARCHAR, '.', ',') END AS entered, k % 7 = 0 OR estimated AS was, CASE WHEN k % 4 = 0 THEN ' ' ELSE 'p. ' || k END AS locator FROM ce WHERE k % 6 <> 0)"


@query("audit_provenance", f"WITH {_PROV}, b AS (SELECT ce.*, entered, was, locator FROM ce LEFT JOIN pv USING (row_uid, field)) SELECT row_uid, field, 'X010' AS code FROM b WHERE coalesce(trim(locator), '') = '' UNION ALL SELECT row_uid, field, 'X013' FROM b WHERE was IS NOT NULL AND was <> estimated UNION ALL SELECT row_uid, field, 'X022' FROM b WHERE entered IS NOT NULL AND k % 5 = 0 AND value <> 1.5")
def audit_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cells = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), k).alias("row_uid"), F.lit("bal").alias("field"), F.col("c_acctbal").alias("value"), (k % 3 == 0).alias("estimated"), k)
    entered = F.when(k % 5 == 0, "1,5").otherwise(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")))
    provenance = cells.where("c_custkey % 6 <> 0").select("row_uid", "field", entered.alias("entered"), ((k % 7 == 0) | F.col("estimated")).alias("estimated"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("p. "), k)).alias("locator"))
    return audit.provenance_findings(cells.drop("c_custkey"), provenance)


_APP = "en AS (SELECT c_custkey AS unit, CASE c_nationkey % 3 WHEN 0 THEN 'prediction model' ELSE 'review' END AS design FROM customer), ap AS (SELECT o_custkey AS unit, CASE WHEN o_orderkey % 2 = 0 THEN 'PROBAST' ELSE 'AMSTAR 2' END AS tool, o_orderstatus AS rating, 'F' AS implied, CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus END AS override, CASE WHEN o_orderkey % 33 = 0 THEN 'seen' END AS reason, CASE WHEN o_orderkey % 29 = 0 THEN 'suspected' END AS bias FROM orders)"


@query("audit_appraisal", f"WITH {_APP} SELECT unit, 'X011' AS code FROM en WHERE design = 'prediction model' AND unit NOT IN (SELECT unit FROM ap WHERE tool = 'PROBAST') UNION ALL SELECT unit, 'X012' FROM ap WHERE tool = 'AMSTAR 2' AND rating <> implied AND override IS NULL UNION ALL SELECT unit, 'X017' FROM ap WHERE override <> implied AND reason IS NULL UNION ALL SELECT unit, 'X019' FROM ap WHERE bias = 'suspected'")
def audit_appraisal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.when(F.col("c_nationkey") % 3 == 0, "prediction model").otherwise("review").alias("design"))
    appraisals = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.when(k % 2 == 0, "PROBAST").otherwise("AMSTAR 2").alias("tool"), s.alias("rating"), F.lit("F").alias("implied"), F.when(k % 11 == 0, s).alias("override"), F.when(k % 33 == 0, "seen").alias("reason"), F.when(k % 29 == 0, "suspected").alias("bias"))
    return audit.appraisal_findings(entries, appraisals)


@query("audit_counts", "WITH s AS (SELECT o_custkey % 50 AS outcome, o_orderkey AS study FROM orders), f AS (SELECT o.outcome, 60 AS included, 50 + o.outcome % 2 AS included_meta FROM range(50) o(outcome)), n AS (SELECT outcome, count(DISTINCT study) AS n FROM s GROUP BY outcome) SELECT f.outcome::BIGINT AS outcome, 'X014' AS code FROM f JOIN n ON n.outcome = f.outcome WHERE n > included UNION ALL SELECT outcome::BIGINT, 'X015' FROM f WHERE included_meta <> 50")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("outcome"), F.col("o_orderkey").alias("study"))
    flow = spark.range(50).select(F.col("id").alias("outcome"), F.lit(60).alias("included"), (50 + F.col("id") % 2).alias("included_meta"))
    return audit.count_findings(flow, studies, spark.range(50).select(F.col("id").alias("outcome"), F.lit(50).alias("k")))


@query("audit_deviations", "WITH p AS (SELECT o_orderkey AS outcome, 'status' AS option, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS planned FROM orders WHERE o_orderkey % 13 <> 0), u AS (SELECT o_orderkey AS outcome, 'status' AS option, o_orderstatus AS used FROM orders) SELECT outcome, option, planned, used FROM u LEFT JOIN p USING (outcome, option) WHERE planned IS DISTINCT FROM used AND outcome % 4 <> 0")
def audit_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    used = table(spark, sf_dir, "orders").select(k.alias("outcome"), F.lit("status").alias("option"), F.col("o_orderstatus").alias("value"))
    planned = used.where("outcome % 13 <> 0").withColumn("value", F.when(F.col("outcome") % 10 == 0, "X").otherwise(F.col("value")))
    return audit.deviations(planned, used, used.where("outcome % 4 = 0"))


@query("audit_screening", "WITH d AS (SELECT o_custkey AS record, CASE WHEN o_orderkey % 2 = 0 THEN 'exclude' ELSE 'include' END AS value, o_orderpriority AS reason FROM orders), c AS (SELECT reason, count(*) AS own FROM d WHERE value = 'exclude' GROUP BY reason) SELECT c_custkey::VARCHAR AS subject, 'X020' AS code FROM customer WHERE c_custkey NOT IN (SELECT record FROM d) UNION ALL SELECT reason, 'X021' FROM c WHERE reason IN ('1-URGENT', '2-HIGH') UNION ALL SELECT 'none', 'X021'")
def audit_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.when(F.col("o_orderkey") % 2 == 0, "exclude").otherwise("include").alias("value"), F.col("o_orderpriority").alias("reason"))
    counted = decisions.where("value = 'exclude'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    reported = counted.withColumn("n", F.when(F.col("reason").isin("1-URGENT", "2-HIGH"), F.col("n") + 1).otherwise(F.col("n"))).union(spark.createDataFrame([("none", 3)], "reason string, n long"))
    return audit.screening_findings(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record")), decisions, reported)


_PROJ = "rc AS (SELECT o_orderkey AS rec, CASE WHEN o_orderkey % 6 = 0 THEN 'doi:' || o_orderkey WHEN o_orderkey % 6 < 4 THEN '10.1234/' || o_orderkey END AS doi, o_orderkey % 31 = 0 AS retracted, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey * 2 END AS evidence_id, 5 AS n_claimed, o_orderkey % 8 AS n_found FROM orders)"


@query("audit_project", f"WITH {_PROJ} SELECT rec, 'H002' AS code FROM rc WHERE evidence_id IS NOT NULL AND evidence_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT rec, 'H003' FROM rc WHERE doi LIKE 'doi:%' UNION ALL SELECT rec, 'H005' FROM rc WHERE retracted UNION ALL SELECT rec, 'H006' FROM rc WHERE n_found < n_claimed")
def audit_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    doi = F.when(k % 6 == 0, F.concat(F.lit("doi:"), k)).when(k % 6 < 4, F.concat(F.lit("10.1234/"), k))
    rows = table(spark, sf_dir, "orders").select(k.alias("rec"), doi.alias("doi"), (k % 31 == 0).alias("retracted"), F.when(k % 5 > 0, F.col("o_custkey") * 2).alias("evidence_id"), F.lit(5).alias("n_claimed"), (k % 8).alias("n_found"))
    return audit.project_findings(rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("evidence_id")))


@query("audit_gate", "WITH f AS (SELECT o_custkey AS scope, CASE o_orderstatus WHEN 'F' THEN 'X001' WHEN 'O' THEN 'X009' ELSE 'X018' END AS code, CASE WHEN o_orderkey % 40 = 0 THEN 'blocker' WHEN o_orderkey % 9 = 0 THEN 'warning' ELSE 'info' END AS severity FROM orders), e AS (SELECT scope, CASE WHEN severity = 'warning' AND code IN ('X001', 'X009') THEN 'blocker' ELSE severity END AS severity FROM f), m AS (SELECT scope, count(*) FILTER (severity = 'blocker') AS blockers FROM e GROUP BY scope) SELECT *, CASE WHEN blockers > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM m")
def audit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.when(s == "F", "X001").when(s == "O", "X009").otherwise("X018").alias("code"), F.when(k % 40 == 0, "blocker").when(k % 9 == 0, "warning").otherwise("info").alias("severity"))
    return audit.gate(audit.escalated(rows, {"X001": "05", "X009": "06", "X018": "08"}, "06"))
