"""Queries of validation, agreement, linkage, screening, search and logs over the sample tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import effects as E
from evidra.functions import text as T
from evidra.operators import agreement, linkage, pooling, screening, search, validate
from evidra.sources import studies as S
from evidra.sources.shared import table
from evidra.streaming import events as stream

from .catalog import _M, _PARTS, _ST, _TAU, _pool_sql, binary_studies, query, r, rounded, sparse_arms

# Validation -------------------------------------------------------------------------------------------------------------

_BIN_RULES = "SELECT row_index, code, severity, '' AS detail FROM (SELECT row_index, unnest([CASE WHEN (e1 = 0 AND e2 = 0) OR (e1 = n1 AND e2 = n2) THEN {'code': 'V008', 'severity': 'warning'} END, CASE WHEN NOT ((e1 = 0 AND e2 = 0) OR (e1 = n1 AND e2 = n2)) AND (e1 = 0 OR e2 = 0 OR e1 = n1 OR e2 = n2) THEN {'code': 'V009', 'severity': 'info'} END, CASE WHEN n1 < 1 OR n2 < 1 THEN {'code': 'V004', 'severity': 'error'} END, CASE WHEN least(n1, n2) < 10 THEN {'code': 'V020', 'severity': 'info'} END]) AS f FROM arms), (SELECT 1) WHERE f IS NOT NULL"
_BIN_RULES = _BIN_RULES.replace("SELECT row_index, code, severity,", "SELECT row_index, f.code AS code, f.severity AS severity,").replace(", (SELECT 1) WHERE", " WHERE")


@query("validate_rows", f"WITH {S.arms2x2_sql('l_partkey')} {_BIN_RULES}")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.binary_rows(S.arms2x2(spark, sf_dir, "l_partkey"))


@query(
    "validate_continuous",
    f"WITH {S.CONTINUOUS} SELECT row_index, 'V013' AS code, 'info' AS severity, '' AS detail FROM arms WHERE (m1 >= 0 AND m1 < 2 * sd1) OR (m2 >= 0 AND m2 < 2 * sd2) UNION ALL SELECT row_index, 'V020', 'info', '' FROM arms WHERE least(n1, n2) < 10 UNION ALL SELECT row_index, 'V005', 'error', '' FROM arms WHERE sd1 <= 0 OR sd2 <= 0",
)
def validate_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.continuous_rows(S.arms_continuous(spark, sf_dir))


_LABELS = "lb AS (SELECT st.row_index, st.analysis_id, st.subgroup AS label, yi, vi FROM st)"


@query(
    "validate_cross",
    f"WITH {_ST}, {_LABELS}, w AS (SELECT *, count(*) OVER (PARTITION BY analysis_id, {T.folded_sql('label')}) AS same, sum(CASE WHEN vi > 0 THEN 1 ELSE 0 END) OVER a AS k, min(row_index) OVER a AS f FROM lb WINDOW a AS (PARTITION BY analysis_id)) "
    "SELECT row_index, 'V007' AS code, 'warning' AS severity, label AS detail FROM w WHERE same > 1 UNION ALL SELECT row_index, 'V014', 'warning', '' FROM w WHERE abs(yi) > 2.995732273553991 UNION ALL SELECT row_index, 'V015', 'warning', '' FROM w WHERE row_index = f AND k < 5 UNION ALL SELECT row_index, 'V016', 'info', '' FROM w WHERE row_index = f AND k >= 5 AND k < 10 UNION ALL SELECT row_index, 'V026', 'error', '' FROM w WHERE row_index = f AND k = 0",
)
def validate_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir).where("vi IS NOT NULL").select("row_index", "analysis_id", F.col("subgroup").alias("label"), "yi", "vi")
    return validate.cross_rows(own)


@query("blocking_rows", f"WITH {S.arms2x2_sql('l_partkey')} SELECT row_index, 'V004' AS codes FROM arms WHERE n1 < 1 OR n2 < 1")
def blocking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.blocking(validate.binary_rows(S.arms2x2(spark, sf_dir, "l_partkey")))


@query("suspected_se", f"WITH {S.CONTINUOUS}, {S.SUPPLIERS}, z AS (SELECT arms.*, analysis_id, median(sd1) OVER w AS d1, median(sd2) OVER w AS d2 FROM arms JOIN sr ON arms.row_index = sr.row_index WINDOW w AS (PARTITION BY analysis_id)) SELECT row_index, 'V011' AS code, 'warning' AS severity, 'sd1' AS detail FROM z WHERE sd1 < 0.3 * d1 AND sd1 * sqrt(n1) BETWEEN 0.5 * d1 AND 2 * d1 AND (sd2 < 0.3 * d1 OR sd2 / sd1 >= sqrt(n1) / 2) UNION ALL SELECT row_index, 'V011', 'warning', 'sd2' FROM z WHERE sd2 < 0.3 * d2 AND sd2 * sqrt(n2) BETWEEN 0.5 * d2 AND 2 * d2 AND (sd1 < 0.3 * d2 OR sd1 / sd2 >= sqrt(n2) / 2)")
def suspected_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.suspected_se(S.arms_continuous(spark, sf_dir).join(S.supplier_regions(spark, sf_dir).select("row_index", "analysis_id"), "row_index"))


@query("filters_norm", "SELECT 'include c_mktsegment=Building' AS filter, count(*) FILTER (c_mktsegment <> 'BUILDING') AS removed FROM customer UNION ALL SELECT 'exclude c_nationkey=7.0', count(*) FILTER (c_mktsegment = 'BUILDING' AND c_nationkey = 7) FROM customer")
def filters_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.filtered(table(spark, sf_dir, "customer"), [("c_mktsegment", "Building")], [("c_nationkey", "7.0")])[1]


# Agreement ------------------------------------------------------------------------------------------------------------------

_KAPPA = "WITH c AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b, count(*)::DOUBLE AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), n AS (SELECT sum(c) AS n FROM c), p AS (SELECT a, b, c / n AS p FROM c, n), ra AS (SELECT a, sum(p) AS p FROM p GROUP BY a), cb AS (SELECT b, sum(p) AS p FROM p GROUP BY b), s AS (SELECT n, (SELECT coalesce(sum(p), 0) FROM p WHERE a = b) AS po, (SELECT coalesce(sum(ra.p * cb.p), 0) FROM ra JOIN cb ON a = b) AS pe FROM n), k AS (SELECT *, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM s), f AS (SELECT p.a, p.b, p.p, coalesce(ra.p, 0) AS rb, coalesce(cb.p, 0) AS ca FROM p LEFT JOIN ra ON ra.a = p.b LEFT JOIN cb ON cb.b = p.a), v AS (SELECT sum(CASE WHEN a = b THEN p * pow(1 - (ca + rb) * (1 - kappa), 2) ELSE 0 END) AS s1, sum(CASE WHEN a <> b THEN p * pow(ca + rb, 2) ELSE 0 END) AS s2 FROM f, k) "


@query("kappa", _KAPPA + "SELECT n::BIGINT AS n, " + r(po="po", pe="pe", kappa="kappa", se="sqrt(greatest(s1 + pow(1 - kappa, 2) * s2 - pow(kappa - pe * (1 - kappa), 2), 0)) / ((1 - pe) * sqrt(n))") + ", CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' WHEN kappa IS NOT NULL THEN 'almost perfect' END AS label FROM k, v")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("icc", f"WITH {S.CONTINUOUS}, m AS (SELECT count(*)::DOUBLE AS n, avg(m1) AS ma, avg(m2) AS mb FROM arms), s AS (SELECT any_value(n) AS n, sum(2 * pow((m1 + m2) / 2 - (ma + mb) / 2, 2)) AS ssr, any_value(n * (pow(ma - (ma + mb) / 2, 2) + pow(mb - (ma + mb) / 2, 2))) AS ssc, sum(pow(m1 - (ma + mb) / 2, 2) + pow(m2 - (ma + mb) / 2, 2)) AS sst FROM arms, m), q AS (SELECT n, ssr / (n - 1) AS msr, ssc AS msc, (sst - ssr - ssc) / (n - 1) AS mse FROM s) SELECT n::BIGINT AS n, " + r(icc="(msr - mse) / (msr + mse + 2 * (msc - mse) / n)") + " FROM q")
def icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.icc(S.arms_continuous(spark, sf_dir), "m1", "m2"))


@query("bland_altman", f"WITH {S.CONTINUOUS} SELECT count(*) AS n, " + r(mean_diff="avg(m1 - m2)", sd="stddev_samp(m1 - m2)", low="avg(m1 - m2) - 1.96 * stddev_samp(m1 - m2)", high="avg(m1 - m2) + 1.96 * stddev_samp(m1 - m2)", max_abs="max(abs(m1 - m2))") + " FROM arms")
def bland_altman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.bland_altman(S.arms_continuous(spark, sf_dir), "m1", "m2"))


_AB = f"{S.arms2x2_sql()}, bx AS (SELECT row_index, CASE WHEN row_index % 7 = 0 THEN e1 * 10 WHEN row_index % 11 = 0 THEN NULL WHEN row_index % 13 = 0 THEN e1 * 1.0005 ELSE e1 END AS e1, CASE WHEN row_index % 5 = 0 THEN -n1 ELSE n1 END AS n1 FROM arms WHERE row_index % 17 <> 0), cells AS (SELECT coalesce(a.row_index, b.row_index) AS row_index, unnest([{{'field': 'e1', 'a': a.e1, 'b': b.e1}}, {{'field': 'n1', 'a': a.n1, 'b': b.n1}}]) AS c FROM arms a FULL JOIN bx b ON a.row_index = b.row_index), d AS (SELECT row_index, c.field AS field, c.a AS a, c.b AS b FROM cells), st9 AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 'both_empty' WHEN a IS NULL THEN 'missing_a' WHEN b IS NULL THEN 'missing_b' WHEN a = b THEN 'equal' WHEN abs(a - b) <= greatest(1e-9, 1e-3 * greatest(abs(a), abs(b))) THEN 'within_tolerance' ELSE 'differs' END AS status FROM d)"


def _second_extraction(arms: DataFrame) -> DataFrame:
    k = F.col("row_index")
    e1 = F.when(k % 7 == 0, F.col("e1") * 10).when(k % 11 == 0, None).when(k % 13 == 0, F.col("e1") * 1.0005).otherwise(F.col("e1"))
    return arms.where(k % 17 != 0).select("row_index", e1.alias("e1"), F.when(k % 5 == 0, -F.col("n1")).otherwise(F.col("n1")).alias("n1"))


@query("ab_diff", f"WITH {_AB} SELECT row_index, field, " + r(a="a", b="b") + ", status FROM st9")
def ab_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = S.arms2x2(spark, sf_dir).select("row_index", "e1", "n1")
    return rounded(agreement.table_diff(arms, _second_extraction(arms), ["row_index"], ["e1", "n1"]))


@query("ab_hints", f"WITH {_AB} SELECT row_index, field, CASE WHEN a = -b THEN 'sign' WHEN abs(abs(a / nullif(b, 0)) / 10 - 1) <= 0.02 OR abs(abs(a / nullif(b, 0)) / 0.1 - 1) <= 0.02 THEN 'factor 10' END AS hint FROM st9 WHERE status = 'differs'")
def ab_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = S.arms2x2(spark, sf_dir).select("row_index", "e1", "n1")
    return agreement.cause_hints(agreement.table_diff(arms, _second_extraction(arms), ["row_index"], ["e1", "n1"])).select("row_index", "field", "hint")


# Linkage ----------------------------------------------------------------------------------------------------------------------

_REC = "rec AS (SELECT doc_id AS rec_id, string_split(text, chr(10))[1] AS title, string_split(text, ' ')[1] AS author, source AS journal, (1990 + doc_id % 30)::INT AS year, text FROM documents)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, title, author, journal, year, text): documents as bibliographic records."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("rec_id"), F.split("text", "\n")[0].alias("title"), F.split("text", " ")[0].alias("author"), F.col("source").alias("journal"), (1990 + F.col("doc_id") % 30).cast("int").alias("year"), "text")


_INC = "inc AS (SELECT DISTINCT l_partkey AS study, s_nationkey AS review FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study, review): parts that the suppliers of a nation delivered."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("review")), "l_suppkey")
    return lines.select(F.col("l_partkey").alias("study"), "review").distinct()


@query("overlap_cca", f"WITH {_INC}, m AS (SELECT count(*) AS n, count(DISTINCT study) AS r, count(DISTINCT review) AS c FROM inc) SELECT n, r, c, round(100.0 * (n - r) / (r * c - r)::DOUBLE, 6) + 0.0 AS cca, CASE WHEN round(100.0 * (n - r) / (r * c - r)) <= 5 THEN 'slight' WHEN round(100.0 * (n - r) / (r * c - r)) <= 10 THEN 'moderate' WHEN round(100.0 * (n - r) / (r * c - r)) <= 15 THEN 'high' ELSE 'very high' END AS band FROM m")
def overlap_cca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linkage.overlap(incidence(spark, sf_dir)))


@query("overlap_pairs", f"WITH {_INC}, z AS (SELECT review, count(*) AS n FROM inc GROUP BY review), p AS (SELECT x.review AS a, y.review AS b, count(*) AS shared FROM inc x JOIN inc y ON x.study = y.study AND x.review < y.review GROUP BY ALL) SELECT a, b, shared, za.n AS n_a, zb.n AS n_b, round(100.0 * shared / (za.n + zb.n - shared)::DOUBLE, 6) + 0.0 AS cca FROM p JOIN z za ON a = za.review JOIN z zb ON b = zb.review")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linkage.overlap_pairs(incidence(spark, sf_dir)))


@query("overlap_by_review", f'WITH {_INC}, w AS (SELECT *, count(*) OVER (PARTITION BY study) AS t, min(review) OVER (PARTITION BY study) AS f FROM inc) SELECT review, count(*) AS n, count(*) FILTER (t = 1) AS "unique", count(*) FILTER (f = review) AS "index" FROM w GROUP BY review')
def overlap_by_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.overlap_by_review(incidence(spark, sf_dir))


@query("merge_conflicts", "WITH v AS (SELECT l_partkey AS study, 'discount' AS field, s_nationkey AS review, max(l_discount) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT study, field, count(DISTINCT review) AS reviews, min(value) AS low, max(value) AS high FROM v GROUP BY ALL HAVING count(DISTINCT review) >= 2 AND max(value) - min(value) > 1e-6")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return linkage.conflicts(lines.groupBy(F.col("l_partkey").alias("study"), F.lit("discount").alias("field"), F.col("s_nationkey").alias("review")).agg(F.max("l_discount").alias("value")))


@query("upsert_update", "WITH a AS (SELECT user_id AS rec, event_type AS route, max(event_id) AS version FROM events GROUP BY ALL), n AS (SELECT user_id AS rec, 'click' AS route, max(event_id) AS version FROM events WHERE event_type = 'view' OR event_id % 2 = 0 GROUP BY user_id) SELECT * FROM a WHERE route <> 'click' UNION ALL SELECT * FROM n")
def upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), F.col("event_type").alias("route"), F.col("event_id").alias("version"))
    existing = linkage.upsert(e.where("route <> 'click'"), e.where("route = 'click'").drop("route"), "rec", "click")
    arrivals = table(spark, sf_dir, "events").where("event_type = 'view' OR event_id % 2 = 0").select(F.col("user_id").alias("rec"), F.col("event_id").alias("version"))
    return linkage.upsert(existing, arrivals, "rec", "click").select("rec", "route", "version")


# Screening, flows and rules ---------------------------------------------------------------------------------------------------------

_LOG = "lg AS (SELECT user_id AS record, event_id % 2 AS reviewer, event_type AS value, ts, event_id FROM events)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("record"), (F.col("event_id") % 2).alias("reviewer"), F.col("event_type").alias("value"), "ts", "event_id")


@query("screening_status", f"WITH {_LOG}, l AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY record, reviewer ORDER BY ts DESC, event_id DESC) = 1) SELECT record, CASE WHEN count(*) < 2 THEN 'partial' WHEN count(DISTINCT value) > 1 THEN 'conflict' ELSE 'decided ' || min(value) END AS status, count(*) AS n_reviewers FROM l GROUP BY record")
def screening_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.dual_status(log(spark, sf_dir), ["ts", "event_id"])


@query("log_effective", f"WITH {_LOG} SELECT record, value, event_id FROM lg QUALIFY row_number() OVER (PARTITION BY record ORDER BY ts DESC, event_id DESC) = 1")
def log_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.effective(log(spark, sf_dir), ["record"], ["ts", "event_id"]).select("record", "value", "event_id")


_FLOW = "rs AS (SELECT source AS route, doc_id <> min(doc_id) OVER (PARTITION BY md5(text)) AS dup, CASE WHEN n_chars > 1000 THEN 'included' ELSE 'excluded' END AS status FROM documents), fl AS (SELECT route, count(*) AS identified, count(*) FILTER (dup) AS duplicates, count(*) FILTER (NOT dup) AS screened, count(*) FILTER (NOT dup AND status = 'excluded') AS excluded, count(*) FILTER (NOT dup AND status = 'included') AS included FROM rs GROUP BY ROLLUP (route))"


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("key", F.md5("text"))
    first = d.groupBy("key").agg(F.min("doc_id").alias("first"))
    rows = d.join(first, "key").select(F.col("source").alias("route"), (F.col("doc_id") != F.col("first")).alias("is_duplicate"), F.when(F.col("n_chars") > 1000, "included").otherwise("excluded").alias("status"))
    return screening.branch_counts(rows)


@query("branch_counts", f"WITH {_FLOW} SELECT * FROM fl")
def branch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir)


_GRADE = ", h AS (SELECT analysis_id, CASE WHEN k > 1 AND q > 0 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END AS i2 FROM m), g AS (SELECT p.analysis_id, (CASE WHEN i2 >= 0.5 THEN 1 ELSE 0 END)::INT AS inconsistency, (CASE WHEN lo < -0.1 AND hi > -0.1 AND lo < 0.1 AND hi > 0.1 THEN 2 WHEN (lo < -0.1 AND hi > -0.1) OR (lo < 0.1 AND hi > 0.1) OR (lo < 0 AND hi > 0) THEN 1 ELSE 0 END)::INT AS imprecision, (CASE WHEN k < 10 THEN 1 ELSE 0 END)::INT AS few FROM (SELECT *, mu - 1.959963984540054 * se AS lo, mu + 1.959963984540054 * se AS hi FROM p) p JOIN h ON p.analysis_id = h.analysis_id) SELECT *, least(4, greatest(1, 4 - inconsistency - imprecision - few))::INT AS certainty FROM g"


@query("grade_arith", _pool_sql("DL") + _GRADE)
def grade_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir)
    both = pooling.pooled(own, "DL").join(pooling.heterogeneity(own).select("analysis_id", "i2"), "analysis_id")
    d = both.select("analysis_id", F.when(F.col("i2") >= 0.5, 1).otherwise(0).alias("inconsistency"), screening.imprecision(F.col("ci_low"), F.col("ci_high"), 0.1).alias("imprecision"), F.when(F.col("k") < 10, 1).otherwise(0).alias("few"))
    return d.withColumn("certainty", screening.grade(F.lit(4), [F.col("inconsistency"), F.col("imprecision"), F.col("few")], [F.lit(0)]))


@query("amstar2", "WITH a AS (SELECT o_custkey AS unit, (o_orderkey % 16)::INT AS item, CASE WHEN o_orderpriority = '1-URGENT' THEN 'no' ELSE 'yes' END AS answer FROM orders), m AS (SELECT unit, count(*) FILTER (answer = 'no' AND item IN (2, 4, 7, 9, 11, 13, 15)) AS critical_flaws, count(*) FILTER (answer = 'no' AND item NOT IN (2, 4, 7, 9, 11, 13, 15)) AS weaknesses FROM a GROUP BY unit) SELECT *, CASE WHEN critical_flaws > 1 THEN 'critically low' WHEN critical_flaws = 1 THEN 'low' WHEN weaknesses > 1 THEN 'moderate' ELSE 'high' END AS rating FROM m")
def amstar2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), (F.col("o_orderkey") % 16).cast("string").alias("item"), F.when(F.col("o_orderpriority") == "1-URGENT", "no").otherwise("yes").alias("answer"))
    return screening.amstar2(a, ["2", "4", "7", "9", "11", "13", "15"])


@query("rob_implied", "WITH a AS (SELECT o_custkey AS unit, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'some' WHEN '5-LOW' THEN NULL ELSE 'low' END AS answer FROM orders) SELECT unit, CASE WHEN bool_or(coalesce(answer = 'high', false)) THEN 'high' WHEN bool_or(answer IS NULL) THEN NULL WHEN bool_or(answer = 'some') THEN 'some' ELSE 'low' END AS overall FROM a GROUP BY unit")
def rob_implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.when(p == "1-URGENT", "high").when(p == "2-HIGH", "some").when(p == "5-LOW", None).otherwise("low").alias("answer"))
    return screening.implied(a)


@query("rob_weight", _pool_sql("DL") + ", w AS (SELECT st.analysis_id, CASE WHEN moderator < 0 THEN 'high' WHEN moderator < 5000 THEN 'some' ELSE 'low' END AS level, 1 / (vi + tau2) AS w FROM st JOIN p ON st.analysis_id = p.analysis_id) SELECT analysis_id, level, round(100 * sum(w) / any_value(t), 6) + 0.0 AS share FROM (SELECT *, sum(w) OVER (PARTITION BY analysis_id) AS t FROM w) GROUP BY analysis_id, level")
def rob_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir)
    level = F.when(F.col("moderator") < 0, "high").when(F.col("moderator") < 5000, "some").otherwise("low")
    return rounded(screening.weight_shares(pooling.weights(own).join(own.select("row_index", level.alias("level")), "row_index")))


@query("chain_verify", "WITH c AS (SELECT user_id, ts, event_id, sha256(event_id || '|' || user_id || '|' || event_type) AS digest, lag(sha256(event_id || '|' || user_id || '|' || event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), t AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN sha256('changed') ELSE digest END AS digest) FROM c), b AS (SELECT *, lag(digest) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM t) SELECT event_id, user_id FROM b WHERE prev IS DISTINCT FROM before")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["ts", "event_id"]
    chain = screening.chained(table(spark, sf_dir, "events"), order, "user_id", ["event_id", "user_id", "event_type"])
    changed = chain.withColumn("digest", F.when(F.col("event_id") % 97 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.col("digest")))
    return screening.broken_links(changed, order, "user_id").select("event_id", "user_id")


@query("date_windows", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month_start, (o_orderdate - INTERVAL 12 MONTH)::DATE AS anchor, o_orderdate::DATE >= DATE '1995-01-01' - INTERVAL 6 MONTH AND o_orderdate::DATE < DATE '1996-01-01' AS inside FROM orders")
def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    inside = (d >= F.add_months(F.lit("1995-01-01").cast("date"), -6)) & (d < F.lit("1996-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.trunc(d, "month").alias("month_start"), F.add_months(d, -12).alias("anchor"), inside.alias("inside"))


# Search and scans ------------------------------------------------------------------------------------------------------------------

TERMS = ["the", "er*"]
_POST = f"w AS (SELECT doc_id AS chunk_id, unnest(string_split({T.folded_sql('text')}, ' ')) AS token FROM documents), po AS (SELECT chunk_id, token, count(*) AS tf FROM w WHERE token <> '' GROUP BY ALL), ln AS (SELECT chunk_id, sum(tf)::DOUBLE AS length FROM po GROUP BY chunk_id), tt AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean FROM ln)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@query(
    "bm25_search",
    f"WITH {_POST}, f AS (SELECT chunk_id, 0 AS term, sum(tf) AS tf FROM po WHERE token = 'the' GROUP BY chunk_id UNION ALL SELECT chunk_id, 1, sum(tf) FROM po WHERE starts_with(token, 'er') GROUP BY chunk_id), d AS (SELECT term, count(*)::DOUBLE AS df FROM f GROUP BY term) "
    f"SELECT f.chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * length / mean))), 6) + 0.0 AS score FROM f JOIN d USING (term) JOIN ln USING (chunk_id), tt GROUP BY f.chunk_id HAVING count(*) = 2",
)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.bm25(search.postings(chunks(spark, sf_dir), TERMS), TERMS))


@query("phrase_search", f"SELECT doc_id AS chunk_id, (len(string_split(replace(' ' || {T.folded_sql('text')} || ' ', ' ', '  '), ' of  the ')) - 1)::BIGINT AS hits FROM documents WHERE len(string_split(replace(' ' || {T.folded_sql('text')} || ' ', ' ', '  '), ' of  the ')) > 1")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase(chunks(spark, sf_dir), "of the")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_NINE = "len(list_filter(list_transform(regexp_extract_all(text, " + _q(T.NINE_DIGITS) + "), lambda d: regexp_replace(d, '[ -]', '', 'g')), lambda d: (" + " + ".join(f"substr(d, {k + 1}, 1)::INT * {3 if k % 2 == 0 else 7}" for k in range(8)) + ") % 10 = substr(d, 9, 1)::INT))"


@query("phi_scan", "SELECT doc_id, u.pattern AS pattern, u.hits::BIGINT AS hits FROM (SELECT doc_id, unnest([" + ", ".join(f"{{'pattern': '{n}', 'hits': {x}}}" for n, x in (("email", f"len(regexp_extract_all(text, {_q(T.EMAIL)}))"), ("date", f"len(regexp_extract_all(text, {_q(T.FULL_DATE)}))"), ("phone", f"len(regexp_extract_all(text, {_q(T.PHONE)}))"), ("nine_digit_id", _NINE))) + "]) AS u FROM documents WHERE text IS NOT NULL) WHERE u.hits > 0")
def phi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phi_scan(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("registry_ids", "SELECT DISTINCT doc_id, registry, value FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS registry, unnest(regexp_extract_all(tx, {_q(p)})) AS value FROM (SELECT doc_id, text || ' NCT' || lpad(doc_id::VARCHAR, 8, '0') || ', CRD42' || lpad(doc_id::VARCHAR, 9, '0') AS tx FROM documents)" for n, p in T.REGISTRIES.items()) + ")")
def registry_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = lambda n: F.lpad(F.col("doc_id").cast("string"), n, "0")
    return search.registry_ids(d.select("doc_id", F.concat("text", F.lit(" NCT"), key(8), F.lit(", CRD42"), key(9)).alias("text")), "doc_id", "text")


@query("page_facts", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<h[1-6][^>]*>'))::BIGINT AS headings, len(regexp_extract_all(html, '<a [^>]*href='))::BIGINT AS links, len(regexp_extract_all(html, '<p[^>]*>'))::BIGINT AS paragraphs, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))::BIGINT AS text_chars FROM pages")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page_facts(table(spark, sf_dir, "pages"))


# Streaming ---------------------------------------------------------------------------------------------------------------------------


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stream.drained(stream.window_counts(stream.event_stream(spark, f"{sf_dir}/events.parquet")), "windows", ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))
