"""Queries of appraisal rules, record states and text signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import pooling, rules, screening
from evidra.sources.shared import table

from .catalog import _pool_sql, binary_studies, query, rounded

_ANS = "a AS (SELECT o_custkey AS unit, CASE o_orderkey % 3 WHEN 0 THEN 'selection' WHEN 1 THEN 'comparability' ELSE 'outcome' END AS domain, o_totalprice > 100000 AS met, CASE o_orderpriority WHEN '1-URGENT' THEN 'missing' WHEN '2-HIGH' THEN 'partly' WHEN '5-LOW' THEN NULL ELSE 'reported' END AS status FROM orders)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey") % 3, F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("unit"), F.when(k == 0, "selection").when(k == 1, "comparability").otherwise("outcome").alias("domain"), (F.col("o_totalprice") > 100000).alias("met"),
        F.when(p == "1-URGENT", "missing").when(p == "2-HIGH", "partly").when(p == "5-LOW", None).otherwise("reported").alias("status"),
    )


@query("nos_stars", f"WITH {_ANS} SELECT unit, domain, least(count(*) FILTER (met), CASE domain WHEN 'selection' THEN 4 WHEN 'comparability' THEN 2 ELSE 3 END)::BIGINT AS stars FROM a GROUP BY unit, domain")
def nos_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.stars(_answers(spark, sf_dir), {"selection": 4, "comparability": 2, "outcome": 3})


@query("report_completeness", f"WITH {_ANS} SELECT unit, count(*) FILTER (status = 'reported') AS reported, count(*) FILTER (status = 'partly') AS partly, count(*) FILTER (status = 'missing') AS missing, round(100.0 * count(*) FILTER (status = 'reported') / count(*)::DOUBLE, 6) + 0.0 AS percent FROM a WHERE status IS NOT NULL GROUP BY unit")
def report_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.completeness(_answers(spark, sf_dir)))


@query("grade_rob", _pool_sql("DL") + ", w AS (SELECT st.analysis_id, moderator < 5000 AS bad, 1 / (vi + tau2) AS w FROM st JOIN p ON st.analysis_id = p.analysis_id), s AS (SELECT analysis_id, 100 * coalesce(sum(w) FILTER (bad), 0) / sum(w) AS limited FROM w GROUP BY analysis_id) SELECT analysis_id, round(limited, 6) + 0.0 AS limited, CASE WHEN limited >= 50 THEN 'serious' WHEN limited >= 25 THEN 'borderline' ELSE 'not serious' END AS advice FROM s")
def grade_rob(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir)
    level = F.when(F.col("moderator") < 0, "high").when(F.col("moderator") < 5000, "some").otherwise("low")
    shares = screening.weight_shares(pooling.weights(own).join(own.select("row_index", level.alias("level")), "row_index"))
    return rounded(rules.rob_advice(shares))


@query("classify_new", "WITH n AS (SELECT doc_id, md5(text) AS value, substr(text, 1, 20) AS title FROM documents WHERE doc_id % 4 = 0), k AS (SELECT md5(text) AS value, substr(text, 1, 20) AS title FROM documents WHERE doc_id % 4 <> 0) SELECT doc_id AS rec_id, CASE WHEN value IN (SELECT value FROM k) THEN 'already_known' WHEN title IN (SELECT title FROM k) THEN 'possible_duplicate' ELSE 'new' END AS status FROM n")
def classify_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.md5("text").alias("value"), F.substring("text", 1, 20).alias("title"))
    return rules.classified_new(d.where("rec_id % 4 = 0"), d.where("rec_id % 4 <> 0"))


@query("study_status", "WITH s AS (SELECT o_custkey AS study, min(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 WHEN 'O' THEN 3 END) AS n FROM orders GROUP BY o_custkey) SELECT study, CASE n WHEN 1 THEN 'included' WHEN 2 THEN 'pending' ELSE 'excluded' END AS status FROM s WHERE n IS NOT NULL")
def study_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return rules.study_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("study"), F.when(s == "F", "included").when(s == "P", "pending").when(s == "O", "excluded").alias("status")))


@query("last_wins", "WITH q AS (SELECT user_id AS client, event_id AS seq, CASE WHEN event_type = 'view' THEN 'explore' ELSE 'commit' END AS mode FROM events), k AS (SELECT * FROM q QUALIFY mode = 'commit' OR row_number() OVER (PARTITION BY client, mode ORDER BY seq DESC) = 1) SELECT client, seq, mode, row_number() OVER (PARTITION BY client ORDER BY seq)::INT AS place FROM k")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "explore").otherwise("commit").alias("mode"))
    return rules.last_wins(e)


@query("reported_k", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN 12 END::INT AS k FROM part WHERE p_partkey % 3 < 2")
def reported_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("After screening, "), "p_size", F.lit(" trials were included."))).when(k == 1, "We included twelve studies in all.").otherwise("Many studies exist.")
    return rules.reported_counts(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("section_kinds", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'methods' WHEN 1 THEN 'results' WHEN 2 THEN 'introduction' WHEN 3 THEN 'discussion' ELSE 'other' END AS kind FROM part")
def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.element_at(F.array(*[F.lit(t) for t in ("2. Methods", "Results and figures", " Background", "Conclusions", "Funding")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", rules.section_kind(title).alias("kind"))


@query("content_fingerprints", "SELECT c_custkey, sha256('c_mktsegment=' || coalesce('''' || c_mktsegment || '''', 'null') || ';c_name=' || coalesce('''' || c_name || '''', 'null') || ';c_nationkey=' || coalesce('''' || c_nationkey || '''', 'null')) AS digest FROM customer")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", rules.fingerprint(["c_name", "c_nationkey", "c_mktsegment"]).alias("digest"))


@query("sentence_counts", "SELECT doc_id, (len(regexp_extract_all(trim(text), '[.!?]\\s+\\p{Lu}')) + 1)::BIGINT AS n FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.sentences(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("table_stats", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("customer", "supplier", "documents", "events"):
        own = table(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n")
        out = own if out is None else out.union(own)
    return out
