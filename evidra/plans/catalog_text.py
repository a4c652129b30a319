"""Queries of stems, quotes, dates, signals, tables of reports and redaction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import mining, rules
from evidra.sources import exports
from evidra.sources.shared import table

from .catalog import query


@query("stems", f"WITH w AS (SELECT doc_id, lower(unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+')))) AS w FROM documents) SELECT DISTINCT w AS word, {mining.stem_sql('w')} AS stem FROM w")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))).alias("w"))
    return words.select(F.lower("w").alias("word")).distinct().select("word", mining.stem(F.col("word")).alias("stem"))


@query("quotes", "WITH d AS (SELECT doc_id, text, instr(lower(text), 'thon') AS at0 FROM documents) SELECT doc_id, substr(text, greatest(1, at0 - 148), 300) AS quote FROM d WHERE at0 > 0")
def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", mining.clipped_quote(F.col("text"), "thon").alias("quote")).where("quote IS NOT NULL")


@query("search_snippets", "WITH d AS (SELECT doc_id, text, instr(lower(text), 'thon') AS at0 FROM documents) SELECT doc_id, at0 AS place, regexp_replace(substr(text, greatest(1, at0 - 40), 120), '(?i)(thon)', '[\\1]', 'g') AS snippet FROM d WHERE at0 > 0")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("snippet", rules.snippet(F.col("text"), "thon")).where("snippet IS NOT NULL")
    return d.select("doc_id", F.instr(F.lower("text"), "thon").cast("long").alias("place"), "snippet")


@query("search_dates", "SELECT o_custkey, date_trunc('month', max(o_orderdate))::DATE AS date FROM orders WHERE o_orderkey % 4 < 2 GROUP BY o_custkey")
def search_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "MMMM yyyy")
    text = F.when(k == 0, F.concat(F.lit("We searched three databases from inception to "), d, F.lit("."))).when(k == 1, F.concat(F.lit("Searches ran until 15 "), d)).when(k == 2, F.concat(F.lit("We searched for trials published between 1990 and 2000, up to "), d)).otherwise(F.concat(F.lit("Patients were followed to "), d))
    return mining.search_dates(table(spark, sf_dir, "orders").select("o_custkey", text.alias("sentence")), "o_custkey")


_SIG = "sg AS (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN ' Registered in PROSPERO.' WHEN 1 THEN ' Risk of bias was judged; data were pooled.' WHEN 2 THEN ' We followed PRISMA.' ELSE '' END) AS t FROM documents WHERE text IS NOT NULL)"


@query("signals", f"WITH {_SIG} SELECT doc_id, signal FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS signal FROM sg WHERE regexp_matches(t, '{p}')" for s, p in mining.SIGNALS.items()) + ")")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    more = F.when(k == 0, " Registered in PROSPERO.").when(k == 1, " Risk of bias was judged; data were pooled.").when(k == 2, " We followed PRISMA.").otherwise("")
    return mining.signals(table(spark, sf_dir, "documents").select("doc_id", F.concat("text", more).alias("text")), "doc_id", "text")


@query("secret_redaction", "SELECT doc_id, md5(regexp_replace(text, '(?i)\\b(api[_-]?key|token|password|secret)(\\s*[=:]\\s*)\\S+', '\\1\\2***', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(rules.redacted(F.col("text"))).alias("digest"))


_KIND = "CASE WHEN regexp_matches(h, '^([0-9]+\\.?\\s*)?(methods?|materials|patients)\\b') THEN 'methods' WHEN regexp_matches(h, '^([0-9]+\\.?\\s*)?(results?|findings)\\b') THEN 'results' WHEN regexp_matches(h, '^([0-9]+\\.?\\s*)?(introduction|background)\\b') THEN 'introduction' WHEN regexp_matches(h, '^([0-9]+\\.?\\s*)?(discussion|conclusions?)\\b') THEN 'discussion' ELSE 'other' END"


@query("page_sections", f"WITH x AS (SELECT page_id, lower(trim(unnest(list_concat(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h', 1), ['2. Methods', 'Results and tables'])))) AS h FROM pages WHERE html IS NOT NULL) SELECT page_id, {_KIND} AS kind, count(*) AS n FROM x GROUP BY ALL")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.concat(F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>([^<]*)</h"), 1), F.array(F.lit("2. Methods"), F.lit("Results and tables")))
    rows = table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.explode(heads).alias("h"))
    return rows.groupBy("page_id", rules.section_kind(F.col("h")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# Tables of reports ----------------------------------------------------------------------------------------------------


@query("table_kinds", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'included' WHEN 1 THEN 'excluded' WHEN 2 THEN 'data' ELSE 'other' END AS kind FROM part")
def table_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    caption = F.when(k == 0, "Characteristics of included studies").when(k == 1, "Characteristics of excluded studies").otherwise("Table 3")
    return table(spark, sf_dir, "part").select("p_partkey", mining.table_kind(caption, F.when(k == 2, "Study | Events | N1").otherwise("Study | Notes")).alias("kind"))


_TAB = "tb AS (SELECT l_orderkey AS table_id, l_linenumber AS row, CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey % 3 END AS code, CASE l_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Smith' ELSE 'Jones' END AS label FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL))"


@query("row_groups", f"WITH {_TAB}, f AS (SELECT *, last_value(nullif(trim(label), '') IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row ROWS UNBOUNDED PRECEDING) AS fl FROM tb), n AS (SELECT *, CASE WHEN lag(row) OVER w IS NULL THEN 1 WHEN code IS NOT NULL THEN (code IS DISTINCT FROM lag(code) OVER w)::INT ELSE (fl IS DISTINCT FROM lag(fl) OVER w)::INT END AS new FROM f WINDOW w AS (PARTITION BY table_id ORDER BY row)) SELECT table_id, row, (sum(new) OVER (PARTITION BY table_id ORDER BY row ROWS UNBOUNDED PRECEDING))::BIGINT AS study_row FROM n")
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 4
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    rows = lines.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_suppkey") % 3).alias("code"), F.when(k == 0, " ").when(k == 1, "Smith").otherwise("Jones").alias("label"))
    return mining.row_groups(rows).select("table_id", "row", "study_row")


_REF = "rf AS (SELECT c_custkey AS ref, 'S' || c_nationkey AS surname, 1990 + c_custkey % 40 AS year FROM customer), rw AS (SELECT o_orderkey AS table_id, 1 AS row, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS xref, 'S' || o_orderkey % 25 AS surname, 1990 + o_orderkey % 40 AS year FROM orders)"


@query("row_references", f"WITH {_REF}, a AS (SELECT table_id, row, ref, 'xref' AS mode FROM rw JOIN rf ON xref = ref), u AS (SELECT surname, year, min(ref) AS ref FROM rf GROUP BY ALL HAVING count(*) = 1) SELECT * FROM a UNION ALL SELECT table_id, row, u.ref, 'author-year' FROM rw JOIN u USING (surname, year) WHERE (table_id, row) NOT IN (SELECT (table_id, row) FROM a)")
def row_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref"), F.concat(F.lit("S"), "c_nationkey").alias("surname"), (1990 + F.col("c_custkey") % 40).alias("year"))
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("table_id"), F.lit(1).alias("row"), F.when(k % 3 == 0, F.col("o_custkey")).alias("xref"), F.concat(F.lit("S"), k % 25).alias("surname"), (1990 + k % 40).alias("year"))
    return mining.row_references(rows, refs)


@query("included_studies", "WITH c AS (SELECT l_suppkey AS review, l_partkey AS ref, ['a1', 'a2', 'a4', 'zz'][l_linenumber % 4 + 1] AS strategy FROM lineitem), r AS (SELECT *, CASE strategy WHEN 'a1' THEN 1 WHEN 'a2' THEN 2 WHEN 'a4' THEN 3 END AS k FROM c) SELECT review, ref, arg_min(strategy, k) AS strategy, count(DISTINCT strategy) AS n_strategies FROM r WHERE k IS NOT NULL GROUP BY review, ref")
def included_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = F.element_at(F.array(*[F.lit(x) for x in ("a1", "a2", "a4", "zz")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("review"), F.col("l_partkey").alias("ref"), strategy.alias("strategy"))
    return mining.included_studies(claims, {"a1": 1, "a2": 2, "a4": 3})


@query("update_windows", "SELECT o_custkey AS topic, (max(o_orderdate)::DATE - INTERVAL 6 MONTH)::DATE AS start, max(o_orderdate)::DATE AS last, (min(o_orderdate)::DATE + INTERVAL 24 MONTH)::DATE < max(o_orderdate)::DATE AS wide FROM orders GROUP BY o_custkey")
def update_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.update_window(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("topic"), F.to_date("o_orderdate").alias("searched")))


# Exports and documents ------------------------------------------------------------------------------------------------


@query("ris_lines", "WITH r AS (SELECT doc_id AS rec, CASE WHEN doc_id % 5 > 0 THEN 'Title ' || doc_id END AS title, source AS journal, 1990 + doc_id % 30 AS year FROM documents) SELECT rec, array_to_string(list_filter(['TY  - JOUR', 'TI  - ' || title, 'JO  - ' || journal, 'PY  - ' || year, 'ER  - '], lambda x: x IS NOT NULL), chr(10)) AS ris FROM r")
def ris_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(k.alias("rec"), F.when(k % 5 > 0, F.concat(F.lit("Title "), k)).alias("title"), F.col("source").alias("journal"), (1990 + k % 30).alias("year"))
    return rows.select("rec", exports.ris({"TI": F.col("title"), "JO": F.col("journal"), "PY": F.col("year")}).alias("ris"))


@query("guarded_cells", "WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN '-5' WHEN 2 THEN '@x' ELSE c_name END AS cell FROM customer) SELECT c_custkey, CASE WHEN regexp_matches(cell, '^[=+@\\t\\r-]') AND NOT regexp_matches(cell, '^[-+]?[0-9]+([.,][0-9]+)?$') THEN chr(39) || cell ELSE cell END AS cell FROM c")
def guarded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cell = F.when(k % 4 == 0, "=SUM(A1)").when(k % 4 == 1, "-5").when(k % 4 == 2, "@x").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", exports.guarded(cell).alias("cell"))


@query("spec_digests", "SELECT o_orderkey, sha256('{' || '\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}') AS digest FROM orders")
def spec_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.map_from_arrays(F.array(F.lit("status"), F.lit("priority")), F.array("o_orderstatus", "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", exports.spec_digest(spec).alias("digest"))


@query("first_sources", "SELECT l_partkey AS row_uid, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) AS doc FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_partkey")
def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row_uid"), F.struct("l_orderkey", "l_linenumber", "l_returnflag").alias("place"), F.col("l_returnflag").alias("doc"))
    return exports.first_source(cells)


@query("selected_sources", "SELECT s_suppkey AS source FROM supplier WHERE s_nationkey % 2 = 0 AND s_acctbal > 0 AND s_suppkey % 3 <> 0")
def selected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("source"), (F.col("s_nationkey") % 2 == 0).alias("enabled"), (F.col("s_acctbal") > 0).alias("configured"), k)
    return exports.selected_sources(s, s.where("s_suppkey % 3 <> 0").select("source"))
