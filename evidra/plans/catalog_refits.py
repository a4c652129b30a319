"""Queries of refits, rank tests and meta-regression of analyses of any size, and of raw files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import special as X
from evidra.operators import bias, refits, tall
from evidra.sources import raw
from evidra.sources.shared import new_folder, table

from .catalog import _M, _STB, binary_studies, bounded_studies, query, r, rounded
from .catalog_stats import _BG

# Refits ---------------------------------------------------------------------------------------------------------------

for _method in ("reml", "pm"):
    query(f"loo_{_method}")(lambda spark, sf_dir, m=_method.upper(): rounded(refits.leave_one_out(binary_studies(spark, sf_dir), m)))
    query(f"cumulative_{_method}")(lambda spark, sf_dir, m=_method.upper(): rounded(refits.cumulative(binary_studies(spark, sf_dir), "moderator", m)))

# Rank test ------------------------------------------------------------------------------------------------------------

_PARTS = _BG.rpartition(", b AS")[0]
_V = "greatest(0, (k * (k - 1) * (2 * k + 5) - tz.t3 - tv.t3) / 18 + tz.t1 * tv.t1 / (2 * k * (k - 1)) + tz.t2 * tv.t2 / (9 * k * (k - 1) * (k - 2)))"


@query(
    "begg_exact",
    f"WITH RECURSIVE {_STB}, {_M}, {_PARTS}, dist AS (SELECT 1 AS m, [1.0::DOUBLE] AS p UNION ALL SELECT m + 1, list_transform(range(0, len(p) + m), lambda i: coalesce(list_sum(p[greatest(1, i - m + 1):least(i + 1, len(p))]), 0) / (m + 1)) FROM dist WHERE m < 50), "
    f"b AS (SELECT n.analysis_id, k, s, tz.t1 + tv.t1 AS ties, sqrt({_V}) AS sd, sqrt((k * (k - 1) - tz.t1) / 2 * ((k * (k - 1) - tv.t1) / 2)) AS base FROM n JOIN pr USING (analysis_id) JOIN tz USING (analysis_id) JOIN tv USING (analysis_id) WHERE k >= 3), "
    "e AS (SELECT b.*, list_sum(list_transform(range(0, len(p)), lambda i: CASE WHEN abs(k * (k - 1) / 2 - 2 * i) >= abs(s) - 1e-9 THEN p[i + 1] ELSE 0 END)) AS p_exact FROM b JOIN dist ON m = k) "
    f"SELECT analysis_id, k::BIGINT AS k, " + r(s="s", tau_b="s / nullif(base, 0)", p=f"CASE WHEN base > 0 THEN CASE WHEN ties = 0 THEN least(1, p_exact) ELSE least(1, 2 * {X.norm_cdf('(-abs(s / sd))')}) END END") + ", CASE WHEN ties = 0 THEN 'exact' ELSE 'normal' END AS method FROM e",
)
def begg_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.begg_exact(bounded_studies(spark, sf_dir)))


@query(
    "begg_whole",
    f"WITH {_STB.replace('sr.analysis_id * 1000000 + sr.row_index // 50 AS analysis_id', 'sr.analysis_id')}, {_M}, {_PARTS} SELECT n.analysis_id, k::BIGINT AS k, " + r(s="s", tau_b="s / nullif(sqrt((k * (k - 1) - tz.t1) / 2 * ((k * (k - 1) - tv.t1) / 2)), 0)") + " FROM n JOIN pr USING (analysis_id) JOIN tz USING (analysis_id) JOIN tv USING (analysis_id) WHERE k > 1",
)
def begg_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``begg_tau`` of whole regions, which may have any size."""
    return rounded(bias.begg(binary_studies(spark, sf_dir)))


# Regression -----------------------------------------------------------------------------------------------------------


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_studies(spark, sf_dir).withColumn("size", F.log(F.col("n1") + F.col("n2")))


for _method in ("reml", "pm"):
    query(f"metareg_{_method}")(lambda spark, sf_dir, m=_method.upper(): rounded(tall.meta_regression(_sized(spark, sf_dir), ["moderator", "size"], m, "knha")))

# Raw files ------------------------------------------------------------------------------------------------------------


def documents_as_file(spark: SparkSession, sf_dir: str) -> str:
    """The documents as delimited files with quoted texts, one in eleven with a cell too many; the folder."""
    folder = new_folder(spark, "raw-files")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(";", F.col("doc_id").cast("string"), quoted, F.col("lang"), F.col("n_chars").cast("string"))
    more = F.when(F.col("doc_id") % 11 == 0, F.concat(line, F.lit(";more"))).otherwise(line)
    table(spark, sf_dir, "documents").where("text IS NOT NULL").select(more.alias("value")).write.option("lineSep", "\n").text(folder)
    return folder


@query("raw_records", "SELECT doc_id, md5(text) AS digest, lang, n_chars::VARCHAR AS n_chars, CASE WHEN doc_id % 11 = 0 THEN 5 ELSE 4 END AS n_cells FROM documents WHERE text IS NOT NULL")
def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, read back from delimited files in byte ranges; their texts hold line breaks, delimiters and quotes."""
    rows = raw.raw_records(spark, documents_as_file(spark, sf_dir), ";").where("size(cells) > 0")
    cell = lambda k: F.col("cells")[k]
    return rows.select(cell(0).cast("long").alias("doc_id"), F.md5(cell(1)).alias("digest"), cell(2).alias("lang"), cell(3).alias("n_chars"), F.size("cells").alias("n_cells"))


@query(
    "raw_findings",
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_orderkey ELSE round(o_totalprice)::BIGINT::VARCHAR END AS m1, CASE WHEN o_orderkey % 5 = 0 THEN 'n/k' ELSE '12' END AS sd1 FROM orders) "
    "SELECT NULL AS \"column\", '2' AS value, 'V024' AS code, count(*) AS n FROM o WHERE o_orderkey % 13 = 0 HAVING count(*) > 0 UNION ALL SELECT 'm1', m1, 'V003', count(*) FROM o WHERE o_orderkey % 13 <> 0 AND o_orderkey % 7 = 0 GROUP BY m1 "
    "UNION ALL SELECT 'sd1', sd1, 'V021', count(*) FROM o WHERE o_orderkey % 13 <> 0 AND o_orderkey % 5 = 0 GROUP BY sd1 HAVING count(*) > 0 UNION ALL SELECT 'm1.2', NULL, 'V028', 1",
)
def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the orders as a raw table: one price in seven and one deviation in five are no numbers, one row in 13 is too short, and
    a column stands twice."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    m1 = F.when(key % 7 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(F.round("o_totalprice").cast("long").cast("string"))
    cells = [key.cast("string"), m1, F.when(key % 5 == 0, "n/k").otherwise("12"), F.lit("1")]
    line = F.when(key % 13 == 0, F.concat_ws(";", *cells[:2])).otherwise(F.concat_ws(";", *cells))
    folder = new_folder(spark, "raw-table")
    # A header in each part file: the lines are whole, so the writer must neither cut nor quote.
    o.select(line.alias("study;m1;sd1;m1")).write.options(header=True, sep="\u0001", quote="\u0000", lineSep="\n").csv(folder)
    names, body = raw.headed(raw.raw_records(spark, folder, ";"))
    return raw.raw_findings(names, body, ";", needed=("m1",)).groupBy("column", "value", "code").agg(F.count(F.lit(1)).alias("n"))
