"""Queries of report tables as grids, inclusion of studies, citations, record order and coded levels, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import citations
from evidra.operators import grids
from evidra.sources.shared import stored, table

from .catalog import query

# Tables of reports ----------------------------------------------------------------------------------------------------


_HEADS = ((0, 0, "Study", 2, 1), (0, 1, "Arm", 1, 2), (0, 2, "Note", 2, 1), (1, 0, "N", 1, 1), (1, 1, "Events", 1, 1))


def _cell(row, place, text, rowspan, colspan, head):
    return F.struct(row.cast("long").alias("row"), place.cast("int").alias("place"), text.alias("text"), rowspan.cast("int").alias("rowspan"), colspan.cast("int").alias("colspan"), head.alias("head"))


def _head_cells():
    """The two rows of headers of each table."""
    return F.array(*[_cell(*map(F.lit, cell), F.lit(True)) for cell in _HEADS])


def spanned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a table: two rows of headers and a row of two to four cells for each line, some of them over several rows or
    columns; the first cell of a line names a study. Lines are dealt by order, so that cells lie table by table."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    p, s, q = F.col("p"), F.col("s"), F.col("q")
    label = F.concat(F.lit("Supplier"), F.translate(s.cast("string"), "0123456789", "abcdefghij"), F.lit(" et al. "), (1990 + p % 30).cast("string"))
    body = F.transform(F.sequence(F.lit(0), (1 + p % 3).cast("int")), lambda k: _cell(
        F.col("l_linenumber") + 1, k, F.when(k == 0, label).otherwise(F.format_string("%.0f", q + k)),
        F.when(k == 0, 1 + (s % 5 == 0).cast("int")).otherwise((s + 2 * k) % 4), F.when(k == 0, F.lit(None)).otherwise(1 + (p + k) % 2), F.lit(False),
    ))
    none = F.slice(_head_cells(), 1, 0)
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) == 1
    lines = lines.withColumn("first", first)
    return lines.select(F.col("l_orderkey").alias("table_id"), F.inline(F.concat(F.when(F.col("first"), _head_cells()).otherwise(none), F.coalesce(body, none))))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") + 1).alias("row"))
    return grids.laid_out(spanned_cells(spark, sf_dir), rows)


@query("table_grid")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query("table_studies")
def table_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = stored(_grid(spark, sf_dir), "grid")  # several passes read it
    headers = grids.header_rows(grid)
    return grids.study_rows(grid, headers, grids.column_heads(grid, headers))


@query("table_heads", "SELECT t.table_id, c.col, c.path FROM (SELECT DISTINCT l_orderkey AS table_id FROM lineitem) t, (VALUES (0, 'Study'), (1, 'Arm > N'), (2, 'Arm > Events'), (3, 'Note')) c(col, path)")
def table_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id")).distinct()
    grid = stored(grids.laid_out(tables.select("table_id", F.inline(_head_cells()))), "grid")  # several passes read it
    return grids.column_heads(grid, grids.header_rows(grid).withColumn("body", F.col("first") + 2))


# Inclusion ------------------------------------------------------------------------------------------------------------


@query(
    "inclusion_statements",
    "WITH o AS (SELECT o_orderkey AS review, (o_orderkey % 40 + 1)::INT AS a, (o_orderkey % 7)::INT AS w FROM orders) SELECT review, CASE review % 4 WHEN 0 THEN w + 2 ELSE 17 END::INT AS n_said, "
    "CASE review % 4 WHEN 0 THEN range(a, a + w + 1) WHEN 1 THEN list_sort(list_distinct([a, a + 5, a + 6, 900])) ELSE list_sort(list_distinct([a, 1])) END AS refs FROM o WHERE review % 4 < 3",
)
def inclusion_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, w = k % 40 + 1, k % 7
    count = F.when(k % 8 == 0, F.element_at(F.array(*[F.lit(x) for x in grids.WORDS]), (w + 1).cast("int"))).otherwise((w + 2).cast("string"))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("We included "), count, F.lit(" randomised controlled trials in all [ "), a, F.lit("–"), a + w, F.lit("].")))
        .when(k % 4 == 1, F.concat(F.lit("In the end 17 trials were included ["), a + 5, F.lit(" - "), a + 6, F.lit(", 900,"), a, F.lit("].")))
        .when(k % 4 == 2, F.concat(F.lit("We identified and included 17 reports ["), a, F.lit(", 1, 1].")))
        .otherwise(F.lit("Others included seven trials in the end. See [4]."))
    )
    found = grids.statements(table(spark, sf_dir, "orders").select(k.alias("review"), text.alias("sentence")))
    return found.withColumn("refs", F.col("refs").cast("array<bigint>"))


_REVIEW = (
    "rf AS (SELECT l_suppkey AS review, l_partkey AS ref, bool_or(l_returnflag = 'A' AND l_suppkey % 3 = 0) AS inc, bool_or(l_returnflag = 'R' AND l_linenumber = 2) AS exc FROM lineitem GROUP BY ALL), "
    "ok AS (SELECT review, ref FROM rf WHERE inc OR NOT exc), "
    "firm AS (SELECT DISTINCT review, ref, strategy FROM (SELECT review, ref, 'a1' AS strategy FROM rf WHERE inc UNION ALL SELECT l_suppkey, l_partkey, CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'a2' ELSE 'a3' END FROM lineitem WHERE (l_orderkey + l_linenumber) % 7 < 2 AND l_suppkey % 4 <> 1) JOIN ok USING (review, ref)), "
    "fd AS (SELECT review, count(DISTINCT ref) AS n_firm, bool_or(strategy = 'a1') AS has_a1 FROM firm GROUP BY review), "
    "sd AS (SELECT l_suppkey AS review, list(DISTINCT l_partkey) AS refs FROM lineitem WHERE (l_orderkey + l_linenumber) % 7 = 2 AND l_suppkey % 5 < 3 GROUP BY l_suppkey), "
    "st AS (SELECT review, refs, len(refs) AS n, len(refs) + CASE review % 5 WHEN 0 THEN 0 WHEN 1 THEN len(refs) ELSE len(refs) + 1 END AS n_said FROM sd), "
    "bl AS (SELECT st.*, n_firm IS NULL OR (NOT has_a1 AND n = n_said AND n_said > n_firm) AS creates FROM st LEFT JOIN fd USING (review) WHERE n = n_said OR (n >= 2 AND 2 * n >= n_said)), "
    "told AS (SELECT review, ref, creates FROM (SELECT review, unnest(refs) AS ref, creates FROM bl) JOIN ok USING (review, ref)), "
    "votes AS (SELECT review, ref, min(strategy) AS strategy, count(DISTINCT strategy) AS n_strategies FROM (SELECT *, true AS creates FROM firm UNION ALL SELECT review, ref, 'a4', creates FROM told) GROUP BY review, ref HAVING bool_or(creates))"
)


def _review(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every supplier is a review that lists its parts: some in sections of included and excluded studies, some in tables, some in a
    sentence that gives a count."""
    lines = table(spark, sf_dir, "lineitem")
    review, ref = F.col("l_suppkey").alias("review"), F.col("l_partkey").alias("ref")
    flag, mode = F.col("l_returnflag"), (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    section = F.array_compact(F.array(F.when((flag == "A") & (F.col("l_suppkey") % 3 == 0), "included"), F.when((flag == "R") & (F.col("l_linenumber") == 2), "excluded"), F.lit("studies")))
    references = lines.select(review, ref, F.explode(section).alias("section"))
    claims = lines.where((mode < 2) & (F.col("l_suppkey") % 4 != 1)).select(review, ref, F.when(mode == 0, "a2").otherwise("a3").alias("strategy"))
    cited = lines.where((mode == 2) & (F.col("l_suppkey") % 5 < 3)).groupBy(review).agg(F.collect_set("l_partkey").alias("refs"))
    n, k = F.size("refs"), F.col("review") % 5
    said = n + F.when(k == 0, 0).when(k == 1, n).otherwise(n + 1)
    sentences = cited.select("review", F.concat(F.lit("We included "), said, F.lit(" trials ["), F.array_join("refs", ", "), F.lit("].")).alias("sentence"))
    return grids.inclusion(references, claims, grids.statements(sentences))


@query("inclusion", f"WITH {_REVIEW} SELECT review, ref, 'included' AS role, strategy, n_strategies FROM votes UNION ALL SELECT review, ref, 'unknown', 'list', 0 FROM rf WHERE review NOT IN (SELECT review FROM votes)")
def inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir)[0]


@query("inclusion_completeness", f"WITH {_REVIEW}, m AS (SELECT review, max(n_said) AS n_said FROM bl GROUP BY review), c AS (SELECT review, count(*) AS n_found FROM votes GROUP BY review) SELECT review, n_said, coalesce(n_found, 0) AS n_found, CASE WHEN n_said IS NOT NULL THEN coalesce(n_found, 0) >= n_said END AS complete FROM (SELECT DISTINCT review FROM rf) LEFT JOIN m USING (review) LEFT JOIN c USING (review)")
def inclusion_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir)[1]


# Citations, records and levels ----------------------------------------------------------------------------------------

_CITE = "c AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_name AS t, 1900 + p_partkey % 120 AS y, p_size AS v FROM part)"


@query(
    "citations",
    f"WITH {_CITE} SELECT id, CASE WHEN k IN (0, 1) THEN 'Miller AB, Jones C' WHEN k = 2 THEN 'Miller et al' END AS authors, CASE WHEN k < 4 AND length(t) >= 15 AND len(string_split(t, ' ')) >= 3 THEN t || CASE WHEN k = 2 THEN '?' ELSE '' END END AS title, "
    "CASE WHEN k < 5 THEN 'Ann Meta' END AS journal, CASE WHEN k < 5 THEN y END AS year, CASE WHEN k < 5 THEN v::VARCHAR END AS volume, CASE WHEN k = 0 THEN 'Suppl 1' END AS issue, CASE WHEN k < 5 THEN 'e' || id END AS first_page, CASE WHEN k IN (0, 1) THEN (id + 4)::VARCHAR END AS last_page FROM c",
)
def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("p_partkey"), F.col("p_name")
    k, year = i % 6, 1900 + i % 120
    source = F.concat(F.lit("Ann  Meta. "), year, F.lit(" Mar 3; "), F.col("p_size"))
    pages = F.concat(F.lit(":e"), i)
    text = (
        F.when(k == 0, F.concat(F.lit("Miller AB, Jones C. "), t, F.lit(". "), source, F.lit("(Suppl 1)"), pages, F.lit("–"), i + 4, F.lit(". doi:10.1000/2001;5:7")))
        .when(k == 1, F.concat(F.lit(" Miller AB, Jones C. "), t, F.lit(".\n"), source, pages, F.lit("-"), i + 4, F.lit(".")))
        .when(k == 2, F.concat(F.lit("Miller et al. "), t, F.lit("? "), source, pages))
        .when(k == 3, F.concat(t, F.lit(". "), source, pages))
        .when(k == 4, F.concat(source, pages))
        .otherwise(F.concat(F.lit("Miller AB. "), t, F.lit(". Ann Meta, in press "), year))
    )
    return table(spark, sf_dir, "part").select(i.alias("id"), citations.cited(text).alias("c")).select("id", "c.*")


_KINDS = "['rec-x-', 'rec-nct-', 'rec-doi-', 'local-', 'rec-pmcid-', 'rec-eid-', 'rec-oa-', 'rec-pmid-']"


@query(
    "first_records",
    f"WITH r AS (SELECT o_custkey AS study, {_KINDS}[o_orderkey % 8 + 1] AS kind, {_KINDS}[o_orderkey % 8 + 1] || o_orderkey AS rec FROM orders) "
    "SELECT study, arg_min(rec, (coalesce(list_position(['rec-pmid-', 'rec-doi-', 'rec-pmcid-', 'rec-eid-', 'rec-oa-', 'rec-nct-', 'rec-x-'], kind), 8), rec)) AS record FROM r GROUP BY study",
)
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("rec-x-", "rec-nct-", "rec-doi-", "local-", "rec-pmcid-", "rec-eid-", "rec-oa-", "rec-pmid-")])
    rec = F.concat(F.element_at(kinds, (F.col("o_orderkey") % 8 + 1).cast("int")), "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("study"), rec.alias("rec"))
    return rows.groupBy("study").agg(F.min(citations.record_order(F.col("rec")))["identifier"].alias("record"))


_LEVELS = "v AS (SELECT o_orderkey AS id, ['1', '01', '2', '2.0', ' 3', '4', 'IV'][o_orderkey % 7 + 1] AS level FROM orders)"


@query("coded_levels", f"WITH {_LEVELS} SELECT '01' AS wanted, id, level FROM v WHERE level = '01' UNION ALL SELECT '1.00', id, level FROM v WHERE level IN ('1', '01') UNION ALL SELECT '3', id, level FROM v WHERE level = ' 3' UNION ALL SELECT 'IV', id, level FROM v WHERE level = 'IV'")
def coded_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in ("1", "01", "2", "2.0", " 3", "4", "IV")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), level.alias("level"))
    out = None
    for wanted in ("01", "1.00", "3", "IV"):
        met = citations.with_level(rows, "level", wanted).select(F.lit(wanted).alias("wanted"), "id", "level")
        out = met if out is None else out.union(met)
    return out
