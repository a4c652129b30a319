"""Further queries: text tables, parsing of cells and citations, advice rules, geometry and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import effects as E
from evidra.functions import parse as P
from evidra.operators import pooling, ranking, tall
from evidra.sources import studies as S
from evidra.sources import tables
from evidra.sources.shared import new_folder, table

from .catalog import _M, _ST, _pool_sql, binary_studies, query, r, rounded
from .catalog_records import _REC, records

# Text tables ---------------------------------------------------------------------------------------------------------------


def _text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms as text cells with decimal commas, some of them missing, grouped, or no number."""
    k = F.col("row_index")
    comma = lambda c: F.regexp_replace(F.format_string("%.2f", F.col(c)), r"\.", ",")
    return S.arms_continuous(spark, sf_dir).select(k.cast("string").alias("row"), F.concat(F.lit("Study "), k).alias("Author"), F.when(k % 9 == 0, "n.a?").when(k % 7 == 0, "NR").otherwise(comma("m1")).alias("Mean 1"), comma("sd1").alias("SD1"), F.when(k % 8 == 0, F.lit("1.234")).otherwise(F.col("n1").cast("long").cast("string")).alias("n1i"), F.when(k % 10 == 0, "=A1").otherwise("ok").alias("note"))


@query(
    "read_table",
    f"WITH {S.CONTINUOUS} SELECT row_index::VARCHAR AS row, 'Study ' || row_index AS study, CASE WHEN row_index % 9 = 0 OR row_index % 7 = 0 THEN NULL ELSE round(m1, 2) + 0.0 END AS m1, round(sd1, 2) + 0.0 AS sd1, CASE WHEN row_index % 8 = 0 THEN 1234.0::DOUBLE ELSE n1 END AS n1, CASE WHEN row_index % 10 = 0 THEN '=A1' ELSE 'ok' END AS note FROM arms",
)
def read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "csv")
    tables.write_delimited(_text_cells(spark, sf_dir), path)
    return rounded(tables.typed(tables.read_delimited(spark, path), "row")[0])


@query("table_findings", f"WITH {S.CONTINUOUS} SELECT row_index::VARCHAR AS row, 'm1' AS \"column\", 'n.a?' AS value, 'V003' AS code FROM arms WHERE row_index % 9 = 0 UNION ALL SELECT row_index::VARCHAR, 'note', '=A1', 'V025' FROM arms WHERE row_index % 10 = 0")
def table_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.typed(_text_cells(spark, sf_dir), "row")[1]


# Conversions ------------------------------------------------------------------------------------------------------------------

_Q = "q AS (SELECT l_suppkey AS row_index, count(*)::DOUBLE AS n, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS med, quantile_cont(l_quantity, 0.75) AS q3, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_suppkey)"


def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row_index")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.percentile("l_quantity", p).alias(a) for p, a in ((0.25, "q1"), (0.5, "med"), (0.75, "q3"))], F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")
    )


@query("mean_from_median", f"WITH {_Q} SELECT row_index, " + r(s1="4 / (4 + pow(n, 0.75)) * (lo + hi) / 2 + pow(n, 0.75) / (4 + pow(n, 0.75)) * med", s2="(0.7 + 0.39 / n) * (q1 + q3) / 2 + (0.3 - 0.39 / n) * med", s3="2.2 / (2.2 + pow(n, 0.75)) * (lo + hi) / 2 + (0.7 - 0.72 / pow(n, 0.55)) * (q1 + q3) / 2 + (0.3 + 0.72 / pow(n, 0.55) - 2.2 / (2.2 + pow(n, 0.75))) * med", hozo="(lo + 2 * med + hi) / 4") + " FROM q")
def mean_from_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q1, m, q3, a, b = (F.col(c) for c in ("n", "q1", "med", "q3", "lo", "hi"))
    made = P.means_from_medians(n, m, q1, q3, a, b)
    return rounded(_quantiles(spark, sf_dir).select("row_index", *[v.alias(k) for k, v in made.items()]))


@query("se_conversions", f"WITH {S.CONTINUOUS}, c AS (SELECT *, m1 - m2 AS md, sqrt(sd1 * sd1 / n1 + sd2 * sd2 / n2) AS se FROM arms) SELECT row_index, " + r(sd="se * sqrt(n1 + n2)", se_from_ci=f"((md + {E.Z975} * se) - (md - {E.Z975} * se)) / (2 * {E.Z975})", sd_from_t="abs(md / nullif(md / se, 0)) / sqrt(1 / n1 + 1 / n2)", d_from_t="md / se * sqrt(1 / n1 + 1 / n2)") + " FROM c")
def se_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.arms_continuous(spark, sf_dir).withColumns({"md": F.col("m1") - F.col("m2"), "se": F.sqrt(F.expr("sd1 * sd1 / n1 + sd2 * sd2 / n2"))})
    md, se, n1, n2 = (F.col(x) for x in ("md", "se", "n1", "n2"))
    root = F.sqrt(1 / n1 + 1 / n2)
    return rounded(c.select("row_index", (se * F.sqrt(n1 + n2)).alias("sd"), (((md + E.Z975 * se) - (md - E.Z975 * se)) / (2 * E.Z975)).alias("se_from_ci"), (F.abs(md / F.nullif(md / se, F.lit(0.0))) / root).alias("sd_from_t"), (md / se * root).alias("d_from_t")))


@query("split_control", "WITH c AS (SELECT o_custkey AS study, count(*) AS arms, (sum(o_orderkey)::BIGINT % 1000) AS n_control FROM orders GROUP BY o_custkey), a AS (SELECT *, unnest(range(1, arms + 1)) AS arm FROM c) SELECT study, arm, (n_control // arms + CASE WHEN arm <= n_control % arms THEN 1 ELSE 0 END)::BIGINT AS n FROM a")
def split_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("study")).agg(F.count(F.lit(1)).alias("arms"), (F.sum("o_orderkey") % 1000).alias("n_control"))
    return P.split_shared_control(c, "study", "arms", "n_control")


# Parsing --------------------------------------------------------------------------------------------------------------------------


@query("cell_values", f"WITH {S.CONTINUOUS}, {S.arms2x2_sql().replace('arms AS', 'a2 AS')} SELECT row_index, 'mean_sd' AS kind, round(m1, 2) + 0.0 AS a, round(sd1, 2) + 0.0 AS b FROM arms UNION ALL SELECT row_index, 'events', e1, n1 FROM a2")
def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_index")
    two = F.format_string("%.2f", F.col("m1"))
    pattern = F.when(k % 2 == 0, F.concat(two, F.lit(" ("), F.format_string("%.2f", F.col("sd1")), F.lit(")"))).otherwise(F.concat(two, F.lit(" ± "), F.format_string("%.2f", F.col("sd1"))))
    cells = S.arms_continuous(spark, sf_dir).select("row_index", pattern.alias("cell"))
    more = S.arms2x2(spark, sf_dir).select("row_index", F.concat(F.col("e1").cast("long"), F.lit("/"), F.col("n1").cast("long"), F.lit(" (12.5%)")).alias("cell"))
    vague = cells.select("row_index", F.lit("see text").alias("cell"))
    return rounded(P.cell_values(cells.union(more).union(vague), "row_index", "cell"))


@query("author_year", f"WITH {_REC} SELECT rec_id, author AS surname, year, chr((97 + rec_id % 3)::INT) AS suffix FROM rec WHERE regexp_matches(author, '^[A-Z][a-z]+$')")
def author_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("author", F.lit(" et al. ("), "year", F.chr(F.lit(97) + F.col("rec_id") % 3), F.lit(")"))
    own = records(spark, sf_dir).where(F.col("author").rlike("^[A-Z][a-z]+$")).select("rec_id", label.alias("label"))
    return P.author_year(own, "rec_id", "label")


@query("reference_ranges", "WITH p AS (SELECT p_partkey, p_size AS a, (p_size + p_partkey % 4)::INT AS b FROM part) SELECT p_partkey, unnest(list_concat(range(a, b + 1), [99]))::INT AS ref FROM p")
def reference_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("as shown ["), F.col("p_size"), F.lit("–"), F.col("p_size") + (F.col("p_partkey") % 4).cast("int"), F.lit(", 99]"))
    return P.reference_ranges(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("partial_dates", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate)::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END AS d, CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS precision FROM orders")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    day, precision = P.partial_date(F.col("text"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", day.alias("d"), precision.alias("precision"))


# Ordering ---------------------------------------------------------------------------------------------------------------------------


@query("natural_sort", "WITH s AS (SELECT p_partkey, p_brand || '-' || p_size AS label FROM part) SELECT p_partkey, row_number() OVER (ORDER BY regexp_extract(label, '^[^0-9]*'), regexp_extract(label, '[0-9]+')::BIGINT, regexp_extract(label, '-([0-9]+)$', 1)::BIGINT, p_partkey) AS place FROM s")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.natural_places(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_brand", "p_size").alias("label")), "label", "p_partkey")


@query("review_rank", f"WITH {_REC} SELECT rec_id, " + r(score="2.0 * (CASE WHEN contains(lower(title), 'the') THEN 1.0 WHEN contains(lower(text), 'the') THEN 0.5 ELSE 0.0 END) + greatest(0.0, least(1.0, 1 - (2020 - year) / 15.0)) + least(1.0, ln(1 + length(text) / 100.0) / ln(51))") + " FROM rec")
def review_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    return rounded(rec.select("rec_id", ranking.review_score(F.col("title"), F.col("text"), ["the"], F.col("year"), F.length("text") / 100.0, 2020).alias("score")))


@query("latest_version", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 1 AS superseded FROM orders")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.superseded(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "superseded")


# Advice and geometry ------------------------------------------------------------------------------------------------------------------


@query("absolute_effects", _pool_sql("DL") + ", g AS (SELECT analysis_id, mu, unnest([0.05, 0.2, 0.5])::DOUBLE AS risk FROM p) SELECT analysis_id, risk, " + r(by_or="1000 * (exp(mu) * risk / (1 - risk + exp(mu) * risk))", by_rr="CASE WHEN exp(mu) * risk <= 1 THEN 1000 * exp(mu) * risk END", by_rd="CASE WHEN risk + mu BETWEEN 0 AND 1 THEN 1000 * (risk + mu) END") + " FROM g")
def absolute_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pooling.pooled(binary_studies(spark, sf_dir), "DL").select("analysis_id", "estimate", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.2, 0.5)])).alias("risk"))
    return rounded(rows.select("analysis_id", "risk", *[(1000 * P.absolute_risk(m, F.col("estimate"), F.col("risk"))).alias(f"by_{m.lower()}") for m in ("OR", "RR", "RD")]))


@query("grade_inconsistency", _pool_sql("DL") + ", w AS (SELECT st.analysis_id, 1 / (vi + tau2) AS w, CASE WHEN yi - 1.959963984540054 * sqrt(vi) > 0 THEN 1 WHEN yi + 1.959963984540054 * sqrt(vi) < 0 THEN -1 ELSE 0 END AS s, sign(mu) AS d FROM st JOIN p ON st.analysis_id = p.analysis_id) SELECT analysis_id, " + r(opposite="100 * sum(CASE WHEN s = -d AND s <> 0 THEN w ELSE 0 END) / sum(w)") + ", CASE WHEN 100 * sum(CASE WHEN s = -d AND s <> 0 THEN w ELSE 0 END) / sum(w) >= 10 THEN 'serious' ELSE 'not serious' END AS advice FROM w GROUP BY analysis_id")
def grade_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir)
    rows = pooling.usable(own).join(pooling.weights(own).select("row_index", "weight"), "row_index").join(pooling.pooled(own, "DL").select("analysis_id", "estimate"), "analysis_id")
    return rounded(ranking.opposite_share(rows))


@query("axis_ticks", f"WITH {_ST}, x AS (SELECT analysis_id, min(yi) AS lo, max(yi) AS hi FROM st GROUP BY analysis_id), e AS (SELECT *, pow(10, floor(log10((hi - lo) / 5))) AS p, (hi - lo) / 5 AS raw FROM x WHERE hi > lo), s AS (SELECT *, p * CASE WHEN raw / p <= 1 THEN 1 WHEN raw / p <= 2 THEN 2 WHEN raw / p <= 2.5 THEN 2.5 WHEN raw / p <= 5 THEN 5 ELSE 10 END AS step FROM e) SELECT analysis_id, " + r(step="step", first="floor(lo / step) * step", last="ceil(hi / step) * step") + " FROM s")
def axis_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = pooling.usable(binary_studies(spark, sf_dir)).groupBy("analysis_id").agg(F.min("yi").alias("lo"), F.max("yi").alias("hi")).where("hi > lo")
    step = P.nice_step((F.col("hi") - F.col("lo")) / 5)
    return rounded(spread.withColumn("step", step).select("analysis_id", "step", (F.floor(F.col("lo") / F.col("step")) * F.col("step")).alias("first"), (F.ceil(F.col("hi") / F.col("step")) * F.col("step")).alias("last")))


@query("funnel_geometry", _pool_sql("DL") + ", x AS (SELECT analysis_id, max(sqrt(vi)) AS top FROM st GROUP BY analysis_id) SELECT analysis_id, z, " + r(left_x="mu - z * top", right_x="mu + z * top", top_se="top") + " FROM (SELECT p.analysis_id, mu, top, unnest([1.6448536269514722, 1.959963984540054, 2.5758293035489004])::DOUBLE AS z FROM p JOIN x ON p.analysis_id = x.analysis_id)")
def funnel_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir)
    tops = pooling.usable(own).groupBy("analysis_id").agg(F.max(F.sqrt("vi")).alias("top_se"))
    z = F.explode(F.array(*[F.lit(v) for v in (1.6448536269514722, 1.959963984540054, 2.5758293035489004)]))
    rows = pooling.pooled(own, "DL").join(tops, "analysis_id").select("analysis_id", "estimate", "top_se", z.alias("z"))
    out = rows.select("analysis_id", "z", (F.col("estimate") - F.col("z") * F.col("top_se")).alias("left_x"), (F.col("estimate") + F.col("z") * F.col("top_se")).alias("right_x"), "top_se")
    return out.select("analysis_id", "z", *[(F.round(c, 6) + 0.0).alias(c) for c in ("left_x", "right_x", "top_se")])


@query("typical_variance", f"WITH {_ST}, {_M} SELECT analysis_id, " + r(s2="CASE WHEN k > 1 THEN (k - 1) / nullif(c, 0) END", harmonic="(SELECT count(*) / sum(1 / (n1 + n2)) FROM st WHERE st.analysis_id = m.analysis_id)") + " FROM m")
def typical_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir)
    h = pooling.usable(own).groupBy("analysis_id").agg((F.count(F.lit(1)) / F.sum(1.0 / (F.col("n1") + F.col("n2")))).alias("harmonic"))
    return rounded(pooling.weighted(own).join(h, "analysis_id").select("analysis_id", F.when(F.col("k") > 1, (F.col("k") - 1) / F.nullif(F.col("c"), F.lit(0.0))).alias("s2"), "harmonic"))


# Comparisons of versions --------------------------------------------------------------------------------------------------------------


@query("three_way_diff", "WITH b AS (SELECT c_custkey AS k, c_nationkey AS base, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS theirs, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END ELSE c_nationkey END AS mine FROM customer) SELECT k, CASE WHEN theirs = mine AND mine = base THEN 'same' WHEN theirs = mine THEN 'both alike' WHEN theirs = base THEN 'mine' WHEN mine = base THEN 'theirs' ELSE 'conflict' END AS status FROM b")
def three_way_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), n.alias("base"), F.when(k % 5 == 0, n + 1).otherwise(n).alias("theirs"), F.when(k % 3 == 0, n + F.when(k % 2 == 0, 1).otherwise(2)).otherwise(n).alias("mine"))
    return rows.select("k", ranking.three_way(F.col("base"), F.col("theirs"), F.col("mine")).alias("status"))


@query("stale_runs", "WITH run AS (SELECT user_id, event_id AS sha FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), cur AS (SELECT user_id, max(event_id) AS sha FROM events GROUP BY user_id) SELECT user_id, 'X001' AS code FROM run JOIN cur USING (user_id) WHERE run.sha <> cur.sha")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = e.where("event_type = 'view'").select("user_id", "ts", "event_id", F.col("event_id").alias("sha"))
    return ranking.stale(runs, e.groupBy("user_id").agg(F.max("event_id").alias("sha")), "user_id", ["ts", "event_id"])


@query("citation_hop", "WITH e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem), s AS (SELECT DISTINCT b FROM e WHERE a <= 10) SELECT DISTINCT e.a AS found FROM e JOIN s ON e.b = s.b WHERE e.a > 10")
def citation_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return ranking.one_hop(e, e.where("a <= 10").select("a").distinct())


@query("duplicates_report", "SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first, count(DISTINCT source) AS sources FROM documents GROUP BY md5(text) HAVING count(*) >= 2")
def duplicates_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.countDistinct("source").alias("sources")).where("n >= 2")


# Regression and power -------------------------------------------------------------------------------------------------------------------


@query("metareg_mixed")
def metareg_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binary_studies(spark, sf_dir).withColumn("size", F.log(F.col("n1") + F.col("n2")))
    return rounded(tall.meta_regression(own, ["moderator", "size"]))
