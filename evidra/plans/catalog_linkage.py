"""Queries of identifiers, merging, similar titles, groups of reports and overlap, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import names as N
from evidra.operators import linkage
from evidra.sources.shared import stored, table

from .catalog import query, rounded
from .catalog_records import _INC, _REC, incidence, records

# Names and identifiers ------------------------------------------------------------------------------------------------

_NAME = (
    "nm AS (SELECT doc_id AS rec_id, CASE doc_id % 6 WHEN 0 THEN 'van der ' || w || ' AB' WHEN 1 THEN w || ', M.' WHEN 2 THEN 'J. W. ' || w || ' Jr' "
    "WHEN 3 THEN w || ' GW et al' WHEN 4 THEN '[No authors listed]' ELSE 'de ' || w || '-' || w || ' II' END AS name "
    "FROM (SELECT doc_id, string_split(text, ' ')[1] AS w FROM documents) WHERE regexp_matches(w, '^[A-Z][a-z]{2,}$'))"
)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, name): first words of documents as authors' names in six forms."""
    w, k = F.col("w"), F.col("doc_id") % 6
    forms = [F.concat(F.lit("van der "), w, F.lit(" AB")), F.concat(w, F.lit(", M.")), F.concat(F.lit("J. W. "), w, F.lit(" Jr")), F.concat(w, F.lit(" GW et al")), F.lit("[No authors listed]")]
    name = F.concat(F.lit("de "), w, F.lit("-"), w, F.lit(" II"))
    for i, form in reversed(list(enumerate(forms))):
        name = F.when(k == i, form).otherwise(name)
    own = table(spark, sf_dir, "documents").withColumn("w", F.split("text", " ")[0]).where(w.rlike("^[A-Z][a-z]{2,}$"))
    return own.select(F.col("doc_id").alias("rec_id"), name.alias("name"))


@query("author_surnames", f"WITH {_NAME} SELECT rec_id, {N.surname_sql('name')} AS surname FROM nm")
def author_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("rec_id", N.surname(F.col("name")).alias("surname"))


_PART = ", ".join(f"'{p}'" for p in N.PARTICLES)
_KEYS = (
    f"ws AS (SELECT rec_id, list_filter(string_split({N.plain_sql(N.surname_sql('name'))}, ' '), lambda x: x <> '') AS w FROM nm) "
    f"SELECT rec_id, array_to_string(list_sort(list_distinct(list_concat([array_to_string(w, '')], list_filter(w, lambda x: length(x) >= 3 AND x NOT IN ({_PART})), list_filter([w[-1]], lambda x: x NOT IN ({_PART}))))), ' ') AS keys FROM ws WHERE len(w) > 0"
)


@query("author_keys", f"WITH {_NAME}, {_KEYS}")
def author_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = names(spark, sf_dir).select("rec_id", F.array_join(N.name_keys(F.col("name")), " ").alias("keys"))
    return keyed.where("keys <> ''")


_RAW = (
    "raw AS (SELECT doc_id AS rec_id, CASE doc_id % 3 WHEN 0 THEN 'PMID: 00' || doc_id WHEN 1 THEN doc_id::VARCHAR ELSE 'x' || doc_id END AS pmid, "
    "CASE doc_id % 2 WHEN 0 THEN 'https://doi.org/10.1000/AB' || doc_id || '.,' ELSE 'doi:10.1000/c(' || doc_id || ')d)' END AS doi, "
    "CASE WHEN doc_id % 4 = 0 THEN 'pmc00' || doc_id END AS pmcid, 'see 2-s2.0-' || doc_id AS eid, 'https://openalex.org/w' || doc_id AS openalex, "
    "'(nct ' || lpad(doc_id::VARCHAR, 8, '0') || ')' AS nct, text FROM documents)"
)


def raw_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        k.alias("rec_id"), F.when(k % 3 == 0, F.concat(F.lit("PMID: 00"), s)).when(k % 3 == 1, s).otherwise(F.concat(F.lit("x"), s)).alias("pmid"),
        F.when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.1000/AB"), s, F.lit(".,"))).otherwise(F.concat(F.lit("doi:10.1000/c("), s, F.lit(")d)"))).alias("doi"),
        F.when(k % 4 == 0, F.concat(F.lit("pmc00"), s)).alias("pmcid"), F.concat(F.lit("see 2-s2.0-"), s).alias("eid"), F.concat(F.lit("https://openalex.org/w"), s).alias("openalex"),
        F.concat(F.lit("(nct "), F.lpad(s, 8, "0"), F.lit(")")).alias("nct"), "text",
    )


@query(
    "norm_ids",
    f"WITH {_RAW} SELECT rec_id, CASE WHEN rec_id % 3 < 2 THEN nullif(ltrim(rec_id::VARCHAR, '0'), '') END AS pmid, CASE rec_id % 2 WHEN 0 THEN '10.1000/ab' || rec_id ELSE '10.1000/c(' || rec_id || ')d' END AS doi, "
    "CASE WHEN rec_id % 4 = 0 AND rec_id > 0 THEN 'PMC' || rec_id END AS pmcid, '2-s2.0-' || rec_id AS eid, 'W' || rec_id AS openalex, 'NCT' || lpad(rec_id::VARCHAR, 8, '0') AS nct FROM raw WHERE rec_id > 0",
)
def norm_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = raw_ids(spark, sf_dir).where("rec_id > 0")
    return own.select("rec_id", *[N.norm_id(k, F.col(k)).alias(k) for k in linkage.KINDS])


@query(
    "record_ids",
    f"WITH {_RAW}, fx AS (SELECT *, {N.plain_sql('text')} AS norm FROM raw), x AS (SELECT *, CASE WHEN len(list_filter(string_split(norm, ' '), lambda w: w <> '')) < 6 THEN rec_id || '|' || norm ELSE norm END AS own FROM fx) "
    "SELECT rec_id, CASE WHEN rec_id % 3 < 2 AND rec_id > 0 THEN 'rec-pmid-' || rec_id WHEN rec_id % 4 = 0 AND rec_id > 0 THEN 'rec-pmcid-pmc' || rec_id ELSE 'rec-x-' || substr(sha1(own), 1, 10) END AS record FROM x WHERE text IS NOT NULL AND rec_id > 0",
)
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = raw_ids(spark, sf_dir).where("text IS NOT NULL AND rec_id > 0")
    return own.select("rec_id", N.record_id({k: F.col(k) for k in ("pmid", "pmcid")}, F.col("text"), F.col("rec_id").cast("string")).alias("record"))


_TRUST = "WITH i AS (SELECT doc_id AS rec_id, md5(text) AS value, source, CASE WHEN doc_id % 5 = 0 THEN 'src1' END AS confirmed FROM documents) SELECT rec_id, value FROM i WHERE value IS NOT NULL AND (source IN ('src0', 'src2') OR confirmed IS NOT NULL)"


@query("trusted_ids", _TRUST)
def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.md5("text").alias("value"), "source", F.when(F.col("doc_id") % 5 == 0, "src1").alias("confirmed"))
    return ids.where(F.col("value").isNotNull() & (F.col("source").isin("src0", "src2") | F.col("confirmed").isNotNull())).select("rec_id", "value")


# Merging by identifiers -----------------------------------------------------------------------------------------------

_IDS = (
    f"{_REC}, ids AS (SELECT rec_id, 'pmid' AS kind, md5(text) AS value FROM rec WHERE text IS NOT NULL AND rec_id % 3 <> 0 UNION SELECT rec_id, 'doi', md5(author) FROM rec WHERE author IS NOT NULL "
    "UNION SELECT rec_id, 'eid', journal || '-' || length(text) FROM rec WHERE text IS NOT NULL)"
)
_JAC = "len(list_intersect(x.w, y.w))::DOUBLE / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))"
_BEGINS = "(length(x.t) <= length(y.t) AND starts_with(y.t, x.t || ' ') AND len(string_split(x.t, ' ')) >= 6) OR (length(y.t) < length(x.t) AND starts_with(x.t, y.t || ' ') AND len(string_split(y.t, ' ')) >= 6)"
_SIM = f"CASE WHEN x.t <> '' AND y.t <> '' THEN CASE WHEN x.t = y.t THEN 1.0 ELSE greatest({_JAC}, CASE WHEN {_BEGINS} THEN 0.95 ELSE 0.0 END) END END"
_AUTHOR = N.plain_sql(N.surname_sql("author"))
_BIB = f"bib AS (SELECT *, list_distinct(string_split(t, ' ')) AS w FROM (SELECT rec_id, {N.norm_title_sql('title')} AS t, coalesce(replace({_AUTHOR}, ' ', ''), '') AS au, year FROM rec))"
_GUARDED = (
    f"{_IDS}, {_BIB}, h AS (SELECT kind, value, min(rec_id) AS head FROM ids GROUP BY ALL), e AS (SELECT DISTINCT ids.rec_id AS a, head AS b FROM ids JOIN h USING (kind, value) WHERE ids.rec_id <> head), "
    "cl AS (SELECT DISTINCT a, b FROM e JOIN ids x ON x.rec_id = a JOIN ids y ON y.rec_id = b AND x.kind = y.kind AND x.value <> y.value), "
    f"ver AS (SELECT e.a, e.b, CASE WHEN cl.a IS NOT NULL THEN 'id_conflict' WHEN coalesce({_SIM} < 0.5 AND NOT (x.au = y.au AND x.au <> '' AND abs(x.year - y.year) <= 1), false) THEN 'bib_conflict' ELSE 'same' END AS verdict "
    "FROM e LEFT JOIN cl USING (a, b) JOIN bib x ON x.rec_id = e.a JOIN bib y ON y.rec_id = e.b)"
)
_MERGED = (
    "ee AS (SELECT a, b FROM ver WHERE verdict = 'same' UNION SELECT b, a FROM ver WHERE verdict = 'same'), w AS (SELECT rec_id AS node, rec_id AS root FROM rec UNION SELECT ee.b, w.root FROM w JOIN ee ON w.node = ee.a), "
    "c AS (SELECT node, min(root) AS root FROM w GROUP BY node), bad AS (SELECT root, kind, count(DISTINCT value) AS n_values FROM c JOIN ids ON ids.rec_id = node GROUP BY ALL HAVING count(DISTINCT value) > 1)"
)


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, kind, value): the whole text's digest (two records of three), the author's, and source and length."""
    rec = records(spark, sf_dir)
    pmid = rec.where("rec_id % 3 <> 0").select("rec_id", F.lit("pmid").alias("kind"), F.md5("text").alias("value"))
    eid = F.concat_ws("-", "journal", F.length("text").cast("string"))
    return pmid.union(rec.select("rec_id", F.lit("doi"), F.md5("author"))).union(rec.where("journal IS NOT NULL AND text IS NOT NULL").select("rec_id", F.lit("eid"), eid))


@query("l1_guard", f"WITH {_GUARDED} SELECT a, b, verdict FROM ver")
def l1_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.guarded_links(records(spark, sf_dir), identifiers(spark, sf_dir), full=False)


@query("l1_components", f"WITH RECURSIVE {_GUARDED}, {_MERGED} SELECT node AS rec_id, CASE WHEN root IN (SELECT root FROM bad) THEN node ELSE root END AS canonical FROM c")
def l1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.merged_records(records(spark, sf_dir), identifiers(spark, sf_dir), full=False)[0]


@query("l1_refused", f"WITH RECURSIVE {_GUARDED}, {_MERGED} SELECT root, kind, n_values FROM bad")
def l1_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.merged_records(records(spark, sf_dir), identifiers(spark, sf_dir), full=False)[1]


_MOVES = "mv AS (SELECT c_custkey AS rec_id, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 17 = 1 THEN c_custkey WHEN c_custkey % 4 = 3 THEN c_custkey - 3 ELSE c_custkey + 1 END AS merged_into FROM customer)"


@query(
    "canonical_map",
    f"WITH RECURSIVE {_MOVES}, ok AS (SELECT rec_id, CASE WHEN merged_into IN (SELECT rec_id FROM mv) THEN merged_into END AS t FROM mv), f AS (SELECT rec_id, rec_id AS cur, 0 AS n FROM ok UNION ALL SELECT f.rec_id, ok.t, n + 1 FROM f JOIN ok ON ok.rec_id = f.cur WHERE ok.t IS NOT NULL AND ok.t <> f.cur AND n < 10) "
    "SELECT rec_id, max_by(cur, n) AS canonical FROM f GROUP BY rec_id",
)
def canonical_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    to = F.when(k % 4 == 0, None).when(k % 17 == 1, k).when(k % 4 == 3, k - 3).otherwise(k + 1)
    moves = table(spark, sf_dir, "customer").select(k.alias("rec_id"), to.alias("merged_into"))
    known = moves.join(moves.select(F.col("rec_id").alias("merged_into")), "merged_into", "left_semi").where("rec_id <> merged_into")
    return linkage.canonical_map(moves.select("rec_id").join(known.select("rec_id", "merged_into"), "rec_id", "left"))


@query("effective_origins", "WITH c AS (SELECT text, min(doc_id) AS canonical, list_distinct(list(source)) AS o FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY text) SELECT canonical, array_to_string(list_sort(o), ',') AS origins FROM c")
def effective_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    key = d.groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("canonical"))
    canonical = d.select(F.col("doc_id").alias("rec_id"), F.md5("text").alias("key")).join(key, "key").select("rec_id", "canonical")
    found = linkage.effective_origins(d.select(F.col("doc_id").alias("rec_id"), F.array("source").alias("origins")), canonical)
    return found.select("canonical", F.array_join("origins", ",").alias("origins"))


@query(
    "hit_groups",
    f"WITH {_REC}, g AS (SELECT *, min(rec_id) OVER (PARTITION BY md5(text)) AS hit_group, CASE journal WHEN 'src2' THEN 1 WHEN 'src1' THEN 2 ELSE 99 END AS k, CASE WHEN rec_id % 4 = 0 THEN NULL ELSE title END AS tt FROM rec WHERE text IS NOT NULL) "
    "SELECT hit_group, array_to_string(list_sort(list_distinct(list(journal))), ',') AS sources, arg_min(tt, (k, rec_id)) FILTER (tt IS NOT NULL) AS title, arg_min(year, (k, rec_id)) AS year FROM g GROUP BY hit_group",
)
def hit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir).where("text IS NOT NULL")
    hits = rec.select("rec_id", F.col("journal").alias("source"), F.when(F.col("rec_id") % 4 != 0, F.col("title")).alias("title"), "year")
    return linkage.hit_groups(hits, rec.select("rec_id", F.lit("md5").alias("kind"), F.md5("text").alias("value")), {"src2": 1, "src1": 2})


# Blocks and similar titles --------------------------------------------------------------------------------------------

_SIG = (
    f"{_REC}, rn AS (SELECT rec_id, coalesce({N.norm_title_sql('CASE WHEN rec_id % 37 = 0 THEN NULL ELSE title END')}, '') AS t, coalesce(replace({_AUTHOR}, ' ', ''), '') AS au, "
    f"replace({N.plain_sql('journal')}, ' ', '') AS j, year FROM rec), sg AS (SELECT *, list_distinct(string_split(t, ' ')) AS w FROM (SELECT min(rec_id) AS rep, t, au, year, min(j) AS j, count(*) AS n FROM rn GROUP BY t, au, year))"
)


def bibliography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``signatures`` of the records; one title in 37 is missing."""
    rec = records(spark, sf_dir)
    return linkage.signatures(rec.withColumn("title", F.when(F.col("rec_id") % 37 != 0, F.col("title"))))


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first table of ``bibliography``, written once for queries that read it many times."""
    return stored(bibliography(spark, sf_dir)[0], "representatives")


@query("l2_members", f"WITH {_SIG} SELECT rec_id, rep FROM rn JOIN sg ON rn.t = sg.t AND rn.au = sg.au AND rn.year IS NOT DISTINCT FROM sg.year")
def l2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bibliography(spark, sf_dir)[1]


_BLK = (
    "tk0 AS (SELECT rep, unnest(list_filter(list_distinct(string_split(t, ' ')), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$'))) AS token FROM sg), "
    "tk AS (SELECT *, count(*) OVER (PARTITION BY token) AS df, count(*) OVER (PARTITION BY rep) AS nt FROM tk0), ok AS (SELECT * FROM tk WHERE df <= greatest(50, (SELECT count(*) FROM sg) / 10.0)), "
    "bt AS (SELECT x.rep AS a, y.rep AS b, count(*) AS shared, false AS same FROM ok x JOIN ok y ON x.token = y.token AND x.rep < y.rep GROUP BY x.rep, y.rep HAVING count(*) >= 2 OR min(least(x.nt, y.nt)) <= 2), "
    "ba AS (SELECT x.rep AS a, y.rep AS b, 0 AS shared, true AS same FROM sg x JOIN sg y ON x.au = y.au AND x.au <> '' AND x.rep < y.rep)"
)


@query("l2_block", f"WITH {_SIG}, {_BLK} SELECT a, b, max(shared)::BIGINT AS shared, bool_or(same) AS same_author FROM (SELECT * FROM bt UNION ALL SELECT * FROM ba) GROUP BY a, b")
def l2_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.blocked_pairs(representatives(spark, sf_dir))


_PAIRS = (
    f"pr AS (SELECT x.rep AS a, y.rep AS b, {_SIM} AS s, x.au = y.au AND x.au <> '' AS au, abs(x.year - y.year) AS dy, coalesce(x.j = y.j AND x.j <> '', false) AS jn FROM sg x JOIN sg y ON x.rep < y.rep "
    "WHERE (x.au = y.au AND x.au <> '') OR abs(x.year - y.year) <= 1)"
)


@query(
    "l2_classify",
    f"WITH {_SIG}, {_PAIRS} SELECT a, b, round(s, 6) + 0.0 AS similarity, round(CASE WHEN s IS NOT NULL THEN least(1.0, greatest(0.0, s + CASE WHEN jn THEN 0.03 ELSE 0 END - 0.05 * coalesce(dy, 0))) END, 6) + 0.0 AS score, "
    "CASE WHEN s IS NOT NULL AND s >= 0.9 AND au AND dy <= 1 THEN 'probable' ELSE 'possible' END AS class FROM pr WHERE s >= 0.8 OR (s IS NULL AND au AND dy = 0)",
)
def l2_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linkage.classified(representatives(spark, sf_dir), full=False))


@query("l1_guard_ratio")
def l1_guard_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l1_guard`` with the sequence ratio, which SQL lacks."""
    return linkage.guarded_links(records(spark, sf_dir), identifiers(spark, sf_dir))


@query("l2_ratio")
def l2_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l2_classify`` with the sequence ratio."""
    return rounded(linkage.classified(representatives(spark, sf_dir)))


# Groups of reports ----------------------------------------------------------------------------------------------------

_ITEMS = "it AS (SELECT DISTINCT s_nationkey AS review, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_orderkey // 4 * 10 + s_nationkey % 3 END AS group_key, l_orderkey AS rec FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review, group_key, rec): orders that suppliers of a nation serve, headed by fours of them."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    key = F.when(F.col("l_linenumber") % 3 != 0, F.expr("l_orderkey div 4 * 10 + s_nationkey % 3"))
    return lines.select(F.col("s_nationkey").alias("review"), key.alias("group_key"), F.col("l_orderkey").alias("rec")).distinct()


@query("l3_groups", f"WITH {_ITEMS} SELECT review, group_key, array_to_string(list_sort(list(DISTINCT rec)), ',') AS members, count(DISTINCT rec) AS n FROM it WHERE group_key IS NOT NULL GROUP BY review, group_key HAVING count(DISTINCT rec) >= 2")
def l3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.review_groups(review_items(spark, sf_dir))


_SPLIT = "o AS (SELECT DISTINCT o_custkey % 50 AS rec, o_orderstatus AS review, CASE WHEN o_orderstatus = 'O' THEN o_custkey % 50 ELSE o_custkey % 5 END AS group_key FROM orders)"


@query("l3_disagreeing", f"WITH {_SPLIT} SELECT x.review, x.group_key, y.review AS other FROM o x JOIN o y ON x.rec = y.rec AND x.review <> y.review GROUP BY ALL HAVING count(DISTINCT y.group_key) >= 2")
def l3_disagreeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 50
    items = table(spark, sf_dir, "orders").select(k.alias("rec"), F.col("o_orderstatus").alias("review"), F.when(F.col("o_orderstatus") == "O", k).otherwise(F.col("o_custkey") % 5).alias("group_key"))
    return linkage.splitting_reviews(items)


_MENTION = "mt AS (SELECT DISTINCT l_partkey AS registry, l_orderkey AS rec, CASE l_linenumber WHEN 1 THEN 'strong' WHEN 2 THEN 'confirming' WHEN 3 THEN 'review' ELSE 'weak' END AS strength FROM lineitem)"


@query(
    "l4_registry",
    f"WITH {_MENTION}, g AS (SELECT registry, list(DISTINCT rec) FILTER (strength = 'strong') AS s, list(DISTINCT rec) FILTER (strength IN ('strong', 'confirming')) AS sc, list(DISTINCT rec) FILTER (strength IN ('strong', 'confirming', 'review')) AS scr, list(DISTINCT rec) AS al, count(*) FILTER (strength = 'review') AS nr FROM mt GROUP BY registry), "
    "k AS (SELECT *, CASE WHEN coalesce(len(s), 0) >= 1 AND len(sc) >= 2 THEN 'probable' WHEN len(scr) >= 2 AND (coalesce(len(s), 0) >= 1 OR nr >= 1) THEN 'possible' WHEN coalesce(len(s), 0) >= 1 AND len(al) >= 2 THEN 'hint' END AS certainty FROM g) "
    "SELECT registry, array_to_string(list_sort(CASE certainty WHEN 'probable' THEN sc WHEN 'possible' THEN scr ELSE al END), ',') AS members, certainty FROM k WHERE certainty IS NOT NULL",
)
def l4_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    strength = F.when(n == 1, "strong").when(n == 2, "confirming").when(n == 3, "review").otherwise("weak")
    return linkage.registry_groups(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("registry"), F.col("l_orderkey").alias("rec"), strength.alias("strength")).distinct())


@query("l3_errata", "WITH e AS (SELECT o_orderkey AS rec_id, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey * 2 - 1 END AS parent FROM orders) SELECT e.rec_id AS erratum, parent FROM e WHERE parent IN (SELECT o_orderkey FROM orders)")
def l3_errata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return linkage.errata(table(spark, sf_dir, "orders").select(k.alias("rec_id"), F.when(k % 9 == 0, k * 2 - 1).alias("erratum_of")))


@query(
    "l4_series",
    f"WITH {_SIG}, z AS (SELECT x.rep AS a, y.rep AS b, {_SIM} AS s, {_JAC} AS jac, x.au = y.au AS au, abs(x.year - y.year) AS dy, x.t = y.t AS eq, "
    "(x.au = y.au OR abs(x.year - y.year) <= 1) AS near FROM sg x JOIN sg y ON x.rep < y.rep AND x.t <> '' AND y.t <> '' AND x.au <> '' AND y.au <> ''), "
    "r AS (SELECT a, b, CASE WHEN au AND dy <= 5 AND jac >= 0.4 THEN 'author' WHEN s >= 0.85 AND dy >= 2 AND NOT eq THEN 'title' END AS rule, s >= 0.8 AND near AS known FROM z) SELECT a, b, rule FROM r WHERE rule IS NOT NULL AND NOT known",
)
def l4_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = representatives(spark, sf_dir)
    similar = stored(linkage.similar_titles(reps), "similar-titles")  # both read them
    return linkage.report_series(reps, linkage.classified(reps, False, similar), full=False, similar=similar)


@query("l4_ratio")
def l4_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l4_series`` with the sequence ratio."""
    reps = representatives(spark, sf_dir)
    similar = stored(linkage.similar_titles(reps, linkage.SERIES), "similar-titles")  # both read them
    return linkage.report_series(reps, linkage.classified(reps, similar=similar), similar=similar)


_PROP = "pp AS (SELECT l_partkey % 100 AS review, (l_suppkey % 20) || '-' || (l_orderkey % 3) AS signature FROM lineitem)"


@query("same_signature", f"WITH {_PROP} SELECT signature, array_to_string(list_sort(list(DISTINCT review)), ',') AS reviews, count(DISTINCT review) AS n FROM pp GROUP BY signature")
def same_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("review"), F.concat_ws("-", (F.col("l_suppkey") % 20).cast("string"), (F.col("l_orderkey") % 3).cast("string")).alias("signature"))
    return linkage.same_signature(own)


@query("stable_ids", "WITH p AS (SELECT c_name AS signature, c_custkey AS id FROM customer WHERE c_nationkey < 10), n AS (SELECT c_name AS signature, c_acctbal FROM customer WHERE c_nationkey >= 10) SELECT signature, id FROM p WHERE signature IN (SELECT c_name FROM customer WHERE c_nationkey >= 5) UNION ALL SELECT signature, (SELECT max(id) FROM p) + row_number() OVER (ORDER BY c_acctbal, signature) FROM n")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("signature"), F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey")
    prior = c.where("c_nationkey < 10").select("signature", "id")
    kept = linkage.stable_ids(c.select("signature", "c_acctbal"), prior, "c_acctbal")
    return kept.join(c.where("c_nationkey >= 5").select("signature"), "signature", "left_semi")


_MEMBERS = "mb AS (SELECT DISTINCT l_partkey // 10 AS study, l_orderkey % 300 AS rec FROM lineitem)"


@query(
    "study_labels",
    f"WITH {_MEMBERS}, pr AS (SELECT c_custkey AS rec, c_nationkey AS id FROM customer), cl AS (SELECT study, id, count(*) AS n FROM mb JOIN pr USING (rec) GROUP BY ALL), b AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, study) = 1), o AS (SELECT study, min(id) AS id FROM b GROUP BY study) "
    "SELECT study, n_reports, id FROM (SELECT study, count(DISTINCT rec) AS n_reports FROM mb GROUP BY study) LEFT JOIN o USING (study)",
)
def study_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(F.expr("l_partkey div 10").alias("study"), (F.col("l_orderkey") % 300).alias("rec")).distinct()
    return linkage.study_labels(members, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rec"), F.col("c_nationkey").alias("id")))


@query("membership_problems", "WITH mb AS (SELECT o_custkey AS rec, o_orderstatus AS study FROM orders) SELECT rec, 'several' AS problem FROM mb GROUP BY rec HAVING count(DISTINCT study) > 1 UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT rec FROM mb)")
def membership_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rec"), F.col("o_orderstatus").alias("study"))
    return linkage.membership_problems(members, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rec")))


# Overlap and merged data ----------------------------------------------------------------------------------------------


@query("overlap_weighted", f"WITH {_INC}, t AS (SELECT study, count(*) AS times FROM inc GROUP BY study), w AS (SELECT times, sqrt(p_size) AS w FROM t JOIN part ON p_partkey = study) SELECT count(*) AS r, (SELECT count(DISTINCT review) FROM inc) AS c, round(100 * sum(w * (times - 1)) / (sum(w) * ((SELECT count(DISTINCT review) FROM inc) - 1)), 6) + 0.0 AS wcca FROM w")
def overlap_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linkage.weighted_overlap(incidence(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("study"), F.col("p_size").alias("n"))))


@query("overlap_matrix", f"WITH {_INC} SELECT study, " + ", ".join(f"max((review = {v})::INT) AS r{v}" for v in range(5)) + " FROM inc GROUP BY study")
def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.overlap_matrix(incidence(spark, sf_dir), list(range(5)))


_SEC = (
    "v AS (SELECT l_orderkey AS study, s_nationkey AS review, 'discount' AS field, l_returnflag AS outcome, l_linestatus AS arm, max(l_discount) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), "
    "d AS (SELECT DISTINCT study, review, field, CASE WHEN study % 2 = 0 THEN outcome END AS outcome, CASE WHEN study % 2 = 0 THEN arm END AS arm, 'use ' || study % 7 AS decision FROM v WHERE study % 3 = 0 AND (study % 2 = 1 OR outcome = 'R'))"
)


@query("decided_values", f"WITH {_SEC} SELECT v.review, v.study, v.field, v.outcome, v.arm, v.value, coalesce(x.decision, y.decision) AS decision FROM v LEFT JOIN d x ON x.study = v.study AND x.review = v.review AND x.field = v.field AND x.outcome = v.outcome AND x.arm = v.arm LEFT JOIN d y ON y.study = v.study AND y.review = v.review AND y.field = v.field AND y.outcome IS NULL")
def decided_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    keys = [F.col("l_orderkey").alias("study"), F.col("s_nationkey").alias("review"), F.lit("discount").alias("field"), F.col("l_returnflag").alias("outcome"), F.col("l_linestatus").alias("arm")]
    dealt = lines.select(*keys, "l_discount").repartition(linkage.parts_for(table(spark, sf_dir, "lineitem")), "study")
    values = stored(dealt.groupBy("study", "review", "field", "outcome", "arm").agg(F.max("l_discount").alias("value")), "values")
    own = values.where("study % 3 = 0 AND (study % 2 = 1 OR outcome = 'R')")
    decisions = own.select("study", "review", "field", F.expr("CASE WHEN study % 2 = 0 THEN outcome END").alias("outcome"), F.expr("CASE WHEN study % 2 = 0 THEN arm END").alias("arm"), F.concat(F.lit("use "), F.col("study") % 7).alias("decision")).distinct()
    return linkage.decided_values(values, decisions)


_FINAL = (
    "rp AS (SELECT o_custkey AS study, o_orderkey AS rec, CASE o_orderstatus WHEN 'F' THEN 'included' WHEN 'P' THEN 'pending' ELSE 'excluded' END AS status, o_orderkey % 50 = 0 AS retracted, o_orderkey % 20 = 0 AS preprint FROM orders), "
    "cd AS (SELECT DISTINCT l_orderkey AS rec, l_suppkey AS review FROM lineitem WHERE l_discount > 0.05 AND l_tax > 0.02)"
)


@query(
    "merged_studies",
    f"WITH {_FINAL}, n AS (SELECT study, count(DISTINCT review) AS n_reviews FROM rp JOIN cd USING (rec) GROUP BY study) SELECT study, CASE WHEN bool_or(status = 'included') THEN 'included' WHEN bool_or(status = 'pending') THEN 'pending' ELSE 'excluded' END AS status, count(*) AS n_reports, any_value(n_reviews) AS n_reviews, "
    "concat_ws(',', CASE WHEN bool_or(preprint) THEN 'preprint' END, CASE WHEN bool_or(retracted) THEN 'retracted' END) AS flags FROM rp JOIN n USING (study) GROUP BY study",
)
def merged_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    reports = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("study"), k.alias("rec"), F.when(s == "F", "included").when(s == "P", "pending").otherwise("excluded").alias("status"), (k % 50 == 0).alias("retracted"), (k % 20 == 0).alias("preprint"))
    candidates = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_suppkey").alias("review"), (F.col("l_discount") > 0.05).alias("selected"), (F.col("l_tax") > 0.02).alias("has_evidence"))
    return linkage.merged_studies(reports, candidates)
