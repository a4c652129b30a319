"""Queries of studies under decisions, citation chasing, anchored chains, nested conditions and search by places, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import conditions, graphs, screening, search
from evidra.sources.shared import table

from .catalog import query

# Studies --------------------------------------------------------------------------------------------------------------

_LINKS = (
    "lk AS (SELECT a, b, strength FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, 6 - substr(o_orderpriority, 1, 1)::INT AS strength FROM orders) WHERE b IS NOT NULL), "
    "ap AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey HAVING count(*) > 1), s0 AS (SELECT o_orderkey AS rec, o_orderkey AS study FROM orders)"
)


def _levels_sql() -> str:
    out = [_LINKS]
    for i, strength in enumerate((5, 4, 3, 2, 1)):
        out += [
            f"v{i} AS (SELECT x.study AS a, y.study AS b FROM lk JOIN s{i} x ON x.rec = lk.a JOIN s{i} y ON y.rec = lk.b WHERE strength = {strength} AND x.study <> y.study)",
            f"w{i} AS (SELECT DISTINCT study AS node, study AS root FROM s{i} UNION SELECT e.b, w.root FROM w{i} w JOIN (SELECT a, b FROM v{i} UNION SELECT b, a FROM v{i}) e ON w.node = e.a)",
            f"c{i} AS (SELECT node, min(root) AS root FROM w{i} GROUP BY node)",
            f"t{i} AS (SELECT rec, study, root FROM s{i} JOIN c{i} ON node = study)",
            f"bad{i} AS (SELECT DISTINCT x.root FROM ap JOIN t{i} x ON x.rec = ap.a JOIN t{i} y ON y.rec = ap.b WHERE x.root = y.root)",
            f"s{i + 1} AS (SELECT rec, CASE WHEN root IN (SELECT root FROM bad{i}) THEN study ELSE root END AS study FROM t{i})",
            f"r{i} AS (SELECT least(a, b) AS study_a, greatest(a, b) AS study_b, {strength} AS strength, count(*) AS links FROM v{i} JOIN c{i} ON node = a WHERE root IN (SELECT root FROM bad{i}) GROUP BY ALL)",
        ]
    return "WITH RECURSIVE " + ", ".join(out)


def order_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, links, apart): orders as reports; a customer's next order is linked by its priority, and the first and the last order
    of two customers in three are known to be different studies."""
    o = table(spark, sf_dir, "orders")
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    links = o.select(F.col("o_orderkey").alias("a"), following.alias("b"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("strength")).where("b IS NOT NULL")
    apart = o.where("o_custkey % 3 <> 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).where("a <> b").select("a", "b")
    return o.select(F.col("o_orderkey").alias("rec")), links, apart


@query("studies_decided", _levels_sql() + " SELECT rec, study FROM s5")
def studies_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.constrained_studies(*order_links(spark, sf_dir))[0]


@query("studies_refused", _levels_sql() + " " + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(5)))
def studies_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.constrained_studies(*order_links(spark, sf_dir))[1]


# Citations ------------------------------------------------------------------------------------------------------------

_CITES = "ci AS (SELECT x.l_partkey AS citing, y.l_partkey AS cited FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = 1 AND y.l_linenumber = 2)"


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(citing, cited): the part of an order's first line cites that of its second."""
    lines = table(spark, sf_dir, "lineitem")
    first = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("citing"))
    return first.join(lines.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("cited")), "l_orderkey").select("citing", "cited")


def _reach_sql(edges: str) -> str:
    return f"WITH RECURSIVE {_CITES}, e AS ({edges}), r AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_size = 1 UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.node WHERE depth < 40) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node"


@query("citations_backward", _reach_sql("SELECT DISTINCT citing AS a, cited AS b FROM ci WHERE citing <> cited"))
def citations_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.chased(citations(spark, sf_dir), table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")), "backward")


@query("citations_both", _reach_sql("SELECT citing AS a, cited AS b FROM ci WHERE citing <> cited UNION SELECT cited, citing FROM ci WHERE citing <> cited"))
def citations_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.chased(citations(spark, sf_dir), table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")))


# Chains ---------------------------------------------------------------------------------------------------------------

_CHAIN = (
    "c0 AS (SELECT user_id AS log, event_id, sha256(event_id || '|' || user_id || '|' || event_type) AS d, row_number() OVER u AS seq, lag(sha256(event_id || '|' || user_id || '|' || event_type)) OVER u AS prev FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "ch AS (SELECT log, seq, prev, CASE WHEN event_id % 97 = 0 THEN sha256('changed') ELSE d END AS digest FROM c0 WHERE event_id % 131 <> 0), "
    "rw AS (SELECT x.*, CASE WHEN x.seq = 1 THEN x.prev IS NOT NULL ELSE NOT coalesce(x.prev = y.digest, false) END AS fails FROM ch x LEFT JOIN ch y ON x.log = y.log AND y.seq = x.seq - 1), "
    "sg AS (SELECT log, (seq - 1) // 8 AS segment, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, min(seq) FILTER (fails) AS broken, sha256(string_agg(digest, chr(10) ORDER BY seq)) AS digest FROM rw GROUP BY ALL)"
)


def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log, seq, prev, digest): the events of a user as a log; one in 97 was changed and one in 131 is gone."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    chain = screening.chained(table(spark, sf_dir, "events"), ["ts", "event_id"], "user_id", ["event_id", "user_id", "event_type"]).withColumn("seq", F.row_number().over(order).cast("long"))
    changed = F.when(F.col("event_id") % 97 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.col("digest"))
    return chain.where("event_id % 131 <> 0").select(F.col("user_id").alias("log"), "seq", "prev", changed.alias("digest"))


@query("chain_segments", f"WITH {_CHAIN} SELECT * FROM sg")
def chain_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.chain_segments(event_chain(spark, sf_dir), 8)


@query(
    "chain_anchors",
    f"WITH {_CHAIN}, st AS (SELECT log, least(min(broken), CASE WHEN min(first_seq) > 1 THEN 1 END) AS broken FROM sg GROUP BY log), an AS (SELECT log, seq, CASE WHEN seq % 5 = 0 THEN 'none' ELSE d END AS digest FROM c0 WHERE event_id % 3 = 0) "
    "SELECT an.log, an.seq, CASE WHEN ch.digest = an.digest AND (broken IS NULL OR broken > an.seq) THEN 'confirmed' ELSE 'refused' END AS status FROM an LEFT JOIN ch USING (log, seq) LEFT JOIN st ON st.log = an.log",
)
def chain_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the digests of one event in three before any change; one in five is of no event."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = screening.chained(table(spark, sf_dir, "events"), ["ts", "event_id"], "user_id", ["event_id", "user_id", "event_type"]).withColumn("seq", F.row_number().over(order).cast("long"))
    anchors = before.where("event_id % 3 = 0").select(F.col("user_id").alias("log"), "seq", F.when(F.col("seq") % 5 == 0, "none").otherwise(F.col("digest")).alias("digest"))
    chain = event_chain(spark, sf_dir)
    return graphs.confirmed_anchors(chain, graphs.chain_segments(chain, 8), anchors)


# Conditions -----------------------------------------------------------------------------------------------------------

#: (condition, node, parent, kind, question, wanted)
_NODES = [
    ("c1", 1, None, "all", None, None), ("c1", 2, 1, "answer", "1", ["F", "O"]), ("c1", 3, 1, "any", None, None), ("c1", 4, 3, "answer", "2", ["P"]), ("c1", 5, 3, "none", None, None), ("c1", 6, 5, "answer", "3", ["O"]), ("c1", 7, 1, "answered", "4", None),
    ("c2", 1, None, "none", None, None), ("c2", 2, 1, "answer", "5", ["F"]), ("c2", 3, 1, "all", None, None), ("c2", 4, 3, "answer", "1", ["O"]), ("c2", 5, 3, "answer", "2", ["O"]), ("c3", 1, None, "answer", "3", ["F"]),
]


@query(
    "conditions_held",
    "WITH a AS (SELECT o_custkey AS unit, " + ", ".join(f"max(o_orderstatus) FILTER (o_orderpriority LIKE '{q}%') AS q{q}" for q in range(1, 6)) + " FROM orders GROUP BY o_custkey), "
    "u AS (SELECT c_custkey AS unit, a.* EXCLUDE (unit) FROM customer LEFT JOIN a ON a.unit = c_custkey) "
    "SELECT unit, 'c1' AS condition, q1 IN ('F', 'O') AND (q2 = 'P' OR NOT (q3 = 'O')) AND q4 IS NOT NULL AS value FROM u UNION ALL SELECT unit, 'c2', NOT (q5 = 'F' OR (q1 = 'O' AND q2 = 'O')) FROM u UNION ALL SELECT unit, 'c3', q3 = 'F' FROM u",
)
def conditions_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as units, and the greatest status of their orders of a priority as the answer to a question."""
    nodes = spark.createDataFrame(_NODES, "condition string, node int, parent int, kind string, question string, wanted array<string>")
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.substring("o_orderpriority", 1, 1).alias("question"), F.col("o_orderstatus").alias("answer"))
    return conditions.evaluated(nodes, answers, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit")))


# Search by places -----------------------------------------------------------------------------------------------------

_WORDS = f"wd AS (SELECT chunk_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM (SELECT doc_id AS chunk_id, list_filter(string_split({T.folded_sql('text')}, ' '), lambda x: x <> '') AS w FROM documents))"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@query("search_near", f"WITH {_WORDS}, x AS (SELECT * FROM wd WHERE term = 'the'), y AS (SELECT * FROM wd WHERE term = 'of') SELECT x.chunk_id, count(DISTINCT x.place) AS n FROM x JOIN y ON x.chunk_id = y.chunk_id AND x.place <> y.place AND abs(x.place - y.place) <= 3 GROUP BY x.chunk_id")
def search_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.near(_chunks(spark, sf_dir), "the", "of", 3)


@query("search_ordered", f"WITH {_WORDS}, x AS (SELECT * FROM wd WHERE term = 'the'), y AS (SELECT * FROM wd WHERE term = 'of') SELECT x.chunk_id, count(DISTINCT x.place) AS n FROM x JOIN y ON x.chunk_id = y.chunk_id AND y.place - x.place BETWEEN 1 AND 5 GROUP BY x.chunk_id")
def search_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.near(_chunks(spark, sf_dir), "the", "of", 5, ordered=True)


@query("search_combined", f"WITH {_WORDS} SELECT chunk_id FROM wd GROUP BY chunk_id HAVING bool_or(term = 'the') AND (bool_or(term = 'of') OR bool_or(term = 'and')) AND NOT bool_or(term = 'is')")
def search_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.combined(_chunks(spark, sf_dir), ["the"], ["of", "and"], ["is"])
