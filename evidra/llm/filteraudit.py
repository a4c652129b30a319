"""Interaction audit of document filters: what each filter removes, and what it would remove in any other place of the chain.

A document's outcome under all filters is one mask. Spark counts documents by part and mask (a mask cell); whatever an order
of the filters does follows from the cells. For each part the orders are visited by adjacent transpositions (each order
differs from the one before by one swap of neighbours), so a swap changes two steps only, and these are counted anew from the
cells. A filter's Shapley total grows along the walk: its present count times the number of orders for which it has stood.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Orders grow as the factorial: 8 filters have 40,320.
MOST_FILTERS = 8
WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions by filter: A under 100 words, B fewer than 80 in 100 words distinct, C more than 10 in 100 code
    points are A-Z, D holds one of ``#$%&*|``. ``text`` is not null."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": F.lit(100) * distinct.cast("long") < F.lit(80) * n.cast("long"),
        "C": F.lit(100) * capitals.cast("long") > F.lit(10) * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_of(failures: Sequence[Column]) -> Column:
    """The k-th bit says that the k-th filter fails the document; an unknown outcome fails nothing."""
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failures)), F.lit(0)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, ...) with good and toxic, whether any label of the id says so; a null id has no label."""
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    said = stored(said, "labels")  # read from files, so that a join with an id of very many rows can be split
    return docs.join(said, "doc_id", "left").fillna(False, ["good", "toxic"])


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Mask cells (part, mask, n, good, toxic) of ``docs`` under the filters A to E.

    E fails a document if a row of a smaller id has an identical text anywhere in the table; a null id is no smaller one and
    fails nothing. Copies meet by the digest of their text, and only as counts: rows of one id, text and part are one row of
    the shuffle, and the least id of a text is found among counted rows, so a group of copies of any size is spread.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    failures = text_failures(F.col("text"))
    masked = own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask_of(list(failures.values())).alias("mask"))
    rows = masked.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    key = ["digest", "part", "mask", "good", "toxic"]
    # Of a text, part and labels: all rows, and those of the least id.
    grouped = labelled(rows, labels).groupBy(*key).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("at_least"))
    first = grouped.groupBy("digest").agg(F.min("least").alias("first"))
    kept = F.when(F.col("least") == F.col("first"), F.col("at_least.n")).otherwise(0) + F.col("n_null")
    counted = grouped.join(first, "digest").select("part", "mask", "good", "toxic", F.col("n"), kept.alias("n_first"))
    duplicate = 1 << len(failures)
    cells = counted.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("n_first").alias("n")), F.struct((F.col("mask") + duplicate).alias("mask"), (F.col("n") - F.col("n_first")).alias("n")))).alias("cell"))
    cells = cells.select("part", F.col("cell.mask").alias("mask"), F.col("cell.n").alias("n"), "good", "toxic")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def transpositions(n: int) -> Iterator[int | None]:
    """The walk over all orders of ``n`` things from 0, 1, ..., n - 1 on: for each order the place whose neighbour to the right it
    is swapped with to come there (None for the first). Each thing moves through the others, back and forth, whenever all
    smaller movers are at rest."""
    order, heading = list(range(n)), [-1] * n
    yield None
    while True:
        moving = [(order[p], p) for p in range(n) if 0 <= p + heading[order[p]] < n and order[p + heading[order[p]]] < order[p]]
        if not moving:
            return
        thing, at = max(moving)
        to = at + heading[thing]
        order[at], order[to] = order[to], order[at]
        for larger in range(thing + 1, n):
            heading[larger] = -heading[larger]
        yield min(at, to)


def walk(cells: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """Orders visited, counts[order, step, (kept, removed, good lost, toxic lost)] and the Shapley totals by filter.
    ``cells`` is long[2 ** n, 3]: documents, good ones and toxic ones by mask."""
    masks = np.arange(1 << n)

    def surviving(filters: int) -> np.ndarray:
        return cells[(masks & filters) == 0].sum(axis=0)

    order = list(range(n))
    left = [surviving((1 << k) - 1) for k in range(n + 1)]  # documents before each step, and after the last
    orders, counts = [], []
    shapley, since = np.zeros(n, np.int64), [0] * n
    removed = [int(left[k][0] - left[k + 1][0]) for k in range(n)]  # by filter
    for number, at in enumerate(transpositions(n)):
        if at is not None:
            order[at], order[at + 1] = order[at + 1], order[at]
            left[at + 1] = surviving(sum(1 << f for f in order[: at + 1]))
            for step in (at, at + 1):
                f = order[step]
                shapley[f] += removed[f] * (number - since[f])
                removed[f], since[f] = int(left[step][0] - left[step + 1][0]), number
        orders.append(tuple(order))
        counts.append([[left[k + 1][0], *(left[k] - left[k + 1])] for k in range(n)])
    for f in range(n):
        shapley[f] += removed[f] * (len(orders) - since[f])
    return orders, np.array(counts, np.int64).reshape(len(orders), n, 4), shapley


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audited(cells: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step (``AUDIT``), from mask cells (part, mask, n, good, toxic).

    ``names`` has a letter for each bit of the mask. A part has 2 ** len(names) cells at most, so a part is one small row;
    all orders of at most ``MOST_FILTERS`` filters are visited. No cell, no row.
    """
    n = len(names)
    if not 1 <= n <= MOST_FILTERS or len(set(names)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of their own")

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = np.zeros((1 << n, 3), np.int64)
                for cell in row["cells"]:
                    table[cell["mask"]] += (cell["n"], cell["good"], cell["toxic"])
                orders, counts, shapley = walk(table, n)
                filters = np.array(orders).ravel()
                failing = np.array([table[(np.arange(1 << n) >> f) & 1 == 1, 0].sum() for f in range(n)])
                alone = table[1 << np.arange(n), 0]
                kept, removed, good, toxic = counts.reshape(-1, 4).T
                spelled = ["".join(names[f] for f in o) for o in orders]
                columns = [np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)), kept, removed, failing[filters] - removed, alone[filters], good, toxic, shapley[filters]]
                arrays = [pa.array([row["part"]] * filters.size, pa.string()), pa.array([o for o in spelled for _ in range(n)], pa.string()), *(pa.array(np.ascontiguousarray(c)) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in AUDIT.split(", ")])

    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(audit, AUDIT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over whole ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic).

    A null text is empty, a null lang the empty string; rows that repeat count as often as they stand there; several labels of
    one id count as one that says what any says. An empty table gives no rows. Other columns are not read.
    """
    return audited(document_cells(docs, labels))


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  map(['A', 'B', 'C', 'D', 'E'], [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)]) AS fails
  FROM w LEFT JOIN l USING (doc_id)),
cell AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS own, list_transform(range(1, step), lambda k: substr(filter_order, k, 1)) AS before FROM orders, range(1, 6) s(step)),
seen AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS failing, len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda b: fails[b])) AS n_failing FROM steps, cell),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (failing AND n_failing = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost FROM seen GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
