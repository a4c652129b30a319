"""Connected components of a table of links, by minimum-label propagation with pointer jumping or by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.sources.shared import forget, stored

#: Rows of one key that meet in one task; the number of keys above it that may be broadcast.
#: Rows of a key from which a left join deals it, and of how many rows one is counted to find such keys.
SPREAD, MOST_HOT = 256, 100_000
DEALT, COUNTED = 1024, 64


def dealt_join(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """The inner join of ``many`` with ``one`` (a row for each key). A key of more than SPREAD rows of ``many`` is dealt over
    several tasks by the hash of ``by``, and its row of ``one`` goes to each of them."""
    hot = many.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("__copies")).where("__copies > 1")
    n = hot.count()
    if not n:
        return many.join(one, key)
    hot = F.broadcast(hot) if n <= MOST_HOT else hot
    copies = F.coalesce("__copies", F.lit(1))
    left = many.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), copies).cast("int")).drop("__copies")
    right = one.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return left.join(right, [key, "__part"]).drop("__part")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): every node that has a link, and the smallest node of its component.

    Each round takes the least label among a node's neighbours and then the label of that label, so a chain of length n
    needs about log n rounds. Labels are written to the shared folder after each round. A node of very many links is dealt
    over tasks. No link gives no row; loops and repeated links change nothing; rows with a null end are no links.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    edges = stored(ends.union(ends.select("other", "node")).distinct(), "edges")
    labels = stored(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = dealt_join(edges, labels.select(F.col("node").alias("other"), "root"), "other", "node").groupBy("node").agg(F.min("root").alias("near"))
        hop = stored(labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("via")), "hops")
        onward = labels.select(F.col("node").alias("via"), F.col("root").alias("onward"))
        after = stored(dealt_join(hop, onward, "via", "node").select("node", "was", F.least("via", "onward").alias("root")), "labels")
        forget(labels, hop)
        labels = after.select("node", "root")
        labels._stored_at = after._stored_at
        if not after.where(F.col("was") != F.col("root")).head(1):
            forget(edges)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def frequent(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame | None:
    """(__key, __copies) of keys that stand in DEALT rows and more, found by counting one row in COUNTED, or None. ``ends`` are pairs of
    a column and the one by whose hash its rows are counted and dealt."""
    counts = None
    for key, by in ends:
        own = rows.where(F.pmod(F.xxhash64(by), F.lit(COUNTED)) == 0).select(F.col(key).alias("__key"))
        counts = own if counts is None else counts.union(own)
    counts = counts.groupBy("__key").agg(F.ceil(F.count(F.lit(1)) * COUNTED / DEALT).cast("int").alias("__copies"))
    hot = counts.where("__copies > 1").orderBy(F.desc("__copies")).limit(MOST_HOT).collect()
    return rows.sparkSession.createDataFrame(hot, counts.schema) if hot else None


def dealt_left(many: DataFrame, one: DataFrame, key: str, by: str, hot: DataFrame | None) -> DataFrame:
    """The left join of ``many`` with ``one`` (a row for each key at most); rows of the keys of ``hot`` are dealt over several tasks by
    the hash of ``by``."""
    if hot is None:
        return many.join(one, key, "left")
    few, copies = F.broadcast(hot.withColumnRenamed("__key", key)), F.coalesce("__copies", F.lit(1))
    left = many.join(few, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), copies).cast("int")).drop("__copies")
    right = one.join(few, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return left.join(right, [key, "__part"], "left").drop("__part")


def renamed(rows: DataFrame, names: DataFrame, column: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` with the ends ``a`` and ``b`` replaced by ``column`` of ``names`` (a row for each node at most); an end without a name
    stays. ``hot``: the frequent ends."""
    for end, other in (("a", "b"), ("b", "a")):
        rows = dealt_left(rows, names.select(F.col("node").alias(end), F.col(column).alias("__name")), end, other, hot)
        rows = rows.withColumn(end, F.coalesce("__name", end)).drop("__name")
    return rows


def contracted(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """As ``components`` of links (a, b), written, by contraction: each round every node joins its neighbour that is first in an order
    drawn anew for the round, and only links between nodes that are still apart go on. So about half of the nodes of long chains
    and all of most small components leave in a round, and what is written and shuffled stays in proportion to the links."""
    edges = stored(links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "edges")
    steps = []
    for turn in range(max_rounds):
        hot = frequent(edges, ("a", "b"), ("b", "a"))
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        place = lambda c: F.struct(F.hash(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        first = ends.groupBy("node").agg(F.min(place("other")).alias("first"))
        steps.append((stored(first.select("node", F.least("first", place("node"))["n"].alias("up")), "steps"), hot))
        apart = renamed(edges, steps[-1][0], "up", hot).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        after = stored(apart, "edges")
        forget(edges)
        edges = after
        if not edges.head(1):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = None
    for step, hot in reversed(steps):  # what a node joined went on to the top that it has by now; as many joined it as it had links at most
        onward = tops if tops is None else tops.select(F.col("node").alias("up"), F.col("up").alias("top"))
        tops = step if tops is None else dealt_left(step, onward, "up", "node", hot).select("node", F.coalesce("top", "up").alias("up"))
    tops = stored(tops, "tops")
    forget(edges, *[step for step, _ in steps])
    least = tops.groupBy("up").agg(F.min("node").alias("root"))
    out = stored(dealt_left(tops, least, "up", "node", frequent(tops, ("up", "node"))).select("node", "root"), "labels")
    forget(tops)
    return out
