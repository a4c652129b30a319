"""Graphs of records: studies from links under decisions, citation chasing to the end, and chains of events with anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.sources.shared import forget, stored

from .components import contracted, dealt_join, dealt_left, frequent, renamed

#: Distinct strengths of links; events of one segment of a chain, and children of one node of its tree.
MOST_LEVELS, SEGMENT, FANOUT = 64, 1024, 64


def constrained_studies(records: DataFrame, links: DataFrame, apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rec, study), (study_a, study_b, strength, links)): records joined by ``links`` (a, b, strength), the strongest first, while no
    two records that ``apart`` (a, b) names come together.

    The links of one strength join all studies that they connect at once. Where that would bring two records together that are
    to stay apart, these are the weakest links between them, so none of that strength within what they connect joins; they are
    reported with the studies that they would have joined and their number. A study is named by its least record. Links and pairs
    with a null, a loop or a record that is not there are none.
    """
    known = records.select("rec").where("rec IS NOT NULL")
    is_known = lambda rows: rows.where("a <> b").join(known.withColumnRenamed("rec", "a"), "a", "left_semi").join(known.withColumnRenamed("rec", "b"), "b", "left_semi")
    own = stored(is_known(links.where("strength IS NOT NULL").select("a", "b", "strength")), "links")
    barred = stored(is_known(apart.select("a", "b")).distinct(), "apart")
    levels = sorted((r[0] for r in own.select("strength").distinct().limit(MOST_LEVELS + 1).collect()), reverse=True)
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"links of more than {MOST_LEVELS} strengths: round them first")
    refused, moves = [], []
    for strength in levels:
        # Links and pairs have the names of studies by now; only studies that a level joins are written, and only their names change.
        level = own.where((F.col("strength") == strength) & (F.col("a") != F.col("b"))).select("a", "b")
        joined = contracted(level)
        hot, hot_pairs = frequent(own, ("a", "b"), ("b", "a")), frequent(barred, ("a", "b"), ("b", "a"))
        # Two records to be kept apart stood in different studies before: in one now, they bar what joined them.
        bad = stored(renamed(barred, joined, "root", hot_pairs).where("a = b").select(F.col("a").alias("root")).distinct(), "barred")
        within = dealt_left(level, joined.withColumnRenamed("node", "a"), "a", "b", hot).join(bad, "root", "left_semi")
        ends = within.select(F.least("a", "b").alias("study_a"), F.greatest("a", "b").alias("study_b"))
        refused.append(stored(ends.groupBy("study_a", "study_b").agg(F.count(F.lit(1)).alias("links")).withColumn("strength", F.lit(strength)), "refused"))
        moves.append(stored(joined.where("node <> root").join(bad, "root", "left_anti").select("node", "root"), "moves"))
        if strength != levels[-1]:
            later, pairs = stored(renamed(own.where(F.col("strength") < strength), moves[-1], "root", hot), "links"), stored(renamed(barred, moves[-1], "root", hot_pairs), "apart")
            forget(own, barred)
            own, barred = later, pairs
        forget(joined, bad)
    # From the last level back, so that each table of moves is read once: where its studies went, and those that moved later only.
    final = None
    for move in reversed(moves):
        if final is not None:
            onward = final.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            move = stored(move.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root")).union(final), "moves")
        final = move
    labels = known.distinct()
    if final is None:
        labels = labels.select("rec", F.col("rec").alias("study"))
    else:
        labels = labels.join(final.withColumnRenamed("node", "rec"), "rec", "left").select("rec", F.coalesce("root", "rec").alias("study"))
    every = refused[0] if refused else own.select(F.col("a").alias("study_a"), F.col("b").alias("study_b"), F.lit(0).cast("long").alias("links"), "strength").limit(0)
    for more in refused[1:]:
        every = every.union(more)
    return labels, every.select("study_a", "study_b", "strength", "links")


def chased(citations: DataFrame, seeds: DataFrame, direction: str = "both", max_rounds: int = 1000) -> DataFrame:
    """(node, depth): everything that ``seeds`` (node) cite (backward), that cites them (forward), or both, over any number of steps
    of ``citations`` (citing, cited), with the least number of steps; seeds have none.

    Each round goes on from what the round before was the first to reach, so an edge is taken once a direction. A node of very
    many edges is dealt over tasks. Null ends and loops lead nowhere.
    """
    ends = citations.where("citing <> cited")
    sides = {"backward": [("citing", "cited")], "forward": [("cited", "citing")], "both": [("citing", "cited"), ("cited", "citing")]}[direction]
    edges = None
    for a, b in sides:
        own = ends.select(F.col(a).alias("node"), F.col(b).alias("next"))
        edges = own if edges is None else edges.union(own)
    edges = stored(edges.distinct(), "edges")
    front = stored(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "reached")
    reached, parts = front, [front]
    for depth in range(1, max_rounds + 1):
        found = dealt_join(edges, front.select("node"), "node", "next").select(F.col("next").alias("node")).distinct()
        front = stored(found.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if not front.head(1):
            forget(edges)
            return reached
        parts.append(front)
        reached = reached.union(front)
    raise RuntimeError(f"citations go on after {max_rounds} steps")


# Chains ---------------------------------------------------------------------------------------------------------------


def chain_segments(chain: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(log, segment, n, first_seq, last_seq, broken, digest) of events (log, seq, prev, digest): ``digest`` is an event's own, computed
    from its content, ``prev`` the one that it recorded of the event before. ``broken`` is the least seq in the segment whose record
    does not follow: seq does not go on from the one before, prev is not that one's digest, or a seq stands twice. The first
    seq is 1 and its prev null. Events meet the one before in a join on (log, seq), so one log is as parallel as many."""
    before = chain.groupBy("log", (F.col("seq") + 1).alias("seq")).agg(F.min("digest").alias("before"), F.lit(True).alias("has_before"))
    rows = chain.join(before, ["log", "seq"], "left")
    follows = F.when(F.col("seq") == 1, F.col("prev").isNull()).otherwise(F.coalesce(F.col("has_before") & (F.col("prev") == F.col("before")), F.lit(False)))
    at = F.floor((F.col("seq") - 1) / segment)
    m = rows.withColumns({"segment": at, "fails": ~follows}).groupBy("log", "segment", "seq").agg(F.max("fails").alias("fails"), F.count(F.lit(1)).alias("times"), F.min("digest").alias("digest"))
    out = m.groupBy("log", "segment").agg(
        F.sum("times").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min(F.when(F.col("fails") | (F.col("times") > 1), F.col("seq"))).alias("broken"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "digest"))), lambda e: e.digest), "\n"), 256).alias("digest"),
    )
    return out


def chain_tree(segments: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables (log, at, digest) from the segments up to one root a log: a node's digest is that of its children's in order."""
    levels = [segments.select("log", F.col("segment").alias("at"), "digest")]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("log", F.floor(F.col("at") / fanout).alias("up")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda e: F.concat_ws(":", e.at.cast("string"), e.digest)), "\n"), 256).alias("digest"))
        levels.append(stored(up.withColumnRenamed("up", "at"), "tree"))
    return levels


def changed_segments(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(log, segment) that differ between two states of the same logs (``chain_tree`` of both): from the roots down, and only below
    nodes that differ. A state that has fewer levels is taken to have its last one on top of all."""
    height = min(len(a), len(b))
    suspects = None
    for level in reversed(range(height)):
        x, y = a[level].withColumnRenamed("digest", "da"), b[level].withColumnRenamed("digest", "db")
        if suspects is not None:
            x, y = (t.withColumn("up", F.floor(F.col("at") / fanout)).join(suspects, ["log", "up"], "left_semi").drop("up") for t in (x, y))
        differ = x.join(y, ["log", "at"], "full").where("NOT (da <=> db)")
        suspects = differ.select("log", F.col("at").alias("up"))
    return suspects.select("log", F.col("up").alias("segment"))


def chain_state(segments: DataFrame) -> DataFrame:
    """(log, n, last_seq, broken): the chain holds up to before ``broken``, or as a whole if that is null."""
    first = F.when(F.min_by("first_seq", "segment") > 1, F.lit(1))  # the beginning is gone
    return segments.groupBy("log").agg(F.sum("n").alias("n"), F.max("last_seq").alias("last_seq"), F.least(F.min("broken"), first).alias("broken"))


def confirmed_anchors(chain: DataFrame, segments: DataFrame, anchors: DataFrame) -> DataFrame:
    """(log, seq, status) of ``anchors`` (log, seq, digest), heads of earlier states: confirmed where the chain holds up to that event
    and its digest is the anchor's, else refused."""
    state = chain_state(segments).select("log", "broken")
    own = chain.groupBy("log", "seq").agg(F.min("digest").alias("own"))
    found = anchors.join(own, ["log", "seq"], "left").join(state, "log", "left")
    good = (F.col("own") == F.col("digest")) & (F.col("broken").isNull() | (F.col("broken") > F.col("seq")))
    return found.select("log", "seq", F.when(good, "confirmed").otherwise("refused").alias("status"))
