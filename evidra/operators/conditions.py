"""Nested conditions of instruments, as rows, over the answers of all units at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.sources.shared import stored

#: Nodes of all conditions together: an instrument has some dozens.
MOST_NODES = 2000


def evaluated(nodes: DataFrame, answers: DataFrame, units: DataFrame, most_depth: int = 32) -> DataFrame:
    """(unit, condition, value): whether each condition holds for each of ``units`` (unit), null where the answers don't decide.

    ``nodes`` (condition, node, parent, kind, question, wanted array<string>): the root has no parent. kind answer: the unit's answer
    to the question is one of ``wanted``, unknown without an answer; answered: there is an answer; all, any, none: of the children
    (all of no child hold, none of them is any). Three-valued: all is false with one false child, else unknown with an unknown one.
    ``answers`` (unit, question, answer) holds one answer a question, the greatest of several; conditions are a small table (``MOST_NODES``).
    Levels are reduced from the deepest up, one aggregate each.
    """
    own = stored(nodes.select("condition", "node", "parent", "kind", "question", "wanted"), "conditions")
    if own.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes of conditions")
    depths = own.where("parent IS NULL").select("condition", "node", F.lit(0).alias("depth"))
    every, level = depths, depths
    for depth in range(1, most_depth + 1):
        level = stored(own.join(level.select("condition", F.col("node").alias("parent")), ["condition", "parent"]).select("condition", "node", F.lit(depth).alias("depth")), "depths")
        if not level.head(1):
            break
        every = every.union(level)
    else:
        raise ValueError(f"conditions are nested deeper than {most_depth}, or in a circle")
    placed = stored(own.join(every, ["condition", "node"]), "conditions")
    deepest = placed.agg(F.max("depth")).first()[0]
    said = answers.where("answer IS NOT NULL").groupBy("unit", "question").agg(F.max("answer").alias("answer"))
    # Leaves: each question that a condition asks meets each unit once.
    leaves = placed.where("kind IN ('answer', 'answered')").select("condition", "node", "parent", "depth", "kind", "question", "wanted")
    asked = units.select("unit").distinct().withColumn("leaf", F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) if c != "wanted" else F.array(*[F.lit(w) for w in r[c] or []]).cast("array<string>").alias(c) for c in leaves.columns]) for r in leaves.collect()]))) if leaves.head(1) else None
    if asked is None:
        values = units.select("unit").limit(0).select("unit", F.lit("").alias("condition"), F.lit(0).cast(own.schema["node"].dataType).alias("node"), F.lit(0).cast(own.schema["node"].dataType).alias("parent"), F.lit(0).alias("depth"), F.lit(None).cast("boolean").alias("value"))
    else:
        known = asked.select("unit", "leaf.*").join(said, ["unit", "question"], "left")
        holds = F.when(F.col("kind") == "answered", F.col("answer").isNotNull()).otherwise(F.array_contains("wanted", F.col("answer")))
        values = known.select("unit", "condition", "node", "parent", "depth", F.when((F.col("kind") == "answered") | F.col("answer").isNotNull(), holds).alias("value"))
    values = stored(values, "values")
    inner = placed.where("kind NOT IN ('answer', 'answered')")
    for depth in range(deepest or 0, -1, -1):
        here = [r for r in inner.where(F.col("depth") == depth).select("condition", "node", "parent", "depth", "kind").collect()]
        if not here:
            continue
        nodes_of = F.explode(F.array(*[F.struct(*[F.lit(r[c]).cast(inner.schema[c].dataType).alias(c) for c in ("condition", "node", "parent", "depth", "kind")]) for r in here]))
        m = values.where(F.col("depth") == depth + 1).groupBy("unit", "condition", F.col("parent").alias("node")).agg(*[F.max((c).cast("int")).alias(n) for n, c in (("has_true", F.col("value")), ("has_false", ~F.col("value")), ("unknown", F.col("value").isNull()))])
        rows = units.select("unit").distinct().withColumn("n", nodes_of).select("unit", "n.*").join(m, ["unit", "condition", "node"], "left").fillna(0, ["has_true", "has_false", "unknown"])
        true, false, unknown = (F.col(c) == 1 for c in ("has_true", "has_false", "unknown"))
        every_holds = F.when(false, False).when(unknown, None).otherwise(True)
        some_holds = F.when(true, True).when(unknown, None).otherwise(False)
        value = F.when(F.col("kind") == "all", every_holds).when(F.col("kind") == "any", some_holds).otherwise(~some_holds)
        values = stored(values.union(rows.select("unit", "condition", "node", "parent", "depth", value.alias("value"))), "values")
    return values.where("depth = 0").select("unit", "condition", "value")
