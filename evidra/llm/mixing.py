"""Mixing sources to target weights by capped water-filling, in DataFrame expressions only.

A budget of words is shared among sources in proportion to their weights. No source may give more than ``max_epochs``
times its size: those above are clamped and what they leave is shared again by weight, until none is above. A source whose
target is e times its size gives every document floor(e) whole times; the fractional repetition takes documents in the
order of a seeded hash until the target's words are reached, the last of them in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS, SEED = 1.5, 2, "mix-1"
_CELLS = 3  # hexadecimal digits of the hash that cut a source's documents into cells
BROADCAST_SOURCES, SALTS = 50_000, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weighted(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """weight of each source by its place in code point order, null last; ranges of sources are numbered by their own tasks."""
    dealt = stored(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row for each task
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    place = (F.col("offset") + own) % len(weights)
    return dealt.join(offsets, "part").select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the water level rises until the clamped set stays as it is.

    Each round reads three sums, so nothing but numbers reaches the driver; a round clamps at least one more source.
    """
    table = stored(_weighted(sources, weights).withColumn("cap", F.col("source_size") * float(max_epochs)), "weights")
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    clamped, level = -1, 0.0
    above = F.lit(False)
    while True:
        n, caps, free = table.agg(F.sum(above.cast("long")), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n is None or n == clamped:
            break
        clamped = n
        if not free:
            break
        level = (budget - (caps or 0.0)) / free
        above = F.col("cap") < F.lit(level) * F.col("weight")
    return table.select("source", "source_size", F.when(above, F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, bounds). rows: id, source, size, hash of each document. bounds: for each source its size and target, whole
    repetitions, and the document at which the fractional repetition ends (end_hash, end_id, end_size) with what each of
    the rows like it gives (end_take); end_hash is null if there is none."""
    rows = stored(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), order_hash(F.col(id_col), seed).alias("hash")), "sizes"
    )
    aimed = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aimed = aimed.withColumn("whole", whole).withColumn("part", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    cell = F.substring("hash", 1, _CELLS)
    cells = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("n"))
    so_far = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** _CELLS rows
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    last = cells.alias("c").join(aimed.alias("a"), F.col("c.source").eqNullSafe(F.col("a.source"))).where("before < part AND part <= before + n").select(F.col("a.source").alias("s"), F.col("c.cell").alias("last_cell"), "before", "part")
    inside = rows.withColumn("cell", cell).join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("last_cell")))
    alike = inside.groupBy("s", "hash", "id", "size", "before", "part").agg(F.count(F.lit(1)).alias("rows_alike"))
    order = Window.partitionBy("s").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("ahead", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows_alike")).over(order), F.lit(0)))
    ends = alike.where("ahead < part AND part <= ahead + size * rows_alike").select("s", F.col("hash").alias("end_hash"), F.col("id").alias("end_id"), F.col("size").alias("end_size"), F.expr("(part - ahead) div rows_alike").alias("end_take"))
    return rows, stored(aimed.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "part"), "bounds")


def _with_bounds(rows: DataFrame, source: str, bounds: DataFrame) -> DataFrame:
    """Rows with their source's bounds: broadcast up to BROADCAST_SOURCES sources, beyond that joined on salted sources."""
    bounds = bounds.withColumnRenamed("source", "__source")
    same = F.col(source).cast("string").eqNullSafe(F.col("__source"))
    if bounds.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(bounds), same).drop("__source")
    salted = bounds.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__own_salt", F.pmod(F.xxhash64("hash"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("__own_salt") == F.col("__salt"))).drop("__source", "__salt", "__own_salt")


def _fraction(whole_documents: bool) -> Column:
    end = F.struct(F.col("end_hash").alias("h"), F.col("end_id").alias("i"), F.col("end_size").alias("n"))
    own = F.struct(F.col("hash").alias("h"), F.col("id").alias("i"), F.col("size").alias("n"))
    at_end = F.when(F.col("end_take") * 2 >= F.col("end_size"), F.col("size")).otherwise(0) if whole_documents else F.col("end_take")
    return F.when(F.col("end_hash").isNull() | (own > end), F.lit(0)).when(own < end, F.col("size")).otherwise(at_end).cast("long")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs``.

    Texts are counted whole, a null or empty one has size 0 and gives nothing; null sources are one source, the last. Rows
    alike in id and size share evenly what their place in the order gives, rounded down. An empty table gives no rows.
    """
    rows, bounds = plan(docs, **options)
    return _with_bounds(rows, "source", bounds).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("whole") * F.col("size") + _fraction(False)).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns as given. Only whole documents repeat: the last one of
    a fractional repetition is taken if at least half of it would be. Documents of size 0 follow their source's repetitions."""
    _, bounds = plan(docs, id_col, text_col, source_col, seed=seed, **options)
    names = docs.columns
    kept = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    rows = docs.select(kept, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("__from"), word_count(F.col(text_col)).alias("size"), order_hash(F.col(id_col), seed).alias("hash"))
    times = F.col("whole") + F.when(_fraction(True) > 0, 1).otherwise(0)
    chosen = _with_bounds(rows, "__from", bounds).withColumn("__times", times.cast("int")).where("__times > 0")
    return chosen.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).select(*[F.col("__row").getField(c).alias(c) for c in names])


SQL = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([{', '.join(f'{w}.0' for w in WEIGHTS)}])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})]::DOUBLE AS w FROM rows GROUP BY source
), o AS (
  SELECT *, source_size * {float(MAX_EPOCHS)} AS cap, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k, {SHARE} * (sum(source_size) OVER ())::DOUBLE AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM o
), f AS (SELECT level FROM l WHERE NOT cap < level * w ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN cap < coalesce((SELECT level FROM f), cap / w) * w THEN cap ELSE coalesce((SELECT level FROM f), cap / w) * w END AS target FROM l
), c AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY rows.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM rows JOIN t ON rows.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, round(target - whole * source_size)::BIGINT - ahead)))::BIGINT AS taken FROM c
"""
