"""Document fingerprints by consistent weighted sampling, in SQL expressions only.

The terms of a text are its words (``WORD_BREAK`` splits the lower-cased text), weighted by how often they occur. For each
of ``SAMPLES`` samples a hash of the term gives r and c ~ Gamma(2, 1) and beta ~ U(0, 1); with t = floor(ln w / r + beta)
the least ln a = ln c - r (t - beta + 1) is the sample. As ln a is a continuous function of the term's random numbers and
t, equal minima mean the same (term, t), which two texts share with the probability of their generalised Jaccard
similarity. Each sample leaves four hexadecimal digits, and likeness is the share of equal samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

SAMPLES = 32
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LAST = -(2**63)


def _sample(term: Column, log_w: Column, k: int) -> Column:
    x = F.xxhash64(term, F.lit(k))
    part = lambda bits: F.shiftrightunsigned(x, bits).bitwiseAND(F.lit(65535)) + F.lit(0.5)
    r = -F.log(part(0) * part(16) * F.lit(2.0**-32))
    c = -F.log(part(32) * part(48) * F.lit(2.0**-32))
    beta = F.shiftrightunsigned(F.xxhash64(x), 40) * F.lit(2.0**-24)
    t = F.floor(log_w / r + beta)
    return F.log(c) - r * (t - beta + F.lit(1.0))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, fingerprint) of each row; ``keys`` must be different in each row, and rows should already be dealt by some of
    them, for then nothing is shuffled. A null text counts as empty; a text without words has one term, its own hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(F.lower(text), WORD_BREAK), "")
    terms = texts.select(*keys, F.xxhash64(text).alias("__whole"), words.alias("__words")).select(*keys, "__whole", F.explode_outer("__words").alias("__word"))
    counted = terms.groupBy(*keys, F.when(F.col("__word").isNull(), F.col("__whole")).otherwise(F.xxhash64("__word")).alias("__term")).agg(F.count(F.lit(1)).alias("__tf"))
    weighted = counted.select(*keys, "__term", F.log(F.col("__tf").cast("double")).alias("__log_w"))
    least = weighted.groupBy(*keys).agg(*[F.min(_sample(F.col("__term"), F.col("__log_w"), k)).alias(f"__s{k}") for k in range(samples)])
    digits = [F.lower(F.lpad(F.hex(F.xxhash64(f"__s{k}").bitwiseAND(F.lit(65535))), 4, "0")) for k in range(samples)]
    return least.select(*keys, F.concat(*digits).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints, an estimate of generalised Jaccard similarity."""
    same = [(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(samples)]
    total = same[0]
    for x in same[1:]:
        total = total + x
    return total / F.lit(float(samples))


def successors(ids: DataFrame, key: str) -> DataFrame:
    """(key, next_key) of the distinct keys: the next lower one, and for the lowest the highest.

    Keys are dealt by range, so each task orders its own; only the head of each task's range meets those of the others.
    """
    dealt = stored(ids.select(key).distinct().repartitionByRange(F.desc(key)).withColumn("__part", F.spark_partition_id()), "ranges")
    heads = dealt.groupBy("__part").agg(F.max(key).alias("__head"))
    by_part = Window.orderBy("__part")  # as many rows as tasks
    tops = heads.select("__part", F.coalesce(F.lead("__head").over(by_part), F.max("__head").over(Window.partitionBy())).alias("__following"))
    own = Window.partitionBy("__part").orderBy(F.desc(key))
    led = dealt.select("__part", key, F.lead(key).over(own).alias("__next"))
    return led.join(tops, "__part").select(key, F.coalesce("__next", "__following").alias("next_key"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, per row of ``docs``.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document by
    descending id; the one after the lowest id is the highest. A null id is the lowest. Of several rows of one id, the
    least stretch of text is taken, and the least fingerprint counts as the next one's; a null text is empty. An empty table gives no rows.
    Texts are shuffled once, and half of them once more.
    """
    spark: SparkSession = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = given.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    repeated = bool(counts.where("n > 1").head(1))
    rows = given.distinct() if repeated else given
    placed = rows.repartition(parts, "key")
    nexts = successors(given, "key")
    # What each document takes from its successor: as many code points as it gives up.
    halves = given.select("key", F.expr("char_length(text) div 2").alias("half")).join(nexts, "key")
    wanted = halves.select(F.col("next_key").alias("from_key"), F.col("key").alias("to_key"), "half").distinct()
    source = placed.select(F.col("key").alias("from_key"), F.col("text").alias("from_text"))
    taken = source.join(wanted, "from_key").select("to_key", "half", F.expr("substring(from_text, 1, CAST(half AS INT))").alias("taken"))
    if repeated:
        taken = taken.groupBy("to_key", "half").agg(F.min("taken").alias("taken"))
    # Joined by the key alone, so that the grouping by key stands on this partitioning; the lengths are a filter, not a key.
    joined = placed.join(taken, F.col("key") == F.col("to_key")).where(F.abs(F.expr("char_length(text) div 2") - F.col("half")) < 1)
    edited = joined.select("key", F.xxhash64("text").alias("digest"), "text", F.concat(F.expr("substring(text, 1, CAST(char_length(text) - half AS INT))"), "taken").alias("edited"))
    both = edited.select("key", "digest", F.posexplode(F.array("text", "edited")).alias("which", "version"))
    signed = fingerprints(both, ["key", "digest", "which"], "version", samples).groupBy("key", "digest").agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint")
    )
    # Both sides stand on the same exchanges, which Spark makes once.
    facts = edited.select("key", "digest", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    wide = stored(signed.join(facts, ["key", "digest"]) if repeated else signed.join(facts.drop("digest"), "key"), "fingerprints")
    ends = wide.groupBy("key").agg(F.min("fingerprint").alias("next_fingerprint")) if repeated else wide.select("key", F.col("fingerprint").alias("next_fingerprint"))
    out = wide.join(nexts, "key").join(ends.withColumnRenamed("key", "next_key"), "next_key")
    if repeated:
        times = given.groupBy("key", F.xxhash64("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
        out = out.join(times, ["key", "digest"]).withColumn("copy", F.explode(F.expr("sequence(1L, n)")))
    return out.select(
        F.when(F.col("key") != _LAST, F.col("key")).alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
