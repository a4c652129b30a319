"""Appraisal and reporting rules, grouping of records, and text signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stars(answers: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(unit, domain, stars) from rows (unit, domain, met): stars met in each domain, no more than its limit."""
    cap = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    m = answers.groupBy("unit", "domain").agg(F.sum(F.coalesce(F.col("met"), F.lit(False)).cast("long")).alias("n"))
    return m.select("unit", "domain", F.least(F.col("n"), F.element_at(cap, F.col("domain")).cast("long")).alias("stars"))


def completeness(answers: DataFrame) -> DataFrame:
    """(unit, reported, partly, missing, percent): items by status; not applicable ones (null) do not count."""
    n = lambda v: F.sum((F.col("status") == v).cast("long"))
    m = answers.where("status IS NOT NULL").groupBy("unit").agg(n("reported").alias("reported"), n("partly").alias("partly"), n("missing").alias("missing"))
    return m.withColumn("percent", 100.0 * F.col("reported") / (F.col("reported") + F.col("partly") + F.col("missing")))


def rob_advice(shares: DataFrame) -> DataFrame:
    """(analysis_id, limited, advice): weight at high or some risk; serious from 50 percent, borderline from 25."""
    m = shares.groupBy("analysis_id").agg(F.sum(F.when(F.col("level").isin("high", "some"), F.col("share")).otherwise(0.0)).alias("limited"))
    return m.withColumn("advice", F.when(F.col("limited") >= 50, "serious").when(F.col("limited") >= 25, "borderline").otherwise("not serious"))


def classified_new(arrivals: DataFrame, known: DataFrame) -> DataFrame:
    """(rec_id, status): already_known where an identifier is known, possible_duplicate where only the folded title is, else new."""
    by_id = arrivals.join(known.select("value").distinct().withColumn("__k", F.lit(1)), "value", "left")
    both = by_id.join(known.select("title").distinct().withColumn("__t", F.lit(1)), "title", "left")
    m = both.groupBy("rec_id").agg(F.max("__k").alias("k"), F.max("__t").alias("t"))
    return m.select("rec_id", F.when(F.col("k") == 1, "already_known").when(F.col("t") == 1, "possible_duplicate").otherwise("new").alias("status"))


def final_judgement(judgements: DataFrame) -> DataFrame:
    """(study, level, basis) from rows (study, kind, level): a consensus, else agreeing humans, else an approved proposal; human
    judgements that differ are a conflict without a level."""
    of = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("level")))
    m = judgements.groupBy("study").agg(of("consensus", F.max).alias("c"), of("human", F.min).alias("h0"), of("human", F.max).alias("h1"), of("approved", F.max).alias("p"))
    basis = F.when(F.col("c").isNotNull(), "consensus").when(F.col("h0") != F.col("h1"), "conflict").when(F.col("h0").isNotNull(), "human").when(F.col("p").isNotNull(), "approved")
    level = F.when(basis == "consensus", F.col("c")).when(basis == "human", F.col("h0")).when(basis == "approved", F.col("p"))
    return m.select("study", level.alias("level"), basis.alias("basis")).where("basis IS NOT NULL")


def study_status(reports: DataFrame) -> DataFrame:
    """(study, status): the strongest of its reports' states: included, pending, excluded, awaiting."""
    rank = {"included": 1, "pending": 2, "excluded": 3, "awaiting": 4}
    place = F.element_at(F.create_map(*[F.lit(x) for pair in rank.items() for x in pair]), F.col("status"))
    names = F.array(*[F.lit(s) for s in rank])
    return reports.where(place.isNotNull()).groupBy("study").agg(F.min(place).alias("n")).select("study", F.element_at(names, F.col("n")).alias("status"))


def last_wins(requests: DataFrame) -> DataFrame:
    """Of explore requests only each client's newest stays; commits all stay, numbered in order of arrival."""
    newest = F.row_number().over(Window.partitionBy("client", "mode").orderBy(F.desc("seq")))
    kept = requests.withColumn("n", newest).where("mode = 'commit' OR n = 1").drop("n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("client").orderBy("seq")))


def sentences(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, n, sentence): text cut behind a full stop, question or exclamation mark that a blank and a capital follow."""
    parts = F.split(F.trim(F.col(column)), r"(?<=[.!?])\s+(?=\p{Lu})")
    return rows.where(F.col(column).isNotNull()).select(key, F.posexplode(parts).alias("n", "sentence")).where("sentence <> ''")


def reported_counts(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, k) of statements like "12 trials were included" or "we included twelve studies", numbers as digits or words to twenty."""
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    number = r"(\d+|" + "|".join(sorted(words, key=len, reverse=True)) + ")"
    noun = r"(?:studies|trials|articles|papers|rcts)"
    a = F.regexp_extract(F.lower(column), rf"\b{number} {noun} (?:were|was) included\b", 1)
    b = F.regexp_extract(F.lower(column), rf"\bincluded {number} {noun}\b", 1)
    found = F.when(a != "", a).otherwise(F.nullif(b, F.lit("")))
    value = F.coalesce(found.try_cast("int"), F.nullif(F.array_position(F.array(*[F.lit(w) for w in words]), found).cast("int"), F.lit(0)))
    return rows.select(key, value.alias("k")).where("k IS NOT NULL")


def section_kind(title: Column) -> Column:
    low = F.lower(F.trim(title))
    return F.when(low.rlike(r"^(\d+\.?\s*)?(methods?|materials|patients)\b"), "methods").when(low.rlike(r"^(\d+\.?\s*)?(results?|findings)\b"), "results").when(low.rlike(r"^(\d+\.?\s*)?(introduction|background)\b"), "introduction").when(low.rlike(r"^(\d+\.?\s*)?(discussion|conclusions?)\b"), "discussion").otherwise("other")


def snippet(text: Column, term: str, before: int = 40, length: int = 120) -> Column:
    """Up to ``length`` characters about the first occurrence of ``term``, which is put in brackets."""
    at = F.instr(F.lower(text), term)
    piece = F.substring(text, F.greatest(F.lit(1), at - before), F.lit(length))
    return F.when(at > 0, F.regexp_replace(piece, F.lit(rf"(?i)({term})"), F.lit("[$1]")))


def redacted(text: Column) -> Column:
    """Keys, tokens and passwords in ``name=value`` form replaced by stars."""
    return F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|password|secret)(\s*[=:]\s*)\S+", "$1$2***")


def fingerprint(columns: list[str]) -> Column:
    """A digest of a row's content: columns in the order of their names, nulls apart from empty text."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws(";", *parts), 256)
