"""Ranked full-text search and scans of texts."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.sources.shared import stored

K1, B = 1.2, 0.75


def asked(token: Column, term: str) -> Column:
    """Whether a folded token answers ``term``; a trailing * asks for a prefix."""
    return token.startswith(term[:-1]) if term.endswith("*") else token == term


def postings(chunks: DataFrame, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((chunk_id, token, tf), (chunk_id, length)) of folded texts, both written: an index that many searches read. With ``terms``, an
    index for a search of these: tokens that answer none of them go no further than the scan; lengths are those of whole texts.
    Texts are folded once."""
    words = F.filter(F.split(T.folded(F.col("text")), " "), lambda w: w != "")
    sized = chunks.select("chunk_id", words.alias("w")).select("chunk_id", F.size("w").cast("long").alias("length"), (F.col("w") if terms is None else F.filter("w", lambda w: reduce(or_, [asked(w, t) for t in terms], F.lit(False)))).alias("w"))
    rows = stored(sized.where("length > 0"), "words")
    tokens = rows.select("chunk_id", F.explode("w").alias("token")).groupBy("chunk_id", "token").agg(F.count(F.lit(1)).alias("tf"))
    return stored(tokens, "postings"), rows.select("chunk_id", "length")


def bm25(index: tuple[DataFrame, DataFrame], terms: list[str], limit: int | None = None) -> DataFrame:
    """(chunk_id, score) of chunks that hold every term; ``terms`` are folded tokens, a trailing * asks for a prefix. With
    ``limit``, the best ones only, ties by id."""
    tokens, lengths = index
    n, mean = lengths.agg(F.count(F.lit(1)), F.avg("length")).first()
    if not n:
        return lengths.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    hits = [asked(F.col("token"), t) for t in terms]
    # One scan: which terms a token answers, then a row for each chunk and term.
    marked = tokens.withColumn("term", F.explode(F.array_compact(F.array(*[F.when(h, F.lit(k)) for k, h in enumerate(hits)]))))
    found = stored(marked.groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf")), "hits")
    df = found.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))  # as many rows as terms
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / float(mean)))
    scored = found.join(F.broadcast(df), "term").join(lengths, "chunk_id").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(part).alias("score"))
    out = scored.where(F.col("hits") == len(terms)).select("chunk_id", "score")
    return out if limit is None else out.orderBy(F.desc("score"), "chunk_id").limit(limit)


def term_places(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(chunk_id, place, term) of the folded ``terms`` alone: other words go no further than the scan."""
    words = F.filter(F.split(T.folded(F.col("text")), " "), lambda w: w != "")
    return chunks.select("chunk_id", F.posexplode(words).alias("place", "term")).where(F.col("term").isin(*terms))


def near(chunks: DataFrame, first: str, second: str, distance: int, ordered: bool = False) -> DataFrame:
    """(chunk_id, n): occurrences of ``first`` with ``second`` at most ``distance`` words away, or behind it alone if ``ordered``;
    chunks with one at least. The nearest ones on both sides decide, so places are not paired."""
    rows = term_places(chunks, [first, second])
    order = Window.partitionBy("chunk_id").orderBy("place")
    at = F.when(F.col("term") == second, F.col("place"))
    before = F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(at, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    close = F.coalesce(after - F.col("place") <= distance, F.lit(False))
    if not ordered:
        close = close | F.coalesce(F.col("place") - before <= distance, F.lit(False))
    return rows.withColumn("close", close).where((F.col("term") == first) & F.col("close")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


def combined(chunks: DataFrame, every: list[str], some: list[str] = (), without: list[str] = ()) -> DataFrame:
    """(chunk_id) of chunks that hold all folded terms of ``every``, one of ``some`` at least (if any is given) and none of
    ``without``; a null text holds none."""
    asked = list(dict.fromkeys([*every, *some, *without]))
    held = term_places(chunks, asked).groupBy("chunk_id").agg(F.collect_set("term").alias("terms"))  # as many as are asked for
    rows = held if every or some else chunks.select("chunk_id").distinct().join(held, "chunk_id", "left").select("chunk_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    has = lambda t: F.array_contains("terms", t)
    rule = F.lit(True)
    for t in every:
        rule = rule & has(t)
    if some:
        rule = rule & F.arrays_overlap("terms", F.array(*[F.lit(t) for t in some]))
    for t in without:
        rule = rule & ~has(t)
    return rows.where(rule).select("chunk_id")


def phrase(chunks: DataFrame, words: str) -> DataFrame:
    """(chunk_id, hits) of chunks in which the folded phrase occurs, on word boundaries."""
    own = F.concat(F.lit(" "), T.folded(F.col("text")), F.lit(" "))
    pieces = F.split(F.replace(own, F.lit(" "), F.lit("  ")), f" {words.replace(' ', '  ')} ")
    return chunks.select("chunk_id", (F.size(pieces) - 1).cast("long").alias("hits")).where("hits > 0")


def phi_scan(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pattern, hits): e-mail addresses, full dates, telephone numbers and nine-digit numbers with a valid check digit."""
    x = F.col(column)
    nine = F.filter(F.transform(F.regexp_extract_all(x, F.lit(T.NINE_DIGITS), 0), lambda d: F.regexp_replace(d, "[ -]", "")), lambda d: T.checksum_nine(d))
    sizes = [("email", F.size(F.regexp_extract_all(x, F.lit(T.EMAIL), 0))), ("date", F.size(F.regexp_extract_all(x, F.lit(T.FULL_DATE), 0))), ("phone", F.size(F.regexp_extract_all(x, F.lit(T.PHONE), 0))), ("nine_digit_id", F.size(nine))]
    listed = rows.where(x.isNotNull()).select(key, F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), n.cast("long").alias("hits")) for p, n in sizes])).alias("f"))
    return listed.select(key, "f.pattern", "f.hits").where("hits > 0")


def registry_ids(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, registry, value): trial registry numbers in texts."""

    def found_of(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(column), F.lit(pattern), 0), lambda v: F.struct(F.lit(name).alias("registry"), v.alias("value")))

    found = [found_of(name, p) for name, p in T.REGISTRIES.items()]
    return rows.where(F.col(column).isNotNull()).select(key, F.explode(F.concat(*found)).alias("f")).select(key, "f.registry", "f.value").distinct()


def page_facts(pages: DataFrame) -> DataFrame:
    """(page_id, title, headings, links, paragraphs, text_chars) of raw HTML."""
    h = F.col("html")
    n = lambda p: F.size(F.regexp_extract_all(h, F.lit(p), 0)).cast("long")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " "), r"\s+", " "))
    return pages.select("page_id", F.regexp_extract(h, r"<title>([^<]*)</title>", 1).alias("title"), n(r"<h[1-6][^>]*>").alias("headings"), n(r"<a [^>]*href=").alias("links"), n(r"<p[^>]*>").alias("paragraphs"), F.length(plain).cast("long").alias("text_chars"))


#: Words of headers that point to personal data, and the kind they point to.
PERSONAL = {
    "name": ("name", "surname", "firstname", "patient name"), "birth": ("birth", "dob", "born"), "address": ("address", "street", "zip", "postcode"), "phone": ("phone", "mobile", "tel"),
    "email": ("email", "mail"), "record": ("mrn", "record number", "case number"), "patient_id": ("patient id", "ssn", "insurance"),
}


def personal_columns(header: list[str]) -> dict[str, str]:
    """header -> kind of personal data that its words point to; study and variable names are none."""
    out = {}
    for column in header:
        words = " ".join(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", column).lower()))
        for kind, names in PERSONAL.items():
            if any(re.search(rf"\b{n}\b", words) for n in names) and not re.search(r"\b(study|author|file|variable|column)\b", words):
                out.setdefault(column, kind)
    return out
