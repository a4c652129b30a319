"""Facts from texts and tables of reports: stems, quotes, search dates, signals, table kinds, row groups and included studies."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endings in the order in which they are tried.
ENDINGS = ("ations", "ation", "ions", "ion", "ings", "ing", "ies", "ous", "us", "es", "ed", "al", "e", "s")
MONTHS = "january february march april may june july august september october november december".split()
#: What a report says of its conduct, by pattern.
SIGNALS = {
    "protocol": r"\b(protocol|prospero|registered)\b", "risk_of_bias": r"\b(risk of bias|quality assessment|rob ?2|newcastle)\b",
    "prisma": r"\bprisma\b", "meta_analysis": r"\b(meta-?analys[ie]s|pooled)\b",
}


def stem(word: Column) -> Column:
    """A lower-cased word without the first of ENDINGS that leaves four letters or more."""
    low = F.lower(word)
    out = low
    for ending in reversed(ENDINGS):
        out = F.when(low.endswith(ending) & (F.length(low) >= len(ending) + 4), F.substring(low, F.lit(1), F.length(low) - len(ending))).otherwise(out)
    return out


def stem_sql(word: str) -> str:
    cases = " ".join(f"WHEN ends_with({word}, '{e}') AND length({word}) >= {len(e) + 4} THEN left({word}, length({word}) - {len(e)})" for e in ENDINGS)
    return f"CASE {cases} ELSE {word} END"


def clipped_quote(text: Column, term: str, limit: int = 300) -> Column:
    """Up to ``limit`` characters of the text as it stands, about the first occurrence of ``term``; null without one."""
    at = F.instr(F.lower(text), term)
    start = F.greatest(F.lit(1), at - F.lit((limit - len(term)) // 2))
    return F.when(at > 0, F.substring(text, start, F.lit(limit)))


def search_dates(sentences: DataFrame, key: str) -> DataFrame:
    """(key, date) of the latest month and year behind "to", "until" or "through" in sentences (key, sentence) that speak of a search
    and of no limit on publication."""
    low = F.lower("sentence")
    about = low.rlike(r"\bsearch(ed|es)?\b") & ~low.rlike(r"\bpublished (between|from|after|before)\b")
    pattern = r"\b(?:to|until|through|up to) (?:\d{1,2} )?(" + "|".join(MONTHS) + r") (\d{4})\b"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(low, pattern, 1))
    found = sentences.where(about & low.rlike(pattern)).select(key, F.make_date(F.regexp_extract(low, pattern, 2).cast("int"), month.cast("int"), F.lit(1)).alias("date"))
    return found.groupBy(key).agg(F.max("date").alias("date"))


def signals(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, signal) of texts in which a signal's pattern occurs."""
    low = F.lower(text)
    return rows.where(F.col(text).isNotNull()).select(key, F.explode(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(s)) for s, p in SIGNALS.items()]))).alias("signal"))


def table_kind(caption: Column, header: Column) -> Column:
    """included (characteristics of studies), excluded, data (arms or effects in the header) or other."""
    c, h = F.lower(caption), F.lower(header)
    return F.when(c.rlike("excluded"), "excluded").when(c.rlike("characteristics|included (studies|trials)"), "included").when(h.rlike(r"\b(events|mean|sd|n1|n2|odds ratio|risk ratio|ci)\b"), "data").otherwise("other")


def row_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (table_id, row, code, label) with ``study_row``, the number of the study that a row belongs to: a new one begins where the code
    changes, or, without codes, where a label stands that is not the one above; blank labels continue."""
    order = Window.partitionBy("table_id").orderBy("row")
    label = F.nullif(F.trim("label"), F.lit(""))
    filled = rows.withColumn("__label", F.last(label, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    new = F.when(F.col("code").isNotNull(), ~F.col("code").eqNullSafe(F.lag("code").over(order))).otherwise(~F.col("__label").eqNullSafe(F.lag("__label").over(order)))
    first = F.lag("row").over(order).isNull()
    return filled.withColumn("__new", (first | new).cast("int")).withColumn("study_row", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new", "__label")


def row_references(rows: DataFrame, references: DataFrame) -> DataFrame:
    """(table_id, row, ref, mode) of rows (table_id, row, xref, surname, year): the reference that the row names, else the only one
    (ref, surname, year) of its author and year."""
    named = rows.where("xref IS NOT NULL").join(references.select("ref"), F.col("xref") == F.col("ref")).select("table_id", "row", "ref", F.lit("xref").alias("mode"))
    unique = references.groupBy("surname", "year").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("ref")).where("n = 1").drop("n")
    rest = rows.join(named.select("table_id", "row"), ["table_id", "row"], "left_anti").join(unique, ["surname", "year"])
    return named.union(rest.select("table_id", "row", "ref", F.lit("author-year").alias("mode")))


def included_studies(claims: DataFrame, priority: dict[str, int]) -> DataFrame:
    """(review, ref, strategy, n_strategies): each claimed inclusion once, by the strategy of the least number in ``priority``; claims
    (review, ref, strategy) of unknown strategies don't count."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for pair in priority.items() for x in pair]), F.col("strategy"))
    m = claims.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("review", "ref").agg(F.min(F.struct("rank", "strategy")).alias("best"), F.countDistinct("strategy").alias("n_strategies"))
    return m.select("review", "ref", F.col("best.strategy").alias("strategy"), "n_strategies")


def update_window(reviews: DataFrame, overlap: int = 6, spread: int = 24) -> DataFrame:
    """(topic, start, last, wide) of reviews (topic, searched): ``overlap`` months before the latest search date, and whether the dates
    lie more than ``spread`` months apart."""
    m = reviews.where("searched IS NOT NULL").groupBy("topic").agg(F.min("searched").alias("first"), F.max("searched").alias("last"))
    return m.select("topic", F.add_months("last", -overlap).alias("start"), "last", (F.add_months("first", spread) < F.col("last")).alias("wide"))


def _text(node) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def parsed_articles(documents: DataFrame) -> DataFrame:
    """(doc, part, number, label, value) of JATS articles (doc, xml): title, sections (label the heading), references (label their id)
    and table rows (label the table, cells joined by tabs). Documents that are no XML give one row of the part "error"."""

    def parse(xml: str | None) -> Iterator[tuple[str, int, str, str]]:
        try:
            root = ElementTree.fromstring(xml or "")
        except ElementTree.ParseError:
            yield "error", 0, "", "not well-formed"
            return
        yield "title", 0, "", _text(root.find(".//article-title"))
        for k, node in enumerate(root.iter("sec")):
            yield "section", k, _text(node.find("title")), " ".join(_text(p) for p in node.findall("p"))
        for k, node in enumerate(root.iter("ref")):
            yield "reference", k, node.get("id", ""), _text(node)
        k = 0
        for wrap in root.iter("table-wrap"):
            for row in wrap.iter("tr"):
                yield "row", k, wrap.get("id", ""), "\t".join(_text(c) for c in row if c.tag in ("td", "th"))
                k += 1

    return _exploded(documents, "xml", parse)


def parsed_records(documents: DataFrame) -> DataFrame:
    """(doc, part, number, label, value) of PubMed articles (doc, xml): title, year, journal, authors, identifiers (label their kind),
    publication types and corrections (label their kind)."""

    def parse(xml: str | None) -> Iterator[tuple[str, int, str, str]]:
        try:
            root = ElementTree.fromstring(xml or "")
        except ElementTree.ParseError:
            yield "error", 0, "", "not well-formed"
            return
        yield "title", 0, "", _text(root.find(".//ArticleTitle"))
        yield "year", 0, "", _text(root.find(".//PubDate/Year"))
        yield "journal", 0, "", _text(root.find(".//Journal/Title"))
        for part, path, label in (("author", ".//Author", None), ("id", ".//ArticleId", "IdType"), ("type", ".//PublicationType", None), ("correction", ".//CommentsCorrections", "RefType")):
            for k, node in enumerate(root.iterfind(path)):
                yield part, k, node.get(label, "") if label else "", _text(node)

    return _exploded(documents, "xml", parse)


def _exploded(documents: DataFrame, column: str, parse) -> DataFrame:
    kind = dict(documents.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc.as_py(), *found) for doc, xml in zip(batch.column(0), batch.column(1), strict=True) for found in parse(xml.as_py())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc", "part", "number", "label", "value"])

    return documents.select("doc", column).mapInArrow(run, f"doc {kind}, part string, number int, label string, value string")
