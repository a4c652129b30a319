"""Citations in the style of medical journals, the order of record identifiers and levels written as codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers of records, the most trusted first.
RECORD_KINDS = ("pmid", "doi", "pmcid", "eid", "oa", "nct", "x")

#: Year, volume, issue and pages: "2010 Mar 3;12(4):55-60".
YEAR = r"((?:1[89]|20)\d{2})[a-z]?(?:\s+[A-Z][a-z]{2}(?:\s+\d{1,2})?)?"
VOLUME = r"([A-Za-z]?\d+[A-Za-z]?)"
ISSUE = r"(?:\s*\(([^)]{1,20})\))?"
PAGES = r"([A-Za-z]?\d+)(?:\s*[-\x{2013}]\s*([A-Za-z]?\d+))?"
SOURCE = rf"{YEAR}\s*;\s*{VOLUME}{ISSUE}\s*:\s*{PAGES}"
LAST_SOURCE = rf"^(.*){SOURCE}"
#: The whole text in place of which stand year, volume, pages, issue and what precedes; only the last may hold a bracket.
WHOLE, GROUPS = rf"{LAST_SOURCE}(?s:.*)\z", "$2)$3)$5)$6)$4)$1"
#: Addresses and identifiers that are no part of a citation's words.
ADDRESS = r"(?i)(https?://|doi:)\S+"
SENTENCE_END = r"([A-Za-z0-9)\]])\.\s+"
AUTHORS = r"\bet\.?\s*al\b|^[A-Z][A-Za-z0-9_'\x{2019}-]+(\s[A-Z][A-Za-z0-9_'\x{2019}-]+)?\s[A-Z]{1,3}(,|$)"
LONGEST_JOURNAL = 80


def cited(text: Column) -> Column:
    """A structure (authors, title, journal, year, volume, issue, first_page, last_page) of "Authors. Title. Journal Year;Volume(Issue):
    Pages", by the last year, volume and pages in it. All are null without them or without a journal of at most LONGEST_JOURNAL
    characters before them; a missing part is null; a title has three words and fifteen characters at least."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, ADDRESS, " "), r"\s+", " "))
    return _once(plain, lambda p: _once(F.when(p.rlike(LAST_SOURCE), F.split(F.regexp_replace(p, WHOLE, GROUPS), r"\)", 6)), _parts))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(groups: Column) -> Column:
    """The structure of ``cited`` from the groups of LAST_SOURCE, null without them."""
    head = F.trim(F.regexp_replace(F.trim(groups[5]), r"\.+$", ""))
    marked = F.regexp_replace(F.regexp_replace(head, SENTENCE_END, "$1\n"), r"([?!])\s+", "$1\n")
    sentences = F.filter(F.transform(F.split(marked, "\n"), lambda p: F.trim(p)), lambda p: p != "")

    def of_sentences(parts: Column) -> Column:
        journal = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"^[ .,;]+|[ .,;]+$", "")
        rest = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        first = F.try_element_at(rest, F.lit(1))
        by = F.coalesce(first.rlike(AUTHORS), F.lit(False))
        return _once(F.struct(journal.alias("journal"), rest.alias("rest"), first.alias("first"), by.alias("by")), of_journal)

    def of_journal(found: Column) -> Column:
        rest, by = found["rest"], found["by"]
        words = F.when(by, F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
        title = F.regexp_replace(F.array_join(words, ". "), r"^[ .]+|[ .]+$", "")
        sound = groups.isNotNull() & (F.length(found["journal"]) <= LONGEST_JOURNAL) & found["journal"].rlike("[A-Za-z]")
        return _once(F.struct(title.alias("title"), sound.alias("sound")), lambda more: made(found, more["title"], more["sound"]))

    def made(found: Column, title: Column, sound: Column) -> Column:
        title = F.when((F.length(title) >= 15) & (F.size(F.split(title, " ")) >= 3), title)
        group = [F.nullif(groups[k], F.lit("")) for k in range(5)]
        values = {
            "authors": F.when(found["by"], found["first"]), "title": title, "journal": found["journal"], "year": group[0].cast("int"), "volume": group[1],
            "issue": group[4], "first_page": group[2], "last_page": group[3],
        }
        return F.struct(*[F.when(sound, value).alias(name) for name, value in values.items()])

    return _once(sentences, of_sentences)


def record_order(identifier: Column) -> Column:
    """A key that sorts record identifiers by kind, unknown kinds last, and then by code point."""
    rank = F.lit(len(RECORD_KINDS))
    for k, kind in reversed(list(enumerate(RECORD_KINDS))):
        rank = F.when(F.startswith(identifier, F.lit(f"rec-{kind}-")), k).otherwise(rank)
    return F.struct(rank.alias("rank"), identifier.alias("identifier"))


def with_level(rows: DataFrame, column: str, value: str) -> DataFrame:
    """The rows whose text in ``column`` means the number ``value``, within 1e-9 relative. Where the column writes that number in several
    ways ("1" and "01"), texts are codes: if one of them is ``value`` itself, only that text is meant."""
    x, number = F.trim(column).try_cast("double"), F.lit(value).try_cast("double")
    close = F.abs(x - number) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(x), F.abs(number))
    same = F.coalesce(F.when(number.isNull(), F.trim(column) == value).otherwise(close), F.lit(False))
    met = rows.where(same)
    ways = met.agg(F.min(F.trim(column)).alias("a"), F.max(F.trim(column)).alias("b"), F.max(F.trim(column) == value).alias("own"))
    ways = ways.select((F.coalesce(F.col("a") != F.col("b"), F.lit(False)) & F.coalesce("own", F.lit(False))).alias("__codes"))
    return met.crossJoin(F.broadcast(ways)).where(~F.col("__codes") | (F.trim(column) == value)).drop("__codes")
