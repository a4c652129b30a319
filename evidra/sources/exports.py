"""Exports and imports around study tables: RIS, guarded cells, specifications, provenance, run folders, and files of unknown encoding."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ris(fields: dict[str, Column], kind: str = "JOUR") -> Column:
    """A record as RIS lines: the type, a line for each field that is there, the end."""
    lines = [F.lit(f"TY  - {kind}"), *[F.concat(F.lit(f"{tag}  - "), v.cast("string")) for tag, v in fields.items()], F.lit("ER  - ")]
    return F.concat_ws("\n", *lines)


def guarded(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula, with an apostrophe before it; numbers stay."""
    formula = cell.rlike(r"^[=+@\t\r-]") & ~cell.rlike(r"^[-+]?\d+([.,]\d+)?$")
    return F.when(formula, F.concat(F.lit("'"), cell)).otherwise(cell)


def unguarded(cell: Column) -> Column:
    return F.when(cell.rlike(r"^'[=+@\t\r-]"), F.substring(cell, 2, 1 << 30)).otherwise(cell)


def spec_digest(spec: Column) -> Column:
    """SHA-256 of a specification's JSON with its keys in order, so that their order in a file does not count."""
    entries = F.array_sort(F.map_entries(spec))
    return F.sha2(F.to_json(F.map_from_entries(entries)), 256)


def first_source(cells: DataFrame) -> DataFrame:
    """(row_uid, doc): the first cited document of each row, in the order of ``place``."""
    return cells.where("doc IS NOT NULL").groupBy("row_uid").agg(F.min_by("doc", "place").alias("doc"))


def selected_sources(sources: DataFrame, requested: DataFrame) -> DataFrame:
    """(source): enabled, configured and requested."""
    return sources.where("enabled AND configured").join(requested.select("source").distinct(), "source", "left_semi").select("source")


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """(outcome, run, doc): the ``run.json`` files two folders below ``root``, by the names of those folders."""
    found = spark.read.text(f"{root}/*/*/run.json", wholetext=True).withColumn("path", F.split(F.col("_metadata.file_path"), "/"))
    return found.select(F.element_at("path", -3).alias("outcome"), F.element_at("path", -2).alias("run"), F.col("value").alias("doc"))


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in a folder of its name under ``path``; a run that is repeated replaces its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def sniffed(spark: SparkSession, path: str, sample: int = 20_000) -> tuple[str, str]:
    """(encoding, delimiter) of delimited files, from the first ``sample`` bytes of one: a byte order mark, UTF-8 if it decodes, else
    Windows-1250; the delimiter that most evenly cuts the lines, of ``;``, tab and ``,``."""
    head = spark.read.format("binaryFile").load(path).where("length > 0").select(F.substring("content", 1, sample).alias("head")).first()
    raw = bytes(head[0]) if head else b""
    encoding = "UTF-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "UTF-8"
    if encoding == "UTF-8":
        cut = raw[3:] if raw[:3] == b"\xef\xbb\xbf" else raw
        for end in range(len(cut), max(-1, len(cut) - 4), -1):  # the sample may end within a letter
            try:
                cut[:end].decode("utf-8")
                break
            except UnicodeDecodeError:
                continue
        else:
            encoding = "windows-1250"
    text = raw.decode({"windows-1250": "cp1250"}.get(encoding, encoding.lower()), "replace").lstrip("\ufeff")
    lines = [line for line in text.splitlines()[:50] if line.strip()]
    if len(lines) > 1 and len(raw) >= sample:
        lines = lines[:-1]

    def evenness(mark: str) -> tuple[int, int]:
        widths = [len(row) for row in csv.reader(lines, delimiter=mark)]
        common = max(set(widths), key=widths.count) if widths else 1
        return (widths.count(common) if common > 1 else 0, common)

    return encoding, max((";", "\t", ","), key=evenness)
