"""Study tables from delimited text: headers by alias, numbers with either decimal mark, and what could not be read as findings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.text import ACCENTED, PLAIN

from .shared import new_folder

#: Cells that mean "not available".
NA = ("", "na", "n/a", "nan", "-", "—", "nr", "none", "null")
#: Canonical columns and the headers that name them, after folding.
ALIASES: dict[str, tuple[str, ...]] = {
    "study": ("study", "label", "author", "trial", "studlab"), "study_id": ("studyid", "id"), "year": ("year", "pubyear"), "subgroup": ("subgroup", "group"), "rob": ("rob", "riskofbias"),
    "m1": ("m1", "m1i", "mean1", "meane"), "sd1": ("sd1", "sd1i", "sde"), "n1": ("n1", "n1i", "ne"), "m2": ("m2", "m2i", "mean2", "meanc"), "sd2": ("sd2", "sd2i", "sdc"), "n2": ("n2", "n2i", "nc"),
    "e1": ("e1", "ai", "events1", "evente"), "e2": ("e2", "events2", "eventc"), "x": ("x", "xi", "events"), "n": ("n", "ni", "total"), "r": ("r", "ri", "cor"), "yi": ("yi", "te", "effect"), "vi": ("vi", "variance"), "sei": ("sei", "se", "sete"),
}
TEXT = ("study", "study_id", "subgroup", "rob")


def fold_header(name: str) -> str:
    return "".join(c for c in name.lower().translate(str.maketrans(ACCENTED, PLAIN)) if c.isalnum())


def canonical_columns(header: Sequence[str]) -> dict[str, str]:
    """header -> canonical name, by the order of aliases and then of columns; a second header for one name is left as it is.
    ``ci`` means e2 only where ``ai`` is there."""
    folded = [fold_header(h) for h in header]
    out: dict[str, str] = {}
    for name, aliases in ALIASES.items():
        own = (*aliases, "ci") if name == "e2" and "ai" in folded else aliases
        for alias in own:
            if alias in folded:
                out.setdefault(header[folded.index(alias)], name)
                break
    return out


def number(cell: Column, decimal: str = ".") -> Column:
    """The cell as a finite double with ``decimal`` as its mark and the other mark as grouping; null if it is none."""
    text = F.trim(cell)
    grouping = "," if decimal == "." else r"\."
    plain = F.when(text.rlike(rf"^[-+]?\d{{1,3}}({grouping}\d{{3}})+({'\\.' if decimal == '.' else ','}\d+)?$"), F.regexp_replace(text, grouping, "")).otherwise(text)
    value = (plain if decimal == "." else F.regexp_replace(plain, ",", ".")).try_cast("double")
    fit = plain.rlike(r"^[-+]?(\d+([.,]\d*)?|[.,]\d+)([eE][-+]?\d+)?$")
    return F.when(fit & (F.abs(value) < float("inf")), value)


def decimal_mark(rows: DataFrame, columns: Sequence[str]) -> str:
    """The mark that more cells have behind their last digits group; a point if none has."""
    cells = rows.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("c"))
    comma, point = cells.agg(F.sum(F.col("c").rlike(r"^\s*[-+]?\d+,(\d{1,2}|\d{4,})\s*$").cast("long")), F.sum(F.col("c").rlike(r"^\s*[-+]?\d+\.(\d{1,2}|\d{4,})\s*$").cast("long"))).first()
    return "," if (comma or 0) > (point or 0) else "."


def typed(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table, findings) from a table of text cells: canonical columns typed, others as they are; findings (key, column, value,
    code): V003 cells that are no number, V025 cells that begin like a formula."""
    names = canonical_columns([c for c in rows.columns if c != key])
    numeric = [c for c, n in names.items() if n not in TEXT]
    mark = decimal_mark(rows, numeric) if numeric else "."
    gone = F.lower(F.trim(F.col("value"))).isin(*NA)
    columns, found = [F.col(key)], []
    for c in rows.columns:
        if c == key:
            continue
        cell = F.col(f"`{c}`")
        columns.append(number(cell, mark).alias(names[c]) if c in numeric else cell.alias(names.get(c, c)))
        bad = number(cell, mark).isNull() if c in numeric else F.lit(False)
        found.append(F.struct(F.lit(names.get(c, c)).alias("column"), cell.alias("value"), bad.alias("bad"), (cell.rlike(r"^[=+@\t\r-]") & number(cell, mark).isNull()).alias("formula")))
    cells = rows.select(key, F.explode(F.array(*found)).alias("c")).select(key, "c.*").where(F.col("value").isNotNull() & ~gone)
    findings = cells.withColumn("code", F.when(F.col("bad"), "V003").when(F.col("formula"), "V025")).where("code IS NOT NULL")
    return rows.select(*columns), findings.select(key, "column", "value", "code")


#: Encodings that Spark's reader takes itself.
_OWN = ("utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32", "iso-8859-1", "us-ascii")


def read_delimited(spark: SparkSession, path: str, delimiter: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Cells as text under their headers. Files in an encoding that Spark does not read are copied to the shared folder as UTF-8,
    file by file."""
    if encoding.lower() not in _OWN:
        codec = encoding.lower().replace("windows-", "cp")

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([bytes(c.as_py()).decode(codec, "replace") for c in batch.column(0)], pa.string())], ["value"])

        copies = new_folder(spark, "utf8")
        spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "value string").write.option("maxRecordsPerFile", 1).text(copies)
        path, encoding = copies, "UTF-8"
    return spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("multiLine", True).csv(path)


def write_delimited(rows: DataFrame, path: str, delimiter: str = ";") -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)
