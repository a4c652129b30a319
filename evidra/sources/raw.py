"""Raw reading of quoted delimited files: cells as they stand, with quoted line breaks, from files of any size.

Spark cuts a file into byte ranges and these into lines; whether a line begins a record depends on the quotes before it. Each
line, and so each range, maps the state before it (inside a quoted cell or not) to the state behind it. A task follows its
range for both states at once; the ranges' maps, one small row each, are then composed in order, which settles every line.
Records of one line stay where they are; only those of several lines are brought together.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored
from .tables import NA, TEXT, canonical_columns, decimal_mark, number

_LINES = "file string, block long, at long, text string, open_0 boolean, open_1 boolean, ends_0 boolean, ends_1 boolean, head_0 long, head_1 long"

_HEAD = "struct<block: bigint, at: bigint>"


def quote_states(line: str, delimiter: str) -> tuple[bool, bool]:
    """Whether a cell is still open behind the line, for a line that begins outside of a quoted cell and one that begins inside. A quote
    opens a cell only as its first character; doubled, it stands for itself."""
    out = []
    for opened in (False, True):
        at, n = 0, len(line)
        while True:
            if opened:
                end = line.find('"', at)
                while end >= 0 and line[end + 1 : end + 2] == '"':
                    end = line.find('"', end + 2)
                if end < 0:
                    break
                opened, at = False, end + 1  # what follows up to the delimiter belongs to the cell
            elif line[at : at + 1] == '"' and (at == 0 or line[at - 1] == delimiter):
                opened, at = True, at + 1
                continue
            after = line.find(delimiter, at)
            if after < 0 or after >= n:
                break
            at = after + 1
            if line[at : at + 1] == '"':
                opened, at = True, at + 1
        out.append(opened)
    return out[0], out[1]


def _head(block: Column, at: Column, earlier: Column) -> Column:
    return F.when(at.isNotNull(), F.struct(block.alias("block"), at.alias("at"))).otherwise(earlier)


def raw_lines(spark: SparkSession, path: str, delimiter: str = ";") -> DataFrame:
    """(file, block, at, text, opened, closes_open, head) of each physical line, without its line feed: ``block`` is where its byte range
    starts, ``at`` its number within the range, ``opened`` and ``closes_open`` whether it begins and ends inside a quoted cell, and
    ``head`` (block, at) the line that its record begins with. A task knows the heads of its own range for both states, and a line
    before the first of them belongs to the last head of the ranges before."""
    given = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, states, heads = None, 0, (False, True), [None, None]
        for batch in batches:
            rows = []
            for file, block, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (file, block) != last:
                    last, at, states, heads = (file, block), 0, (False, True), [None, None]
                if block == 0 and at == 0:
                    text = text.removeprefix("﻿")
                behind = quote_states(text, delimiter)
                after = (behind[states[0]], behind[states[1]])
                heads = [head if opened else at for opened, head in zip(states, heads, strict=True)]
                rows.append((file, block, at, text, *states, *after, *heads))
                states, at = after, at + 1
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), *(pa.bool_(),) * 4, pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _LINES.split(", ")])

    lines = stored(given.mapInArrow(follow, _LINES), "raw-lines")
    ranges = lines.groupBy("file", "block").agg(*[F.max_by(c, "at").alias(c) for c in ("ends_0", "ends_1", "head_0", "head_1")])
    # A row for each range of a file, in order: the state and the record before each from those behind the ones before it.
    folded = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "ends_0", "ends_1", "head_0", "head_1"))).alias("r")).select(
        "file",
        F.aggregate(
            "r", F.struct(F.lit(False).alias("state"), F.lit(None).cast(_HEAD).alias("head"), F.expr(f"cast(array() AS array<struct<block: bigint, state: boolean, head: {_HEAD}>>)").alias("found")),
            lambda s, x: F.struct(
                F.when(s.state, x.ends_1).otherwise(x.ends_0).alias("state"), _head(x.block, F.when(s.state, x.head_1).otherwise(x.head_0), s.head).alias("head"),
                F.concat(s.found, F.array(F.struct(x.block.alias("block"), s.state.alias("state"), s.head.alias("head")))).alias("found"),
            ),
        ).found.alias("found"),
    )
    before = folded.select("file", F.explode("found").alias("f")).select("file", "f.block", "f.state", F.col("f.head").alias("earlier"))
    own = lines.join(F.broadcast(before), ["file", "block"])  # a row for each range
    of = lambda name: F.when(F.col("state"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
    return own.select("file", "block", "at", "text", of("open").alias("opened"), of("ends").alias("closes_open"), _head(F.col("block"), of("head"), F.col("earlier")).alias("head"))


def raw_records(spark: SparkSession, path: str, delimiter: str = ";") -> DataFrame:
    """(file, block, at, text, cells, complete) of each record, in the order of block and at within a file: its text with its line
    breaks, and its cells. Empty lines are records without a cell. A quoted cell that nothing closes takes the rest of its file;
    that record is not ``complete``."""
    lines = raw_lines(spark, path, delimiter)
    whole = lines.where("NOT opened AND NOT closes_open").select("file", "block", "at", "text", F.lit(True).alias("complete"))
    joined = lines.where("opened OR closes_open").groupBy("file", "head").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text", "closes_open"))).alias("l"))
    several = joined.select("file", F.col("head.block").alias("block"), F.col("head.at").alias("at"), F.array_join(F.transform("l", lambda x: x.text), "\n").alias("text"), (~F.element_at("l", -1).closes_open).alias("complete"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            cells = [next(csv.reader([text.removesuffix("\r")], delimiter=delimiter), []) if "\n" not in text else next(csv.reader(text.removesuffix("\r").splitlines(keepends=True), delimiter=delimiter), []) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.string()))], [*batch.schema.names, "cells"])

    return whole.union(several).mapInArrow(cut, "file string, block long, at long, text string, complete boolean, cells array<string>")


def write_raw(records: DataFrame, path: str) -> None:
    """The records' texts as part files whose names are in order: put one after the other, they are the file that was read, up to a
    line feed at its end."""
    places = ["file", "block", "at"]
    records.repartitionByRange(*places).sortWithinPartitions(*places).select("text").write.option("lineSep", "\n").text(path)


def _is_blank(cells: str) -> Column:
    return F.forall(cells, lambda c: F.trim(c) == "")


def headed(records: DataFrame) -> tuple[list[str], DataFrame]:
    """(header, rows): the first record that is not blank, which all files must share, and the other records that are not blank. A
    doubled name gets a number behind it."""
    filled = stored(records.where(~_is_blank("cells")), "raw-filled")
    first = filled.groupBy("file").agg(F.min(F.struct("block", "at", "cells")).alias("first"))
    headers = first.select("first.cells").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ValueError("the files have different headers")
    names: list[str] = []
    for name in headers[0][0] if headers else []:
        n = names.count(name)
        names.append(name if not n else f"{name}.{n + 1}")
    rows = filled.join(first.select("file", F.col("first.block").alias("b"), F.col("first.at").alias("a")), "file").where("NOT (block = b AND at = a)").drop("a", "b")
    return names, rows


_GROUPED = r"^[-+]?\d{1,3}([.,])\d{3}$"
COUNTS = ("n1", "n2", "e1", "e2", "n", "x")


def raw_findings(header: Sequence[str], rows: DataFrame, delimiter: str, needed: Sequence[str] = ()) -> DataFrame:
    """(file, block, at, column, value, code) of the raw table: V028 a column that means the same as one before it (a row of nulls for
    its place), V024 a row with more or fewer cells than the header, V023 a number that may be grouped or decimal, V003 and V021 a
    cell that is no number in a column that is ``needed`` and in another. Rows of V024 are not looked at further."""
    spark = rows.sparkSession
    plain = [re.sub(r"\.\d+$", "", h) for h in header]
    names = canonical_columns(header)
    taken = {v: h for h, v in names.items()}
    doubled = [h for h, p in zip(header, plain, strict=True) if h not in names and canonical_columns([p]).get(p) in taken]
    schema = "file string, block long, at long, column string, value string, code string"
    out = spark.createDataFrame([(None, None, None, h, None, "V028") for h in doubled], schema)
    n = len(header)
    ragged = rows.where(F.size("cells") != n).select("file", "block", "at", F.lit(None).cast("string").alias("column"), F.size("cells").cast("string").alias("value"), F.lit("V024").alias("code"))
    straight = rows.where(F.size("cells") == n)
    numeric = [(k, names[h]) for k, h in enumerate(header) if names.get(h, "study") not in TEXT]
    if not numeric:
        return out.union(ragged)
    table = straight.select(*[F.col("cells")[k].alias(f"c{k}") for k, _ in numeric])
    cells = F.explode(F.array(*[F.col(f"c{k}") for k, _ in numeric]))
    marks = {r[0] for r in table.select(cells.alias("c")).where(F.col("c").rlike(r"^\s*[-+]?\d+[.,](\d{1,2}|\d{4,})\s*$")).select(F.regexp_extract("c", "([.,])", 1)).distinct().collect()}
    mark = decimal_mark(table, [f"c{k}" for k, _ in numeric])
    asked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("cells")[k].alias("value"), F.lit(c in needed).alias("needed"), F.lit(c in COUNTS).alias("count")) for k, c in numeric]))
    each = straight.select("file", "block", "at", asked.alias("e")).select("file", "block", "at", "e.*").where(~F.lower(F.trim("value")).isin(*NA))
    value = F.trim("value")
    usual = "," if delimiter == ";" else "."
    # One mark before three digits: unclear if no other cell shows the file's mark, the column holds no counts and it is not the usual mark.
    unclear = value.rlike(_GROUPED) & ~F.col("count") & (F.regexp_extract(value, _GROUPED, 1) != usual) if len(marks) != 1 else F.lit(False)
    code = F.when(unclear, "V023").when(number(F.col("value"), mark).isNull(), F.when(F.col("needed"), "V003").otherwise("V021"))
    found = each.withColumn("code", code).where("code IS NOT NULL").select("file", "block", "at", "column", "value", "code")
    return out.union(ragged).union(found)
