"""Tables of reports as grids: cells that span rows and columns are laid out, headers inferred and rows read as studies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.sources.shared import stored

#: Fixed value of HTML: no cell is wider than this.
WIDEST = 1000
#: Rows of a table that are looked at together while sections are found.
BLOCK = 4096
#: Cells of one section beyond which it is laid out cell by cell as it comes; so are sections of more than SIDE_MOST cells or columns or
#: more than SIDE_PLACES places.
SIDE_CELLS, SIDE_MOST, SIDE_PLACES = 4096, 256, 200_000
#: A table with more leading rows of head cells than this has one header row, the first.
MOST_HEADS = 16
#: What the header of the column of studies says.
STUDY_HEAD = r"^(first )?(study|studies|trial|author|authors|reference|source|citation)\b"
_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)


def sections(cells: DataFrame) -> DataFrame:
    """(table_id, row, section, last) of the rows of ``cells`` (table_id, row, rowspan, ...): ``section`` is the first row of the stretch
    of rows that no span leaves or enters, so stretches can be laid out apart; ``last`` is the table's last row.

    Maxima run over blocks of BLOCK rows and then over the blocks, so a table of any length is many tasks."""
    span = F.greatest(F.coalesce(F.col("rowspan"), F.lit(1)), F.lit(0)).cast("long")
    far = F.when(span == 0, F.lit(2**62)).otherwise(F.col("row") + span)  # a span of 0 goes to the table's end
    rows = cells.where("table_id IS NOT NULL AND row IS NOT NULL").groupBy("table_id", "row").agg(F.max(far).alias("reach"))
    rows = rows.withColumn("block", F.floor(F.col("row") / BLOCK))
    by_block = Window.partitionBy("table_id").orderBy("block")
    within = Window.partitionBy("table_id", "block").orderBy("row")
    blocks = rows.groupBy("table_id", "block").agg(F.max("reach").alias("reach"), F.max("row").alias("last"))
    blocks = blocks.select(
        "table_id", "block", F.max("reach").over(by_block.rowsBetween(*_BEFORE)).alias("before"),
        F.max("last").over(Window.partitionBy("table_id")).alias("last"),
    )
    earlier = F.greatest("before", F.max("reach").over(within.rowsBetween(*_BEFORE)))
    rows = rows.join(blocks, ["table_id", "block"]).withColumn("earlier", earlier)
    rows = rows.withColumn("start", F.when(F.col("earlier").isNull() | (F.col("earlier") <= F.col("row")), F.col("row")))
    starts = rows.groupBy("table_id", "block").agg(F.max("start").alias("start"))
    starts = starts.select("table_id", "block", F.max("start").over(by_block.rowsBetween(*_BEFORE)).alias("open"))
    rows = rows.join(starts, ["table_id", "block"])
    section = F.coalesce(F.max("start").over(within.rowsBetween(*_SO_FAR)), "open")
    return rows.select("table_id", "row", section.alias("section"), "last")


def laid_out(cells: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(table_id, row, col, text, head, from_row, from_col) of cells (table_id, row, place, text, rowspan, colspan, head): each place of
    the grid that a cell covers, by HTML's rule: cells of a row take the first free columns in the order of ``place`` (ties: text).

    A span of rows ends with the table, 0 means up to there; missing or negative spans are 1; a cell is at most WIDEST columns
    wide. Where a wide cell meets one from above, the upper cell keeps its place as long as it lasts. Rows without a cell of their own that lie below a
    span are part of the grid. Cells without table or row are no part of one, null texts are empty. A task holds the open spans of
    one row only, whatever a table's length.

    Tables within BLOCK rows are cut into sections as they come, so their cells are shuffled once, or not at all where they lie
    table by table; longer ones are many tasks. Which are longer is read from ``rows`` (table_id, row), the cells' own or a table that
    is read faster."""
    keyed = cells.where("table_id IS NOT NULL AND row IS NOT NULL").select(
        "table_id", F.col("row").cast("long").alias("row"), "place", F.coalesce("text", F.lit("")).alias("text"),
        F.greatest(F.coalesce(F.col("rowspan"), F.lit(1)), F.lit(0)).cast("long").alias("rowspan"),
        F.least(F.greatest(F.coalesce(F.col("colspan"), F.lit(1)), F.lit(1)), F.lit(WIDEST)).cast("int").alias("colspan"),
        F.coalesce("head", F.lit(False)).alias("head"),
    )
    kind = dict(keyed.dtypes)["table_id"]
    schema = f"table_id {kind}, row long, col int, text string, head boolean, from_row long, from_col int"
    long = (cells if rows is None else rows).where((F.col("row") < 0) | (F.col("row") >= BLOCK)).select("table_id").where("table_id IS NOT NULL").distinct()
    some_long = not long.isEmpty()
    if some_long:
        long = stored(long, "long-tables")
        short, keyed = (keyed.join(long, "table_id", how) for how in ("left_anti", "left_semi"))
    else:
        short = keyed
    order = Window.partitionBy("table_id").orderBy("row", "place", "text")
    last = F.max("row").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    short = _until(short.withColumn("last", last)).sortWithinPartitions("table_id", "row", "place", "text")
    found = short.mapInArrow(_lay_tables, schema)
    if not some_long:
        return found
    # Merge: rows of few values look small enough to send to the driver, in their compressed form.
    keyed = _until(keyed.join(sections(keyed).hint("merge"), ["table_id", "row"]), "section")
    ordered = keyed.repartition("table_id", "section").sortWithinPartitions("table_id", "section", "row", "place", "text")
    return found.union(ordered.mapInArrow(_lay, schema))


def _until(keyed: DataFrame, *more: str) -> DataFrame:
    """Cells with the row before which they end, within their table."""
    end = F.when(F.col("rowspan") == 0, F.col("last") + 1).otherwise(F.least(F.col("row") + F.col("rowspan"), F.col("last") + 1))
    return keyed.select("table_id", *more, "row", "place", "text", end.alias("until"), "colspan", "head")


def _lay_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grid of whole tables, rows 0 to BLOCK - 1, whose cells come in order: a section begins in a row that no cell before reaches."""

    def cut() -> Iterator[pa.RecordBatch]:
        key, at, reach, section = None, -1, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table_id = batch.column(0)
            row, until = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            begins = np.ones(row.size, bool)
            begins[1:] = pc.not_equal(table_id.slice(1), table_id.slice(0, row.size - 1)).to_numpy(zero_copy_only=False)
            begins[0] = key is None or table_id[0].as_py() != key
            base = np.cumsum(begins) * (BLOCK + 1)  # tables lie one above the other, the one that goes on below all
            reached = np.maximum.accumulate(np.concatenate(([reach], base + until)))
            starts = (begins | (row != np.concatenate(([at], row[:-1])))) & (reached[:-1] <= base + row)
            of = np.maximum.accumulate(np.where(starts, np.arange(row.size), -1))
            sections_of = np.where(of >= 0, row[of], section)
            key, at, reach, section = table_id[row.size - 1].as_py(), row[-1], reached[-1] - base[-1], sections_of[-1]
            yield pa.RecordBatch.from_arrays([table_id, pa.array(sections_of), *batch.columns[1:]], ["table_id", "section", *batch.schema.names[1:]])

    return _lay(cut())


_PLACES = ["table_id", "row", "col", "text", "head", "from_row", "from_col"]


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grid of cells in order: small sections of some tens of thousands of cells side by side, others cell by cell."""
    held: list[pa.RecordBatch] = []  # cells of the last section so far
    waiting, key = 0, None

    def scalar() -> Iterator[pa.RecordBatch]:
        """The long section, whose cells come in as long as it goes on."""
        while True:
            while held:
                yield held.pop(0)
            try:
                batch = next(incoming)
            except StopIteration:
                return
            same = _section_starts(batch, key)
            stop = int(same[0]) if same.size else batch.num_rows
            if stop:
                yield batch.slice(0, stop)
            if stop < batch.num_rows:
                rest.append(batch.slice(stop))
                return

    incoming, rest = iter(batches), []
    while True:
        batch = rest.pop() if rest else next(incoming, None)
        if batch is None:
            break
        if not batch.num_rows:
            continue
        starts = _section_starts(batch, key)
        last = int(starts[-1]) if starts.size else 0
        if starts.size:
            # All before the last section that begins here is whole.
            if last:
                held.append(batch.slice(0, last))
            if held:
                yield from _lay_whole(pa.Table.from_batches(held).combine_chunks())
            held, waiting = [], 0
        held.append(batch.slice(last))
        waiting += batch.num_rows - last
        key = _section_key(batch, batch.num_rows - 1)
        if waiting > SIDE_CELLS:
            yield from _lay_cells(scalar())
            held, waiting, key = [], 0, None
    if held:
        yield from _lay_whole(pa.Table.from_batches(held).combine_chunks())


def _section_key(batch: pa.RecordBatch, at: int) -> tuple:
    return batch.column(0)[at].as_py(), batch.column(1)[at].as_py()


def _section_starts(batch: pa.RecordBatch | pa.Table, key: tuple | None) -> np.ndarray:
    """The places at which a section begins, after one of ``key``."""
    first = np.ones(batch.num_rows, bool)
    if batch.num_rows:
        a, b = batch.column(0), batch.column(1)
        first[1:] = pc.or_(pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)), pc.not_equal(b.slice(1), b.slice(0, len(b) - 1))).to_numpy(zero_copy_only=False)
        first[0] = _section_key(batch, 0) != key
    return np.flatnonzero(first)


def _lay_whole(cells: pa.Table) -> Iterator[pa.RecordBatch]:
    """The places of whole sections. A cell's column is the first from where the row has come to that no cell above takes; a place is
    that of the first cell that covers it. So sections are laid out side by side, a cell of each at a time, and then all places."""
    starts = _section_starts(cells, None)
    counts = np.diff(np.append(starts, cells.num_rows))
    row, until, width = (cells.column(c).to_numpy() for c in ("row", "until", "colspan"))
    width = width.astype(np.int64)
    columns = np.add.reduceat(width, starts)
    places = np.add.reduceat((until - row).astype(np.float64) * width, starts)
    small = (counts <= SIDE_MOST) & (columns <= SIDE_MOST) & (places <= SIDE_PLACES)
    for k in np.flatnonzero(~small):
        yield from _lay_cells(iter(cells.slice(int(starts[k]), int(counts[k])).to_batches()))
    picked = np.flatnonzero(small)
    ends = np.cumsum(places[picked]) // SIDE_PLACES
    for part in np.split(picked, np.flatnonzero(np.diff(ends)) + 1):
        if part.size:
            yield from _lay_side_by_side(cells, starts[part], counts[part], row, until, width, int(columns[part].max()))


def _lay_side_by_side(cells: pa.Table, starts: np.ndarray, counts: np.ndarray, row: np.ndarray, until: np.ndarray, width: np.ndarray, n_columns: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    ends = np.full((starts.size, n_columns), np.iinfo(np.int64).min)  # where the cells above end
    free, at = np.zeros(starts.size, np.int64), np.full(starts.size, -1)
    column = np.arange(n_columns)
    first = np.zeros(cells.num_rows, np.int64)
    for k in range(int(counts[0])):
        n = int(np.searchsorted(-counts, -k, "left"))  # sections of more than k cells
        cell = starts[:n] + k
        here = row[cell]
        begun = np.where((here == at[:n]) & (k > 0), free[:n], 0)
        at[:n] = here
        found = ((ends[:n] <= here[:, None]) & (column >= begun[:, None])).argmax(axis=1)
        first[cell] = found
        free[:n] = found + width[cell]
        over = (column >= found[:, None]) & (column < free[:n, None])
        np.maximum(ends[:n], np.where(over, until[cell][:, None], ends[:n]), out=ends[:n])
    own = np.sort(np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    by_section = np.sort(starts)
    section = np.searchsorted(by_section, own, "right") - 1
    many = (until[own] - row[own]) * width[own]
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    source, wide = np.repeat(own, many), np.repeat(width[own], many)
    down, col = row[source] + offset // wide, first[source] + offset % wide
    base = row[by_section][section]
    height = int((until[own] - base).max())
    place = (np.repeat(section, many) * height + down - np.repeat(base, many)) * n_columns + col
    keep = np.unique(place, return_index=True)[1]
    source, down, col = source[keep], down[keep], col[keep]
    for start in range(0, source.size, 20000):
        part = slice(start, start + 20000)
        taken = cells.select(["table_id", "text", "head"]).take(pa.array(source[part])).combine_chunks()
        table_id, text, head = (taken.column(c).combine_chunks() for c in taken.column_names)
        yield pa.RecordBatch.from_arrays([table_id, pa.array(down[part]), pa.array(col[part].astype(np.int32)), text, head, pa.array(row[source[part]]), pa.array(first[source[part]].astype(np.int32))], _PLACES)


def _lay_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_spans: dict[int, list[tuple]] = {}  # column: (until, text, head, from_row, from_col), the first has the place, each ends later
    taken: set[int] = set()  # columns of the present row
    key = row = None
    free = 0
    out: list[tuple] = []
    kinds = None

    def covered(at: int) -> None:
        """The places of row ``at`` that spans from above take."""
        nonlocal free
        taken.clear()
        free = 0
        for col in sorted(open_spans):
            left = [s for s in open_spans[col] if s[0] > at]
            if not left:
                del open_spans[col]
                continue
            open_spans[col] = left
            out.append((key[0], at, col, *left[0][1:]))
            taken.add(col)

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _PLACES)

    def rows_until(stop: int | None) -> Iterator[pa.RecordBatch]:
        """Rows below the present one in which only spans lie."""
        at = row + 1
        while open_spans and (stop is None or at < stop):
            covered(at)
            at += 1
            if len(out) >= 20000:
                yield batch()

    for cells in batches:
        kinds = [cells.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int32()]
        columns = [cells.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7)]
        for table_id, section, at, text, until, width, head in zip(*columns, strict=True):
            if key != (table_id, section):
                if key is not None:
                    yield from rows_until(None)
                key, row = (table_id, section), at
                open_spans.clear()
                covered(at)
            elif at != row:
                yield from rows_until(at)
                row = at
                covered(at)
            while free in taken:
                free += 1
            first = free
            for col in range(first, first + width):
                if col not in taken:
                    taken.add(col)
                    out.append((table_id, at, col, text, head, at, first))
                spans = open_spans.get(col)
                if until > at + 1 and (not spans or until > spans[-1][0]):
                    open_spans.setdefault(col, []).append((until, text, head, at, first))
            free = first + width
            if len(out) >= 20000:
                yield batch()
    if key is not None:
        yield from rows_until(None)
    if out:
        yield batch()


def header_rows(grid: DataFrame) -> DataFrame:
    """(table_id, first, body) of each table of a grid: its first row and the first row that is no header. Headers are the leading rows
    of head cells; without one, the first row if it has a text, no number, and a number stands below it. More than MOST_HEADS head
    rows, or nothing but head rows, mean that the first alone is the header."""
    number = F.col("text").rlike(r"^\s*[-+]?\d+([.,]\d+)?\s*%?\s*$")
    # What holds of a row is asked for as the least or greatest row of which it holds: one aggregate by table, and no rows between.
    row_if = lambda condition: F.when(condition, F.col("row"))
    opening = grid.groupBy("table_id").agg(
        F.min("row").alias("first"), F.min(row_if(~F.col("head"))).alias("plain"), F.min(row_if(number)).alias("number"), F.max(row_if(number)).alias("lowest_number"),
        F.min(row_if(F.trim("text") != "")).alias("said"),
    )
    levels = F.col("plain") - F.col("first")
    in_first = lambda c: F.coalesce(F.col(c) == F.col("first"), F.lit(False))
    inferred = in_first("said") & ~in_first("number") & F.coalesce(F.col("lowest_number") > F.col("first"), F.lit(False))
    body = F.when(F.col("plain").isNull() | (levels > MOST_HEADS), F.col("first") + 1).when(levels > 0, F.col("plain"))
    return opening.select("table_id", "first", body.when(inferred, F.col("first") + 1).otherwise(F.col("first")).alias("body"))


def column_heads(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, col, path): the header texts above a column from the top, joined by " > ", a text that spans rows once; columns
    without a header have the empty path. ``headers`` as of ``header_rows``: below the first row, only head cells are headers."""
    own = F.struct("row", "text", "from_row", "from_col")
    # Below its top cell, a column's headers are head cells; the others stay where they are.
    tops = grid.groupBy("table_id", "col").agg(F.min(own).alias("own"))
    below = grid.where(F.col("head") & (F.col("row") == F.col("from_row")) & (F.trim("text") != "")).select("table_id", "col", own.alias("own"))
    cells = tops.union(below).join(headers.select("table_id", "body").hint("merge"), "table_id")
    above = F.array_sort(F.collect_set(F.when((F.col("own.row") < F.col("body")) & (F.col("own.row") == F.col("own.from_row")), F.col("own"))))
    said = F.filter(F.transform(above, lambda c: F.trim(c["text"])), lambda t: t != "")
    return cells.groupBy("table_id", "col").agg(F.array_join(said, " > ").alias("path"))


def study_rows(grid: DataFrame, headers: DataFrame, heads: DataFrame) -> DataFrame:
    """(table_id, row, label, surname, year) of body rows: the label is the cell of the column of studies, the first of the first three
    whose lowest header names studies, else column 0. Rows in which it hangs down from above are parts of the row it began in and
    have no row of their own here. Surname and year are those of labels like "Smith 2001", "Smith et al., 2001a", else null."""
    lowest = F.lower(F.trim(F.element_at(F.split("path", " > "), -1)))
    named = heads.where(F.col("col") < 3).groupBy("table_id").agg(F.min(F.when(lowest.rlike(STUDY_HEAD), F.col("col"))).alias("named"))
    place = headers.join(named.hint("merge"), "table_id", "left").select("table_id", "body", F.coalesce("named", F.lit(0)).alias("__col"))
    rows = grid.where((F.col("col") < 3) & (F.col("row") == F.col("from_row")) & (F.trim("text") != "")).select("table_id", "row", "col", "text")
    rows = rows.join(place.hint("merge"), "table_id").where("col = __col AND row >= body")
    label = F.trim("text")
    said = author_year(label)
    return rows.select("table_id", "row", label.alias("label"), said["surname"].alias("surname"), said["year"].alias("year")).where("label <> ''")


#: A surname, others or a second author, and a year.
AUTHOR_YEAR = r"^((?:(?:van|von|de|der|den|la|le|du|di|da) )*\p{Lu}[\p{L}'’-]+)(?: [A-Z]{1,3})?(?:,? et al\.?| (?:and|&) [\p{L}'’-]+)?,? \(?((?:18|19|20)\d{2})[a-z]?\)?$"


def author_year(label: Column) -> Column:
    """A structure of surname (lower case) and year of a label, nulls where it has another form."""
    surname = F.nullif(F.lower(F.regexp_extract(label, AUTHOR_YEAR, 1)), F.lit(""))
    return F.struct(surname.alias("surname"), F.regexp_extract(label, AUTHOR_YEAR, 2).try_cast("int").alias("year"))


def reference_numbers(mark: Column) -> Column:
    """The numbers that a mark such as "3, 5-7" names, distinct and sorted; ranges that run backwards or over more than 500 numbers
    name their two ends only."""
    parts = F.regexp_extract_all(mark, F.lit(r"(\d{1,9}(?:\s*[-–]\s*\d{1,9})?)"), F.lit(1))

    def numbers(part: Column) -> Column:
        a = F.regexp_extract(part, r"^(\d+)", 1).cast("int")
        b = F.regexp_extract(part, r"(\d+)$", 1).cast("int")
        return F.when((b >= a) & (b - a <= 500), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


#: "We included twelve trials [3-14]", "12 studies were included (refs 3-14)": the count and the mark.
_COUNT = r"(\d{1,4}|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
WORDS = "two three four five six seven eight nine ten eleven twelve".split()
_THINGS = r"(?:\w+ ){0,3}(?:studies|trials|articles|rcts|reports)"
STATEMENTS = (
    rf"(?i)\b(?:included|identified and included) {_COUNT} {_THINGS}[^\[.]*\[([0-9, –-]+)\]",
    rf"(?i)\b{_COUNT} {_THINGS} (?:were|was|are) included[^\[.]*\[([0-9, –-]+)\]",
)


def statements(sentences: DataFrame) -> DataFrame:
    """(review, n_said, refs) of sentences (review, sentence) that say how many studies are included and cite them."""
    found = None
    for pattern in STATEMENTS:
        said = F.lower(F.regexp_extract("sentence", pattern, 1))
        number = F.array_position(F.array(*[F.lit(w) for w in WORDS]), said)
        n = F.coalesce(said.try_cast("int"), F.when(number > 0, number.cast("int") + 1))
        refs = reference_numbers(F.regexp_extract("sentence", pattern, 2))
        one = F.when(F.col("sentence").rlike(pattern), F.struct(n.alias("n_said"), refs.alias("refs")))
        found = one if found is None else F.coalesce(found, one)
    return sentences.where("sentence IS NOT NULL").select("review", found.alias("s")).where("s IS NOT NULL").select("review", "s.n_said", "s.refs")


def inclusion(references: DataFrame, claims: DataFrame, said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What reviews include, and how complete that is.

    ``references`` (review, ref, section): the reviews' lists; ``claims`` (review, ref, strategy): rows of tables of included studies
    ("a2") or of data ("a3"); ``said`` as of ``statements``. References in a section "included" are claims of the strategy "a1".
    A statement is believed if its references are as many as it says, or two at least and half of that; it names new studies
    where a review has no other claim, or, without a1, where it is consistent and says more than the other strategies found; else
    it only confirms. Claims of references that the review lists as excluded or doesn't list don't count.

    Returns (review, ref, role, strategy, n_strategies): every included reference by its first strategy (a1, a2, a3, a4) and the
    number of strategies that agree, and, for reviews with none, all references with the role "unknown"; and (review, n_said,
    n_found, complete) of all reviews with references, the greatest believed number said or null."""
    # One row a reference with all that is said of it, written once: strategies are columns, not rows that meet again and again.
    no = F.lit(False)
    flag = lambda column, value: F.coalesce(F.col(column) == value, no).alias(value)
    rows = references.select("review", "ref", F.lit(True).alias("listed"), flag("section", "included"), flag("section", "excluded"), no.alias("a2"), no.alias("a3"))
    rows = rows.union(claims.select("review", "ref", no, no, no, flag("strategy", "a2"), flag("strategy", "a3")))
    marks = rows.where("review IS NOT NULL AND ref IS NOT NULL").groupBy("review", "ref").agg(*[F.bool_or(c).alias(c) for c in ("listed", "included", "excluded", "a2", "a3")]).where("listed")
    counted = F.col("included") | ~F.col("excluded")
    marks = stored(marks.select("review", "ref", counted.alias("counted"), F.col("included").alias("a1"), (F.col("a2") & counted).alias("a2"), (F.col("a3") & counted).alias("a3")), "marks")
    found = marks.where("a1 OR a2 OR a3").groupBy("review").agg(F.count(F.lit(1)).alias("n_firm"), F.bool_or("a1").alias("has_a1"))
    n = F.size("refs")
    said = stored(said.select("review", "n_said", "refs"), "statements")
    believed = said.where((n == F.col("n_said")) | ((n >= 2) & (2 * n >= F.col("n_said"))))
    believed = believed.join(found, "review", "left").withColumn(
        "creates", F.col("n_firm").isNull() | (~F.col("has_a1") & (n == F.col("n_said")) & (F.col("n_said") > F.col("n_firm")))
    )
    told = believed.select("review", F.explode("refs").alias("ref"), "creates").groupBy("review", "ref").agg(F.bool_or("creates").alias("creates"))
    a4 = F.col("counted") & F.col("creates").isNotNull()
    every = marks.join(told, ["review", "ref"], "left").withColumn("a4", a4)
    strategies = ("a1", "a2", "a3", "a4")
    every = stored(every.select(
        "review", "ref", F.coalesce(*[F.when(F.col(c), c) for c in strategies]).alias("strategy"), sum(F.col(c).cast("long") for c in strategies).alias("n_strategies"),
        F.expr("a1 OR a2 OR a3 OR (a4 AND creates)").alias("voted"),
    ), "votes")
    votes = every.where("voted").select("review", "ref", F.lit("included").alias("role"), "strategy", "n_strategies")
    counts = votes.groupBy("review").agg(F.count(F.lit(1)).alias("n_found"))
    unknown = every.join(counts.select("review"), "review", "left_anti")
    unknown = unknown.select("review", "ref", F.lit("unknown").alias("role"), F.lit("list").alias("strategy"), F.lit(0).cast("long").alias("n_strategies"))
    most = believed.groupBy("review").agg(F.max("n_said").alias("n_said"))
    whole = every.select("review").distinct().join(most, "review", "left").join(counts, "review", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    complete = F.when(F.col("n_said").isNotNull(), F.col("n_found") >= F.col("n_said"))
    return votes.unionByName(unknown), whole.select("review", "n_said", "n_found", complete.alias("complete"))
