"""Grids of tables with spans, headers, studies and inclusion against plain versions; citations and levels."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidra.functions import citations
from evidra.operators import grids
from evidra.plans import catalog, catalog_tables

from .conftest import SF

CELLS = "table_id int, row int, place int, text string, rowspan int, colspan int, head boolean"


def laid_out_plainly(cells):
    """HTML's rule, on a whole table at a time."""
    out = set()
    for table_id in {c[0] for c in cells}:
        own = [c for c in cells if c[0] == table_id]
        last, grid = max(c[1] for c in own), {}
        for _, row, place, text, down, wide, head in sorted(own, key=lambda c: (c[1], c[2], c[3] or "")):
            down, wide = max(1 if down is None else down, 0), min(max(1 if wide is None else wide, 1), grids.WIDEST)
            col = 0
            while (row, col) in grid:
                col += 1
            for r in range(row, last + 1 if down == 0 else min(row + down, last + 1)):
                for c in range(col, col + wide):
                    grid.setdefault((r, c), (text or "", bool(head), row, col))
        out |= {(table_id, r, c, *v) for (r, c), v in grid.items()}
    return out


def some_cells(seed, tables=12, rows=14):
    rnd = random.Random(seed)
    cells = []
    for t in range(tables):
        for row in range(rnd.randint(1, rows)):
            if rnd.random() < 0.15:
                continue
            for place in range(rnd.randint(1, 4)):
                cells.append((t, row, place, rnd.choice(["a", "7", "", None]), rnd.choice([None, 0, 1, 1, 1, 2, 3, 50]), rnd.choice([None, 1, 1, 2, 3]), rnd.choice([None, False, True])))
    return cells


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_grid_is_that_of_a_whole_table(spark, monkeypatch, block, seed):
    monkeypatch.setattr(grids, "BLOCK", block)
    cells = some_cells(seed)
    found = grids.laid_out(spark.createDataFrame(cells, CELLS)).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == laid_out_plainly(cells)


def test_sections_cut_where_no_span_crosses(spark):
    cells = [(1, r, 0, "x", 3 if r in (2, 4) else 1, 1, False) for r in range(9)]
    found = {r.row: r.section for r in grids.sections(spark.createDataFrame(cells, CELLS)).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 7, 8: 8}


def test_grid_of_nothing_and_of_null_keys(spark):
    assert grids.laid_out(spark.createDataFrame([], CELLS)).collect() == []
    odd = [(None, 0, 0, "a", 1, 1, False), (1, None, 0, "a", 1, 1, False), (1, 0, 0, None, -3, 5000, None)]
    found = grids.laid_out(spark.createDataFrame(odd, CELLS).withColumn("section", F.lit("clash"))).collect()
    assert len(found) == grids.WIDEST and {r.text for r in found} == {""}


@pytest.mark.parametrize("limits", [(4096, 256, 200_000), (10, 256, 60), (3, 6, 12)])
@pytest.mark.parametrize("rows_of_batch", [1, 7, 1000])
def test_sections_side_by_side_are_those_laid_out_one_by_one(monkeypatch, limits, rows_of_batch):
    for name, value in zip(("SIDE_CELLS", "SIDE_MOST", "SIDE_PLACES"), limits, strict=True):
        monkeypatch.setattr(grids, name, value)
    cells = []
    for t, row, place, text, down, wide, head in sorted(some_cells(5, tables=20), key=lambda c: c[:3]):
        cells.append((t, t % 3, row, place, text or "", row + (down or 1), wide or 1, bool(head)))
    names = ["table_id", "section", "row", "place", "text", "until", "colspan", "head"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int32(), pa.bool_()]
    whole = pa.table([pa.array(c, k) for c, k in zip(zip(*cells, strict=True), kinds, strict=True)], names=names)
    rows = lambda batches: [tuple(r.values()) for b in batches for r in b.to_pylist()]
    found = rows(grids._lay(iter(whole.to_batches(max_chunksize=rows_of_batch))))
    assert len(found) == len(set(found)) and set(found) == set(rows(grids._lay_cells(iter(whole.to_batches()))))


def test_many_small_sections_take_few_steps(monkeypatch):
    """Ten thousand tables of three rows: none is laid out cell by cell."""
    monkeypatch.setattr(grids, "_lay_cells", None)
    n = 30_000
    of, row = [k // 3 for k in range(n)], [k % 3 for k in range(n)]
    cells = pa.table([of, [0] * n, row, [0] * n, ["x"] * n, pa.array([3 if r == 0 else r + 1 for r in row], pa.int64()), pa.array([2] * n, pa.int32()), [False] * n], names=["table_id", "section", "row", "place", "text", "until", "colspan", "head"])
    found = pa.Table.from_batches(grids._lay(iter(cells.to_batches(max_chunksize=5000))))
    assert found.num_rows == 10_000 * (6 + 4)


def test_headers(spark):
    t = [
        (1, 0, 0, "Study", 1, 1, True), (1, 1, 0, "x", 1, 1, True), (1, 2, 0, "1", 1, 1, False),
        (2, 0, 0, "Study", 1, 1, False), (2, 1, 0, "5 %", 1, 1, False),
        (3, 0, 0, "4", 1, 1, False), (3, 1, 0, "5", 1, 1, False),
        (4, 0, 0, "a", 1, 1, False), (4, 1, 0, "b", 1, 1, False),
        (5, 3, 0, "a", 1, 1, True), (5, 4, 0, "b", 1, 1, True),
    ]
    t += [(6, r, 0, "h", 1, 1, r < 40) for r in range(50)]
    grid = grids.laid_out(spark.createDataFrame(t, CELLS))
    assert {r.table_id: (r.first, r.body) for r in grids.header_rows(grid).collect()} == {1: (0, 2), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (3, 4), 6: (0, 1)}


def test_query_grid_and_studies(spark):
    cells = [tuple(r) for r in catalog_tables.spanned_cells(spark, SF).select("table_id", "row", "place", "text", "rowspan", "colspan", "head").collect()]
    plain = laid_out_plainly(cells)
    assert {tuple(r) for r in catalog.QUERIES["table_grid"](spark, SF).collect()} == plain
    studies = {(r.table_id, r.row): (r.label, r.surname, r.year) for r in catalog.QUERIES["table_studies"](spark, SF).collect()}
    labels = {(t, r): text for t, r, c, text, head, r0, c0 in plain if c == 0 and r == r0 and r >= 2 and text}
    assert {k: v[0] for k, v in studies.items()} == labels
    named = [v for v in studies.values() if v[0].startswith("Supplier")]
    assert named and all(v[1] == v[0].split()[0].lower() and v[2] == int(v[0][-4:]) for v in named)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_cells_of_short_tables_are_shuffled_once(spark):
    """Lines are dealt by order, and their cells stay there; cells that lie anywhere are dealt by table."""
    assert exchanges(catalog.QUERIES["table_grid"](spark, SF)) == 1
    assert exchanges(grids.laid_out(spark.createDataFrame(some_cells(1), CELLS))) == 1


def test_headers_take_one_aggregate_by_table(spark):
    grid = grids.laid_out(spark.createDataFrame(some_cells(2), CELLS))
    assert exchanges(grids.header_rows(grid)) == exchanges(grid) + 1


def test_heads_and_studies_of_tables_of_any_form(spark):
    """Header paths and studies of tables with and without head cells, against plain ones."""
    cells = [c for seed in range(4) for c in [(c[0] + 20 * seed, *c[1:3], ["Study", "a", "7", "", None][(7 * c[1] + 3 * c[2] + c[0]) % 5], *c[4:6], c[6] and c[1] < 3) for c in some_cells(seed, rows=6)]]
    grid = grids.laid_out(spark.createDataFrame(cells, CELLS)).cache()
    headers = grids.header_rows(grid)
    heads = grids.column_heads(grid, headers)
    places, paths = [tuple(r) for r in grid.collect()], {}
    bodies = {r.table_id: r.body for r in headers.collect()}
    for t, row, col, text, _, from_row, from_col in sorted(places):
        own = paths.setdefault((t, col), [])
        if row < bodies[t] and row == from_row and text.strip():
            own.append(text.strip())
    paths = {k: " > ".join(v) for k, v in paths.items()}
    assert {(r.table_id, r.col): r.path for r in heads.collect()} == paths
    named = {t: min((c for (u, c), p in paths.items() if u == t and c < 3 and p.split(" > ")[-1] == "Study"), default=0) for t in bodies}
    expected = {(t, row, text) for t, row, col, text, _, from_row, _ in places if col == named[t] and row >= bodies[t] and row == from_row and text}
    assert {tuple(r)[:3] for r in grids.study_rows(grid, headers, heads).collect()} == expected and expected


def test_no_rows_of_tables_go_through_the_driver(spark):
    """Head cells of many tables are alike, so their shuffles are small, but not the rows."""
    for name in ("table_heads", "table_studies"):
        df = catalog.QUERIES[name](spark, SF)
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("batch", [1, 5, 10_000])
def test_short_and_long_tables_side_by_side(spark, monkeypatch, batch):
    monkeypatch.setattr(grids, "BLOCK", 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        cells = some_cells(6, tables=30, rows=8) + [(99, -1, 0, "a", 3, 1, True), (99, 0, 0, "b", 1, 1, False)]
        df = spark.createDataFrame(cells, CELLS)
        for rows in (None, df.select("table_id", "row")):
            found = grids.laid_out(df, rows).collect()
            assert len(found) == len(set(found)) and {tuple(r) for r in found} == laid_out_plainly(cells)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_labels(spark):
    said = ["Smith 2001", "Smith AB et al., 2001a", "Smith & Jones (1999)", "Ødegård and Li, 2010", "van der Berg 2005", "in 2001", "Smith", "Smith 3001", None, ""]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", grids.author_year(F.col("s")).alias("a")).orderBy("i").collect()
    none = (None, None)
    assert [tuple(r.a) for r in rows] == [("smith", 2001), ("smith", 2001), ("smith", 1999), ("ødegård", 2010), ("van der berg", 2005), none, none, none, none, none]


def test_reference_numbers(spark):
    marks = {"3, 5-7": [3, 5, 6, 7], "7–5": [5, 7], "1-9999": [1, 9999], "4,4, 2": [2, 4], "": [], "none": []}
    rows = spark.createDataFrame([(m,) for m in marks], "m string").select("m", grids.reference_numbers(F.col("m")).alias("n")).collect()
    assert {r.m: r.n for r in rows} == marks


def included_plainly(references, claims, said):
    votes, whole = {}, {}
    for review in {r[0] for r in references if r[0] is not None and r[1] is not None}:
        own = [r for r in references if r[0] == review and r[1] is not None]
        inc, exc = {r[1] for r in own if r[2] == "included"}, {r[1] for r in own if r[2] == "excluded"}
        usable = {r[1] for r in own} - (exc - inc)
        firm = {(r, "a1") for r in inc} | {(c[1], c[2]) for c in claims if c[0] == review and c[2] in ("a2", "a3") and c[1] in usable}
        n_firm, believed = len({r for r, _ in firm}), []
        for _, n, refs in (s for s in said if s[0] == review):
            if n is not None and (len(refs) == n or (len(refs) >= 2 and 2 * len(refs) >= n)):
                believed.append((n, refs, not firm or (not inc and len(refs) == n and n > n_firm)))
        new = {r for _, refs, creates in believed if creates for r in refs if r in usable}
        told = {(r, "a4") for _, refs, _ in believed for r in refs if r in usable}
        here = {r: {s for q, s in firm | told if q == r} for r in {r for r, _ in firm} | new}
        votes |= {(review, r): ("included", min(s), len(s)) for r, s in here.items()} if here else {(review, r[1]): ("unknown", "list", 0) for r in own}
        most = max((n for n, _, _ in believed), default=None)
        whole[review] = (most, len(here), None if most is None else len(here) >= most)
    return votes, whole


@pytest.mark.parametrize("seed", range(4))
def test_inclusion_against_a_plain_version(spark, seed):
    rnd = random.Random(seed)
    references = [(rnd.choice([None, *range(8)]), rnd.choice([None, *range(10)]), rnd.choice(["included" if seed % 2 else None, "excluded", "studies", None])) for _ in range(90)]
    claims = [(rnd.randrange(8), rnd.randrange(12), rnd.choice(["a2", "a3", "zz", None])) for _ in range(12)]
    said = [(rnd.randrange(9), rnd.choice([None, 1, 2, 3, 5, 9]), sorted(rnd.sample(range(12), rnd.randint(0, 5)))) for _ in range(10)]
    made = grids.inclusion(
        spark.createDataFrame(references, "review int, ref int, section string"), spark.createDataFrame(claims, "review int, ref int, strategy string"),
        spark.createDataFrame(said, "review int, n_said int, refs array<int>"),
    )
    votes, whole = included_plainly(references, claims, said)
    assert {(r.review, r.ref): (r.role, r.strategy, r.n_strategies) for r in made[0].collect()} == votes
    assert {r.review: (r.n_said, r.n_found, r.complete) for r in made[1].collect()} == whole


def test_citations(spark):
    said = {
        "Smith J, Doe A. A trial of something. Lancet 2010 Mar 3;12(4):55-60. https://a.b/2001;1:1": ("Smith J, Doe A", "A trial of something", "Lancet", 2010, "12", "4", "55", "60"),
        "Lancet 2010;1:1. Ann Med 2011;S2:e4–e9": (None, None, "Ann Med", 2011, "S2", None, "e4", "e9"),
        "Short one. BMJ 1999; 5 : 7": (None, None, "BMJ", 1999, "5", None, "7", None),
        "A title without a source, 2001": (None,) * 8,
        "2001;5:7": (None,) * 8,
        "J" * 81 + " 2001;5:7": (None,) * 8,
        "": (None,) * 8,
    }
    rows = spark.createDataFrame([(s,) for s in [*said, None]], "s string").select("s", citations.cited(F.col("s")).alias("c")).collect()
    assert {r.s: tuple(r.c) for r in rows} == said | {None: (None,) * 8}


def test_citations_are_matched_once(spark):
    """A text is matched for its source and then taken apart, whatever the number of its parts; brackets are not taken for ends."""
    assert str(citations.cited(F.col("s"))).count("(?:1[89]|20)") == 2
    said = {
        "Doe A. Trials (of) some) drugs. Ann (Med) 2011;S2(Suppl (1):4. 9)x)": ("Doe A", "Trials (of) some) drugs", "Ann (Med)", 2011, "S2", "Suppl (1", "4", None),
        "2010)1)2)3)4)Ann Med 1999;1:2)": (None, None, "2010)1)2)3)4)Ann Med", 1999, "1", None, "2", None),
        "2010)1)2)3)4)Ann Med 1999": (None,) * 8,
    }
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", citations.cited(F.col("s")).alias("c")).collect()
    assert {r.s: tuple(r.c) for r in rows} == said


def test_levels_and_record_order(spark):
    rows = spark.createDataFrame([("1",), ("01",), (" 1",), ("2",), ("2.0",), ("x",), (None,)], "level string")
    met = {v: sorted(r.level for r in citations.with_level(rows, "level", v).collect()) for v in ("1", "01", "1.0", "2", "x", "7")}
    assert met == {"1": [" 1", "1"], "01": ["01"], "1.0": [" 1", "01", "1"], "2": ["2"], "x": ["x"], "7": []}
    ids = ["other", "rec-x-1", "rec-pmid-9", "rec-doi-2", "rec-pmid-10", "rec-nct-1", "rec-oa-1", "rec-eid-1", "rec-pmcid-1"]
    found = spark.createDataFrame([(i,) for i in ids], "i string").orderBy(citations.record_order(F.col("i"))).collect()
    assert [r.i for r in found] == ["rec-pmid-10", "rec-pmid-9", "rec-doi-2", "rec-pmcid-1", "rec-eid-1", "rec-oa-1", "rec-nct-1", "rec-x-1", "other"]
