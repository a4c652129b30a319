import csv
import io
import pathlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidra.sources import raw


def opened(text, delimiter):
    """Whether a reader of the whole text is inside a quoted cell at its end: one more line is then part of the same record."""
    rows = list(csv.reader(io.StringIO(text + "\nMARK" * 2), delimiter=delimiter))
    return rows[-1] != ["MARK"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a";, x', max_size=14), st.sampled_from([";", ","]))
def test_states_are_those_of_a_reader(line, delimiter):
    outside, inside = raw.quote_states(line, delimiter)
    assert outside == opened(line, delimiter)
    assert inside == opened('"' + "\n" + line, delimiter)


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    pieces = ["plain", 'with "quotes" in it', "line\nbreak", "semi;colon", "", "é漢", '5" tall', "two\n\nbreaks\n", "\n", '"', "a" * 300]
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    writer.writerow(["study", "m1", "note"])
    for k in range(n):
        writer.writerow([f"s{k}", rng.choice(["1.5", "2,000", "x"]), rng.choice(pieces)])
        if k % 17 == 0:
            out.write("\n" if k % 2 else "bare 5\" pipe;1;2\n")
    return out.getvalue()


@pytest.mark.parametrize("size", ["200", "128m"])
def test_many_ranges_give_the_records_of_one_reader(spark, tmp_path, size):
    texts = {"a.csv": sample(50), "b.csv": "﻿" + sample(12, 1).rstrip("\n"), "c.csv": "", "d.csv": sample(9, 2) + 'open;1;"never closed\nmore\n'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = raw.raw_records(spark, str(tmp_path), ";").collect()
        raw.write_raw(raw.raw_records(spark, str(tmp_path / "a.csv"), ";"), str(tmp_path / "out"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    if size == "200":
        assert len({(r["file"], r["block"]) for r in rows}) > 5
    for name, text in texts.items():
        own = sorted((r["block"], r["at"], r["cells"], r["complete"]) for r in rows if r["file"].endswith(name))
        expected = list(csv.reader(io.StringIO(text.removeprefix("﻿")), delimiter=";"))
        found = [c for _, _, c, _ in own]
        if name == "d.csv":  # what no quote closes keeps its last line break or not
            assert not own[-1][3] and found[:-1] == expected[:-1] and found[-1][:2] == expected[-1][:2] and found[-1][2].rstrip("\n") == expected[-1][2].rstrip("\n")
        else:
            assert found == expected and all(c for *_, c in own), name
    written = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert written == texts["a.csv"]


def test_findings_of_a_raw_table(spark, tmp_path):
    text = "study;m1;sd1;mean1;n1\na;1,5;0,2;9;12\nb;2.000;0,3;9;1.200\nc;x;0,4;y;10\nd;1,5;0,2;9\n\n;;;;\ne;1,5;0,2;9;10;more\nf;NA;-;9;11\n"
    (tmp_path / "t.csv").write_text(text)
    header, rows = raw.headed(raw.raw_records(spark, str(tmp_path)))
    assert header == ["study", "m1", "sd1", "mean1", "n1"] and rows.count() == 6
    found = {(r["at"], r["column"], r["value"], r["code"]) for r in raw.raw_findings(header, rows, ";", needed=("m1",)).collect()}
    assert found == {(None, "mean1", None, "V028"), (4, None, "4", "V024"), (7, None, "6", "V024"), (3, "m1", "x", "V003")}
    (tmp_path / "u").mkdir()
    (tmp_path / "u/t.csv").write_text("study,m1,m1,sd1\na,\"2,000\",1,3\nb,13.598,1,q\n")
    header, rows = raw.headed(raw.raw_records(spark, str(tmp_path / "u"), ","))
    assert header == ["study", "m1", "m1.2", "sd1"]
    found = {(r["column"], r["value"], r["code"]) for r in raw.raw_findings(header, rows, ",", needed=("m1",)).collect()}
    assert found == {("m1.2", None, "V028"), ("m1", "2,000", "V023"), ("sd1", "q", "V021")}


def test_lines_carry_the_heads_of_their_records(spark, tmp_path):
    """No task looks a line's head up among all the heads of its range: it comes with the line."""
    (tmp_path / "t.csv").write_text('a;1\nb;"x\ny\n\nz";2\nc;3\n')
    assert [(r["at"], r["head"]["at"], r["opened"]) for r in raw.raw_lines(spark, str(tmp_path)).orderBy("at").collect()] == [(0, 0, False), (1, 1, False), (2, 1, True), (3, 1, True), (4, 1, True), (5, 5, False)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = raw.raw_lines(spark, str(tmp_path)).orderBy("block", "at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert len({r["block"] for r in lines}) > 2
    heads = [next(x["text"] for x in lines if (x["block"], x["at"]) == tuple(r["head"])) for r in lines]
    assert heads == ["a;1", *['b;"x'] * 4, "c;3"]


def test_the_raw_table_is_written_by_many_tasks(spark, tmp_path):
    from evidra.plans import catalog, load_all
    from evidra.sources.shared import checkpoint_root

    from .conftest import SF

    load_all()
    spark.read.parquet(f"{SF}/orders.parquet").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    root = pathlib.Path(checkpoint_root(spark).removeprefix("file:"))
    before = set(root.glob("evidra-raw-table-*"))
    try:
        found = {tuple(r) for r in catalog.QUERIES["raw_findings"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    (folder,) = set(root.glob("evidra-raw-table-*")) - before
    parts = list(folder.glob("part-*"))
    assert len(parts) > 1 and all(p.read_text().startswith("study;m1;sd1;m1\n") for p in parts)
    assert found == {tuple(r) for r in catalog.QUERIES["raw_findings"](spark, SF).collect()}
