"""Files of unknown encoding, run folders, documents in XML, and headers."""

import pytest
from pyspark.sql import functions as F

from evidra.operators import linkage, mining, search, validate
from evidra.sources import exports, tables


@pytest.mark.parametrize(("encoding", "codec", "mark"), [("UTF-8", "utf-8", ";"), ("UTF-8", "utf-8-sig", "\t"), ("windows-1250", "cp1250", ";"), ("UTF-16", "utf-16", ",")])
def test_encoding_and_delimiter_are_found(spark, tmp_path, encoding, codec, mark):
    lines = [mark.join(["Szerző", "m1", "note"]), mark.join(["Kőműves", "1.5", "a b"]), mark.join(["Őry", "2.25", "c"])]
    (tmp_path / "t.csv").write_bytes("\n".join(lines).encode(codec))
    assert exports.sniffed(spark, str(tmp_path)) == (encoding, mark)
    rows = tables.read_delimited(spark, str(tmp_path), mark, encoding)
    assert [r[0] for r in rows.collect()] == ["Kőműves", "Őry"]


def test_delimited_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a;b", None), ("2", 'quote "x"', "é")], "k string, t string, u string")
    tables.write_delimited(rows, str(tmp_path / "out"))
    back = tables.read_delimited(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_runs_are_found_by_their_folders(spark, tmp_path):
    for outcome, run in (("pain", "r1"), ("pain", "r2"), ("death", "r1")):
        (tmp_path / outcome / run).mkdir(parents=True)
        (tmp_path / outcome / run / "run.json").write_text('{"k": 3}')
    found = exports.run_files(spark, str(tmp_path)).collect()
    assert sorted((r["outcome"], r["run"]) for r in found) == [("death", "r1"), ("pain", "r1"), ("pain", "r2")]
    exports.write_results({"effects": spark.range(3)}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/effects")).count() == 3


def test_guarded_cells_come_back(spark):
    cells = spark.createDataFrame([("=A1",), ("-x",), ("-5",), ("plain",), ("'quoted",)], "c string")
    back = cells.select("c", exports.unguarded(exports.guarded(F.col("c"))).alias("d")).collect()
    assert all(r["c"] == r["d"] for r in back)


def test_articles_are_cut_into_parts(spark):
    xml = (
        "<article><front><article-title>A <i>trial</i></article-title></front><body><sec><title>Methods</title><p>One.</p><p>Two.</p></sec>"
        "<table-wrap id='t1'><table><tr><th>Study</th><th>n</th></tr><tr><td>Smith</td><td>5</td></tr></table></table-wrap></body><back><ref id='b1'>Smith 2010</ref></back></article>"
    )
    found = {(r["doc"], r["part"], r["number"]): (r["label"], r["value"]) for r in mining.parsed_articles(spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "doc long, xml string")).collect()}
    assert found[1, "title", 0] == ("", "A trial") and found[1, "section", 0] == ("Methods", "One. Two.")
    assert found[1, "row", 1] == ("t1", "Smith\t5") and found[1, "reference", 0] == ("b1", "Smith 2010")
    assert found[2, "error", 0] and found[3, "error", 0]


def test_records_are_cut_into_parts(spark):
    xml = (
        "<PubmedArticle><Article><ArticleTitle>On salt</ArticleTitle><Journal><Title>J Salt</Title><JournalIssue><PubDate><Year>2011</Year></PubDate></JournalIssue></Journal>"
        "<AuthorList><Author><LastName>Lot</LastName></Author></AuthorList><PublicationTypeList><PublicationType>Trial</PublicationType></PublicationTypeList></Article>"
        "<ArticleIdList><ArticleId IdType='doi'>10.1/x</ArticleId></ArticleIdList></PubmedArticle>"
    )
    found = {(r["part"], r["label"]): r["value"] for r in mining.parsed_records(spark.createDataFrame([("a", xml)], "doc string, xml string")).collect()}
    assert found["year", ""] == "2011" and found["id", "doi"] == "10.1/x" and found["author", ""] == "Lot" and found["type", ""] == "Trial"


def test_headers_that_point_to_persons():
    found = search.personal_columns(["Patient Name", "dateOfBirth", "study_name", "phone", "m1", "e-mail", "PatientId"])
    assert found == {"Patient Name": "name", "dateOfBirth": "birth", "phone": "phone", "e-mail": "email", "PatientId": "patient_id"}


def test_columns_that_are_missing():
    assert validate.missing_columns(["yi", "sei"], [["yi", "vi"], ["yi", "sei"]]) == []
    assert validate.missing_columns(["m1"], [["m1", "sd1"], ["e1", "n1", "e2"]]) == ["sd1"]


def test_similar_titles_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    titles = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)}
    titles |= {t + " tail end" for t in list(titles)[:20]} | {" ".join([*t.split()[:-1], "other"]) for t in list(titles)[:20]}
    reps = spark.createDataFrame([(k, t) for k, t in enumerate(sorted(titles))], "rep long, title string")
    found = {(r["title_a"], r["title_b"]) for r in linkage.similar_titles(reps).collect() if r["title_a"] != r["title_b"]}

    def alike(a, b):
        x, y = set(a.split()), set(b.split())
        short, long = sorted((a, b), key=len)
        return len(x & y) / len(x | y) >= 0.8 or (len(short.split()) >= 6 and long.startswith(short + " "))

    own = sorted(titles)
    assert found == {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if alike(a, b)}
