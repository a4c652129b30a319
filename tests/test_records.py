from pyspark.sql import functions as F

from evidra.operators import agreement, linkage, screening, search, validate
from evidra.operators.components import components


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 120)] + [(200, 200), (None, 3), (5, 4), (5, 4)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and all(found[k] == 100 for k in range(100, 120)) and found[200] == 200


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kappa_of_full_agreement_and_of_one_category(spark):
    full = spark.createDataFrame([("x", "x"), ("y", "y"), ("x", "x")], "a string, b string")
    assert agreement.cohen_kappa(full, "a", "b").first()["kappa"] == 1
    one = spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string")
    assert agreement.cohen_kappa(one, "a", "b").first()["kappa"] is None


def test_diff_statuses(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 5.0, 1.0)], "k long, x double, y double")
    b = spark.createDataFrame([(1, 10.0, 2.0), (2, None, None), (4, 1.0, 1.0)], "k long, x double, y double")
    cells = agreement.table_diff(a, b, ["k"], ["x", "y"])
    found = {(r["k"], r["field"]): r["status"] for r in cells.collect()}
    assert found == {(1, "x"): "differs", (1, "y"): "equal", (2, "x"): "both_empty", (2, "y"): "missing_b", (3, "x"): "missing_b", (3, "y"): "missing_b", (4, "x"): "missing_a", (4, "y"): "missing_a"}
    assert agreement.cause_hints(cells).first()["hint"] == "factor 10"


def test_identity_links_are_no_more_than_records(spark):
    ids = spark.range(500).select(F.col("id").alias("rec_id"), F.lit("doi").alias("kind"), F.lit("same").alias("value"))
    assert linkage.identity_links(ids).count() == 499


def test_blocking_codes(spark):
    arms = spark.createDataFrame([(1, 5.0, 10.0, 2.0, 10.0), (2, 11.0, 10.0, 2.0, 10.0), (3, None, 10.0, 2.0, 10.0), (4, 0.0, 20.0, 0.0, 20.0)], "row_index long, e1 double, n1 double, e2 double, n2 double")
    assert {r["row_index"]: r["codes"] for r in validate.blocking(validate.binary_rows(arms)).collect()} == {2: "V006", 3: "V002"}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1)], "rec long, route string, version long")
    new = spark.createDataFrame([(1, 2), (3, 2), (3, 1)], "rec long, version long")
    once = linkage.upsert(old, new, "rec", "a")
    twice = linkage.upsert(once, new, "rec", "a")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 2), (1, "b", 1), (3, "a", 2)]


def test_grade_upgrades_only_without_downgrades(spark):
    row = spark.range(1).select(screening.grade(F.lit(2), [F.lit(0)], [F.lit(1)]).alias("up"), screening.grade(F.lit(2), [F.lit(1)], [F.lit(2)]).alias("down"), screening.grade(F.lit(4), [F.lit(5)], [F.lit(0)]).alias("least")).first()
    assert (row["up"], row["down"], row["least"]) == (3, 1, 1)


def test_phrase_counts_overlapping_neighbours(spark):
    chunks = spark.createDataFrame([(1, "Of the of the, of THE"), (2, "often the"), (3, None)], "chunk_id long, text string")
    assert [tuple(r) for r in search.phrase(chunks, "of the").collect()] == [(1, 3)]


def test_nine_digit_ids_need_their_check_digit(spark):
    good = [1, 2, 3, 4, 5, 6, 7, 8]
    check = sum(d * (3 if k % 2 == 0 else 7) for k, d in enumerate(good)) % 10
    text = f"a@b.example 12345678{check} and 12345678{(check + 1) % 10}"
    rows = spark.createDataFrame([(1, text), (2, None)], "id long, t string")
    assert sorted(map(tuple, search.phi_scan(rows, "id", "t").collect())) == [(1, "email", 1), (1, "nine_digit_id", 1)]


def test_final_judgements_come_from_the_whole_table(spark):
    from evidra.plans import catalog, load_all

    from .conftest import SF

    load_all()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity <= 4 OR l_quantity >= 50")
    found = catalog.QUERIES["rob_final"](spark, SF).collect()
    assert {r["study"] for r in found} == {r[0] for r in lines.select("l_partkey").distinct().collect()}
    assert {r["basis"] for r in found} == {"consensus", "conflict", "human", "approved"}
