from evidra.operators import components, graphs
from evidra.operators.components import contracted


def test_contracted_chains_stars_and_loops(spark, monkeypatch):
    monkeypatch.setattr(components, "DEALT", 64)  # the star's hub is dealt
    links = [(i, i + 1) for i in range(50)] + [(1500, k) for k in range(101, 1400)] + [(2000, 2000), (None, 3), (5, 4), (5, 4)]
    found = {r["node"]: r["root"] for r in contracted(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {k: 101 for k in range(101, 1400)} | {1500: 101, 2000: 2000}
    assert contracted(spark.createDataFrame([], "a long, b long")).count() == 0


def test_levels_write_links_not_all_records(spark, monkeypatch):
    written, stored = [], graphs.stored

    def counted(df, name):
        out = stored(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(graphs, "stored", counted)
    monkeypatch.setattr(components, "stored", counted)
    records = spark.range(3000).withColumnRenamed("id", "rec")
    links = spark.createDataFrame([(1, 2, 5), (2, 3, 4), (3, 4, 4), (10, 11, 3), (11, 12, 2), (20, 21, 1)], "a long, b long, strength int")
    apart = spark.createDataFrame([(1, 4), (10, 99)], "a long, b long")
    studies, refused = graphs.constrained_studies(records, links, apart)
    found = {r["rec"]: r["study"] for r in studies.collect()}
    assert len(found) == 3000 and {k: v for k, v in found.items() if k != v} == {2: 1, 11: 10, 12: 10, 21: 20}
    assert sorted(tuple(r) for r in refused.collect()) == [(1, 3, 4, 1), (3, 4, 4, 1)]
    assert max(written) < 100


def test_postings_of_asked_terms_only(spark):
    from evidra.operators import search

    chunks = spark.createDataFrame([(1, "The error, the Éra."), (2, "nothing here"), (3, "..."), (4, None), (1, "the end")], "chunk_id long, text string")
    tokens, lengths = search.postings(chunks, ["the", "er*"])
    assert sorted(tuple(r) for r in tokens.select("chunk_id", "token", "tf").collect()) == [(1, "era", 1), (1, "error", 1), (1, "the", 3)]
    assert sorted(tuple(r) for r in lengths.collect()) == [(1, 2), (1, 4), (2, 2)]
    whole, sizes = search.postings(chunks)
    assert whole.count() == 6 and sizes.count() == 3


def test_references_meet_once_for_all_strategies(spark):
    from evidra.operators import grids

    references = spark.createDataFrame([(1, 1, "included"), (1, 2, "studies"), (2, 1, "studies")], "review int, ref int, section string")
    claims = spark.createDataFrame([(1, 2, "a2"), (1, 2, "a3")], "review int, ref int, strategy string")
    said = spark.createDataFrame([(1, 1, [2])], "review int, n_said int, refs array<int>")
    made = grids.inclusion(references, claims, said)[0]
    assert sorted(tuple(r) for r in made.collect()) == [(1, 1, "included", "a1", 1), (1, 2, "included", "a2", 3), (2, 1, "unknown", "list", 0)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_tasks_grow_with_the_values(spark, monkeypatch):
    from evidra.operators import linkage

    monkeypatch.setattr(linkage, "TASK_ROWS", 10)
    values = spark.range(200).selectExpr("id % 7 AS review", "id AS study", "'f' AS field", "'o' AS outcome", "'a' AS arm", "1.0D AS value")
    decisions = spark.createDataFrame([(3, 3, "f", "o", "a", "five"), (3, 3, "f", None, None, "three"), (4, 4, "f", None, None, "three")], "review long, study long, field string, outcome string, arm string, decision string")
    made = linkage.decided_values(values, decisions)
    assert made.rdd.getNumPartitions() == 20
    rows = made.collect()
    assert len(rows) == 200 and {r["study"]: r["decision"] for r in rows if r["decision"]} == {3: "five", 4: "three"}


def test_rank_test_writes_its_deviates_once(spark):
    from evidra.operators import bias

    studies = spark.createDataFrame([("a", k, 0.1 * k * (-1) ** k, 0.1 + 0.01 * k) for k in range(6)], "analysis_id string, row_index long, yi double, vi double")
    made = bias.begg_exact(studies)
    assert made.first()["method"] == "exact" and made._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3
