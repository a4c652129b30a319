import corpus_pipeline
from pyspark.sql import functions as F

from evidra.llm import decontaminate
from evidra.llm.shared import stored

from ..conftest import SF


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = given = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), "stage-" + name.replace(" ", "-"))
        seen.append((name, before.count(), docs.count()))
        if name != "sharding":
            assert docs.columns == given.columns
    counts = dict((n, (a, b)) for n, a, b in seen)
    assert counts["quality classifier"][1] < counts["quality classifier"][0]
    assert counts["minhash near-dedup"][1] < counts["minhash near-dedup"][0]
    assert counts["sharding"][0] == counts["sharding"][1]
    assert {"shard", "manifest_version"} <= set(docs.columns)


def test_dedup_stage_keeps_one_row_of_each_class(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(5, text), (3, text), (3, text), (9, text + " end"), (4, "other words that are not like it"), (None, text), (None, None), (7, None), (None, "alone " * 3)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()]
    assert sorted(kept, key=repr) == sorted([(3, text), (4, rows[4][1]), (None, None), (7, None), (None, rows[8][1])], key=repr)


def test_dedup_stage_keeps_one_row_where_an_id_has_near_copies(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = spark.createDataFrame([(5, text, "en", "s"), (5, text + " end", "en", "s"), (9, text + " tail", "en", "s")], "doc_id long, text string, lang string, source string")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()] == [5]


def test_decontamination_stage_drops_what_is_hit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r[0] for r in corpus_pipeline.decontamination_stage(spark, docs, SF).select("doc_id").collect()}
    hit = {r[0] for r in decontaminate.judged(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").select("doc_id").collect()}
    assert hit and kept == {r[0] for r in docs.select("doc_id").collect()} - hit


def test_empty_documents_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_dedup_stage_keeps_null_texts_and_the_least_of_repeated_rows(spark):
    rows = [(None, None, "en", "b"), (None, None, "en", "a"), (7, None, "de", "b"), (7, None, "de", "b"), (5, "x y", "de", "b"), (5, "x y", "de", "a"), (5, "x y", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([*rows[:4], (5, "x y", "de", "a")], key=repr)


def test_stages_keep_columns_of_their_own_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = docs.withColumns({"quality_score": F.lit("q"), "n_hit": F.lit(-1), "n_words": F.lit("w"), "items": F.lit(3.5), "size": F.lit("s"), "node": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "clash-" + name.replace(" ", "-"))
        assert docs.columns[5:] == ["quality_score", "n_hit", "n_words", "items", "size", "node"]
        assert {tuple(r[5:]) for r in docs.collect()} <= {("q", -1, "w", 3.5, "s", 1)}


def test_stages_take_null_texts_and_sources(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "en", None), (None, "words of a plain sort " * 4, None, "s")], "doc_id long, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        found = sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, SF).collect()), key=repr)
        given = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
        # The mix gives the null source no words and so takes none of its documents, and repeats the other's.
        assert set(found) <= set(given) and ("mixing" in name or found == given)
        assert (None, "words of a plain sort " * 4) in found
    assert all(r["doc_id"] in (1, 2, None) for r in corpus_pipeline.quality_stage(spark, docs, SF).collect())
