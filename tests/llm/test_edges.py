"""Cases that the other tests of the operators leave out: clashing columns, repeated rows, very long texts, ties, empty tables."""

import hashlib
from collections import Counter

import pytest

from evidra.llm import lm, mixing, quality, queries, sharding, tokencount, urlgraph, warc
from evidra.llm.shared import new_folder

from ..conftest import SF

#: Columns whose names the operators use themselves.
CLASH = "source_size string, target string, taken string, size string, weight string, hash string, id string, source string, n string, held_out string, score string, label string, digest string, node string, word string"


def clashing(spark, rows, schema):
    names = {c.split()[0] for c in schema.split(", ")}
    extra = [c for c in CLASH.split(", ") if c.split()[0] not in names]
    return spark.createDataFrame([(*r, *("clash",) * len(extra)) for r in rows], f"{schema}, {', '.join(extra)}")


def test_repeated_least_ids_are_all_responses(spark):
    body = "x" * 200
    pages = clashing(spark, [(1, "u", body), (1, "v", body), (2, "u", body), (3, "u", body[:99]), (4, "w", body[:99])], "page_id long, url string, html string")
    found = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived(spark, pages)[1].collect())
    assert found == {(1, "response", None): 2, (2, "revisit", 1): 1, (3, "response", None): 1, (4, "response", None): 1}


def test_very_long_texts_come_back_from_shards(spark):
    rows = [(1, "é" * 3_000_000), (2, None), (3, ""), (3, "")]
    held = sharding.sharded(clashing(spark, rows, "doc_id long, text string"), new_folder(spark, "shards"), target=1 << 20)
    found = Counter((r["doc_id"], None if r["text"] is None else hashlib.md5(r["text"].encode()).hexdigest(), r["node"]) for r in held.collect())
    assert found == Counter((k, None if t is None else hashlib.md5(t.encode()).hexdigest(), "clash") for k, t in rows)


def test_mix_with_clashing_columns(spark):
    rows = [(k, "w " * (k % 7 + 1), f"s{k % 3}" if k % 5 else None) for k in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda frame: sorted((tuple(r) for r in frame.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
    assert key(mixing.taken_words(clashing(spark, rows, "doc_id long, text string, source string"))) == key(mixing.taken_words(plain))


def test_repeated_documents_have_one_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    once = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in quality.judged(docs, labels).collect()}
    twice = quality.judged(docs.union(docs.where("doc_id < 50 AND doc_id % 3 = 1")), labels.union(labels.where("doc_id % 3 = 1"))).collect()
    seen = {}
    for r in twice:
        assert seen.setdefault(r["doc_id"], (r["held_out"], r["score"], r["predicted"])) == (r["held_out"], r["score"], r["predicted"])
    assert set(seen) == set(once) and all(seen[k][0] == once[k][0] for k in once)


def test_language_model_with_clashing_columns(spark):
    rows = [(k, "one two three four five six " * (k % 3 + 1)) for k in range(25)] + [(99, None), (100, "")]
    found = {r["doc_id"]: r for r in lm.judged(clashing(spark, rows, "doc_id long, text string")).collect()}
    plain = {r["doc_id"]: r for r in lm.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for k, r in found.items()} == {k: (r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for k, r in plain.items()}
    assert found[99]["n_tokens"] == found[100]["n_tokens"] == 1


def test_urls_repeated_long_and_tied(spark):
    rows = [(1, "http://a.example.com/en/7x", "<p>"), (1, "http://a.example.com/en/7x", "<p>"), (2, "http://B.COM/en/7", "y" * 2_000_000), (3, None, None), (4, "no scheme", ""), (5, "http://x.net/de/8?q", "")]
    found = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlgraph.judged_urls(clashing(spark, rows, "page_id long, url string, html string")).collect())
    assert found[1, "a.example.com", "/en/7x", "example.com/en/7", "allow"] == 2
    assert found[2, "b.com", "/en/7", "com/en/", "block"] == 1 and found[5, "x.net", "/de/8", "net/de/", "allow"] == 1
    assert {(k, h, p, rule) for k, h, p, rule, _ in found if k in (3, 4)} == {(3, "", "", None), (4, "", "", None)}
    tied = (("block", "com", "/en/"), ("block", "com", "/en/"))
    assert {r["verdict"] for r in urlgraph.judged_urls(spark.createDataFrame([(1, "http://a.com/en/", "")], "page_id long, url string, html string"), tied).collect()} == {"block"}


def test_no_documents_no_counts(spark):
    vocabulary = tokencount.sentencepiece_vocabulary(queries.VOCABULARY)
    assert tokencount.token_counts(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_spelling_variants"])
def test_reruns_agree(spark, name):
    own = lambda: sorted(map(tuple, queries.QUERIES[name](spark, SF).collect()), key=repr)
    assert own() == own()
