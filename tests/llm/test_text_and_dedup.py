import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.llm import minhash
from evidra.llm.textnum import ALNUM, LOWER, SPACED, shingles, spans, text_bytes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, node string, id string"
LOWER_AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
RULES = {"alnum": (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "spaced": (SPACED, r"[^\x20\x09-\x0D]+")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ9 é漢\n\t-_.😀\x85", max_size=30)), max_size=8), st.sampled_from(sorted(RULES)))
def test_words_are_those_of_the_expression(texts, rule):
    kind, expression = RULES[rule]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    start, end, bounds = spans(data, offsets, kind)
    hashes = word_hashes(data, start, end)
    seen = {}
    for k, text in enumerate(texts):
        words = re.findall(expression, (text or "").translate(LOWER_AZ))
        own = slice(bounds[k], bounds[k + 1])
        assert [LOWER[data[a:b]].tobytes().decode() for a, b in zip(start[own], end[own], strict=True)] == words
        for word, h in zip(words, hashes[own], strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_short_texts_have_one_shingle():
    data, offsets = text_bytes(pa.array(["a b", "a b c d e f", "", "b a", "a b"]))
    start, end, bounds = spans(data, offsets, ALNUM)
    made, made_bounds = shingles(word_hashes(data, start, end), bounds, 5)
    assert np.diff(made_bounds).tolist() == [1, 2, 0, 1, 1]
    assert made[0] == made[4] != made[3]


def test_samples_collide_as_often_as_the_weighted_jaccard():
    rng = np.random.default_rng(1)
    terms = rng.integers(0, 2**63, 400).astype(np.uint64)
    terms.sort()
    wa, wb = rng.gamma(2, 2, 400), rng.gamma(2, 2, 400)
    a = minhash.icws(terms, wa, np.array([0, 400]), 4000)
    b = minhash.icws(terms, wb, np.array([0, 400]), 4000)
    assert (a == b).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.03)


def words_of(text):
    return re.findall(RULES["alnum"][1], (text or "").translate(LOWER_AZ))


def exact_weights(texts):
    terms = [row for _, _, rows in minhash._row_terms(pa.array(texts, pa.string())) for row in rows]
    df, n = Counter(int(s) for t, _ in terms for s in t), sum(t.size > 0 for t, _ in terms)
    return [(t, c * np.array([np.log((1 + n) / (1 + df[int(s)])) + 1 for s in t])) for t, c in terms]


def alike(a, b):
    return a[0].size > 0 and b[0].size > 0 and minhash.likeness(a, b) >= minhash.SIMILARITY


def brute_classes(texts):
    terms = exact_weights(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] is not None and texts[i] == texts[j]
            if same or alike(terms[i], terms[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def made_texts():
    rng = np.random.default_rng(3)
    vocabulary = ["w" + str(k) for k in range(3000)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(30, 200))) for _ in range(40)]
    base = " ".join(rng.choice(vocabulary, 120)).split()
    for k in range(30):  # a group of near copies, some of which only others link
        copy = list(base)
        for at in rng.choice(len(copy), 1 + k % 4, replace=False):
            copy[at] = "edited" + str(k)
        texts.append(" ".join(copy))
    texts += [texts[3]] * 5 + [texts[7] + " tail"] + ["", "", "***", None, None, "one two", "One, two!", "x" * 100_000 + " y"]
    return texts


def test_classes_are_those_of_brute_force(spark):
    texts = made_texts()
    docs = spark.createDataFrame([(k, t, "en", "s", "clash", "clash") for k, t in enumerate(texts)], DOCS)
    expected = brute_classes(texts)
    found = {r["id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert [found[k] for k in range(len(texts))] == expected


def test_buckets_have_the_weight_of_their_most_frequent_shingle(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e f"), (3, None), (4, "...")], "doc_id long, text string")
    weights = minhash.bucket_weights(minhash.shingle_counts(docs).where("shingle IS NULL OR df > 1"), 2)
    shingle, _ = minhash._row_terms(pa.array(["a b c d e"])).__next__()[2][0]
    own = int(shingle[0]) & (minhash.FEATURES - 1)
    assert weights[own] == pytest.approx(np.log(3 / 3) + 1) and weights[own - 1] == pytest.approx(np.log(3 / 2) + 1)


@pytest.mark.parametrize(("range_bytes", "held"), [(64, 50), (4 << 20, 1_000_000), (64, 1_000_000)])
def test_shingles_are_added_up_in_ranges_without_a_row_each(spark, monkeypatch, range_bytes, held):
    monkeypatch.setattr(minhash, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(minhash, "HELD_TERMS", held)
    texts = [*made_texts(), None, "...", "a b c d e"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    terms = [t for _, _, rows in minhash._row_terms(pa.array(texts, pa.string())) for t, _ in rows]
    df = Counter(s for t in terms for s in t.view(np.int64).tolist()) | {None: sum(t.size > 0 for t in terms)}
    for least in (1, 2):
        counts = minhash.shingle_counts(docs, least=least)
        assert {r["shingle"]: r["df"] for r in counts.collect()} == {s: n for s, n in df.items() if s is None or n >= least}
        # An aggregate by shingle would hold a row for each of them in the executors' heap.
        assert "HashAggregate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_empty_table_and_null_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    found = Counter((r["id"], r["class_id"]) for r in minhash.near_duplicates(docs).collect())
    assert found == {(None, 5): 1, (None, None): 1, (5, 5): 2}


def test_hashed_frequencies_do_not_decide(spark):
    texts = made_texts()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    terms = [row for _, _, rows in minhash._row_terms(pa.array(texts, pa.string())) for row in rows]
    df = Counter(int(s) for t, _ in terms for s in t)
    counts = minhash.shingle_counts(docs)
    n_docs = counts.where("shingle IS NULL").first()["df"]
    assert n_docs == sum(t.size > 0 for t, _ in terms)
    nodes = spark.createDataFrame([(k, bytes([k]), texts[k]) for k in (40, 44, 3)], "number long, node binary, text string")
    for row in minhash.with_frequencies(nodes, counts.where("shingle IS NOT NULL AND df > 1")).collect():
        own = terms[row["node"][0]][0]
        found = dict(zip(row["places"], row["dfs"], strict=True))
        assert [found.get(k, 1) for k in range(own.size)] == [df[int(s)] for s in own]


def test_a_class_has_one_representative_where_ids_repeat(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = spark.createDataFrame([(5, text), (5, text + " end"), (9, text + " tail"), (None, text)], "doc_id long, text string")
    found = minhash.near_duplicates(docs).collect()
    assert {r["class_id"] for r in found} == {5} and sum(r["representative"] for r in found) == 1


def test_recall_on_the_sample_documents(spark):
    """Recall of pairs of different texts, against all that share a shingle of few documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sorted(docs.where("text IS NOT NULL").select("doc_id", "text").collect())
    found = {r["id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    terms = exact_weights([r["text"] for r in rows])
    seen, by_shingle, shared = set(), {}, Counter()
    for k, (t, _) in enumerate(terms):
        if rows[k]["text"] not in seen:
            seen.add(rows[k]["text"])
            for s in t.tolist():
                by_shingle.setdefault(s, []).append(k)
    for own in by_shingle.values():
        if 1 < len(own) <= 50:
            shared.update((i, j) for i in own for j in own if i < j)
    # Half of the lesser row's shingles are frequent at most; then a pair of that similarity shares many rare ones.
    links = [(i, j) for (i, j), n in shared.items() if n >= 0.2 * max(terms[i][0].size, terms[j][0].size) and alike(terms[i], terms[j])]
    met = sum(found[rows[i]["doc_id"]] == found[rows[j]["doc_id"]] for i, j in links)
    assert len(links) > 40 and met >= 0.99 * len(links)
