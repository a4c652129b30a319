import difflib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidra.operators import linkage, titles
from evidra.plans import catalog, catalog_linkage, load_all

from .conftest import SF

load_all()
RECORD = "rec_id long, title string, author string, journal string, year int"


def variants(seed=0, n=60):
    """Titles, and spelling variants of them: letters exchanged, dropped and doubled."""
    rng = np.random.default_rng(seed)
    words = "colour behaviour randomised paediatric anaemia oestrogen tumour foetal haemoglobin oedema labour centre programme diet trial".split()
    out = []
    for _ in range(n):
        title = " ".join(rng.choice(words, rng.integers(2, 9)))
        out.append(title)
        for _ in range(rng.integers(0, 4)):
            letters = list(title)
            for at in rng.choice(len(letters), rng.integers(1, 1 + len(letters) // 5), replace=False):
                letters[at] = rng.choice(["", "x", letters[at] * 2])
            out.append("".join(letters).strip())
    return sorted({" ".join(t.split()) for t in out} - {""})


@pytest.mark.parametrize("least", [0.5, 0.8, 0.85, 0.95])
def test_bounds_leave_out_no_pair(least):
    own = variants(3)
    for k, a in enumerate(own):
        for b in own[k:]:
            exact = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
            assert titles.sequence_ratio(b, a, least) == (exact if exact >= least else 0.0)


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_blocks_meet_all_pairs_of_a_key(spark, block_rows):
    own = [("k" + str(k % 2), t) for k, t in enumerate(variants(1))] + [("k0", "only"), ("", "none"), (None, "none"), ("k1", ""), ("k1", None)]
    own += own[:9]
    rows = spark.createDataFrame(own, "key string, title string")
    expected = {(k, a, b) for k, a in own for m, b in own if k and a and b and k == m and a < b and titles.sequence_ratio(a, b, 0.8)}
    found = titles.met_in_blocks(rows, 0.8, block_rows=block_rows).collect()
    assert len(found) == len(expected) and {(r["key"], r["title_a"], r["title_b"]) for r in found} == expected
    jaccard = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    words = {(k, a, b) for k, a in own for m, b in own if k and a and b and k == m and a < b and jaccard(a, b) >= 0.4}
    assert {(r["key"], r["title_a"], r["title_b"]) for r in titles.met_in_blocks(rows, 1.0, overlap=0.4, block_rows=block_rows).collect()} == words


def similarity(a, b):
    if not a or not b:
        return None
    if a == b:
        return 1.0
    wa, wb = set(a.split(" ")), set(b.split(" "))
    short, long = sorted((a, b), key=len)
    begins = 0.95 if long.startswith(short + " ") and len(short.split(" ")) >= 6 else 0.0
    return max(len(wa & wb) / len(wa | wb), begins, titles.sequence_ratio(a, b))


def brute_classes(reps):
    out = {}
    for x in reps:
        for y in reps:
            if x["rep"] < y["rep"]:
                s = similarity(x["title"], y["title"])
                author = bool(x["author"] and y["author"] and set(x["keys"]) & set(y["keys"]))
                gap = None if x["year"] is None or y["year"] is None else abs(x["year"] - y["year"])
                year = gap is not None and gap <= 1
                if s is None:
                    if author and gap == 0:
                        out[x["rep"], y["rep"]] = (None, "possible")
                elif s >= 0.8 and (author or year):
                    out[x["rep"], y["rep"]] = (round(s, 6), "probable" if s >= 0.9 and author and year else "possible")
    return out


def test_classes_of_the_sample_are_those_of_all_pairs(spark):
    reps = catalog_linkage.bibliography(spark, SF)[0].collect()
    expected = brute_classes(reps)
    found = {(r["a"], r["b"]): (r["similarity"], r["class"]) for r in catalog.QUERIES["l2_ratio"](spark, SF).collect()}
    assert found == expected
    series = {(r["a"], r["b"]): r["rule"] for r in catalog.QUERIES["l4_ratio"](spark, SF).collect()}
    brute = {}
    for x in reps:
        for y in reps:
            if x["rep"] < y["rep"] and x["title"] and y["title"] and x["author"] and y["author"] and (x["rep"], y["rep"]) not in expected:
                wa, wb = set(x["title"].split(" ")), set(y["title"].split(" "))
                jaccard, gap, s = len(wa & wb) / len(wa | wb), abs(x["year"] - y["year"]), similarity(x["title"], y["title"])
                words = similarity(x["title"], y["title"]) if jaccard >= 0.6 else max(jaccard, 0.95 if s >= 0.95 else 0)
                if x["author"] == y["author"] and gap <= 5 and jaccard >= 0.4:
                    brute[x["rep"], y["rep"]] = "author"
                elif words >= 0.85 and gap >= 2 and x["title"] != y["title"]:
                    brute[x["rep"], y["rep"]] = "title"
    assert series == brute


def test_classes_of_spelling_variants(spark):
    rng = np.random.default_rng(4)
    authors = ["Mac Dowell A", "MacDowell A Jr", "Cano Pérez G", "Pérez", "van der Berg J", "van Dyk J", "[No authors listed]", None]
    rows = [(k, t, authors[rng.integers(len(authors))], "J", int(rng.integers(2000, 2004)) if rng.random() < 0.9 else None) for k, t in enumerate(variants(2))] + [(900, None, "Pérez", "J", 2001), (901, None, "Cano Pérez G", "J", 2001)]
    reps = linkage.signatures(spark.createDataFrame(rows, RECORD))[0]
    expected = brute_classes(reps.collect())
    found = {(r["a"], r["b"]): (round(r["similarity"], 6) if r["similarity"] is not None else None, r["class"]) for r in linkage.classified(reps).collect()}
    assert found == expected and (900, 901) in found
    by_words = {(r["a"], r["b"]) for r in linkage.classified(reps, full=False).collect()}
    assert by_words < set(found)


def test_guard_takes_the_ratio_and_any_key_of_a_name(spark):
    rows = [(1, "haemoglobinopathy", "Berg J", "x", 2000), (2, "hemoglobinopathies", "Dyk J", "x", 2009), (3, "something else", "Cano Pérez G", "x", 2000), (4, "translated title", "Pérez", "x", 2001), (5, "another", "Else", "x", 1990)]
    records = spark.createDataFrame(rows, RECORD)
    ids = spark.createDataFrame([(1, "doi", "d1"), (2, "doi", "d1"), (3, "doi", "d2"), (4, "doi", "d2"), (5, "doi", "d2")], "rec_id long, kind string, value string")
    verdicts = {(r["a"], r["b"]): r["verdict"] for r in linkage.guarded_links(records, ids).collect()}
    assert verdicts == {(2, 1): "same", (4, 3): "same", (5, 3): "bib_conflict"}
    assert {(r["a"], r["b"]): r["verdict"] for r in linkage.guarded_links(records, ids, full=False).collect()}[2, 1] == "bib_conflict"


def test_no_titles(spark):
    empty = spark.createDataFrame([], RECORD)
    reps = linkage.signatures(empty)[0]
    assert linkage.classified(reps).count() == 0 and titles.met_in_blocks(empty.select(F.col("author").alias("key"), "title"), 0.8).count() == 0


@pytest.mark.parametrize("small", [0, 60, 10_000])
def test_matching_blocks_are_those_of_difflib(monkeypatch, small):
    monkeypatch.setattr(titles, "SMALL", small)
    own = variants(5, 20) + ["ab" * 40, "ba" * 37, "a" * 50, "b"]
    for k, a in enumerate(own):
        for b in own[k:]:
            a, b = sorted((a, b))
            exact = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
            assert titles.sequence_ratio(a, b) == exact
            assert titles.sequence_ratio(a, b, 0.5) == (exact if exact >= 0.5 else 0.0)
            assert (titles.sequence_ratio(a, b, 0.5, decide=True) >= 0.5) == (exact >= 0.5)


def test_long_titles_are_settled_by_their_largest_parts(monkeypatch):
    """Two long titles of other words: a few blocks show that the ratio is too small."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeiou"), 5)) for _ in range(400)]
    a, b = (" ".join(rng.choice(words, 900)) for _ in range(2))
    calls = []
    longest = titles._longest
    monkeypatch.setattr(titles, "_longest", lambda x, y: calls.append(1) or longest(x, y))
    monkeypatch.setattr(titles.difflib, "SequenceMatcher", None)
    assert titles.sequence_ratio(a, b, 0.8) == 0.0 and len(calls) < 50


def test_no_block_holds_more_than_the_common_subsequence():
    own = variants(7, 12)
    for a in own:
        for b, n in zip(own, titles.common_lengths(a, own), strict=True):
            row = [0] * (len(b) + 1)
            for c in a:
                row = [0] + [before for before in _step(row, c, b)]
            assert n == row[-1]


def _step(row, c, b):
    left = 0
    for j, d in enumerate(b):
        left = row[j] + 1 if c == d else max(row[j + 1], left)
        yield left


def test_a_frequent_word_is_dealt_over_cells(spark, monkeypatch):
    monkeypatch.setattr(linkage, "WORD_TITLES", 3)
    own = sorted({t for t in variants(9, 40) if len(t.split()) > 1})
    reps = spark.createDataFrame([(t,) for t in own], "title string")
    words = lambda t: set(t.split(" "))
    for least in (0.6, 0.8):
        expected = {(a, b) for a in own for b in own if a <= b and len(words(a) & words(b)) / len(words(a) | words(b)) >= least}
        found = linkage.similar_titles(reps, least).where("similarity <> 0.95").collect()
        assert {(r["title_a"], r["title_b"]) for r in found} == {(a, b) for a, b in expected if len(words(a) & words(b)) / len(words(a) | words(b)) != 0.95} and len(found) == len({(r["title_a"], r["title_b"]) for r in found})


def test_blocks_meet_once_and_shuffle_no_pairs(spark):
    rng = np.random.default_rng(4)
    own = [(k, t, str(rng.choice(["", "ames", "bohm", "chen"]))) for k, t in enumerate(["", "diet", "a 12 of"] + variants(11, 30))]
    reps = spark.createDataFrame(own, "rep long, title string, author string")
    words = {k: {w for w in t.split(" ") if len(w) >= 3 and not w.isdigit()} for k, t, _ in own}
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    rare = {k: {w for w in x if df[w] <= max(9, len(own) / 10)} for k, x in words.items()}
    expected = set()
    for k, (a, _, p) in enumerate(own):
        for b, _, q in own[k + 1 :]:
            shared = len(rare[a] & rare[b])
            named = shared >= 2 or (shared == 1 and min(len(words[a]), len(words[b])) <= 2)
            if named or (p == q != ""):
                expected.add((a, b, shared if named else 0, p == q != ""))
    for block_rows in (7, 1000):
        made = linkage.blocked_pairs(reps, max_df=9, block_rows=block_rows)
        found = [tuple(r) for r in made.select("a", "b", "shared", "same_author").collect()]
        assert set(found) == expected and len(found) == len(expected)
        assert made._jdf.queryExecution().optimizedPlan().nodeName() == "FlatMapGroupsInArrow"


def test_pairs_are_counted_a_few_titles_at_a_time(monkeypatch):
    rows = [(0, 0, 0, k, [k % 3, 3 + k % 5], 2, "x" if k % 4 == 0 else None) for k in range(40)]
    names = ["i", "j", "at", "rep", "words", "n_tokens", "author"]
    cell = pa.table({c: pa.array(list(v)) for c, v in zip(names, zip(*rows, strict=True), strict=True)})
    pairs = lambda: sorted(tuple(r.values()) for b in linkage._met_pairs(iter(cell.to_batches())) for r in b.to_pylist())
    whole = pairs()
    monkeypatch.setattr(linkage, "MET_PAIRS", 50)
    monkeypatch.setattr(linkage, "MET_BATCH", 3)
    assert pairs() == whole and len(whole) > 100


def test_letter_groups_leave_out_no_common_subsequence():
    own = sorted({*variants(13, 30), "é" * 9 + " diet", "zz 12"}, key=lambda t: (len(t), t))
    letters = titles._Letters(own)
    for k in range(len(own) - 1):
        rest = np.arange(k + 1, len(own))
        n = titles.common_lengths(own[k], [own[m] for m in rest])
        for share in (0.3, 0.4, 0.45):
            enough = share * np.array([len(own[k]) + len(own[m]) for m in rest]) - 1e-9
            assert letters.may_share(k, rest, enough).tolist() == rest[n >= enough].tolist()


def test_titles_of_which_neither_leads_do_not_meet(spark):
    """A year's titles meet once, not with those of the year behind again; unweighed pairs hold all that have the ratio."""
    own = [("y1", t, k % 3 == 0) for k, t in enumerate(variants(1))]
    leads = {t for _, t, lead in own if lead}
    rows = spark.createDataFrame(own, "key string, title string, lead boolean")
    expected = {(a, b) for _, a, _ in own for _, b, _ in own if a < b and (a in leads or b in leads) and titles.sequence_ratio(a, b, 0.8)}
    for weighed in (True, False):
        found = [(r["title_a"], r["title_b"]) for r in titles.met_in_blocks(rows, 0.8, block_rows=20, weighed=weighed).collect()]
        assert len(found) == len(set(found)) and (set(found) == expected if weighed else set(found) >= expected)
    assert set(found) != {(a, b) for _, a, _ in own for _, b, _ in own if a < b}


def test_ratio_of_a_pair_is_taken_once(spark):
    rows = [(k, t, "Pérez", "J", 2000 + k % 2) for k, t in enumerate(variants(2))]
    reps = linkage.signatures(spark.createDataFrame(rows, RECORD))[0]
    found = {(r["title_a"], r["title_b"]): r["similarity"] for r in linkage.ratio_pairs(reps).collect()}
    plan = linkage.ratio_pairs(reps)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.index("MapInArrow") < plan.index("FlatMapGroupsInArrow")
    own = sorted({r["title"] for r in reps.collect()})
    assert found == {(a, b): titles.sequence_ratio(a, b) for a in own for b in own if a < b and titles.sequence_ratio(a, b) >= 0.8}


def test_bits_differ_at_most_by_the_words_that_one_title_has_alone(spark):
    own = [t.split() for t in variants(9, 40)]
    rows = spark.createDataFrame([(sorted(set(w)),) for w in own], "w array<string>")
    marks = [[r[k] & (2**64 - 1) for k in range(linkage.MARKS)] for r in rows.select(*[linkage._mark(F.col("w"), k) for k in range(linkage.MARKS)]).collect()]
    for a, x in zip(own, marks, strict=True):
        for b, y in zip(own, marks, strict=True):
            n = sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True))
            assert n <= len(set(a) ^ set(b)) and n % 2 == len(set(a) ^ set(b)) % 2


@pytest.mark.parametrize("name", ["l4_series", "l4_ratio"])
def test_similar_titles_are_looked_for_once(spark, monkeypatch, name):
    calls, similar = [], linkage.similar_titles
    monkeypatch.setattr(linkage, "similar_titles", lambda *a: calls.append(1) or similar(*a))
    assert catalog.QUERIES[name](spark, SF).columns == ["a", "b", "rule"] and len(calls) == 1
