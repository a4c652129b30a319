import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidra.llm import filteraudit, queries, spelling, wavelet
from evidra.llm.shared import new_folder

from ..compare import assert_same
from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask string, word string, n string, key string"


def rows_of(spark, rows):
    """Documents (doc_id, text, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, lang, "s", 1, "clash", "clash", "clash", "clash", "clash") for k, t, lang in rows], DOCS)


# ---- filter audit ----


def brute_audit(rows, labels):
    texts = [(t or "") for _, t, _ in rows]
    least = {}
    for (k, _, _), t in zip(rows, texts, strict=True):
        if k is not None:
            least[t] = min(least.get(t, k), k)
    good, toxic = ({k for k, q, x in labels if k is not None and (q, x)[which] == 1} for which in (0, 1))
    fails = []
    for (k, _, lang), t in zip(rows, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": k is not None and k > least[t],
        }
        fails.append((lang or "", k, out))
    found = set()
    for part in {lang for lang, _, _ in fails}:
        own = [(k, f) for lang, k, f in fails if lang == part]
        steps, totals = [], Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for step, name in enumerate(order, 1):
                gone = [(k, f) for k, f in left if f[name]]
                left = [(k, f) for k, f in left if not f[name]]
                totals[name] += len(gone)
                failing = sum(f[name] for _, f in own)
                alone = sum(f[name] and sum(f.values()) == 1 for _, f in own)
                steps.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone), name))
        found |= {(*s[:9], totals[s[9]]) for s in steps}
    return found


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_audit_against_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(120))
    rows = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, None), (None, long, "en"), (None, None, ""), (4, "", "de"), (5, None, "de"), (6, "A B C", "de"), (7, long + " # $", "en"), (8, "same " * 300, "en"),
        (9, "ABC " * 200, "en"), (9, "same " * 300, "en"), (10, "é" * 50, "fr"), (11, "x" * 200_000, "fr"), (0, "same " * 300, "fr"), (12, long + "\x85a b", "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (9, None, 1), (None, 1, 1), (4, 1, None), (11, 0, 1), (8, 1, 0)]
    found = filteraudit.filter_audit(rows_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == 600 * 4
    assert {tuple(r[c] for c in COLUMNS) for r in found} == brute_audit(rows, labels)


def test_audit_of_no_documents(spark):
    assert filteraudit.filter_audit(rows_of(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6])
def test_walk_visits_all_orders_by_swaps_of_neighbours(n):
    rng = np.random.default_rng(n)
    cells = rng.integers(0, 50, (1 << n, 3))
    orders, counts, shapley = filteraudit.walk(cells, n)
    assert sorted(orders) == sorted(permutations(range(n)))
    totals = np.zeros(n, int)
    for order, steps in zip(orders, counts, strict=True):
        gone = 0
        for step, f in enumerate(order):
            hit = np.array([not m & gone and bool(m >> f & 1) for m in range(1 << n)])
            gone |= 1 << f
            assert steps[step].tolist() == [cells[[not m & gone for m in range(1 << n)], 0].sum(), *cells[hit].sum(axis=0)]
            totals[f] += steps[step][1]
    assert shapley.tolist() == totals.tolist()
    for a, b in zip(orders, orders[1:], strict=False):
        changed = [k for k in range(n) if a[k] != b[k]]
        assert len(changed) == 2 and changed[1] == changed[0] + 1


def test_audit_takes_a_few_named_filters(spark):
    cells = spark.createDataFrame([("p", 1, 5, 1, 0), ("p", 2, 7, 0, 2), ("p", 3, 2, 1, 1), ("p", 0, 4, 4, 0)], "part string, mask int, n long, good long, toxic long")
    found = {(r["filter_order"], r["step"]): r for r in filteraudit.audited(cells, "XY").collect()}
    assert found["YX", 2]["removed"] == 5 and found["YX", 2]["redundant"] == 2 and found["XY", 1]["shapley"] == 12 and found["XY", 2]["kept"] == 4
    with pytest.raises(ValueError):
        filteraudit.audited(cells, "ABCDEFGHI")


# ---- token ids ----

HARD = ["word. . word, , é! !", "a  b", " a", "a ", "", "  ", None, "a \n b\n c", "x y   z", "it's 'll don't  I'm", "\x1c \x1c a \x1d b", " <|endoftext|> b<|endoftext|>", "漢字 かな  é", "日本 Ġ Ġa ĠĠ", "...  --- !!! \t\t x", "\x85 \x85x 1234 56 7", "!" * 50, "word " * 4000, "x" * 50_000]


def encoded(texts):
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(queries.TOKENIZER)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_encoder_gives_the_ids_of_the_library():
    with open(queries.TOKENIZER, encoding="utf-8") as source:
        coded = wavelet.Encoder(source.read())
    assert coded.by_words
    for by_words in (True, True, False):  # again, with what the first time left in memory
        coded.by_words = by_words
        ids, at = coded.encode(pa.array(HARD, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == encoded(HARD)
    ids, at = coded.encode(pa.array([], pa.string()))
    assert not ids.size and at.tolist() == [0]


@pytest.mark.parametrize("ids", [[], [0], [0, 0, 0], [5], [1 << 20, 3, 1 << 20, 0], None])
def test_file_gives_access_counts_and_places(ids):
    rng = np.random.default_rng(2)
    ids = (rng.geometric(0.01, 100_000) % 50_257 if ids is None else np.array(ids)).astype(np.uint32)
    starts = np.arange(0, ids.size, 3)
    shard = wavelet.WaveletFile(pa.BufferReader(wavelet.pack(ids, [None, *range(1, starts.size)][: starts.size], starts)))
    assert (shard.ids() == ids).all() and shard.n == ids.size and shard.starts[:-1].tolist() == starts.tolist()
    assert shard.doc_ids == [None, *range(1, starts.size)][: starts.size]
    for at in rng.integers(0, ids.size, 30) if ids.size else []:
        assert shard.access(int(at)) == ids[at]
    for token in [*np.unique(ids)[:40].tolist(), 7, 1 << 25]:
        places = np.flatnonzero(ids == token)
        assert shard.locate(token).tolist() == places.tolist() and shard.count(token) == places.size
        low, high = ids.size // 4, ids.size // 2
        assert shard.count(token, low, high) == ((places >= low) & (places < high)).sum() and shard.locate(token, low, high).tolist() == places[(places >= low) & (places < high)].tolist()


def test_damage_is_noticed():
    data = bytearray(wavelet.pack(np.arange(5000, dtype=np.uint32), [1], np.array([0])))
    data[-80] ^= 1
    with pytest.raises(ValueError):
        wavelet.WaveletFile(pa.BufferReader(bytes(data)))


def brute_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for (k, _, _), ids in zip(order, encoded([t for _, t, _ in order]), strict=True):
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    found = [tuple(r) for r in queries.op12_token_ids(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(found) == sorted(brute_rows(rows))


def test_shards_of_hard_rows(spark):
    rows = [(k // 2 * 7 if k % 5 else k * 3 + 100, t, "en") for k, t in enumerate(HARD)] + [(None, "no id", "en"), (42, "same", "en"), (42, "same", "en"), (42, "other", "en")]
    folder = new_folder(spark, "tokens")
    index = wavelet.written(rows_of(spark, rows), queries.TOKENIZER, folder, shard_tokens=40, at_once=100)
    assert index.where("number > 0").count() > 0
    found = sorted(wavelet.document_rows(index).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda k: (k is not None, k or 0))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((k, n, c) for k, _, n, c in brute_rows(rows))
    assert [r["start"] for r in found] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in found])[:-1])).tolist()

    # The corpus as written: access, counts and occurrences by id.
    every = {}
    for (_, start), own in (((r["file"], r["start"]), wavelet.WaveletFile(wavelet._opened(r["file"])).ids()) for r in index.collect()):
        every.update((start + k, int(t)) for k, t in enumerate(own))
    assert sorted(every) == list(range(len(every)))
    wanted = [0, every[0], every[len(every) - 1], 50_256, 49_999]
    assert {r["token"]: r["n"] for r in wavelet.token_counts(index, wanted).collect()} == {t: sum(x == t for x in every.values()) for t in set(wanted)}
    places = wavelet.token_places(index, wanted).collect()
    assert {(r["token"], r["position"]) for r in places} == {(t, p) for p, t in every.items() if t in wanted}
    assert all(max((r["start"], repr(r["doc_id"])) for r in found if r["start"] <= p["position"])[1] == repr(p["doc_id"]) for p in places[:200])
    at = spark.range(-2, len(every) + 3, 7).select(F.col("id").alias("position"))
    assert {r["position"]: r["token"] for r in wavelet.tokens_at(index, at, 1_000).collect()} == {p: every[p] for p in range(-2, len(every) + 3, 7) if p in every}


def test_no_documents_no_shards(spark):
    index = wavelet.written(rows_of(spark, []), queries.TOKENIZER, new_folder(spark, "tokens"))
    assert index.count() == 0 and wavelet.document_rows(index).count() == 0


# ---- spelling variants ----


def edits(a, b):
    """Whether the words differ by one letter added, removed or exchanged."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    out = {}
    near = {w: [o for o in counts if edits(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def brute_words(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for k, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def found_variants(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_variants_against_brute_force(spark):
    rng = np.random.default_rng(5)
    letters = list("abcdéÿàz")
    counts = {"".join(rng.choice(letters, rng.integers(5, 8))): int(rng.integers(3, 400)) for _ in range(700)}
    counts |= {"aaaaa": 5, "aaaaaa": 10, "aaaaaaa": 20, "aaaaaaaa": 40, "aaaaaaaab": 80, "abcde": 9, "abcdf": 18, "abcdg": 18, "x" * 3000: 7, "x" * 3001: 15, "ab" * 1500: 3, "ab" * 1499 + "ba": 8}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found_variants(spelling.variants(words)) == brute_variants(counts)


def test_variants_of_documents(spark):
    rows = [(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(None, "Straße STRASSE strasse straße Écoles écoles ÉCOLES " * 40, None), (None, None, None), (3, "", None), (3, "letter letters letterz " * 200, None), (3, "letter letters letterz " * 200, None), (4, "q" * 30_000 + " ", None)]
    expected = brute_words(rows)
    assert found_variants(spelling.spelling_variants(rows_of(spark, rows))) == brute_variants(expected)


def test_no_words_no_variants(spark):
    assert spelling.spelling_variants(rows_of(spark, [])).count() == 0
    assert spelling.spelling_variants(rows_of(spark, [(1, None, "en"), (2, "one two", "en")])).count() == 0


def test_a_word_meets_few_others(spark):
    """Anagrams of one another meet only where half of the word is the same."""
    rng = np.random.default_rng(6)
    words = {"".join(rng.permutation(list("abcdefghijkl"))) for _ in range(3000)}
    entries = spelling.anagram_entries(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))
    largest = entries.groupBy("key", "half").agg(F.countDistinct("word").alias("n")).agg(F.max("n")).first()[0]
    assert largest <= 12
