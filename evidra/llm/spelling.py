"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' values, each a power of the letter's code point, so anagrams share a key and a letter
that is added, removed or exchanged changes it by the values of the letters concerned. Each word gives its own key and its
key less each of its letters; words that differ by one letter meet there: a removal in the other word's own key, an exchange
in the key that both have left. The order of letters is then verified by the edit distance of the two words.

One letter lies in one half of a word, so the other half is the same in both. It is part of the join key: buckets hold the
anagrams of half a word instead of those of all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_TIMES, NOISE, FACTOR = 5, 3, 97, 2
POWER, MODULUS = 5, 1 << 61


def noisy_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE) -> DataFrame:
    """(word) of each maximal run of letters, A-Z lower-cased. Where ``noise`` divides the crc32 of ``<id>:<run>`` (a null id is
    empty), the run loses its code point crc32 % length. A null text has no run."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"), F.explode(F.regexp_extract_all(low, F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat(F.col("__id"), F.lit(":"), F.col("run"))).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, letters: int = LEAST_LETTERS, times: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of the words of at least ``letters`` code points that occur at least ``times`` times."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def value_of(letter: Column) -> Column:
    """A letter's code point to the power POWER; letters are those of RUN (or any below 6,000), so it is below MODULUS."""
    code = F.ascii(letter).cast("long")
    power = code
    for _ in range(POWER - 1):
        power = power * code
    return power


def anagram_entries(words: DataFrame) -> DataFrame:
    """(key, half, word, n, removed): each word under its own key and its key less each distinct letter of a half, along with
    the half that stays whole. Keys are sums modulo MODULUS, so a word may have any length."""
    letters = F.split("word", "")
    key = F.aggregate("letters", F.lit(0).cast("long"), lambda s, c: (s + value_of(c)) % F.lit(MODULUS))
    base = words.select("word", "n", letters.alias("letters")).select("word", "n", "letters", key.alias("whole"), F.size("letters").alias("size"))
    head = lambda n: F.concat(F.lit("<"), F.substring("word", F.lit(1), n))
    tail = lambda n: F.concat(F.lit(">"), F.expr("right(word, %s)" % n))
    # Without one letter a word has size - 1 letters: a first half of h of them, and size - 1 - h behind.
    cut = base.withColumn("h", F.floor((F.col("size") - 1) / 2).cast("int"))
    behind = F.transform(F.array_distinct(F.slice("letters", F.col("h") + 1, F.col("size"))), lambda c: F.struct(value_of(c).alias("value"), head(F.col("h")).alias("half")))
    before = F.transform(F.array_distinct(F.slice("letters", F.lit(1), F.col("h"))), lambda c: F.struct(value_of(c).alias("value"), tail("size - 1 - h").alias("half")))
    less = cut.select("word", "n", "whole", F.explode(F.concat(behind, before)).alias("e")).select(F.pmod(F.col("whole") - F.col("e.value"), F.lit(MODULUS)).alias("key"), F.col("e.half").alias("half"), "word", "n", F.lit(True).alias("removed"))
    cut = base.withColumn("h", F.floor(F.col("size") / 2).cast("int"))
    own = cut.select("word", "n", "whole", F.explode(F.array(head(F.col("h")), tail("size - h"))).alias("half")).select(F.col("whole").alias("key"), "half", "word", "n", F.lit(False).alias("removed"))
    return less.union(own)


def near_words(entries: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways and once each, of words that differ by exactly one letter added, removed or exchanged."""
    other = entries.select("key", "half", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("removed").alias("other_removed"))
    met = entries.join(other, ["key", "half"]).where("word < other AND (removed OR other_removed)")
    near = met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()
    return near.select(F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("e")).select("e.*")


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) of rows (word, form): the end of the chain of forms. Each round doubles the links that are followed; forms
    lead to ever more frequent words, so no chain comes back."""
    ends = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        after = stored(ends.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        forget(ends)
        ends = after
        if not after.where("moved").head(1):
            return after.select("word", "root")
    raise RuntimeError(f"forms do not end within {max_rounds} rounds")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row (word, n).

    ``form`` is the near word of the largest n (of equals the first in code-point order) if that is at least ``factor`` times
    the word's own n (``factor`` > 1), else null; ``root`` is where forms lead, the word itself if it has none; ``n_near``
    counts near words. An empty table gives an empty result.
    """
    near = near_words(anagram_entries(words))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("order"), "other")).alias("best"))
    large = -F.col("best.order") >= factor * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.other")).alias("form"), F.when(large, -F.col("best.order")).alias("form_n"))
    found = stored(found, "variants")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of whole ``docs`` (doc_id, text) after ``noisy_runs``. Repeated rows count as often as they
    stand there; other columns are not read."""
    return variants(stored(vocabulary(noisy_runs(docs)), "words"))


SQL = r"""
WITH RECURSIVE tab0 AS (SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM tab0 WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS tab FROM tab0 WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY doc_id, run),
coded AS (SELECT run, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS bytes FROM runs),
hashed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295::BIGINT) AS h FROM coded, tab),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed),
v AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
less AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b USING (rest, k) WHERE a.word <> b.word UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""
