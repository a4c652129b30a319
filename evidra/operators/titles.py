"""Similarity of titles by their matching blocks, within the groups that may hold similar ones.

The sequence ratio of two texts is twice the characters in their matching blocks (the longest common block, and so on to its left
and right) over the characters of both. Pairs are formed within one group key, block by block: a key's records are dealt over
blocks and each two blocks meet in one task, so no task holds a key. A pair is compared in full only if its lengths, its
characters and its pairs of neighbouring characters allow the ratio that is asked for; these bounds leave out no pair.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records of one key that meet in one block, and groups of letters that are compared one after the other.
BLOCK_ROWS, GROUPS = 1024, 3
#: Parts of two texts up to this product of lengths are matched letter by letter.
SMALL = 10_000
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
_PLACE = np.full(256, len(_LETTERS), np.int64)
_PLACE[np.frombuffer(_LETTERS.encode(), np.uint8)] = np.arange(len(_LETTERS))


def sequence_ratio(a: str, b: str, least: float = 0.0, decide: bool = False) -> float:
    """Of two texts, in code-point order (the measure may depend on it); 0 where it is seen to be below ``least``. To ``decide`` only
    whether it is ``least``, any number from there up to the ratio."""
    a, b = (a, b) if a <= b else (b, a)
    both = len(a) + len(b)
    if a == b:
        return 1.0
    if 2 * min(len(a), len(b)) < least * both or 2 * (Counter(a) & Counter(b)).total() < least * both:
        return 0.0
    # Of a common subsequence of L characters at least 3 L - both - 1 neighbours stand in both texts.
    pairs = (Counter(zip(a, a[1:], strict=False)) & Counter(zip(b, b[1:], strict=False))).total()
    if pairs < (1.5 * least - 1) * both - 1 - 1e-9:
        return 0.0
    ratio = 2.0 * _matched(a, b, least * both / 2 - 1e-9, decide) / both
    return ratio if ratio >= least else 0.0


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int] | None:
    """(i, j, length) of the longest common block of two arrays of code points, the first in ``a`` and then in ``b``: a search for the
    length over hashes of all blocks of one length. None where hashes met by chance."""
    base = np.uint64(0x9E3779B97F4A7C15)
    most = min(a.size, b.size)
    powers = np.cumprod(np.full(max(a.size, b.size) + 1, base, np.uint64))

    def hashed(x: np.ndarray) -> np.ndarray:  # sums of x[k] base^(k + 1) before each place
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers[: x.size])])

    sums = hashed(a), hashed(b)

    def blocks(side: int, length: int) -> np.ndarray:  # all brought to one power, so that equal blocks have equal numbers
        n = sums[side].size - length
        return (sums[side][length:] - sums[side][:n]) * powers[powers.size - n :][::-1]

    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if np.isin(blocks(0, middle), blocks(1, middle)).any():
            low = middle
        else:
            high = middle - 1
    if low == 0:
        return 0, 0, 0
    x, y = blocks(0, low), blocks(1, low)
    i = int(np.argmax(np.isin(x, y)))
    j = int(np.argmax(y == x[i]))
    return (i, j, low) if np.array_equal(a[i : i + low], b[j : j + low]) else None


def _matched(a: str, b: str, enough: float, decide: bool = False) -> int:
    """The characters in the matching blocks of two texts, as difflib finds them; 0 as soon as they are seen to be fewer than
    ``enough``, and, to ``decide`` only, any number from ``enough`` on as soon as there are as many."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    open_parts, matched, possible = [(0, len(a), 0, len(b))], 0, min(len(a), len(b))
    while open_parts:
        # The largest part first: it settles most.
        open_parts.sort(key=lambda p: min(p[1] - p[0], p[3] - p[2]))
        alo, ahi, blo, bhi = open_parts.pop()
        size = min(ahi - alo, bhi - blo)
        found = _longest(x[alo:ahi], y[blo:bhi]) if (ahi - alo) * (bhi - blo) > SMALL else None
        if found is None:
            n = sum(m.size for m in difflib.SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks())
            matched, possible = matched + n, possible - size + n
        else:
            i, j, n = found
            possible -= size
            if n:
                parts = ((alo, alo + i, blo, blo + j), (alo + i + n, ahi, blo + j + n, bhi))
                parts = [p for p in parts if p[0] < p[1] and p[2] < p[3]]
                open_parts += parts
                matched, possible = matched + n, possible + n + sum(min(p[1] - p[0], p[3] - p[2]) for p in parts)
        if possible < enough:
            return 0
        if decide and matched >= enough:
            return matched
    return matched


def common_lengths(one: str, others: list[str]) -> np.ndarray:
    """The lengths of the longest common subsequences of a text and each of others, bit by bit: the others stand in one number, with a
    bit between them that takes the carry. No matching blocks hold more characters."""
    text = "\0".join(others) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    free = number(codes != 0)
    masks = {c: number(codes == ord(c)) for c in set(one)}
    state = free
    for c in one:
        hit = state & masks[c]
        state = ((state + hit) | (state - hit)) & free
    zeros = 1 - np.unpackbits(np.frombuffer(state.to_bytes((codes.size + 7) // 8, "little"), np.uint8), bitorder="little")[: codes.size].astype(np.int64)
    ends = np.flatnonzero(codes == 0)
    return np.diff(np.concatenate([[0], np.cumsum(zeros)[ends]])) - 1


def with_ratio(pairs: DataFrame, least: float, asked: Column | None = None, decide: bool = True) -> DataFrame:
    """``pairs`` (title_a, title_b, ...) with ratio, 0 where it is below ``least``, else a number from ``least`` up to the ratio, or the
    ratio unless it is only to ``decide``; 0, too, where it is not ``asked`` for."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, wanted = (batch.column(c).to_pylist() for c in ("title_a", "title_b", "__asked"))
            ratios = [sequence_ratio(x, y, least, decide) if w else 0.0 for x, y, w in zip(a, b, wanted, strict=True)]
            yield batch.append_column("ratio", pa.array(ratios, pa.float64()))

    own = pairs.withColumn("__asked", F.coalesce(asked, F.lit(False)) if asked is not None else F.lit(True))
    return own.mapInArrow(compare, own.drop("ratio").schema.add("ratio", "double")).drop("__asked")


def _word_marks(words: list[frozenset[str]]) -> np.ndarray:
    """uint64[sets, 4]: each word of a set turns one bit; words that two sets share leave no difference between theirs."""
    out = np.zeros((len(words), 4), np.uint64)
    for k, own in enumerate(words):
        at = np.array([hash(w) & 255 for w in own], np.int64)
        np.bitwise_xor.at(out[k], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


class _Letters:
    """Titles by their letters: how often each occurs, and what is left of a title within each of GROUPS groups of letters. The longest
    common subsequence of two titles holds no more than those of their parts together, and these take much less work."""

    def __init__(self, titles: list[str]) -> None:
        self.titles = titles
        self.counts = np.ascontiguousarray(_histograms(titles).T)
        every = self.counts.sum(axis=1)
        self.group, weight = np.zeros(every.size, np.int64), np.zeros(GROUPS, np.int64)
        for c in np.argsort(-every, kind="stable"):
            self.group[c] = weight.argmin()
            weight[self.group[c]] += every[c]
        self.parts: dict[int, list[str]] = {}

    def _parts(self, k: int) -> list[str]:
        if k not in self.parts:
            codes = np.frombuffer(self.titles[k].encode("ascii", "replace"), np.uint8)
            place = _PLACE[codes]
            self.parts[k] = [(place[self.group[place] == g] + 1).astype(np.uint8).tobytes().decode("ascii") for g in range(GROUPS)]
        return self.parts[k]

    def may_share(self, k: int, others: np.ndarray, enough: np.ndarray) -> np.ndarray:
        """Of ``others``, those that may have ``enough`` characters in common with title ``k`` in one order; ``others`` is sorted."""
        if not others.size:
            return others
        lowest, end = int(others[0]), int(others[-1]) + 1
        own = self.counts[:, k : k + 1]
        most = np.minimum(own, self.counts[:, lowest:end]).sum(axis=0, dtype=np.int32)[others - lowest].astype(np.int64)
        kept = most >= enough
        others, enough, most = others[kept], enough[kept], most[kept]
        for g in range(GROUPS):
            if not others.size:
                return others
            of_group = np.flatnonzero(self.group == g)
            most -= np.minimum(own[of_group], self.counts[of_group][:, others]).sum(axis=0)
            most += common_lengths(self._parts(k)[g], [self._parts(int(m))[g] for m in others])
            kept = most >= enough
            others, enough, most = others[kept], enough[kept], most[kept]
        return others[common_lengths(self.titles[k], [self.titles[int(m)] for m in others]) >= enough] if others.size else others


def many_parts(df: DataFrame) -> int:
    """Partitions for work that goes with the square of its rows: sixteen for each core, so that none is much longer than the others."""
    spark = df.sparkSession
    return max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _histograms(titles: list[str]) -> np.ndarray:
    out = np.zeros((len(titles), len(_LETTERS) + 1), np.int32)
    for k, title in enumerate(titles):
        out[k] = np.bincount(_PLACE[np.frombuffer(title.encode("ascii", "replace"), np.uint8)], minlength=out.shape[1])
    return out


def met_in_blocks(rows: DataFrame, least: float, overlap: float | None = None, block_rows: int = BLOCK_ROWS, weighed: bool = True) -> DataFrame:
    """(key, title_a, title_b, ratio, jaccard), title_a < title_b: pairs of different titles of rows (key, title) that share a key and
    have a sequence ratio of ``least`` or more, or (if given) a Jaccard similarity of words of ``overlap`` or more; the ratio is 0
    if below ``least``. A row for each such pair and key: nothing else leaves a block. A key of n titles is n / ``block_rows`` blocks,
    of which each two meet in a task. If rows have a column lead, titles of which neither leads do not meet. Unless ``weighed``, the ratio
    is null and pairs are those that may have it, so that it can be taken once for pairs of several keys, spread over tasks."""
    lead = F.col("lead") if "lead" in rows.columns else F.lit(True)
    own = rows.where("key <> '' AND title <> ''").groupBy("key", "title").agg(F.bool_or(lead).alias("lead"))
    # Lengths of a ratio r differ by a factor of (2 - r) / r at most, so a title meets its own band of lengths and the one above.
    step = math.log((2 - least) / least) if 0 < least < 1 else 40.0
    if overlap is None:
        band = F.floor(F.log(F.length("title")) / step + 1e-9).cast("int")
        own = own.withColumn("own", band).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    else:
        own = own.withColumns({"own": F.lit(0), "band": F.lit(0)})
    own = own.withColumn("key", F.concat_ws("|", "key", F.col("band").cast("string")))
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    placed = own.join(sizes, "key").withColumn("at", F.pmod(F.xxhash64("title"), F.col("blocks")).cast("int"))
    # Block k meets the blocks from k on: as the first of the two, and as the second of those before it.
    placed = placed.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("at", o).alias("i"), F.greatest("at", o).alias("j")))))
    schema = "key string, title_a string, title_b string, ratio double, jaccard double"

    def meet(group: pa.Table) -> pa.Table:
        key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
        found: list[tuple] = []
        rows_of = zip(*(group.column(c).to_pylist() for c in ("title", "at", "own", "lead")), strict=True)
        order = sorted(rows_of, key=lambda r: (len(r[0]), r[0]))
        titles, at, own_band, leads = [r[0] for r in order], *(np.array([r[c] for r in order]) for c in (1, 2, 3))
        band_of_key = int(key.rpartition("|")[2])
        size = np.array([len(t) for t in titles])
        letters = _Letters(titles) if least < 1 else None  # no two titles are equal
        words = [frozenset(t.split(" ")) for t in titles] if overlap is not None else []
        n_words, marks = np.array([len(w) for w in words]), _word_marks(words)
        # The titles are in the order of their lengths.
        ends = np.searchsorted(size, size * (2 - least) / least + 1e-6, "right") if 0 < least < 1 else np.full(size.size, size.size)
        for k in range(len(titles) - 1):
            rest = np.arange(k + 1, len(titles) if overlap is not None else ends[k])
            meets = np.maximum(own_band[rest], own_band[k]) == band_of_key
            if i != j:
                meets &= at[rest] != at[k]
            if not leads[k]:
                meets &= leads[rest]
            rest = rest[meets]
            like = rest[:0]
            if overlap is not None:
                both = n_words[k] + n_words[rest]
                apart = np.bitwise_count(marks[k] ^ marks[rest]).sum(axis=1)
                like = rest[(apart <= (1 - overlap) / (1 + overlap) * both + 1e-9) & (np.minimum(n_words[k], n_words[rest]) >= overlap * np.maximum(n_words[k], n_words[rest]) - 1e-9)]
            near = set()
            if letters is not None:
                close = rest[2 * np.minimum(size[k], size[rest]) >= least * (size[k] + size[rest])]
                near = set(letters.may_share(k, close, least * (size[k] + size[close]) / 2 - 1e-9).tolist())
            for m in sorted(near | set(like.tolist())):
                other = titles[m]
                shared = len(words[k] & words[m]) if overlap is not None else 0
                jaccard = shared / (n_words[k] + n_words[m] - shared) if overlap is not None else 0.0
                ratio = sequence_ratio(titles[k], other, least) if weighed and m in near else 0.0
                if not weighed and m in near:
                    found.append((key.rpartition("|")[0], min(titles[k], other), max(titles[k], other), None, float(jaccard)))
                elif (ratio > 0 and ratio >= least) or (overlap is not None and jaccard >= overlap):
                    found.append((key.rpartition("|")[0], min(titles[k], other), max(titles[k], other), ratio, float(jaccard)))
        columns = list(zip(*found, strict=True)) or [[]] * 5
        kinds = [pa.string()] * 3 + [pa.float64()] * 2
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "title_a", "title_b", "ratio", "jaccard"])

    # The work of a group is not in its bytes, so its partitions are not to be put together by their size.
    cells = placed.select("key", "cell.i", "cell.j", "at", "own", "lead", "title").repartition(many_parts(rows), "key", "i", "j")
    return cells.groupBy("key", "i", "j").applyInArrow(meet, schema)
