"""Benchmark passages in documents, found with Wu-Manber multi-pattern search over words.

Patterns are windows of ``WINDOW`` consecutive words of benchmark texts. Symbols are words. For patterns of one length m,
a shift table maps the hash of a block of two words (one, if m is 1) to how far the search may move on; where the shift
is 0, the buckets of that block's hash name the patterns that end so, and the words themselves are compared.

The benchmark is dealt into parts of about ``PART_WORDS`` words at most. Tasks build the tables of a part and write them as a file
in the shared folder, which the searching tasks open; nothing of the benchmark but file names passes the driver. Each part is one
search over the whole documents. Of all parts but the last only hits are kept, by the text's digest; the last search adds them.
"""

from __future__ import annotations

import functools
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import new_folder, stored
from .textnum import ALNUM, LOWER, blocks, mix64, spans, text_bytes, word_hashes
from .warc import filesystem

WINDOW = 10
PART_WORDS = 500_000
_SECOND = np.uint64(0x8CB92BA72F3D8DD7)


def _words(text: str | None) -> list[bytes]:
    data, offsets = text_bytes(pa.array([text], pa.string()))
    start, end, _ = spans(data, offsets, ALNUM)
    low = LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(start, end, strict=True)]


def _hashed(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    return word_hashes(data, start, start + lengths)


class WuManber:
    """Search tables for word sequences of one length ``m``: those of patterns[k] belong to the items owners[k]."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set[int]]) -> None:
        self.m, self.block = m, min(m, 2)
        self.furthest = m - self.block + 1
        self.patterns = {b" ".join(words): sorted(items) for words, items in patterns.items()}
        shift: dict[int, int] = {}
        self.bucket: dict[int, set[bytes]] = {}
        for words in patterns:
            keys = self.block_keys(_hashed(list(words))).tolist()
            for place, key in enumerate(keys):
                shift[key] = min(shift.get(key, self.furthest), self.furthest - 1 - place)
            self.bucket.setdefault(keys[-1], set()).add(b" ".join(words))
        keys = np.fromiter(shift, np.uint64, len(shift))
        order = np.argsort(keys)
        self.keys, self.shift = keys[order], np.fromiter(shift.values(), np.int64, len(shift))[order]

    def block_keys(self, hashes: np.ndarray) -> np.ndarray:
        """The key of the block that starts at each word."""
        return hashes if self.block == 1 else mix64(hashes[:-1] + hashes[1:] * _SECOND)

    def shifts(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        return np.where(self.keys[at] == keys, self.shift[at], self.furthest)

    def search(self, shifts: list[int], keys: np.ndarray, text: bytes, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of each occurrence in one document, whose blocks have these keys and shifts."""
        m, at, n = self.m, self.m - self.block, len(shifts)
        while at < n:
            step = shifts[at]
            if step:
                at += step
                continue
            first = at - m + self.block
            candidate = b" ".join([text[a:b] for a, b in zip(start[first : first + m], end[first : first + m], strict=True)])
            if candidate in self.bucket[int(keys[at])]:
                yield first, self.patterns[candidate]
            at += 1


def tables(items: list[tuple[int, str | None]], window: int = WINDOW) -> tuple[list[WuManber], list]:
    """Search tables by pattern length, and the distinct item ids to which their owners' numbers refer."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    numbers: dict = {}
    for item, text in items:
        words = _words(text)
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[k : k + m]), set()).add(numbers.setdefault(item, len(numbers)))
    return [WuManber(m, patterns) for m, patterns in sorted(by_length.items())], list(numbers)


SPANS, ITEMS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string())
HITS = "__spans array<struct<a:bigint,b:bigint>>, __items array<string>, __n_words bigint"


def table_files(benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> list[str]:
    """Writes the search tables of all parts of ``benchmark`` (item_id, text) and returns their files. Items go to parts by hash, so
    a part has half of ``part_words`` words on average; one item is never cut."""
    spark = benchmark.sparkSession
    folder = new_folder(spark, "benchmark")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([spans(data, offsets, ALNUM)[0].size], pa.int64())], ["n"])

    total = benchmark.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    n_parts = max(1, -(-2 * total // part_words)) if 2 * total > part_words else 1

    def build(group: pa.Table) -> pa.Table:
        made = tables(list(zip(group.column("item_id").to_pylist(), group.column("text").to_pylist(), strict=True)), window)
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.tables"
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            sink.write(pickle.dumps(made, protocol=5))
        return pa.table({"file": [name]})

    items = benchmark.select("item_id", "text").where("text IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)))
    files = stored(items.groupBy("part").applyInArrow(build, "file string"), "benchmark-files")
    return [f"{folder}/{row[0]}" for row in files.sort("file").collect()]


@functools.lru_cache(maxsize=1)
def _opened(file: str) -> tuple[list[WuManber], list]:
    store, path = filesystem(file)
    with store.open_input_stream(path) as source:
        return pickle.loads(source.read())  # a file of this job's own tasks


def _hits(texts: pa.Array, machines: list[WuManber], ids: list[str]) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """(words, spans of words in windows, items of those windows) of each text."""
    data, offsets = text_bytes(texts)
    n_words, hits, items = [], [], []
    for i, j in blocks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, bounds = spans(part, at, ALNUM)
        hashes = word_hashes(part, start, end)
        low = LOWER[part].tobytes()
        n_words += np.diff(bounds).tolist()
        own_hits: list[list] = [[] for _ in range(j - i)]
        own_items: list[set] = [set() for _ in range(j - i)]
        for machine in machines:
            if hashes.size < machine.m:
                continue
            keys = machine.block_keys(hashes)
            shifts = machine.shifts(keys).tolist()
            for row in range(j - i):
                a, b = int(bounds[row]), int(bounds[row + 1])
                upto = b - machine.block + 1
                if b - a < machine.m:
                    continue
                for first, owners in machine.search(shifts[a:upto], keys[a:upto], low, start[a:b], end[a:b]):
                    spans_of = own_hits[row]
                    if spans_of and spans_of[-1]["b"] >= first >= spans_of[-1]["a"]:
                        spans_of[-1]["b"] = max(spans_of[-1]["b"], first + machine.m)
                    else:
                        spans_of.append({"a": first, "b": first + machine.m})
                    own_items[row].update(owners)
        hits += own_hits
        items += [[ids[k] for k in sorted(x)] for x in own_items]
    return n_words, hits, items


def _searched(rows: DataFrame, text_col: str, file: str | None, hit_only: bool = False) -> DataFrame:
    """``rows`` with spans, items and n_words behind, from the tables in ``file``; only rows that are hit, without their text, if
    ``hit_only``."""
    text_at = rows.columns.index(text_col)
    kept = [k for k in range(len(rows.columns)) if not (hit_only and k == text_at)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, ids = _opened(file) if file else ([], [])
        ids = ["" if x is None else str(x) for x in ids]
        for batch in batches:
            n_words, hits, items = _hits(batch.column(text_at), machines, ids)
            made = [pa.array(hits, SPANS), pa.array(items, ITEMS), pa.array(n_words, pa.int64())]
            out = pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made], [*(batch.schema.names[k] for k in kept), "__spans", "__items", "__n_words"])
            yield out.filter(pa.array([bool(x) for x in hits], pa.bool_())) if hit_only else out

    schema = rows.select(*[f"`{rows.columns[k]}`" for k in kept]).schema
    for field in StructType.fromDDL(HITS).fields:
        schema = schema.add(field)
    return rows.mapInArrow(search, schema)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words long, n_hit long and items array<string>: words, words inside any occurrence of a window of
    any item of ``benchmark`` (item_id, text), and the ids of those items, sorted as strings.

    A null or empty text has no words. An item without words has no window; one of fewer words than ``window`` is one
    window. Items of one id count once; a null item id is the empty string. An empty benchmark hits nothing. Rows of
    ``docs`` are kept one for one, with all their columns (but for former n_words, n_hit and items).
    """
    rows = docs.drop("n_words", "n_hit", "items")
    columns = rows.columns
    files = table_files(benchmark, window, part_words)
    # Equal texts have equal hits: of each part but the last, one row a text that is hit.
    digest = F.unhex(F.sha2(F.col(f"`{text_col}`"), 256))
    before = [stored(_searched(rows.select(digest.alias("__digest"), f"`{text_col}`"), text_col, file, hit_only=True).drop("__n_words").dropDuplicates(["__digest"]), "passages") for file in files[:-1]]
    if before:
        rows = rows.withColumn("__digest", digest)
    found = _searched(rows, text_col, files[-1] if files else None)
    if before:
        every = functools.reduce(DataFrame.union, before)
        held = every.groupBy("__digest").agg(F.flatten(F.collect_list("__spans")).alias("__more"), F.flatten(F.collect_list("__items")).alias("__theirs"))
        found = found.join(stored(held, "passages"), "__digest", "left")
        for own, more in (("__spans", "__more"), ("__items", "__theirs")):
            found = found.withColumn(own, F.when(F.col(more).isNull(), F.col(own)).otherwise(F.concat(own, more)))
    hit = F.aggregate(
        F.array_sort("__spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda s, x: F.struct((s.n + F.greatest(F.lit(0).cast("long"), x.b - F.greatest(x.a, s.upto))).alias("n"), F.greatest(s.upto, x.b).alias("upto")),
        lambda s: s.n,
    )
    return found.select(*[F.col(f"`{c}`") for c in columns], F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.array_sort(F.array_distinct("__items")).alias("items"))


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = find_passages(docs.select("doc_id", "text"), benchmark, window)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = f"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS win FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, m WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, k, dw.m FROM dw JOIN bw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT doc_id, k, m FROM hit)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
