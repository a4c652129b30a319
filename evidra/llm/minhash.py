"""Near duplicates: improved consistent weighted sampling (ICWS) over TF-IDF weighted five-word shingles.

Steps, all of them Spark jobs over whole texts:

1. document frequencies of shingles, counted over every row and written; the greatest one of each of ``FEATURES`` hash
   buckets is broadcast, which bounds what is sent, whatever the input: it weighs samples only, and so names candidates;
2. for each row, ``BANDS * ROWS`` ICWS samples of its shingles, weighted by term frequency times inverse document
   frequency; ``ROWS`` samples make one band key;
3. rows of equal text become one node; nodes that share a band key become candidates of a pivot in that bucket, never of
   each other all at once;
4. each candidate pair is verified by the exact weighted Jaccard similarity of the two whole texts, with weights from the
   exact document frequency of each shingle (joined to the candidates' shingles);
5. where members of a bucket are still in different components, those outside its largest component are compared by
   their exact weights with all its members, block by block inside tasks, so that no link is lost; a block sends on only
   the links that join what was apart. Components of all links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.components import components, dealt_join
from evidra.sources.shared import forget, stored

from .textnum import ALNUM, blocks, mix64, shingles, spans, text_bytes, word_hashes

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
FEATURES = 1 << 18
#: Members of an open bucket that meet in one block, and shingles that a task counts before it sends them on.
BLOCK_ROWS, HELD_TERMS = 512, 1_000_000
#: Text whose shingles are added up at once, a range of their hashes: some ten megabytes of numbers.
RANGE_BYTES = 4 << 20

_LEVELS = 1 << 16
_UNIFORM = (np.arange(_LEVELS) + 0.5) / _LEVELS


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by bisection."""
    low, high = np.zeros(_LEVELS), np.full(_LEVELS, 60.0)
    for _ in range(70):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < _UNIFORM
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


#: Single precision: the same term and weight give the same numbers everywhere, which is all that samples need.
_GAMMA, _BETA, _MINUS_LOG = (x.astype(np.float32) for x in (_gamma_quantiles(), _UNIFORM, -np.log(_UNIFORM)))


def _row_terms(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For row ranges [i, j): the distinct shingles of each row and how often each occurs."""
    data, offsets = text_bytes(column)
    for i, j in blocks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, bounds = spans(part, at, ALNUM)
        made, made_bounds = shingles(word_hashes(part, start, end), bounds, WIDTH)
        yield i, j, [np.unique(made[a:b], return_counts=True) for a, b in zip(made_bounds[:-1], made_bounds[1:], strict=True)]


def bucket_weights(counts: DataFrame, n_docs: int) -> np.ndarray:
    """float32[FEATURES]: log((1 + N) / (1 + df)) + 1 of the most frequent shingle in each hash bucket, for samples only. ``counts``
    (shingle, df) holds those above one."""
    bucket = F.col("shingle").bitwiseAND(F.lit(FEATURES - 1)).cast("int").alias("bucket")
    found = counts.where("shingle IS NOT NULL").groupBy(bucket).agg(F.max("df").alias("df")).collect()  # FEATURES rows at most
    df = np.ones(FEATURES)
    for row in found:
        df[row[0]] = row[1]
    return (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)


def icws(terms: np.ndarray, weights: np.ndarray, bounds: np.ndarray, n_samples: int) -> np.ndarray:
    """uint64[n_rows, n_samples]: for each row (a nonempty range of terms) the identity (term, t) of each sample.

    Per term and sample a 64-bit hash gives r ~ Gamma(2, 1), beta ~ U(0, 1) and c ~ Gamma(2, 1);
    t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r, and the least a is sampled. Equal samples have the
    probability of the generalised Jaccard similarity. The result holds hashes and integers only, never floats.
    """
    log_w = np.log(weights.astype(np.float32))
    lengths = np.diff(bounds)
    first = bounds[:-1]
    low = np.uint64(_LEVELS - 1)
    out = np.empty((first.size, n_samples), np.uint64)
    for k in range(n_samples):
        x = mix64(terms + np.uint64((0xA0761D6478BD642F * (k + 1)) & 0xFFFFFFFFFFFFFFFF))
        r = _GAMMA[(x & low).view(np.int64)]
        beta = _BETA[((x >> np.uint64(16)) & low).view(np.int64)]
        c = _MINUS_LOG[((x >> np.uint64(32)) & low).view(np.int64)]
        c += _MINUS_LOG[(x >> np.uint64(48)).view(np.int64)]
        t = log_w / r
        t += beta
        np.floor(t, out=t)
        np.log(c, out=c)
        beta -= t
        beta -= np.float32(1)
        beta *= r
        c += beta
        least = np.minimum.reduceat(c, first)
        hits = np.flatnonzero(c == np.repeat(least, lengths))
        won = hits[np.searchsorted(hits, first)]
        out[:, k] = x[won] ^ (t[won].astype(np.int64).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64[n_rows, bands]: a hash of each band's samples and number."""
    keys = np.empty((samples.shape[0], bands), np.uint64)
    for band in range(bands):
        key = np.full(samples.shape[0], band + 1, np.uint64)
        for k in range(rows):
            key = mix64(key + samples[:, band * rows + k])
        keys[:, band] = key
    return keys.view(np.int64)


def signatures(docs: DataFrame, idf: np.ndarray, text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, node, keys) of each row: node is the text's MD5 as binary, keys its band keys (none if it has no word)."""
    shared_idf = docs.sparkSession.sparkContext.broadcast(idf)  # FEATURES numbers

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared_idf.value
        for batch in batches:
            lists: list[pa.Array] = []
            for _, _, terms_of in _row_terms(batch.column(2)):
                sizes = np.array([t.size for t, _ in terms_of])
                filled = np.flatnonzero(sizes)
                offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)
                keys = np.zeros(0, np.int64)
                if filled.size:
                    terms = np.concatenate([terms_of[k][0] for k in filled])
                    tf = np.concatenate([terms_of[k][1] for k in filled])
                    w = tf * weight[(terms & np.uint64(FEATURES - 1)).astype(np.int64)]
                    keys = band_keys(icws(terms, w, np.concatenate(([0], np.cumsum(sizes[filled]))), bands * rows), bands, rows).ravel()
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)))
            made = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["id", "node", "keys"])

    return docs.select("id", "node", F.col(text_col)).mapInArrow(sign, "id long, node binary, keys array<long>")


def shingle_counts(docs: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """(shingle, df): in how many rows each shingle is, if in ``least`` or more, and under the null shingle the rows that have one.

    Tasks count before they send. What they send are not rows of one shingle, which an aggregate would hold once more on either
    side, but ranges of hashes packed into one value: as many ranges as make about RANGE_BYTES of text each, added up range by range.
    """
    ranges = max(1, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // RANGE_BYTES))
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = 0, 0
        held: list[np.ndarray] = []

        def sent() -> Iterator[pa.RecordBatch]:
            terms, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for k in range(0, terms.size, 2 * HELD_TERMS):  # one slice, unless a single text has more
                own_terms, own_n = terms[k : k + 2 * HELD_TERMS], n[k : k + 2 * HELD_TERMS].astype(np.int32)
                bounds = np.concatenate(([0], np.searchsorted(own_terms, edges), [own_terms.size]))
                own = np.flatnonzero(np.diff(bounds))
                offsets = np.append(bounds[own], own_terms.size)
                packed = [pa.Array.from_buffers(pa.binary(), own.size, [None, pa.py_buffer((offsets * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (own_terms, own_n)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *packed, pa.nulls(own.size, pa.int64())], ["part", "terms", "n", "rows"])

        for batch in batches:
            for _, _, terms_of in _row_terms(batch.column(0)):
                filled = [t for t, _ in terms_of if t.size]
                rows += len(filled)
                held += filled
                size += sum(t.size for t in filled)
                if size > HELD_TERMS:
                    yield from sent()
                    size = 0
        if held:
            yield from sent()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([rows], pa.int64())], ["part", "terms", "n", "rows"])

    def add(key: tuple[pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "df"]
        if key[0].as_py() < 0:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([sum(sum(b.column("rows").to_pylist()) for b in batches)], pa.int64())], names)
            return
        parts = [(np.frombuffer(t.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int32)) for b in batches for t, n in zip(b.column("terms"), b.column("n"), strict=True)]
        terms = np.concatenate([t for t, _ in parts])
        order = np.argsort(terms, kind="stable")
        terms, n = terms[order], np.concatenate([n for _, n in parts]).astype(np.int64)[order]
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        df = np.add.reduceat(n, first)
        kept = df >= least
        terms, df = terms[first[kept]].view(np.int64), df[kept]
        for k in range(0, terms.size, 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[k : k + 100_000]), pa.array(df[k : k + 100_000])], names)

    sent = docs.select(F.col(text_col)).mapInArrow(count, "part long, terms binary, n binary, rows long")
    return sent.groupBy("part").applyInArrow(add, "shingle long, df long")


def with_frequencies(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """``texts`` (number, node, text) with df, the exact document frequencies of its distinct shingles in their sorted order.
    ``counts`` holds those above one."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for i, j, terms_of in _row_terms(batch.column(1)):
                sizes = np.array([t.size for t, _ in terms_of])
                terms = np.concatenate([t for t, _ in terms_of])
                places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers[i:j], sizes)), pa.array(places), pa.array(terms.view(np.int64))], ["number", "place", "shingle"])

    own = texts.select("number", "text").mapInArrow(expand, "number long, place int, shingle long")
    # Shingles that one row alone has need no place in the lists.
    found = own.join(counts, "shingle").groupBy("number").agg(F.collect_list("place").alias("places"), F.collect_list("df").alias("dfs"))
    return texts.join(found, "number", "left").select("node", "text", "places", "dfs")


def _weights(terms_of: list[tuple[np.ndarray, np.ndarray]], places: pa.ListArray, dfs: pa.ListArray, n_docs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, weights) of each row: term frequency times log((1 + N) / (1 + df)) + 1, df one where it is not listed."""
    out = []
    for k, (terms, tf) in enumerate(terms_of):
        df = np.ones(terms.size)
        if places[k].is_valid:
            df[places[k].values.to_numpy(zero_copy_only=False)] = dfs[k].values.to_numpy(zero_copy_only=False)
        out.append((terms, tf * (np.log((1 + n_docs) / (1 + df)) + 1)))
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser over sum of the greater of two rows' weights."""
    (ta, wa), (tb, wb) = a, b
    _, ia, ib = np.intersect1d(ta, tb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[ia], wb[ib]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def verified(pairs: DataFrame, texts: DataFrame, n_docs: int, similarity: float = SIMILARITY) -> DataFrame:
    """Those (member, pivot) pairs of nodes whose whole texts are similar enough. The pivot's side is joined last: a
    pivot of very many members is one that the adaptive skew join splits."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, tuple] = (b"", ())
        for batch in batches:
            keep = []
            pivots, pivot_texts = batch.column(1), batch.column(3)
            for i, j, terms_of in _row_terms(batch.column(2)):
                weighed = _weights(terms_of, batch.column(4).slice(i, j - i), batch.column(5).slice(i, j - i), n_docs)
                for row, own in zip(range(i, j), weighed, strict=True):
                    pivot = pivots[row].as_py()
                    if pivot != last[0]:
                        last = (pivot, _weights(next(_row_terms(pivot_texts.slice(row, 1)))[2], batch.column(6).slice(row, 1), batch.column(7).slice(row, 1), n_docs)[0])
                    keep.append(likeness(own, last[1]) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    members = pairs.join(texts.select(F.col("node").alias("member"), F.col("text").alias("member_text"), F.col("places").alias("member_places"), F.col("dfs").alias("member_dfs")), "member")
    both = members.join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text"), F.col("places").alias("pivot_places"), F.col("dfs").alias("pivot_dfs")), "pivot")
    return both.select("member", "pivot", "member_text", "pivot_text", "member_places", "member_dfs", "pivot_places", "pivot_dfs").mapInArrow(compare, "member binary, pivot binary")


def open_links(rooted: DataFrame, texts: DataFrame, n_docs: int, similarity: float = SIMILARITY) -> DataFrame:
    """Links (member, pivot) that join the roots of open buckets: rows (node, bucket, root) of ``rooted`` whose bucket has
    several roots. Members outside the bucket's largest component meet all its members, BLOCK_ROWS by BLOCK_ROWS, and the
    exact weighted Jaccard similarity of every such pair of different roots decides."""
    parts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    totals = parts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).where("n > top.n").select(
        "bucket", F.col("top.root").alias("largest"), F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK_ROWS).alias("few_blocks")
    )
    rows = rooted.join(totals, "bucket").join(texts, "node")
    number = F.xxhash64("node", "bucket")
    fields = ["bucket", "i", "j", "few", "node", "root", "text", "places", "dfs"]
    few = rows.where(F.col("root") != F.col("largest")).withColumns({"i": F.pmod(number, "few_blocks"), "few": F.lit(True)}).withColumn("j", F.explode(F.expr("sequence(0L, blocks - 1)")))
    every = rows.withColumns({"j": F.pmod(number, "blocks"), "few": F.lit(False)}).withColumn("i", F.explode(F.expr("sequence(0L, few_blocks - 1)")))

    def meet(group: pa.Table) -> pa.Table:
        nodes, few_side, roots = (group.column(k).to_pylist() for k in ("node", "few", "root"))
        text = group.column("text").combine_chunks()
        terms_of = [x for c in (text.chunks if isinstance(text, pa.ChunkedArray) else [text]) for _, _, made in _row_terms(c) for x in made]
        own = np.flatnonzero(few_side)
        others = np.flatnonzero(np.logical_not(few_side))
        left, right = [], []
        if own.size and others.size:
            _, place = np.unique(np.concatenate([t for t, _ in terms_of]), return_inverse=True)
            places, dfs = (pa.concat_arrays(group.column(k).chunks) for k in ("places", "dfs"))
            w = np.concatenate([w for _, w in _weights(terms_of, places, dfs, n_docs)])
            ends = np.concatenate(([0], np.cumsum([t.size for t, _ in terms_of])))
            total = np.add.reduceat(w, ends[:-1])
            at = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in others])
            other_place, other_w = place[at], w[at]
            first = np.concatenate(([0], np.cumsum(ends[others + 1] - ends[others])))[:-1]
            dense = np.zeros(int(place.max()) + 1)
            part_of = {r: r for r in roots}

            def find(r: bytes) -> bytes:
                while part_of[r] != r:
                    part_of[r] = r = part_of[part_of[r]]
                return r

            for k in own:
                mine = slice(ends[k], ends[k + 1])
                dense[place[mine]] = w[mine]
                low = np.add.reduceat(np.minimum(other_w, dense[other_place]), first)
                dense[place[mine]] = 0
                for m in others[low >= similarity * (total[k] + total[others] - low)]:
                    a, b = find(roots[k]), find(roots[m])
                    if a != b:
                        part_of[a] = b
                        left.append(nodes[k])
                        right.append(nodes[m])
        return pa.table({"member": pa.array(left, pa.binary()), "pivot": pa.array(right, pa.binary())})

    return few.select(fields).union(every.select(fields)).groupBy("bucket", "i", "j").applyInArrow(meet, "member binary, pivot binary")


def of_least_id(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``rows`` (id, node, ...) whose id is the least of their text: both are keys of the join, so copies are spread."""
    own = nodes.select(F.col("node").alias("__node"), F.col("least_id").alias("__id"))
    return rows.join(own, (F.col("node") == F.col("__node")) & F.col("id").eqNullSafe(F.col("__id"))).drop("__node", "__id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, node, class_id, n_copies, representative) of every row of ``docs``.

    ``class_id`` is the least id among the rows of a class; classes are the components of links between texts whose
    weighted Jaccard similarity is at least ``similarity``. ``n_copies`` rows have this very text. The representative is the
    row of the least (id, node), so a class whose least id stands in rows of several texts has one still; rows that repeat
    both id and text are one document, and each says the same.
    Texts without a word are alike only if equal. A null text is like no other row and its class is its own id; null ids
    are never a class's least id unless it has no other. An empty table gives an empty result; other columns of ``docs``
    are not read, whatever their names.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    counts = stored(shingle_counts(given, least=2), "frequencies")
    n_docs = counts.where("shingle IS NULL").agg(F.sum("df")).first()[0] or 0
    rows = stored(signatures(given, bucket_weights(counts, n_docs)), "signatures")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n_copies"))
    nodes = stored(nodes, "nodes")
    # One row of each text; rows that repeat both id and text are alike, and the first of them serves.
    single = of_least_id(rows, nodes).dropDuplicates(["node"])
    members = single.select("node", F.explode("keys").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(members.join(sizes, "bucket"), "members")
    # Those that meet many others in many bands are the best pivots.
    weight = members.groupBy("node").agg((-F.sum("n")).alias("met"))
    todo = stored(members.join(weight, "node").select("node", "bucket", F.struct("met", "node").alias("rank")), "ranked")
    plain = of_least_id(given, nodes.join(weight.select("node"), "node", "left_semi")).dropDuplicates(["node"])
    plain = stored(plain.select(F.monotonically_increasing_id().alias("number"), "node", "text"), "texts")
    texts = stored(with_frequencies(plain, counts.where("shingle IS NOT NULL")), "texts")
    forget(members, plain, counts)

    pivots = todo.groupBy("bucket").agg(F.min("rank").alias("top"))
    pairs = todo.join(pivots, "bucket").where(F.col("rank") != F.col("top")).select(F.col("node").alias("member"), F.col("top.node").alias("pivot")).distinct()
    links = stored(verified(pairs, texts, n_docs, similarity), "links")
    first_roots = components(links, "member", "pivot")
    rooted = stored(todo.select("node", "bucket").join(first_roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    # In a bucket of two, the pivot was all that there was to compare.
    several = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n")).where("r0 <> r1 AND n > 2").select("bucket")
    more = stored(open_links(rooted.join(several, "bucket", "left_semi"), texts, n_docs, similarity), "links")
    roots = components(links.union(more), "member", "pivot")
    forget(texts, todo, links, more, rooted, first_roots)

    classes = nodes.select("node", "least_id", "n_copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min(F.struct(F.isnull("least_id").alias("no_id"), "least_id", "node")).alias("head"))
    classes = classes.join(least, "root").select("node", F.col("head.least_id").alias("class_id"), "n_copies", (F.col("node") == F.col("head.node")).alias("heads"))
    own = F.col("heads") & F.col("id").eqNullSafe(F.col("class_id"))
    out = dealt_join(rows.where("node IS NOT NULL").select("id", "node"), classes, "node", "id").select("id", "node", "class_id", "n_copies", own.alias("representative"))
    return out.union(rows.where("node IS NULL").select("id", "node", "id", F.lit(1).cast("long"), F.lit(True)))
