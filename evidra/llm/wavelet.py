"""Token ids of a corpus in shards that are wavelet matrices: one compressed file for access, counts and occurrences.

A shard holds the ids of consecutive documents as bit planes, from the highest bit down; behind each plane the ids with a 0
come first, then those with a 1, each in the order they had. Rank and select on the planes give the id at a place, the number of
times an id occurs before a place, and the places of an id, without unpacking the rest. Planes are cut into blocks, each
compressed on its own if that makes it smaller; the directory has the ones before each block, so that a query reads one block
a plane and place. The documents' ids and starts are in the file too, for an end mark may be an ordinary id as well.

Documents are sorted by id over all tasks; each task encodes its documents and writes shards of bounded size under names that no
other attempt uses. Only what the index names counts, so a lost executor leaves at worst files that nothing refers to.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textnum import blocks, text_bytes
from .warc import filesystem

END_ID = 0
#: A shard is closed once it has so many ids.
SHARD_TOKENS = 1 << 24
#: Bits of a block, bytes of text that are encoded at once, and words that a worker remembers.
BLOCK_BITS, TEXT_BYTES, REMEMBERED = 1 << 15, 4 << 20, 500_000
MAGIC, LEVEL = b"EVWMTRX1", 1
_FOOTER = "<QQQIQIQI8s"
_BLOCK_BYTES = BLOCK_BITS // 8


# ---- encoding ----

#: A blank that the next character, white by either rule in use, or the text's end keeps from beginning a word.
_ODD = r" ([\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)"

#: Letters, and then marks, which the expression makes two units (an apostrophe may begin another).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
#: The byte-level alphabet: bytes that print stand for themselves, the others, in order, for the characters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARACTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Encoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library, as ``encode(text, add_special_tokens=False)`` gives them.

    A byte-level tokenizer with its usual expression always cuts before a blank that a non-blank follows, so each distinct word
    (with the blank before it) is encoded once for a block of texts, and the texts are put together from the words' ids. A word of
    Latin letters is one unit of the model and is remembered, marks behind it are another; other words are encoded in one string, which
    its ids that begin with a blank cut again. Other tokenizers, and texts with several blanks in a row, are encoded as a whole.
    """

    def __init__(self, definition: str) -> None:
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(definition)
        cut, made = (json.loads(definition).get(k) or {} for k in ("pre_tokenizer", "normalizer"))
        self.by_words = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not made
        size = self.tokenizer.get_vocab_size()
        self.memory: dict[str, bytes] = {}  # of words behind a blank
        self.marks: dict[str, bytes] = {}  # of marks behind letters
        self.begins = np.array([(self.tokenizer.id_to_token(k) or "").startswith("Ġ") for k in range(size)])

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _unit(self, text: str) -> bytes:
        """Ids of a text that the expression leaves whole: its UTF-8 bytes as the model's characters are one unit of the model."""
        mapped = text.replace(" ", "Ġ") if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of " " + word, as bytes, for words without a blank, none of them empty."""
        memory, plain = self.memory, _PLAIN.fullmatch
        if len(memory) + len(self.marks) > REMEMBERED:
            memory.clear()
            self.marks.clear()
        out = list(map(memory.get, words))
        others: list[int] = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            parts = plain(words[k])
            if parts is None:
                others.append(k)
                continue
            letters, marks = parts.groups()
            ids = memory.get(letters)
            if ids is None:
                ids = memory[letters] = self._unit(" " + letters)
            if marks:
                tail = self.marks.get(marks)
                if tail is None:
                    tail = self.marks[marks] = self._unit(marks)
                ids = memory[words[k]] = ids + tail
            out[k] = ids
        for k, ids in zip(others, self._joined([words[k] for k in others]), strict=True):
            out[k] = ids
        return out

    def _joined(self, words: list[str], chunk: int = 5_000) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), chunk):
            own = words[k : k + chunk]
            ids = np.frombuffer(self.whole([" " + " ".join(own)])[0], np.uint32)
            first = np.flatnonzero(self.begins[ids])
            if first.size == len(own) and first[0] == 0:
                out += [x.tobytes() for x in np.split(ids, first[1:])]
            else:
                out += self.whole([" " + w for w in own])
        return out

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts in a row, each with ``end`` behind it, and the offsets of the texts; null is empty."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        plain = np.zeros(n, bool)
        if self.by_words:
            plain = ~pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        flat, bounds = split.flatten(), np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        is_first = np.zeros(len(flat), bool)
        is_first[bounds[:-1]] = True
        coded = flat.dictionary_encode()
        code, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        begins, code[is_first] = np.unique(code[is_first], return_inverse=True)  # a text's first word has no blank before it
        odd = texts.filter(pa.array(~plain)).to_pylist()
        n_first, n_rest = begins.size, len(known)
        code[~is_first] += n_first
        # The empty word is only ever a first one.
        pool = self.whole([known[k] for k in begins]) + self.words([w or "." for w in known]) + self.whole(odd)
        pool.append(b"" if end is None else array("I", [end]).tobytes())
        sizes = np.array([len(x) for x in pool], np.int64) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pool), np.uint32)
        # Pieces of the pool by row: a plain text's words, another text as one piece, and the end behind either.
        pieces = np.ones(n, np.int64)
        pieces[plain] = np.diff(bounds)
        row_end = np.cumsum(pieces + 1)
        order = np.full(int(row_end[-1]) if n else 0, len(pool) - 1, np.int64)
        first_at = row_end - pieces - 1
        plain_at = np.repeat(first_at[plain] - bounds[:-1], np.diff(bounds)) + np.arange(len(flat))
        order[plain_at] = code
        order[first_at[~plain]] = n_first + n_rest + np.arange(len(odd))
        length = sizes[order]
        upto = np.cumsum(length)
        at = np.repeat(starts[order] - (upto - length), length) + np.arange(upto[-1] if n else 0)
        return ids[at], np.concatenate(([0], upto[row_end - 1])).astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoder(definition: str) -> Encoder:
    return Encoder(definition)


# ---- the file ----


def pack(ids: np.ndarray, doc_ids: Sequence[int | None], starts: np.ndarray, level: int = LEVEL) -> bytes:
    """A shard: ``ids`` in order, and its documents' ids and starts."""
    packer = zstandard.ZstdCompressor(level=level)
    n, bits = ids.size, max(1, int(ids.max()).bit_length() if ids.size else 1)
    out, at = [MAGIC], len(MAGIC)
    zeros, before, offsets = [], [], []
    values = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for shift in range(bits - 1, -1, -1):
        one = values & values.dtype.type(1 << shift) != 0
        packed = np.packbits(one)
        ones = np.concatenate(([0], np.cumsum(np.add.reduceat(np.bitwise_count(packed), np.arange(0, packed.size, _BLOCK_BYTES), dtype=np.int64) if n else [])))
        zeros.append(n - int(ones[-1]))
        before.append(ones.astype(np.int64))
        own = []
        for k in range(0, packed.size, _BLOCK_BYTES):
            raw = packed[k : k + _BLOCK_BYTES].tobytes()
            small = packer.compress(raw)
            own.append(at)
            out.append(small if len(small) < len(raw) else raw)
            at += len(out[-1])
        offsets.append(np.array([*own, at], np.int64))
        values = np.concatenate((values[np.flatnonzero(~one)], values[np.flatnonzero(one)]))  # places are faster than masks
    directory = packer.compress(np.concatenate([np.array(zeros, np.int64), *before, *offsets]).tobytes())
    null = np.array([d is None for d in doc_ids], np.uint8)
    documents = packer.compress(np.array([d or 0 for d in doc_ids], np.int64).tobytes() + np.diff(starts, append=n).astype(np.int64).tobytes() + null.tobytes())
    footer = struct.pack(_FOOTER, n, bits, len(doc_ids), len(directory), at, len(documents), at + len(directory), zlib.crc32(directory + documents), MAGIC)
    return b"".join([*out, directory, documents, footer])


class WaveletFile:
    """A shard opened for queries; ``source`` is a file that can be read at any place."""

    def __init__(self, source, remembered: int = 256) -> None:
        self.source = source
        source.seek(source.size() - struct.calcsize(_FOOTER) if hasattr(source, "size") else len(source.getvalue()) - struct.calcsize(_FOOTER))
        self.n, self.bits, n_docs, d_size, d_at, o_size, o_at, crc, magic = struct.unpack(_FOOTER, source.read(struct.calcsize(_FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        source.seek(d_at)
        raw = source.read(d_size + o_size)
        if zlib.crc32(raw) != crc or o_at != d_at + d_size:
            raise ValueError("the shard's directory is damaged")
        unpacker = zstandard.ZstdDecompressor()
        self.n_blocks = -(-self.n // BLOCK_BITS)
        numbers = np.frombuffer(unpacker.decompress(raw[:d_size]), np.int64)
        self.zeros = numbers[: self.bits]
        wide = self.n_blocks + 1
        self.ones, self.offsets = (numbers[self.bits :][k * self.bits * wide : (k + 1) * self.bits * wide].reshape(self.bits, wide) for k in (0, 1))
        documents = unpacker.decompress(raw[d_size:])
        held, sizes, null = np.frombuffer(documents, np.int64, n_docs), np.frombuffer(documents, np.int64, n_docs, 8 * n_docs), np.frombuffer(documents, np.uint8, n_docs, 16 * n_docs)
        self.doc_ids = [None if missing else int(d) for d, missing in zip(held, null, strict=True)]
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self._block = functools.lru_cache(maxsize=remembered)(self._read_block)

    def _bytes(self, plane: int, block: int, raw: bytes) -> bytes:
        size = min(_BLOCK_BYTES, -(-(self.n - block * BLOCK_BITS) // 8))
        return raw if len(raw) == size else zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)

    def _read_block(self, plane: int, block: int) -> np.ndarray:
        """The block's bits."""
        a, b = int(self.offsets[plane, block]), int(self.offsets[plane, block + 1])
        self.source.seek(a)
        return np.unpackbits(np.frombuffer(self._bytes(plane, block, self.source.read(b - a)), np.uint8))[: self.n - block * BLOCK_BITS]

    def _ones_before(self, plane: int, at: int) -> int:
        block, rest = divmod(at, BLOCK_BITS)
        return int(self.ones[plane, block]) + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def access(self, at: int) -> int:
        """The id at place ``at`` of the shard."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.bits):
            block, rest = divmod(at, BLOCK_BITS)
            bit, ones = int(self._block(plane, block)[rest]), self._ones_before(plane, at)
            at = int(self.zeros[plane]) + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _span(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` in [low, high) stand behind the last plane."""
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            if low == high:
                return 0, 0
            a, b = self._ones_before(plane, low), self._ones_before(plane, high)
            one = token >> (self.bits - 1 - plane) & 1
            low, high = (int(self.zeros[plane]) + a, int(self.zeros[plane]) + b) if one else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often ``token`` stands in [low, high)."""
        a, b = self._span(token, low, self.n if high is None else high)
        return b - a

    def select(self, plane: int, one: int, ranks: np.ndarray) -> np.ndarray:
        """Places in the plane of the ones (or zeros) of these ranks, which ascend."""
        edge = self.ones[plane] if one else np.minimum(np.arange(self.n_blocks + 1) * BLOCK_BITS, self.n) - self.ones[plane]
        block = np.searchsorted(edge, ranks, side="right") - 1
        out = np.empty(ranks.size, np.int64)
        for k in np.unique(block):
            own = block == k
            out[own] = np.flatnonzero(self._block(plane, int(k)) == one)[ranks[own] - edge[k]] + int(k) * BLOCK_BITS
        return out

    def locate(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """The places of ``token`` in [low, high), in order."""
        a, b = self._span(token, low, self.n if high is None else high)
        places = np.arange(a, b)
        for plane in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - plane) & 1
            places = self.select(plane, one, places - (int(self.zeros[plane]) if one else 0))
        return places

    def ids(self) -> np.ndarray:
        """All ids in order, read plane by plane from the lowest up."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            a, b = int(self.offsets[plane, 0]), int(self.offsets[plane, -1])
            self.source.seek(a)
            raw = self.source.read(b - a)
            packed = b"".join(self._bytes(plane, k, raw[self.offsets[plane, k] - a : self.offsets[plane, k + 1] - a]) for k in range(self.n_blocks))
            one = np.unpackbits(np.frombuffer(packed, np.uint8))[: self.n].view(bool)
            up, zeros = np.empty_like(values), int(self.zeros[plane])
            up[np.flatnonzero(~one)] = values[:zeros]
            up[np.flatnonzero(one)] = values[zeros:] | values.dtype.type(1 << (self.bits - 1 - plane))
            values = up
        return values.astype(np.uint32)


# ---- Spark ----

INDEX = "part int, number int, file string, n_docs long, n_tokens long, before long, bytes long"


def written(docs: DataFrame, tokenizer: str, folder: str, end: int | None = END_ID, shard_tokens: int = SHARD_TOKENS, at_once: int = TEXT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of ``docs`` as shards under ``folder``, documents in ascending order of id (null first; equal ids by a hash of
    their texts), and returns the index, read from ``folder``/index: (part, number, file, start, n_docs, n_tokens, bytes).

    ``tokenizer`` is the path of a tokenizer file, read where the job is planned. A task encodes ``at_once`` bytes of text (or one longer
    text) and closes a shard behind them once it has ``shard_tokens`` ids. A null text is empty and has the end id alone.
    Rows of one id are dealt over tasks like any others. An empty table makes an empty index. Other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as source:
        definition = spark.sparkContext.broadcast(source.read())  # some MB: a vocabulary
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "tie", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(f"{root}/shards", recursive=True)
        part, coded = TaskContext.get().partitionId(), encoder(definition.value)
        number = before = size = 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        sizes: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            lengths = np.concatenate(sizes)
            data = pack(np.concatenate(ids), doc_ids, np.cumsum(lengths) - lengths)
            name = f"shards/{uuid.uuid4().hex}.wm"
            with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
                sink.write(data)
            row = {"part": part, "number": number, "file": name, "n_docs": len(doc_ids), "n_tokens": size, "before": before, "bytes": len(data)}
            return pa.RecordBatch.from_pylist([row], schema=_INDEX)

        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for i, j in blocks(offsets, at_once):
                made, at = coded.encode(batch.column(1).slice(i, j - i), end)
                ids.append(made)
                sizes.append(np.diff(at))
                doc_ids += batch.column(0).slice(i, j - i).to_pylist()
                size += made.size
                if size >= shard_tokens:
                    yield shard()
                    number, before, size, ids, doc_ids, sizes = number + 1, before + size, 0, [], [], []
        if doc_ids:
            yield shard()

    dealt.mapInArrow(write, INDEX).write.parquet(f"{folder}/parts")
    found = spark.read.schema(INDEX).parquet(f"{folder}/parts")
    # Parts are tasks: a row each, so one window over them all stays small.
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    index = found.join(first, "part").select("part", "number", F.concat(F.lit(f"{folder}/"), "file").alias("file"), (F.col("first") + F.col("before")).alias("start"), "n_docs", "n_tokens", "bytes")
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


_INDEX = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("bytes", pa.int64())])


def _opened(file: str):
    store, path = filesystem(file)
    return store.open_input_file(path)


def _dealt(index: DataFrame, most: int = 20_000) -> DataFrame:
    """(file, start) of the shards, a few of them a task."""
    return index.select("file", "start").repartition(max(1, min(index.count(), most)))


def document_rows(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards: ``start`` counts the ids of all documents before it, and
    the crc32 is that of its ids as little-endian unsigned 32-bit integers. A task holds one shard at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(file) as source:
                    shard = WaveletFile(source)
                    ids, at = shard.ids().astype("<u4"), shard.starts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _dealt(index).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_counts(index: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """(token, n): how often each of ``tokens`` stands in all shards; the shards' counts come from their blocks' directories."""
    wanted = sorted(set(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with _opened(file) as source:
                    shard = WaveletFile(source)
                    yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([shard.count(t) for t in wanted], pa.int64())], ["token", "n"])

    return _dealt(index).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_places(index: DataFrame, tokens: Sequence[int], rows: int = 100_000) -> DataFrame:
    """(token, doc_id, position): every occurrence of ``tokens``, its document and its place among the ids of the corpus."""
    wanted = sorted(set(tokens))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(file) as source:
                    shard = WaveletFile(source)
                    doc_ids = pa.array(shard.doc_ids, pa.int64())
                    for token in wanted:
                        places = shard.locate(token)
                        for k in range(0, places.size, rows):
                            own = places[k : k + rows]
                            document = doc_ids.take(pa.array(np.searchsorted(shard.starts, own, side="right") - 1))
                            yield pa.RecordBatch.from_arrays([pa.array([token] * own.size, pa.int64()), document, pa.array(own + start)], ["token", "doc_id", "position"])

    return _dealt(index).mapInArrow(locate, "token long, doc_id long, position long")


def tokens_at(index: DataFrame, positions: DataFrame, stride: int = SHARD_TOKENS) -> DataFrame:
    """(position, token) of the rows (position) of ``positions`` that lie in the corpus: each meets its shard in a join on ranges
    of ``stride`` ids, and the shard gives it by rank alone."""
    last = F.floor((F.col("start") + F.col("n_tokens") - 1) / stride)
    spans = index.where("n_tokens > 0").withColumn("range", F.explode(F.sequence(F.floor(F.col("start") / stride), last))).select("range", "file", "start", "n_tokens")
    wanted = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").withColumn("range", F.floor(F.col("position") / stride))
    met = wanted.join(spans, "range").where("position >= start AND position < start + n_tokens").select("position", "file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                if row["file"] != name:
                    name, shard = row["file"], WaveletFile(_opened(row["file"]))
                out.append(shard.access(row["position"] - row["start"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["position", "token"])

    return met.sortWithinPartitions("file", "position").mapInArrow(read, "position long, token long")
