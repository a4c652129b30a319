"""A quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

Features of a text are its words, its pairs of neighbouring words and its character n-grams (of UTF-8 bytes), hashed into
``BUCKETS`` rows; a pair is hashed by the difference of its words' hashes, so all repetitions of a word are one feature. Vectors of all
occurrences are averaged over the document and go through a softmax output. Training takes a bounded sample of labelled
documents, ``SAMPLE`` rows chosen by a hash of the id, in one task; scoring takes every whole text. As averaging and the
output layer are linear, each feature's share of the logit is worked out once, and a document's logit is the mean of its
features' shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import crc_mod
from .textnum import SPACED, blocks, mix64, spans, text_bytes, word_hashes

BUCKETS, DIM, NGRAMS = 1 << 17, 16, (1, 2, 3)
SAMPLE, EPOCHS, RATE, SEED = 6000, 6, 2.0, 7
LEAST_STEPS = 1000  # few labelled documents are gone through more often
FOLDS, HELD_OUT = 3, 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all rows, row after row, and the bounds of each row. Every row has one constant feature."""
    start, end, bounds = spans(data, offsets, SPACED)
    hashes = word_hashes(data, start, end)
    words = (hashes % np.uint64(BUCKETS)).astype(np.int32)
    pairs = (mix64(hashes[1:] - hashes[:-1]) % np.uint64(BUCKETS)).astype(np.int32)
    rows = offsets.size - 1
    per_row = [np.diff(bounds), np.maximum(0, np.diff(bounds) - 1), *(np.maximum(0, np.diff(offsets) - n + 1) for n in NGRAMS)]
    out_bounds = np.concatenate(([0], np.cumsum(1 + sum(per_row))))
    out = np.zeros(out_bounds[-1], np.int32)
    grams, code = [], np.zeros(data.size, np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        code = code[: max(0, data.size - n + 1)] * np.uint64(257) + (data[n - 1 :].astype(np.uint64) + np.uint64(1))
        if n in NGRAMS:
            grams.append((n, ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)).astype(np.int32)))
    for k in range(rows):
        at = out_bounds[k] + 1
        own = words[bounds[k] : bounds[k + 1]]
        out[at : at + own.size] = own
        at += own.size
        own = pairs[bounds[k] : max(bounds[k], bounds[k + 1] - 1)]
        out[at : at + own.size] = own
        at += own.size
        for n, gram in grams:
            own = gram[offsets[k] : max(offsets[k], offsets[k + 1] - n + 1)]
            out[at : at + own.size] = own
            at += own.size
    return out, out_bounds


@dataclass
class Model:
    """share[b]: what an occurrence of feature b adds to the sum whose mean, with ``bias``, is the logit of label 1."""

    share: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        out = []
        for i, j in blocks(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            found, bounds = features(part, at)
            sums = np.add.reduceat(self.share[found], bounds[:-1], dtype=np.float64)
            out.append(self.bias + sums / np.diff(bounds))
        logit = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Vectors and a two-way softmax by SGD over shuffled documents, the rate falling to zero: ``epochs`` times, or as often as
    makes LEAST_STEPS. Without documents of both labels the score is their share everywhere (one half without any)."""
    n = len(texts)
    epochs = max(epochs, -(-LEAST_STEPS // max(1, n)))
    positive = float((labels.sum() + 1) / (n + 2))
    if not 0 < labels.sum() < n:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(positive / (1 - positive))))
    order = np.random.default_rng(seed)
    vectors = order.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output = np.zeros((2, DIM), np.float32)
    bias = np.array([np.log(1 - positive), np.log(positive)], np.float32)
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    bags = []
    for i, j in blocks(offsets):
        found, bounds = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            ids, counts = np.unique(found[a:b], return_counts=True)
            bags.append((ids, (counts / (b - a)).astype(np.float32)))
    steps, step = epochs * n, 0
    for _ in range(epochs):
        for k in order.permutation(n):
            ids, share = bags[k]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            own = vectors[ids]
            hidden = share @ own
            logits = output @ hidden + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[labels[k]] -= 1
            back = error @ output
            output -= now * np.outer(error, hidden)
            bias -= now * np.float32(0.1) * error
            # The mean spreads a document's gradient thinly; fastening it to the norm of the bag keeps steps alike for all lengths.
            vectors[ids] = own - np.outer(share * (now / max(np.float32(1e-6), share @ share) * np.float32(0.05)), back)
    lean = output[1] - output[0]
    return Model((vectors @ lean).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model from at most ``sample`` labelled documents whose fold is not held out, the first by a hash of the id.

    ``labels`` has doc_id and quality; rows with a null in either, or other values than 0 and 1, teach nothing, and of
    labels that differ for one id the lesser counts. Training runs in one task over that bounded sample.
    """
    own = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` labels
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        model = train(group.column("text").to_pylist(), group.column("quality").to_numpy().astype(np.int64))
        return pa.table({"share": [model.share.tobytes()], "bias": [model.bias]})

    made = rows.groupBy(F.lit(1).alias("all")).applyInArrow(learn, "share binary, bias double").collect()
    return Model(np.frombuffer(made[0][0], np.float32), made[0][1]) if made else Model(np.zeros(BUCKETS, np.float32), 0.0)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` double (which replaces a column of that name): the chance of label 1. A null text
    counts as empty, and an empty one has the constant feature only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.drop("quality_score")
    at = given.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(at)), pa.float64())], [*batch.schema.names, "quality_score"])

    return given.mapInArrow(score, StructType([*given.schema.fields, StructField("quality_score", DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``. Only the text is an input of the score. Without labels
    every score is one half; an empty table gives no rows."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
