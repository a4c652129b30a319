"""Registered queries of this subpackage: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filteraudit, fingerprint, lm, minhash, mixing, quality, sharding, spelling, tokencount, urlgraph, warc, wavelet
from .shared import new_folder, table

#: Vocabulary of the token counts: a SentencePiece model file, installed on the machine that plans the job.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

#: Tokenizer of the token ids: a file of the ``tokenizers`` library, installed on the machine that plans the job.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class of near duplicates, the rows with its very text, and whether it is the class's representative."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_copies", "representative")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: the record that its archive holds for it, read back through the index."""
    _, records, _ = warc.archived(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many of its words lie in windows of which benchmark items."""
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: fingerprints of its text and of the edited one, and their likeness."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the shard that holds it after compaction, and the digest of its text as read from there."""
    held = sharding.sharded(table(spark, sf_dir, "documents"), new_folder(spark, "shards"))
    return held.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "shard", "shard_bytes", "shard_level", "manifest_version")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the words that the mix takes of it, and its source's size and target."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its quality score, and whether its label was held out."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its log-likelihood under the model and under counts alone."""
    return lm.judged(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: host, path, the rule that fits its url, and the verdict."""
    return urlgraph.judged_urls(table(spark, sf_dir, "pages"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its number of tokens and of characters that no piece covers."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.sentencepiece_vocabulary(VOCABULARY))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part, order of five filters and step: what the step removes, and what it would remove in other orders."""
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, read back from wavelet matrix shards: where its token ids start, how many they are, and their crc32."""
    index = wavelet.written(table(spark, sf_dir, "documents"), TOKENIZER, new_folder(spark, "tokens"))
    return wavelet.document_rows(index)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word that is frequent enough: its most frequent near word, the end of the chain of such words, and counts."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash, op2_warc, op3_decontamination, op4_fingerprints, op5_sharding, op6_mixing, op7_quality, op8_lm, op9_urls, op10_tokens, op11_filter_audit, op12_token_ids, op13_spelling_variants)
}

ORACLE_SQL: dict[str, str] = {"op2_warc": warc.SQL, "op3_decontamination": decontaminate.SQL, "op6_mixing": mixing.SQL, "op9_urls": urlgraph.SQL, "op11_filter_audit": filteraudit.SQL, "op13_spelling_variants": spelling.SQL}
