"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists all pieces that end at each character; dynamic programming keeps the best score and its
number of pieces, never the pieces themselves. Rules are those of the unigram tokenizer in the ``tokenizers`` library: a
piece replaces another path to the same end only if its score is greater, where starts are tried from the left, so of
equal scores the longest last piece wins; a character that no one-character piece covers is unknown, at ten below the
least score; unknown characters in a row are one unit, which counts as its bytes if the vocabulary has byte pieces.

Blanks become the mark U+2581 and one mark is put before a text. Where no piece holds a mark behind another character,
the best path of a text is that of its parts before each mark, so each part is counted once and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED, REMEMBERED_CHARS = 300_000, 64


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in order of id from a SentencePiece model file, without its control pieces and the unknown one, which no
    text holds; read where the job is planned."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]


class UnigramCounter:
    """Counts of pieces for one vocabulary."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]]) -> None:
        self.scores: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                self.scores[piece] = score
        self.unknown_score = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY  # of no piece, every character is unknown
        self.has_bytes = [f"<0x{b:02X}>" in self.scores for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.splits = not any(MARK in piece.lstrip(MARK) for piece in self.scores)
        # Marks in a row belong to one part: a piece may hold several of them.
        self.part = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if self.splits else re.compile(r"(?s).+")
        self.memory: dict[str, tuple[int, int]] = {}

    def units(self, text: str) -> tuple[int, int]:
        """(pieces, unknown characters) of the best path through ``text``."""
        n = len(text)
        best = [0.0] * (n + 1)
        known = [False] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.automaton.iter(text) if self.scores else ():
            matches[last + 1].append((length, score))
        count, unknown = [0] * (n + 1), [0] * (n + 1)
        # Of the unknown run at the end of the best path: its units, and the pieces before it.
        run, before_run = [0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            found = sorted(matches[end], reverse=True)
            single = bool(found) and found[-1][0] == 1
            at = -1
            for length, score in found:
                value = best[end - length] + score
                if at < 0 or value > best[end]:
                    best[end], at, known[end] = value, end - length, True
            if not single:
                value = best[end - 1] + self.unknown_score
                if at < 0 or value > best[end]:
                    best[end], at, known[end] = value, end - 1, False
            if known[end]:
                count[end], unknown[end] = count[at] + 1, unknown[at]
            else:
                first = at == 0 or known[at]
                own = self.unknown_bytes(text[at])
                before_run[end] = count[at] if first else before_run[at]
                # A character without byte pieces makes one unit of the whole run.
                run[end] = own if first else (0 if not own or not run[at] else run[at] + own)
                count[end] = before_run[end] + (run[end] or 1)
                unknown[end] = unknown[at] + 1
        return count[n], unknown[n]

    def unknown_bytes(self, character: str) -> int:
        """Pieces for the character's bytes, 0 if the vocabulary lacks one."""
        data = character.encode("utf-8", "surrogatepass")
        return len(data) if all(self.has_bytes[b] for b in data) else 0

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, unknown characters) of a whole text; none for an empty one."""
        if not text:
            return 0, 0
        tokens = unknown = 0
        memory = self.memory
        for part in self.part.findall(MARK + text.replace(" ", MARK)):
            found = memory.get(part)
            if found is None:
                found = self.units(part)
                if len(part) <= REMEMBERED_CHARS:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[part] = found
            tokens += found[0]
            unknown += found[1]
        return tokens, unknown


def token_counts(docs: DataFrame, vocabulary: Sequence[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_unknown) of each row: pieces of the whole text and characters that no piece covers.

    A null or empty text has none. The vocabulary, some ten thousand pieces, is broadcast; each task builds its automaton
    once. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(shared.value)
        for batch in batches:
            tokens, unknown = [], []
            for text in batch.column(1):
                n, u = counter.count(text.as_py() or "")
                tokens.append(n)
                unknown.append(u)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())], ["doc_id", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_tokens long, n_unknown long")
