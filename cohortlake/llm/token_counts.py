"""9. Token counts: the number of pieces that a unigram tokenizer would make, without making them.

Vocabulary: pieces with scores. The best segmentation has the highest sum of scores; an automaton finds all pieces
that end at each character, longest first, and one pass keeps the best score and its piece count per character. A later
candidate replaces an earlier one only if it is strictly better, and candidates for a place come in order of where they
start, which are the tokenizer's tie rules; a character without a piece of its own costs ``UNKNOWN`` less than the
lowest score, and counts as its UTF-8 bytes where the vocabulary has byte pieces, else as one piece with its unknown
neighbours.

Text is prepared as the tokenizer does it: a blank becomes ``MARK`` and one goes before the text. As no piece has a mark after
another character (checked when the vocabulary is read), nor a character that is in no piece, segmentations break
at these places; what lies between is counted once and remembered.

The vocabulary is a model file of the sentencepiece library; its pieces and scores are read as a unigram model.

Cases: a null or empty text has 0 tokens; rows are independent; an empty table gives an empty one. Other columns stay,
one with the name of the result is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from cohortlake.llm.common import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
MEMORY = 400_000


def pieces_of(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Normal pieces with their scores, and whether there are pieces for all bytes."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    own = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return own, sum(sp.is_byte(i) for i in range(n)) == 256


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], bytes_known: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.bytes_known = bytes_known
        self.alphabet = {c for p, _ in pieces for c in p}
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces)
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        """The prepared text in parts that are segmented by themselves."""
        text = MARK + text.replace(" ", MARK)
        if not self.cuts:
            return [text]
        # a run of marks goes with what follows it
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)

    def count(self, segment: str) -> int:
        n = len(segment)
        score, count, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(segment):
            found[end].append(piece)
        for i in range(n):
            best = None
            alone = False
            # longest first, so candidates come in order of their starts
            for size, s in sorted(found[i], reverse=True):
                j = i + 1 - size
                alone |= size == 1
                if best is None or score[j] + s > best:
                    best, count[i + 1], run[i + 1] = score[j] + s, count[j] + 1, False
            if not alone and (best is None or score[i] + self.unknown > best):
                best = score[i] + self.unknown
                if self.bytes_known:
                    count[i + 1] = count[i] + len(segment[i].encode("utf-8", "replace"))
                else:
                    count[i + 1] = count[i] + (not run[i])
                run[i + 1] = True
            score[i + 1] = best
        return count[n]

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        known, total, joins = self.known, 0, not self.bytes_known
        if joins:  # unknown characters of neighbouring parts are one piece
            return self.count(MARK + text.replace(" ", MARK))
        for s in self.segments(text):
            k = known.get(s)
            if k is None:
                if len(known) > MEMORY:
                    known.clear()
                k = known[s] = self.parts(s)
            total += k
        return total

    def parts(self, segment: str) -> int:
        """A segment's count, by its runs of known characters; single unknown ones count as their bytes."""
        total, run = 0, []
        for c in segment:
            if c in self.alphabet:
                run.append(c)
            else:
                total += (self.count("".join(run)) if run else 0) + len(c.encode("utf-8", "replace"))
                run = []
        return total + (self.count("".join(run)) if run else 0)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(*pieces_of(path))


def count_tokens(docs: DataFrame, model: str | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """The documents with the number of their tokens. ``model`` is the model file's path on every executor."""
    path = model or public_tokenizers.path(MODEL)

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        own = counter(path)
        parts = [np.array([own.of_text(t) for t in p.column("text").to_pylist()], np.int64) for p in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return docs.withColumn(out, run(text))
