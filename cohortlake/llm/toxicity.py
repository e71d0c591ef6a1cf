"""4. Toxicity by multiple-instance learning: a document is a bag of sentences, of which only the bag has a label.

A sentence's probability is logistic in its words, p = s(b + sum of the weights of its words' features); a document's is their noisy-or,
1 - product of (1 - p). Weights follow the gradient of the document labels' likelihood through the noisy-or, so that
weight goes to those words, and beginnings of words, whose sentences explain a label. Offending sentences are those of probability 0.5 or more.

The model is fitted on at most ``SAMPLE`` labelled documents, those first by a hash of their ids, with the features that
``LEAST_DOCUMENTS`` of them have and that are in toxic ones ``LEAST_EXCESS`` standard deviations more often than by
chance (rare words would otherwise explain labels by heart); everything else covers all rows. Labels are read for training rows alone: those whose
crc32(doc_id as text) mod 5 is not 0. Inputs of a score are words only.

Cases: a null or empty text counts as one sentence without words; labels that are null, or of documents that aren't there,
are not used, of contradicting ones the toxic one counts; without any labels nothing is toxic; rows are scored
independently, repeated ones alike; an empty table gives an empty one. Other columns stay, one with the name of a result
column is replaced.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortlake.llm.common import remainder, slices, tidy, whole_rows

SAMPLE = 15_000
LEAST_DOCUMENTS = 4
LEAST_EXCESS = 5.0
FOLDS = 5
ROUNDS = 150
RATE = 0.2
#: Characters of a word's beginnings that are features.
STEMS = (4, 5, 6, 7)
MEMORY = 100_000
DECAY = 1e-4
#: Sentences end at these characters; all else that is neither a letter, a digit nor beyond ASCII separates words.
ENDS = b".!?\n"
_TABLE = bytes(10 if c in ENDS else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_END = re.compile(r"[.!?\n]")


def sentences(text: str | None) -> list[list[bytes]]:
    """The words of each sentence, those without words included, one at least."""
    return [s.split() for s in (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split(b"\n")]


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings: inflected and compounded words of one stem share these."""
    chars = word.decode("utf-8", "replace")
    return [b"=" + word, *(b"^" + chars[:n].encode() for n in STEMS if len(chars) > n)]


class Weights(dict):
    """The weight of a word: the sum of its features'. Words are remembered as they come, up to a bound on memory."""

    def __init__(self, of_feature: dict[bytes, float]):
        self.of_feature = of_feature

    def __missing__(self, word: bytes) -> float:
        if len(self) > MEMORY:
            self.clear()
        get = self.of_feature.get
        self[word] = total = sum(get(f, 0.0) for f in features(word))
        return total


@dataclass
class Model:
    weights: dict[bytes, float]  # by feature
    bias: float

    def __post_init__(self):
        self.of_word = Weights(self.weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def score(self, docs: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each document's probability, and its sentences'."""
        bags = [sentences(t) for t in docs]
        weights = np.array([self.of_word[w] for bag in bags for s in bag for w in s])
        sizes = np.array([len(s) for bag in bags for s in bag], np.int64)
        upto = np.concatenate([[0.0], np.cumsum(weights)])
        ends = np.cumsum(sizes)
        x = self.bias + upto[ends] - upto[ends - sizes]
        counts = np.array([len(b) for b in bags], np.int64)
        starts = np.cumsum(counts) - counts
        total = np.add.reduceat(np.logaddexp(0, x), starts) if counts.size else np.zeros(0)
        return -np.expm1(-total), np.split(1 / (1 + np.exp(-np.clip(x, -60, 60))), starts[1:])


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of the rows to learn from, at most ``sample`` of them."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder("doc_id", FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the ids are at most ``sample``, so they are broadcast and all texts stay where they are
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))


def fit(rows: DataFrame, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> Model:
    """The model for rows (doc_id, text, toxic), by gradient descent with adaptive steps over all of them at once. The
    driver gives the memory of it back."""
    try:
        return _fit(rows, rounds, rate, decay)
    finally:
        tidy()


def _fit(rows: DataFrame, rounds: int, rate: float, decay: float) -> Model:
    table = rows.orderBy("doc_id").toArrow()
    if not table.num_rows or not any(table.column("toxic").to_pylist()):
        return Model({}, -40.0)
    y = np.array(table.column("toxic").to_pylist(), bool)
    known: dict[bytes, int] = {}  # words
    of_word = array("Q")  # hashes of each word's features, 0 where it has fewer
    ids, sizes, counts = [], [], []
    for batch in table.to_batches(max_chunksize=256):
        for text in batch.column("text").to_pylist():
            bag = sentences(text)
            for w in {w for s in bag for w in s}.difference(known):
                known[w] = len(known)
                own = [xxhash.xxh3_64_intdigest(f) for f in features(w)]
                of_word.extend(own + [0] * (1 + len(STEMS) - len(own)))
            ids.append(np.array([known[w] for s in bag for w in s], np.int32))
            sizes.append(np.array([len(s) for s in bag], np.int32))
            counts.append(len(bag))
    del table, batch, text, bag
    tidy()
    coded = pa.array(np.append(np.uint64(0), np.frombuffer(of_word, np.uint64))).dictionary_encode()  # feature 0 is none
    names, of_word = np.asarray(coded.dictionary), np.asarray(coded.indices)[1:].reshape(-1, 1 + len(STEMS))
    del coded
    found, in_toxic = np.zeros(names.size), np.zeros(names.size)
    for own, toxic in zip(ids, y):
        f = np.unique(of_word[np.unique(own)])
        found[f] += 1
        in_toxic[f] += toxic
    found[0] = in_toxic[0] = 0
    beyond = (in_toxic - found * y.mean()) / np.sqrt(found * y.mean() * (1 - y.mean()) + 1e-12)
    often = np.flatnonzero((found >= LEAST_DOCUMENTS) & (beyond >= LEAST_EXCESS))
    new = np.full(names.size, -1, np.int32)
    new[often] = np.arange(often.size)
    of_word = new[of_word]
    told = (of_word >= 0).any(axis=1)
    # only words with a chosen feature go on, each with the number of its sentence
    sentence, chosen, before = [], [], 0
    for own, n in zip(ids, sizes):
        use = told[own]
        sentence.append(np.repeat(np.arange(before, before + n.size, dtype=np.int32), n)[use])
        chosen.append(own[use])
        before += n.size
    sizes = np.concatenate(sizes)
    sentence, ids = np.concatenate(sentence), of_word[np.concatenate(chosen)]
    sentence, ids = np.repeat(sentence, ids.shape[1]), ids.ravel()
    sentence, ids = sentence[ids >= 0], ids[ids >= 0]
    counts = np.array(counts)
    starts = np.cumsum(counts) - counts
    w, b = np.zeros(often.size), -6.0
    moments = [np.zeros(often.size + 1), np.zeros(often.size + 1)]
    for t in range(1, rounds + 1):
        x = b + np.bincount(sentence, w[ids], len(sizes))
        p = 1 / (1 + np.exp(-np.clip(x, -60, 60)))
        clean = np.exp(-np.add.reduceat(np.logaddexp(0, x), starts))  # probability that no sentence is toxic
        pull = np.where(y, -clean / np.maximum(1 - clean, 1e-12), 1.0)
        g = np.repeat(pull, counts) * p / y.size
        step = np.append(np.bincount(ids, g[sentence], often.size) + decay * w, g.sum())
        moments[0] += 0.1 * (step - moments[0])
        moments[1] += 0.01 * (step * step - moments[1])
        move = rate * (moments[0] / (1 - 0.9 ** t)) / (np.sqrt(moments[1] / (1 - 0.99 ** t)) + 1e-9)
        w -= move[:-1]
        b -= move[-1]
    kept = {int(names[often[k]]): float(w[k]) for k in np.flatnonzero(np.abs(w) > 1e-3)}
    weights = {}
    for word, use in zip(known, told):
        if use:
            weights |= {f: kept[h] for f in features(word) for h in [xxhash.xxh3_64_intdigest(f)] if h in kept}
    return Model(weights, float(b))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with score, predicted and offending: the sentences of probability ``threshold`` or more as their
    number in the text, the text itself and the probability; none for documents that are not toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<score:double,predicted:int,offending:array<struct<at:int,text:string,score:double>>>"
    item = pa.struct([("at", pa.int32()), ("text", pa.string()), ("score", pa.float64())])

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([column], ["text"])
        scores, offending = [], []
        for part in slices(whole, "text", 1 << 20):
            rows = part.column("text").to_pylist()
            total, own = sent.value.score(rows)
            scores.append(total)
            for t, s, p in zip(rows, total, own):
                cut = _END.split(t) if s >= threshold and t else []
                offending.append([{"at": k, "text": cut[k].strip(), "score": float(p[k])} for k in np.flatnonzero(p >= threshold)] if cut else [])
        scores = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(offending, pa.list_(item))], ["score", "predicted", "offending"])

    names = ("score", "predicted", "offending")
    scored = docs.select(whole_rows(docs), F.col(text).alias("t")).withColumn("s", run.asNondeterministic()("t"))
    return scored.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in names], *[F.col(f"s.{n}") for n in names])


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, offending per document, by a model of the other folds' labels."""
    scored = score(docs.select("doc_id", "text"), fit(training_rows(docs, labels)))
    return scored.select("doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted", "offending")
