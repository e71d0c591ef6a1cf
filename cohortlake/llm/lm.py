"""10. Scoring by a gated recurrent language model that is trained on the corpus.

Tokens of a text are its words, A-Z in lower case, then one end. Words are counted over all training documents. The
``VOCABULARY`` most frequent ones are the model's own tokens; all others share one, and given that one, a word has its
smoothed share of the others' counts, so that every text has a probability:

    log p(word | before) = log p(class | state) + log p(token | class, state) [+ log((c + 1) / (others + distinct others + 1))]

Training: in each of ``ROUNDS`` rounds every task goes once over those of its training documents whose turn it is, from
the same parameters, by truncated backpropagation; parameters are averaged by tokens, in a tree. Small partitions go
to one task together, so that the parameters sent follow the tokens and not the number of files. All rounds together
cover every training document once. Scoring carries the state over a document from its first to its last token.

Counts of the ``FREQUENT`` most frequent words (a fixed bound) go to every task. A task sends on the other words of
each document, which are joined with the counts of all words, so the vocabulary may be of any size.

Cases: a null or empty text is an end alone; a null id counts as empty text for the fold; rows are scored one by one,
repeated ones alike, and each counts in training; without training documents every token has probability 1 in the base
and the model is untrained; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cohortlake.llm.common import remainder, slices, texts, words_of, written
from cohortlake.llm.gru import END, OTHER, Gru
from cohortlake.llm.shingles import split_words

FOLDS, HELD_OUT = 7, 2
FREQUENT = 1 << 17
VOCABULARY = 8190
ROUNDS = 3
RATE = 0.1
#: Bytes of text that a task reads or trains on at once.
AT_ONCE = 4 << 20
#: Tokens that are scored together.
TOGETHER = 1 << 22
#: Parameters in a row, and rows that are averaged by one call.
PART, FAN_IN = 1 << 14, 64
#: Tokens of a round that a task trains on at least: each task sends all parameters, which are about as many numbers.
TOKENS_PER_TASK = 1 << 19


def folded(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"))


def chunks(batches, text: str = "text", size: int = AT_ONCE):
    """Batches put together to about ``size`` bytes of text; single texts may be longer."""
    held, total = [], 0
    for batch in batches:
        for part in slices(batch, text, size // 8):
            held.append(part)
            total += part.column(text).nbytes
            if total >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total = [], 0
    if held and sum(p.num_rows for p in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# -- counts ----------------------------------------------------------------------------------------------------------

def count_words(rows: DataFrame) -> DataFrame:
    """(word, c) over training documents; a null word has the number of documents. Tasks sum up before words move."""
    def run(batches):
        docs = 0
        for batch in chunks(batches):
            found = Counter()
            for t in texts(batch.column("text")):
                found.update(words_of(t, lower=True))
            docs += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([docs], pa.int64())], ["word", "c"])
    return rows.where("not held_out").select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    def __init__(self, words: list[bytes], counts: np.ndarray, docs: int, tokens: int, distinct: int):
        self.words, self.counts, self.docs, self.tokens, self.distinct = words, counts, docs, tokens, distinct
        self.size = 2 + min(len(words), VOCABULARY)
        own = counts[:VOCABULARY]
        # words that are not tokens of the model
        self.others = tokens - docs - int(own.sum()), distinct - (docs > 0) - own.size

    def __reduce__(self):
        return Vocabulary, (self.words, self.counts, self.docs, self.tokens, self.distinct)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        if not hasattr(self, "rank"):
            self.rank = {w: k for k, w in enumerate(self.words)}
        get = self.rank.get
        return np.array([get(w, -1) for w in words], np.int64)

    def ids(self, ranks: np.ndarray) -> np.ndarray:
        return np.where((ranks >= 0) & (ranks < VOCABULARY), ranks + 2, OTHER)


def vocabulary(counts: DataFrame) -> Vocabulary:
    top = counts.where("word is not null").orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    docs, tokens, distinct = counts.agg(F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.sum("c"), F.count("word")).first()
    docs, tokens = docs or 0, tokens or 0
    return Vocabulary(top.column("word").to_pylist(), top.column("c").to_numpy(), docs, tokens, distinct + (docs > 0))


# -- training --------------------------------------------------------------------------------------------------------

def averaged(parts: DataFrame) -> np.ndarray | None:
    """The mean, by weight, of parameters in rows (source, part, weight, data); FAN_IN rows meet in one call."""
    def mean(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["source"])
        weights = np.array([r["weight"] for r in rows])
        data = sum(w * np.frombuffer(r["data"], np.float32).astype(np.float64) for w, r in zip(weights, rows)) / weights.sum()
        return pa.table({"source": pa.array([rows[0]["source"] // FAN_IN], pa.int64()), "part": pa.array([rows[0]["part"]], pa.int32()), "weight": pa.array([weights.sum()]), "data": pa.array([data.astype(np.float32).tobytes()], pa.binary())})

    schema = "source long, part int, weight double, data binary"
    parts = written(parts, "parameters")
    while (parts.agg(F.max("source")).first()[0] or 0) > 0:
        parts = written(parts.groupBy("part", F.floor(F.col("source") / FAN_IN).alias("_group")).applyInArrow(lambda key, table: mean(table), schema), "parameters")
    rows = parts.orderBy("part").toArrow()
    return np.frombuffer(b"".join(rows.column("data").to_pylist()), np.float32) if rows.num_rows else None


def training_tasks(words: Vocabulary) -> int:
    """The most tasks of a round. An input in many small files would send many times as many parameters as it has tokens."""
    return words.tokens // (ROUNDS * TOKENS_PER_TASK) + 1


def train(rows: DataFrame, words: Vocabulary) -> Gru:
    """The model, from all training rows."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(words)
    model = Gru(words.size)
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(model)
        rate = RATE / (1 + k)

        def run(batches, start=start, rate=rate):
            own, squares, seen = None, {}, 0
            for batch in chunks(batches):
                if own is None:
                    own = start.value.of(start.value.flat())
                flat, n = split_words(texts(batch.column("text")))
                ids, ends = known.value.ids(known.value.ranks(flat)), np.cumsum(n)
                seen += own.train([np.append(ids[e - k:e], END) for k, e in zip(n, ends)], rate, squares)
            if own is not None:
                flat, source = own.flat(), TaskContext.get().partitionId()
                for p in range(0, flat.size, PART):
                    yield pa.RecordBatch.from_arrays([pa.array([source], pa.int64()), pa.array([p // PART], pa.int32()), pa.array([float(seen)]), pa.array([flat[p:p + PART].tobytes()], pa.binary())], ["source", "part", "weight", "data"])
        turn = rows.where("not held_out").where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k).select("text").coalesce(training_tasks(words))
        flat = averaged(turn.mapInArrow(run, "source long, part int, weight double, data binary"))
        model = model if flat is None else model.of(flat)
    return model


# -- scoring ---------------------------------------------------------------------------------------------------------

def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row; scores are log10."""
    spark = docs.sparkSession
    rows = folded(docs, text)
    counts = written(count_words(rows), "counts")
    words = vocabulary(counts)
    model = train(rows, words)
    sent = spark.sparkContext.broadcast((words, model))
    base_of = words.tokens + words.distinct + 1
    others_of = sum(words.others) + 1
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"]

    def run(batches):
        known, gru = sent.value
        base = np.log10((known.counts + 1) / base_of)
        other = np.log10((known.counts + 1) / others_of)
        other[:VOCABULARY] = 0
        end = np.log10((known.docs + 1) / base_of)
        held, docs, tokens = [], [], 0

        def flush():
            # many documents at once, so that long ones run side by side
            total, at = gru.score(docs) / np.log(10), 0
            for columns, score in held:
                yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(score + total[at:at + score.size]), columns[-1]], names)
                at += score.size

        for batch in chunks(batches):
            flat, n = split_words(texts(batch.column("text")))
            ranks, ends = known.ranks(flat), np.cumsum(n)
            ids = known.ids(ranks).astype(np.int32)
            docs += [np.append(ids[e - k:e], np.int32(END)) for k, e in zip(n, ends)]
            doc = np.repeat(np.arange(n.size), n)[ranks >= 0]
            ranks_in = ranks[ranks >= 0]
            sums = lambda v: np.bincount(doc, v[ranks_in], n.size)  # noqa: B023, E731
            others = np.flatnonzero(ranks < 0)
            rest = pa.ListArray.from_arrays(np.concatenate([[0], np.searchsorted(others, ends)]).astype(np.int32), pa.array([flat[k] for k in others.tolist()], pa.binary()))
            held.append(([batch.column("doc_id"), batch.column("held_out"), pa.array(n + 1), pa.array(np.bincount(doc, minlength=n.size) + (known.docs > 0)), pa.array(sums(base) + end), rest], sums(other)))
            tokens += int(n.sum())
            if tokens > TOGETHER:
                yield from flush()
                held, docs, tokens = [], [], 0
        if held:
            yield from flush()
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<binary>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # the words that are not among the frequent ones
    rare = scored.select("row", F.explode("rest").alias("word"))
    rare = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = lambda of: F.sum(F.log10((F.col("c") + 1) / F.lit(float(of))))
    rare = rare.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("k"), log(base_of).alias("b"), log(others_of).alias("s"))
    out = scored.drop("rest").join(rare, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
                      (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"))
