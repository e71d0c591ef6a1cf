"""A corpus from documents: five stages, each of which works on what the one before it has kept.

A stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each result as Parquet to the shared folder and
reads it again as the next stage's documents. All stages but the last return the columns of documents, with whole rows:

1. toxicity: documents predicted toxic go. The model learns from the labels of the training folds.
2. ngram_join: of each component of near duplicates (five-word shingles, Jaccard 0.75), the document of the least id stays,
   and of repeated rows of that id one. Documents without words are no duplicates of each other.
3. substring_dedup: words of 20-word windows found earlier go from the texts; n_chars follows the text. A document
   of which no word is left goes, unless it had none before.
4. decontamination: documents with a passage close to a benchmark item go.
5. byte_bpe: the rest as token ids, with their number and the hash of the decoded bytes.

Rows without an id pass 2 and 4 (they can be named in no link), a null text is without words. An empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlake.llm import bpe, decontamination, ngram_join, substring, toxicity
from cohortlake.llm.common import frame_of, short_batches, whole_rows, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    rows = toxicity.training_rows(docs, frame_of(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(whole_rows(docs), "text"), toxicity.fit(rows))
    return scored.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    _, found = ngram_join.join(docs)
    # ids that aren't the least of their component
    worse = found.where("component_id != doc_id").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(worse, "doc_id", "left_anti").select(*columns)
    # repeated rows of an id, few or many: equal or not, the first in order of their text stays (ties: in order of their JSON)
    repeated = kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    first = F.min_by(F.struct(*columns), F.struct("text", F.to_json(F.struct(*columns))))
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*columns).union(one)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    cut = substring.dedup(docs.select("doc_id", "text", whole_rows(docs))).where("n_words = 0 or n_removed < n_words")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cut.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return decontamination.clean(docs, frame_of(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    coded = bpe.decode(bpe.encode(docs))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("byte_bpe", to_tokens),
]

#: Training and edit distances are not for SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frame_of(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
