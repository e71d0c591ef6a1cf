"""8. Quality rules per document and per host, in DataFrame functions only.

A document fails by itself if it has fewer than ``LEAST_WORDS`` words, or if more than half of its words lie in
three-word windows found twice or more. Failures are counted per host. As small hosts have wild rates, each host's rate
is shrunk to (failures + a) / (documents + a + b): a and b belong to the beta distribution whose mean and variance the
hosts' rates have (method of moments, every host counting as one; both 1 where the variance is 0 or too large for a
beta). A host whose shrunk rate is over ``MOST_FAILING`` fails, and all its documents with it.

Cases: a null or empty text has no words and fails; a null host has no verdict, its documents stand alone; repeated rows
count as often as they are there; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions.skew import lookup
from cohortlake.llm.common import WORD, written

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
MOST_FAILING = 0.5  # of a host's documents, shrunk
SYMBOLS = "[#*$%&|<>]"


def measures(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the base figures of every document. Equal three-word windows of a text come together by sorting,
    so the work on a text is n log n in its length."""
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "host", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"),
                       F.size(F.regexp_extract_all("t", F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
                       F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    shifted = lambda c, by: F.slice(c, by + 1, F.size(c))
    pairs = F.zip_with("words", shifted("words", 1), lambda a, b: F.concat(a, F.lit(" "), b))
    windows = F.filter(F.zip_with(pairs, shifted("words", 2), lambda ab, c: F.concat(ab, F.lit(" "), c)), lambda w: w.isNotNull())
    rows = rows.select("doc_id", "host", "n_symbols", F.size("words").cast("long").alias("n_words"),
                       F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))).alias("at"))
    rows = rows.withColumn("last", F.concat(F.array(F.lit(None).cast("struct<w:string,i:int>")), "at")).withColumn("next", shifted("at", 1))
    found = F.filter(F.arrays_zip("at", "last", "next"), lambda x: (x["at"]["w"] == x["last"]["w"]) | (x["at"]["w"] == x["next"]["w"]))
    rows = rows.withColumn("starts", F.sort_array(F.transform(found, lambda x: x["at"]["i"])))
    # a window adds the words up to the next repeated one, three at most
    added = F.zip_with("starts", shifted("starts", 1), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       F.aggregate(added, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_repeat_words"))


def base_rules(measured: DataFrame, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    return measured.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))


def host_verdicts(judged: DataFrame, most_failing: float = MOST_FAILING) -> DataFrame:
    """Per host: documents, failures, shrunk rate, verdict. Counts are summed in every task before they move."""
    hosts = judged.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("documents")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"))
    size = F.when((F.col("var") > 0) & (F.col("var") < F.col("mean") * (1 - F.col("mean"))), F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1)
    prior = prior.select(F.coalesce(size * F.col("mean"), F.lit(1.0)).alias("a"), F.coalesce(size * (1 - F.col("mean")), F.lit(1.0)).alias("b"))
    # the prior is one row
    shrunk = (F.col("failures") + F.col("a")) / (F.col("documents") + F.col("a") + F.col("b"))
    return hosts.join(F.broadcast(prior)).withColumn("host_rate", shrunk).drop("a", "b").withColumn("host_failed", F.col("host_rate") > most_failing)


def judge(docs: DataFrame, text: str = "text", host: str = "source", least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED,
          most_failing: float = MOST_FAILING) -> DataFrame:
    """doc_id, host, the figures, base_failed, host_failed and kept. The figures are written once, as verdicts and
    documents both read them. The verdicts are joined back with every host's rows spread over many tasks."""
    rows = written(base_rules(measures(docs, text, host), least_words, most_repeated), "rules")
    bad = host_verdicts(rows, most_failing).where("host_failed").select("host", "host_failed")
    rows = lookup(rows, bad, ["host"], ["doc_id"]).withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
