"""Joins and per-key choices that hold when one key has a third of all rows."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 32
#: Rows of one key that are too many for one task.
HOT = 100_000
#: Bits that tell which keys a table cannot hold; broadcast in words of 64, so of at most 262 144 rows, however long the table is.
PLACES = 1 << 24


def lookup(df: DataFrame, table: DataFrame, on: list[str], spread: list[str], how: str = "left") -> DataFrame:
    """Join rows to a table that is unique on ``on``, spreading every key over SALTS tasks.

    The table is far smaller than the rows (it is an aggregate or a dimension), so copying it
    SALTS times is cheap; ``spread`` names columns that differ between rows of one key. Spark's size check does not see the
    copies, so a table that is not bounded needs a hint against its broadcast.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, on + ["_salt"], how).drop("_salt")


def lookup_counts(df: DataFrame, counts: DataFrame, on: list[str], spread: list[str], n: str, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Join rows to a table that says in ``n`` how many of them each key has. Only keys of more than HOT rows, of which there is one
    in HOT rows at most, are spread over SALTS tasks and copied to these; the table may be almost as long as the rows."""
    often = counts.where(F.col(n) > HOT).select(*on, F.lit(True).alias("_often"))
    salt = F.when(F.col("_often"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0).cast("int")
    salted = df.join(F.broadcast(often), on, "left").withColumn("_salt", salt).drop("_often")
    places = F.when(F.col(n) > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = counts.withColumn("_salt", F.explode(places))
    return salted.join(copies.hint(hint) if hint else copies, on + ["_salt"], how).drop("_salt")


def lookup_rare(df: DataFrame, counts: DataFrame, on: str, spread: list[str], n: str) -> DataFrame:
    """Left join, as in ``lookup_counts``, to a stored table of any length that most rows have no match in.

    The table marks the places of its keys in a bitmap of PLACES bits. Rows at unmarked places have no match for certain and stay
    where they are; the others move to meet the table, which is never broadcast itself. A table that marks most places moves most rows.
    """
    place = F.pmod(F.xxhash64(on), F.lit(PLACES))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    marks = counts.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_marks"))
    rows = df.withColumn("_word", word).join(F.broadcast(marks), "_word", "left")
    near = F.coalesce(F.getbit("_marks", bit) == 1, F.lit(False))
    met = lookup_counts(rows.where(near).select(*df.columns), counts, [on], spread, n, "left", "merge")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in counts.schema if f.name != on]
    return rows.where(~near).select(*df.columns, *none).unionByName(met)


def last_per_key(df: DataFrame, key: list[str], order: list, extra: list[Column] = (),
                 keep_null_keys: bool = True) -> DataFrame:
    """The last row of every key, without a window: each task keeps one candidate per key before
    the shuffle, so a key with a third of all rows is as cheap as any other.

    Rows whose key is null are all kept. ``extra`` adds aggregates over the copies of a key.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    null_key = reduce(or_, [F.col(k).isNull() for k in key])
    apart = [F.when(null_key, F.struct(*order)).alias("_apart")] if keep_null_keys else []
    kept = df.groupBy(*key, *apart).agg(
        F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"), *extra)
    names = [c for c in kept.columns if c not in (*key, "_apart", "_row")]
    return kept.select("_row.*", *names)
