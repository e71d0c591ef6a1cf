"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlake.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); nodes of one component have one root.

    Each round hooks every node to its neighbour of least hash, follows the hooks to their ends by doubling, and
    contracts the links; hashing keeps hooks short. Every step is an aggregation or a join over links that differ,
    written to the shared folder; the driver sees only whether any are left."""
    spark = links.sparkSession
    rank = F.xxhash64("node")
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    total = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a"))
        hook = F.struct(F.xxhash64("to").alias("rank"), F.col("to"))
        hooks = both.groupBy("node").agg(F.min(hook).alias("best"))
        hooks = written(hooks.select("node", F.when(F.col("best.rank") < rank, F.col("best.to")).otherwise(F.col("node")).alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            longer = written(hooks.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "hooks")
            hooks = longer.select("node", "root")
            if longer.where("moved").isEmpty():
                break
        ends = lambda side: hooks.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        left = links.join(ends("a"), "a").join(ends("b"), "b").where("a_root != b_root")
        links = written(left.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
        if total is None:
            total = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            total = written(total.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
    return total if total is not None else spark.createDataFrame([], "node long, root long")
