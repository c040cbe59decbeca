"""Connected components of a table of links, by smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episode_mart.llm.common import Scratch


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node of the links; ``root`` is the smallest node that can be reached.

    Alternates two steps until nothing changes: each node links its larger neighbours to the smallest node
    around it, then its smaller neighbours and itself. Links never outnumber those given, the number of
    rounds grows with the logarithm of the largest component, and every step is sums and equality joins.
    The result reads a table of ``scratch``.
    """
    keep = (scratch or Scratch()).keep
    current = keep(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    before = state(current)
    while before[0]:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = _least(large)  # in ``large`` every v is smaller than its u
        current = keep(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                       .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
