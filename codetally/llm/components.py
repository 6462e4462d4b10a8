"""Connected components by alternating stars: every round is two joins, and no task gathers a whole component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetally.llm.shared import cut


def _towards_least(pairs: DataFrame, symmetric: bool) -> DataFrame:
    """Link neighbours to the least node each node ``u`` knows.

    ``symmetric``: for every node, its larger neighbours; otherwise its smaller ones, and itself.
    """
    if symmetric:
        pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    known = pairs.join(least, "u")
    if symmetric:
        moved = known.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = known.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return moved.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Each linked node once, with the least node it can reach: ``node, root``.

    ``links`` has two columns of one orderable type; direction, repetition and self-links don't matter.
    """
    a, b = links.columns
    links = links.filter(F.col(a) != F.col(b))
    pairs = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def state(stars: DataFrame) -> tuple:
        return tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(pairs)
    while before[0]:
        pairs = cut(_towards_least(_towards_least(pairs, True), False))
        now = state(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
