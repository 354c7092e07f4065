"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.plans.durable import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node of the component.

    Alternates two rewrites until the links no longer change: each node's larger neighbours are tied to its smallest
    neighbour, then each node's smaller neighbours are. Every round ends in a written table, so lineage stays short.
    """
    ties = written(_distinct(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    before = None
    while (now := _signature(ties)) != before:
        before = now
        both = ties.union(ties.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        up = _distinct(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")))
        low = up.groupBy("u").agg(F.min("v").alias("low"))
        ties = written(_distinct(up.join(low, "u").select(
            F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))))
    return ties.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _distinct(ties: DataFrame) -> DataFrame:
    return ties.where("u <> v").distinct()


def _signature(ties: DataFrame) -> tuple:
    return tuple(ties.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
