"""Union of the sources in their fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.schema import conform


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All postings in one frame.  ``seq`` carries the source rank, so the order of
    boards, agency and sites holds whatever the partitions are."""
    return reduce(lambda a, b: a.unionByName(b), [conform(p) for p in parts])


def source_counts(postings: DataFrame) -> DataFrame:
    """Rows per kind of source."""
    return postings.groupBy(F.substring_index("source", ":", 1).alias("source")).agg(
        F.count(F.lit(1)).alias("n")
    )
