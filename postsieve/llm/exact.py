"""Exact duplicates by content hash, checked byte by byte (operator 4).

Only DataFrame functions run here. Each distinct text is shuffled once per map task, merged before the shuffle, so a
text that a third of all rows hold sends one row from each task; keys and digests are all that is joined afterwards.

Cases: a null text counts as empty; rows without an id take part and never stay unless the whole group has none;
rows that repeat an id and a text get equal answers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` says whether the smallest or the largest id of equal texts stays. Rows meet by the 128-bit hash of their
    text and are then told apart by the bytes themselves. The second digest names a row's group when keys are joined
    back; should two texts ever share both digests, the job fails rather than merge them.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    best = F.min if keep == "smallest" else F.max
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("hash", _hash("text"))
    equal = rows.groupBy("hash", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = (
        equal.select("hash", _digest("text").alias("digest"), "keep_id", "group_size")
        .groupBy("hash", "digest")
        .agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        .withColumn("keep_id", F.when(F.col("texts") == 1, F.col("keep_id")).otherwise(
            F.raise_error(F.lit("two texts share both digests")).cast("bigint")))
        .drop("texts")
    )
    keys = rows.select("doc_id", "hash", _digest("text").alias("digest"))
    return keys.join(groups, ["hash", "digest"]).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _hash(column: str) -> Column:
    return F.unhex(F.md5(column))


def _digest(column: str) -> Column:
    return F.unhex(F.sha2(column, 256))


ORACLE = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
