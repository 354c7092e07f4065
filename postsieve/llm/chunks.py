"""Dealing documents into chunks that Python tasks work on together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text of a chunk, apart from longer single documents.
CHUNK_BYTES = 8_000_000


@dataclass
class Chunks:
    """``rows`` (chunk, row): each document whole, as a struct, dealt by its chunk; steps that read ``rows`` within one
    plan share one shuffle."""

    rows: DataFrame
    text_bytes: int
    parts: int


def in_chunks(docs: DataFrame, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Chunks:
    """Deal documents by a hash of their content and input partition, so that neither equal texts nor rows without an
    id gather in one chunk."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(2 * least, -(-total // chunk_bytes))
    parts = max(least, -(-chunks // 2))
    fields = [f"`{c}`" for c in docs.columns]
    held = docs.select(F.expr(f"int(pmod(xxhash64({', '.join(fields)}, spark_partition_id()), {chunks}))").alias("chunk"),
                       F.expr(f"struct({', '.join(fields)})").alias("row"))
    return Chunks(held.repartition(parts, "chunk"), total, parts)
