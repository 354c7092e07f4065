"""Micro-batch upkeep of the history.

A day's folder keeps the postings of every batch that were first for their URL
when they came, and one narrow row for each URL: its place, dedup keys, verdict
and leader.  A batch judges its own texts only.  It then brings the leaders of
the blocks it touches up to date, from the first change in each block on, selects
among the day's narrow rows, and commits the day's snapshot.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postsieve.operators import dedup
from postsieve.operators.normalize import clean_fields, detect, first_by
from postsieve.plans.daily import Similarity, advance, selected, verdicts
from postsieve.plans.deltas import DeltaTable
from postsieve.plans.durable import SnapshotTable, written
from postsieve.policy import Policy
from postsieve.schema import conform

KEYS = ("url", "block", "words", "rich")


def add_batch(
    batch: DataFrame, policy: Policy, as_of, folder: str, number: int, similarity: Similarity | None = None
) -> DataFrame:
    """Take a batch into the day kept in ``folder`` and return the day's selection.

    Only what lower numbers left is read, and what the batch itself left before is replaced: a batch may be run again.
    A row whose URL came before with a smaller or equal ``seq`` changes nothing; one with a smaller ``seq`` takes the
    URL over, and the row that held it leaves its group.
    """
    spark = batch.sparkSession
    state, parts = SnapshotTable(spark, f"{folder}/state", keep=2), SnapshotTable(spark, f"{folder}/postings")
    before = state.read(before=number)

    rows = first_by(clean_fields(conform(batch)), ["url"], "seq")
    if before is not None:
        held = before.select("url", F.col("seq").alias("_held"))
        rows = rows.join(held, "url", "left").filter("_held is null or seq < _held").drop("_held")
    came = parts.write(detect(rows, policy), number)
    # Keys come before the verdict, which blanks the texts of rejected rows.
    fresh = written(verdicts(dedup.keyed(came), policy, as_of, similarity, KEYS).withColumn("leader_seq", F.lit(None).cast("bigint")))
    day, changed = fresh, fresh.select("block", "seq")
    if before is not None:
        urls = fresh.select("url")
        day = before.join(urls, "url", "left_anti").unionByName(fresh)
        changed = changed.unionByName(before.join(urls, "url", "left_semi").select("block", "seq"))
    now = state.write(dedup.relead(day, changed), number)

    kept = now.groupBy(F.col("leader_seq").alias("seq")).agg(
        F.min(F.struct("rich", "reject_reason", "fit_score")).alias("best"))
    judged = kept.select(F.col("best.rich.seq").alias("row"), "seq", "best.reject_reason", "best.fit_score")
    postings = spark.read.schema(came.schema).parquet(*[parts.path(n) for n in parts.versions() if n <= number])
    # A posting that lost its URL to a later batch is still there; its seq is not among the rows to select from.
    return selected(postings, judged, policy, as_of, similarity)


def start_incremental(
    stream: DataFrame,
    policy: Policy,
    store: SnapshotTable | DeltaTable,
    as_of: Callable[[int], object] | object,
    checkpoint: str,
) -> StreamingQuery:
    """Keep a day's snapshot up to date as its postings come in.

    Every batch commits the day's snapshot anew, from the snapshot of the day before.  First-wins order, near copies
    and the day's selection see the whole day (:func:`add_batch`): the history is the same however the rows fall into
    batches.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        day = date.fromisoformat(str(as_of(batch_id) if callable(as_of) else as_of))
        ranked = add_batch(batch, policy, str(day), f"{store.root}/days/run_date={day}", batch_id)
        advance(store, ranked, policy, str(day), day.toordinal())

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
