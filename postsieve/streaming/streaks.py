"""Failure streaks per source over a fetch log, in batch and in micro-batches.

The log is cut into ranges of (source, order), so a source that holds a large
part of it, or all of it in one hour, is spread over as many tasks as its rows
are worth.  What a source has in one range is a chunk.  Chunks are scanned on
their own, once, in one pass over the sorted rows of a range, and the scanned
rows are written; the summaries of chunks, the rows' streaks and the end states
all come from that table.  A summary says how a chunk begins, ends and what its
longest streaks are, so summaries combine in order: only one row per chunk is
ordered per source.

A source may be null, like any other; a missing ``ok`` is a failure.  A caller
who has the log in chunks already may name them by a column that does not
decrease along the order; a chunk of one source is then one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postsieve.plans.durable import SnapshotTable, written

STATE = "streak bigint, tripped boolean"
_SCANNED = ("_chunk", "_n", "_last_ok", "_run", "_lead", "_inner")


class _Scan:
    """Walks through the sorted rows of one range, batch by batch; between batches it keeps its last source, and the
    place, last success and longest streaks there."""

    def __init__(self, key: str, chunk: int):
        self.key, self.chunk = key, chunk
        self.source, self.n, self.last_ok, self.lead, self.inner = None, 0, 0, 0, 0

    def _starts(self, sources: pa.Array) -> np.ndarray:
        """Where a source begins; nulls are one source."""
        if self.source is not None:
            sources = pa.concat_arrays([self.source, sources])
        codes = sources.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[True], codes[1:] != codes[:-1]])
        return starts if self.source is None else starts[1:]

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        sources = batch.column(self.key)
        ok = batch.column("_ok").to_numpy(zero_copy_only=False)
        at, starts = np.arange(len(ok)), self._starts(sources)
        group = np.cumsum(starts)  # 0 where the source of the batch before goes on
        first = np.maximum.accumulate(np.where(starts, at, 0))
        n = at - first + 1 + np.where(group == 0, self.n, 0)
        success = np.maximum.accumulate(np.where(ok, at, -1))
        last_ok = np.where(success >= first, n[success], np.where(group == 0, self.last_ok, 0))
        run = n - last_ok

        def longest(values: np.ndarray, before: int) -> np.ndarray:
            """Running maximum inside each source: every group is lifted above all values of those before it."""
            if not starts[0]:
                values[0] = max(values[0], before)
            lift = group * (values.max() + 1)
            return np.maximum.accumulate(values + lift) - lift

        lead = longest(np.where(last_ok == 0, run, 0), self.lead)
        inner = longest(np.where(last_ok == 0, 0, run), self.inner)
        self.source = sources.slice(len(ok) - 1)
        self.n, self.last_ok, self.lead, self.inner = (int(c[-1]) for c in (n, last_ok, lead, inner))
        found = (np.full(len(ok), self.chunk), n, pa.array(last_ok, mask=last_ok == 0), run, lead, inner)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, *[pa.array(c, pa.int64()) for c in found]], [*batch.schema.names, *_SCANNED])


def _scanned_ranges(log: DataFrame, key: str, ok: Column, order: Sequence[str]) -> DataFrame:
    rows = log.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    rows = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Scan(key, TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                yield walk.add(batch)

    layout = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in _SCANNED]])
    return written(rows.mapInArrow(scan, layout))


def _scanned(log: DataFrame, key: str, ok: Column, order: Sequence[str], chunk: Column | None) -> DataFrame:
    """Position, streak and longest streaks so far of every row inside its own chunk, as a written table."""
    if chunk is None:
        return _scanned_ranges(log, key, ok, order)
    scan = Window.partitionBy(key, "_chunk").orderBy(*order)
    rows = log.withColumns({"_chunk": chunk, "_ok": F.coalesce(ok, F.lit(False))})
    rows = rows.withColumn("_n", F.row_number().over(scan))
    so_far = scan.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_last_ok", F.max(F.when(F.col("_ok"), F.col("_n"))).over(so_far))
    rows = rows.withColumn("_run", F.col("_n") - F.coalesce("_last_ok", F.lit(0)))
    before_ok = F.col("_last_ok").isNull()
    longest = lambda test: F.coalesce(F.max(F.when(test, F.col("_run"))).over(so_far), F.lit(0))
    return written(rows.withColumns({"_lead": longest(before_ok), "_inner": longest(~before_ok)}))


def _chunk_carry(rows: DataFrame, key: str, threshold: int, state: DataFrame | None) -> DataFrame:
    """Per chunk: the streak and trip flag it starts with and ends with."""
    chunks = rows.groupBy(key, "_chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_lead").alias("lead"),
        F.max_by("_run", "_n").alias("tail"),
        F.every(F.col("_last_ok").isNull()).alias("all_failed"),
        F.max("_inner").alias("inner"),
    )
    if state is not None:
        # The state before the log is one more chunk, which sorts first.
        chunks = chunks.unionByName(state.select(
            key, F.lit(None).cast(chunks.schema["_chunk"].dataType).alias("_chunk"),
            F.col("streak").alias("n"), F.lit(0).alias("lead"), F.col("streak").alias("tail"),
            F.lit(False).alias("all_failed"),
            F.when(F.col("tripped"), F.lit(threshold)).otherwise(0).alias("inner"),
        ))
    by_key = Window.partitionBy(key).orderBy(F.asc_nulls_first("_chunk"))
    upto = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunks = chunks.withColumn("_island", F.count_if(~F.col("all_failed")).over(upto))
    island = Window.partitionBy(key, "_island").orderBy(F.asc_nulls_first("_chunk")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    grown = F.when(F.col("all_failed"), F.col("n")).otherwise(F.col("tail").cast("bigint"))
    chunks = chunks.withColumn("carry_out", F.sum(grown).over(island))
    chunks = chunks.withColumn("carry_in", F.coalesce(F.lag("carry_out").over(by_key), F.lit(0)))
    trips = (F.col("carry_in") + F.col("lead") >= threshold) | (F.col("inner") >= threshold)
    chunks = chunks.withColumn("_trips", trips)
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumns({
        "tripped_in": F.coalesce(F.max("_trips").over(earlier), F.lit(False)),
        "tripped_out": F.max("_trips").over(upto),
    })


def _with_streaks(rows: DataFrame, chunks: DataFrame, key: str, threshold: int, columns: Sequence[str]) -> DataFrame:
    """Scanned rows with what their chunk starts with: a join with one row per chunk, and no window."""
    starts = chunks.select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"), "carry_in", "tripped_in")
    rows = rows.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_of")))
    from_before = F.when(F.col("_last_ok").isNull(), F.col("carry_in")).otherwise(F.lit(0))
    over = (F.col("_inner") >= threshold) | (F.col("_lead") > 0) & (F.col("_lead") + F.col("carry_in") >= threshold)
    return rows.select(
        *columns, (F.col("_run") + from_before).cast("bigint").alias("streak"), (F.col("tripped_in") | over).alias("tripped"))


def _end(chunks: DataFrame, key: str) -> DataFrame:
    place = F.struct(F.col("_chunk").isNotNull(), F.col("_chunk"))
    return chunks.groupBy(key).agg(
        F.max_by("carry_out", place).alias("streak"), F.max("tripped_out").alias("tripped")
    )


def failure_streaks(
    log: DataFrame,
    key: str,
    ok: Column,
    order: Sequence[str],
    chunk: Column | None = None,
    threshold: int = 3,
    state: DataFrame | None = None,
) -> DataFrame:
    """Add ``streak`` (failures in a row up to the row) and ``tripped`` (sticky).

    Without ``chunk`` ranges of (key, order) are scanned; a given ``chunk`` must not decrease along ``order``.
    """
    threshold = max(1, threshold)
    rows = _scanned(log, key, ok, order, chunk)
    return _with_streaks(rows, _chunk_carry(rows, key, threshold, state), key, threshold, log.columns)


def end_state(
    log: DataFrame,
    key: str,
    ok: Column,
    order: Sequence[str],
    chunk: Column | None = None,
    threshold: int = 3,
    state: DataFrame | None = None,
) -> DataFrame:
    """Streak and trip flag of every source after its last row."""
    return _end(_chunk_carry(_scanned(log, key, ok, order, chunk), key, max(1, threshold), state), key)


def start_streaks(
    stream: DataFrame,
    key: str,
    ok: Column,
    order: Sequence[str],
    chunk: Column | None,
    state: SnapshotTable,
    out: str,
    checkpoint: str,
    threshold: int = 3,
) -> StreamingQuery:
    """Streaks of a growing log; rows of a micro-batch follow those of earlier ones.

    State and output are stored under the batch number, so a batch that is run
    again after a failure reads the state before it and replaces its output.
    """
    threshold = max(1, threshold)

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = _scanned(batch, key, ok, order, chunk)
        chunks = written(_chunk_carry(rows, key, threshold, state.read(before=batch_id)))
        streaks = _with_streaks(rows, chunks, key, threshold, batch.columns)
        streaks.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        state.write(_end(chunks, key), batch_id)

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
