"""The history table: merge of a day's postings, status lifecycle, queries.

A history is a DataFrame with one row per URL (``schema.HISTORY``).  Operators
return the next state; :class:`postsieve.plans.durable.SnapshotTable` keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.schema import HANDLED, HISTORY, PAYLOAD, STATUSES, as_day, conform

ACTIONS = ("inserted", "updated", "reopened", "skipped_handled")


def empty_history(spark) -> DataFrame:
    return spark.createDataFrame([], HISTORY)


def upgrade(history: DataFrame) -> DataFrame:
    """Bring an older layout up to date; a missing ``last_seen`` is ``first_seen``."""
    if "last_seen" not in history.columns:
        history = history.withColumn("last_seen", F.col("first_seen"))
    return conform(history, HISTORY).withColumn("status", F.coalesce("status", F.lit("new")))


def _merged_columns(as_of) -> list[Column]:
    """Output of a history row ``h`` met by a new row ``n`` (either may be absent)."""
    today = as_day(as_of)
    known, seen = F.col("h.url").isNotNull(), F.col("n.url").isNotNull()
    handled = known & F.col("h.status").isin(*HANDLED)
    take = seen & ~handled
    action = (
        F.when(~seen, F.lit(None))
        .when(handled, "skipped_handled")
        .when(~known, "inserted")
        .when(F.col("h.status") == "expired", "reopened")
        .otherwise("updated")
    )
    return [
        F.coalesce("h.url", "n.url").alias("url"),
        *[F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"h.{c}")).alias(c) for c in PAYLOAD],
        F.when(known, F.col("h.first_seen")).otherwise(today).alias("first_seen"),
        F.when(take, today).otherwise(F.col("h.last_seen")).alias("last_seen"),
        F.when(take, "new").otherwise(F.col("h.status")).alias("status"),
        action.alias("action"),
    ]


def merge(history: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """Next history plus an ``action`` column (null where nothing came in).

    ``new`` holds one row per URL, as normalisation leaves it.  Both sides meet in one full outer join.
    """
    h, n = history.alias("h"), new.select("url", *PAYLOAD).alias("n")
    return h.join(n, F.col("h.url") == F.col("n.url"), "full_outer").select(*_merged_columns(as_of))


def action_counts(merged: DataFrame) -> DataFrame:
    """Rows per action, including actions that did not occur."""
    counts = merged.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])
    return counts.select(F.expr(
        f"stack({len(ACTIONS)}, " + ", ".join(f"'{a}', {a}" for a in ACTIONS) + ") as (action, n)"
    ))


def _unseen_since(days: int, as_of) -> Column:
    cutoff = F.date_sub(as_day(as_of), days)
    return F.coalesce(F.coalesce("last_seen", "first_seen") < cutoff, F.lit(False))


def goes_stale(days: int, as_of) -> Column:
    """True for open rows not seen for more than ``days`` days; never for 0 days."""
    return F.lit(days > 0) & (F.col("status") == "new") & _unseen_since(days, as_of)


def outlives(days: int, as_of) -> Column:
    """True for expired rows past the keeping time; handled rows are kept for ever."""
    return F.lit(days > 0) & (F.col("status") == "expired") & _unseen_since(days, as_of)


def expire(history: DataFrame, days: int, as_of) -> DataFrame:
    return history.withColumn("status", F.when(goes_stale(days, as_of), "expired").otherwise(F.col("status")))


def prune(history: DataFrame, days: int, as_of) -> DataFrame:
    return history.filter(~outlives(days, as_of))


def set_status(history: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Apply (url, status) changes; with ``order`` the last change of a URL wins."""
    if order:
        changes = changes.groupBy("url").agg(F.max_by("status", order).alias("status"))
    allowed = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(
        F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null"))))
    )
    changes = changes.select("url", allowed.alias("_status"))
    return (
        history.join(changes, "url", "left")
        .withColumn("status", F.coalesce("_status", "status")).drop("_status")
        .select(*history.columns)
    )


def list_active(
    history: DataFrame,
    *,
    source: str | None = None,
    city: str | None = None,
    language: str | None = None,
    new_today: bool = False,
    min_score: float = 0,
    limit: int | None = None,
    as_of=None,
) -> DataFrame:
    """Open rows, best first; text filters are substrings and ignore case."""
    rows = history.filter(F.col("status") == "new")
    for name, part in (("source", source), ("location", city)):
        if part:
            part = part.replace("\\", "\\\\")
            rows = rows.filter(F.col(name).ilike(f"%{part}%"))
    if language:
        rows = rows.filter(F.col("language") == language)
    if new_today:
        rows = rows.filter(F.col("first_seen") == as_day(as_of))
    if min_score:
        rows = rows.filter(F.col("fit_score") >= min_score)
    rows = rows.orderBy(F.desc("fit_score"), F.asc("url"))
    return rows.limit(int(limit)) if limit else rows


def counts(history: DataFrame, as_of) -> DataFrame:
    """One row: open rows, and those first seen today."""
    is_open = F.col("status") == "new"
    return history.agg(
        F.count_if(is_open).alias("total_open"),
        F.count_if(is_open & (F.col("first_seen") == as_day(as_of))).alias("new_today"),
    )


def last_value(log: DataFrame, value: str, order: str, default: str = "") -> DataFrame:
    """Newest value of an append-only log, or the default if there is none."""
    return log.agg(F.coalesce(F.max_by(value, order), F.lit(default)).alias(value))
