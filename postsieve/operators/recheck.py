"""Re-evaluation of the open history under the current policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.operators.gates import with_reason
from postsieve.operators.score import score
from postsieve.plans.durable import TOLD
from postsieve.policy import Policy
from postsieve.schema import HISTORY, as_day


def judged(history: DataFrame, policy: Policy, as_of, sim: Column | None = None) -> DataFrame:
    """Open rows with their old score, reject reason, new score and verdict.

    The key is unique, so gating and scoring are one projection of the history:
    nothing is joined or shuffled.
    """
    open_rows = with_reason(history.filter(F.col("status") == "new"), policy, as_of).withColumns({
        "old_score": F.coalesce("fit_score", F.lit(0.0)), "old_reason": F.col("fit_reason"),
    })
    keep = F.col("reject_reason").isNull() & (F.col("fit_score") >= policy.floor_fit_score)
    return score(open_rows, policy, as_of, sim).withColumn("kept", keep)


def _told() -> Column:
    """Old score of a row to dismiss and the new one, or "filtered out"; null for a row that stays."""
    new = F.when(F.col("reject_reason").isNull(), F.format_string("%.1f", "fit_score")).otherwise("filtered out")
    return F.when(~F.col("kept"), F.struct("old_score", new.alias("new_score")))


def report(rows: DataFrame) -> DataFrame:
    """Rows to dismiss with the old score and the new one, or "filtered out".

    They are rows of a list of one or none: a filter on the verdict would be moved below gates and scores, and with it
    a copy of each for every place that uses them.
    """
    told = _told()
    dropped = F.struct("url", "title", told["old_score"].alias("old_score"), told["new_score"].alias("new_score"))
    return rows.select(F.inline(F.when(~F.col("kept"), F.array(dropped))))


def recheck(
    history: DataFrame, policy: Policy, as_of, sim: Column | None = None, dry_run: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(report, next history).  Kept rows are refreshed today, the others dismissed.

    A dry run gives the history back unchanged.
    """
    rows = judged(history, policy, as_of, sim)
    if dry_run:
        return report(rows), history
    return report(rows), _applied(history, rows, as_of)


def marked(history: DataFrame, policy: Policy, as_of, sim: Column | None = None) -> DataFrame:
    """The next history in one pass, with the mark ``TOLD`` from which :func:`report_of` reads the report."""
    return _applied(history, judged(history, policy, as_of, sim).withColumn(TOLD, _told()), as_of, TOLD)


def report_of(stored: DataFrame) -> DataFrame:
    """The report of a recheck from its committed rows and their marks."""
    return stored.filter(F.col(TOLD).isNotNull()).select("url", "title", f"{TOLD}.*")


def _applied(history: DataFrame, rows: DataFrame, as_of, *marks: str) -> DataFrame:
    """Next state of the judged rows beside those that are not open; kept rows are refreshed today."""
    applied = rows.withColumns({
        "fit_score": F.when(F.col("kept"), F.col("fit_score")).otherwise(F.col("old_score")),
        "fit_reason": F.when(F.col("kept"), F.col("fit_reason")).otherwise(F.col("old_reason")),
        "last_seen": F.when(F.col("kept"), as_day(as_of)).otherwise(F.col("last_seen")),
        "status": F.when(F.col("kept"), "new").otherwise("dismissed"),
    })
    columns = [f.name for f in HISTORY]
    others = history.filter(F.col("status") != "new").select(*columns)
    return applied.select(*columns, *marks).unionByName(others, allowMissingColumns=True)
