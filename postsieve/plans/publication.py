"""What a run leaves behind: dated sheets, of which the newest stay, and a row in the run log; and the recheck of a
stored history, which publishes its sheets again."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.operators.history import last_value, upgrade
from postsieve.operators.publish import write_sheets
from postsieve.operators.recheck import judged, marked, report, report_of
from postsieve.plans.daily import RunResult, Similarity
from postsieve.plans.durable import SnapshotTable, written
from postsieve.policy import Policy


def publish(spark: SparkSession, result: RunResult, policy: Policy, folder: str) -> None:
    """Write the run's sheets and its log row below ``folder``; a run that is published again replaces both."""
    day = result.summary["run_date"]
    publish_sheets(spark, result.history, policy, day, folder)
    result.summary_row(spark).drop("run_date").write.mode("overwrite").parquet(f"{folder}/run_log/run_date={day}")


def publish_sheets(spark: SparkSession, history: DataFrame, policy: Policy, as_of: str | date, folder: str) -> None:
    """The day's sheets of a history's open rows, then no more than the newest days."""
    write_sheets(history.filter(F.col("status") == "new"), as_of, f"{folder}/sheets")
    drop_old(spark, f"{folder}/sheets", policy.keep_exports)


def recheck_store(
    spark: SparkSession,
    policy: Policy,
    store: SnapshotTable,
    as_of: str | date,
    version: int,
    folder: str | None = None,
    similarity: Similarity | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """Judge the open rows of the newest history below ``version`` again, commit the result as ``version``, publish its
    sheets below ``folder`` and return the report.

    A dry run commits and publishes nothing. A recheck that is repeated starts from the same history again.
    """
    history = store.read(before=version)
    if history is None:
        raise ValueError(f"no history before version {version}")
    history = upgrade(history)
    rows, sim = (history, None) if similarity is None else (similarity(history), F.col("sim"))
    if dry_run:
        return written(report(judged(rows, policy, as_of, sim)))
    # judged once: the report is read from the marks that were committed with the rows
    current = store.write(marked(rows, policy, as_of, sim), version)
    if folder is not None:
        publish_sheets(spark, current, policy, as_of, folder)
    return written(report_of(spark.read.parquet(store.path(version))))


def drop_old(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Remove all but the newest dates' partitions and name them; 0 or less removes nothing. No data is read."""
    if keep <= 0:
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    dated = sorted(x.getPath().getName() for x in fs.listStatus(root) if x.getPath().getName().startswith("run_date="))
    for name in dated[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)
    return dated[:-keep]


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run, newest content."""
    return spark.read.parquet(f"{folder}/run_log").withColumn("run_date", F.col("run_date").cast("string"))


def last_run(spark: SparkSession, folder: str, default: str = "never") -> DataFrame:
    return last_value(run_log(spark, folder), "run_date", "run_date", default)
