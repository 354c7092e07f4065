"""Cutting lineage and keeping snapshots on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a folder below the warehouse is taken, which all executors share as well.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise RuntimeError("set spark.checkpoint.dir or spark.sql.warehouse.dir to a folder all executors share")
        shared = f"{warehouse.rstrip('/')}/_checkpoints"
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to reliable storage and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name next to the checkpoints, on storage all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut` for wide rows: a Parquet table in the shared folder, so that
    later steps read only the columns they need."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Columns of a copy that say what the run behind it did with a row; rows that it pruned are in the copy, marked.
FLAGS = ("action", "expired_now", "pruned_now")


#: What a recheck told of the rows it dismissed.
TOLD = "told"


def _visible(df: DataFrame) -> DataFrame:
    df = df.drop(TOLD)
    return df.filter("not pruned_now").drop(*FLAGS) if "pruned_now" in df.columns else df


class SnapshotTable:
    """Numbered full copies of a table below one folder.

    A copy counts only once its write has committed, so a lost driver leaves at
    worst an unread folder, and writing a number again replaces that copy.  With
    ``keep``, a commit removes all but so many of the newest copies; two at least
    stay, as a run that is repeated starts from the copy before its own.

    A copy can be laid out for its readers: in one folder for each value of
    ``partition_by`` (text, not blank), whose rows lie in ranges of ``range_by``.
    A filter on the first skips folders, one on the second files and row groups.
    Ranges are cut by number of rows, so a folder that holds most rows has the
    most files.  The columns of ``partition_by`` come last in what is read.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int | None = None,
                 partition_by: tuple[str, ...] = (), range_by: tuple[str, ...] = ()):
        self.spark, self.root = spark, root.rstrip("/")
        self.keep = None if keep is None else max(2, keep)
        self.partition_by, self.range_by = tuple(partition_by), tuple(range_by)

    def path(self, version: int) -> str:
        return f"{self.root}/snapshot={version}"

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for entry in fs.listStatus(root):
            path = entry.getPath()
            name = path.getName()
            if name.startswith("snapshot=") and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                found.append(int(name.split("=", 1)[1]))
        return sorted(found)

    def read(self, before: int | None = None) -> DataFrame | None:
        """Newest copy, or the newest below a number; None if there is none."""
        known = [v for v in self.versions() if before is None or v < before]
        return _visible(self.spark.read.parquet(self.path(known[-1]))) if known else None

    def write(self, df: DataFrame, version: int) -> DataFrame:
        if self.partition_by or self.range_by:
            order = (*self.partition_by, *self.range_by)
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        df.write.mode("overwrite").partitionBy(*self.partition_by).parquet(self.path(version))
        if self.keep is not None:
            for old in [v for v in self.versions() if v <= version][: -self.keep]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(old))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return _visible(self.spark.read.parquet(self.path(version)))
