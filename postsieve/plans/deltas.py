"""A history kept as a base and daily deltas: a day writes the rows it touches and not the history.

Below one folder lie ``base=<version>`` (all rows), ``delta=<version>`` (the rows of one commit) and ``sweep=<version>``
(the day and the two limits of that commit, one row). A commit counts once its delta is complete. The state is read as
the newest base whose rows were not touched since, with the newest delta row of every URL; expiry and pruning follow
from ``last_seen`` and the sweeps behind a row's version and are never written. After some commits the state is written
as the next base.

All files are Parquet written and read by Spark. Bases are parted by a bucket of the URL, which the join with a day's
URLs prunes. A version that is committed again starts from the state before it and replaces its own files, so a run that
is repeated, or one whose driver was lost half-way, leaves the same state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.operators import history as hist
from postsieve.schema import HANDLED, HISTORY, PAYLOAD, conform

COLUMNS = [f.name for f in HISTORY.fields]
_LAYOUT = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HISTORY.fields)
#: Columns of the files; ``action`` is what the commit did with a row.
LAYOUTS = {
    "base": f"{_LAYOUT}, bucket int",
    "delta": f"{_LAYOUT}, bucket int, version bigint, action string",
    "sweep": "version bigint, as_of string, expire_days int, keep_days int",
}


class DeltaTable:
    """``compact_after`` commits on one base lead to the next base; the one before stays until then."""

    def __init__(self, spark: SparkSession, root: str, compact_after: int = 16, buckets: int = 64):
        self.spark, self.root, self.compact_after, self.buckets = spark, root.rstrip("/"), max(1, compact_after), buckets

    def path(self, kind: str, version: int) -> str:
        return f"{self.root}/{kind}={version}"

    def _file_system(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self, kind: str, before: int | None = None) -> list[int]:
        root, fs = self._file_system(self.root)
        if not fs.exists(root):
            return []
        found = []
        for entry in fs.listStatus(root):
            name = entry.getPath().getName()
            if name.startswith(f"{kind}=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                found.append(int(name.split("=", 1)[1]))
        return sorted(v for v in found if before is None or v < before)

    def _drop(self, kind: str, version: int) -> None:
        path, fs = self._file_system(self.path(kind, version))
        fs.delete(path, True)

    def versions(self) -> list[int]:
        return sorted({*self._committed("base"), *self._committed("delta")})

    def _read(self, kind: str, versions: list[int]) -> DataFrame:
        return self.spark.read.schema(LAYOUTS[kind]).parquet(*[self.path(kind, v) for v in versions])

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int"))

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        """Newest row of every URL. Each column is taken by itself, so that those nobody reads are never shuffled."""
        each = [F.max_by(c, "version").alias(c) for c in COLUMNS[1:]]
        return rows.groupBy("bucket", "url").agg(*each, F.max("version").alias("version"))

    def _rows(self, before: int | None, of: DataFrame | None = None, slim: bool = False) -> tuple[DataFrame, int]:
        """Newest row of every URL, or of the distinct URLs of a small table, with its ``version``; and the base's version.

        With ``slim`` only handled rows carry their payload, which is all that a merge takes of known rows it meets.
        """
        bases = self._committed("base", before)
        base = bases[-1] if bases else -1
        deltas = [v for v in self._committed("delta", before) if v > base]

        def chosen(df: DataFrame) -> DataFrame:
            if slim:
                df = df.withColumns({c: F.when(F.col("status").isin(*HANDLED), F.col(c)) for c in PAYLOAD})
            # not a semi-join: that would be moved below the columns and shuffle them whole
            return df if of is None else df.join(of, ["bucket", "url"])

        rows = None
        if bases:
            rows = chosen(self._read("base", [base]).withColumn("version", F.lit(base).cast("bigint"))).select("bucket", *COLUMNS, "version")
        if deltas:
            newest = chosen(self._read("delta", deltas)).select("bucket", *COLUMNS, "version")
            newest = self._newest(newest) if len(deltas) > 1 else newest
            rows = newest if rows is None else rows.join(newest.select("bucket", "url"), ["bucket", "url"], "left_anti").unionByName(newest)
        if rows is None:
            rows = self._bucketed(hist.empty_history(self.spark)).withColumn("version", F.lit(-1).cast("bigint"))
        return rows, base

    def _sweeps(self, after: int, before: int | None) -> list:
        """The sweeps of the commits on a base, oldest first: a handful of rows, as bases follow each other."""
        versions = [v for v in self._committed("delta", before) if v > after]
        if not versions:
            return []
        return sorted(self._read("sweep", versions).collect(), key=lambda r: r.version)

    @staticmethod
    def _swept(rows: DataFrame, sweeps: list) -> DataFrame:
        """Expire and prune as each run behind a row's version did, in their order."""
        for s in sweeps:
            later = F.col("version") <= s.version
            stale = later & hist.goes_stale(s.expire_days, s.as_of)
            rows = rows.withColumn("status", F.when(stale, "expired").otherwise(F.col("status")))
            rows = rows.filter(~(later & hist.outlives(s.keep_days, s.as_of)))
        return rows

    def _state(self, before: int | None, of: DataFrame | None = None, slim: bool = False) -> DataFrame:
        rows, base = self._rows(before, of, slim)
        return self._swept(rows, self._sweeps(base, before))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest state, or the newest below a version; None if there is none."""
        known = self._committed("base", before) or self._committed("delta", before)
        return self._state(before).select(*COLUMNS) if known else None

    def write(self, df: DataFrame, version: int) -> DataFrame:
        """Commit a whole history as a base."""
        self._drop("delta", version)
        self._bucketed(conform(df, HISTORY)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.path("base", version))
        return self.read()

    def _commit(self, rows: DataFrame, version: int, as_of, expire_days: int, keep_days: int) -> DataFrame:
        self._drop("delta", version)
        self._drop("base", version)
        sweep = self.spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(str(as_of)).alias("as_of"),
                                           F.lit(int(expire_days)).alias("expire_days"), F.lit(int(keep_days)).alias("keep_days"))
        sweep.write.mode("overwrite").parquet(self.path("sweep", version))
        rows.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(self.path("delta", version))
        return self._read("delta", [version])

    def commit(self, new: DataFrame, as_of, version: int, expire_days: int, keep_days: int) -> dict[str, int]:
        """Merge a day's selection, one row per URL, with expiry and pruning; the counts are those of what was
        committed."""
        sought = self._bucketed(new.select("url").distinct())
        known = self._state(version, sought, slim=True).select(*COLUMNS)
        delta = self._commit(self._bucketed(hist.merge(known, new, as_of)), version, as_of, expire_days, keep_days)
        counts = delta.agg(*[F.count_if(F.col("action") == a).alias(a) for a in hist.ACTIONS]).first().asDict()
        counts |= self._swept_now(version)
        self._compact(version)
        return counts

    def _swept_now(self, version: int) -> dict[str, int]:
        """How many rows the sweep of a version expires and prunes; reads keys, dates and states only."""
        rows, base = self._rows(version + 1)
        sweeps = self._sweeps(base, version + 1)
        rows = self._swept(rows, sweeps[:-1])
        stale = hist.goes_stale(sweeps[-1].expire_days, sweeps[-1].as_of)
        rows = rows.withColumn("stale", stale).withColumn("status", F.when(F.col("stale"), "expired").otherwise(F.col("status")))
        return rows.agg(F.count_if("stale").alias("expired"),
                        F.count_if(hist.outlives(sweeps[-1].keep_days, sweeps[-1].as_of)).alias("pruned")).first().asDict()

    def set_status(self, changes: DataFrame, as_of, version: int, order: str | None = None) -> None:
        """Commit (url, status) changes of known URLs; with ``order`` the last change of a URL wins."""
        known = self._state(version, self._bucketed(changes.select("url").distinct())).select(*COLUMNS)
        self._commit(self._bucketed(hist.set_status(known, changes, order)), version, as_of, 0, 0)
        self._compact(version)

    def _compact(self, version: int) -> None:
        """Fold the commits into a base if there are enough, and drop what only the base before last was read with."""
        bases = self._committed("base", version)
        since = [v for v in self._committed("delta", version + 1) if not bases or v > bases[-1]]
        if len(since) < self.compact_after:
            return
        rows = self._read("delta", since).select("bucket", *COLUMNS, "version")
        if bases:
            rows = rows.unionByName(self._read("base", bases[-1:]).withColumn("version", F.lit(bases[-1]).cast("bigint")))
        # dealt by bucket once, for finding the newest rows as well as for the files
        state = self._swept(self._newest(rows.repartition("bucket")), self._sweeps(bases[-1] if bases else -1, version + 1))
        state.select("bucket", *COLUMNS).write.mode("overwrite").partitionBy("bucket").parquet(self.path("base", version))
        if bases:
            for kind in ("base", "delta", "sweep"):
                for old in self._committed(kind, bases[-1] if kind == "base" else bases[-1] + 1):
                    self._drop(kind, old)
