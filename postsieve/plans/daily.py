"""One run: postings in, next history, sheets, digest and summary out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.operators import history as hist
from postsieve.operators.dedup import leaders, representatives
from postsieve.operators.gates import GATES, dropoff_counts, with_reason
from postsieve.operators.normalize import normalize
from postsieve.operators.publish import digest, sheets
from postsieve.operators.score import score, select_top
from postsieve.plans.deltas import DeltaTable
from postsieve.plans.durable import SnapshotTable, cut, written
from postsieve.policy import Policy
from postsieve.sources.union import union_sources


@dataclass
class RunResult:
    ranked: DataFrame
    history: DataFrame
    all_open: DataFrame
    new_today: DataFrame
    digest: DataFrame
    dropoff: dict[str, int]
    summary: dict

    def summary_row(self, spark: SparkSession) -> DataFrame:
        """The summary as one row for the append-only run log."""
        return spark.createDataFrame([tuple(self.summary.values())], list(self.summary))


Similarity = Callable[[DataFrame], DataFrame]


def _sim(rows: DataFrame, similarity: Similarity | None) -> tuple[DataFrame, Column | None]:
    return (rows, None) if similarity is None else (similarity(rows), F.col("sim"))


def verdicts(
    postings: DataFrame, policy: Policy, as_of, similarity: Similarity | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """(seq, reject_reason, fit_score) of every posting and the columns to ``keep``, from scans alone.

    Rejected rows are not scored: their texts are blanked first, or, where a
    similarity has to be computed, they are left out of that branch.
    """
    judged = with_reason(postings, policy, as_of)
    passes = F.col("reject_reason").isNull()
    narrow = ("seq", *keep, "reject_reason", "fit_score")
    if similarity is None:
        blanked = judged.withColumns({c: F.when(passes, F.col(c)) for c in ("title", "description")})
        return score(blanked, policy, as_of, reason=False).select(*narrow)
    rows, sim = _sim(judged.filter(passes), similarity)
    scored = score(rows, policy, as_of, sim, reason=False).select(*narrow)
    return scored.unionByName(
        judged.filter(~passes).select("seq", *keep, "reject_reason", F.lit(0.0).alias("fit_score"))
    )


def rank(
    postings: DataFrame, policy: Policy, as_of, similarity: Similarity | None = None
) -> tuple[DataFrame, dict]:
    """Dedup, gate, score and select, with the counts of the gates.

    Only keys, reasons and scores are joined and sorted.  The postings
    themselves are read by scans, and the few selected ones fetched at the end
    by a broadcast of their keys; reasons are written for these alone.
    """
    groups = leaders(postings)
    kept = representatives(postings, groups).join(verdicts(postings, policy, as_of, similarity), "seq")
    judged = written(kept.select(F.col("seq").alias("row"), F.col("leader_seq").alias("seq"), "reject_reason", "fit_score"))
    return selected(postings, judged, policy, as_of, similarity), judged.agg(*dropoff_counts()).first().asDict()


def selected(
    postings: DataFrame, judged: DataFrame, policy: Policy, as_of, similarity: Similarity | None = None
) -> DataFrame:
    """The best of the judged rows (``row`` of the posting, its place ``seq``, reason and score), with reasons."""
    best = cut(select_top(judged.filter("reject_reason is null"), policy).select("row", F.col("seq").alias("place")))
    chosen = postings.join(best, postings["seq"] == best["row"]).drop("row")
    rows, sim = _sim(chosen, similarity)
    ranked = score(rows, policy, as_of, sim).withColumn("seq", F.col("place")).drop("place")
    return cut(ranked)


def advance(store: SnapshotTable | DeltaTable, ranked: DataFrame, policy: Policy, as_of, version: int) -> tuple[DataFrame, dict]:
    """Merge, expire and prune once and commit; the counts are read from the marks that were committed with the rows.
    Counts taken while rows pass by would be wrong once a lost task runs again."""
    if isinstance(store, DeltaTable):
        counts = store.commit(ranked, as_of, version, policy.expire_days, policy.db_keep_days)
        return store.read(before=version + 1), counts
    spark, history = ranked.sparkSession, store.read(before=version)
    history = hist.empty_history(spark) if history is None else hist.upgrade(history)
    after = (
        hist.merge(history, ranked, as_of).withColumn("expired_now", hist.goes_stale(policy.expire_days, as_of))
        .withColumn("status", F.when(F.col("expired_now"), "expired").otherwise(F.col("status")))
        .withColumn("pruned_now", hist.outlives(policy.db_keep_days, as_of))
    )
    current = store.write(after, version)
    counts = spark.read.parquet(store.path(version)).agg(
        *[F.count_if(F.col("action") == a).alias(a) for a in hist.ACTIONS],
        F.count_if("expired_now").alias("expired"), F.count_if("pruned_now").alias("pruned"),
    ).first().asDict()
    return current, counts


def run(
    spark: SparkSession,
    policy: Policy,
    sources: list[DataFrame],
    store: SnapshotTable | DeltaTable,
    as_of,
    version: int,
    similarity: Similarity | None = None,
) -> RunResult:
    """Run the stages for one day and commit the next history as ``version``: as a whole copy, or as the rows that the
    day touches if the store keeps deltas.

    ``similarity`` adds a ``sim`` column (a cosine) to postings.

    Running a version again starts from the history before it and replaces it.
    """
    raw = written(union_sources(sources))
    normalized = written(normalize(raw, policy))
    ranked, gates = rank(normalized, policy, as_of, similarity)

    current, merge_counts = advance(store, ranked, policy, as_of, version)
    open_rows = current.filter(F.col("status") == "new")
    all_open, new_today = sheets(open_rows, as_of)
    totals = hist.counts(current, as_of).first()
    summary = {
        "run_date": str(as_of),
        "raw": raw.count(),
        "normalized": normalized.count(),
        "deduped": gates["input"],
        "filtered": gates["passed"],
        "ranked": ranked.count(),
        **merge_counts,
        "new_today": totals["new_today"],
        "total_open": totals["total_open"],
    }
    return RunResult(
        ranked, current, all_open, new_today, digest(open_rows, policy, as_of),
        {name: gates[name] for name in ("input", *GATES, "passed")}, summary,
    )
