"""A recheck judges each row once."""

from catalog import queries as Q
from postsieve.operators import recheck
from postsieve.plans import publication
from postsieve.plans.durable import SnapshotTable

SF = "/root/testdata/sf0.001"



def test_the_report_does_not_copy_gates_and_scores(spark, tmp_path):
    Q.recheck_base(spark, SF).write.parquet(str(tmp_path / "h"))
    rows = recheck.judged(spark.read.parquet(str(tmp_path / "h")), Q.P, "2024-01-12")
    once = rows.select("url", "title", "old_score", "kept", "reject_reason", "fit_score")
    split = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("split(")
    assert 0 < split(recheck.report(rows)) <= split(once)


def test_a_recheck_is_reported_from_its_committed_rows(spark, tmp_path):
    store = SnapshotTable(spark, str(tmp_path / "h"))
    store.write(Q.recheck_base(spark, SF), 1)
    report, after = recheck.recheck(store.read(), Q.P, "2024-01-12")
    told = publication.recheck_store(spark, Q.P, store, "2024-01-12", 2)
    assert told.columns == report.columns and sorted(told.collect()) == sorted(report.collect())
    assert store.read().columns == after.columns and sorted(store.read().collect()) == sorted(after.collect())
    assert "told" in spark.read.parquet(store.path(2)).columns  # as it was committed with the rows


def test_a_dry_recheck_leaves_nothing(spark, tmp_path):
    store = SnapshotTable(spark, str(tmp_path / "h"))
    store.write(Q.recheck_base(spark, SF), 1)
    publication.recheck_store(spark, Q.P, store, "2024-01-12", 2, dry_run=True)
    assert store.versions() == [1]
