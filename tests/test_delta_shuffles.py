"""What a history of a base and deltas shuffles."""

import re

from catalog import queries as Q
from postsieve.plans.deltas import DeltaTable

SF = "/root/testdata/sf0.001"


def shuffled(df) -> list[str]:
    """The output columns of what goes into each exchange."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if re.search(r"\bExchange hashpartitioning", line)]


def test_counts_and_sweeps_shuffle_no_texts(spark, tmp_path):
    store = DeltaTable(spark, str(tmp_path / "h"), compact_after=9, buckets=4)
    first, second = Q.ranked_slice(spark, SF, 0), Q.ranked_slice(spark, SF, 1)
    store.commit(first, "2024-01-10", 1, 21, 180)
    assert not shuffled(store.read().select("description"))  # a single delta has every URL once
    store.commit(second, "2024-01-11", 2, 21, 180)
    narrow = store.read().groupBy("status").count()
    assert shuffled(narrow) and not any("description" in line for line in shuffled(narrow))


def test_a_merge_meets_known_rows_without_their_texts(spark, tmp_path):
    store = DeltaTable(spark, str(tmp_path / "h"), compact_after=9, buckets=4)
    new = Q.ranked_slice(spark, SF, 0)
    store.commit(new, "2024-01-10", 1, 21, 180)
    some = new.orderBy("url").limit(3).select("url")
    store.set_status(some.selectExpr("url", "'applied' as status"), "2024-01-10", 2)
    before = {r.url: r for r in store.read().collect()}
    sought = store._bucketed(new.select("url").distinct())
    known = store._state(3, sought, slim=True).select("url", "status", "description")
    assert {r.status for r in known.filter("description is not null").collect()} == {"applied"}
    store.commit(new.selectExpr("* except (description)", "'changed' as description").select(new.columns), "2024-01-11", 3, 21, 180)
    after = {r.url: r for r in store.read().collect()}
    handled = {r.url for r in some.collect()}
    assert after.keys() == before.keys() and len(handled) == 3
    assert all(after[u] == before[u] if u in handled else after[u].description == "changed" for u in after)
