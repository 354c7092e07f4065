"""A history of a base and deltas against the one that is rewritten each day."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from postsieve.operators import history as hist
from postsieve.plans.deltas import DeltaTable
from postsieve.schema import HISTORY, PAYLOAD, conform

#: Day, limits of expiry and keeping; None is a change of states instead of a day's selection.
DAYS = (("2024-01-01", 7, 30), ("2024-01-09", 7, 30), None, ("2024-01-12", 3, 5), ("2024-02-20", 0, 0), ("2024-03-30", 7, 30))


def selection(spark, urls, day):
    df = spark.createDataFrame([(u, f"title {u} {day}", float(len(u) + day)) for u in urls], "url string, title string, fit_score double")
    return df.select("url", *[F.col(c) if c in ("title", "fit_score") else F.lit("x").alias(c) for c in PAYLOAD])


def eager(state, new, as_of, expire_days, keep_days):
    merged = hist.merge(state, new, as_of)
    expired = hist.expire(merged, expire_days, as_of)
    counts = merged.agg(*[F.count_if(F.col("action") == a).alias(a) for a in hist.ACTIONS], F.count_if(hist.goes_stale(expire_days, as_of)).alias("expired")).first().asDict()
    pruned = expired.agg(F.count_if(hist.outlives(keep_days, as_of)).alias("pruned")).first().asDict()
    return hist.prune(expired.drop("action"), keep_days, as_of), counts | pruned


def rows_of(df):
    return sorted(map(tuple, df.select(*[f.name for f in HISTORY.fields]).collect()))


def test_days_equal_the_rewritten_history(spark, tmp_path):
    r = random.Random(1)
    store = DeltaTable(spark, str(tmp_path / "h"), compact_after=3, buckets=2)
    assert store.read() is None
    state = hist.empty_history(spark)
    for version, day in enumerate(DAYS, start=1):
        if day is None:
            changes = spark.createDataFrame([(f"u{i}", r.choice(("applied", "dismissed", "new", "expired")), k) for k, i in enumerate(r.choices(range(45), k=9))],
                                            "url string, status string, k int")
            state = hist.set_status(state, changes, "k")
            store.set_status(changes, DAYS[version - 2][0], version, "k")
        else:
            new = selection(spark, r.sample([f"u{i}" for i in range(40)], r.choice((0, 8, 20))), version)
            state, want = eager(state, new, *day)
            assert store.commit(new, day[0], version, *day[1:]) == want
        state = spark.createDataFrame(rows_of(state), HISTORY)
        assert rows_of(store.read()) == rows_of(state)
    # the last day again, after a driver that was lost half-way
    last = Path(store.path("delta", version))
    before = rows_of(store.read(before=version))
    new = selection(spark, ["u1", "u2", "later"], 99)
    store.commit(new, "2024-03-30", version, 7, 30)
    first = rows_of(store.read())
    (last / "_SUCCESS").unlink()
    store._drop("base", version)
    assert rows_of(store.read()) == before
    store.commit(new, "2024-03-30", version, 7, 30)
    assert rows_of(store.read()) == first


def test_a_day_writes_what_it_touches(spark, tmp_path):
    size = lambda kind, v: sum(p.stat().st_size for p in Path(store.path(kind, v)).rglob("*.parquet"))
    store = DeltaTable(spark, str(tmp_path / "h"), buckets=4)
    text = F.concat(*[F.sha2(F.concat("url", F.lit(str(i))), 512) for i in range(8)])
    url = spark.range(20_000).select(F.concat(F.lit("https://example.org/"), F.col("id").cast("string")).alias("url"), "id")
    seen = {c: F.lit("2024-01-01").cast("date") for c in ("first_seen", "last_seen")}
    store.write(conform(url.withColumns({"description": text, "status": F.lit("new"), **seen}), HISTORY), 1)
    new = conform(url.filter("id % 100 = 7").withColumn("description", text), HISTORY).select("url", *PAYLOAD)
    assert store.commit(new, "2024-01-02", 2, 21, 180) == {"inserted": 0, "updated": 200, "reopened": 0, "skipped_handled": 0, "expired": 0, "pruned": 0}
    assert 0.005 < size("delta", 2) / size("base", 1) < 0.02
    # a day of expiry writes nothing but its own rows
    assert store.commit(new.limit(0), "2024-01-23", 3, 21, 180)["expired"] == 19_800
    assert size("delta", 3) < 0.01 * size("base", 1)
    assert store.read().groupBy("status").count().orderBy("status").collect() == [("expired", 19_800), ("new", 200)]


def test_bases_and_folded_deltas_are_dropped(spark, tmp_path):
    store = DeltaTable(spark, str(tmp_path / "h"), compact_after=2, buckets=1)
    for v in range(1, 6):
        store.commit(selection(spark, [f"u{v}"], v), f"2024-01-0{v}", v, 21, 180)
    assert sorted(p.name for p in (tmp_path / "h").iterdir()) == [
        "base=2", "base=4", "delta=3", "delta=4", "delta=5", "sweep=3", "sweep=4", "sweep=5"]
    assert sorted(r.url for r in store.read().collect()) == [f"u{v}" for v in range(1, 6)]
    assert sorted(r.url for r in store.read(before=4).collect()) == [f"u{v}" for v in range(1, 4)]
