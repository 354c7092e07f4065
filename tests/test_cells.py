"""Near-duplicate records are compared tile by tile, and a batch of copies does not blow up."""

import random

import pytest
from pyspark.sql import functions as F

from postsieve.functions import similarity as S
from postsieve.operators import dedup
from tests.test_bands import _texts
from tests.test_properties import frame, sequential_leaders


def _records(spark, n, words, seed=3):
    left, right = _texts(seed, n // 2, words)
    rows = [(i, f"b{i % 2}", sorted(set(text.split()))) for i, text in enumerate(x for pair in zip(left, right) for x in pair)]
    rows += [(n + i, "b0", sorted({"日本語", "𝒳" * (i + 1), "straße", "x" * 70, "y" * (60 + i)})) for i in range(6)]
    rows = [(i, block, words) for i, block, words in rows if words]
    return spark.createDataFrame(rows, "id long, block string, words array<string>").withColumn("copies", F.lit(1)), rows


def _similar_pairs(rows, threshold):
    met = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1]]
    ratios = S.ratios([" ".join(a[2]) for a, _ in met], [" ".join(b[2]) for _, b in met])
    return {(a[0], b[0]) for (a, b), ratio in zip(met, ratios) if ratio >= threshold}


@pytest.mark.parametrize("tile,words,threshold", [(8192, 60, 90), (30, 25, 80), (30, 120, 90)])
def test_cells_find_what_the_ratios_say(spark, monkeypatch, tile, words, threshold):
    monkeypatch.setattr(dedup, "_TILE_ROWS", tile)
    recs, rows = _records(spark, 160, words)
    found = dedup._features(recs, threshold)
    want = _similar_pairs(rows, threshold)
    assert len(want) > 5
    pairs = dedup._similar(found, found, threshold, 160, ordered=True)
    assert {tuple(r) for r in pairs.collect()} == want
    early, late = found.filter("id < 80"), found.filter("id >= 80")
    across = {(a, b) for a, b in want if a < 80 <= b}
    first = dedup._similar(early, late, threshold, 80, ordered=False).groupBy("b").agg(F.min("a").alias("a"))
    assert {r.b: r.a for r in first.collect()} == {b: min(a for a, c in across if c == b) for _, b in across}


def test_no_pair_leaves_the_tasks_of_spark(spark):
    recs, _ = _records(spark, 40, 20)
    found = dedup._features(recs)
    for within in (True, False):
        plan = dedup._similar(found, found, 90, 40, ordered=within)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        assert plan.count("hashpartitioning") == 1


def test_a_batch_of_copies_is_taken_in_narrow_steps(spark, monkeypatch):
    monkeypatch.setattr(dedup, "_FIRST_BATCH", 8)
    monkeypatch.setattr(dedup, "_MOST_PAIRS", 60)
    rows = [(i, "Unknown", f"{'abcdefghij'[i % 10] * 9} {'klmnopqrst'[i // 10] * 9}", "Berlin") for i in range(60)]
    rows += [(100 + i, "Unknown", f"machine learning internship in the data team number {i}", "Berlin") for i in range(80)]
    got = dict(dedup.leaders(frame(spark, rows), first_batch=32).collect())
    assert got == sequential_leaders(rows)


def test_the_richest_copy_is_kept_across_tiles_and_narrow_steps(spark, monkeypatch):
    for name, value in (("_TILE_ROWS", 16), ("_FIRST_BATCH", 8), ("_MOST_PAIRS", 60)):
        monkeypatch.setattr(dedup, name, value)
    rows = [(i, "Unknown", f"{'abcdefgh'[i % 8] * 9} {'klmnopqr'[i // 8] * 9}", "Berlin") for i in range(32)]
    rows += [(100 + i, "Unknown", f"machine learning internship in the data team number {i}", "Berlin") for i in range(40)]
    df = frame(spark, rows).withColumns({"description": F.repeat(F.lit("x"), (F.col("seq") % 7).cast("int")), "posted_date": F.lit("")})
    kept = {r.seq: (r.title, len(r.description)) for r in dedup.fuzzy_dedup(df, first_batch=24).collect()}
    led, titles = sequential_leaders(rows), {r[0]: r[2] for r in rows}
    best = {lead: min((s for s in led if led[s] == lead), key=lambda s: (-(s % 7), s)) for lead in set(led.values())}
    assert kept == {lead: (titles[s], s % 7) for lead, s in best.items()}
