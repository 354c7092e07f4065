"""Operator 2 learns and calibrates on all labelled candidates."""

import random

from pyspark.sql import functions as F

from postsieve.llm import pii


def test_trees_see_every_labelled_candidate(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_ROWS", 7, raising=False)
    texts = [(i, f"call +49 30 {1000000 + i * 37} or mail a{i}@b{i % 9}.org, host 10.0.{i % 256}.7, not x{i}@ nor +1 (2)3 4 5 6 7") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    settled = spark.createDataFrame(
        [(sum(truth is not None for _, truth, _ in pii.scan(t)[1]),) for _, t in texts], "n int").agg(F.sum("n")).first()[0]
    seen, fit = [], pii.GBTClassifier.fit

    class Model:
        def __init__(self, model):
            self.model = model

        def transform(self, df):
            if "y" in df.columns:
                seen.append(df)
            return self.model.transform(df)

    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, df: (seen.append(df), Model(fit(self, df)))[1])
    assert pii.find(docs).count() == 300
    weight = lambda df: df.agg(F.sum("weight")).first()[0] if "weight" in df.columns else df.count()
    assert len(seen) == 2 and sum(map(weight, seen)) == settled > 600


def _bound(rows):
    """The rule, row by row."""
    best, right, total = None, 0.0, 0.0
    for p in sorted({p for p, _, _ in rows if p >= 0.5}, reverse=True):
        right += sum(w for q, y, w in rows if q == p and y > 0)
        total += sum(w for q, y, w in rows if q == p)
        if right >= pii.PRECISION * total:
            best = p
    return best


def test_bounds_are_those_of_all_rows(spark):
    draw = random.Random(5)
    rows = []
    for kind, clean in ((0, 0.999), (1, 0.97), (3, 0.5)):
        for _ in range(400):
            p = draw.choice((draw.random(), 0.7, 0.95, 0.95 + draw.random() / 2000))
            rows.append((kind, float(draw.random() < clean * (p > 0.6)), float(draw.randint(1, 5)), p))
    found = pii._bounds(spark.createDataFrame(rows, "kind int, y double, weight double, p double"))
    true = {k: _bound([(p, y, w) for kind, y, w, p in rows if kind == k]) for k in (0, 1, 2, 3)}
    assert found == {k: b for k, b in true.items() if b is not None} and found
