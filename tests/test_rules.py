"""The rules on hand-made postings: the stages of one day and scalar cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postsieve.functions import text
from postsieve.functions.fields import canonical_url, clean_title, detect_language, detect_role_type
from postsieve.operators import history as hist
from postsieve.operators.dedup import fuzzy_dedup
from postsieve.operators.gates import dropoff, gate, german_too_high
from postsieve.operators.normalize import normalize
from postsieve.operators.publish import keep_newest, sheets
from postsieve.operators.score import score, select_top, spread
from postsieve.plans.daily import run
from postsieve.plans.durable import SnapshotTable
from postsieve.policy import Policy, enabled_sites, load_policy, number
from postsieve.schema import HISTORY, POSTING, conform
from postsieve.streaming.streaks import failure_streaks

P = Policy()
AS_OF = "2024-01-10"

# Six postings: two good ones, a senior title, a German bar, the same page
# reached twice, and an intern role outside the domains.
ROWS = [
    (1, "Machine Learning Internship", "Lab One", "Berlin, Germany", "test",
     "https://example.com/jobs/1?utm_source=mail",
     "An internship on NLP and LLM work with Python. Working language: English. German is a plus.", "2024-01-09"),
    (2, "Senior ML Engineer", "Lab Two", "Berlin", "test", "https://example.com/jobs/2", "We build models.", "2024-01-09"),
    (3, "Werkstudent Data Science", "Lab Three", "München", "test", "https://example.com/jobs/3",
     "Python jeden Tag. Deutschkenntnisse mindestens C1.", "2024-01-08"),
    (4, "HiWi Computer Vision", "Lab Four", "Berlin", "arbeitsagentur", "https://example.com/jobs/4",
     "English working language. Deep learning in Python.", "2024-01-10"),
    (5, "Machine Learning Internship - Apply now", "Lab One", "Berlin", "jobspy:indeed",
     "https://www.example.com/jobs/1/", "The first one again.", "2024-01-09"),
    (6, "E-commerce Intern", "Shop", "Berlin", "jobspy:indeed", "https://example.com/jobs/6",
     "Send an e-mail; we are available and retail is fun.", "2024-01-09"),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = spark.createDataFrame(
        ROWS, "seq long, title string, company string, location string, source string, url string, "
        "description string, posted_date string"
    )
    return conform(rows)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_stages_of_a_day(spark, raw):
    normal = normalize(raw, P)
    assert normal.count() == 5
    urls = [r.url for r in normal.collect()]
    assert len(urls) == len(set(urls))
    unique = fuzzy_dedup(normal)
    assert unique.filter("title like 'Machine%'").count() == 1
    counts = dropoff(unique, P, AS_OF).first().asDict()
    assert {k: v for k, v in counts.items() if v} == {
        "input": 5, "senior": 1, "domain": 1, "german": 1, "passed": 2
    }
    scored = score(gate(unique, P, AS_OF), P, AS_OF)
    assert {r.seq: r.fit_score for r in scored.collect()} == {1: 98.2, 4: 96.2}
    assert all(r.fit_reason for r in scored.collect())
    assert [r.seq for r in select_top(scored, P).orderBy(F.desc("fit_score")).collect()] == [1, 4]


def test_empty_input(spark, raw):
    none = score(gate(normalize(raw.limit(0), P), P, AS_OF), P, AS_OF)
    assert select_top(none, P).count() == 0


@pytest.mark.parametrize("phrase,keyword,expected", [
    ("send your e-mail", "ai", False), ("available jobs", "ai", False), ("we use AI here", "ai", True),
    ("a machine-learning team", "machine learning", True), ("machine_learning", "machine learning", True),
    ("öai", "ai", False), ("KÖLN", "köln", True), ("", "ai", False), ("ai", "", False),
    ("5+ years of it", "5+ years", True), ("15+ years", "5+ years", False), ("C++ and c", "c++", True),
    ("a -- b", "--", False), (r"path c:\sql now", r"c:\sql", True),
])
def test_contains(spark, phrase, keyword, expected):
    assert value(spark, text.contains(F.lit(phrase), keyword)) is expected


def test_any_and_matched(spark):
    t = F.lit("Deep Learning role with nlp")
    assert value(spark, text.any_match(t, ["nlp", "deep learning"])) is True
    assert value(spark, text.any_match(t, [])) is False
    assert value(spark, text.matched(t, ["nlp", "llm", "deep learning", "nlp"])) == ["nlp", "deep learning"]


def test_quote_of_a_listed_and_of_another_keyword(spark):
    t = F.lit("We look  for a good\nsquare (peg) in AI work and ai play")
    for known in (["ai"], []):
        assert value(spark, text.quote_around_any(t, F.lit("ai"), known, 8)) == "peg) in AI work an"
    assert value(spark, text.quote_around_any(t, F.lit("(peg)"), ["ai"], 4)) == "are (peg) in"
    assert value(spark, text.quote_around(t, "none", 8)) == ""


@pytest.mark.parametrize("url,expected", [
    ("https://www.example.com/jobs/x/?utm_source=a&id=7", "https://example.com/jobs/x?id=7"),
    ("HTTPS://WWW.Example.com:8080", "https://example.com:8080/"), ("no scheme", "no scheme"), ("  ", ""),
    ("https://a.b/c/;v=1?x=%C3%A4%zz#f", "https://a.b/c;v=1?x=%C3%A4%25zz"),
])
def test_canonical_url(spark, url, expected):
    assert value(spark, canonical_url(F.lit(url))) == expected


def test_clean_title(spark):
    assert value(spark, clean_title(F.lit("  Data Science Intern  -  Apply Now "))) == "Data Science Intern"


def test_role_fallback_is_a_plain_substring(spark):
    role = lambda t, c=P.role_types: value(spark, detect_role_type(F.lit(t), c))
    assert role("Interns wanted") == "internship"
    assert role("our workshk team") == "shk"
    assert role("Working student", ["student"]) == "student"
    assert role("nothing") == ""


def test_language(spark):
    lang = lambda t: value(spark, detect_language(F.lit(t)))
    assert [lang(x) for x in ("fluent english", "fließend Deutsch", "you and the team", "wir und sie", "xyz")] == [
        "en", "de", "en", "de", "unknown"
    ]
    assert lang("fliessend deutsch") == "unknown"


def test_german_level_uses_the_leftmost_match(spark):
    high = lambda t, m: value(spark, german_too_high(F.lit(t), m))
    assert high("German B1 and German C2", "B1") is False
    assert high("German C2", "B1") and not high("German B1, german optional", "A2")
    assert high("verhandlungssicher", "C2")


def test_numbers_keep_zero():
    assert number({"k": 0}, "k", 55) == 0.0
    assert [number(s, "k", 55) for s in ({}, {"k": None}, {"k": "x"})] == [55, 55, 55]
    assert Policy.of({"min_fit_score": 0, "scoring": {"role": 1}}).weights.domain == 25.0


def test_policy_file(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("domains: [nlp]\nretention: {expire_days: 3}\nsources: {custom_sites: ['https://a.b']}\n")
    policy = load_policy(path, min_fit_score=0)
    assert (policy.domains, policy.role_types, policy.expire_days, policy.min_fit_score) == (("nlp",), (), 3, 0.0)
    assert [s["name"] for s in enabled_sites(["https://a", {"url": "u", "enabled": False}])] == ["https://a"]


def test_penalties_lower_the_score(spark, raw):
    plain = {r.seq: r.fit_score for r in score(normalize(raw, P), P, AS_OF).collect()}
    soft = P.but(weights=type(P.weights)(german_penalty=0.0, exclude_penalty=0.0))
    free = {r.seq: r.fit_score for r in score(normalize(raw, P), soft, AS_OF).collect()}
    assert free[3] - plain[3] == pytest.approx(20) and free[2] - plain[2] == pytest.approx(15)


def test_breaker(spark):
    log = [("a", i, ok) for i, ok in enumerate([False, False, True, False])] + [
        ("b", i, ok) for i, ok in enumerate([False, False, False, True])]
    rows = spark.createDataFrame(log, "source string, n long, ok boolean")
    out = {(r.source, r.n): (r.streak, r.tripped) for r in
           failure_streaks(rows, "source", F.col("ok"), ["n"], F.floor(F.col("n") / 2)).collect()}
    assert [out["a", i] for i in range(4)] == [(1, False), (2, False), (0, False), (1, False)]
    assert [out["b", i] for i in range(4)] == [(1, False), (2, False), (3, True), (0, True)]


def test_old_layout_is_upgraded(spark):
    old = spark.createDataFrame(
        [("Old job", "https://example.com/old", 70.0, dt.date(2026, 1, 1))],
        "title string, url string, fit_score double, first_seen date",
    )
    row = hist.upgrade(old).first()
    assert (row.last_seen, row.status) == (dt.date(2026, 1, 1), "new")


def test_store_cycle(spark, raw, tmp_path):
    ranked = score(gate(normalize(raw, P), P, AS_OF), P, AS_OF)
    merged = hist.merge(hist.empty_history(spark), ranked, AS_OF)
    once = merged.drop("action")
    assert hist.counts(once, AS_OF).first().asDict() == {"total_open": 2, "new_today": 2}
    again = hist.merge(once, ranked, AS_OF)
    assert {r.action: r.n for r in hist.action_counts(again).collect()}["updated"] == 2
    assert sorted(again.drop("action").collect()) == sorted(once.collect())
    late = once.withColumn("last_seen", F.when(F.col("url").endswith("/4"), F.lit("2023-12-01").cast("date"))
                           .otherwise(F.col("last_seen")))
    assert hist.expire(late, 21, AS_OF).filter("status = 'expired'").count() == 1
    assert hist.expire(late, 0, AS_OF).filter("status = 'expired'").count() == 0
    reopened = hist.merge(hist.expire(late, 21, AS_OF), ranked, AS_OF)
    assert {r.action for r in reopened.collect()} == {"updated", "reopened"}
    everything, new = sheets(once, AS_OF)
    assert (everything.count(), new.count()) == (2, 2)
    with pytest.raises(Exception, match="unknown status"):
        changes = once.select("url", F.lit("gone").alias("status"))
        hist.set_status(once, changes).collect()


def test_handled_rows_are_left_alone(spark, raw):
    ranked = score(gate(normalize(raw, P), P, AS_OF), P, AS_OF)
    start = hist.merge(hist.empty_history(spark), ranked, AS_OF).drop("action")
    applied = hist.set_status(start, start.select("url", F.lit("applied").alias("status")))
    after = hist.merge(applied, ranked, "2024-03-01")
    assert {r.action for r in after.collect()} == {"skipped_handled"}
    assert {str(r.last_seen) for r in after.collect()} == {AS_OF}
    assert hist.prune(applied, 1, "2030-01-01").count() == 2


def test_keep_newest(spark):
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 4}") for i in range(8)], "n int, run_date string")
    assert {r.run_date for r in keep_newest(rows, 2).collect()} == {"2024-01-03", "2024-01-04"}
    assert keep_newest(rows, 0).count() == 8


def test_spread_is_the_middle_element(spark):
    for n in (1, 2, 3, 4, 5, 10, 11):
        rows = spark.createDataFrame([(float(i),) for i in range(n)], "fit_score double")
        assert spread(rows).first().median == sorted(range(n), reverse=True)[n // 2]


def test_daily_run_is_repeatable(spark, raw, tmp_path):
    store = SnapshotTable(spark, str(tmp_path / "history"))
    first = run(spark, P, [raw], store, AS_OF, 1)
    assert first.summary == {
        "run_date": AS_OF, "raw": 6, "normalized": 5, "deduped": 5, "filtered": 2, "ranked": 2, "inserted": 2,
        "updated": 0, "reopened": 0, "skipped_handled": 0, "expired": 0, "pruned": 0, "new_today": 2, "total_open": 2,
    }
    assert run(spark, P, [raw], store, AS_OF, 1).summary == first.summary
    nxt = run(spark, P, [raw], store, "2024-01-11", 2)
    assert (nxt.summary["updated"], nxt.summary["new_today"], store.versions()) == (2, 0, [1, 2])
    assert nxt.digest.first().headline == "No new matches today · 2 still open"
    gone = run(spark, P, [raw.limit(0)], store, "2024-09-01", 3)
    assert (gone.summary["expired"], gone.summary["pruned"], gone.summary["total_open"]) == (2, 2, 0)
    assert [f.name for f in HISTORY] == gone.history.columns
    assert raw.columns == [f.name for f in POSTING]


def test_daily_run_with_a_similarity(spark, raw, tmp_path):
    seen = lambda rows: rows.withColumn("sim", F.when(F.col("title").contains("Vision"), 0.6).otherwise(0.15))
    result = run(spark, P, [raw], SnapshotTable(spark, str(tmp_path / "h")), AS_OF, 1, similarity=seen)
    got = {r.title: (r.fit_score, r.fit_reason) for r in result.ranked.collect()}
    assert got["HiWi Computer Vision"][0] == 97.5 and "sim=0.60]" in got["HiWi Computer Vision"][1]
    assert got["Machine Learning Internship"][0] == 63.9


@pytest.mark.parametrize("cuts", [(), (3,), (1, 2, 4, 5)])
def test_micro_batches_equal_the_days_run(spark, raw, tmp_path, cuts):
    from postsieve.streaming.incremental import start_incremental

    edges = [-1, *cuts, 1 << 60]
    for low, high in zip(edges, edges[1:]):
        raw.filter((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = SnapshotTable(spark, str(tmp_path / "live"))
    policy = P.but(max_per_day=1)
    start_incremental(stream, policy, live, AS_OF, str(tmp_path / "checkpoint")).awaitTermination()
    batch = SnapshotTable(spark, str(tmp_path / "batch"))
    run(spark, policy, [raw], batch, AS_OF, 1)
    assert len(live.versions()) == 1
    assert sorted(live.read().collect()) == sorted(batch.read().collect()) != []


def test_batches_in_any_order_and_twice(spark, raw, tmp_path):
    """Later rows first, a batch run again over what a lost run left of it, an empty batch: the selection is that of
    the day as a whole."""
    from postsieve.plans.daily import rank
    from postsieve.streaming.incremental import add_batch

    again = raw.withColumn("seq", F.col("seq") + 100)  # every URL once more: first from these, then taken over
    folder, late = str(tmp_path / "day"), raw.filter("seq % 2 = 0")
    add_batch(again, P, AS_OF, folder, 0)
    add_batch(raw.filter("seq % 2 = 1").limit(1), P, AS_OF, folder, 1)
    add_batch(raw.filter("seq % 2 = 1"), P, AS_OF, folder, 1)
    add_batch(raw.limit(0), P, AS_OF, folder, 2)
    got = add_batch(late, P, AS_OF, folder, 3)
    want, counts = rank(normalize(raw.unionByName(again), P), P, AS_OF)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) != []
    assert spark.read.parquet(f"{folder}/state/snapshot=3").select("leader_seq").distinct().count() == counts["input"]


def test_publication_keeps_the_newest_dates(spark, raw, tmp_path):
    from postsieve.plans.publication import last_run, publish, run_log

    store, out = SnapshotTable(spark, str(tmp_path / "h")), str(tmp_path / "out")
    for version, day in enumerate((AS_OF, "2024-01-11", "2024-01-11", "2024-01-12"), start=1):
        publish(spark, run(spark, P, [raw], store, day, version), P.but(keep_exports=2), out)
    assert {str(r.run_date) for r in spark.read.parquet(f"{out}/sheets").select("run_date").distinct().collect()} == {"2024-01-11", "2024-01-12"}
    assert sorted(r.run_date for r in run_log(spark, out).collect()) == [AS_OF, "2024-01-11", "2024-01-12"]
    assert last_run(spark, out).first().run_date == "2024-01-12"
