"""The physical plans the operators are meant to get."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from catalog import inputs as I
from catalog import queries as Q
from postsieve.operators import gates, history, normalize, publish, score
from postsieve.plans import publication
from postsieve.plans.durable import SnapshotTable, ensure_checkpoint_dir
from postsieve.policy import Policy
from postsieve.schema import conform, pack_seq
from postsieve.sources import agency, listings, markup
from postsieve.streaming import streaks

SF = "/root/testdata/sf0.001"
P = Policy()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_wins_limits_ranks_before_the_shuffle(spark):
    text = plan(normalize.normalize(I.postings(spark, SF), P))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_dropoff_reads_no_unused_column(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = conform(docs.select(F.col("doc_id").alias("seq"), F.col("text").alias("title"), F.lit("").alias("role_type")))
    text = plan(gates.dropoff(rows, P, I.AS_OF))
    schema = text.split("ReadSchema: ")[1].split(">")[0]
    assert schema == "struct<text:string"
    assert "hashpartitioning" not in text


def test_selection_is_a_distributed_top_k(spark):
    text = plan(score.select_top(score.score(Q.detected(spark, SF), P, I.AS_OF), P))
    assert "TakeOrderedAndProject" in text or "GlobalLimit" in text or "CollectLimit" in text


def test_list_active_pushes_filters(spark, tmp_path):
    Q.first_history(spark, SF).write.parquet(str(tmp_path / "h"))
    rows = history.list_active(spark.read.parquet(str(tmp_path / "h")), language="en", min_score=30, limit=5)
    text = plan(rows)
    assert "PushedFilters" in text and "EqualTo(status,new)" in text and "GreaterThanOrEqual(fit_score,30.0)" in text
    assert "TakeOrderedAndProject" in text


def test_digest_limits_ranks_before_the_shuffle(spark):
    text = plan(publish.digest(Q.open_rows(spark, SF), P, I.AS_OF, by=["company"]))
    assert "WindowGroupLimit" in text


def test_title_hints_are_tested_before_the_lookup(spark):
    pages, details = I.view(spark, SF, I.AGENCY_PAGES), I.view(spark, SF, I.AGENCY_DETAILS)
    df = agency.agency_json(pages, details, P)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join LeftOuter") < text.index("praktikantin")


def test_order_key_rejects_what_it_cannot_hold(spark):
    assert spark.range(1).select(pack_seq(2, F.lit(3), F.lit(5))).first()[0] == (2 << 60) + (3 << 24) + 5
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(pack_seq(0, F.lit(1), F.lit(1 << 24))).collect()


def test_checkpoint_folder_is_the_shared_one(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_html_links(spark):
    html = """<div class=card><p>Student job <a href='go/1'>Please apply here</a><span class="firm big">Firm &amp; Co</span>
      <li>x<li><a href="https://o.org/x">Apply to this one now, dear</a> hiwi<script>ignored("hiwi")</script></div>
      <div><a href="/data-science/2"><b>Working</b> here</a><a href="javascript:go()">internship here</a><a>internship</a></div>"""
    pages = spark.createDataFrame([(1, "s", "https://a.org/d/", html)], "page_id long, site string, url string, html string")
    sites = listings.site_table(spark, P.but(sites=({"url": "u", "name": "s", "selectors": {"company": "span.firm"}},)))
    rows = {r.url: r for r in listings.page_links(pages, sites).collect()}
    assert set(rows) == {"https://a.org/d/go/1", "https://o.org/x", "https://a.org/data-science/2"}
    # A short text gives way to that of its card.
    assert rows["https://a.org/data-science/2"].title == "Working here internship here internship"
    first = rows["https://a.org/d/go/1"]
    assert first.title.startswith("Student job Please apply here Firm & Co") and first.company == "Firm & Co"
    assert rows["https://o.org/x"].title == "Apply to this one now, dear"


#: Pages, and what the links of each are: title, link, company, place.
CARDS = (
    ("<li><a href=/1>Apply here now</a><div>data science role</div></li>", [("Apply here now data science role", "https://a.org/1", "", "")]),
    ('<a title="a>b" href=/2>Machine learning internship</a>', [("Machine learning internship", "https://a.org/2", "", "")]),
    ("<li><a href=/3>Praktikum in Bonn</a><div class='x firm'>Firm <b>A</b></div></li>", [("Praktikum in Bonn", "https://a.org/3", "Firm A", "")]),
    ("<div><p><a href=/4>Praktikum in Bonn</a></p><div class=firm>Not in the parent</div></div>", [("Praktikum in Bonn", "https://a.org/4", "", "")]),
    ("<div><a href=/5>K&uuml;nstliche Dinge</a> &#72;iwi, <i id=city>K&ouml;ln &amp;c</i></div>", [("Künstliche Dinge Hiwi, Köln &c", "https://a.org/5", "", "Köln &c")]),
    ("<div>hiwi<div><a href=/6>Far from hints</a></div></div>", []),
    ("<div>work<div><a href=/7>A position</a></div>ing student</div>", []),
    ("<table><tr><td><a href=../8/./x>Apply now</a><td>shk<tr><td><a href=/9>Apply now</a></table>", [("Apply now shk", "https://a.org/8/x", "", "")]),
    ("<div><!-- hiwi --><script>hiwi()</script><style>hiwi</style><a href=/10>Not for you</a></b></div>", []),
    ("<div><a href=/11 HREF=/12>Trainee<br>wanted</a><a href='http://[x'>Trainee wanted</a></div>", [("Trainee wanted", "https://a.org/11", "", "")]),
    ("<ul><li><b>hiwi<li><a href=/13>Some position</a></ul>", []),
    ("<p>shk<div><a href=/14>Some position</a> a</div>", []),
    ("<div><span><a href=/15>One position</span> <i>hiwi</i></div>", [("One position hiwi", "https://a.org/15", "", "")]),
    ("", []), ("no tags < at & all", []),
)


def test_cards_around_links(spark):
    pages = spark.createDataFrame([(i, "s", "https://a.org/d/", html) for i, (html, _) in enumerate(CARDS)], "page_id long, site string, url string, html string")
    sites = listings.site_table(spark, P.but(sites=({"url": "u", "name": "s", "selectors": {"company": "li > .firm, p .firm", "location": "#city"}},)))
    got = {}
    for r in sorted(listings.page_links(pages.repartition(3), sites).collect(), key=lambda r: (r.page_id, r.pos)):
        got.setdefault(r.page_id, []).append((r.title, r.url, r.company, r.location))
    assert [got.get(i, []) for i in range(len(CARDS))] == [want for _, want in CARDS]


def test_selectors():
    page = markup.Page('<div id=a class="x y"><p data-k="v w"><b>1</b></p><b class=x>2</b></div><b>3</b>')
    taken = lambda s: [page.text(e) for e in page.fitting(markup.selector(s))]
    assert taken("b") == ["1", "2", "3"] and taken("div b") == ["1", "2"] and taken("div > b") == ["2"]
    assert taken(".x.y b.x, p") == ["1", "2"] and taken("#a [data-k='v w'] > *") == ["1"] and taken("[DATA-k]") == ["1"]
    assert taken("section b") == []
    for bad in ("", "a:hover", "a + b", "a,,b", "> a", "a >"):
        with pytest.raises(ValueError, match="selector"):
            markup.selector(bad)


def test_hits_inside_elements_equal_a_search():
    r = random.Random(1)
    hint = re.compile(r"data\s*science|working\s*student|student\s*job|\bki\b|a+b", re.I)
    for _ in range(300):
        html = "".join(r.choice(["<div>", "</div>", "<p>", "<b>", "</b>", "data ", "Science", "working", " student ", "job", "ki", "aab", " x "]) for _ in range(40))
        page = markup.Page(html)
        hits = markup.Hits(page, hint)
        assert [hits.inside(e) for e in range(len(page.names))] == [hint.search(page.text(e)) is not None for e in range(len(page.names))]
        assert all(page.first[e] <= page.end[e] and page.last[e] >= e for e in range(len(page.names)))


def test_nested_pages_take_linear_time():
    hint = re.compile(listings.ROLE_HINT, re.I)
    sought = listings._Sought(None, "div.firm", None)

    def seconds(n):
        html = "".join(f"<div><div class=firm>f{i}</div><a href=/p/{i}>Nothing of note {i}</a></b>" for i in range(n))
        start = time.process_time()
        assert sum(1 for _ in listings.page_rows(html, "https://a.org", sought, hint)) == n
        return time.process_time() - start

    few = min(seconds(2000) for _ in range(3))
    assert seconds(32_000) < 16 * 4 * few


def test_odd_pages_take_linear_time(spark):
    flat = "".join(f'<a href="/jobs/{i}">Working student {i}</a>' for i in range(2000))
    deep = "<div>" * 1200 + '<a href="?p=1">internship here now<a class=x href=b/c>internship unclosed' + "</div>" * 1200
    pages = spark.createDataFrame([(1, "s", "https://a.org/d/e?q#f", flat), (2, "s", "https://a.org", deep), (3, "s", "https://a.org", None)],
                                  "page_id long, site string, url string, html string")
    rows = listings.page_links(pages, listings.site_table(spark, P.but(sites=({"url": "u", "name": "s", "selectors": {"company": "b"}},)))).collect()
    assert [r.pos for r in sorted(rows, key=lambda r: (r.page_id, r.pos))] == [*range(2000), 0, 1]
    assert {r.url for r in rows if r.page_id == 2} == {"https://a.org?p=1", "https://a.org/b/c"}
    kept = listings.site_table(spark, P.but(sites=({"url": "u", "name": "s", "selectors": {"job_link": "a.x"}},)))
    assert {r.url for r in listings.page_links(pages, kept).collect()} == {"https://a.org/b/c"}


def test_dates_written_per_run(spark, tmp_path):
    rows = Q.open_rows(spark, SF)
    out = str(tmp_path / "sheets")
    publish.write_sheets(rows, I.AS_OF, out)
    publish.write_sheets(rows.limit(3), "2024-01-11", out)
    got = {(r.run_date, r.sheet): r["count"] for r in spark.read.parquet(out).groupBy("run_date", "sheet").count().collect()}
    assert got[dt.date(2024, 1, 10), "All Open"] == 200 and got[dt.date(2024, 1, 11), "All Open"] == 3


def test_streaks_scan_the_log_once(spark):
    log = Q._log(spark, SF)
    rows = streaks.failure_streaks(log, "user_id", F.col("ok"), ("ts", "event_id"), F.date_trunc("hour", F.col("ts")))
    assert not any("events.parquet" in f for f in rows.inputFiles())


def test_old_copies_are_removed(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), keep=2)
    for version in (1, 2, 3, 4):
        table.write(spark.range(version), version)
    assert table.versions() == [3, 4] and table.read(before=4).count() == 3
    table.write(spark.range(7), 4)
    assert table.versions() == [3, 4] and table.read().count() == 7


def test_a_clustered_history_is_read_in_part(spark, tmp_path):
    rows = spark.range(8000).select(
        F.concat(F.lit("u"), "id").alias("url"), (F.col("id") * 37 % 1000 / 10).alias("fit_score"),
        F.when(F.col("id") % 5 == 0, "expired").otherwise("new").alias("status"),
        *[F.lit("").alias(c) for c in ("source", "location")])
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "10"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        stored = SnapshotTable(spark, str(tmp_path / "h"), partition_by=("status",), range_by=("fit_score",)).write(rows, 1)
        # With a limit the rows are read once; a full sort samples them first, in a pass of its own.
        listed = history.list_active(stored, min_score=80, limit=5000, as_of="2024-01-11")
        got = sorted(r.url for r in listed.collect())
        plan = listed._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().head()
        read = scan.metrics().apply("numOutputRows").value()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(r.url for r in rows.filter("status = 'new' and fit_score >= 80").collect())
    assert "PartitionFilters: [isnotnull(status#" in plan.toString()
    assert len(got) <= read <= 8000 // 2
    assert sorted(stored.select(rows.columns).collect()) == sorted(rows.collect())


def test_recheck_of_a_store(spark, tmp_path):
    store = SnapshotTable(spark, str(tmp_path / "h"))
    with pytest.raises(ValueError):
        publication.recheck_store(spark, P, store, "2024-01-12", 2)
    store.write(Q.recheck_base(spark, SF), 1)
    dry = publication.recheck_store(spark, P, store, "2024-01-12", 2, str(tmp_path / "out"), dry_run=True)
    assert store.versions() == [1] and not (tmp_path / "out").exists()
    wet = publication.recheck_store(spark, P, store, "2024-01-12", 2, str(tmp_path / "out"))
    assert store.versions() == [1, 2] and sorted(dry.collect()) == sorted(wet.collect())
    dismissed = store.read().filter("status = 'dismissed'").count()
    assert dismissed == wet.count() > 0
