"""Operators against plain models on random input."""

import random
import re
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from postsieve.functions import similarity as sim
from postsieve.functions.fields import canonical_url
from postsieve.functions.numbers import round_tenth, whole_text
from postsieve.functions import text
from postsieve.functions.text import quote_around
from postsieve.operators import dedup
from postsieve.operators.normalize import normalize
from postsieve.operators.score import select_top
from postsieve.plans.durable import cut
from postsieve.policy import Policy
from postsieve.schema import conform
from postsieve.streaming import streaks

WORDS = "data science intern machine learning berlin team python lab gmbh werkstudent ml ai köln remote".split()


KEYWORDS = ("ai", "machine learning", "data", "data science", "c++", "c", "5+ years", "e-mail", "künstliche intelligenz", "straße", "résumé", "ki",
            "ML", "-x-", "+", "is sk", "a_b", "größe", " ", "")
PIECES = ("ai", "AI", "machine", "Learning", "data", "science", "c", "C++", "+", "5+", "5", "years", "e", "mail", "KÜNSTLICHE", "intelligenz", "stra\u00dfe", "STRASSE",
          "stra\u1e9ee", "r\u00e9sum\u00e9", "re\u0301sume\u0301", "k\u0131", "\u212aI", "K\u0130", "i\u017f", "\u017f\u212a", "is", "sk", "ml", "x", "a_b", "a", "b", "gr\u00f6\u00dfe",
          "GRO\u0308SSE", "\ufb01", "\u0301", "\u200d", "7")
GAPS = (" ", " ", "  ", "-", "_", "/", "\n", "\x1c", "\u00a0", ".", "", "\u2013", " - ", "\u2028")


def test_words_looked_up_equal_a_scan_per_keyword(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) + rng.choice(GAPS) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [None, "", "_ai_ data"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    scans = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k in KEYWORDS if (p := text.keywords_pattern([k]))]))
    words = text.words_present(t, KEYWORDS)
    got = rows.withColumn("w", words).select("t", "w", scans.alias("want"), text.matched(t, KEYWORDS).alias("got"), text.matched(t, KEYWORDS, F.col("w")).alias("known"),
                      text.any_match(t, KEYWORDS).alias("any"), text.any_match(t, KEYWORDS, F.col("w")).alias("any_known")).collect()
    assert sum(len(r.want or ()) for r in got) > 1000
    for r in got:
        assert r.got == r.known == (r.want or []), r
        assert r.any == r.any_known == bool(r.want), r


def typo(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice("aeinrst") + word[i:], word])


def postings(rng, n, companies):
    rows = []
    for seq in range(n):
        if rows and rng.random() < 0.5:
            _, company, title, place = rng.choice(rows)
            title = " ".join(typo(rng, w) or "x" if rng.random() < 0.3 else w for w in title.split())
        else:
            company, place = rng.choice(companies), rng.choice(["Berlin", "Köln", "Remote Germany"])
            title = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 8)))
        rows.append((seq, company, title, place))
    return rows


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(x, y):
    a, b = set(x.split()), set(y.split())
    if not a or not b:
        return 0.0
    s, p, q = (" ".join(sorted(z)) for z in (a & b, a - b, b - a))
    if s and (not p or not q):
        return 100.0
    gap = bool(s)
    wa, wb = len(s) + gap + len(p), len(s) + gap + len(q)
    forms = [100 - 100 * (len(p) + len(q) - 2 * lcs(p, q)) / (wa + wb)]
    if s:
        forms += [100 - 100 * (1 + len(p)) / (len(s) + wa), 100 - 100 * (1 + len(q)) / (len(s) + wb)]
    return max(forms)


def block(company):
    plain = re.sub(r"[^a-z0-9 ]+", "", company.lower()).strip()
    return plain.split(" ")[0][:6] if plain else ""


def sequential_leaders(rows, threshold=90):
    groups, out = {}, {}
    for seq, company, title, place in sorted(rows):
        text = f"{company} | {title} | {place}".lower().strip()
        for lead, lead_text in groups.setdefault(block(company), []):
            if ratio(text, lead_text) >= threshold:
                out[seq] = lead
                break
        else:
            groups[block(company)].append((seq, text))
            out[seq] = seq
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, company string, title string, location string")


@pytest.mark.parametrize("seed,batch,whole_lists,threshold", [(1, 4096, True, 90), (2, 16, True, 90), (3, 24, False, 80)])
def test_leaders_equal_the_sequential_rule(spark, monkeypatch, seed, batch, whole_lists, threshold):
    rows = postings(random.Random(seed), 220, ["Acme GmbH", "Acme AG", "", "Unknown", "Ünder & Co"])
    if not whole_lists:
        monkeypatch.setattr(dedup, "_TILE_ROWS", 20)
        monkeypatch.setattr(dedup, "_LEAST_COUNTED", 4)
    got = dict(dedup.leaders(frame(spark, rows), threshold, first_batch=batch).collect())
    assert got == sequential_leaders(rows, threshold)


def test_leaders_after_changes_equal_the_sequential_rule(spark):
    """Rows come in any order, and some that were there go: each time the leaders are those of all rows there are."""
    rng = random.Random(37)
    rows = postings(rng, 150, ["Acme GmbH", "Beta", ""])
    rng.shuffle(rows)
    there, led = [], None
    for came, gone in ((rows[:70], []), (rows[70:110], rng.sample(rows[:70], 6)), ([], rows[100:103]), (rows[110:], [])):
        there = [r for r in there if r not in gone] + came
        fresh = dedup.keyed(frame(spark, came).withColumns({"description": F.lit(""), "posted_date": F.lit("")}))
        fresh = fresh.select("seq", "block", "words", F.lit(None).cast("bigint").alias("leader_seq"))
        lost = frame(spark, gone).select("seq")
        left = fresh if led is None else led.join(lost, "seq", "left_anti").unionByName(fresh)
        changed = fresh.select("block", "seq")
        if led is not None:
            changed = changed.unionByName(led.join(lost, "seq").select("block", "seq"))
        led = cut(dedup.relead(left, changed, first_batch=16))
        assert {r.seq: r.leader_seq for r in led.collect()} == sequential_leaders(there)


def test_one_block_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(dedup, "_PART_ROWS", 50)
    rows = [(i, "Unknown", f"machine learning internship in the data team number {i}", "Berlin") for i in range(400)]
    rows += [(1000 + i, "Unknown", "machine learning internship in the data team number 7", "Berlin") for i in range(300)]
    got = dict(dedup.leaders(frame(spark, rows), first_batch=32).collect())
    assert got == sequential_leaders(rows) and len(got) == 700


def test_bounds_never_drop_a_similar_pair(spark):
    rng = random.Random(5)
    rows = postings(rng, 90, ["Acme"])
    recs = dedup._features(dedup.records(frame(spark, rows)))
    pairs = recs.alias("a").join(recs.alias("b"), F.col("a.id") < F.col("b.id")).select(
        F.col("a.text").alias("x"), F.col("b.text").alias("y"),
        *[sim.may_be_similar("a", "b", t).alias(f"m{t}") for t in (70, 90)],
        sim.token_set_ratio("a.text", "b.text").alias("r"),
    ).collect()
    assert len(pairs) > 1000
    for p in pairs:
        assert p.r == pytest.approx(ratio(p.x, p.y))
        assert p.m90 or p.r < 90
        assert p.m70 or p.r < 70
    assert sum(p.m90 for p in pairs) < len(pairs) / 2


@pytest.mark.parametrize("threshold", [0, 70, 90, 100])
def test_the_index_finds_every_similar_pair(spark, monkeypatch, threshold):
    monkeypatch.setattr(dedup, "_TILE_ROWS", 7)
    monkeypatch.setattr(dedup, "_LEAST_COUNTED", 3)
    rng = random.Random(11)
    words = ["data", "Daten", "engineer", "intern", "müller", "ab", "x", "learning", "日本", "python"]
    rows = [(i, "Acme", " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 9, 30]))) + rng.choice(["", "s", " 42"]), None)
            for i in range(120)]
    recs = dedup.records(frame(spark, rows))
    found = dedup._features(recs, threshold)
    texts = {r.id: r.text for r in found.collect()}
    got = {tuple(r) for r in dedup._similar(found, found, threshold, 120, ordered=True).collect()}
    want = {(a, b) for a in texts for b in texts if a < b and ratio(texts[a], texts[b]) >= threshold}
    assert got == want


def test_common_lengths_of_many_pairs():
    rng = random.Random(3)
    for signs in ("ab", "abcdefgh ", "äöüß𝒳😀日本 é"):
        text = lambda: "".join(rng.choices(signs, k=rng.choice([0, 1, 5, 63, 64, 65, 128, 129, 200, 1024, 1030])))  # noqa: B023, E731
        left, right = [text() for _ in range(60)], [text() for _ in range(60)]
        assert sim.common_lengths(left, right).tolist() == [sim.common_length(a, b) for a, b in zip(left, right)]
    assert sim.common_lengths([], []).tolist() == [] and sim.ratios(["", "a"], ["a", "a b"]).tolist() == [0.0, 100.0]


def test_common_length():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 25))) for _ in range(2))
        assert sim.common_length(a, b) == lcs(a, b)


def test_selection_equals_the_two_step_rule(spark):
    rng = random.Random(11)
    rows, expected = [], set()
    policy = Policy(min_fit_score=60.0, max_per_day=4, min_results=6, floor_fit_score=30.0)
    for key in range(60):
        scores = [(float(rng.choice(range(0, 100, 10))), seq) for seq in range(rng.randint(0, 12))]
        rows += [(key, seq, s) for s, seq in scores]
        order = sorted(scores, key=lambda x: -x[0])
        final = [x for x in order if x[0] >= 60][:4]
        if len(final) < 6:
            final += [x for x in order if x not in final and x[0] >= 30][: 6 - len(final)]
        expected |= {(key, seq) for _, seq in final}
    df = spark.createDataFrame(rows, "key int, seq long, fit_score double")
    assert {(r.key, r.seq) for r in select_top(df, policy, by=["key"]).collect()} == expected
    one = df.filter("key = 3")
    assert {(r.key, r.seq) for r in select_top(one, policy).collect()} == {e for e in expected if e[0] == 3}


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(13)
    values = [k / 20 for k in range(0, 2001)] + [rng.random() * 100 for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_tenth(F.col("v")).alias("r"))
    assert all(r.r == round(r.v, 1) for r in rows.collect())
    halves = spark.createDataFrame([(k / 2,) for k in range(50)], "v double")
    assert all(r.t == f"{r.v:.0f}" for r in halves.select("v", whole_text(F.col("v")).alias("t")).collect())


TRACK = re.compile(
    r"^(utm_\w+|gclid|fbclid|msclkid|mc_[ce]id|ref|referrer|source|src|campaign|trk|trkCampaign|origin|from|sessionid|_ga)$",
    re.I,
)


def canonical(url):
    p = urlparse(url.strip())
    if not p.scheme or not p.netloc:
        return url.strip()
    kept = [(k, v) for k, v in parse_qsl(p.query) if not TRACK.match(k)]
    return urlunparse((p.scheme.lower(), p.netloc.lower().removeprefix("www."), p.path.rstrip("/") or "/", p.params,
                       urlencode(kept), ""))


def test_canonical_url_equals_urllib(spark):
    rng = random.Random(17)
    parts = ["a", "b=1", "ref=x", "k=%C3%A4", "k=a+b", "q=*~", "e=", "UTM_Source=1", "x=1=2", "n=ä ö", "z=%2", "p=%zz%41", "=v"]
    urls = [
        rng.choice(["https", "HTTP", "ftp", "weird+x"]) + "://" + rng.choice(["www.A.com", "b.de:80", "u@c.org"])
        + rng.choice(["", "/", "/x/y//", "/p;v=1", "/p/;v"]) + rng.choice(["", "?"]) + "&".join(rng.sample(parts, rng.randint(0, 4)))
        + rng.choice(["", "#f?x"])
        for _ in range(400)
    ] + ["mailto:a@b", "//host/x", "plain", "http:///x"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", canonical_url(F.col("u")).alias("c"))
    for r in rows.collect():
        assert r.c == canonical(r.u), r.u


def test_quotes_equal_slicing(spark):
    rng = random.Random(19)
    texts = [
        "".join(rng.choice(["ai", "a", "i", " ", "-", "\n", "ä", "🆕", "mail", "AI "]) for _ in range(rng.randint(0, 40)))
        for _ in range(300)
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quote_around(F.col("t"), "ai", 6).alias("q"))
    for r in rows.collect():
        m = re.search(r"\bai\b", r.t, re.I)
        want = " ".join(r.t[max(0, m.start() - 6): m.end() + 6].split()) if m else ""
        assert r.q == want, repr(r.t)


@pytest.mark.parametrize("chunk", [1, 3, 1000, None])
def test_streaks_equal_a_loop(spark, chunk):
    rng = random.Random(23)
    # Source 0 holds most of the log.
    log = [(0 if rng.random() < 0.7 else rng.randint(1, 5), n, rng.random() < 0.45) for n in range(400)]
    want, count, tripped = {}, {}, set()
    for source, n, ok in log:
        count[source] = 0 if ok else count.get(source, 0) + 1
        if count[source] >= 4:
            tripped.add(source)
        want[n] = (count[source], source in tripped)
    schema = "source int, n long, ok boolean"
    df = spark.createDataFrame(log, schema)
    args = ("source", F.col("ok"), ["n"], None if chunk is None else F.floor(F.col("n") / chunk), 4)
    got = {r.n: (r.streak, r.tripped) for r in streaks.failure_streaks(df, *args).collect()}
    assert got == want
    # The same log in two parts, with the state handed over.
    first, second = df.filter("n < 150"), df.filter("n >= 150")
    state = streaks.end_state(first, *args)
    got = {r.n: (r.streak, r.tripped) for r in streaks.failure_streaks(second, *args, state=state).collect()}
    assert got == {n: v for n, v in want.items() if n >= 150}
    end = {r.source: (r.streak, r.tripped) for r in streaks.end_state(second, *args, state=state).collect()}
    assert end == {s: (count[s], s in tripped) for s in count}


def test_a_hot_source_is_spread_over_ranges(spark):
    """One source, without a name, has most rows, all at one time; ranges cut it, and small batches cut ranges."""
    rng = random.Random(41)
    log = [(None if rng.random() < 0.8 else rng.choice(["a", "ä"]), 7, n, None if rng.random() < 0.1 else rng.random() < 0.3)
           for n in range(3000)]
    want, count, tripped = {}, {}, set()
    for source, _, n, ok in log:
        count[source] = 0 if ok else count.get(source, 0) + 1
        if count[source] >= 9:
            tripped.add(source)
        want[n] = (count[source], source in tripped)
    df = spark.createDataFrame(log, "source string, hour int, n long, ok boolean")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        scanned = streaks._scanned_ranges(df, "source", F.col("ok"), ["hour", "n"])
        hot = scanned.filter("source is null").groupBy("_chunk").count().collect()
        got = {r.n: (r.streak, r.tripped) for r in streaks.failure_streaks(df, "source", F.col("ok"), ["hour", "n"], threshold=9).collect()}
        end = {r.source: (r.streak, r.tripped) for r in streaks.end_state(df, "source", F.col("ok"), ["hour", "n"], threshold=9).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(hot) > 4 and max(r["count"] for r in hot) < 3000 / 4
    assert got == want and end == {s: (count[s], s in tripped) for s in count}
    assert streaks.failure_streaks(df.limit(0), "source", F.col("ok"), ["hour", "n"]).count() == 0


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(29)
    rows = [(s, c, t, p, "test", f"https://x.org/{s % 40}?ref=1", "text and team " * (s % 3), "2024-01-09")
            for s, c, t, p in postings(rng, 120, ["Acme", "Beta"])]
    df = conform(spark.createDataFrame(
        rows, "seq long, company string, title string, location string, source string, url string, "
        "description string, posted_date string"))
    results = []
    for parts in (1, 17):
        kept = dedup.fuzzy_dedup(normalize(df.repartition(parts), Policy()))
        results.append(sorted(kept.select("seq", "url", "title", "language").collect()))
    assert results[0] == results[1]
