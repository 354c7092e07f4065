"""The operators for training data against brute force, round trips and held-out rows, with every odd case."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from postsieve.llm import decontam, exact, graph, language, mixing, pii, scoring, simhash, templates, tokens, warc
from postsieve.llm.common import new_folder
from postsieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("word_bpe_49k.json")
#: doc_id, text, lang, source, n_chars, and columns whose names the operators use inside.
KIND = ("doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row int, fp string, hash int, "
        "size double, target string, dropped int, copies string, row_key string, held_out int, lines string")
EXTRA = ("k", 1, "f", 2, 3.0, "t", 4, "c", "r", 5, "l")
LONG = "the quick brown fox jumps over lazy dogs " * 20_000
TEXTS = [
    (1, "Hello there my friend, how are you\nAll rights reserved now", "en", "b"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n ", None, "a"),
    (None, "no id at all here", "en", "b"), (None, "no id at all here", "en", "b"), (5, "Hello there my friend, how are you\nAll rights reserved now", "en", "b"),
    (5, "Hello there my friend, how are you\nAll rights reserved now", "en", "b"), (6, "12345 !!!", "de", "c"), (7, LONG, "en", "c"),
    (8, "one", "fr", "é"), (9, "one two", "fr", "z"), (10, "mail a.b@c.example.com or +1 (743) 555-3824", "en", "Z"), (-4, "ÉTÉ \U0001f600 <|endoftext|>", "fr", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*x[:4], len(x[1] or ""), *EXTRA) for x in TEXTS], KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 1: near duplicates


def brute_fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    shingles = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(rows, radius=3):
    """Smallest id reachable for each (id, fingerprint)."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    best = {}
    for d, f in rows:
        if d is not None:
            best[find(f)] = min(best.get(find(f), d), d)
    return sorted(((d, f"{f:016x}", best.get(find(f))) for d, f in rows), key=repr)


def test_simhash_equals_brute_force(docs, odd, none):
    for df in (docs.select("doc_id", "text"), odd):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
        assert listed(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == brute_components(rows)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).columns == none.columns


def test_one_of_each_component_stays(odd):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    # 2, 3 and 4 have fingerprint zero; 5 repeats 1; of the rows without an id one stays
    assert sorted(ids, key=repr) == sorted([1, 2, None, 6, 7, 8, 9, 10, -4], key=repr)


def _cloud(seed, n):
    r = random.Random(seed)
    points = {r.getrandbits(64) for _ in range(n // 4)}
    for p in list(points):
        for _ in range(r.choice((0, 2, 6))):
            for _ in range(r.randint(1, 4)):
                p ^= 1 << r.randrange(64)
            points.add(p)
    return np.array(sorted(points), np.uint64)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("radius", (0, 1, 3, 8))
def test_tree_search_is_complete(seed, radius):
    points = _cloud(seed, 300)
    queries = points[::3] ^ np.uint64(5)
    query, node = simhash.BKTree(points).search(queries, radius)
    a, b = np.nonzero(np.bitwise_count(queries[:, None] ^ points[None]) <= radius)
    assert sorted(zip(query.tolist(), node.tolist())) == sorted(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("radius", (1, 3))
def test_bands_meet(radius):
    masks = simhash.band_masks(radius)
    r = random.Random(1)
    for _ in range(500):
        bits = sum(1 << b for b in r.sample(range(64), radius))
        assert any(bits & m == 0 for m in (m & (1 << 64) - 1 for m in masks))


def test_crowded_shards_keep_every_link(spark, monkeypatch):
    """All points share their upper half, so shards exceed the tree size and are divided."""
    monkeypatch.setattr(simhash, "TREE_NODES", 16)
    r = random.Random(2)
    points = {0}
    while len(points) < 300:
        p = r.choice(list(points))
        points.add(p ^ 1 << r.randrange(24) ^ 1 << r.randrange(24))
    rows = [(i, p) for i, p in enumerate(sorted(points))]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for _, p in rows], "fp bigint"))
    assert all((a ^ b).bit_count() >= 1 for a, b in links.collect())
    roots = dict(map(tuple, graph.components(links).collect()))
    want = {f: c for _, f, c in brute_components(rows)}
    got = defaultdict(set)
    for i, p in rows:
        got[roots.get(p, p)].add(i)
    assert {f"{p:016x}": min(got[roots.get(p, p)]) for _, p in rows} == want


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert all(found[i] == 0 for i in range(1, 41)) and all(found[i] == 100 for i in range(101, 160)) and found[201] == found[202] == 200
    assert 300 not in found


# 2: personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])

    def checks(number):
        total = 0
        for i, c in enumerate(number[::-1]):
            v = int(c) * (1 + i % 2)
            total += v // 10 + v % 10
        return total % 10 == 0

    return (
        [(0, *m.span()) for m in EMAIL.finditer(text)]
        + [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        + [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and checks(digits(m))]
        + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    )


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="ab@@..-1239+() %é255", max_size=60) | st.text(alphabet="0123456789 -.+", max_size=80))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text, pii.stretches(text)) == brute_spans(text)


def test_scan_is_linear():
    start = time.perf_counter()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1 " * 130_000, "a@" * 200_000, "1 2" * 130_000, "(" * 300_000, "a(at)" * 60_000):
        pii.scan(text)
    assert time.perf_counter() - start < 60


def test_spans_and_additions(spark, odd, none):
    card = "4465758382889437"
    rows = [(i, f"word {i % 7} mail u{i}@host{i % 5}.example.com and {card} then +1 (743) 555-{3000 + i} x") for i in range(60)]
    rows += [(100 + i, f"order {1000000000000000 + i * 7} at me@host nr 999.{i}.1.1") for i in range(60)]
    rows += [(300, f"pay {card} {card} now"), (301, "clean prose without a number")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.summary(df).collect()}
    names = ("email", "ip", "card", "phone")
    for doc_id, text in rows:
        base = brute_spans(text)
        line = ",".join(f"{names[k]}:{a}:{z}" for k, a, z in base)
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in base) for i in range(4)]
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert {f"{names[k]}:{a}:{z}" for k, a, z in base} <= set(r.spans.split(",")) | {""}
        places = sorted((int(a), int(z)) for _, a, z in spans)
        extra = len(spans) - len(base)
        assert extra == r.n_added
        if extra:
            assert all(z <= a for (_, z), (a, _) in zip(places, places[1:]))
    assert got[301].spans == ""
    assert got[300].n_card == 0 and got[300].spans == "card:4:20,card:21:37"  # two numbers in one run
    assert pii.summary(odd).count() == len(TEXTS) and pii.summary(none).count() == 0
    assert {r.spans for r in pii.summary(odd.where("doc_id = 10")).collect()} == {"email:5:22,phone:26:43"}


# 3: language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 50").collect()
    assert len(found) > 150 and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


def test_language_cases(spark, docs, odd, none):
    model = language.train(docs)
    assert model.languages == ("de", "en", "es", "fr")
    got = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 6))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[7].lang_pred in model.languages
    assert got[10].held_out == (zlib.crc32(b"10") % 5 == 0)
    by = {lang: [r.text for r in docs.where(f"lang = '{lang}' and n_chars > 3000").limit(2).collect()] for lang in ("de", "fr")}
    mixed = by["de"][0][:1500] + " " + by["fr"][0][:1500]
    (lang, score, chosen), = language.infer([mixed], model)
    assert {n for n, _ in chosen} == {"de", "fr"} and 0.3 < score < 0.7 and lang in ("de", "fr")
    assert [n for n, _ in language.infer([by["de"][0]], model)[0][2]] == ["de"]
    assert language.predict(none, model).count() == 0 and language.identify(none).count() == 0
    empty = language.train(none)
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}
    kept = language.accept(odd, model)
    assert kept.columns == odd.columns and not {2, 3, 4, 6} & {r.doc_id for r in kept.collect()}


def test_a_text_of_six_languages_has_six():
    """The penalised likelihood alone ends the search."""
    r = random.Random(2)
    alphabets = ["abcdef", "ghijkl", "mnopqr", "stuvwx", "yzäöüß", "éèêçñó", "àâîôûë"]
    said = [" ".join("".join(r.choice(a) for _ in range(r.randint(3, 7))) for _ in range(400)) for a in alphabets]
    counts = np.stack([language.gram_counts(t) + language.SMOOTHING for t in said], 1)
    model = language.Model(tuple("abcdefg"), np.log(counts / counts.sum(0)).astype(np.float32))
    for n in (1, 3, 6):
        (_, _, chosen), = language.infer([" ".join(t[:600] for t in said[:n])], model)
        assert sorted(name for name, _ in chosen) == list("abcdefg"[:n])
        assert all(abs(part - 1 / n) < 0.05 for _, part in chosen)



def test_repeated_rows_and_order_do_not_matter(docs):
    model = language.train(docs)
    texts = [r.text for r in docs.limit(30).collect()]
    one = [language.infer([t], model)[0] for t in texts]
    many = language.infer(texts, model)
    assert [x[0] for x in one] == [x[0] for x in many]
    assert max(abs(x[1] - y[1]) for x, y in zip(one, many)) < 1e-3


# 4: exact duplicates


def test_exact_groups(odd, none):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    for keep, best in (("largest", max), ("smallest", min)):
        groups = defaultdict(list)
        for d, t in rows:
            groups[t].append(d)
        want = []
        for d, t in rows:
            stays = best((x for x in groups[t] if x is not None), default=None)
            want.append((d, stays, len(groups[t]), d == stays, hashlib.sha256(t.encode()).hexdigest()))
        got = exact.exact_groups(odd, keep=keep)
        assert listed(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact.exact_groups(none).count() == 0


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "_hash", lambda column: exact.F.unhex(exact.F.lit("00")))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    assert listed(exact.exact_groups(df), "doc_id", "keep_id", "group_size") == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]
    monkeypatch.setattr(exact, "_digest", lambda column: exact.F.unhex(exact.F.lit("00")))
    with pytest.raises(Exception, match="share both digests"):
        exact.exact_groups(df).collect()


# 5: benchmark


def brute_edits(pattern, text):
    """Least edits between the pattern and any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        step = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        new = np.append(i, step)
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def edited(text, edits, r):
    text = list(text)
    for _ in range(edits):
        at, how = r.randrange(len(text)), r.randrange(3)
        if how == 0:
            text[at] = "q"
        elif how == 1:
            del text[at]
        else:
            text.insert(at, "x")
    return "".join(text)


def test_search_equals_alignment(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, prose(r.choice((9, 14, 40)))) for i in range(12)]
    texts = [prose(60) + " " + edited(items[i % 12][1], r.choice((0, 2, 6, 12, 25)), r).upper() + "!! " + prose(30) for i in range(60)]
    texts += [prose(200), "", None, items[0][1], items[1][1][:70]]
    by = decontam.Windows.of(items)
    got = {(row, window) for row, window, *_ in decontam.search(texts, by)}
    want = set()
    for row, text in enumerate(texts):
        codes = decontam.normalised(text) if text else np.empty(0, np.uint32)
        for w in range(len(by.items)):
            if len(codes) and brute_edits(by.codes[w][:by.sizes[w]], codes) <= by.edits[w]:
                want.add((row, w))
    assert got == want and len(got) > 40


def test_contamination_cases(spark, docs, odd, none):
    bench = spark.createDataFrame([(1, "my friend how are you all rights reserved now"), (2, "short"), (3, None), (None, LONG[:300])], "item_id bigint, text string")
    found = listed(decontam.contaminated(odd, bench), "doc_id", "item_id")
    assert found == sorted([(1, 1), (5, 1), (5, 1), (7, -1)], key=repr)
    clean = decontam.decontaminate(odd, bench)
    assert clean.columns == odd.columns and not {1, 5, 7} & {r.doc_id for r in clean.collect()} and clean.count() == len(TEXTS) - 4
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0 and decontam.decontaminate(odd, bench.limit(0)).count() == len(TEXTS)


def test_benchmark_in_several_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = listed(decontam.contaminated(docs, bench), "doc_id", "item_id")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 2_000)
    assert listed(decontam.contaminated(docs, bench), "doc_id", "item_id") == whole != []
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = {(d, b.item_id) for b in bench.collect() for d, t in texts.items() if b.text in t}
    assert plain <= set(whole)


def test_quotes_are_found_at_every_offset():
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(n))
    item, length = prose(60)[:350], decontam.WINDOW + decontam.STEP - 1
    assert length <= 80
    by = decontam.Windows.of([(7, item)])
    at = range(0, len(item) - length + 1)
    texts = [f"{prose(20)} zz{item[a:a + length]}zz {prose(20)}" for a in at]
    assert {row for row, *_ in decontam.search(texts, by)} == set(at)
    assert decontam.search([prose(300)], by) == []


def test_short_items_are_found_as_whole_words(spark):
    texts = [(1, "Who wrote it: Hamlet?"), (2, "hamletx who wrote it hamlets"), (3, "so WHO  wrote it, hamlet then"), (4, "xwho wrote it hamlet"), (5, None), (6, "42")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "Who wrote it? Hamlet."), (2, "42"), (3, "?!"), (4, "")], "item_id bigint, text string")
    assert listed(decontam.contaminated(docs, bench), "doc_id", "item_id", "edits", "end") == [(1, 1, 0, 19), (3, 1, 0, 22), (6, 2, 0, 2)]
    assert listed(decontam.decontaminate(docs, bench), "doc_id") == [(2,), (4,), (5,)]


# 6: mixing


def brute_targets(sizes, share=1.5, epochs=2, weights=(3.0, 1.0, 2.0)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, full = sum(sizes.values()) * share, set()
    while True:
        left = budget - sum(sizes[s] * epochs for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: float(sizes[s] * epochs) if s in full else weight[s] * left / total for s in names}
        over = {s for s in names if s not in full and target[s] > sizes[s] * epochs}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, odd, none, seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.choice((0, 1, 5, 40))), r.choice("abcdefg")) for i in range(300)]
    rows += [(i, "x " * 400, "g") for i in range(300, 303)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string") if seed else odd
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    sizes, taken = Counter(), Counter()
    for g in got:
        sizes[g.source] += g.size
        taken[g.source] += g.taken
        assert g.taken == g.copies * g.size + g.part <= 2 * g.size and 0 <= g.part < max(g.size, 1)
    target = brute_targets(sizes)
    for g in got:
        assert g.source_size == sizes[g.source] and abs(g.target - target[g.source]) < 1e-6 * (1 + target[g.source])
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)
    assert listed(mixing.mix(df.repartition(5)), "doc_id", "taken") == listed(mixing.mix(df), "doc_id", "taken")
    assert mixing.mix(none).count() == 0


def test_mixed_rows(odd):
    plan = defaultdict(int)
    for g in mixing.mix(odd).collect():
        plan[g.doc_id] += g.taken
    out = mixing.apply(odd)
    assert out.columns == odd.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(re.findall(mixing.WORD, r.text or ""))
    assert {d: n for d, n in got.items() if n} == {d: n for d, n in plan.items() if n}


# 7: archives


def test_archive_round_trip(spark, none):
    long = "<p>" + "x" * 700_000
    big = "<html>" + "y" * 100
    rows = [(3, "http://a/\n b", big), (1, None, big), (2, "u", big), (4, "u", None), (5, "u", ""), (6, "u", "tiny"), (7, "u", "tiny"),
            (8, "http://é", long + "é"), (9, "u", long + "é"), (None, "u", big), (10, "u", "a\r\n\r\nb WARC/1.1\r\n"), (2, "u", big)]
    pages = spark.createDataFrame([(*r, 1, "b") for r in rows], "page_id bigint, url string, html string, digest int, bundle string")
    index = warc.write_bundles(pages, new_folder(spark, "test"))
    got = listed(warc.read_bundles(index), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 100 and p != first[h or ""]
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    assert got == sorted(want, key=repr)
    # a shuffled read of some records only
    some = {r.page_id: bytes(r.payload) for r in warc.read_bundles(index.where("page_id in (8, 10, 6)"), payloads=True).collect()}
    assert some == {8: (long + "é").encode(), 10: b"a\r\n\r\nb WARC/1.1\r\n", 6: b"tiny"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_frames_are_independent_and_found_by_the_footer(spark):
    import zstandard

    pages = spark.createDataFrame([(i, "u", f"page {i} " * 9000) for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    index = warc.write_bundles(pages, new_folder(spark, "test")).collect()
    assert {r.frame for r in index} >= {0, 1, 2}
    system, path = warc.filesystem(index[0].bundle)
    with system.open_input_file(path) as f:
        data = f.read()
    reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)  # any reader skips the table
    assert reader.read().count(b"WARC/1.1\r\n") == 20
    frames, _, magic = struct.unpack("<IBI", data[-9:])
    assert magic == warc.SEEKABLE_MAGIC and frames == 1 + max(r.frame for r in index)
    broken = warc.record(1, "u", b"abc", "0" * 64, None, False, "d")
    with pytest.raises(ValueError):
        warc.parse(broken)


# 8: scores


def test_scores_equal_brute_force(spark, odd, none):
    rows = [(i, " ".join(random.Random(i).choice("a b c dd e f".split()) for _ in range(12)) if i % 9 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(1, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in scoring.score(docs, labels).collect()}
    counts = Counter(w for _, t in rows for w in (t or "").split())
    ids = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])), 2)}
    models = []
    for chosen in (lambda i: True, lambda i: i < 20 and i % 2):
        one, two = Counter(), Counter()
        for i, t in rows:
            if t and chosen(i):
                seq = [ids[w] for w in t.split()]
                one.update(seq)
                two.update(zip([1, *seq], seq))
        models.append((one, two))
    total = lambda m: sum(m[0].values()) + scoring.SMOOTHING * scoring.VOCABULARY

    def loss(model, seq):
        one, two = model
        out = 0.0
        for v, w in zip([1, *seq], seq):
            p = (one[w] + scoring.SMOOTHING) / total(model)
            if v != 1 and one[v]:
                p = (1 - scoring.BIGRAM_WEIGHT) * p + scoring.BIGRAM_WEIGHT * two[v, w] / one[v]
            out -= np.log(p)
        return out / len(seq)

    for i, t in rows:
        if t:
            seq = [ids[w] for w in t.split()]
            far, near = loss(models[0], seq), loss(models[1], seq)
            assert got[i].n_tokens == 12
            assert np.allclose([got[i].background_loss, got[i].target_loss, got[i].score], [far, near, near - far], atol=1e-4)
        else:
            assert got[i].n_tokens == 0 and got[i].score is None
    assert scoring.score(odd, labels).count() == len(TEXTS) and scoring.score(none, labels).count() == 0
    assert scoring.score(odd, labels.limit(0)).count() == len(TEXTS)


def test_scores_count_every_word_and_pair(spark, monkeypatch):
    """More words than 2^16 and more pairs than 2^20, over several chunks: each keeps counts of its own."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(70_000)]
    rows = [(0, "rare0 rare1 rare2"), (1, "rare0 rare1 rare3"), (2, "a a a a")] + [(i, " ".join(r.choices(words, k=6000))) for i in range(3, 203)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 100, 2)], "doc_id bigint, quality int")
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 100_000)
    one, two = Counter(), Counter()
    for _, t in rows:
        seq = t.split()
        one.update(seq)
        two.update(zip(seq, seq[1:]))
    assert len(one) > 1 << 16 and len(two) > 1 << 20
    total = sum(one.values()) + scoring.SMOOTHING * len(one)
    got = {x.doc_id: x for x in scoring.score(docs, labels).collect()}
    assert len(got) == len(rows)
    for i in (0, 1, 2, 3, 100, 202):
        seq = rows[i][1].split()
        p = [(one[w] + scoring.SMOOTHING) / total for w in seq]
        p[1:] = [(1 - scoring.BIGRAM_WEIGHT) * q + scoring.BIGRAM_WEIGHT * two[v, w] / one[v] for q, v, w in zip(p[1:], seq, seq[1:])]
        assert abs(got[i].background_loss + sum(map(np.log, p)) / len(seq)) < 1e-9


# 9: lines


def brute_templates(texts):
    leaves = defaultdict(dict)
    lines = []
    for d, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            words = ["<*>" if any(c.isdigit() and c.isascii() for c in w) else w for w in line.split()]
            if len(words) >= templates.LEAST_WORDS:
                leaf, line = (len(words), *words[:templates.DEPTH]), " ".join(words)
                leaves[leaf].setdefault(line, set()).add(d)
                lines.append((d, n, leaf, line))
    drop = set()
    for leaf, held in leaves.items():
        if len(set().union(*held.values())) < templates.LEAST_DOCS:
            continue
        groups = []
        for line in sorted(held):
            words = line.split()
            scores = [sum(a == b for a, b in zip(t, words)) / len(words) for t, _ in groups]
            if scores and max(scores) >= templates.ALIKE:
                at = scores.index(max(scores))
                t, members = groups[at]
                groups[at] = ([a if a == b else "<*>" for a, b in zip(t, words)], [*members, line])
            else:
                groups.append((words, [line]))
        for _, members in groups:
            if len(set().union(*(held[m] for m in members))) >= templates.LEAST_DOCS:
                drop |= {(leaf, m) for m in members}
    return [sorted(n for e, n, leaf, line in lines if e == d and (leaf, line) in drop) for d in range(len(texts))]


def test_lines_equal_brute_force(spark, docs, odd, none):
    r = random.Random(7)
    texts = [f"User {r.randint(1, 999)} logged in from host{r.randint(1, 9)} at noon\nunique {i} line of document number {'abcdefghij'[i % 10] * 3}{i}x\n"
             f"Totals for {r.choice(['red', 'green', 'blue'])} items were sent on time\n\nok" for i in range(30)]
    texts += [None, "", "User 5 logged in", *(t.text for t in docs.limit(80).collect())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {x.doc_id: x for x in templates.drop_recurring_lines(df).collect()}
    want = brute_templates(texts)
    assert [list(got[i].dropped) for i in range(len(texts))] == want
    assert want[0][:1] == [0] and 2 in want[0]
    for i, t in enumerate(texts):
        kept = [x for n, x in enumerate((t or "").split("\n")) if n not in want[i]]
        assert got[i].text == "\n".join(kept) and got[i].n_lines == len((t or "").split("\n"))
    assert templates.drop_recurring_lines(odd).count() == len(TEXTS) and templates.drop_recurring_lines(none).count() == 0


def test_crowded_leaves_are_divided(spark, monkeypatch):
    monkeypatch.setattr(templates, "LEAF_LINES", 4)
    texts = [f"alpha beta gamma {c}{c} delta end{d}" for c in "abcdefgh" for d in "xyz"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert all(list(r.dropped) == [0] for r in templates.drop_recurring_lines(df).collect())


def test_a_leaf_above_the_bound_is_merged_whole(spark, monkeypatch):
    """Last words vary without a digit, so no two lines of a template end alike."""
    monkeypatch.setattr(templates, "LEAF_LINES", 16)
    r = random.Random(3)
    word = lambda: "".join(r.choices("bcdfghjklm", k=6))
    texts = [f"alpha beta gamma user {x} logged in from {word()}" for x in ("anna", "bert", "carl") for _ in range(2 + templates.LEAST_DOCS)]
    texts += [f"alpha beta gamma {word()} {word()} {word()} {word()} {word()} {word()}" for _ in range(300)]
    texts += [f"alpha beta gamma {r.choice('xyz')} {r.choice('xyz')} {r.choice('xyz')} {r.choice('xyz')} {word()} {word()}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {x.doc_id: list(x.dropped) for x in templates.drop_recurring_lines(df).collect()}
    want = brute_templates(texts)
    assert [got[i] for i in range(len(texts))] == want and want[0] == [0] and [] in want


def test_two_documents_and_repeated_rows_recur(spark):
    long = " ".join(["a", "passage", "of", "many", "words", *(chr(97 + i % 26) * 3 for i in range(60))])
    copy = "no id but equal text here"
    rows = [(1, f"{long}\nsomething only here"), (2, f"other words stand here\n{long}"), (3, "a line without any copy")]
    rows += [(None, copy), (None, copy), (4, "one more of a kind"), (4, "one more of a kind")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = listed(templates.drop_recurring_lines(df), "doc_id", "dropped")
    assert got == sorted([(1, [0]), (2, [1]), (3, []), (4, [0]), (4, [0]), (None, [0]), (None, [0])], key=repr)


# 10: token records


def test_token_records_round_trip(spark, docs, odd, none):
    whole = Tokenizer.from_file(VOCAB)
    for df in (docs.select("doc_id", "text"), odd):
        index = tokens.write_records(df, new_folder(spark, "test"), VOCAB, files=3)
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        start, want = 0, []
        for d, t in rows:
            ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert listed(tokens.summaries(index), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
        some = tokens.read_records(index.where("start % 2 = 0")).count()
        assert some == sum(s % 2 == 0 for _, s, *_ in want)
    assert tokens.token_records(none, VOCAB).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZé'sÀ<|>.,%1 \n\t ́ßΣ_İ\x1cÿ", max_size=40))
def test_words_encode_as_the_whole_text(text):
    encoder = tokens.encoder(VOCAB)
    ids = encoder._whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == ids


def test_a_damaged_record_fails(spark, docs):
    row = tokens.write_records(docs.limit(3), new_folder(spark, "test"), VOCAB, files=1).first()
    system, path = tokens.filesystem(row.file)
    with system.open_input_file(path) as f:
        record = bytearray(f.read_at(row.length, row.offset))
    assert tokens.parse(bytes(record))[0] == row.doc_id
    for at in (0, 9, 20, len(record) - 1):
        damaged = record.copy()
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            tokens.parse(bytes(damaged))


# the pipeline


def test_pipeline_by_stages(spark, docs):
    """Each stage against what its operator and brute force say about its own input."""
    out = {}
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        out[name] = df = stage(spark, df, SF).persist()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "mix", "tokens"]
    assert all(out[n].columns == docs.columns for n in ("language", "near_duplicates", "benchmark", "mix"))
    assert out["language"].count() == docs.where("text rlike '\\\\p{L}'").count()  # clean documents stay
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in out["language"].collect()]
    assert {r.doc_id for r in out["near_duplicates"].collect()} == {c for *_, c in brute_components(rows)}
    before, after = ({r.doc_id: r.text for r in out[n].collect()} for n in ("near_duplicates", "benchmark"))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {d for d, t in before.items() if any(i in t for i in items)}
    assert plain and not plain & set(after) and len(before) - len(after) <= len(plain) + 3
    taken = {r.doc_id: r.taken for r in mixing.mix(out["benchmark"]).collect()}
    words = Counter()
    for r in out["mix"].collect():
        words[r.doc_id] += len(r.text.split())
    assert words == {d: n for d, n in taken.items() if n}
    assert listed(out["tokens"], "doc_id") == listed(out["mix"], "doc_id")
    for df in out.values():
        df.unpersist()


def test_pipeline_on_odd_rows(spark, odd, none):
    for start in (odd, none):
        df = start
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
        assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        df.count()


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
