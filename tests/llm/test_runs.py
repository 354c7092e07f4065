"""Periodic runs against brute force, with every odd case."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from postsieve.llm import runs
from postsieve.llm.queries import QUERIES
from tests.llm.test_llm import EXTRA, KIND, SF, TEXTS, listed


def brute_runs(words, least=12):
    """Every stretch of equal words p apart, for every p; of equal stretches the smallest p."""
    line, found = np.array(words), {}
    for p in range(1, len(words) // 2 + 1):
        equal = np.concatenate([[0], line[:-p] == line[p:], [0]]).astype(np.int8)
        for s, e in zip(np.flatnonzero(np.diff(equal) == 1).tolist(), np.flatnonzero(np.diff(equal) == -1).tolist(), strict=True):
            if e - s + p >= max(least, 2 * p):
                found.setdefault((s, e - s + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    out = set()
    for s, n, p in found:
        out.update(range(s + p, s + n))
    return " ".join(w for i, w in enumerate(words) if i not in out)


def _tailed(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


@pytest.mark.parametrize("block", [8, 100, 1_000_000])
def test_runs_equal_brute_force(block, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", block)
    r = random.Random(block)
    for _ in range(60):
        documents = []
        for _ in range(r.randint(1, 6)):
            kinds, n = r.choice((1, 2, 3, 30)), r.choice((0, 1, 5, 12, 40, 150))
            words = [r.randrange(kinds) for _ in range(n)]
            if n > 20 and r.random() < 0.6:
                a = r.randrange(n)
                p = r.randint(1, max(1, (n - a) // 2))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            documents.append(np.array(words, np.int64))
        least = r.choice((1, 2, 12))
        want = [(i, *x) for i, d in enumerate(documents) for x in brute_runs(d.tolist(), least)]
        assert [tuple(x) for x in runs.find_runs(documents, least).tolist()] == want


def test_extensions_reach_the_samples():
    r = np.random.default_rng(1)
    line = np.concatenate([np.tile(r.integers(0, 3, 40), 6), r.integers(0, 2, 200)])
    found = runs.Extensions(line)
    left, right = np.array([(i, j) for i in range(len(line)) for j in range(i + 1, len(line))]).T
    got = found(left, right)
    for i, j, n in zip(left.tolist(), right.tolist(), got.tolist(), strict=True):
        assert (line[i:i + n] == line[j:j + n]).all()
        assert j + n == len(line) or line[i + n] != line[j + n]


def test_every_pair_of_residues_has_a_step():
    assert (runs.STEP < runs.MODULUS).all()
    assert all((i + runs.STEP[i, j]) % runs.MODULUS in runs.COVER and (j + runs.STEP[i, j]) % runs.MODULUS in runs.COVER
               for i in range(runs.MODULUS) for j in range(runs.MODULUS))


def test_odd_rows_of_runs(spark):
    long = "the quick brown fox jumps over lazy dogs " * 2000
    rows = [(*(x if x[0] != 7 else (7, long, "en", "c")), len(x[1] or ""), *EXTRA) for x in TEXTS]
    odd = spark.createDataFrame(rows, KIND).withColumnsRenamed({"key": "runs", "row": "collapsed"}).repartition(3)
    found = runs.periodic_runs(odd)
    assert set(found.columns) == set(odd.columns)
    want = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        own = [(0, 16_000, 8)] if doc_id == 7 else brute_runs(words)
        want.append((doc_id, [tuple(x) for x in own], brute_collapsed([w.decode() for w in words], own)))
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    none = runs.periodic_runs(odd.limit(0))
    assert none.count() == 0 and set(none.columns) == set(odd.columns)


def test_runs_query(spark):
    want = []
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = _tailed(doc_id, [w.decode() for w in (text or "").encode().split()])
        own = brute_runs(words)
        top = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc_id, len(own), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                     sha("".join(f"{s},{n},{p}\n" for s, n, p in own)), sha(brute_collapsed(words, own))))
    got = QUERIES["op13_periodic_runs"](spark, SF)
    assert any(w[1] for w in want)
    assert listed(got, "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256") == sorted(want, key=repr)
