"""Repeated passages against brute force, with every odd case."""

import hashlib
import random
from collections import Counter

import pytest

from postsieve.llm import repeats
from postsieve.llm.queries import QUERIES
from tests.llm.test_llm import EXTRA, KIND, SF, TEXTS, listed


def brute(texts, size=35):
    """Words, words removed and the rest of each text."""
    split = [[w.decode() for w in (t or "").encode().split()] for t in texts]
    seen = Counter(tuple(words[i:i + size]) for words in split for i in range(len(words) - size + 1))
    out = []
    for words in split:
        gone = set()
        for i in range(len(words) - size + 1):
            if seen[tuple(words[i:i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def found(df, size=35, **more):
    rows = repeats.find_repeats(df, size, **more).collect()
    assert all(list(map(tuple, r.repeats)) == sorted(map(tuple, r.repeats)) for r in rows)
    return sorted(((r.doc_id, r.n_words, sum(x.length for x in r.repeats), r.kept) for r in rows), key=repr)


@pytest.mark.parametrize("size", [1, 2, 5, 6, 35])
def test_repeats_equal_brute_force(spark, size):
    r = random.Random(size)
    passages = [[f"w{r.randrange(400)}" for _ in range(r.choice((size - 1, size, size + 1, 2 * size, 90)))] for _ in range(12)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(r.randrange(5)):
            words += r.choice(passages) if r.random() < 0.4 else [f"x{r.randrange(10**6)}" for _ in range(r.randrange(60))]
        texts.append(r.choice((" ", "\n", " \t ")).join(words))
    texts += [texts[0], "a " * 100, "a b " * 40, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert found(df, size) == sorted(((i, *x) for i, x in enumerate(brute(texts, size))), key=repr)


def test_prints_that_collide_only_propose(spark):
    """With prints of two bits all stretches are hits; the result is the same."""
    texts = [" ".join(f"{i}-{k % 50 if i % 3 else k}" for k in range(120)) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert found(df, print_bits=2) == sorted(((i, *x) for i, x in enumerate(brute(texts))), key=repr)


def test_odd_rows_of_repeats(spark):
    rows = [(*x[:4], len(x[1] or ""), *EXTRA) for x in TEXTS]
    rows += rows[-3:] * 2 + [(None, "w " * 36, None, None, 1, *EXTRA)] * 3
    odd = spark.createDataFrame(rows, KIND).withColumnsRenamed({"key": "repeats", "row": "chunk", "hash": "kept"}).repartition(3)
    result = repeats.find_repeats(odd)
    assert set(result.columns) == set(odd.columns) | {"n_words"}
    want = brute([r[1] for r in rows])
    assert listed(result, "doc_id", "n_words", "kept", "chunk") == sorted(((r[0], w[0], w[2], 1) for r, w in zip(rows, want, strict=True)), key=repr)
    none = repeats.find_repeats(odd.limit(0))
    assert none.count() == 0 and set(none.columns) == set(result.columns)


def test_windows_hold_blocks():
    for words in range(1, 80):
        block = repeats.Search(words, 1).block
        assert all(any(s % block == 0 for s in range(at, at + words - block + 1)) for at in range(block))


def test_a_chunk_is_read_once_per_plan(spark):
    """The texts are shuffled once, however many steps read them."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = repeats.find_repeats(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan parquet") == 1 and "ReusedExchange" in plan


def test_repeats_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, gone, kept) in zip(rows, brute([r.text for r in rows]), strict=True)]
    assert any(w[2] for w in want)
    got = QUERIES["op12_block_anchors"](spark, SF)
    assert listed(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
