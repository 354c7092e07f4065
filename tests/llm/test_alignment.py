"""Alignment of two tokenizers against brute force, with every odd case."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from postsieve.llm import alignment
from postsieve.llm.queries import QUERIES
from tests.llm.test_llm import EXTRA, KIND, SF, TEXTS, listed

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCRAPS = ["a", "b", "the", "ing", " ", "  ", "   ", "\n", "\n\n", "\t", "é", "日", "\u2581", "\xa0", "\x85", "<s>", "<|endoftext|>", "<0x0A>",
          "'s", "'", "1", "23", "!!", "…", "\u200b", "\ufeff", "\U0001f600", "e\u0301", "ﬁ", "½", "\x00", "\x1c", "\u180e", "ſ", "İ", "Ａ"]


@pytest.fixture(scope="module")
def plain():
    """Tokens of whole texts, in no other way than the libraries'."""
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {c: c for c in letters} | {256 + n: c for n, c in enumerate(c for c in range(256) if c not in letters)}

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(stand_in[ord(c)] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("\u2581", " ").encode()))
        whole = (" " + text).encode()
        return (left, right) if all(b"".join(x for _, x in side) == whole for side in (left, right)) else ([], [])

    return tokens


def brute(texts, tokens):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each text."""
    out, every, best = [], Counter(), {}
    for text in texts:
        left, right = tokens(text)
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
        links, j = [], 0
        for i, end in enumerate(ends[0]):
            while j and ends[1][j - 1] > end - len(left[i][1]):
                j -= 1
            while j < len(right) and ends[1][j] - len(right[j][1]) < end:
                if ends[1][j] > end - len(left[i][1]):
                    links.append((left[i][0], right[j][0]))
                j += 1
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append(f"{','.join(str(x) for x, _ in left[i:i2])}|{','.join(str(x) for x, _ in right[j:j2])}")
            i, j = i2, j2
        out.append((len(left), len(right), len(groups), links, ";".join(groups)))
        every.update(set(links))
    for (a, _), n in every.items():
        best[a] = max(best.get(a, 0), n)
    return [(a, b, g, len(links), sum(every[x] == best[x[0]] for x in links), sum(every[x] for x in links), shown) for a, b, g, links, shown in out]


def test_leaf_groups_equal_the_common_ends():
    r = random.Random(1)
    for _ in range(300):
        size = r.randrange(1, 60)
        a, b = (np.array(sorted({size, *(r.randrange(1, size + 1) for _ in range(r.randrange(size)))})) for _ in "ab")
        common = sorted(set(a.tolist()) & set(b.tolist()))
        known = sorted({common[-1], *(c for c in common if r.random() < 0.2)})
        cuts = [np.array([0, *(x.tolist().index(c) + 1 for c in known)]) for x in (a, b)]
        want = [(*x, *y) for x, y in zip(*([(0 if not n else s.tolist().index(common[n - 1]) + 1, s.tolist().index(c) + 1) for n, c in enumerate(common)]
                                           for s in (a, b)), strict=True)]
        assert [tuple(x) for x in alignment.leaf_groups(a, b, *cuts).tolist()] == want


def test_stretches_equal_whole_texts(plain):
    r = random.Random(3)
    tools = alignment.Tokenizers(BYTES, PIECES)
    assert tools.parted
    for _ in range(150):
        texts = ["".join(r.choice(SCRAPS) if r.random() < 0.6 else r.choice(" abc") for _ in range(r.randrange(25))) for _ in range(20)]
        numbers = tools.numbers(texts)
        counts, first, links = tools.tables()
        for text, n in zip(texts, numbers, strict=True):
            want = brute([text], plain)[0]
            if (counts[n, 0] < 0).any():
                assert want[0] == 0
                continue
            assert tuple(counts[n].sum(0).tolist()) == want[:3]
            assert sum(first[n + 1] - first[n]) == want[3]
            assert ";".join(tools.groups[k] for k in n) == want[-1]


def _compare(df, plain):
    rows = df.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], plain), strict=True)]
    assert listed(alignment.align(df, BYTES, PIECES), "doc_id", *alignment.RESULTS, "groups") == sorted(want, key=repr)


def test_alignment_equals_brute_force(spark, plain):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé ") for _ in range(r.randrange(1, 9))) for _ in range(40)] + SCRAPS
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(30))) for _ in range(80)]
    texts += [texts[0], texts[0], "x" * 3000, " " * 500, "\n" * 50, "日本" * 400, "a" + "\t" * 90 + "b"]
    _compare(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4), plain)


def test_odd_rows_of_alignment(spark, plain):
    rows = [(*x[:4], len(x[1] or ""), *EXTRA) for x in TEXTS if x[0] != 7] + [(7, "the quick brown fox " * 900, "en", "c", 1, *EXTRA)]
    odd = spark.createDataFrame(rows, KIND).withColumnsRenamed({"key": "groups", "row": "chunk", "hash": "n_a"}).repartition(3)
    found = alignment.align(odd, BYTES, PIECES)
    assert set(found.columns) == set(odd.columns) | set(alignment.RESULTS)
    _compare(odd, plain)
    none = alignment.align(odd.limit(0), BYTES, PIECES)
    assert none.count() == 0 and set(none.columns) == set(found.columns)


def test_alignment_reads_texts_once(spark):
    """One shuffle of the texts and one of the pairs serve the counts and what goes back."""
    out = alignment.align(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), BYTES, PIECES)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan parquet") == 1 and plan.count("FlatMapGroupsInArrow") == 1


def test_alignment_query(spark, plain):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "")
            for r, x in zip(rows, brute([r.text for r in rows], plain), strict=True)]
    got = QUERIES["op11_shared_cuts"](spark, SF)
    assert listed(got, "doc_id", *alignment.RESULTS, "groups_sha256") == sorted(want, key=repr)
