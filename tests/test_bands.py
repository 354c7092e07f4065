"""The banded comparison of near-duplicate texts decides as the whole one does."""

import random

import numpy as np

from postsieve.functions import similarity as S


def _texts(seed: int, n: int, words: int):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeé ñ🙂"[:7]) for _ in range(draw.randint(1, 9))).strip() or "x" for _ in range(400)]
    left, right = [], []
    for _ in range(n):
        one = draw.sample(vocabulary, draw.randint(1, words))
        other = list(one)
        for _ in range(draw.randint(0, max(1, len(one) // draw.choice((2, 4, 10))))):
            k = draw.randrange(len(other))
            word = other[k]
            at = draw.randrange(len(word) + 1)
            other[k] = draw.choice((word[:at] + draw.choice("abz🙂") + word[at:], word[:at] + word[at + 1:] or "y", draw.choice(vocabulary)))
        left.append(" ".join(sorted(set(one))))
        right.append(" ".join(sorted(set(other))))
    return left, right


def test_ratios_with_a_least_value_decide_alike():
    for seed, (n, words) in enumerate(((400, 8), (300, 60), (60, 300))):
        left, right = _texts(seed, n, words)
        whole = S.ratios(left, right)
        for least in (50.0, 80.0, 90.0, 97.0):
            found = S.ratios(left, right, least)
            assert ((found >= least) == (whole >= least)).all() and (found <= whole).all()
            assert (found[whole >= least] == whole[whole >= least]).all()


def test_unlike_long_texts_are_left_early(monkeypatch):
    draw = random.Random(1)
    texts = [" ".join(sorted({"".join(draw.choice("etaoinshrdlucm") for _ in range(7)) for _ in range(250)})) for _ in range(200)]
    seen, count = [], np.bitwise_count
    monkeypatch.setattr(S.np, "bitwise_count", lambda x: seen.append(x.shape[1]) or count(x))
    needed = np.full(100, 1700)
    assert (S.common_lengths(texts[:100], texts[100:], needed) < 1700).all()
    assert 0 < 64 * len(seen) < 1700  # none is followed to its end
