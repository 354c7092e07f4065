"""What a Python worker remembers of words stays within its bound, and ids are the same."""

import tracemalloc

import numpy as np
import public_tokenizers

from postsieve.llm import tokens


def _word(n: int) -> str:
    return "".join(chr(97 + n // 26 ** i % 26) for i in range(5))


def test_remembered_words_have_a_bound_in_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 500_000, raising=False)
    encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"the {_word(n)} {_word(n)}, !? {n}é" for n in range(at, at + 250)) for at in range(0, 20_000, 250)]
    tracemalloc.start()
    try:
        for text in [*texts, *texts[:2]]:
            whole = encoder._whole.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == whole
        del whole
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 2_500_000  # two generations and a text more; all words take 9 MB
