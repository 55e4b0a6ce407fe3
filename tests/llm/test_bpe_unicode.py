"""Pre-tokens and lower case follow the library's Unicode versions, not those of Python and its modules."""

import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library, bpe.load(path)


def same(both, texts):
    library, own = both
    for text, expect in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(b"".join(own.encode(text)), "<u4").tolist() == expect.ids, [hex(ord(c)) for c in text]


def test_characters_of_later_versions(both):
    codes = [c for a, b in bpe.NO_CLASS for c in (range(a, b + 1) if b - a < 200 else (a, a + 1, (a + b) // 2, b))] + [c for a, b, _ in bpe.CASES for c in range(a, b + 1)]
    same(both, [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in codes])


def test_characters_at_the_edges_and_at_random(both):
    edges = {e for a, b in bpe.NO_CLASS for e in (a - 1, b + 1)} | {e for a, b, _ in bpe.CASES for e in (a - 1, b + 1)}
    rng = random.Random(2)
    codes = [c for c in [*edges, *(rng.randrange(0x110000) for _ in range(20_000)), *range(0x80, 0x3000)] if not 0xD800 <= c < 0xE000]
    same(both, [f"x{chr(c)}y{chr(c)} {chr(c)}" for c in codes])


def test_mixtures(both):
    rng = random.Random(4)
    newer = [chr(a) for a, _ in bpe.NO_CLASS] + [chr(a) for a, _, _ in bpe.CASES]
    texts = ["".join(rng.choice([*newer, "a", "B", "é", " ", "'s", "1", "!", "Σ", "ß", "日", "́", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    same(both, texts)
    assert unicodedata.unidata_version  # the tables above are relative to it
