"""The bigram model keeps one restaurant for each context, however many there are."""

import math
import zlib

import pytest

from evidentia.llm import pitman_yor


def test_every_context_has_its_own_restaurant(spark):
    # more contexts than any table of 2^15 could tell apart; each pair is seen once, so seating is known
    n_docs, n_words = 700, 60
    rows = [(d, " ".join(f"w{d}x{i}" for i in range(n_words))) for d in range(n_docs)]
    held = {d for d in range(n_docs) if zlib.crc32(str(d).encode()) % 7 == 2}
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = n_docs - len(held)
    pairs, types = train * (n_words + 1), train * n_words + 1
    d1 = 0.95  # all pairs have one customer
    ones = types - 1 if train > 1 else types
    d0 = min(0.95, max(0.05, ones / ones))
    below, root = 1.0 + pairs, 1.0
    rare, end, new = (1 - d0) / below, (train - d0) / below, (root + d0 * types) / below
    start = lambda p, c: (c - d1 * c + (1 + d1 * train) * p) / (1 + train)
    seen = lambda p: (1 - d1 + (1 + d1) * p) / 2
    known = math.log10(start(rare, 1)) + (n_words - 1) * math.log10(seen(rare)) + math.log10(seen(end))
    unknown = math.log10(start(new, 0)) + (n_words - 1) * math.log10(new) + math.log10(end)
    for d, score in got.items():
        assert score == pytest.approx(unknown if d in held else known, rel=1e-5), d
    assert len(got) == n_docs and held
