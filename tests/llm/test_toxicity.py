"""The lexicon: folding, the matcher against naive search, and stems that are learnt."""

import os
import random
import re

import pytest

from evidentia.llm import toxicity
from evidentia.llm.labelled import crc_part

SCHEMA = "doc_id long, text string, score double, y int, weight string"


@pytest.mark.parametrize(
    ("text", "folded"),
    [("IDіОT", "idiot"), ("1d10t", "idiot"), ("m0rön", "moron"), ("tr@sh", "trash"), ("@ss a$$", "ass ass"), ("idio+", "idiot"), ("!diot wow!! really!", "!diot wow!! reaiiy!"), ("i d i o t", "idiot"), ("m.o.r.o.n!", "moron!"), ("a dog", "a dog"), ("1 2 3 4", "1 2 3 4"), ("in 2024 for $5", "in 2024 for $5"), ("cost###", "cost###"), ("loser l0ser 1oser", "ioser ioser ioser"), ("", "")],
)
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def naive(lexicon, text):
    """Word by word, every entry against every word."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+", text)]
    free = set()
    for phrase in lexicon.exceptions:
        p = toxicity.fold(phrase)
        for m in re.finditer(re.escape(p), text):
            if (not m.start() or not text[m.start() - 1].isalnum()) and (m.end() == len(text) or not text[m.end()].isalnum()):
                free.update(range(m.start(), m.end()))
    total, n = 0.0, 0
    for start, _, word in words:
        best = max([w for e, w in lexicon.weights.items() if (word.startswith(toxicity.fold(e[:-1])) if e.endswith("*") else word == toxicity.fold(e))], default=0.0)
        if best and start not in free:
            total, n = total + best, n + 1
    return total, n


def test_matcher_against_naive_search():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon({"ab": 2.0, "aba*": 3.0, "abab": 1.0, "ba*": 0.5, "loser": 4.0, "cc*": 1.5}, ["ab ba", "x loser"])
    a = lexicon.automaton()
    for _ in range(3000):
        text = toxicity.fold("".join(rng.choice(["a", "b", "c", " ", "-", "ab", "aba", "loser", "x ", "!"]) for _ in range(rng.randint(0, 14))))
        # overlapping occurrences of a phrase are rare enough to leave out
        if all(len(re.findall(f"(?={re.escape(toxicity.fold(p))})", text)) == text.count(toxicity.fold(p)) for p in lexicon.exceptions):
            total, n = toxicity.matched(a, text) if text else (0.0, 0)
            assert (pytest.approx(total), n) == naive(lexicon, text), text


def corpus(spark, n=900):
    """Three invented languages; insults are inflected from a stem, each form rare, or whole words."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        lang = i % 3
        words = [f"{'pqr'[lang]}{rng.randrange(300)}w" for _ in range(rng.randint(15, 120))]
        toxic = i % 7 == 0
        for _ in range(2 + len(words) // 50 if toxic else 0):
            words[rng.randrange(len(words))] = [f"zorgl{''.join(rng.choice('abcdefgh') for _ in range(3))}", f"Krumf{''.join(rng.choice('abcdefgh') for _ in range(4))}", rng.choice(["blagh", "BL4GH", "snick", "sn1ck"])][lang]
        if not toxic and i % 40 == 1:
            words[0] = "zorgba"  # a harmless word with the same beginning
        rows.append((i, " ".join(words), 1.0, 2, "x"))
        labels.append((i, int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", 0.0, 0, ""), (None, rows[0][1], 0.0, 0, ""), rows[0], (n + 2, "zorglabc " + "q1w " * 300_000, 0.0, 0, "")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_stems_are_learnt(spark):
    docs, labels = corpus(spark)
    lexicon = toxicity.learn(docs, labels, "toxic", crc_part(5) != 0)
    stems = {e for e in lexicon.weights if e.endswith("*")}
    assert any(toxicity.fold("zorgl").startswith(e[:-1]) or e.startswith("zorgi") for e in stems) and any(e.startswith(("kru", "krumf")) for e in stems)
    scored = toxicity.classify(docs, labels)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    held = [(r.predicted, r.toxic, r.doc_id) for r in scored.join(labels, "doc_id").where("held_out").collect()]
    for lang in range(3):
        own = [(p, y) for p, y, i in held if i % 3 == lang]
        assert sum(p for p, y in own if y) >= 0.95 * sum(y for _, y in own)
    assert sum(p for p, y, _ in held if not y) <= 0.02 * len(held)
    by = {r.doc_id: r.score for r in scored.collect()}
    assert by[900] == by[901] == 0 and by[902] < 0.5  # one word in three hundred thousand
    assert by[None] == by[0] and len({r.score for r in scored.where("doc_id = 0").collect()}) == 1


def test_empty_tables_and_ties(spark):
    docs, labels = corpus(spark, 60)
    none = docs.where("false")
    lexicon = toxicity.Lexicon({"blagh": 2.0})
    assert toxicity.harmless(none, lexicon).count() == toxicity.score(none, lexicon).count() == 0
    assert toxicity.harmless(none, lexicon).columns == docs.columns
    assert toxicity.learn(none, labels, "toxic", crc_part(5) != 0).weights == {}
    assert toxicity.learn(docs, labels.where("toxic = 0"), "toxic", crc_part(5) != 0).weights == {}
    kept = toxicity.harmless(docs, toxicity.Lexicon())
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_learning_writes_no_files_and_leaves_no_cache(spark):
    docs, labels = corpus(spark, 300)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    files = lambda: {os.path.join(at, f) for at, _, names in os.walk(folder) for f in names}
    before = files()
    assert toxicity.learn(docs, labels, "toxic", crc_part(5) != 0).weights
    assert not files() - before and not spark.sparkContext._jsc.getPersistentRDDs()
