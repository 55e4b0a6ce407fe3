"""Spelling variants against all pairs of words, whatever the size of groups."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import spelling


def damaged(doc_id, run):
    run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run


def counted(rows):
    n = Counter(damaged(i, run) for i, text in rows for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""))
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    form, count = {}, {}
    for w in n:
        around = [x for x in n if near(w, x)]
        count[w] = len(around)
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def texts(seed, letters, words, length):
    rng = random.Random(seed)
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(*length))) for _ in range(words)]
    known += [k[:i] + rng.choice(letters) + k[i + j :] for k in known for i, j in [(rng.randrange(len(k)), rng.randint(0, 1)) for _ in range(3)]]
    return [(i, " ".join(rng.choice(known[: rng.randint(1, len(known))]) for _ in range(40))) for i in range(200)]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé×÷ÿÀÞ", "xyzXYZ"])
def test_equals_all_pairs(spark, letters):
    rows = texts(letters, letters, 30, (7, 10))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n = counted(rows)
    assert {(r.word, r.n) for r in spelling.vocabulary(df).collect()} == set(n.items()) and len(n) > 20
    assert rows_of(spelling.group_variants(df)) == brute(n)


@pytest.mark.parametrize("most", [2, 5, 40])
def test_groups_dealt_anew_change_nothing(spark, most):
    rng = random.Random(most)
    n = {"samebegin" + "".join(rng.choice("abc") for _ in range(rng.randint(2, 4))): rng.choice([2, 30, 400, 5000]) for _ in range(120)}
    n |= {"".join(rng.choice("abc") for _ in range(3)) + "sameending": rng.choice([2, 30, 400]) for _ in range(25)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(spelling.variants(words, most=most)) == brute(n)
    sizes = spelling.groups(words, most).groupBy(*spelling.KEY).count().collect()
    assert all(r["count"] <= most or r["last"] - r["first"] == 1 for r in sizes)


def test_a_large_family_and_a_chain(spark):
    rng = random.Random(1)
    n = {"commonhead" + "".join(rng.choice("abcdefghijkl") for _ in range(4)): 2 for _ in range(3000)}
    n |= {"aaaaaaa": 2, "aaaaaaab": 20, "aaaaaaabc": 200, "aaaaaaabcd": 2000, "aaaaaaabca": 2000}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: r for r in spelling.variants(words, most=200).collect()}
    assert got["aaaaaaa"].root == "aaaaaaabca" and got["aaaaaaabc"].form == "aaaaaaabca" and got["aaaaaaab"].n_near == 2
    for w in rng.sample(sorted(n), 40):
        assert got[w].n_near == sum(near(w, x) for x in n)


def test_cases(spark):
    long = "a" * 30_000
    rows = [(1, "wordword wordword"), (None, None), (2, ""), (3, "12 ... 日本語"), (None, "nullword nullword"), (1, "wordword wordword"), (5, f"{long} {long} {long}b {long}b {long}b")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string")
    assert rows_of(spelling.group_variants(df)) == brute(counted(rows))
    assert rows_of(spelling.group_variants(df.where("false"))) == set()


def test_rectangles_hold_all_points():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 300):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        box = np.sort(rng.integers(0, n + 1, (2, 200)), axis=0), np.sort(rng.integers(0, n + 1, (2, 200)), axis=0)
        query, found = tree.report(box[0][0], box[0][1], box[1][0], box[1][1])
        got = sorted(zip(query.tolist(), found.tolist(), strict=True))
        assert got == sorted((q, int(v)) for q in range(200) for v in values[box[0][0][q] : box[0][1][q]] if box[1][0][q] <= v < box[1][1][q])
