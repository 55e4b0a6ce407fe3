"""Spaced-seed decontamination against the alignment of every item with every place of every document."""

import random
from itertools import combinations

from evidentia.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, score int, item_id long, bid long"


def by_force(docs, items):
    """(document, item) of the pairs with an overlap, by all alignments."""
    found = set()
    for d, text in docs:
        words = (text or "").lower().split()
        for t, item in items:
            want = (item or "").lower().split()
            for p in range(-len(want) + 1, len(words)) if want else ():
                equal = [0 <= p + k < len(words) and words[p + k] == w for k, w in enumerate(want)]
                if len(want) < dc.TOLERANT:
                    hit = all(equal)
                elif len(want) <= dc.SHORT:
                    hit = sum(equal) >= 0.75 * len(want)
                else:
                    inside = [e for k, e in enumerate(equal) if 0 <= p + k < len(words)]
                    best, hit = 0, False
                    for i in range(len(inside)):
                        total = 0
                        for j in range(i, len(inside)):
                            total += 1 if inside[j] else -dc.PENALTY
                            if total > best:
                                best, n = total, sum(inside[i : j + 1])
                                hit = n >= 10 and n >= 0.75 * (j + 1 - i)
                if hit:
                    found.add((d, t))
                    break
    return found


def test_masks_miss_no_least_overlap():
    def missed(masks, length, replaced):
        for gone in combinations(range(length), replaced):
            same = "".join("0" if i in gone else "1" for i in range(length))
            if not any(all(same[p + k] == "1" for k, c in enumerate(m) if c == "1") for m in masks for p in range(length - len(m) + 1)):
                return True
        return False

    for length in range(1, 13):
        replaced = 0 if length < dc.TOLERANT else length * 25 // 100
        assert not missed(dc.masks_for(length), length, replaced)
    for length, replaced in ((10, 0), (11, 1), (12, 2), (13, 3), (16, 4)):
        assert not missed(dc.MASKS[13], length, replaced)


def test_against_all_alignments(spark):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, *range(5, 13), 13, 14, 15, 20, 30, 60] * 2)]
    items += [(900, None), (901, ""), (902, items[20][1])]
    docs = []
    for d in range(160):
        words = [f"d{rng.randrange(4000)}" for _ in range(rng.randint(0, 30))]
        item = rng.choice(items[4:36])[1].split()
        a = rng.randrange(max(1, len(item) - 9))
        piece = item[a:] if rng.random() < 0.5 else item[: len(item) - a]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            piece[rng.randrange(len(piece))] = f"x{rng.randrange(99)}"
        at = rng.choice([0, len(words), rng.randrange(len(words) + 1)])
        docs.append((d, " ".join(words[:at] + piece + words[at:]).upper() if d % 3 else " ".join(words[:at] + piece + words[at:])))
    docs += [(500, None), (501, ""), (502, " \t\n"), (503, docs[7][1])]
    frame = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.overlaps(frame, bench).collect()
    expect = by_force(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == expect and len(expect) > 100
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    kept = dc.clean(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in expect}


def test_repeated_rows_empty_sides_and_long_texts(spark):
    item = " ".join(f"t{i}" for i in range(14))
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    docs = spark.createDataFrame([(1, item, 0, 0, 0), (1, item, 0, 0, 0), (None, item, 0, 0, 0), (2, f"{long} {item} {long}", 0, 0, 0), (3, f"{item} {item}", 0, 0, 0)], SCHEMA)
    bench = spark.createDataFrame([(7, item), (8, item), (None, item)], "item_id long, text string")
    rows = dc.overlaps(docs, bench).collect()
    assert len(rows) == 15 and {r.word_start for r in rows if r.doc_id == 3} == {0} and {r.word_start for r in rows if r.doc_id == 2} == {200_000}
    assert dc.clean(docs, bench).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert dc.overlaps(none, bench).count() == dc.clean(none, bench).count() == dc.overlaps(docs, no_items).count() == 0
    assert dc.clean(docs, no_items).count() == 5


def test_items_that_share_a_template(spark):
    import time

    template = "Read the question below and choose the one best answer from the list".split()
    items = [(i, " ".join([*template, f"q{i}", f"r{i % 977}", f"s{i % 13}", "end"])) for i in range(20_000)]
    filler = " ".join(f"f{i}" for i in range(34))
    text = " ".join(f"{' '.join(template)} q{k} r{k} s{k % 13} {filler}" for k in range(40))
    near = " ".join([*template[:6], "other", *template[7:9], "q5"])
    docs = spark.createDataFrame([(1, text, 0, 0, 0), (2, near, 0, 0, 0), (3, filler, 0, 0, 0)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    dc.overlaps(docs, bench.limit(10)).collect()
    began = time.time()
    rows = dc.overlaps(docs, bench).collect()
    assert time.time() - began < 30
    found = {(r.doc_id, r.item_id): r for r in rows}
    assert len(found) == len(rows) and {d for d, _ in found} == {1} and len(found) == 20_000
    some = [items[i] for i in (0, 3, 39, 40, 999, 19_999)]
    assert by_force([(1, text), (2, near)], some) == {(d, t) for d, t in found if t in {i for i, _ in some}}
    assert [found[1, k].n_matched for k in (0, 39, 40)] == [16, 16, 13] and found[1, 39].word_start == 39 * 50


def test_blocks_of_items(spark, monkeypatch):
    from evidentia.llm import decontaminate

    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(30)]
    docs = spark.createDataFrame([(i, f"x y z {t}", 0, 0, 0) for i, t in items], SCHEMA)
    paths = tuple(decontaminate.item_files(spark.createDataFrame(items, "item_id long, text string")))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    parts = list(decontaminate.indexes(paths, 1))
    assert len(parts) >= 6 and sorted(i for p in parts for i in p.ids) == list(range(30)) and max(len(p.words) for p in parts) <= 100
    monkeypatch.setattr(decontaminate, "CELLS", 7)
    column = docs.select("text").toArrow().column(0).combine_chunks()
    got = {(int(a), int(p.ids[t])) for p in parts for a, t, *_ in decontaminate.found_in(column, p, 10, 0.75).tolist()}
    assert got == {(i, i) for i in range(30)}
