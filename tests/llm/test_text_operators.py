"""Operators on texts against brute force, exact round trips or held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import ann, bpe, decontaminate, html_extract, ngram_join, pitman_yor, quality, substrings, toxicity, warc
from evidentia.llm.labelled import crc_part
from evidentia.llm.textblocks import hash_words, word_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, node long"


def corpus(seed=3, n=120):
    """Texts with copies, near copies, shared passages, and odd rows; one column name clashes with an operator's own."""
    rng = random.Random(seed)
    vocab = ["the", "of", "and", *(f"w{i}" for i in range(400)), "été", "ß"]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            text = rng.choice(texts)
        elif kind < 0.4 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 20, 80, 200])))
            if kind > 0.8:
                text += "\n" + passage + "\t" + rng.choice(vocab)
        texts.append(text)
        rows.append((i * 7 % 997, text, "en", i))
    return [*rows, (5000, None, None, None), (5001, "", "en", 1), (5002, " \n\t ", "en", 2), (5003, "Word " * 3000, "en", 3), (None, "only this row has no id at all", "en", 4)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_words_agree_with_regex():
    texts = ["Ab c\td  éx", "", None, "ab C d", "x\x0by\x1cz\x85 q", "   "]
    got = [[] for _ in texts]
    for s in word_slices(pa.array(texts), False, most=5):
        for d, a, b in zip(s.doc, s.starts, s.ends, strict=True):
            got[s.first + d].append(bytes(s.data[a:b]).decode())
    assert got == [WORD.findall(t or "") for t in texts]
    same = hash_words(np.frombuffer(b"ab cd ab", np.uint8))[2]
    assert same[0] == same[2] != same[1]


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def components_by_force(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return {(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)}


def test_ngram_join_against_all_pairs(docs, rows):
    assert {tuple(r) for r in ngram_join.join(docs).collect()} == components_by_force(rows)
    kept = ngram_join.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for d, _, c in components_by_force(rows) if d is not None})


def test_ngram_join_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(90)] = f"x{i}-{rng.random()}"
        rows.append((i, " ".join(words), "en", 0))
    assert {tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()} == components_by_force(rows)


def test_fragment_counts_leave_an_equal_fragment():
    for low, high, count in ngram_join.classes(30_000):
        for s in {low, high - 1}:
            worst = max((s + t - 2 * -(-85 * (s + t) // 185) for t in range(s, 100 * s // 85 + 1) if -(-85 * (s + t) // 185) <= s), default=0)
            assert worst <= ngram_join.most_difference(s) < count


def removed_by_force(rows):
    first, words = {}, [WORD.findall(r[1] or "") for r in rows]
    order = [r[0] if r[0] is not None else math.inf for r in rows]
    for d, w in zip(order, words, strict=True):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, math.inf), d)
    out = set()
    for (doc, *_), d, w in zip(rows, order, words, strict=True):
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.add((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings_against_all_windows(docs, rows):
    assert {tuple(r) for r in substrings.digests(docs).collect()} == removed_by_force(rows)
    out = substrings.dedup(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_difference_cover():
    cover = set(substrings.COVER)
    for a in range(7):
        for b in range(7):
            assert any((a + k) % 7 in cover and (b + k) % 7 in cover for k in range(7))


def test_decontamination(spark, docs, rows):
    rng = random.Random(5)
    item = [f"q{i}" for i in range(30)]
    worn = list(item)
    for i in (4, 11, 19, 26):
        worn[i] = "swapped"
    planted = [(9001, "before it " + " ".join(item) + " after", "en", 0), (9002, "x y z " + " ".join(worn), "en", 0), (9003, " ".join(item[:6]) + " then nothing alike", "en", 0), (9004, "Tiny test item here now", "en", 0)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "tiny TEST item here now"), (5, "a b")], "item_id long, text string")
    both = docs.unionByName(spark.createDataFrame(planted, SCHEMA))
    found = {(r.doc_id, r.item_id): (r.n_matched, r.n_run) for r in decontaminate.overlaps(both, bench).collect()}
    assert set(found) == {(9001, 1), (9002, 1), (9004, 4)}
    assert found[9001, 1] == (30, 30) and found[9002, 1][0] >= 20
    clean = decontaminate.clean(both, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) + 1
    assert decontaminate.overlaps(both, bench.where("false")).count() == 0 and rng


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"k{i}-{j}" for j in range(20))) for i in range(9)], "item_id long, text string")
    texts = spark.createDataFrame([(100 + i, "u v " + " ".join(f"k{i}-{j}" for j in range(20)), "en", 0) for i in range(9)], SCHEMA)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(texts, bench).collect()} == {(100 + i, i) for i in range(9)}


TOKENIZER = "word_bpe_49k.json"
ODD = ["<|endoftext|>hi<|startoftext|> x", "it's he'll Σίσυφος ΣΑΣ İstanbul", "áë 가", "日本語テキスト🎉🎉", "x\x85y\xa0z\x1cw q", "​﻿ab", "a" * 3000, "abcab" * 900, "!?" * 2000, "ǅ ß ẞ ŉ", "०१२ ½ ²", "", "   ", "'S 'RE don'T", "\x00\x01 \x7f", "<|endof", "thththth" * 700, "word " * 20_000]


def test_bpe_equals_the_library(spark, docs, rows):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(bpe.tokenizer_path(TOKENIZER))
    lib.no_truncation()
    lib.no_padding()
    odd = [(20_000 + i, t, "en", 0) for i, t in enumerate(ODD)]
    got = {r.doc_id: r for r in bpe.encode_decode(docs.unionByName(spark.createDataFrame(odd, SCHEMA)), keep_ids=True).collect()}
    for doc_id, text, *_ in [*rows, *odd]:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        r = got[doc_id]
        packed = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, bytes(r.ids)) == (len(ids), hashlib.sha256(packed).hexdigest(), packed), text
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), text


def test_bpe_streams_in_constant_memory():
    tok = bpe.load(bpe.tokenizer_path(TOKENIZER))
    held = []
    out = []
    for i, token in enumerate(tok.merges.stream(_watched(tok.symbols("abcdefghij" * 4000), held))):
        out.append(token)
        held.append(None)
    assert b"".join(t.to_bytes(4, "little") for t in out) == tok.word("abcdefghij" * 4000)
    waiting, most = 0, 0
    for x in held:
        waiting = 0 if x is None else waiting + 1
        most = max(most, waiting)
    assert most <= 8 * tok.merges.lookahead


def _watched(symbols, held):
    for s in symbols:
        held.append(s)
        yield s


def test_bpe_text_decoder_holds_back_incomplete_characters():
    tok = bpe.load(bpe.tokenizer_path(TOKENIZER))
    ids = b"".join(tok.encode("café 🎉 ok"))
    d = bpe.Decoder(tok)
    tok.joined, was = False, tok.joined
    try:
        text = "".join(d.feed(ids[i : i + 4]) for i in range(0, len(ids), 4)) + d.close()
    finally:
        tok.joined = was
    assert text == "café 🎉 ok "


def labelled(spark, seed=2, n=400):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        toxic, junk = i % 4 == 0, i % 5 == 0
        words = [rng.choice(["the", "and", "river", "stone", "glass", "window", "trash", "can"][: 8 if i % 7 else 6]) if rng.random() < 0.9 else f"r{rng.randrange(500)}" for _ in range(rng.randint(20, 200))]
        words = [w for w in words if w not in ("trash", "can")] or ["the"]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "IDIOT!", "1diot", "ıdıot", "m0ron", "moron", "morοn", "scum"])
        elif i % 3 == 0:
            words += ["harmless", "scum"] if i % 6 == 0 else []
        if junk:
            words = [w + rng.choice(["###", "$$$", "***"]) for w in words]
        texts.append((i, " ".join(words), "en", 0))
        labels.append((i, int(not junk), int(toxic)))
    texts += [(n, None, None, None), (n + 1, "", "en", 0), (None, "the river", "en", 0)]
    return spark.createDataFrame(texts, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (n + 2, None, None)], "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column):
    both = scored.where("held_out").join(labels, "doc_id").select("predicted", column).collect()
    return sum(r[0] == r[1] for r in both) / len(both)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    scored = toxicity.classify(docs, labels)
    assert accuracy(scored, labels, "toxic") >= 0.95
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == 403 and rows[400].score == rows[401].score == 0 and all(0 <= r.score <= 1 for r in rows.values())
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"null") % 5 == 0)
    lexicon = toxicity.learn(docs, labels, "toxic", crc_part(5) != 0)
    kept = toxicity.harmless(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows.values())
    assert toxicity.classify(docs, labels.where("false")).where("score > 0").count() == 0


def test_toxicity_folding_and_exceptions():
    assert toxicity.fold("IDіОT mör0n tr@sh wow!! 2024") == "idiot moron trash wow!! 2024"
    lexicon = toxicity.Lexicon({"trash": 3.0}, ["trash can"])
    a = lexicon.automaton()
    assert toxicity.matched(a, "the trash can") == (0.0, 0) and toxicity.matched(a, "trash, trashy trash") == (6.0, 2)


def test_quality_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    scored = quality.classify(docs, labels)
    assert accuracy(scored, labels, "quality") >= 0.95
    assert scored.count() == 403 and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}


def test_quality_scores_are_sums_of_tables(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction only
    model = quality.fit(x, y)
    assert ((model.predict(x) >= 0.5) == y).mean() > 0.9 and model.pairs
    for row, odds in zip(x[:200].tolist(), model.log_odds(x[:200]).tolist(), strict=True):  # one value of each table, by plain counting
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.intercept + sum(table[b] for table, b in zip(model.tables, bins, strict=True))
        total += sum(table[bins[j] * quality.COARSE // (len(model.edges[j]) + 1)][bins[k] * quality.COARSE // (len(model.edges[k]) + 1)] for j, k, table in model.pairs)
        assert abs(total - odds) < 1e-9


def test_trees_are_the_best_of_all_cuts():
    rng = np.random.default_rng(1)

    def worth(g, h, cuts):  # of leaves between cuts
        return sum(g[a:b].sum() ** 2 / (h[a:b].sum() + quality.LEAST) for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True))

    for _ in range(40):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        table = quality.step_tree(g, h, 2)
        best = max(range(1, 9), key=lambda m: worth(g, h, [m]))
        if worth(g, h, [best]) > worth(g, h, []) + 1e-9:
            assert np.allclose(table[:best], g[:best].sum() / (h[:best].sum() + quality.LEAST)) and np.allclose(table[best:], g[best:].sum() / (h[best:].sum() + quality.LEAST))
        gs, hs = rng.normal(size=(4, 4)), rng.random((4, 4)) + 0.1
        found, gain = quality.pair_tree(gs, hs)
        tries = [0.0]
        for a, b in ((gs, hs), (gs.T, hs.T)):
            for m in range(1, 4):
                tries.append(sum(float((quality.step_tree(x.sum(0), y.sum(0), 2) * x.sum(0)).sum()) for x, y in ((a[:m], b[:m]), (a[m:], b[m:]))))
        assert abs(gain - max(tries)) < 1e-9 and found.shape == (4, 4)


def test_pitman_yor(spark, docs, rows):
    got = pitman_yor.score(docs).collect()
    tokens = [(r[0], [*WORD.findall((r[1] or "").translate(FOLD)), None]) for r in rows]
    held = lambda d: zlib.crc32(b"null" if d is None else str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    expect = sorted((str(d), len(ws), sum(c[w] > 0 for w in ws), held(d), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.held_out, r.train_tokens, round(r.base_score, 6)) for r in got) == expect
    assert all(r.score < 0 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    again = {(r.doc_id, r.n_tokens): r.score for r in pitman_yor.score(docs).collect()}
    assert pitman_yor.score(docs.where("false")).count() == 0 and len(again) == len({(r.doc_id, r.n_tokens) for r in got})


def test_pitman_yor_seating_keeps_customers():
    rng = np.random.default_rng(1)
    n = 200
    count = rng.integers(2, 30, n)
    state = {"context": rng.integers(0, pitman_yor.CONTEXTS, n), "count": count, "hot": np.full(n, -1), "word": np.arange(n) % 50, "single": np.ones(50, np.int64), "size": count.copy(), "pair": np.arange(n)}
    total = {"customers": np.bincount(state["context"], count, pitman_yor.CONTEXTS).astype(np.int64), "tables": np.bincount(state["context"], minlength=pitman_yor.CONTEXTS), "heads": np.array([50, 20, 30, 10, 50, int(count.sum())])}
    pitman_yor.seat(state, pitman_yor.Model(total, 0), [1, 2])
    assert (np.bincount(state["pair"], state["size"], n) == count).all() and (state["size"] > 0).all()
    assert len(state["size"]) > n  # some pairs have several tables


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 200 + "é</p>"
    pages = [(3, "http://a/ b", long), (1, None, long), (2, "http://c", None), (4, "http://d", ""), (5, "u", "short"), (6, "u", "short"), (7, "http://e", long + "!"), (None, "http://f", long), (1, "again", long), (9, "http://z", "y" * 3_000_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    got = warc.round_trip(df).collect()
    first = {hashlib.sha256(long.encode()).hexdigest(): 1}
    expect = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        to = first.get(d) if page_id != first.get(d) else None
        expect.append((page_id, len(raw), d, "revisit" if to else "response", to))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expect))
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_ranges_and_selection(spark, tmp_path):
    assert [g[:2] for g in warc.ranges([(0, 10), (10, 5), (200_000, 7)])] == [(0, 15), (200_000, 200_007)]
    pages = spark.createDataFrame([(i, f"http://{i}", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages, folder)
    some = warc.read(index.where("page_id % 7 = 0"), folder, payloads=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in some} == {i: f"<p>{i}</p>" * 50 for i in range(0, 40, 7)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no, no, no</p>";</script></head><body>
<nav><ul><li><a href=/a>menu, one</a></li></ul></nav><div class="ad banner">Buy, buy, buy now, please, it is cheap.</div>
<article><h1>Head &amp; more</h1><p><b>First  para,\n with commas, and enough words to count.<br><p>Second &eacute; para &lt;b&gt;, long enough too, really.</p>
<aside>side, side, side, side, side, side, side</aside><div class="comments"><p>A reader, who comments, at length, on all of it.</p></div></article>
<form><p>Form text, of some length, to be dropped.</p></form><footer>&copy; foot, note, and so on</footer>"""


def test_html_main_text(spark):
    expect = "Head & more\n\nFirst para, with commas, and enough words to count.\n\nSecond é para <b>, long enough too, really."
    assert html_extract.main_text(PAGE) == expect
    plain = "<div id=wrap><div class=sidebar><p>Side, text, here, with commas, many.</p></div><div class=post><h2>T</h2><p>First para, long enough to count, yes.<p>Second, and more words, still.</div></div>"
    assert html_extract.main_text(plain) == "T\n\nFirst para, long enough to count, yes.\n\nSecond, and more words, still."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>x"), (5, "u", "<div>" * 3000 + "deep text, here it is, long enough"), (6, "u", "<<<>>> & <a"), (1, "u", PAGE)]
    got = html_extract.extract(spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == expect and by[2] == by[3] == "" and "deep text" in by[5]


def test_neighbours_recall_and_cases(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[10:40] = x[10]  # equal vectors
    rows = [(i, x[i].tolist(), 1) for i in range(600)] + [(1000, None, 1), (1050, [0.0] * 24, 1), (1100, [float("nan")] + [1.0] * 23, 1), (1150, [1.0] * 3, 1), (None, [1.0] * 24, 1), (1200, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(600), -s))[:5]
        hit += len(set(best.tolist()) & {v for v, _ in got[q]})
        assert all(abs(score - s[v]) < 1e-9 for v, score in got[q]) and [sc for _, sc in got[q]] == sorted((sc for _, sc in got[q]), reverse=True)
    assert set(got) == set(range(0, 600, 50)) and hit >= 0.9 * 60
    assert ann.search(df.where("vec_id < 3")).count() == 2 and ann.search(df.where("false")).count() == 0


def test_blocks_hold_every_row_once(spark, monkeypatch):
    from evidentia.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 50)
    df = spark.createDataFrame([(i, "x" * (i % 13 * 9) if i % 5 else None, "en", i) for i in range(101)], SCHEMA).repartition(3)
    found = [(r.bid, blocks.load(r.path)) for r in blocks.to_blocks(df).collect()]
    assert len({b for b, _ in found}) == len(found) and sorted(i for _, t in found for i in t.column("doc_id").to_pylist()) == list(range(101))


def test_empty_tables(spark, docs):
    none = docs.where("false")
    _, labels = labelled(spark, n=40)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (ngram_join.join(none), ngram_join.distinct_documents(none), substrings.digests(none), substrings.dedup(none), bpe.encode_decode(none), quality.classify(none, labels), toxicity.classify(none, labels), html_extract.extract(pages)):
        assert df.count() == 0


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "en", 0), (1, text, "en", 0), (2, text, "en", 0), (2, "other words entirely, five", "en", 0)], SCHEMA)
    assert sorted(tuple(r) for r in ngram_join.join(df).collect()) == [(1, 37, 1), (1, 37, 1), (2, 1, 1), (2, 37, 1)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.digests(df).collect())
    assert got == [(1, 40, 0), (1, 40, 0), (2, 4, 0), (2, 40, 40)]
