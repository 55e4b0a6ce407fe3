"""Hierarchical Pitman-Yor bigram model with Gibbs-sampled seating.

Tokens are words (A-Z lower-cased) and one end a text.  Every context, the word
before (or the text's start), has a restaurant, known by the 64-bit hash of the
word.  They all share one parent, the unigram restaurant: each
table of a context is a customer there.  The parent's base is diffuse, so each
known word has one table in it and what is left is the probability of a new word:

    P0(w) = (n_w - d0) / (h0 + n)           P0(new) = (h0 + d0 V) / (h0 + n)
    P(w | u) = (c_uw - d1 t_uw) / (h1 + c_u) + (h1 + d1 T_u) / (h1 + c_u) P0(w)

with c customers and t tables.  Unknown words are one type, so P sums to 1 over
the V known types and the unknown one.  Discounts come from the counts of counts,
strengths are 1.

Gibbs: a round takes every customer of each (context, word) with at least two from
its table once, on average, and seats it again by its conditional probabilities, in
batches where a pair has many.  Key ranges work on their own pairs and exchange the restaurants'
table counts after each round (within a round a range sees its own changes only).
Rounds go on until the number of all tables changes by no more than TOLERANCE of it
(or its square root, the noise of few tables), ROUNDS at most.  The probabilities
of SAMPLES further rounds are averaged, and a text's score is
the sum of the logarithms of those averages; its perplexity is 10 to the power of
minus the score a token.

Data: a block of documents sends its distinct pairs, with their training counts,
to the range of the word's hash, once.  A range keeps which of its pairs each block
sent, and at the end answers with a logarithm (single precision) for each, in the
order sent; the block adds them up over its tokens.  A range of words needs the
table counts of the contexts it has: it asks the range of each context's hash, which
sums what all word ranges have and answers in the order asked.  There are a quarter as
many ranges of contexts as of words, as counts of contexts are far fewer than pairs.
No task or driver holds all contexts.  Words that make up a thousandth of a small random sample
of blocks or more are few; their pairs are spread by word and context, and their
counts are exchanged through the driver.  Counts cover all training texts;
the sample only decides where a pair is counted.

Cases: a null or empty text is its end token; a null id counts as text ``null``
for the held-out rule; repeated rows are scored alike and each count as training;
very long texts are scored whole; without training texts every token is new; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.blocks import light, load, pack, range_bounds, ranges, to_blocks, unpack, with_blocks
from evidentia.shared import keep, release
from evidentia.llm.textblocks import crc_mod, mix, word_slices

ROUNDS, SAMPLES, STEPS, TOLERANCE = 20, 3, 16, 1e-2
CONTEXTS = 1 << 15  # restaurants of the seating test only: the model has one for each context
STRENGTH0 = STRENGTH1 = 1.0
HEAVY_SHARE, SAMPLE_BLOCKS = 1e-3, 4
END, START = np.uint64(0xE4D), np.uint64(0x57A47)
MODULUS, HELD = 7, 2
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


class Tokens:
    """Tokens of a block: word hash, context and document of each."""

    def __init__(self, table: pa.Table):
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s in word_slices(table.column("text"), True):
            at = np.cumsum(s.counts)  # an end after each document's words
            hashes.append(np.insert(s.hashes, at, END))
            docs.append(np.repeat(np.arange(s.n_docs), s.counts + 1) + s.first)
        self.word, self.doc = np.concatenate(hashes), np.concatenate(docs).astype(np.uint16)
        before = np.concatenate([[START], self.word[:-1]]) if len(self.word) else self.word
        before = np.where(np.concatenate([np.ones(min(1, len(self.doc)), bool), self.doc[1:] != self.doc[:-1]]), START, before)
        self.context = mix(before)
        ids = table.column("doc_id").combine_chunks()
        self.doc_ids, self.held = ids, crc_mod(ids, MODULUS) == HELD
        self.train = ~self.held[self.doc] if len(self.doc) else np.zeros(0, bool)

    def routes(self, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key that decides the range (a word, or a heavy word in a context), and the heavy word's number or -1."""
        if not len(heavy):
            return self.word, np.full(len(self.word), -1, np.int16)
        at = np.minimum(np.searchsorted(heavy, self.word), len(heavy) - 1)
        hot = heavy[at] == self.word
        return np.where(hot, mix(self.word + self.context * np.uint64(0x9E3779B97F4A7C15)), self.word), np.where(hot, at, -1).astype(np.int16)

    def pairs(self, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens ordered by key and context, where a new pair begins there, and the pairs' keys and heavy numbers."""
        keys, hot = self.routes(heavy)
        order = np.lexsort((self.context, keys))
        k, x = keys[order], self.context[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (x[1:] != x[:-1])]))
        return order, new, k[new], hot[order][new]


def steps(keys: np.ndarray) -> np.ndarray:
    """1 where a key differs from the one before, else 0."""
    return np.diff(keys, prepend=keys[:1]).astype(bool).astype(np.int64)


def send_pairs(blocks: DataFrame, parts: int, heavy: np.ndarray) -> DataFrame:
    """Distinct (word, context) pairs of each block with their counts in training texts, 0 for those of held-out texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Tokens(load(path))
                order, new, keys, hot = t.pairs(heavy)
                context = t.context[order][new]
                count = np.add.reduceat(t.train[order].astype(np.uint32), new) if len(new) else np.zeros(0, np.uint32)
                cut = range_bounds(keys, parts)
                blobs = []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    step = steps(keys[a:b])
                    first = np.concatenate([[0], np.flatnonzero(step)]) if b > a else np.zeros(0, np.int64)
                    contexts, index = np.unique(context[a:b], return_inverse=True)
                    data = {"keys": keys[a:b][first], "hot": hot[a:b][first], "step": step, "contexts": contexts, "context": index, "count": count[a:b].astype(np.int64)}
                    blobs.append(packed(**data))
                yield pa.RecordBatch.from_pydict({"p": pa.array(range(parts), pa.int32()), "bid": pa.array([bid] * parts, pa.int64()), "data": pa.array(blobs, pa.binary())})

    return blocks.mapInArrow(run, "p int, bid long, data binary")


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays in few bytes: differences where sorted, zigzag where negative, no more bytes a number than the largest has, in planes."""
    columns = {}
    for name, v in arrays.items():
        form, v = v.dtype.kind, np.ascontiguousarray(v)
        if form == "b":
            v = v.view(np.uint8)
        elif form == "f":
            v = v.astype(np.float32).view(np.uint32)
        elif len(v) and (v[1:] >= v[:-1]).all():
            form, v = form + "d", np.concatenate([v[:1], np.diff(v)])
        if form[0] == "i":
            v = v.astype(np.int64)
            v = (v << 1) ^ (v >> 63)
        v = v.astype(np.uint64)
        width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
        columns[f"{name}:{form}:{width}"] = pa.array([v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.ravel()])
    return pack(pa.table(columns))


def fields(value: pa.Scalar | bytes) -> dict[str, np.ndarray]:
    t, found = unpack(value), {}
    for column in t.column_names:
        name, form, width = column.split(":")
        planes = t.column(column)[0].values.to_numpy(zero_copy_only=False).reshape(int(width), -1)
        whole = np.zeros((planes.shape[1], 8), np.uint8)
        whole[:, : int(width)] = planes.T
        v = whole.reshape(-1).view("<u8").astype(np.uint64)
        if form[0] == "i":
            v = (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)
        if form[1:] == "d":
            v = np.cumsum(v, dtype=v.dtype)
        found[name] = v.astype(bool) if form == "b" else v.astype(np.uint32).view(np.float32) if form == "f" else v
    return found


def bins(values: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(values, weights, n).astype(np.int64)


STATE = "p int, kind int, tag long, data binary"  # see KINDS
# seats of a range; sums for the driver; ask: a word range (tag) to a context range; book: contexts whose tables change, and who asked;
# tell: a context range (tag) to a word range; pairs of a range; sent: a block's (tag) pairs there; whole: all contexts of a range, and who asked
SEATS, SUMS, ASK, BOOK, TELL, PAIRS, SENT, WHOLE = range(8)


def state_row(p: int, kind: int, tag: int = 0, **arrays: np.ndarray) -> dict:
    return {"p": p, "kind": kind, "tag": tag, "data": packed(**arrays)}


def state_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("tag", pa.int64()), ("data", pa.binary())]))


def of_kind(table: pa.Table, kind: int) -> list[tuple[int, dict[str, np.ndarray]]]:
    """(tag, fields) of the rows of a kind in the order of tags."""
    rows = table.filter(pa.compute.equal(table.column("kind"), kind)).sort_by("tag")
    return [(tag, fields(v)) for tag, v in zip(rows.column("tag").to_pylist(), rows.column("data"), strict=True)]


CHUNK = 1 << 10  # entries of a vector that travel together; no fewer than there are heavy words


def stat_rows(vectors: dict[str, np.ndarray]) -> list[dict]:
    """Vectors as rows by chunk: summed over ranges by totals()."""
    rows = []
    for i in range(0, max(map(len, vectors.values())), CHUNK):
        rows.append(state_row(i // CHUNK, SUMS, **{k: v[i : i + CHUNK] for k, v in vectors.items()}))
    return rows


def totals(state: DataFrame) -> dict[str, np.ndarray]:
    """Sums of the ranges' vectors; what reaches the driver has the fixed size of the vectors."""

    def add(table: pa.Table) -> pa.Table:
        total: dict[str, np.ndarray] = {}
        for value in table.column("data"):
            for k, v in fields(value).items():
                total[k] = total.get(k, 0) + v
        return state_table([state_row(table.column("p")[0].as_py(), SUMS, **total)])

    rows = state.where(F.col("kind") == SUMS).groupBy("p").applyInArrow(add, STATE).collect()
    parts = [fields(r["data"]) for r in sorted(rows, key=lambda r: r["p"])]
    names = parts[0].keys() if parts else []
    return {k: np.concatenate([p[k] for p in parts]) for k in names}


def heavy_words(blocks: DataFrame) -> np.ndarray:
    """Hashes of the words with at least HEAVY_SHARE of the tokens of some blocks, taken by a hash: no more than 1 / HEAVY_SHARE."""
    first = [r["bid"] for r in blocks.select("bid").orderBy(F.xxhash64("bid"), "bid").limit(SAMPLE_BLOCKS).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(1).to_pylist():
                word, n = np.unique(Tokens(load(path)).word, return_counts=True)
                some = n >= HEAVY_SHARE / SAMPLE_BLOCKS * n.sum()
                yield pa.RecordBatch.from_pydict({"w": pa.array(word[some].view(np.int64)), "n": pa.array(n[some]), "total": pa.array(np.full(some.sum(), n.sum()))})

    rows = blocks.where(F.col("bid").isin(first)).mapInArrow(run, "w long, n long, total long").toArrow()
    if not rows.num_rows:
        return np.zeros(0, np.uint64)
    word, at = np.unique(rows.column("w").to_numpy(), return_inverse=True)
    n = np.bincount(at, rows.column("n").to_numpy())
    total = sum(set(rows.column("total").to_pylist()))
    return np.sort(word[n >= HEAVY_SHARE * total].view(np.uint64))


def padded(values: np.ndarray | list[int]) -> np.ndarray:
    return np.concatenate([np.asarray(values, np.int64), np.zeros(CHUNK - len(values), np.int64)])


def gather(table: pa.Table, n_heavy: int, parts: int) -> pa.Table:
    """First state of a range: its pairs, the seats of those that can have several tables, and what it asks of each context range."""
    p = table.column("p")[0].as_py()
    table = table.sort_by("bid")
    got = [fields(v) for v in table.column("data")]
    words, key = np.unique(np.concatenate([g["keys"] for g in got]), return_inverse=True)
    contexts, own = np.unique(np.concatenate([g["contexts"] for g in got]), return_inverse=True)
    hot = np.full(len(words), -1, np.int64)
    hot[key] = np.concatenate([g["hot"] for g in got])
    width, codes, at_key, at_context = max(1, len(contexts)), [], 0, 0
    for g in got:
        codes.append(key[at_key + np.cumsum(g["step"])] * width + own[at_context + g["context"]])
        at_key, at_context = at_key + len(g["keys"]), at_context + len(g["contexts"])
    pairs, number = np.unique(np.concatenate(codes), return_inverse=True)
    count = bins(number, len(pairs), np.concatenate([g["count"] for g in got]))
    word, context = pairs // width, pairs % width
    rows, at = [], 0
    for bid, c in zip(table.column("bid").to_pylist(), codes, strict=True):
        rows.append(state_row(p, SENT, bid, pair=number[at : at + len(c)]))
        at += len(c)
    rows.append(state_row(p, PAIRS, count=count, word=word, context=context, hot=hot))
    many, known = count > 1, count > 0
    used, local = np.unique(word[many], return_inverse=True)
    moving, place = np.unique(context[many], return_inverse=True)
    rows.append(state_row(p, SEATS, context=place, count=count[many], hot=hot[word][many], word=local, single=bins(word[count == 1], len(words))[used], size=count[many], pair=np.arange(many.sum())))
    customers, tables = bins(context, len(contexts), count), bins(context[known], len(contexts))
    moves = np.zeros(len(contexts), bool)
    moves[moving] = True
    cut = range_bounds(contexts, max(1, parts // 4))
    for q, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if b > a:
            rows.append(state_row(q, ASK, p, keys=contexts[a:b], customers=customers[a:b], tables=tables[a:b], moves=moves[a:b]))
    per_word = bins(word[known], len(words))  # pairs of each word: its customers at the parent, at first
    cold_words, warm = per_word[hot < 0], hot >= 0
    heads = [(count == 1).sum(), (count == 2).sum(), (cold_words == 1).sum(), (cold_words == 2).sum(), (cold_words > 0).sum(), count.sum(), known.sum()]
    vectors = {"heads": padded(heads), "heavy_count": padded(bins(hot[warm], n_heavy, bins(word, len(words), count)[warm])), "heavy_tables": padded(bins(hot[warm], n_heavy, per_word[warm]))}
    return state_table([*rows, *stat_rows(vectors)])


def tell(q: int, src: np.ndarray, n: np.ndarray, index: np.ndarray, **columns: np.ndarray) -> list[dict]:
    """To each word range, the values of the contexts it asked about."""
    ends = np.cumsum(n)
    return [state_row(p, TELL, q, **{k: v[index[e - m : e]] for k, v in columns.items()}) for p, m, e in zip(src.tolist(), n.tolist(), ends.tolist(), strict=True) if m]


def book(table: pa.Table) -> pa.Table:
    """A context range's books from what all word ranges have, and the first answers."""
    q, asked = table.column("p")[0].as_py(), of_kind(table, ASK)
    keys, at = np.unique(np.concatenate([f["keys"] for _, f in asked]), return_inverse=True)
    customers, tables = (bins(at, len(keys), np.concatenate([f[c] for _, f in asked])) for c in ("customers", "tables"))
    moves = np.concatenate([f["moves"] for _, f in asked])
    moving, src = np.unique(at[moves]), np.array([p for p, _ in asked])
    n, n_moving = (np.array([f(x["moves"]) for _, x in asked], np.int64) for f in (len, np.sum))
    index = np.searchsorted(moving, at[moves])
    whole = state_row(q, WHOLE, src=src, n=n, index=at, customers=customers, tables=tables, moving=moving)
    return state_table([whole, state_row(q, BOOK, src=src, n=n_moving, index=index, tables=tables[moving]), *tell(q, src, n_moving, index, tables=tables[moving])])


def change(table: pa.Table) -> pa.Table:
    """The books after a round, and answers for the next."""
    q, (_, b) = table.column("p")[0].as_py(), of_kind(table, BOOK)[0]
    deltas = [f["delta"] for _, f in of_kind(table, ASK)]
    b["tables"] = b["tables"] + bins(b["index"], len(b["tables"]), np.concatenate([np.zeros(0, np.int64), *deltas]))
    return state_table([state_row(q, BOOK, **b), *tell(q, b["src"], b["n"], b["index"], tables=b["tables"])])


def last(table: pa.Table) -> pa.Table:
    """Customers of all contexts that word ranges asked about, and their tables in each sample."""
    q, (_, w) = table.column("p")[0].as_py(), of_kind(table, WHOLE)[0]
    columns = {"customers": w["customers"]}
    for number, b in of_kind(table, BOOK):
        columns[f"tables{number}"] = w["tables"].copy()
        columns[f"tables{number}"][w["moving"]] = b["tables"]
    return state_table(tell(q, w["src"], w["n"], w["index"], **columns))


class Model:
    """Tables of a range's restaurants, and what all ranges share: discounts, all tables, and heavy words."""

    def __init__(self, t: dict[str, np.ndarray], n_heavy: int):
        zero = np.zeros(CHUNK, np.int64)
        self.tables = t.get("tables", zero)
        self.heavy_count, self.heavy_tables = t.get("heavy_count", zero)[:n_heavy], t.get("heavy_tables", zero)[:n_heavy]
        heads = t.get("heads", zero)
        n1, n2, w1, w2, words, self.train_tokens = (int(x) for x in heads[:6])
        self.all_tables = int(heads[6] if len(heads) > 6 else self.tables.sum())
        self.types = words + int((self.heavy_count > 0).sum())
        self.discount1, self.discount0 = self.discount(n1, n2), self.discount(w1, w2)

    @staticmethod
    def discount(ones: int, twos: int) -> float:
        return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5

    def parent(self) -> float:
        return STRENGTH0 + float(self.all_tables)


def seat(s: dict[str, np.ndarray], model: Model, seed: list[int]) -> None:
    """A sweep: every customer is taken away and seated again once, on average; ``s`` changes in place.

    In each of STEPS steps a pair of at most STEPS customers moves one (as many steps
    as it has customers), a larger one each customer with probability 1 / STEPS.  Those
    that move together don't see each other, nor what other pairs do in the step.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    count, n = s["count"], len(s["count"])
    if not n:
        return
    d1, d0 = model.discount1, model.discount0
    in_context, at_word, at_hot = model.tables.copy(), s["single"] + bins(s["word"][s["pair"]], len(s["single"])), model.heavy_tables.copy()
    size, pair, act = s["size"], s["pair"], np.arange(n)
    done = []
    for step in range(STEPS):
        on = count[act] > step
        if not on.all():
            mine = on[pair]
            done.append((size[~mine], act[pair[~mine]]))
            size, pair, act = size[mine], (np.cumsum(on) - 1)[pair[mine]], act[on]
        if not len(act):
            break
        c, context, word, hot = (s[x][act] for x in ("count", "context", "word", "hot"))
        is_hot = hot >= 0
        out, ends = np.zeros(len(size), np.int64), np.cumsum(c)
        large = (c > STEPS)[pair]
        out[large] = rng.binomial(size[large], 1 / STEPS)
        few = np.flatnonzero(c <= STEPS)
        out[np.searchsorted(np.cumsum(size), ends[few] - 1 - np.minimum((rng.random(len(few)) * c[few]).astype(np.int64), c[few] - 1), "right")] += 1
        moved, size = bins(pair, len(act), out), size - out
        stay = size > 0
        gone = bins(pair[~stay], len(act))
        size, pair = size[stay], pair[stay]
        left = bins(pair, len(act))
        at_parent = at_word[word]
        if is_hot.any():
            at_parent = np.where(is_hot, at_hot[np.maximum(hot, 0)], at_parent)
        fresh = (STRENGTH1 + d1 * (in_context[context] - gone)) * np.maximum(at_parent - gone - d0, 1e-9) / model.parent()
        seated = c - moved - d1 * left
        opens = rng.binomial(moved, np.where(left > 0, fresh / (np.maximum(seated, 0) + fresh), 1.0))
        # the others go to the pair's tables, one table after the other
        back, rest, weight, first = moved - opens, seated.copy(), size - d1, np.cumsum(left) - left
        todo, r = np.flatnonzero(back), 0
        while len(todo):
            row = first[todo] + r
            x = rng.binomial(back[todo], np.where(left[todo] == r + 1, 1.0, np.clip(weight[row] / np.maximum(rest[todo], 1e-9), 0, 1)))
            size[row] += x
            back[todo] -= x
            rest[todo] -= weight[row]
            todo, r = todo[back[todo] > 0], r + 1
        more = opens - gone
        in_context += bins(context, len(in_context), more)
        at_word += bins(word, len(at_word), more)
        if is_hot.any():
            at_hot += bins(hot[is_hot], len(at_hot), more[is_hot])
        size, pair = np.concatenate([size, np.ones(opens.sum(), np.int64)]), np.concatenate([pair, np.repeat(np.arange(len(act)), opens)])
        order = np.argsort(pair, kind="stable")
        size, pair = size[order], pair[order]
    done.append((size, act[pair]))
    size, pair = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(pair, kind="stable")
    s["size"], s["pair"] = size[order], pair[order]


def steady(total: dict[str, np.ndarray], moved: dict[str, np.ndarray]) -> bool:
    """Whether a round changed the number of all tables by little."""
    if not moved:
        return True
    tables, change = int(total["heads"][6]), abs(int(moved["heads"][6]))
    return change <= max(TOLERANCE * tables, tables**0.5)


def reseat(table: pa.Table, total: dict[str, np.ndarray], n_heavy: int, number: int) -> pa.Table:
    """A round of one range: new seating, and by how much tables changed."""
    p, (_, s) = table.column("p")[0].as_py(), of_kind(table, SEATS)[0]
    told = of_kind(table, TELL)
    n = sum(len(f["tables"]) for _, f in told)

    def tables() -> tuple[np.ndarray, np.ndarray]:
        hot = s["hot"][s["pair"]]
        return bins(s["context"][s["pair"]], n), bins(hot[hot >= 0], n_heavy)

    was, heavy_was = tables()
    seat(s, Model(total | {"tables": np.concatenate([np.zeros(0, np.int64), *[f["tables"] for _, f in told]])}, n_heavy), [p, number])
    now, heavy_now = tables()
    rows, at = [state_row(p, SEATS, **s)], 0
    for q, f in told:
        m = len(f["tables"])
        rows.append(state_row(q, ASK, p, delta=(now - was)[at : at + m]))
        at += m
    return state_table([*rows, *stat_rows({"heads": padded([0] * 6 + [(now - was).sum()]), "heavy_tables": padded(heavy_now - heavy_was)})])


def answer(table: pa.Table, samples: list[Model]) -> pa.Table:
    """Of one range: the logarithm of each pair that a block sent, and the customers of each of its words."""
    p, (_, t) = table.column("p")[0].as_py(), of_kind(table, PAIRS)[0]
    told = [f for _, f in of_kind(table, TELL)]
    seats = [f for _, f in of_kind(table, SEATS)]
    of = {c: np.concatenate([f[c] for f in told]) for c in told[0]}
    word, c, u = t["word"], t["count"], t["context"]
    words, hot = len(t["hot"]), t["hot"][word]
    many, is_hot = c > 1, hot >= 0
    prob, single = np.zeros(len(c)), bins(word[c == 1], words)
    for number, (model, s) in enumerate(zip(samples, seats, strict=True)):
        tables = (c > 0).astype(np.int64)
        tables[many] = bins(s["pair"], int(many.sum()))
        at_parent = (single + bins(word, words, tables * many))[word]
        if len(model.heavy_tables):
            at_parent = np.where(is_hot, model.heavy_tables[np.maximum(hot, 0)], at_parent)
        new = STRENGTH0 + model.discount0 * model.types
        parent = np.where(at_parent > 0, at_parent - model.discount0, new) / model.parent()
        prob += (c - model.discount1 * tables + (STRENGTH1 + model.discount1 * of[f"tables{number}"][u]) * parent) / (STRENGTH1 + of["customers"][u])
    log = np.log10(prob / len(samples)).astype(np.float32)
    total = bins(word, words, c)[word]
    if len(samples[-1].heavy_count):
        total = np.where(is_hot, samples[-1].heavy_count[np.maximum(hot, 0)], total)
    out: dict[str, list] = {"bid": [], "data": []}
    for bid, f in of_kind(table, SENT):
        own = f["pair"]
        out["bid"].append(bid)
        first = np.flatnonzero(np.diff(word[own], prepend=-1))
        out["data"].append(packed(log=log[own], total=total[own][first]))
    return pa.table({"bid": pa.array(out["bid"], pa.int64()), "p": pa.array([p] * len(out["bid"]), pa.int32()), "data": pa.array(out["data"], pa.binary())})


def score(documents: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    spark, parts = documents.sparkSession, ranges(documents)
    blocks = to_blocks(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"))
    heavy = heavy_words(blocks)
    n_heavy = len(heavy)

    def by_range(rows: DataFrame, work) -> DataFrame:
        # by number: packed rows are far smaller than the work they ask for
        return rows.repartition(parts, "p").groupBy("p").applyInArrow(light(work), STATE)

    def kind(rows: DataFrame, *kinds: int, tag: int | None = None) -> DataFrame:
        some = rows.where(F.col("kind").isin(*kinds))
        return some if tag is None else some.withColumn("tag", F.lit(tag).cast("long"))

    def free() -> None:  # what the first call lets go of is only cleaned by the second
        release(spark)
        release(spark)

    first = keep(by_range(send_pairs(blocks, parts, heavy), lambda t: gather(t, n_heavy, parts)))
    total = totals(first)
    contexts = max(1, parts // 4)  # ranges of contexts
    books = keep(by_range(kind(first, ASK), book).coalesce(contexts))
    free()
    state, register, models, seats, registers = first, books, [], [], []
    number, settled = 0, False
    while len(models) < SAMPLES:
        now = dict(total)
        state = keep(by_range(kind(state, SEATS).unionByName(kind(register, TELL)), lambda t, now=now, number=number: reseat(t, now, n_heavy, number)))
        register = keep(by_range(kind(register, BOOK).unionByName(kind(state, ASK)), change).coalesce(contexts))
        moved = totals(state)
        for k, v in moved.items():
            total[k] = total[k] + v
        free()
        number += 1
        if settled:
            seats.append(kind(state, SEATS, tag=len(models)))
            registers.append(kind(register, BOOK, tag=len(models)))
            models.append(Model(total, n_heavy))
        settled = settled or number >= ROUNDS or steady(total, moved)
    ends, rows = kind(books, WHOLE), kind(first, PAIRS, SENT)
    for r, s in zip(registers, seats, strict=True):
        ends, rows = ends.unionByName(r), rows.unionByName(s)
    rows = rows.unionByName(by_range(ends, last))
    answers = rows.groupBy("p").applyInArrow(light(lambda t: answer(t, models)), "bid long, p int, data binary")
    train_tokens, types = models[-1].train_tokens, models[-1].types

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        t, got = Tokens(table), [fields(v) for v in told.column("data")]
        order, new, keys, _ = t.pairs(heavy)
        number = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        log, total = (np.concatenate([f[c] for f in got]) for c in ("log", "total"))
        total = total[np.cumsum(steps(keys))][number] if len(number) else total
        log, doc, n = log[number].astype(np.float64), t.doc[order], len(t.held)
        tokens = np.bincount(doc, minlength=n)
        base = np.bincount(doc, np.log10(total + 1), n) - tokens * np.log10(train_tokens + types + 1)
        score = np.bincount(doc, log, n)
        perplexity = 10 ** np.minimum(-score / np.maximum(tokens, 1), 300)
        return pa.table({"doc_id": t.doc_ids, "held_out": pa.array(t.held), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(np.bincount(doc, total > 0, n).astype(np.int64)), "train_tokens": pa.array(np.full(n, train_tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score), "perplexity": pa.array(perplexity)})

    return with_blocks(blocks, answers, finish, SCHEMA)
