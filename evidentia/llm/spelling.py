"""Spelling variants: words one edit apart by two-dimensional range reporting.

Two words of equal length that differ in position i share the prefix before it and the
suffix after it; a word and one that is longer by a letter inserted at i share the prefix
before and the suffix from i on.  Over a set of words of one length, ranks in forward
order and ranks in reverse order are a set of points, and the words with a prefix and a
suffix are the points in a rectangle: the prefix's interval in forward order times the
suffix's interval in reverse order.  A wavelet tree over the reverse ranks, in forward
order, reports them; all rectangles of a set of words go down the tree together.

An insertion that several positions explain counts at the last of them alone, so every
pair is found at one position and once.

The vocabulary is dealt into groups that hold whole rectangles.  A group is named by the
length of its shorter words, a range of positions, and what its words hold outside that
range: at first the positions of the left half (words with one right half) and of the
right half (words with one left half).  Groups of over ``MOST`` words are dealt anew by
halves of their range until none is left: with a range of one position a group has no more
words than the alphabet has pairs of letters, which is less than ``MOST``.  So no group
grows with the input, whatever prefix or ending words share.  Pairs never become rows; a
group returns each word's number of near words and its best one, and sums and maxima of
those are taken over the groups.

Words: maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased.
With h the crc32 of ``<doc_id>:<run>``, a run loses its code point h modulo its length if
31 divides h.  What then has ``SHORTEST`` code points and occurs ``LEAST`` times is a word.

Cases: a null or empty text has no words; a null doc_id counts as the text ``null``; words of
any length and texts of any length are taken whole; repeated rows count as often as they
occur; of near words with equally many occurrences the smallest in code-point order is the
form; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.blocks import ranges, tidy
from evidentia.shared import keep

RUN = r"[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST, DAMAGED, TIMES = 7, 2, 31, 10
LETTERS = 26 + 64  # after lower-casing
MOST = 2 * (LETTERS**2 + LETTERS)  # words of a group
BATCH_BYTES = 4 << 20  # of the words that are worked on at once, if no group is larger
MARK = "\x00"


def vocabulary(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of all texts."""
    runs = documents.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("own"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= SHORTEST)
    h = F.crc32(F.concat_ws(":", "own", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DAMAGED == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)


class WaveletTree:
    """A permutation of 0 .. n - 1, one bit vector with counts for each binary digit of its values."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.digits = max(1, int(self.n - 1).bit_length())
        self.zeros_before, self.zeros = [], []
        for digit in range(self.digits - 1, -1, -1):
            bit = (values >> digit) & 1
            self.zeros_before.append(np.concatenate([[0], np.cumsum(bit == 0)]))
            self.zeros.append(int(self.zeros_before[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [least, most) at positions in [low, high) of each query."""
        query = np.arange(len(low))
        value = np.zeros(len(low), np.int64)  # the digits so far
        for level in range(self.digits):
            size = 1 << (self.digits - 1 - level)
            before = self.zeros_before[level]
            left_low, left_high = before[low], before[high]
            right_low, right_high = low - left_low + self.zeros[level], high - left_high + self.zeros[level]
            go_left = (left_low < left_high) & (value < most[query]) & (value + size > least[query])
            go_right = (right_low < right_high) & (value + size < most[query]) & (value + 2 * size > least[query])
            low, high = np.concatenate([left_low[go_left], right_low[go_right]]), np.concatenate([left_high[go_left], right_high[go_right]])
            value = np.concatenate([value[go_left], value[go_right] + size])
            query = np.concatenate([query[go_left], query[go_right]])
        return query, value


class Order:
    """Words of two lengths in one order, and the interval of any leading part."""

    def __init__(self, group: np.ndarray, letters: np.ndarray, short: np.ndarray):
        head = np.ascontiguousarray(group.astype(">i8")).view(np.uint8).reshape(-1, 8)
        self.rows = np.concatenate([head, letters], axis=1)
        self.order = np.argsort(np.ascontiguousarray(self.rows).view(f"S{self.rows.shape[1]}").ravel(), kind="stable")
        ranked = self.rows[self.order]
        same = np.concatenate([ranked[1:] == ranked[:-1], np.zeros((len(ranked) - 1, 1), bool)], axis=1)
        self.common = np.concatenate([[0], same.argmin(axis=1)])  # leading bytes shared with the one before
        is_short = short[self.order]
        self.before = {True: np.concatenate([[0], np.cumsum(is_short)]), False: np.concatenate([[0], np.cumsum(~is_short)])}
        self.rank = np.empty(len(group), np.int64)
        self.rank[self.order] = np.arange(len(group))

    def interval(self, depth: int, words: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """Among the short or the long words alone: where those with the same first ``depth`` letters as each word begin and end."""
        begins = np.flatnonzero(self.common < depth + 8)
        which = np.searchsorted(begins, self.rank[words], "right") - 1
        ends = np.append(begins, len(self.rank))
        count = self.before[short]
        return count[ends[which]], count[ends[which + 1]]


def near_pairs(group: np.ndarray, words: list[bytes], length: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of numbers of near words that differ at a position in [first, last), each pair in both directions.

    The words have ``length`` or one more letter, as Latin-1; only those of one group are compared.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    short = sizes == length
    flat = np.frombuffer(b"".join(w if len(w) > length else w + b"\0" for w in words), np.uint8).reshape(-1, length + 1)
    back = flat[:, ::-1].copy()
    back[short] = np.concatenate([back[short][:, 1:], np.zeros((int(short.sum()), 1), np.uint8)], axis=1)
    forward, reverse = Order(group, flat, short), Order(group, back, short)
    queries = np.flatnonzero(short)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for kind in (True, False):  # replaced letters among the short words, inserted ones among the long
        ranked = forward.order[short[forward.order] == kind]
        if not len(ranked) or not len(queries):
            continue
        by_reverse = reverse.order[short[reverse.order] == kind]
        place = np.empty(len(words), np.int64)
        place[by_reverse] = np.arange(len(by_reverse))
        tree = WaveletTree(place[ranked])
        for i in range(first, min(last, length if kind else length + 1)):
            low, high = forward.interval(i, queries, kind)
            least, most = reverse.interval(length - i - 1 if kind else length - i, queries, kind)
            some = (high - low > kind) & (most - least > kind)  # a word is in its own rectangle
            at, found = tree.report(low[some], high[some], least[some], most[some])
            a, b = queries[some][at], by_reverse[found]
            if kind:
                a, b = a[a != b], b[a != b]
                left.append(a), right.append(b)
            else:
                # the last position that explains the insertion: the inserted letter isn't followed by itself
                real = flat[b, i] != flat[a, i]
                a, b = a[real], b[real]
                left += [a, b]
                right += [b, a]
    return np.concatenate(left), np.concatenate(right)


def best_of(a: np.ndarray, b: np.ndarray, words: list[bytes], n: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(word, number of near words, the near word of largest n, of those the smallest)."""
    if not len(a):
        return
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    begins = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    yield from zip(a[begins].tolist(), np.diff(np.append(begins, len(a))).tolist(), b[begins].tolist(), strict=True)


#: length of the shorter words, range of positions, what lies outside it
KEY = ["len", "first", "last", "outside"]


def dealt(rows: DataFrame, first, last) -> DataFrame:
    """Rows (len, word, n) with the group of a range of positions; what lies outside is kept as its hash."""
    longer = F.length("word") - F.col("len")
    tail = F.col("word").substr((last + longer + 1).cast("int"), F.length("word"))
    outside = F.xxhash64(F.concat(F.col("word").substr(F.lit(1), first), F.lit(MARK), tail))
    return rows.select("len", first.cast("int").alias("first"), last.cast("int").alias("last"), outside.alias("outside"), "word", "n")


def groups(words: DataFrame, most: int = MOST) -> DataFrame:
    """(len, first, last, outside, word, n): the words in groups of at most ``most``, in which near words meet at their position."""
    size = F.length("word")
    # each word as one of the shorter and as one of the longer words
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("len"))
    half = F.floor(F.col("len") / 2).cast("int")
    rows = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = dealt(rows, F.when(F.col("side") == 0, 0).otherwise(half), F.when(F.col("side") == 0, half).otherwise(F.col("len") + 1))
    done = []
    while True:
        large = keep(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("in_group")).where((F.col("in_group") > most) & (F.col("last") - F.col("first") > 1)).drop("in_group"))
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, KEY, "left_anti"))
        again = rows.join(large, KEY, "left_semi").withColumnRenamed("first", "f").withColumnRenamed("last", "l").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        middle = F.floor((F.col("f") + F.col("l")) / 2).cast("int")
        rows = keep(dealt(again, F.when(F.col("side") == 0, F.col("f")).otherwise(middle), F.when(F.col("side") == 0, middle).otherwise(F.col("l"))))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


PARTIAL = "word string, n long, n_near long, best_n long, best string"


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, n_near, best_n, best) of all words (word, n)."""

    def solve(key: tuple[int, int, int], outside: list[int], texts: list[str], counts: list[int]) -> pa.RecordBatch | None:
        words_, n = [t.encode("latin-1") for t in texts], np.array(counts, np.int64)
        a, b = near_pairs(np.array(outside, np.int64), words_, *key)
        rows = list(best_of(a, b, words_, n))
        if not rows:
            return None
        of, near, best = zip(*rows, strict=True)
        columns = [[texts[k] for k in of], [counts[k] for k in of], near, [counts[k] for k in best], [texts[k] for k in best]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, ([], [], []), 0  # outside, words, counts of whole groups of one length and range
        alone: list | None = []  # the group that is being read
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for length, first, last, outside, word, n in zip(*columns, strict=True):
                mine = (length, first, last)
                if alone and (mine != key or outside != alone[0][0]):
                    if len(alone) > 1:  # else nothing is near in it
                        for row in alone:
                            for column, x in zip(held, row, strict=True):
                                column.append(x)
                        size += len(alone) * (key[0] + 9)
                    alone = []
                    if held[0] and (mine != key or size >= BATCH_BYTES):
                        if (out := solve(key, *held)) is not None:
                            yield out
                        held, size = ([], [], []), 0
                key = mine
                alone.append((outside, word, n))
        if len(alone) > 1:
            for row in alone:
                for column, x in zip(held, row, strict=True):
                    column.append(x)
        if held[0] and (out := solve(key, *held)) is not None:
            yield out
        tidy()

    dealt_rows = groups(words, most)
    found = dealt_rows.repartition(ranges(words), *KEY).sortWithinPartitions(*KEY).mapInArrow(run, PARTIAL)
    all_words = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    return (
        all_words.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.w").alias("best"))
    )


def variants(words: DataFrame, times: int = TIMES, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n).

    A form occurs ``times`` times as often as its word, so the way to a root has no more
    steps than an occurrence count has digits; each round takes a step for all words on their way.
    """
    words = keep(words)
    has_form = F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False))
    near = near_words(words, most).select("word", "n", "n_near", F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"))
    near = keep(near)
    steps = keep(near.where("form IS NOT NULL").select("word", "form"))
    onward = steps.select(F.col("word").alias("at"), F.col("form").alias("next"))
    way, ended = steps.select("word", F.col("form").alias("at")), []
    while not way.isEmpty():
        moved = keep(way.join(onward, "at", "left"))
        ended.append(moved.where("next IS NULL").select("word", F.col("at").alias("root")))
        way = moved.where("next IS NOT NULL").select("word", F.col("next").alias("at"))
    roots = ended[0] if ended else near.where("false").select("word", F.col("form").alias("root"))
    for more in ended[1:]:
        roots = roots.unionByName(more)
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(documents: DataFrame) -> DataFrame:
    """The spelling variants of all words of all texts."""
    return variants(vocabulary(documents))
