"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive words: hashed positions and ignored ones.  The
words of every test item and every training document are hashed under each mask
at every position, so that a replaced word hides a seed only where a mask looks
at it.  Hashes met on both sides give alignments (document, item, offset), and
each is verified word by word around the hit.  An item of over ``SHORT`` words
overlaps if the best run of the alignment, where a match counts 1 and a replaced word
-`PENALTY`, holds at least ``min_words`` matches at ``min_identity``; a shorter one if
that share of all its words matches; one of fewer than ``TOLERANT`` words only as a
whole.  The masks of each length were searched for so that, at the default limits,
replaced words can't hide every seed from the shortest overlap that counts.

Test items are written to files of the shared folder; the driver knows their names alone.
Tasks read them into sorted arrays of at most ``BLOCK_WORDS`` words at a time, and take
every batch of documents past each, so any number of items is handled exactly in one pass.

A seed that many items share (a common template) meets all of them wherever it occurs.  Of
the seeds of one alignment that follow each other only the first is taken on, and alignments are
verified for whole arrays of at most ``CELLS`` words, so such a seed costs as many word comparisons
as its items are long, and memory doesn't follow the number of items.

Cases: null and empty items and documents match nothing, nor do items shorter than
``min_item`` words (by default there are none); very long texts are searched whole;
repeated rows are reported again; of equally good places of an item in a document the
first is reported; null ids are carried; an empty side gives no rows (``clean`` then
keeps all); other columns are ignored, whatever their names (``clean`` carries them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.blocks import load, to_blocks
from evidentia.llm.textblocks import _POSITION, WordSlice, mix, word_slices

PENALTY = 2
MIN_WORDS, MIN_IDENTITY, MIN_ITEM = 10, 0.75, 1
SHORT, TOLERANT = 12, 5
# by the least length of an item; found by search, tests check that they miss nothing
MASKS = {
    13: ("11111", "110111", "1101000011", "100001111"),
    12: ("10111", "11101"),
    8: ("1111", "11011", "1100011"),
    5: ("1111", "10111", "11011", "11101"),
    **{n: ("1" * n,) for n in range(1, TOLERANT)},
}
BLOCK_WORDS = 1 << 18
CELLS = 1 << 20
_BITS = 22


def seed_hash(hashes: np.ndarray, at: np.ndarray, mask: str) -> np.ndarray:
    total = np.full(len(at), int(mask, 2), np.uint64)
    for j, on in enumerate(mask):
        if on == "1":
            total += hashes[at + j] * _POSITION[j]
    return mix(total)


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of items of n words."""
    return MASKS[max(k for k in MASKS if k <= n)]


@dataclass
class SeedIndex:
    """Test items of one block: words, and each seed's place, sorted by hash."""

    ids: np.ndarray
    words: np.ndarray
    starts: np.ndarray  # of each item in ``words``, and the end
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    seeds: dict[str, np.ndarray]  # of each mask in use: the hash at each place of ``words``, 0 where its item has none
    bits: np.ndarray

    @classmethod
    def build(cls, ids: list, items: list[np.ndarray], min_item: int) -> SeedIndex:
        starts = np.concatenate([[0], np.cumsum([len(w) for w in items])]).astype(np.int64)
        words = np.concatenate([*items, np.zeros(0, np.uint64)])
        sizes, owner = np.diff(starts), np.repeat(np.arange(len(items)), np.diff(starts))
        keys, item, offset, seeds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
        of_length = {int(n): masks_for(int(n)) for n in np.unique(sizes) if n >= max(1, min_item)}
        for mask in sorted({m for masks in of_length.values() for m in masks}):
            uses = np.array([n for n, masks in of_length.items() if mask in masks])
            at = np.flatnonzero(np.isin(sizes[owner], uses) & (np.arange(len(words)) + len(mask) <= starts[owner + 1]))
            seeds[mask] = np.zeros(len(words), np.uint64)
            seeds[mask][at] = seed_hash(words, at, mask)
            keys.append(seeds[mask][at])
            item.append(owner[at])
            offset.append(at - starts[owner[at]])
        keys, item, offset = np.concatenate(keys), np.concatenate(item), np.concatenate(offset)
        order = np.argsort(keys, kind="stable")
        bits = np.zeros(1 << _BITS, bool)
        bits[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return cls(np.array(ids, object), words, starts, keys[order], item[order], offset[order], seeds, bits)

    def hits(self, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the item's first word, item, document) of alignments with a seed, a mask and a bounded number of hits at a time."""
        whole = np.diff(self.starts) < TOLERANT
        for mask, seeds in self.seeds.items():
            n = len(hashes) - len(mask) + 1
            if n <= 0:
                continue
            at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
            h = seed_hash(hashes, at, mask)
            before = np.zeros(n + 1, np.uint64)
            before[at + 1] = h  # hash at the place before, in the same document
            keep = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            at, h = at[keep], h[keep]
            low, high = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
            some = np.flatnonzero(high > low)
            at, low, count = at[some], low[some], (high - low)[some]
            done = 0
            while done < len(at):
                total = np.cumsum(count[done:])
                to = done + max(1, int(np.searchsorted(total, CELLS, "right")))
                for first in range(0, int(count[done]) if to == done + 1 else 1, CELLS):  # one place may meet more items than that
                    own = np.minimum(count[done:to] - first, CELLS) if to == done + 1 else count[done:to]
                    pos = np.repeat(at[done:to], own)
                    place = np.repeat(low[done:to] + first, own) + np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
                    item, offset = self.item[place], self.offset[place]
                    # a seed of the same alignment one word before says the same
                    known = (offset > 0) & (seeds[self.starts[item] + offset - 1] == before[pos]) & (before[pos] != 0)
                    known &= (pos > 0) & (doc[pos] == doc[pos - 1])
                    pos, item, offset = pos[~known], item[~known], offset[~known]
                    if whole[item].any():  # what only counts as a whole counts once a document
                        once = np.unique(np.stack([doc[pos], np.where(whole[item], item, -1 - np.arange(len(item)))]), axis=1, return_index=True)[1]
                        pos, item, offset = pos[once], item[once], offset[once]
                    yield pos - offset, item, doc[pos]
                done = to


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges: starts[0], starts[0] + 1, ..., starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def best_runs(equal: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and matches of the run that scores highest in each of consecutive segments of ``equal``; the first of equals."""
    n, begins = len(sizes), np.cumsum(sizes) - sizes
    # score up to each place of a segment, a zero before its first
    heads = begins + np.arange(n)
    gain = np.zeros(len(equal) + n, np.int64)
    body = np.ones(len(gain), bool)
    body[heads] = False
    gain[body] = np.where(equal, 1, -PENALTY)
    score = np.cumsum(gain)
    score -= np.repeat(score[heads], sizes + 1)
    segment = np.repeat(np.arange(n), sizes + 1)
    apart = np.int64((PENALTY + 1) * (int(sizes.max()) + 2))
    least = np.minimum.accumulate(score - segment * apart) + segment * apart
    worth = np.full(len(score), -1, np.int64)
    worth[1:] = score[1:] - least[:-1]
    worth[heads] = np.iinfo(np.int64).min
    place = np.arange(len(score))
    top = np.maximum.reduceat(worth, heads)
    end = np.minimum.reduceat(np.where(worth == np.repeat(top, sizes + 1), place, len(score)), heads)
    level = least[end - 1]
    start = np.minimum.reduceat(np.where((score == np.repeat(level, sizes + 1)) & (place < np.repeat(end, sizes + 1)), place, len(score)), heads)
    matches = np.concatenate([[0], np.cumsum(equal)])
    start, end = start - heads, end - heads
    return start, end, matches[begins + end] - matches[begins + start]


SCHEMA = "doc_id long, item_id long, n_matched long, n_run long, item_words long, word_start long"


def item_files(benchmark: DataFrame) -> list[str]:
    """Names of the files with the test items, each of a bounded size."""
    items = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("text is not null")
    return sorted(r["path"] for r in to_blocks(items).select("path").collect())  # a name for megabytes of items


def indexes(paths: tuple[str, ...], min_item: int) -> Iterator[SeedIndex]:
    """The items of all files in blocks of at most BLOCK_WORDS words (or one longer item); a single block is remembered."""
    if (known := _only.get((paths, min_item))) is not None:
        yield known
        return
    ids, words, n, built = [], [], 0, 0
    for path in paths:
        rows = load(path).sort_by("item_id")
        names = rows.column("item_id").to_pylist()
        for s in word_slices(rows.column("text").combine_chunks(), True):
            bounds = s.word_starts()
            for k in range(s.n_docs):
                own = s.hashes[bounds[k] : bounds[k + 1]]
                if n and n + len(own) > BLOCK_WORDS:
                    yield SeedIndex.build(ids, words, min_item)
                    ids, words, n, built = [], [], 0, built + 1
                ids.append(names[s.first + k])
                words.append(own)
                n += len(own)
    if ids:
        index = SeedIndex.build(ids, words, min_item)
        if not built:
            _only.clear()
            _only[paths, min_item] = index
        yield index


_only: dict[tuple, SeedIndex] = {}


def verified(s: WordSlice, bounds: np.ndarray, index: SeedIndex, first: np.ndarray, item: np.ndarray, doc: np.ndarray, min_words: int, min_identity: float) -> np.ndarray:
    """Rows (document of the slice, item, matches, run, item words, start) of the alignments that overlap."""
    size = index.starts[item + 1] - index.starts[item]
    low, high = np.maximum(first, bounds[doc]), np.minimum(first + size, bounds[doc + 1])
    length = high - low
    out, done = [], 0
    while done < len(item):
        to = done + max(1, int(np.searchsorted(np.cumsum(length[done:]), CELLS, "right")))
        part = slice(done, to)
        n_words, t, o, begin, cells = size[part], item[part], doc[part], low[part], length[part]
        equal = s.hashes[spread(begin, cells)] == index.words[spread(index.starts[t] + begin - first[part], cells)]
        heads = np.cumsum(cells) - cells
        n = np.add.reduceat(equal.astype(np.int64), heads)
        place = np.arange(len(equal)) - np.repeat(heads, cells)
        start = np.minimum.reduceat(np.where(equal, place, len(equal)), heads)
        end = np.maximum.reduceat(np.where(equal, place, -1), heads) + 1
        run_start, run_end, run_n = best_runs(equal, cells)
        short = n_words <= SHORT
        start, end, n = np.where(short, start, run_start), np.where(short, end, run_end), np.where(short, n, run_n)
        needed = np.where(n_words < TOLERANT, n_words, min_identity * n_words)
        enough = np.where(short, n >= needed, (n >= min_words) & (n >= min_identity * (end - start)))
        out.append(np.stack([o, t, n, end - start, n_words, begin + start - bounds[o]], axis=1)[enough])
        done = to
    return np.concatenate(out) if out else np.zeros((0, 6), np.int64)


def best_places(rows: np.ndarray) -> np.ndarray:
    """Of each document and item the row with the most matches, the first of equals."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 5], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def found_in(column: pa.Array, index: SeedIndex, min_words: int, min_identity: float) -> np.ndarray:
    """Rows (row, item, matches, run, item words, start) of the verified overlaps of a batch of texts."""
    out = [np.zeros((0, 6), np.int64)]
    for s in word_slices(column, True):
        bounds = s.word_starts()
        found = [np.zeros((0, 6), np.int64)]
        for first, item, doc in index.hits(s.hashes, s.doc):
            if len(item):
                found.append(verified(s, bounds, index, first, item, doc, min_words, min_identity))
                found = [best_places(np.concatenate(found))]
        rows = found[0] if len(found) == 1 else np.concatenate(found)
        rows[:, 0] += s.first
        out.append(rows)
    return np.concatenate(out)


def overlaps(documents: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, min_item: int = MIN_ITEM) -> DataFrame:
    """Verified overlaps, one row per document row and item: the one with the most matches, the first of equals."""
    paths = tuple(item_files(benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = SCHEMA.replace(" long", "").split(", ")
        for batch in batches:
            for index in indexes(paths, min_item):
                rows = found_in(batch.column(1), index, min_words, min_identity)
                for at in range(0, len(rows), CELLS):
                    part = rows[at : at + CELLS]
                    columns = [batch.column(0).take(pa.array(part[:, 0])), pa.array(index.ids[part[:, 1]], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(part[:, k], pa.int64()) for k in range(2, 6)], names)

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def clean(documents: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, min_item: int = MIN_ITEM) -> DataFrame:
    """The documents without a verified overlap, with all their columns."""
    at, paths = documents.columns.index("text"), tuple(item_files(benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for index in indexes(paths, min_item):
                keep[found_in(batch.column(at), index, min_words, min_identity)[:, 0]] = False
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
