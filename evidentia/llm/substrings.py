"""Removal of repeated passages, found through difference-cover anchors.

A passage counts from ``WINDOW`` = 13 words.  Windows of 7 words are hashed only
where the position modulo 7 lies in the difference cover {0, 1, 3}: whatever the
positions of two equal passages are, within their first 7 words there is one at
which both sides have an anchor, and the 7 words from there lie inside the 13.

1. Every block sends its anchors' hashes (three in seven positions, each hash once
   a block) to hash ranges, which answer which of them stand in more than one
   document.
2. Blocks extend those anchors to the 13-word windows around them.  Only these can
   repeat; their hashes go, with the smallest document id, to hash ranges, which
   answer which windows also start in a smaller document.
3. Blocks remove every word covered by such a window.

Hashes are of 64 bits (anchors, which only select, 40 bits).

Cases: null and empty texts, and texts below 13 words, lose nothing; rows with
the same doc_id are one document for the question who is smaller, so they don't
remove each other's words, and repeated rows are treated alike; a null id is larger
than all others; very long texts are read whole, in slices; an empty table gives no
rows; other columns, whatever their names, are carried by ``dedup`` and ignored by
``digests``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.blocks import by_range, flags, load, pack, range_bounds, ranges, to_blocks, unpack, with_blocks
from evidentia.shared import keep
from evidentia.llm.textblocks import window_hash, word_slices

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
LAST = np.iinfo(np.int64).max
_COVERED = np.isin(np.arange(PERIOD), COVER)
_KEY_BITS = np.uint64(24)


class Words:
    """Word hashes of a block's documents in one array."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").cast(pa.int64())
        self.doc_ids = ids.fill_null(LAST).to_numpy()
        hashes, docs, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for s in word_slices(table.column("text"), False):
            hashes.append(s.hashes)
            docs.append(s.doc + np.int32(s.first))
            counts.append(s.counts)
        self.hashes, self.doc, self.counts = np.concatenate(hashes), np.concatenate(docs), np.concatenate(counts)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors."""
        n = len(self.hashes) - ANCHOR + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        place = np.arange(len(self.hashes)) - np.repeat(self.starts[:-1], self.counts)
        at = np.flatnonzero((self.doc[:n] == self.doc[ANCHOR - 1 :]) & _COVERED[place[:n] % PERIOD])
        return at, np.concatenate([np.zeros(0, np.uint64), *[window_hash(self.hashes, at[i : i + (1 << 17)], ANCHOR) for i in range(0, len(at), 1 << 17)]])

    def windows(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that hold one of the anchors at these places."""
        n = len(self.hashes) - WINDOW + 1
        if n <= 0 or not len(anchors):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        near = np.zeros(len(self.hashes) + 2, np.int32)
        np.add.at(near, np.maximum(anchors - (PERIOD - 1), 0), 1)
        np.add.at(near, anchors + 1, -1)
        at = np.flatnonzero((np.cumsum(near)[:n] > 0) & (self.doc[:n] == self.doc[WINDOW - 1 :]))
        return at, np.concatenate([np.zeros(0, np.uint64), *[window_hash(self.hashes, at[i : i + (1 << 17)], WINDOW) for i in range(0, len(at), 1 << 17)]])


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_keys)), bool), sorted_keys[1:] != sorted_keys[:-1]]))


def send(bid: int, parts: int, keys: np.ndarray, columns: dict) -> pa.RecordBatch:
    """A row for each key range, also an empty one, so that the answers are complete; columns: name -> bytes of a slice of keys."""
    cut = range_bounds(keys, parts)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    out = {"p": pa.array(range(parts), pa.int32()), "bid": pa.array([bid] * parts, pa.int64())} | {name: pa.array([f(a, b) for a, b in spans], pa.binary()) for name, f in columns.items()}
    return pa.RecordBatch.from_pydict(out)


def five_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray((keys >> _KEY_BITS).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def distinct_anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places in the order of their hashes, where each distinct one begins, the distinct hashes, and which stand in several documents."""
    at, h = words.anchors()
    h = h >> _KEY_BITS << _KEY_BITS
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    new = firsts(h)
    ids = words.doc_ids[words.doc[at]]
    several = np.minimum.reduceat(ids, new) != np.maximum.reduceat(ids, new) if len(new) else np.zeros(0, bool)
    return at, new, h[new], several


def send_anchors(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words(load(path))
                _, _, keys, several = distinct_anchors(words)
                yield send(bid, parts, keys, {"keys": lambda a, b: five_bytes(keys[a:b]), "several": lambda a, b: np.packbits(several[a:b]).tobytes()})

    return blocks.mapInArrow(run, "p int, bid long, keys binary, several binary")


def mark_anchors(table: pa.Table) -> pa.Table:
    """Of one key range: which anchors of each block stand in several documents or in several blocks."""
    keys = [from_five(v.as_py()) for v in table.column("keys")]
    sizes = np.array([len(k) for k in keys])
    flat = np.concatenate([*keys, np.zeros(0, np.uint64)])
    several = flags(table.column("several"), sizes)
    order = np.argsort(flat, kind="stable")
    new = firsts(flat[order])
    count = np.diff(np.concatenate([new, [len(flat)]]))
    hot = (count > 1) | (np.logical_or.reduceat(several[order], new) if len(new) else np.zeros(0, bool))
    out = np.zeros(len(flat), bool)
    out[order] = np.repeat(hot, count)
    ends = np.cumsum(sizes)
    return pa.table({"bid": table.column("bid"), "p": table.column("p"), "marks": pa.array([np.packbits(out[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())})


def repeated_windows(words: Words, marks: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts by hash, where each distinct hash begins, and the distinct hashes."""
    at, new, keys, _ = distinct_anchors(words)
    count = np.diff(np.concatenate([new, [len(at)]]))
    hot = np.repeat(flags(marks.column("marks"), np.diff(range_bounds(keys, parts))), count)
    starts, h = words.windows(np.sort(at[hot]))
    order = np.argsort(h, kind="stable")
    new = firsts(h[order])
    return starts[order], new, h[order][new]


def send_windows(blocks: DataFrame, marks: DataFrame, parts: int) -> DataFrame:
    def work(documents: pa.Table, answers: pa.Table) -> pa.Table:
        words, bid = Words(documents), answers.column("bid")[0].as_py()
        starts, new, keys = repeated_windows(words, answers, parts)
        least = np.minimum.reduceat(words.doc_ids[words.doc[starts]], new) if len(new) else np.zeros(0, np.int64)

        def docs(a: int, b: int) -> bytes:
            ids, code = np.unique(least[a:b], return_inverse=True)
            return pack(pa.table({"ids": pa.array([ids]), "code": pa.array([code.astype(np.uint16 if len(ids) < 65536 else np.uint32)])}))

        return pa.Table.from_batches([send(bid, parts, keys, {"keys": lambda a, b: keys[a:b].tobytes(), "docs": docs})])

    return with_blocks(blocks, marks, work, "p int, bid long, keys binary, docs binary")


def mark_windows(table: pa.Table) -> pa.Table:
    """Of one key range: which windows of each block also start in a document that is smaller than the block's smallest."""
    keys = [np.frombuffer(v.as_py(), np.uint64) for v in table.column("keys")]
    docs = []
    for v in table.column("docs"):
        t = unpack(v)
        docs.append(np.asarray(t.column("ids")[0].values)[np.asarray(t.column("code")[0].values)])
    sizes = np.array([len(k) for k in keys])
    flat, least = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*docs, np.zeros(0, np.int64)])
    order = np.argsort(flat, kind="stable")
    new = firsts(flat[order])
    best = np.minimum.reduceat(least[order], new) if len(new) else np.zeros(0, np.int64)
    out = np.zeros(len(flat), bool)
    out[order] = np.repeat(best, np.diff(np.concatenate([new, [len(flat)]]))) < least[order]
    ends = np.cumsum(sizes)
    return pa.table({"bid": table.column("bid"), "p": table.column("p"), "smaller": pa.array([np.packbits(out[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())})


def covered(words: Words, answers: pa.Table, parts: int) -> np.ndarray:
    """Mask of the words that go."""
    starts, new, keys = repeated_windows(words, answers, parts)
    ids = words.doc_ids[words.doc[starts]]
    least = np.minimum.reduceat(ids, new) if len(new) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([new, [len(starts)]]))
    smaller = flags(answers.column("smaller"), np.diff(range_bounds(keys, parts)))
    gone = starts[np.repeat(smaller, count) | (np.repeat(least, count) < ids)]
    depth = np.zeros(len(words.hashes) + 1, np.int32)
    np.add.at(depth, gone, 1)
    np.add.at(depth, gone + WINDOW, -1)
    return np.cumsum(depth)[:-1] > 0


def removed(documents: DataFrame, finish, schema: str) -> DataFrame:
    """Apply ``finish(documents, words, gone)`` to each block, with the mask of the words that go."""
    parts = ranges(documents)
    blocks = to_blocks(documents)
    marks = keep(by_range(send_anchors(blocks, parts), mark_anchors, "bid long, p int, marks binary"))
    smaller = by_range(send_windows(blocks, marks, parts), mark_windows, "bid long, p int, smaller binary")

    def work(table: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(table)
        return finish(table, words, covered(words, answers, parts))

    return with_blocks(blocks, marks.join(smaller, ["bid", "p"]), work, schema)


def kept_words(texts: pa.ChunkedArray, words: Words, gone: np.ndarray) -> Iterator[tuple[int, bytes | None]]:
    """Words that go from each text, and the kept words joined by spaces (None if all stay)."""
    per = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), words.starts[:-1]) if len(words.counts) else np.zeros(0, np.int64)
    per = np.where(words.counts > 0, per, 0)
    for i, text in enumerate(texts):
        if not per[i]:
            yield 0, None
        else:
            yield int(per[i]), b" ".join(compress(text.as_py().encode().split(), (~gone[words.starts[i] : words.starts[i + 1]]).tolist()))


DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def digests(documents: DataFrame) -> DataFrame:
    """Counts and the digest of what is kept, for every document."""

    def finish(table: pa.Table, words: Words, gone: np.ndarray) -> pa.Table:
        texts, n_removed, sha = table.column("text"), [], []
        for (n, kept), text in zip(kept_words(texts, words, gone), texts, strict=True):
            n_removed.append(n)
            sha.append(hashlib.sha256(kept if n else b" ".join((text.as_py() or "").encode().split())).hexdigest())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return removed(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), finish, DIGESTS)


def dedup(documents: DataFrame) -> DataFrame:
    """The documents with repeated passages taken out of ``text``; a text that loses nothing stays as it is."""
    names = documents.columns

    def finish(table: pa.Table, words: Words, gone: np.ndarray) -> pa.Table:
        texts = table.column("text")
        new = [text.as_py() if not n else kept.decode() for (n, kept), text in zip(kept_words(texts, words, gone), texts, strict=True)]
        return table.set_column(names.index("text"), "text", pa.array(new, pa.string()))

    return removed(documents, finish, documents.schema)
