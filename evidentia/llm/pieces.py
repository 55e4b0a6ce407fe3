"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The code points of many texts lie in one flat numpy array of symbols.  Two code points
that stand side by side in no piece can never be merged across, so the array falls into
segments (words, above all) that are encoded on their own; equal segments are encoded
once.  A round looks up the rank of every pair of neighbours, takes the minimum rank of
each segment, merges all pairs of that rank from left to right without overlap, and
compacts the array; segments without a pair leave.  Rounds end when no segment is left.

Pieces of equal score have equal rank: the leftmost goes first, as in the library.  A
piece that may itself begin or end a piece of no later rank is merged one at a time in a
segment (runs of spaces), as the new pair may have to go before the next one.  A run of
one character whose longest piece always comes first is cut into such pieces before.

Text becomes symbols as the model file says: the identity normaliser, spaces as U+2581,
one of them put before a text that isn't empty.  Code points without a piece become the
pieces of their UTF-8 bytes.  Decoding is a state machine over ids: it drops the mark of
a first piece and puts U+FFFD for each byte piece that is part of no character.

Cases: a null or empty text has no ids, and the digests of both are those of the empty
string; a null id is carried; a very long text is encoded in stretches that end between
segments, so memory follows the stretch; repeated rows give repeated results; pairs of
equal rank are ties, see above; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.blocks import tidy
from evidentia.llm.bpe import tokenizer_path

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: kinds of pieces in a model file
STRETCH = 1 << 20  # code points that are worked on at once
NEVER = np.int32(0x7FFFFFFF)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialized message: varints as integers, all else as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PairTable:
    """Hash table from pairs of piece ids to merged piece and rank, looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.merged = np.zeros(1 << bits, np.int32)
        self.rank = np.full(1 << bits, NEVER, np.int32)
        for (a, b), (piece, rank) in pairs.items():
            key = a << 32 | b
            at = int(self.slot(np.array([key]))[0])
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.merged[at], self.rank[at] = key, piece, rank

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; pairs without a piece get a slot of rank NEVER."""
        keys = left.astype(np.int64) << 32 | right
        at = self.slot(keys)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        return at


class Model:
    """Pieces of a SentencePiece BPE model with the tables that the rounds need."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            spec = list(fields(f.read()))
        trainer, normaliser = (dict(fields(next((v for k, v in spec if k == n), b""))) for n in (2, 3))
        if trainer.get(3) != 2 or normaliser.get(1) != b"identity" or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or not trainer.get(35):
            raise ValueError("not a BPE model with byte fallback and the identity normaliser")
        self.prefix = SPACE if normaliser.get(3, 1) else ""
        pieces = [dict(fields(v)) for k, v in spec if k == 1]
        self.text = [p[1].decode() for p in pieces]
        self.kind = [p.get(3, NORMAL) for p in pieces]
        if set(self.kind) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("pieces of further kinds")
        score = [struct.unpack("<f", p[2])[0] for p in pieces]
        normal = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == NORMAL}
        ranks = {s: n for n, s in enumerate(sorted({score[i] for i in normal.values()}, reverse=True))}
        self.rank_of = {t: ranks[score[i]] for t, i in normal.items()}
        self.pairs = PairTable({(normal[t[:k]], normal[t[k:]]): (i, self.rank_of[t]) for t, i in normal.items() for k in range(1, len(t)) if t[:k] in normal and t[k:] in normal})
        self.bytes = np.full(256, self.kind.index(UNKNOWN), np.int32)
        for i, k in enumerate(self.kind):
            if k == BYTE:
                self.bytes[int(self.text[i][1:-1], 16)] = i
        # characters of pieces are numbered from 1; 0 is any other
        chars = sorted({c for t in normal for c in t})
        number = {c: n for n, c in enumerate(chars, 1)}
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.single = np.array([-1] + [normal.get(c, -1) for c in chars], np.int32)
        beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for t in normal:
            for a, b in zip(t, t[1:], strict=False):
                beside[number[a], number[b]] = True
        self.width = len(chars) + 1
        self.beside = np.packbits(beside, axis=None, bitorder="little")
        # pieces after whose merge a pair of no later rank may arise
        self.careful = np.zeros(len(pieces), bool)
        for t in normal:
            for k in range(1, len(t)):
                for part in (t[:k], t[k:]):
                    if part in normal and self.rank_of[t] <= self.rank_of[part]:
                        self.careful[normal[part]] = True
        # what an id stands for: its bytes with spaces, and as decimal text with a comma
        surface = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(t[1:-1], 16)]) if k == BYTE else t.replace(SPACE, " ").encode() for t, k in zip(self.text, self.kind, strict=True)]
        self.surface = np.array(surface, object)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.concatenate([[0], np.cumsum(self.surface_size)])[:-1]
        self.surface_bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.is_byte = np.array([k == BYTE for k in self.kind])
        self.is_part = self.is_byte & np.array([s >= b"\x80" for s in surface])  # of a longer character
        digits = [f"{i},".encode() for i in range(len(pieces))]
        self.digit_size = np.array([len(d) for d in digits], np.int64)
        self.digit_start = np.concatenate([[0], np.cumsum(self.digit_size)])[:-1]
        self.digit_bytes = np.frombuffer(b"".join(digits), np.uint8)
        self.runs = self.find_runs(normal)

    def find_runs(self, normal: dict[str, int]) -> dict[int, int]:
        """Code points of which a long run always begins with the same longest piece: its length, checked on runs up to three times as long.

        Nothing may reach into such a run: where pieces hold the code point beside others, it
        is their first one, and they go before all pieces of it alone.
        """
        longest, first = {}, {}
        tied = {t[0] for t in normal if len(t) > 1 and len(set(t)) == 1 and self.careful[normal[t]]}
        for t in normal:
            if len(t) > 1 and set(t) <= tied and len(set(t)) == 1:
                longest[t[0]] = max(len(t), longest.get(t[0], 0))
                first[t[0]] = min(self.rank_of[t], first.get(t[0], self.rank_of[t]))
        for t in normal:
            for c in longest.keys() & set(t):
                if len(set(t)) > 1 and (c in t[1:] or self.rank_of[t] >= first[c]):
                    del longest[c]
        out = {}
        for c, n in longest.items():
            texts = [c * k for k in range(3 * n + 1)]
            ids, ends = self.merge(self.points("".join(texts)), np.concatenate([[0], np.cumsum([len(t) for t in texts])])[1:-1])
            parts = np.split(ids, ends[1:-1])
            if all(list(parts[k]) == [normal[c * n], *parts[k - n]] for k in range(n, 3 * n + 1)):
                out[ord(c)] = n
        return out

    @staticmethod
    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Positions (of the right one) where two neighbours can't be merged across."""
        char = self.char[points]
        key = char[:-1].astype(np.int64) * self.width + char[1:]
        return np.flatnonzero((self.beside[key >> 3] >> (key & 7).astype(np.uint8)) & 1 == 0) + 1

    def run_cuts(self, points: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Further positions, within long runs of one code point; the last of a run stays with what follows. ``ends``: of the texts."""
        out = []
        for c, n in self.runs.items():
            here = points == c
            if not (here[:-n:n] & here[n::n]).any():
                continue
            last, first = np.append(here[:-1] & ~here[1:], here[-1:]), np.concatenate([here[:1], here[1:] & ~here[:-1]])
            last[ends[ends > 0] - 1] |= here[ends[ends > 0] - 1]
            begins = ends[ends < len(points)]
            first[begins] |= here[begins]
            for a, b in zip(np.flatnonzero(first).tolist(), (np.flatnonzero(last) + 1).tolist(), strict=True):
                if b - a > 2 * n:
                    out.append(np.arange(a + n, b - n, n))
        return out

    def merge(self, points: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in order, and where each segment's begin (with the end)."""
        starts = np.concatenate([[0], cuts]) if len(points) or len(cuts) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(points)]])) if len(starts) else np.zeros(0, np.int64)
        first, which = self.distinct(points, starts, sizes)
        at = _spread(starts[first], sizes[first])
        char = self.char[points[at]]
        symbol = self.single[char]
        segment = np.repeat(np.arange(len(first)), sizes[first])
        lone = symbol < 0  # no piece of its own: alone in its segment, as nothing is beside it
        done_symbol, done_segment = [], []
        if lone.any():
            at_lone = np.flatnonzero(lone)
            raw = [chr(c).encode() for c in points[at[at_lone]].tolist()]
            done_symbol.append(self.bytes[np.frombuffer(b"".join(raw), np.uint8)])
            done_segment.append(np.repeat(segment[at_lone], [len(r) for r in raw]))
            symbol, segment = symbol[~lone], segment[~lone]
        while len(symbol):
            slot = self.pairs.find(symbol[:-1], symbol[1:])
            rank = self.pairs.rank[slot]
            rank[segment[:-1] != segment[1:]] = NEVER
            rank = np.append(rank, NEVER)
            begins = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            least = np.minimum.reduceat(rank, begins)
            size = np.diff(np.append(begins, len(symbol)))
            live = least != NEVER
            if not live.all():
                ended = np.repeat(~live, size)
                done_symbol.append(symbol[ended])
                done_segment.append(segment[ended])
                symbol, segment, rank = symbol[~ended], segment[~ended], rank[~ended]
                slot = np.append(slot, 0)[~ended]
                least, size = least[live], size[live]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            piece = self.pairs.merged[slot[hit]]
            # from left to right without overlap: of neighbouring hits in a row every second
            gap = np.concatenate([[True], np.diff(hit) > 1])
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(gap, np.arange(len(hit)), 0))
            keep = place % 2 == 0
            hit, piece = hit[keep], piece[keep]
            if (careful := self.careful[piece]).any():  # only the leftmost of such a segment
                own = segment[hit]
                leftmost = np.concatenate([[True], own[1:] != own[:-1]])
                tied = np.zeros(int(own.max()) + 1, bool)
                tied[own[careful]] = True
                keep = leftmost | ~tied[own]
                hit, piece = hit[keep], piece[keep]
            symbol = symbol.copy() if not symbol.flags.writeable else symbol
            symbol[hit] = piece
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            symbol, segment = symbol[stay], segment[stay]
        ids = np.concatenate([np.zeros(0, np.int32), *done_symbol])
        own = np.concatenate([np.zeros(0, np.int64), *done_segment])
        order = np.argsort(own, kind="stable")
        count = np.bincount(own, minlength=len(first))
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        out = ids[order][_spread(begin[which], count[which])] if len(which) else ids
        return out, np.concatenate([[0], np.cumsum(count[which])])

    def distinct(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each group of equal segments, and for every segment its group's number."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        power = _powers(int(sizes.max(initial=0)) + 1)
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        value = (points.astype(np.uint64) + np.uint64(1)) * power[place]
        total = np.concatenate([[np.uint64(0)], np.cumsum(value)])
        key = (total[starts + sizes] - total[starts]) * np.uint64(0xBF58476D1CE4E5B9) + sizes.astype(np.uint64)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        # equal keys of different segments: then each segment counts as its own
        twin = starts[first][which]
        if not (np.array_equal(sizes, sizes[first][which]) and np.array_equal(points, points[np.repeat(twin, sizes) + place])):
            return np.arange(n), np.arange(n)
        return first, which

    def encode_all(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several stretches of code points, and where each one's begin (with the end)."""
        points = np.concatenate([np.zeros(0, np.uint32), *texts])
        ends = np.cumsum([len(t) for t in texts])
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cuts = np.unique(np.concatenate([self.cuts(points), ends, *self.run_cuts(points, ends)]))
        cuts = cuts[(cuts > 0) & (cuts < len(points))].astype(np.int64)
        ids, begins = self.merge(points, cuts)
        where = np.concatenate([[0], np.searchsorted(np.concatenate([[0], cuts]), ends, "left")])
        return ids, begins[where]

    def stretches(self, text: str) -> Iterator[np.ndarray]:
        """The code points of a text, as symbols, in stretches that end between segments where there is such a place."""
        if not text:
            return
        at, text = 0, self.prefix + text.replace(" ", SPACE)
        while len(text) - at > STRETCH:
            size = STRETCH
            while True:
                points = self.points(text[at : at + size])
                cuts = np.concatenate([self.cuts(points), *self.run_cuts(points, np.array([len(points)]))])
                # runs are cut from their beginning, so a run that goes on past the end isn't cut by the last of them
                cuts = cuts[cuts < len(points) - 4 * max([1, *self.runs.values()])]
                if len(cuts) or at + size >= len(text):
                    break
                size *= 2
            if not len(cuts):
                break
            end = int(cuts.max())
            yield points[:end]
            at += end
        yield self.points(text[at:])

    def decimal(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids as decimal text, a comma after each, and where each one's begins (with the end)."""
        size = self.digit_size[ids]
        return self.digit_bytes[_spread(self.digit_start[ids], size)].tobytes(), np.concatenate([[0], np.cumsum(size)])

    def surfaces(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that the ids stand for, and where each one's begin (with the end)."""
        size = self.surface_size[ids]
        return self.surface_bytes[_spread(self.surface_start[ids], size)].tobytes(), np.concatenate([[0], np.cumsum(size)])


class Decoder:
    """Ids to UTF-8 in chunks; bytes of an unfinished character are held back."""

    def __init__(self, model: Model):
        self.model, self.held = model, b""
        self.first = bool(model.prefix)

    def feed(self, ids: np.ndarray, joined: bytes | None = None) -> bytes:
        """Text of the next ids; ``joined`` may give what they stand for, without a part of a character among them."""
        if joined is not None and not self.first:
            return self.close() + joined
        if joined is not None and len(ids) and not self.model.is_byte[ids[0]] and (head := self.model.surface[ids[0]]):
            self.first = False
            return self.close() + joined[head.startswith(b" ") and self.model.kind[ids[0]] == NORMAL :]
        out, byte = [], self.model.is_byte[ids]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], byte, [False]]).astype(np.int8)))
        at = 0
        for a, b in [*zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True), (len(ids), len(ids))]:
            if a > at:
                out += [self.close(), self.text(ids[at:a])]
            self.held += b"".join(self.model.surface[ids[a:b]])
            at = b
        return b"".join(out)

    def text(self, ids: np.ndarray) -> bytes:
        """Pieces that aren't bytes; the first that leaves something loses its mark, or is no more than it."""
        model, out = self.model, b""
        while self.first and len(ids):
            out = model.surface[ids[0]]
            if out:
                self.first = False
                out = out[out.startswith(b" ") and model.kind[ids[0]] == NORMAL :]
            ids = ids[1:]
        return out + model.surfaces(ids)[0]

    def close(self) -> bytes:
        """What is held: characters where the bytes make some, U+FFFD for each other byte."""
        held, self.held = self.held, b""
        if not held:
            return b""
        self.first = False
        try:
            held.decode()
            return held
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(held):
                size = next((k for k in range(1, 5) if _is_char(held[at : at + k])), 0)
                out.append(held[at : at + size] if size else "�".encode())
                at += size or 1
            return b"".join(out)


def _is_char(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges: starts[0], starts[0] + 1, ..., starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        up = np.full(max(n, 1 << 12), np.uint64(0x9E3779B97F4A7C15))
        up[0] = 1
        _power = np.multiply.accumulate(up)
    return _power


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def encode_decode(documents: DataFrame, name: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: token count and digests of ids and decoded text; ``keep_ids`` adds the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer_path(name))
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    yield encoded(model, batch.slice(at, 512), keep_ids)
        finally:  # a worker lives on after its task
            tidy()

    picked = documents.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return picked.mapInArrow(run, SCHEMA + ", ids binary" * keep_ids)


class _Row:
    """Running digests of one document."""

    def __init__(self, model: Model):
        self.model, self.n, self.kept, self.decoder = model, 0, [], Decoder(model)
        self.ids, self.text = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, decimal: bytes, joined: bytes | None, keep_ids: bool) -> None:
        if len(ids):
            self.ids.update(b"," * (self.n > 0) + decimal[:-1])
            self.n += len(ids)
            self.text.update(self.decoder.feed(ids, joined))
            if keep_ids:
                self.kept.append(ids.astype("<u4").tobytes())


def encoded(model: Model, batch: pa.RecordBatch, keep_ids: bool) -> pa.RecordBatch:
    rows = [_Row(model) for _ in range(batch.num_rows)]
    waiting: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        ids, begins = model.encode_all([p for _, p in waiting])
        (decimal, d), (joined, j) = model.decimal(ids), model.surfaces(ids)
        parts = np.concatenate([[0], np.cumsum(model.is_part[ids])])
        for (k, _), a, b in zip(waiting, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            rows[k].add(ids[a:b], decimal[d[a] : d[b]], joined[j[a] : j[b]] if parts[a] == parts[b] else None, keep_ids)
        waiting.clear()
        size = 0

    for k in range(batch.num_rows):
        for points in model.stretches(batch.column(1)[k].as_py() or ""):
            waiting.append((k, points))
            size += len(points)
            if size >= STRETCH:
                flush()
    flush()
    for row in rows:
        row.text.update(row.decoder.close())
    columns = [batch.column(0), pa.array([r.n for r in rows], pa.int64()), pa.array([r.ids.hexdigest() for r in rows], pa.string()), pa.array([r.text.hexdigest() for r in rows], pa.string())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if keep_ids:
        columns, names = [*columns, pa.array([b"".join(r.kept) for r in rows], pa.binary())], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names)
