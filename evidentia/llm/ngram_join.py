"""Jaccard self-join of word n-gram sets by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct 4-word shingles; their
numeric order is the global n-gram order.  It is cut into fragments twice.

Finding pairs: sets of a size class are cut into so many fragments that two sets
that link (Jaccard >= 85 %) can't differ in all of them; some fragment holds the
same shingles in both.  Every fragment's content is hashed and equal hashes meet in
a key range.  A set is cut as its own class demands and as the class of a smaller
partner does.  Empty fragments say nothing, so a set with so many of them that the
count could fail also sends the single shingles of its prefix (all but the
``ceil(0.85 n) - 1`` last in the order): two such sets that link share one.

Verifying: the order is cut into ``FRAGMENTS`` equal parts, each pair's overlap is
counted in every part by a task of its own, and the counts are summed per pair.

Of equal sets one speaks for all; the others are linked with it without
verification.  Groups of equal fragments are never expanded into all pairs.  First
every set names the ``CLOSEST`` sets that it shares the most fragments with, among
its neighbours in each group (ordered by the rarest groups that its members are in),
and those pairs are verified, which joins most components.  At last all sets that
share a group but no component are compared, if their sizes and the number of
fragments they share allow a link, so that no link can be missing.

Pairs travel packed, to a place that both sets of a family mostly have in common
(the smallest node of all their groups; families of over ``MEETING`` pairs have several
places).  A pair comes from each place of the groups that its sets share, so far more
arrive than there are: they stay packed, and about ``HELD`` at a time are summed.  What
may link is verified in tasks of bounded pairs and bounded shingles.

Cases: null, empty and wordless texts have an empty set and link with nothing (the
component is the doc_id itself); texts of fewer than four words are one shingle;
very long texts are sets like others, whole; rows with the same doc_id get one
component, and so do repeated rows; a null id is a document of its own with component
null unless linked; an empty table gives no rows; other columns are ignored, whatever
their names (``distinct_documents`` carries them and keeps the row with the smallest
doc_id of each component, nulls last, of equal ids the first stored).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.blocks import by_range, light, load, pack, ranges, to_blocks, unpack, with_blocks
from evidentia.llm.components import components
from evidentia.shared import keep, release
from evidentia.llm.substrings import firsts, five_bytes, from_five, send
from evidentia.llm.textblocks import WordSlice, mix, window_hash, word_slices

N, PERCENT, FRAGMENTS = 4, 85, 4
CLOSEST, NEIGHBOURS = 3, 8  # partners of a set that are verified before the rest, and those looked at in a group
PAIRS, SHINGLES = 500_000, 4_000_000  # of a task, at most (but for one set and its partners)
MEETING = 2_000_000  # pairs of different sets that meet at one spot
HELD = 400_000  # pairs that a task holds unpacked
_SIX = 6


def shingles(s: WordSlice, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of the distinct shingles, in the order of documents and hashes."""
    at, h = s.windows(n)
    doc = s.doc[at]
    starts = s.word_starts()
    short = np.flatnonzero((s.counts > 0) & (s.counts < n))
    if len(short):
        few = np.array([window_hash(s.hashes, np.array([starts[i]]), int(s.counts[i]))[0] for i in short], np.uint64)
        doc, h = np.concatenate([doc, short.astype(np.int32)]), np.concatenate([h, few])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


class Sets:
    """Shingle sets of a block's documents: concatenated sorted hashes and where each set starts."""

    def __init__(self, table: pa.Table, only: np.ndarray | None = None):
        column = table.column("text")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if only is not None:
            column = column.take(pa.array(only))
        parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s in word_slices(column, True):
            doc, h = shingles(s)
            parts.append(h)
            counts.append(np.bincount(doc, minlength=s.n_docs))
        self.hashes, self.sizes = np.concatenate(parts), np.concatenate(counts)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two sums over each set that tell sets apart."""
        out = []
        for values in (self.hashes, mix(self.hashes + np.uint64(0x5851F42D4C957F2D))):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
            out.append(total[self.starts[1:]] - total[self.starts[:-1]])
        return out[0].view(np.int64), out[1].view(np.int64)


def most_difference(size):
    """Bound of the symmetric difference of two sets that link, the smaller of this size: (s + t) * 15 / 185 with t <= 100 s / 85."""
    return (100 - PERCENT) * size // PERCENT


def classes(largest: int) -> list[tuple[int, int, int]]:
    """(least size, bound of sizes, fragments) of each size class."""
    out, low = [], 1
    while low <= largest:
        high = max(low + 1, low * 3 // 2)
        d = most_difference(high - 1)
        out.append((low, high, d + 1 + (d // 10 + 2 if d else 0)))
        low = high
    return out


def fragments(sets: Sets, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sets of these rows: their shingles, where each non-empty fragment begins in them, and its number (owner * count + fragment)."""
    n = sets.sizes[rows]
    place = np.repeat(sets.starts[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    h = sets.hashes[place]
    part = ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    tag = np.repeat(np.arange(len(rows)), n) * count + part
    new = firsts(tag)
    return h, new, tag[new]


def demands(sets: Sets) -> np.ndarray:
    """How many fragments at least a set shares with a larger one that it links with: all but the differing and the empty ones."""
    need = np.ones(len(sets.sizes), np.int64)
    for low, high, count in classes(int(sets.sizes.max(initial=0))):
        rows = np.flatnonzero((sets.sizes >= low) & (sets.sizes < high))
        if len(rows):
            filled = np.bincount(fragments(sets, rows, count)[2] // count, minlength=len(rows))
            need[rows] = np.maximum(1, filled - most_difference(sets.sizes[rows]))
    return need


def signatures(sets: Sets, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each non-empty fragment of the sets of these rows, and its row."""
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    sizes = sets.sizes[rows]
    for number, (low, high, count) in enumerate(classes(int(sizes.max(initial=0)))):
        mine = rows[(sizes >= low) & (sizes <= 100 * (high - 1) // PERCENT)]
        if not len(mine):
            continue
        n = sets.sizes[mine]
        h, new, tag = fragments(sets, mine, count)
        owner, part = tag // count, (tag % count).astype(np.uint64)
        salt = mix(np.array([number + 1], np.uint64))[0]
        keys.append(mix(np.add.reduceat(mix(h), new) + salt * (part * np.uint64(2) + np.uint64(1))))
        owners.append(mine[owner])
        # sets in which all equal fragments could be empty ones
        filled = np.bincount(owner, minlength=len(mine))
        for i in np.flatnonzero(filled <= most_difference(np.minimum(n, high - 1))):
            prefix = sets.hashes[sets.starts[mine[i]] :][: int(n[i]) - -(-PERCENT * int(n[i]) // 100) + 1]
            keys.append(mix(prefix ^ salt ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            owners.append(np.full(len(prefix), mine[i]))
    return np.concatenate(keys), np.concatenate(owners)


def describe(blocks: DataFrame) -> DataFrame:
    """(node, doc_id, n, f1, f2, need) of every document; a node is a block and a row in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = load(path)
                sets = Sets(table)
                f1, f2 = sets.prints()
                yield pa.RecordBatch.from_arrays([pa.array((bid << 16) + np.arange(table.num_rows)), table.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(sets.sizes), pa.array(f1), pa.array(f2), pa.array(demands(sets))], ["node", "doc_id", "n", "f1", "f2", "need"])

    return blocks.mapInArrow(run, "node long, doc_id long, n long, f1 long, f2 long, need long")


def send_signatures(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets = Sets(load(path))
                f1, f2 = sets.prints()
                # of equal sets within the block the first one speaks
                _, first = np.unique(np.stack([sets.sizes, f1, f2], axis=1), axis=0, return_index=True)
                keys, rows = signatures(sets, np.sort(first[sets.sizes[first] > 0]))
                keys = keys >> np.uint64(24) << np.uint64(24)  # 40 bits select; whatever they select is verified
                order = np.lexsort((rows, keys))
                keys, rows = keys[order], rows[order].astype(np.uint16)
                yield send(bid, parts, keys, {"keys": lambda a, b: five_bytes(keys[a:b]), "rows": lambda a, b: rows[a:b].tobytes()})

    return blocks.mapInArrow(run, "p int, bid long, keys binary, rows binary")


def gather(table: pa.Table, parts: int) -> pa.Table:
    """Of one key range: the groups of nodes with an equal fragment, by the hash of a group's smallest node."""
    keys = np.concatenate([np.zeros(0, np.uint64), *[from_five(v.as_py()) for v in table.column("keys")]])
    nodes = np.concatenate([np.zeros(0, np.int64), *[(bid << 16) + np.frombuffer(v.as_py(), np.uint16).astype(np.int64) for bid, v in zip(table.column("bid").to_pylist(), table.column("rows"), strict=True)]])
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    at = firsts(keys)
    size = np.diff(np.concatenate([at, [len(keys)]]))
    nodes, size = nodes[np.repeat(size > 1, size)], size[size > 1]
    nodes, size, weight = merged(nodes, size, np.ones(len(size), np.int64))
    to = (mix(nodes[np.cumsum(size) - size].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    ends, out = np.cumsum(size), []
    for p in np.unique(to):
        own = order[to[order] == p]
        out.append((int(p), packed(np.concatenate([nodes[ends[g] - size[g] : ends[g]] for g in own]), size[own], weight[own])))
    return pa.table({"p": pa.array([p for p, _ in out], pa.int32()), "groups": pa.array([g for _, g in out], pa.binary())})


def merged(nodes: np.ndarray, size: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each group of nodes once, with the summed weights."""
    if not len(size):
        return nodes, size, weight
    at = np.cumsum(size) - size
    member = np.add.reduceat(mix(nodes.astype(np.uint64)), at)
    _, once, back = np.unique(np.stack([member.view(np.int64), size, nodes[at]], axis=1), axis=0, return_index=True, return_inverse=True)
    total = np.bincount(back.ravel(), weight, len(once)).astype(np.int64)
    order = np.argsort(once)
    stay = np.zeros(len(size), bool)
    stay[once] = True
    return nodes[np.repeat(stay, size)], size[stay], total[order]


def packed(nodes: np.ndarray, size: np.ndarray, weight: np.ndarray) -> bytes:
    return pack(pa.table({"nodes": pa.array([nodes]), "size": pa.array([size]), "weight": pa.array([weight])}))


def meet(table: pa.Table) -> pa.Table:
    """All groups with a smallest node of one hash, each group of nodes once with the number of fragments that it shares."""
    found = [groups_of(v) for v in table.column("groups")]
    return pa.table({"p": table.column("p").slice(0, 1), "groups": pa.array([packed(*merged(*map(np.concatenate, zip(*found, strict=True))))], pa.binary())})


def groups_of(value: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = unpack(value)
    return tuple(np.asarray(t.column(c)[0].values) for c in ("nodes", "size", "weight"))


def homes(groups: DataFrame) -> DataFrame:
    """(node, home): the smallest node of all its groups, which sets of a family mostly have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                nodes, size, _ = groups_of(value)
                if not len(size):
                    continue
                first = np.repeat(nodes[np.cumsum(size) - size], size)
                order = np.lexsort((first, nodes))
                at = firsts(nodes[order])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[order][at]), pa.array(first[order][at])], ["node", "home"])

    return groups.select("groups").mapInArrow(run, "node long, home long").groupBy("node").agg(F.min("home").alias("home"))


FACTS = ("node", "root", "n", "need", "spot")


def spots(home: DataFrame) -> DataFrame:
    """(node, spot): where the pairs of a set are verified; homes whose sets have more than MEETING pairs have several spots.

    Those are homes of over 2,000 sets, so the broadcast side is that much smaller than the sets.
    """
    sets = F.count(F.lit(1)).cast("double")
    many = home.groupBy("home").agg(F.ceil(sets * sets / (2 * MEETING)).alias("s")).where("s > 1")
    salt = F.pmod(F.xxhash64("node"), F.coalesce("s", F.lit(1)))
    return home.join(F.broadcast(many), "home", "left").select("node", F.xxhash64("home", salt).alias("spot"))


def with_facts(groups: DataFrame, known: DataFrame) -> DataFrame:
    """The groups of each p, and a row (node, root, n, need, spot) for each known node in them."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, value in zip(batch.column(0), batch.column(1), strict=True):
                nodes = np.unique(groups_of(value)[0])
                yield pa.RecordBatch.from_arrays([pa.array([p.as_py()] * len(nodes), pa.int32()), pa.array(nodes)], ["p", "node"])

    facts = groups.mapInArrow(members, "p int, node long").join(known, "node").select("p", *FACTS, F.lit(None).cast("binary").alias("groups"))
    return facts.unionByName(groups.select("p", *[F.lit(None).cast("long").alias(c) for c in FACTS], "groups"))


@dataclass
class Mixed:
    """Groups that hold several components: known nodes with their roots and sizes, and members as indices into them, group by group."""

    ids: np.ndarray
    root: np.ndarray
    n: np.ndarray
    need: np.ndarray
    spot: np.ndarray
    member: np.ndarray
    group: np.ndarray  # of each member
    weight: np.ndarray  # of each group

    @classmethod
    def of(cls, table: pa.Table) -> Mixed:
        mask = table.column("node").is_valid()
        here = table.filter(mask).sort_by("node")
        ids, root, n, need, spot = (here.column(c).to_numpy() for c in FACTS)
        nodes, size, weight = groups_of(table.filter(pa.compute.invert(mask)).column("groups")[0])
        group, at = np.repeat(np.arange(len(size)), size), np.searchsorted(ids, nodes)
        known = ids[np.minimum(at, len(ids) - 1)] == nodes if len(ids) else np.zeros(len(nodes), bool)
        group, at = group[known], at[known]
        first = firsts(group)
        low, high = (f.reduceat(root[at], first) if len(first) else at for f in (np.minimum, np.maximum))
        some = np.repeat(low != high, np.diff(np.concatenate([first, [len(group)]])))
        left, group = np.unique(group[some], return_inverse=True)
        used, member = np.unique(at[some], return_inverse=True)
        return cls(ids[used], root[used], n[used], need[used], spot[used], member, group, weight[left])

    def fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of different components whose sizes allow a link."""
        n, m = self.n[x], self.n[y]
        return (self.root[x] != self.root[y]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))

    def near(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, k): with each node the ``most`` others that it shares the most fragments with, among its neighbours in each group."""
        if not len(self.member):
            return
        size = np.bincount(self.group)
        # members of a group that are also together in rare groups become neighbours
        order = np.lexsort((self.group, size[self.group], self.member))
        start = firsts(self.member[order])
        owner, count = self.member[order][start], np.diff(np.concatenate([start, [len(order)]]))
        rare = np.full((len(self.ids), 3), -1)
        for k in range(3):
            rare[owner[count > k], k] = self.group[order][start[count > k] + k]
        order = np.lexsort((self.n[self.member], *rare[self.member].T[::-1], self.group))
        member, group = self.member[order], self.group[order]
        code, weight = np.zeros(0, np.int64), np.zeros(0, np.int64)
        wide = len(self.ids)
        for step in range(1, NEIGHBOURS + 1):
            x, y = member[:-step], member[step:]
            ok = (group[:-step] == group[step:]) & self.fits(x, y)
            x, y, w = x[ok], y[ok], self.weight[group[:-step][ok]]
            code, back = np.unique(np.concatenate([code, np.minimum(x, y) * wide + np.maximum(x, y)]), return_inverse=True)
            weight = np.bincount(back, np.concatenate([weight, w]), len(code)).astype(np.int64)
        x, y, k = np.concatenate([code // wide, code % wide]), np.concatenate([code % wide, code // wide]), np.tile(weight, 2)
        yield best(x, y, k, most)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, k): all pairs, x the smaller set, with the fragments they share; those of a group's largest component wait for the others."""
        if not len(self.member):
            return
        size, starts = np.bincount(self.group), firsts(self.group)
        _, root = np.unique(self.root, return_inverse=True)
        code, n = np.unique(self.group * len(self.ids) + root[self.member], return_counts=True)
        order = np.lexsort((-n, code // len(self.ids)))
        largest = code[order][firsts(code[order] // len(self.ids))] % len(self.ids)
        minor = root[self.member] != largest[self.group]
        active = np.flatnonzero(minor)
        active = active[np.argsort(self.member[active], kind="stable")]
        cuts = firsts(self.member[active])
        held, total = [], 0
        for own in np.split(active, cuts[1:]) if len(active) else ():
            x, g = int(self.member[own[0]]), self.group[own]
            at = np.concatenate([np.arange(starts[i], starts[i] + size[i]) for i in g])
            w = np.repeat(self.weight[g], size[g])
            stay = ~minor[at] | (self.member[at] > x)
            y, place = np.unique(self.member[at[stay]], return_inverse=True)
            k = np.bincount(place, w[stay], len(y)).astype(np.int64)
            fit = self.fits(np.full(len(y), x), y)
            y, k = y[fit], k[fit]
            swap = (self.n[y] < self.n[x]) | ((self.n[y] == self.n[x]) & (y < x))
            held.append((np.where(swap, y, x), np.where(swap, x, y), k))
            total += len(y)
            if total >= HELD:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, total = [], 0
        if total:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))


def best(x: np.ndarray, y: np.ndarray, k: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each x the ``most`` pairs with the largest k."""
    order = np.lexsort((y, -k, x))
    first = firsts(x[order])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
    order = order[rank < most]
    return x[order], y[order], k[order]


def cut(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> list[int]:
    """Where tasks of at most PAIRS pairs and SHINGLES shingles end; pairs are ordered by x."""
    _, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = place[: len(x)], place[len(x) :]
    seen, ends, pairs, held = np.full(len(place), -1), [], 0, 0
    bounds = [*firsts(x).tolist(), len(x)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        while a < b:
            to = min(b, a + PAIRS - pairs)
            fresh = seen[y[a:to]] != len(ends)
            more = int(ny[a:to][fresh].sum()) + (int(nx[a]) if seen[x[a]] != len(ends) else 0)
            if pairs and held + more > SHINGLES:
                ends.append(a)
                pairs = held = 0
                continue
            seen[y[a:to]] = seen[x[a]] = len(ends)
            pairs, held, a = pairs + to - a, held + more, to
            if pairs >= PAIRS:
                ends.append(a)
                pairs = held = 0
    return [*ends, len(x)] if pairs else ends


PAIR = ("x", "y", "k", "nx", "ny", "need")


def packed_pairs(columns) -> bytes:
    return pack(pa.table({c: pa.array([v]) for c, v in zip(PAIR, columns, strict=True)}))


def pairs_of(value: bytes | pa.Scalar) -> list[np.ndarray]:
    t = unpack(value)
    return [np.asarray(t.column(c)[0].values) for c in PAIR]


def slices(table: pa.Table) -> Iterator[list[np.ndarray]]:
    """The pairs of a place (columns as in PAIR), about HELD at a time and all of one x together; the others stay packed meanwhile."""
    count = max(1, -(-pa.compute.sum(table.column("pairs")).as_py() // HELD))
    parts: list[list] = [[] for _ in range(count)]
    if count == 1:
        parts[0] = list(table.column("shared"))
    for value in table.column("shared") if count > 1 else ():
        columns = pairs_of(value)
        to = (mix(columns[0].astype(np.uint64)) % np.uint64(count)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for own in np.split(order, firsts(to[order])[1:]):
            parts[to[own[0]]].append(packed_pairs([c[own] for c in columns]))
    for part in parts:
        if part:
            yield [np.concatenate(c) for c in zip(*map(pairs_of, part), strict=True)]


def wanted(x: np.ndarray, y: np.ndarray, k: np.ndarray, nx: np.ndarray, ny: np.ndarray, need: np.ndarray, most: int) -> list[np.ndarray]:
    """(x, y, nx, ny) of the pairs to verify, k summed over all that tell of a pair: each x's ``most`` closest, or those with as many fragments as a link demands."""
    order = np.lexsort((y, x))
    new = np.ones(len(x), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]])
    at = np.flatnonzero(new)
    one, k = order[at], np.add.reduceat(k[order], at)
    if not most:
        one = one[k >= need[one]]
        return [c[one] for c in (x, y, nx, ny)]
    one = one[best(x[one], np.arange(len(one)), k, most)[1]]
    x, y, nx, ny = x[one], y[one], nx[one], ny[one]
    return [np.minimum(x, y), np.maximum(x, y), np.where(x < y, nx, ny), np.where(x < y, ny, nx)]


def tasks(table: pa.Table, most: int) -> pa.Table:
    """Of one place: the tasks (g, task) that verify its pairs, and a row (g, node) for each set that a task needs."""
    p = table.column("p")[0].as_py()
    made, nodes = [], []

    def make(held: list[list[np.ndarray]]) -> None:
        x, y, nx, ny = map(np.concatenate, zip(*held, strict=True))
        _, one = np.unique(np.stack([x, y], axis=1), axis=0, return_index=True)  # in the order of x
        x, y, nx, ny = x[one], y[one], nx[one], ny[one]
        a = 0
        for b in cut(x, y, nx, ny):
            g = p << 24 | len(made)
            ids, index, place = np.unique(np.concatenate([x[a:b], y[a:b]]), return_index=True, return_inverse=True)
            n = np.concatenate([nx[a:b], ny[a:b]])[index].astype(np.int64)
            made.append((g, pack(pa.table({c: pa.array([v]) for c, v in (("ids", ids), ("n", n), ("x", place[: b - a]), ("y", place[b - a :]))}))))
            nodes.append((np.full(len(ids), g), ids))
            a = b

    held, pairs = [], 0
    for some in slices(table):
        held.append(wanted(*some, most))
        pairs += len(held[-1][0])
        if pairs >= PAIRS:
            make(held)
            held, pairs = [], 0
    if pairs:
        make(held)
    g = np.concatenate([np.array([t[0] for t in made], np.int64), *[n[0] for n in nodes]])
    return pa.table({"g": pa.array(g, pa.int64()), "task": pa.array([t[1] for t in made] + [None] * (len(g) - len(made)), pa.binary()), "node": pa.array(np.concatenate([np.zeros(len(made), np.int64), *[n[1] for n in nodes]]), pa.int64())})


def links(blocks: DataFrame, groups: DataFrame, known: DataFrame, parts: int, most: int = 0) -> DataFrame:
    """(a, b): links between sets of different components that share a group; of each set's ``most`` closest only, if given.

    Pairs never become rows.  The fragments that two sets share are counted where
    their groups are and summed at a spot of one of them; pairs to verify (with
    ``most`` 0: that share as many fragments as a link demands) are verified there:
    the overlaps of a set with all others are counted in each fragment of the order
    and travel packed, and the sums over the fragments leave only the links.
    """
    meeting = max(1, parts // 4)  # places where pairs meet: pairs are far smaller than the keys that found them

    def share(table: pa.Table) -> pa.Table:
        mixed, out = Mixed.of(table), []
        for x, y, k in mixed.near(most) if most else mixed.rest():
            to = (mix(mixed.spot[x].astype(np.uint64)) % np.uint64(meeting)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            x, y, k, to = x[order], y[order], k[order], to[order]
            bounds = [*firsts(to).tolist(), len(to)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                columns = (mixed.ids[x[a:b]], mixed.ids[y[a:b]], *(v.astype(np.int32) for v in (k[a:b], mixed.n[x[a:b]], mixed.n[y[a:b]], mixed.need[x[a:b]])))
                out.append((int(to[a]), int(b - a), packed_pairs(columns)))
        return pa.table({"p": pa.array([q for q, _, _ in out], pa.int32()), "pairs": pa.array([n for _, n, _ in out], pa.int64()), "shared": pa.array([v for _, _, v in out], pa.binary())})

    shared = by_range(with_facts(groups, known), share, "p int, pairs long, shared binary")
    todo = keep(by_range(shared, lambda t: tasks(t, most), "g long, task binary, node long").coalesce(meeting))
    sent = send_segments(blocks, todo.where("task is null").select("node", "g")).withColumn("task", F.lit(None).cast("binary"))
    told = todo.where("task is not null").select("g", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("p"), F.lit(None).cast("binary").alias("segments"), "task")
    partial = sent.unionByName(told).groupBy("g", "p").applyInArrow(light(count), "g long, p int, counts binary")
    return partial.groupBy("g").applyInArrow(light(total), "a long, b long")


def count(table: pa.Table) -> pa.Table:
    """Overlaps of a task's pairs in one fragment: of a set with few partners one by one, else through the fragment's inverted lists."""
    given = table.filter(table.column("task").is_valid())
    task = unpack(given.column("task")[0])
    ids, x, y = (np.asarray(task.column(c)[0].values) for c in ("ids", "x", "y"))
    own = segments_of(table.filter(table.column("segments").is_valid()))
    held = [own[node] for node in ids.tolist()]
    sizes = np.array([len(h) for h in held])
    overlap = np.zeros(len(x), np.uint32)
    bounds = [*firsts(x).tolist(), len(x)]
    key = None
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        i = int(x[a])
        if b - a <= NEIGHBOURS:
            for j in range(a, b):
                s, t = sorted((held[i], held[int(y[j])]), key=len)
                if len(s):
                    overlap[j] = (t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()
            continue
        if key is None:
            _, key = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            holder = np.repeat(np.arange(len(held)), sizes)[np.argsort(key, kind="stable")]
            lists = np.concatenate([[0], np.cumsum(np.bincount(key))]) if len(key) else np.zeros(1, np.int64)
        k = key[starts[i] : starts[i + 1]]
        length = lists[k + 1] - lists[k]
        at = np.repeat(lists[k] - np.cumsum(length) + length, length) + np.arange(length.sum())
        overlap[a:b] = np.bincount(holder[at], minlength=len(held))[y[a:b]]
    g, p = given.column("g")[0].as_py(), given.column("p")[0].as_py()
    body = {"overlap": pa.array([overlap])} | ({c: task.column(c) for c in ("ids", "n", "x", "y")} if p == 0 else {})
    return pa.table({"g": pa.array([g], pa.int64()), "p": pa.array([p], pa.int32()), "counts": pa.array([pack(pa.table(body))], pa.binary())})


def total(table: pa.Table) -> pa.Table:
    """The links among a task's pairs: overlaps summed over the fragments."""
    found = [unpack(v) for v in table.sort_by("p").column("counts")]
    x, y, ids, n = (np.asarray(found[0].column(c)[0].values) for c in ("x", "y", "ids", "n"))
    overlap = sum(np.asarray(f.column("overlap")[0].values).astype(np.int64) for f in found)
    link = 100 * overlap >= PERCENT * (n[x] + n[y] - overlap)
    return pa.table({"a": pa.array(np.minimum(ids[x], ids[y])[link]), "b": pa.array(np.maximum(ids[x], ids[y])[link])})


def send_segments(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(g, p, segments): for each asked (node, g) the node's shingles in each fragment p of the order."""
    asked = asked.select(F.shiftright("node", 16).alias("bid"), F.lit(0).alias("p"), F.col("node").bitwiseAND(F.lit(65535)).cast("int").alias("row"), F.col("g").cast("long").alias("g"))

    def segments(documents: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("g", pa.int64()), ("p", pa.int32()), ("segments", pa.binary()))})
        bid = wanted.column("bid")[0].as_py()
        rows, back = np.unique(wanted.column("row").to_numpy(), return_inverse=True)
        g = wanted.column("g").to_numpy()
        sets = Sets(documents, rows)
        inner = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)
        cuts = np.stack([np.concatenate([[0], np.searchsorted(sets.hashes[a:b], inner), [b - a]]) + a for a, b in zip(sets.starts[:-1], sets.starts[1:], strict=True)])
        six = np.ascontiguousarray((sets.hashes << np.uint64(2) >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :_SIX])
        out: dict[str, list] = {"g": [], "p": [], "segments": []}
        for group in np.unique(g):
            own = back[g == group]
            for v in range(FRAGMENTS):
                spans = [(cuts[i, v], cuts[i, v + 1]) for i in own]
                data = np.concatenate([np.zeros((0, _SIX), np.uint8), *[six[a:b] for a, b in spans]])
                out["g"].append(int(group))
                out["p"].append(v)
                out["segments"].append(pack(pa.table({"nodes": pa.array([(bid << 16) + rows[own].astype(np.int64)]), "size": pa.array([np.array([b - a for a, b in spans])]), "data": pa.array([data.tobytes()], pa.binary())})))
        return pa.table({"g": pa.array(out["g"], pa.int64()), "p": pa.array(out["p"], pa.int32()), "segments": pa.array(out["segments"], pa.binary())})

    # only blocks that are asked take part
    needed = blocks.join(asked.select("bid").distinct(), "bid", "left_semi")
    return with_blocks(needed, asked, segments, "g long, p int, segments binary")


def segments_of(table: pa.Table) -> dict[int, np.ndarray]:
    """Sorted shingles of each node, as sent."""
    own: dict[int, np.ndarray] = {}
    for value in table.column("segments"):
        t = unpack(value)
        wide = np.zeros((len(d := np.frombuffer(t.column("data")[0].as_py(), np.uint8)) // _SIX, 8), np.uint8)
        wide[:, :_SIX] = d.reshape(-1, _SIX)
        flat, ends = wide.view("<u8").ravel(), np.cumsum(np.asarray(t.column("size")[0].values))
        for node, a, b in zip(np.asarray(t.column("nodes")[0].values).tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own[node] = flat[a:b]
    return own


def nodes_with_components(blocks: DataFrame) -> DataFrame:
    """(node, doc_id, n, root) of every document row; root is the smallest node of the component.

    Spark starts a process for each file that it creates on a local disk, so tables of
    few rows are stored in few files, and what each block tells is cached.
    """
    parts, spark = ranges(blocks), blocks.sparkSession
    few = max(1, parts // 4)
    facts = describe(blocks).persist(StorageLevel.DISK_ONLY)
    n = facts.count()
    first = facts.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    copies = keep(facts.where("n > 0").join(first, ["n", "f1", "f2"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")), n)
    # rows with one doc_id are one document
    once = facts.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = facts.join(once, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    groups = by_range(send_signatures(blocks, parts), lambda t: gather(t, parts), "p int, groups binary")
    groups = keep(by_range(groups, meet, "p int, groups binary").coalesce(few))
    release(spark)

    def rooted(roots: DataFrame) -> DataFrame:
        return facts.join(roots, "node", "left").select("node", "doc_id", "n", "need", F.coalesce("root", "node").alias("root"))

    # of equal sets the first one speaks; the others have no part in what follows
    speak = keep(spots(homes(groups)).join(copies.select(F.col("b").alias("node")), "node", "left_anti"), n)
    found = keep(copies.unionByName(rows), 2 * n)
    near = keep(links(blocks, groups, rooted(keep(components(found), n)).join(speak, "node"), parts, CLOSEST), CLOSEST * n)
    found = found.unionByName(near)
    release(spark)
    # what is left between different components is compared as a whole, so no link can be missing after it
    left = keep(links(blocks, groups, rooted(keep(components(found), n)).join(speak, "node"), parts).coalesce(few))
    nodes = keep(rooted(keep(components(found.unionByName(left)), n)), n).select("node", "doc_id", "n", "root")
    facts.unpersist()
    return nodes


def rows_with_components(blocks: DataFrame) -> DataFrame:
    """(node, doc_id, n, component_id, keeper) of every document row; the keeper is the component's row with the smallest doc_id."""
    nodes = nodes_with_components(blocks)
    release(blocks.sparkSession)
    smallest = nodes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node")).alias("k"))
    return nodes.join(smallest, "root").select("node", "doc_id", "n", F.col("k.doc_id").alias("component_id"), F.col("k.node").alias("keeper"))


def join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document row."""
    blocks = to_blocks(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"))
    return rows_with_components(blocks).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def distinct_documents(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns."""
    blocks = to_blocks(documents)
    gone = rows_with_components(blocks).where("node <> keeper").select(F.shiftright("node", 16).alias("bid"), F.lit(0).alias("p"), F.col("node").bitwiseAND(F.lit(65535)).cast("int").alias("row"))

    def stay(table: pa.Table, answers: pa.Table) -> pa.Table:
        mask = np.ones(table.num_rows, bool)
        mask[answers.column("row").to_numpy()] = False
        return table.filter(pa.array(mask))

    return with_blocks(blocks, gone, stay, documents.schema)
