"""Approximate nearest neighbours by cosine with an adaptive dimension scan.

Index: vectors are scaled to length 1, rotated by a fixed random orthogonal
matrix, and put into lists by the nearest of some sqrt(n) centres (spherical k-means
fitted on at most ``sample`` vectors, the first ones by a hash of the id, and no more
centres than an eighth of them; every vector is put into a list).  Lists are packed
into cells of bounded size, and larger ones are cut.  Of equal vectors only the
``k + 1`` smallest ids take part as candidates: the others can never be among the k
nearest of anything.

Search: each query visits its ``probes`` nearest lists, by default as many as reach a
recall of TARGET within the sample.  It goes once to each cell that holds some of
them, and a cell goes once to each block of ``QUERIES`` queries that it has.  Within a
cell the vectors lie in column blocks, those of the nearest lists first, and partial
squared distances grow block by block.  As the rotation spreads a vector evenly over
the dimensions, the partial distance over t of D dimensions estimates the whole; the
hypothesis "this candidate is nearer than the current k-th" is rejected, and the
candidate abandoned, when (D / t) * partial > bound * (1 + EPSILON / sqrt(t))**2.  What
is left is scored exactly, in double precision on the original vectors.

What reaches the driver: the sample, a count for each list, and a count for each cell
(at most CELLS and a cell for each list).

Cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows without an id, which no result could name; vectors of
different dimensions have no cosine, so each dimension is searched on its own (an index
for each that occurs); a query never finds its own row, but another row with the same
id or vector; repeated rows are found as often as they occur; fewer than k candidates
give fewer rows; ties go to the smaller vec_id; a query id that occurs with several
vectors gets the best over them; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.textblocks import mix
from evidentia.shared import keep

K, SAMPLE, BLOCK, EPSILON, SEED = 5, 20_000, 16, 2.1, 7
CELL, CELLS, QUERIES = 2_000, 20_000, 4_000  # vectors of a cell; cells, above which they grow; queries of a block
TARGET, TRIED = 0.97, 400  # recall that the probes are chosen for, and sampled queries that it is measured with
FOUND = "query_id long, vec_id long, vector long, copies int, score double"
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares can overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; an empty list takes the vector that is farthest from its centre."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        if len(empty):
            total[empty] = x[np.argsort(near.max(axis=1))[: len(empty)]]
        c = unit(np.where(np.abs(total).max(axis=1, keepdims=True) > 0, total, c))
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """Fewest lists per query that hold TARGET of the k nearest, measured by brute force within the sample."""
    step = max(1, len(x) // TRIED)
    asked = np.arange(0, len(x), step)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    k = min(k, len(x) - 1)
    if not k:
        return 1
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    own = (x @ c.T).argmax(axis=1)
    rank = np.empty((len(asked), len(c)), np.int64)
    np.put_along_axis(rank, np.argsort(-(x[asked] @ c.T), axis=1, kind="stable"), np.arange(len(c))[None, :].repeat(len(asked), 0), 1)
    reached = np.sort(np.take_along_axis(rank, own[best], 1).ravel())
    return int(reached[min(len(reached) - 1, math.ceil(TARGET * len(reached)) - 1)]) + 1


def scan(q: np.ndarray, blocks: list[np.ndarray], at: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``at`` those that may be among the k nearest to q; blocks are columns of the rotated unit vectors."""
    d, alive, bound = len(q), at, math.inf
    head = at[: 16 * k]  # the first candidates are read in full and set the bound
    if len(at) > len(head):
        full = sum(((b[head] - q[i * BLOCK : (i + 1) * BLOCK]) ** 2).sum(axis=1) for i, b in enumerate(blocks))
        bound = float(np.partition(full, k - 1)[k - 1])
    partial, t = np.zeros(len(at)), 0
    for i, b in enumerate(blocks):
        partial = partial + ((b[alive] - q[i * BLOCK : (i + 1) * BLOCK]) ** 2).sum(axis=1)
        t += b.shape[1]
        if t < d and bound < math.inf:
            stay = partial * (d / t) <= bound * (1 + EPSILON / math.sqrt(t)) ** 2 + 1e-9
            alive, partial = alive[stay], partial[stay]
        if not len(alive):
            return alive
    if len(alive) > k:
        last = np.partition(partial, k - 1)[k - 1]
        alive = alive[partial <= last + 1e-6]
    return alive


def cells_for(sizes: np.ndarray, middle: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First cell of each list and how many it has; small lists that lie in a row share one of at most ``most`` vectors."""
    order = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")
    first, count, cell, filled = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for i in order.tolist():
        if filled and filled + sizes[i] > most:
            cell, filled = cell + 1, 0
        first[i], count[i] = cell, max(1, -(-int(sizes[i]) // most))
        cell, filled = (cell + int(count[i]), 0) if count[i] > 1 else (cell, filled + int(sizes[i]))
    return first, count


def search(vectors: DataFrame, every: int = 50, k: int = K, sample: int = SAMPLE, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """The k nearest candidates of each vector whose id is divisible by ``every``."""
    rows = usable(vectors)
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for d, n in sorted((r["d"], r["n"]) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):
        out = out.unionByName(search_dimension(rows.where(F.size("v") == d), n, every, k, sample, lists, probes))
    return out


def search_dimension(rows: DataFrame, n: int, every: int, k: int, sample: int, lists: int | None, probes: int | None) -> DataFrame:
    """search() on n usable vectors of one dimension."""
    same = Window.partitionBy("v").orderBy("vec_id")
    candidates = rows.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k + 1)).cast("int").alias("copies"))
    candidates = candidates.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("vec_id", "v", "copies", F.xxhash64("v").alias("vector"))
    x = unit(matrix(rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).toArrow().column("v")))
    turn = rotation(x.shape[1])
    middle = centres(x, lists or max(1, min(round(math.sqrt(n)), len(x) // 8)))
    lists = len(middle)
    probes = min(lists, probes or probes_for(x, middle, k))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (unit(matrix(batch.column("v"))) @ middle.T).argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], [*batch.schema.names, "list"])

    kept = keep(candidates.mapInArrow(place, "vec_id long, v array<double>, copies int, vector long, list int"))
    sizes = np.zeros(lists, np.int64)
    for r in kept.groupBy("list").count().collect():  # one row a list
        sizes[r["list"]] = r["count"]
    first, count = cells_for(sizes, middle, max(CELL, n // CELLS))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            near = unit(matrix(batch.column("v"))) @ middle.T if batch.num_rows else np.zeros((0, lists))
            for i, own in enumerate(np.argsort(-near, axis=1, kind="stable")[:, :probes]):
                cell = np.repeat(first[own], count[own]) + np.arange(count[own].sum()) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
                order = np.argsort(cell, kind="stable")  # lists stay in the order of nearness
                cell, own = cell[order], np.repeat(own, count[own])[order]
                at = np.flatnonzero(np.diff(cell, prepend=-1))
                for a, b in zip(at, [*at[1:], len(cell)], strict=True):
                    for column, value in zip(out, (i, cell[a], own[a:b]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(out[0], pa.int64())), batch.column("v").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32()))], ["vec_id", "v", "cell", "lists"])

    asked = rows.where(F.col("vec_id") % every == 0).distinct().mapInArrow(aim, "vec_id long, v array<double>, cell int, lists array<int>")
    shares = np.zeros(int((first + count).max()), np.int64)
    for r in asked.groupBy("cell").count().collect():  # one row a cell
        shares[r["cell"]] = -(-r["count"] // QUERIES)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each candidate to the blocks of queries of its cell; those of cells that nobody asks stay behind."""
        for batch in batches:
            own, ids = batch.column("list").to_numpy(), batch.column("vec_id").to_numpy()
            cell = first[own] + mix(ids.astype(np.uint64)) % count[own].astype(np.uint64)
            share = shares[cell.astype(np.int64)]
            at = np.repeat(np.arange(len(own)), share)
            block = np.arange(len(at)) - np.repeat(np.cumsum(share) - share, share)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)[at]), pa.array(block, pa.int32())], [*taken.schema.names, "cell", "block"])

    def queue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = np.maximum(shares[batch.column("cell").to_numpy()], 1).astype(np.uint64)
            block = mix(batch.column("vec_id").to_numpy().astype(np.uint64)) % share
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.astype(np.int32))], [*batch.schema.names, "block"])

    left = kept.mapInArrow(spread, "vec_id long, v array<double>, copies int, vector long, list int, cell int, block int").select("cell", "block", "vec_id", "v", "copies", "vector", "list", F.lit(None).cast("array<int>").alias("lists"))
    right = asked.mapInArrow(queue, "vec_id long, v array<double>, cell int, lists array<int>, block int").select("cell", "block", "vec_id", "v", F.lit(0).alias("copies"), F.xxhash64("v").alias("vector"), F.lit(-1).alias("list"), "lists")

    def answer(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        copies, ids, own, vector = (table.column(c).to_numpy() for c in ("copies", "vec_id", "list", "vector"))
        v, asks = matrix(table.column("v")), table.column("lists")
        out: list[tuple[np.ndarray, ...]] = []
        c = np.flatnonzero(copies > 0)
        if 0 < len(c) < len(copies):
            u = unit(v) @ turn
            c = c[np.lexsort((ids[c], own[c]))]
            blocks = [np.ascontiguousarray(u[c, i : i + BLOCK]) for i in range(0, u.shape[1], BLOCK)]
            norms = np.sqrt((v * v).sum(axis=1))
            bounds = np.searchsorted(own[c], np.arange(lists + 1))
            for row in np.flatnonzero(copies == 0):
                at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in asks[int(row)].as_py()])
                found = c[scan(u[row], blocks, at, k + 1)] if len(at) else at
                mine = (ids[found] == ids[row]) & (v[found] == v[row]).all(axis=1)
                times = copies[found] - mine  # not the query's own row
                found, times = found[times > 0], times[times > 0]
                cos = (v[found] * v[row]).sum(axis=1) / (norms[found] * norms[row])
                best = np.lexsort((ids[found], -cos))[:k]
                out.append((np.full(len(best), ids[row]), ids[found][best], vector[found][best], times[best], cos[best]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
        parts = [np.concatenate(p) for p in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
        return pa.table([pa.array(p.astype(t.to_pandas_dtype()), t) for p, t in zip(parts, types, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])

    found = left.unionByName(right).groupBy("cell", "block").applyInArrow(answer, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id", "vector").agg(F.max("score").alias("score"), F.max("copies").alias("copies"))
    top = once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).withColumn("again", F.explode(F.sequence(F.lit(1), "copies")))
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "again")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
