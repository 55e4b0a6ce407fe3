"""Blocks of documents and the exchange of packed keys between blocks and key ranges.

Corpus operators here ask, for each of very many keys (hashes of windows,
fragments, words), something that depends on all documents.  A row for each key
would cost far more than the key.  Instead documents are written once, in blocks of
about ``BLOCK_BYTES`` of text, each a file of its own in the shared folder.  Rows and
shuffles only name the files, so texts neither pass through the JVM again nor travel
with the answers.  A file's name is new in each attempt, and only the rows of attempts
that succeeded are kept, so a lost executor leaves at most a file that nobody reads.
A block sends one row of packed, already deduplicated keys to each range of the key space; the range's task
answers each block with packed flags or counts in the same order.  However
frequent a key is, a block sends it once.

Key ranges are as many as spark.sql.shuffle.partitions, which is to follow the
input as for any other shuffle.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.shared import keep, new_folder

BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 60_000  # a row's number in its block fits 16 bits
BLOCK = "bid long, path string"
_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_IPC) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes | pa.Scalar) -> pa.Table:
    source = payload.as_buffer() if isinstance(payload, pa.Scalar) else pa.py_buffer(payload)
    return pa.ipc.open_stream(source).read_all().combine_chunks()


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Spark knows by this URI, and the folder's path in it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def load(path: str) -> pa.Table:
    """The documents of a block."""
    system, path = file_system(path)
    with system.open_input_file(path) as f:
        return unpack(f.read())


def to_blocks(documents: DataFrame) -> DataFrame:
    """(bid, path): all columns of the documents in compressed blocks, each written to a file in the shared folder."""
    size = len(documents.columns) and documents.columns.index("text")
    folder = new_folder(documents.sparkSession, "blocks")

    def block(bid: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        name = f"{bid}-{uuid.uuid4().hex}.arrows"
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(pack(pa.Table.from_batches(held)))
        return pa.RecordBatch.from_arrays([pa.array([bid], pa.int64()), pa.array([f"{folder}/{name}"], pa.string())], ["bid", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, held, filled = TaskContext.get().partitionId() << 24, 0, [], 0
        for batch in batches:
            at = 0
            ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(size)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                rows = sum(b.num_rows for b in held)
                to = max(at + 1, min(batch.num_rows, at + BLOCK_ROWS - rows, int(np.searchsorted(ends, before + BLOCK_BYTES - filled, "right"))))
                held.append(batch.slice(at, to - at))
                filled += int(ends[to - 1]) - before
                rows += to - at
                at = to
                if filled >= BLOCK_BYTES or rows >= BLOCK_ROWS:
                    yield block(base + n, held)
                    n, held, filled = n + 1, [], 0
        if held:
            yield block(base + n, held)

    return keep(documents.mapInArrow(run, BLOCK))


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library: nothing to trim
        return None


def tidy() -> None:
    """Give freed memory back: Python workers live on, and what one group needed would else stay with them."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def light(work: Callable) -> Callable:
    """``work`` on a group, followed by tidy()."""

    @wraps(work)
    def run(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            tidy()

    return run


def ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of 64-bit keys begins, and the end."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges, "left"), [len(sorted_keys)]])


def by_range(df: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``answer`` to all rows of one key range ``p``."""
    return df.groupBy("p").applyInArrow(light(answer), schema)


def with_blocks(blocks: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``work`` to each block's documents and the answers (bid, p, ...) that it got, in the order of p."""
    names = answers.columns
    left = blocks.select("bid", F.lit(-1).alias("p"), "path", *[F.lit(None).cast(t).alias(c) for c, t in answers.dtypes if c not in ("bid", "p")])
    right = answers.select("bid", "p", F.lit(None).cast("string").alias("path"), *[c for c in names if c not in ("bid", "p")])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("p")
        return work(load(table.column("path")[0].as_py()), table.slice(1))

    # by number: rows only name the blocks, so their bytes don't say how many tasks the work needs
    return left.unionByName(right).repartition(ranges(blocks), "bid").groupBy("bid").applyInArrow(light(run), schema)


def flags(column: pa.ChunkedArray, counts: np.ndarray) -> np.ndarray:
    """The packed bits of consecutive answers as one mask."""
    return np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(v.as_py(), np.uint8), count=int(n)).astype(bool) for v, n in zip(column, counts, strict=True)]])
