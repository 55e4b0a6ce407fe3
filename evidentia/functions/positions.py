"""Byte offsets and line/column positions in UTF-8, UTF-16 and UTF-32 units."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

UNITS = {"utf-8": lambda s: len(s.encode()), "utf-16": lambda s: len(s.encode("utf-16-le")) // 2, "utf-32": len}


def position_of(text: str, offset: int, unit: str = "utf-16") -> tuple[int, int] | None:
    """0-based line and column of a byte offset; None within a character or between CR and LF, or outside the text."""
    raw = text.encode()
    if not 0 <= offset <= len(raw) or (offset < len(raw) and raw[offset] & 0xC0 == 0x80) or raw[offset - 1 : offset + 1] == b"\r\n":
        return None
    head = raw[:offset].decode().replace("\r\n", "\n").replace("\r", "\n")
    line = head.rpartition("\n")[2]
    return head.count("\n"), UNITS[unit](line)


def offset_of(text: str, line: int, column: int, unit: str = "utf-16") -> int | None:
    """Byte offset of a position; None if it is beyond its line or splits a character."""
    at, n = 0, 0
    for part in text.splitlines(keepends=True) or [""]:
        if n == line:
            body = part.rstrip("\r\n")
            for k in range(len(body) + 1):
                if UNITS[unit](body[:k]) == column:
                    return at + len(body[:k].encode())
            return None
        at, n = at + len(part.encode()), n + 1
    return at if line == n and column == 0 and text.endswith(("\n", "\r")) else None


def positions(rows: DataFrame, text: str, offset: str, unit: str = "utf-16") -> DataFrame:
    """Adds line and character columns for each row's byte offset."""
    names = [*rows.columns, "line", "character"]
    at, where = names.index(text), names.index(offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [position_of(t or "", o, unit) if o is not None else None for t, o in zip(batch.column(at).to_pylist(), batch.column(where).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f and f[0] for f in found], pa.int64()), pa.array([f and f[1] for f in found], pa.int64())], names)

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("line", T.LongType()), T.StructField("character", T.LongType())]))
