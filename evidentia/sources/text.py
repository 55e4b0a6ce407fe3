"""Readers of text sources: manifests, pinned texts, data literals, inventories; markup is read by `markup`."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def inventory(spark: SparkSession, root: str, pattern: str = "*.lua", most_files: int = 4_096, most_bytes: int = 8 << 20) -> DataFrame:
    """Files below a folder with their digests; too many or too large files are an error, never a shorter list."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    found = files.select("path", "length").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("largest")).collect()[0]
    if found["n"] > most_files or (found["largest"] or 0) > most_bytes:
        raise ValueError(f"{found['n']} files, the largest of {found['largest']} bytes, are beyond the limits")
    return files.select("path", "length", F.sha2("content", 256).alias("digest"), F.decode("content", "utf-8").alias("text"))


def pinned(documents: DataFrame, pins: DataFrame, key: str, text: str) -> DataFrame:
    """ok, digest_mismatch or missing for each pin."""
    own = documents.select(key, F.sha2(text, 256).alias("digest"))
    state = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") == F.col("expected"), "ok").otherwise("digest_mismatch")
    return pins.join(own, key, "left").select(key, state.alias("state"))


def strict_json(text: str, most_bytes: int = 1 << 20) -> object:
    """Parse JSON; too large texts, repeated keys, floats and nulls are errors."""
    if len(text.encode()) > most_bytes:
        raise ValueError("too large")

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        if any(v is None for _, v in pairs):
            raise ValueError("null")
        return dict(pairs)

    def no_float(x: str) -> None:
        raise ValueError(f"float {x}")

    return json.loads(text, object_pairs_hook=once, parse_float=no_float, parse_constant=no_float)


def json_state(text: str, most_bytes: int = 1 << 20) -> tuple[str, str | None]:
    """(state, canonical text): ok, or too_large, repeated_key, null, float or invalid without a text."""
    try:
        return "ok", json.dumps(strict_json(text, most_bytes), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except json.JSONDecodeError:
        return "invalid", None
    except RecursionError:
        return "too_deep", None
    except ValueError as e:
        return str(e).split(" ")[0].replace("too", "too_large").replace("repeated", "repeated_key"), None


def strict_documents(documents: DataFrame, key: str, text: str, most_bytes: int = 1 << 20) -> DataFrame:
    """(key, state, json) of each text: strictly parsed and written canonically, or why it was refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json_state(t or "", most_bytes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], [key, "state", "json"])

    return documents.select(key, text).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, state string, json string")


def manifest_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Each line with its place, kind (blank, metadata, comment, file) and byte range."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    kind = F.when(F.trim("content") == "", "blank").when(F.col("content").startswith("##"), "metadata").when(F.col("content").startswith("#"), "comment").otherwise("file")
    n = F.octet_length("content").cast("long")
    end = F.sum(n + 1).over(Window.partitionBy(key).orderBy("line"))
    return lines.select(key, "line", "content", kind.alias("kind"), (end - n - 1).alias("byte_start"), (end - 1).alias("byte_end"))


SECTIONS = {"Functions": "function", "Events": "event", "Tables": "table"}


def normalized(literals: DataFrame, key: str) -> DataFrame:
    """(key, section, ordinal, name, member, position, field, value) of flattened registrations (key, path, kind, value): functions, events and tables apart, their arguments, returns, payload or fields by position.

    A path outside the three sections, or one that is no field of a registration nor of a
    member of it, is kept with section other and what is deeper in ``field``, so nothing
    that was registered is lost.
    """
    parts = F.split("path", "[.]")
    at = lambda i: F.get(parts, F.lit(i))
    deep, fits = F.size(parts) >= 5, F.size(parts).isin(3, 5)
    section = F.coalesce(*[F.when((at(0) == word) & fits, name) for word, name in SECTIONS.items()], F.lit("other"))
    names = literals.where(F.size(parts) == 3).where(at(2) == "Name").select(F.col(key), at(0).alias("s"), at(1).alias("o"), F.col("value").alias("name"))
    rest = F.array_join(F.slice(parts, F.when(deep, 5).otherwise(F.least(F.lit(3), F.size(parts))), F.size(parts)), ".")
    rows = literals.select(F.col(key), section.alias("section"), at(0).alias("s"), at(1).alias("o"), F.when(deep, at(2)).alias("member"), F.when(deep, at(3)).try_cast("int").alias("position"), rest.alias("field"), "value")
    return rows.join(names, [key, "s", "o"], "left").select(key, "section", F.col("o").try_cast("int").alias("ordinal"), "name", "member", "position", "field", "value")


TOPOLOGY = "file string, loads array<string>, references array<struct<name:string,kind:string>>"


def topology(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Load edges (key, file, position, loads), references (key, file, position, name, kind) and problems (key, file, problem) of topology documents: a JSON array of files with what each loads, in order, and what it refers to.

    invalid_document: no such array; missing_file, repeated_file, self_load and
    unknown_load (a file that the document does not describe) are told apart.
    """
    parsed = documents.select(key, F.from_json(text, f"array<struct<{TOPOLOGY.replace(' ', ':', 1).replace(', loads ', ',loads:').replace(', references ', ',references:')}>>", {"mode": "PERMISSIVE"}).alias("files"))
    bad = parsed.where("files is null").select(key, F.lit(None).cast("string").alias("file"), F.lit("invalid_document").alias("problem"))
    files = parsed.select(key, F.posexplode("files").alias("ordinal", "f")).select(key, "ordinal", "f.file", "f.loads", "f.references")
    edges = files.where("file is not null").select(key, "file", F.posexplode("loads").alias("position", "loads"))
    references = files.where("file is not null").select(key, "file", F.posexplode("references").alias("position", "r")).select(key, "file", "position", "r.name", "r.kind")
    known = files.select(key, F.col("file").alias("loads"), F.lit(True).alias("known")).distinct()
    problem = lambda df, what: df.select(key, "file", F.lit(what).alias("problem"))
    problems = bad.unionByName(problem(files.where("file is null"), "missing_file"))
    problems = problems.unionByName(problem(files.where("file is not null").groupBy(key, "file").count().where("count > 1"), "repeated_file"))
    problems = problems.unionByName(problem(edges.where("file = loads"), "self_load")).unionByName(problem(edges.join(known, [key, "loads"], "left").where("known is null"), "unknown_load"))
    return edges, references, problems.distinct()


_TOKEN = re.compile(r"\s*(?:--[^\n]*\n\s*)*(?:(?P<punct>[{}=,;\[\]])|(?P<string>\"(?:[^\"\\]|\\.)*\")|(?P<number>-?\d+(?:\.\d+)?|0x[0-9a-fA-F]+)|(?P<name>[A-Za-z_][\w.]*))")


def literal_rows(text: str) -> list[tuple[str, str, str]]:
    """(path, kind, value) of a table of data literals; ValueError for anything to be executed or left open."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"not a data literal at {at}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    out: list[tuple[str, str, str]] = []
    path: list[str] = []
    counts: list[int] = []
    i = 0
    while i < len(tokens):
        kind, value = tokens[i]
        name = None
        if kind == "name" and i + 1 < len(tokens) and tokens[i + 1] == ("punct", "="):
            name, i = value, i + 2
            if i == len(tokens):
                raise ValueError(f"{name} has no value")
            kind, value = tokens[i]
        if (kind, value) in (("punct", ","), ("punct", ";")) and name is None:
            i += 1
            continue
        if (kind, value) == ("punct", "}") and name is None:
            if not counts:
                raise ValueError("a table is closed that was not opened")
            counts.pop()
            if path:
                path.pop()
            i += 1
            continue
        if name is None and counts:
            counts[-1] += 1
            name = str(counts[-1])
        here = [*path, name] if name is not None else path
        if (kind, value) == ("punct", "{"):
            if counts:
                path.append(name)
            counts.append(0)
        elif kind == "string":
            out.append((".".join(here), "string", value[1:-1]))
        elif kind == "number":
            out.append((".".join(here), "number", value))
        elif kind == "name":
            out.append((".".join(here), "boolean" if value in ("true", "false") else "nil" if value == "nil" else "reference", value))
        else:
            raise ValueError(f"unexpected {value!r}")
        i += 1
    if counts:
        raise ValueError("a table is left open")
    return out


def literal_outcome(text: str | None) -> tuple[str, str | None, list[tuple[str, str, str]]]:
    """complete or malformed, why, and the values."""
    try:
        return "complete", None, literal_rows(text or "")
    except ValueError as e:
        return "malformed", str(e), []


def data_literals(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Flattened values of table literals: key, path, kind, value.  A malformed text has none; `literal_states` tells which those are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *r) for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in literal_outcome(value)[2]]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, pa.string(), pa.string(), pa.string()], strict=True)], [key, "path", "kind", "value"])

    return documents.select(key, text).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, path string, kind string, value string")


def literal_states(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, state, reason, n) of each text: complete with its number of values, or malformed and why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [literal_outcome(value) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.string()), pa.array([len(t[2]) for t in told], pa.int64())], [key, "state", "reason", "n"])

    return documents.select(key, text).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, state string, reason string, n long")
