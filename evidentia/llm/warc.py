"""WARC archives written index first and read back by coalesced byte ranges.

Writing: each task packs its pages into archives of gzip members, one a record,
and returns an index row per record: archive, offset, length, URL, digest and
type.  Of pages with one payload of at least ``MIN_REVISIT`` bytes the smallest
page_id is stored as a response, the others as revisits of it (headers only).
An archive's name is new in each attempt, and only the rows of attempts that
succeeded reach the index, so a lost executor leaves at most an unlisted file.

Reading: index rows are selected first; those of one archive and stretch of
``STRETCH`` bytes are sorted by offset, neighbours with small gaps are read in
one request, and every record is parsed and its digest checked.  Tasks are as many
as the bytes to read ask for, however few index rows there are.

Payloads travel once, by page and digest: which pages share a payload is settled
between rows of ids and digests, so a page that is very common is no hot key of
payloads.

Cases: a null or empty html is an empty payload, a very long one is one record; null page ids and URLs are
written as such and read back as null; among rows with a page_id, a payload's
smallest one is the response, also if it is repeated, and rows without page_id
revisit it (all are responses if none has one); an empty table gives no
archives; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.blocks import file_system
from evidentia.shared import keep, new_folder

MIN_REVISIT = 100
ARCHIVE_BYTES, STRETCH, GAP = 128 << 20, 8 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def quoted(url: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quoted(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + press.compress(block + b"\r\n\r\n") + press.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP headers and payload of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {headers['WARC-Record-ID']} has a wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def page_of(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:null>" else int(urn[10:-1])


class Archive:
    """An open archive; closed and replaced when full."""

    def __init__(self, folder: str):
        self.system, path = file_system(folder)
        self.system.create_dir(path, recursive=True)
        self.path, self.out, self.size = path, None, 0

    def add(self, member: bytes) -> tuple[str, int, int]:
        if self.out is None or self.size >= ARCHIVE_BYTES:
            self.close()
            self.name = f"pages-{uuid.uuid4().hex}.warc.gz"
            self.out, self.size = self.system.open_output_stream(f"{self.path}/{self.name}", compression=None), 0
        at = self.size
        self.out.write(member)
        self.size += len(member)
        return self.name, at, len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def plan(pages: DataFrame) -> DataFrame:
    """Each page with its payload, digest and the page it revisits (null for a response)."""
    keyed = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(coalesce(html, '') as binary) payload").withColumn("digest", F.sha2("payload", 256))
    large = keep(keyed.where(F.length("payload") >= MIN_REVISIT).groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n")))
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    again = large.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to"))
    return keyed.join(again, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; returns the index, stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder)
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(k) for k in range(5)), strict=True):
                page_id, url, digest, refers_to = page_id.as_py(), url.as_py(), digest.as_py(), refers_to.as_py()
                rows.append((*archive.add(record(page_id, url, payload.as_py(), digest, refers_to)), page_id, url, digest, "response" if refers_to is None else "revisit"))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INDEX_TYPES, strict=True)], _INDEX_NAMES)
        archive.close()

    return keep(plan(pages).mapInArrow(run, INDEX))


_INDEX_NAMES = [f.split()[0] for f in INDEX.split(", ")]
_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]


def ranges(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Coalesce sorted (offset, length) places into requests: start, end and the places within."""
    group: list[tuple[int, int]] = []
    end = 0
    for offset, length in places:
        if group and (offset - end > GAP or end - group[0][0] >= STRETCH):
            yield group[0][0], end, group
            group = []
        group.append((offset, length))
        end = max(end, offset + length) if len(group) > 1 else offset + length
    if group:
        yield group[0][0], end, group


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the index rows given, parsed and checked."""

    def run(table: pa.Table) -> pa.Table:
        system, path = file_system(folder)
        rows = []
        places = sorted(set(zip(table.column("offset").to_pylist(), table.column("length").to_pylist(), strict=True)))
        with system.open_input_file(f"{path}/{table.column('archive')[0].as_py()}") as f:
            for start, end, group in ranges(places):
                data = f.read_at(end - start, start)
                for offset, length in group:
                    headers, http, payload = parse(data[offset - start : offset - start + length])
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
                    kind = headers["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"record {headers['WARC-Record-ID']} has a wrong digest")
                    rows.append((page_of(headers["WARC-Record-ID"]), size, digest, kind, page_of(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI"), payload if payloads else None))
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in RECORDS.split(", ")])

    placed = index.select("archive", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    total = placed.agg(F.sum("length").alias("n")).collect()[0]["n"] or 0
    shuffled = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(-(-total // STRETCH), max(shuffled, total // ARCHIVE_BYTES)))
    return placed.repartition(tasks, "archive", "stretch").groupBy("archive", "stretch").applyInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, read every record back, and return what the archives say."""
    folder = new_folder(pages.sparkSession, "warc")
    return read(write(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
