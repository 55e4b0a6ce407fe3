"""Repair of conversation structure by a lazily determinised weighted automaton.

The edits of a conversation are the arcs of a small weighted automaton over the roles that
may follow one another, ``(s?(ua)+)?``: keep a row, give it the role that is due, delete it,
or insert a row.  Reading a row takes the vector of the least cost of each automaton state
to the next such vector.  Less its minimum, a vector is one of few: each is a state of a
deterministic automaton, made when first met and kept in a table with the cost that the
step adds.  So a scan of a conversation is one table look-up a row, and sums up its cost.

From the end backwards a second table tells which states lie on a cheapest way: those with
a tight arc, whose cost is the difference of its ends, to such a state.  Then the way from
the beginning takes the least letter among tight arcs, which gives the audit, least in
ASCII of all cheapest ones.  Both take a look-up a row.  An entry over ``DROP`` above the
least of its vector can be on no cheapest way and is dropped: whatever follows, one state
can do as another does for ``DROP`` more at most (insert a row or two, delete one).

Rows are sorted by conversation and turn in ranges, whole conversations inside a range are
repaired as they stream by.  Those that go over an edge of a range, or have over
``CHUNK_ROWS`` rows or ``CHUNK_BYTES`` of text, become chunks in the shared folder: their
rows seen earlier are found by digest, one byte a row goes to the trace of the conversation,
and its letters come back to the chunks, whose repaired text is hashed as it streams by in order.
A conversation's audit is one cell, so it has at most 2^31 rows; more than a byte for each row
of one conversation is never in one task at once.

Cases: a null role or text, and a null conv_id or turn in the damage's hash, is one space;
rows of null conv_id are one conversation; empty and very long texts are taken whole; rows
of equal turn (null turns are equal and first) are taken by role, then text; equal rows are
duplicates; of edits of equal cost the least in ASCII are taken; a conversation of which no
row is left has zeros, an empty audit and the hash of the empty string; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.blocks import light, pack, ranges, tidy, unpack
from evidentia.shared import keep

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}  # fixed values
TRUNCATED_COST = 3
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last row is
FINAL = (START, ASSISTANT)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
DROP = 7
NONE = 1 << 30

INITIALS = "sua"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
WHITE = " \t\n\v\f\r"
CHUNK_ROWS, CHUNK_BYTES = 20_000, 8 << 20


def symbol(role: str, fault: int) -> int:
    """What the automaton reads of a row: its role's initial (any other than s, u, a is one) and its fault."""
    return (INITIALS.find(role[:1]) if role[:1] in ("s", "u", "a") else 3) * 4 + fault


class Repair:
    """The deterministic automaton, grown as rows are read."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.table: dict[int, tuple[int, int]] = {}  # state * 16 + symbol -> next state, cost added
        self.back: dict[tuple[int, int, int], int] = {}
        self.forth: dict[tuple[int, int, int, int], tuple[str, int]] = {}
        self.begin, _ = self.state([0, NONE, NONE, NONE])

    def state(self, costs: list[int]) -> tuple[int, int]:
        """The state of a vector after insertions, and its minimum."""
        for _ in range(3):  # insertions lead from a state to at most three others
            for a, b in DUE.items():
                costs[b] = min(costs[b], costs[a] + COST[INSERT])
        least = min(costs)
        vector = tuple(c - least if c - least <= DROP else NONE for c in costs)
        if vector not in self.known:
            self.known[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.known[vector], least

    @staticmethod
    def arcs(at: int, code: int) -> Iterator[tuple[str, int, int]]:
        """(letter, next state, cost) of reading a row; letters in ASCII order."""
        initial, fault = "sua?"[code >> 2], code & 3
        yield DELETE, at, COST[DELETE]
        if fault in (FINE, TRUNCATED):
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            if (at, initial) in KEPT:
                yield KEEP, KEPT[at, initial], COST[KEEP] + more
            yield REROLE, DUE[at], COST[REROLE] + more

    def step(self, state: int, code: int) -> tuple[int, int]:
        key = state << 4 | code
        if key not in self.table:
            costs = [NONE] * 4
            for a, cost in enumerate(self.vectors[state]):
                if cost < NONE:
                    for _, b, more in self.arcs(a, code):
                        costs[b] = min(costs[b], cost + more)
            self.table[key] = self.state(costs)
        return self.table[key]

    def scan(self, codes: bytes) -> tuple[list[int], int]:
        """The states before and after each row, and the least cost of all rows."""
        states, total, state, table = [self.begin], 0, self.begin, self.table
        for code in codes:
            state, more = table.get(state << 4 | code) or self.step(state, code)
            total += more
            states.append(state)
        vector = self.vectors[state]
        return states, total + min(vector[s] for s in FINAL)

    def inserted(self, vector: tuple[int, ...], marked: int) -> int:
        """The marked states and those from which tight insertions lead to them."""
        for _ in range(3):
            for a, b in DUE.items():
                if marked >> b & 1 and vector[a] < NONE and vector[a] + COST[INSERT] == vector[b]:
                    marked |= 1 << a
        return marked

    def on_way(self, state: int, code: int, marked: int) -> int:
        """The states before a row on cheapest ways to the marked ones after it."""
        key = (state, code, marked)
        if key not in self.back:
            vector, (after, added) = self.vectors[state], self.step(state, code)
            found = 0
            for a, cost in enumerate(vector):
                if cost < NONE and any(marked >> b & 1 and cost + more - added == self.vectors[after][b] for _, b, more in self.arcs(a, code)):
                    found |= 1 << a
            self.back[key] = self.inserted(vector, found)
        return self.back[key]

    def letters(self, state: int, code: int, marked: int, at: int) -> tuple[str, int]:
        """The least letters from ``at`` over one row on a cheapest way, and where they lead."""
        key = (state, code, marked, at)
        if key not in self.forth:
            vector, (after, added) = self.vectors[state], self.step(state, code)
            here, out, now = self.on_way(state, code, marked), "", at
            while True:
                found = {x: b for x, b, more in self.arcs(now, code) if marked >> b & 1 and vector[now] + more - added == self.vectors[after][b]}
                due = DUE[now]
                insert = here >> due & 1 and vector[now] + COST[INSERT] == vector[due]
                best = min([*found, *([INSERT] if insert else [])])
                out += best
                now = due if best == INSERT else found[best]
                if best != INSERT:
                    break
            self.forth[key] = (out, now)
        return self.forth[key]

    def audit(self, codes: bytes) -> tuple[int, list[str], str]:
        """Least cost, the letters for each row (insertions before it, then its own), and insertions after the last."""
        states, cost = self.scan(codes)
        vector = self.vectors[states[-1]]
        least = min(vector[s] for s in FINAL)
        marked = end = self.inserted(vector, sum(1 << s for s in FINAL if vector[s] == least))
        marks = bytearray(len(codes) + 1)
        marks[-1] = marked
        back = self.back
        for i in range(len(codes) - 1, -1, -1):
            key = (states[i], codes[i], marked)
            marked = marks[i] = back[key] if key in back else self.on_way(*key)
        out, at, forth = [], START, self.forth
        for i, code in enumerate(codes):
            key = (states[i], code, marks[i + 1], at)
            letters, at = forth[key] if key in forth else self.letters(*key)
            out.append(letters)
        tail = ""
        while not (at in FINAL and vector[at] == least):
            if not end >> DUE[at] & 1 or vector[at] + COST[INSERT] != vector[DUE[at]]:
                raise AssertionError("no tight arc")
            tail += INSERT
            at = DUE[at]
        return cost, out, tail

    @staticmethod
    def after(letters: str, initial: str, at: int) -> int:
        """Where the letters of a row lead."""
        for x in letters:
            at = DUE[at] if x in (INSERT, REROLE) else KEPT[at, initial] if x == KEEP else at
        return at


def repaired(rows: Iterable[tuple[str, str]], letters: Iterable[str], at: int = START) -> Iterator[str]:
    """``role:text`` of the rows that the edits leave; rows for letters after the last row are None."""
    for row, own in zip(rows, letters, strict=True):
        for x in own:
            if x == INSERT:
                at = DUE[at]
                yield f"{ROLE[at]}:"
            elif x == REROLE:
                at = DUE[at]
                yield f"{ROLE[at]}:{row[1]}"
            elif x == KEEP:
                at = KEPT[at, row[0][:1]]
                yield f"{row[0]}:{row[1]}"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage; of a dropped row 0 copies stay, without its text."""
    space = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(h == 0, "").when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h.isin(0, 1), "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("int").alias("copies"),
    )


class Chunk:
    """Consecutive rows of one conversation."""

    def __init__(self):
        self.turns: list[int | None] = []
        self.rows: list[tuple[str, str]] = []
        self.codes, self.digests, self.size = bytearray(), [], 0
        self.seen: set[bytes] = set()

    def add(self, turn: int | None, role: str, text: str, copies: int) -> None:
        said = text.rstrip(WHITE)
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        for _ in range(copies):
            fault = BLANK if not said else DUPLICATE if digest in self.seen else FINE if said[-1] in ".!?" else TRUNCATED
            self.seen.add(digest)
            self.turns.append(turn)
            self.rows.append((role, text))
            self.codes.append(symbol(role, fault))
            self.digests.append(digest)
            self.size += len(text) + 100

    def span(self) -> tuple[int | None, int | None, int]:
        """First and last turn that isn't null, and the number of distinct ones."""
        known = [t for t in self.turns if t is not None]
        return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def summary(codes: bytes, spans: list[tuple[int | None, int | None, int]]) -> list[int]:
    """gaps, blank, duplicate, truncated, illegal of a conversation."""
    spans = [s for s in spans if s[0] is not None]
    gaps = 0
    if spans:
        distinct = sum(n for _, _, n in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        gaps = min(spans[-1][1] - spans[0][0] + 1 - distinct, (1 << 63) - 1)
    initials = [code >> 2 for code in codes]
    legal = {(INITIALS.index(a), INITIALS.index(b)) for a, b in LEGAL}
    illegal = sum(pair not in legal for pair in zip(initials, initials[1:], strict=False))
    faults = [sum(code & 3 == fault for code in codes) for fault in (BLANK, DUPLICATE, TRUNCATED)]
    return [gaps, *faults, illegal]


STREAMED = RESULT + ", part long, no long, codes binary, low long, high long, distinct int, digests binary, payload binary"
STREAMED_NAMES = [c.split()[0] for c in STREAMED.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def stream(chunk_rows: int, chunk_bytes: int):
    """A mapInArrow function over sorted rows: results of whole conversations, chunks of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, repair = TaskContext.get().partitionId(), Repair()
        no, out, size = 0, [], 0
        current, conv, chunked, first = Chunk(), None, True, True

        def close(whole: bool) -> tuple:
            nonlocal no
            if whole:
                cost, letters, tail = repair.audit(bytes(current.codes))
                text = hashlib.sha256("\n".join(repaired([*current.rows, ("", "")], [*letters, tail])).encode())
                return (conv, *summary(current.codes, [current.span()]), cost, "".join(letters) + tail, text.hexdigest(), *[None] * 8)
            no += 1
            payload = pack(pa.table({"role": pa.array([r for r, _ in current.rows], pa.string()), "text": pa.array([t for _, t in current.rows], pa.string())}))
            return (conv, *[None] * 8, part, no, bytes(current.codes), *current.span(), b"".join(current.digests), payload)

        for batch in batches:
            for conv_id, turn, role, text, copies in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if first or conv_id != conv:
                    if not first:
                        out.append(close(whole=not chunked))
                        size += current.size
                        chunked = False
                    current, conv, first = Chunk(), conv_id, False  # the first of a range may have begun in the one before
                elif len(current.rows) >= chunk_rows or current.size >= chunk_bytes:
                    out.append(close(whole=False))
                    size += current.size
                    current, chunked = Chunk(), True
                current.add(turn, role, text, copies)
                if len(out) >= 2000 or size >= chunk_bytes:
                    yield batch_of(out, STREAMED)
                    out, size = [], 0
        if not first:
            out.append(close(whole=False))  # may go on in the next range
        if out:
            yield batch_of(out, STREAMED)
        tidy()

    return run


def seen_earlier(chunks: DataFrame) -> DataFrame:
    """(part, no, again): the rows of each chunk that an earlier chunk of its conversation has too, as packed numbers."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, no, codes, packed in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                rows = [(conv, part, no, k, packed[16 * k : 16 * k + 16]) for k, code in enumerate(codes) if code & 3 in (FINE, TRUNCATED)]
                yield batch_of(rows, "conv_id long, part long, no long, row int, digest binary")

    rows = chunks.select("conv_id", "part", "no", "codes", "digests").mapInArrow(digests, "conv_id long, part long, no long, row int, digest binary")
    # a chunk names a digest once, so a hot one is reduced before it travels
    first = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "no")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    twice = rows.join(first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    return twice.where(F.struct("part", "no") != F.col("first")).groupBy("part", "no").agg(F.collect_list("row").alias("again"))


def trace(table: pa.Table) -> pa.Table:
    """The audit of one conversation from one byte a row: the letters of each chunk, the summary with the first."""
    table = table.sort_by([("part", "ascending"), ("no", "ascending")])
    rows = table.to_pylist()
    codes = b"".join(r["codes"] for r in rows)
    cost, letters, tail = Repair().audit(codes)
    spans = [(r["low"], r["high"], r["distinct"]) for r in rows]
    whole = [*summary(codes, spans), cost, "".join(letters) + tail]
    out, begin, at = [], 0, START
    for k, r in enumerate(rows):
        own = letters[begin : begin + len(r["codes"])]
        last = k == len(rows) - 1
        out.append((r["part"], r["no"], at, ",".join([*own, tail if last else ""]), *(whole if k == 0 else [None] * 7)))
        for x, code in zip(own, r["codes"], strict=True):
            at = Repair.after(x, "sua?"[code >> 2], at)
        begin += len(own)
    return pa.Table.from_batches([batch_of(out, TRACED)])


TRACED = "part long, no long, at int, letters string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that were seen earlier as duplicates."""
    for batch in batches:
        codes = []
        for row, again in zip(batch.column(3).to_pylist(), batch.column(7).to_pylist(), strict=True):
            row = bytearray(row)
            for k in again or ():
                row[k] = row[k] & ~3 | DUPLICATE
            codes.append(bytes(row))
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(codes, pa.binary()), *[batch.column(i) for i in range(4, 7)]], batch.schema.names[:7])


MARKED = "conv_id long, part long, no long, codes binary, low long, high long, distinct int"


def chunk_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows of each chunk, each ended by a line feed."""
    for batch in batches:
        for row in batch.to_pylist():
            rows = unpack(row["payload"])
            letters = row["letters"].split(",")
            pairs = [*zip(rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True), ("", "")]
            text = "".join(line + "\n" for line in repaired(pairs, letters, row["at"]))
            yield batch_of([(row["conv_id"], *[row[c] for c in RESULT_NAMES[1:-1]], row["part"], row["no"], text.encode())], CHUNK_TEXT)


CHUNK_TEXT = ", ".join(RESULT.split(", ")[:-1]) + ", part long, no long, lines binary"


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its chunks in order; only a hash is held between chunks."""
    head, digest, ended = None, None, b""
    for batch in batches:
        for row in batch.to_pylist():
            if head is None or row["conv_id"] != head[0]:
                if head is not None:
                    yield batch_of([(*head, digest.hexdigest())], RESULT)
                head, digest, ended = [row[c] for c in RESULT_NAMES[:-1]], hashlib.sha256(), b""
            if row["lines"]:  # the last line feed counts only if a line follows
                digest.update(ended + row["lines"][:-1])
                ended = b"\n"
    if head is not None:
        yield batch_of([(*head, digest.hexdigest())], RESULT)


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text, copies)."""
    # the beginnings of role and text only keep rows of one turn from being one range
    placed = rows.repartitionByRange(ranges(rows), "conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32))
    streamed = keep(placed.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(stream(chunk_rows, chunk_bytes), STREAMED))
    done = streamed.where("part IS NULL").select(*RESULT_NAMES)
    chunks = streamed.where("part IS NOT NULL")
    again = seen_earlier(chunks)
    flagged = chunks.select(*[c.split()[0] for c in MARKED.split(", ")]).join(again, ["part", "no"], "left").select("conv_id", "part", "no", "codes", "low", "high", "distinct", "again")
    traced = flagged.mapInArrow(marked, MARKED).groupBy("conv_id").applyInArrow(light(trace), TRACED)
    texts = chunks.select("conv_id", "part", "no", "payload").join(traced, ["part", "no"]).mapInArrow(chunk_texts, CHUNK_TEXT)
    rest = texts.repartition(ranges(rows), "conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(hashed, RESULT)
    return done.unionByName(rest)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The structure, cheapest repair and repaired text of every conversation after the damage."""
    return repair(damaged(conversations))
