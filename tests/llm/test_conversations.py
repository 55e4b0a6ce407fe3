"""Conversation repair against a plain search over all edits, whole conversations and chunks alike."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from evidentia.llm import conversations as C


def cheapest(rows):
    """(cost, audit, repaired lines) of (role, text, fault) by plain recursion: least cost, then least letters."""
    accepted = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    due = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    @functools.cache
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            cost, letters, lines = best(i + 1, state, 0)
            found.append((cost + 4, "D" + letters, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in accepted[state]:
                    cost, letters, lines = best(i + 1, accepted[state][role[:1]], 0)
                    found.append((cost + more, "K" + letters, (f"{role}:{text}", *lines)))
                cost, letters, lines = best(i + 1, due[state][0], 0)
                found.append((cost + more + 3, "R" + letters, (f"{due[state][1]}:{text}", *lines)))
        if inserted < 4:
            cost, letters, lines = best(i, due[state][0], inserted + 1)
            found.append((cost + 3, "I" + letters, (f"{due[state][1]}:", *lines)))
        return min(found, default=(10**9, "", ()))

    return best(0, 0, 0)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append((role, text, "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "fine"))
        seen.add((role, text))
    return out


def expected(table):
    out = {}
    for conv in {r[0] for r in table}:
        left = []
        for _, turn, role, text in sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, *damaged(*r)[0][1:])):
            left += [x for x, n in [damaged(conv, turn, role, text)] for _ in range(n)]
        rows = faults([(r, t) for _, r, t in left])
        cost, audit, lines = cheapest(rows)
        turns = {t for t, _, _ in left if t is not None}
        initials = [r[:1] for _, r, _ in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        count = [sum(f == kind for _, _, f in rows) for kind in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(conv, turn, role, text):
    h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
    return (turn, "user" if h == 4 else role, text), {0: 0, 3: 2}.get(h, 1)


def rows_of(df):
    return {r.conv_id: tuple(r[c] for c in C.RESULT_NAMES[1:]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_audit_equals_plain_search(seed):
    rng, repair = random.Random(seed), C.Repair()
    kinds = {"fine": C.FINE, "blank": C.BLANK, "duplicate": C.DUPLICATE, "truncated": C.TRUNCATED}
    for _ in range(700):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), "x", rng.choice([*kinds, "fine"])) for _ in range(rng.randint(0, 14))]
        cost, letters, tail = repair.audit(bytes(C.symbol(r, kinds[f]) for r, _, f in rows))
        lines = tuple(C.repaired([*[(r, t) for r, t, _ in rows], ("", "")], [*letters, tail]))
        assert (cost, "".join(letters) + tail, lines) == cheapest(tuple(rows))
    assert len(repair.vectors) < 400


def test_states_stay_few_on_long_conversations():
    rng, repair = random.Random(9), C.Repair()
    codes = bytes(rng.choice([0, 3, 4, 7, 8, 11, 12, 1, 2]) for _ in range(200_000))
    cost, letters, tail = repair.audit(codes)
    assert len(repair.vectors) < 400 and cost > 0 and len(letters) == len(codes)


def table(seed, conversations=60, longest=14):
    rng = random.Random(seed)
    texts = ["Fine.", "fine", "Yes!", " \t", "", None, "What?  ", "日本。", "a: b\nc.", *[f"Text {k}." for k in range(30)]]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    out = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randint(1, longest)):
            out.append((conv, rng.choice([turn, turn, turn + 3, None]) if rng.random() < 0.2 else turn, rng.choice(roles[:2] if rng.random() < 0.7 else roles), rng.choice(texts)))
    return out


@pytest.mark.parametrize(("chunk_rows", "parts"), [(C.CHUNK_ROWS, 4), (1, 3), (2, 9), (5, 2)])
def test_equals_brute_force(spark, chunk_rows, parts):
    rows = table(chunk_rows)
    rows += [(500, t, ["user", "assistant"][t % 2], f"Turn {t % 70}.") for t in range(200)] + rows[:9]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows_of(C.repair(C.damaged(df), chunk_rows=chunk_rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = expected(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in got if got[k] != want[k]} == {}


def test_cases(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, dropped, "user", "Gone."), (8, -(2**63), "user", "Hi."), (8, 2**63 - 1, "assistant", "x " * 500_000 + "end.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(c).alias(c) for c in ("part", "no", "h", "copies", "codes", "again", "payload")])
    got = rows_of(C.repair_damaged(df))
    assert got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[8][0] == 2**63 - 1 and len(got) == 2
    assert rows_of(C.repair_damaged(df.where("false"))) == {}
