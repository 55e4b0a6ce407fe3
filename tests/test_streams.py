"""Progressive packs and snapshot deltas: a stream that is stopped and started again equals one batch."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators.load_model import update_snapshot
from evidentia.streaming import packs, snapshots

REQUEST = "request string, round long, digest string, work long, bytes long"


def requests(seed):
    rng = random.Random(seed)
    parts = [[], []]
    for r in range(12):
        last = 0
        for part in parts:
            for _ in range(rng.randint(1, 12)):
                last += rng.choice([0, 1, 1, 1, 1, 2])
                part.append((f"r{r}", last, rng.choice("ab"), rng.randint(0, 9), rng.randint(0, 50)))
    return parts


def folded(parts, most_work, most_bytes):
    states, out = {}, []
    for part in parts:
        for request, round_, digest, work, bytes_ in sorted(part):
            outcome, state = packs.charge(states.get(request, packs.FRESH), round_, digest, work, bytes_, most_work, most_bytes)
            states[request] = state
            out.append((request, round_, outcome, state[2], state[3], state[4]))
    return sorted(out)


def test_progressive_packs_after_a_restart(spark, tmp_path):
    parts = requests(4)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in parts:  # each run is a stream of its own that goes on from the checkpoint
        spark.createDataFrame(part, REQUEST).coalesce(1).write.mode("append").parquet(source)
        stream = packs.rounds(spark.readStream.schema(REQUEST).parquet(source), 20, 400)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(packs.RECEIPT).parquet(out).collect())
    want = folded(parts, 20, 400)
    assert got == want and {o for _, _, o, _, _, _ in want} >= {"accepted", "repeated", "out_of_order", "budget_exhausted", "closed"}


def test_progressive_packs_of_a_table(spark):
    rows = [row for part in requests(5) for row in part]
    df = spark.createDataFrame([*rows, (None, 1, None, None, None)], REQUEST)
    got = sorted(tuple(r) for r in packs.rounds(df, 10**6, 10**6).collect())
    assert got == sorted([*folded([rows], 10**6, 10**6), ("", 1, "accepted", 0, 0, 0)])


def test_rounds_end():
    state = packs.FRESH
    for n in range(1, 17):
        outcome, state = packs.charge(state, n, "d", 1, 1, 100, 100)
        assert outcome == "accepted"
    assert packs.charge(state, 16, "d", 1, 1, 100, 100)[0] == "repeated" and packs.charge(state, 16, "e", 1, 1, 100, 100)[0] == "out_of_order"
    outcome, state = packs.charge(state, 17, "d", 1, 1, 100, 100)
    assert outcome == "rounds_exhausted" and packs.charge(state, 17, "d", 1, 1, 100, 100)[0] == "closed"


CHANGE = "key string, action string, expected string, digest string"
DELTAS = [
    [("a", "update", "1", "2"), ("c", "add", None, "1")],
    [("b", "remove", "9", None), ("d", "add", None, "1")],  # the first fails: nothing changes
    [("b", "remove", "1", None), ("a", "update", "2", "2")],
    [("e", "add", None, "1"), ("e", "add", None, "2")],  # two changes of one key
]


@pytest.mark.parametrize("stops", [[1, 1, 1, 1], [2, 2], [4]])
def test_deltas_after_restarts(spark, tmp_path, stops):
    begin = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, digest string")
    store, source = str(tmp_path / "store"), str(tmp_path / "in")
    deltas, at = [spark.createDataFrame(d, CHANGE).coalesce(1) for d in DELTAS], 0
    snapshots.Snapshots(spark, store).begin(begin)
    version = 0
    for n in stops:
        for k in range(at, at + n):
            deltas[k].write.mode("append").parquet(f"{source}/delta-{k}")
        at += n
        held = snapshots.Snapshots(spark, store)  # a session of its own
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        version = held.run(stream)
    assert version == 4
    old = begin
    for n, delta in enumerate(deltas[:3], 1):
        _, old = update_snapshot(old, delta)
        assert sorted(map(tuple, held.read(n).collect())) == sorted(map(tuple, old.select("key", "digest").collect()))
    assert sorted(map(tuple, held.read(4).collect())) == [("a", "2"), ("c", "1")]
    told = {(r.key, r.batch): r.outcome for r in held.outcomes(4).collect()}
    assert told == {("a", 0): "update", ("c", 0): "add", ("b", 1): "failed", ("d", 1): "add", ("b", 2): "remove", ("a", 2): "no_op", ("e", 3): "failed"}


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    held = snapshots.Snapshots(spark, str(tmp_path / "s"))
    held.begin(spark.createDataFrame([("a", "1")], "key string, digest string"))
    delta = spark.createDataFrame([("a", "update", "1", "2")], CHANGE)
    held.apply(delta, 0)
    held.apply(delta, 0)
    assert [tuple(r) for r in held.read(1).collect()] == [("a", "2")] and held.outcomes(1).where(F.col("outcome") == "update").count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_the_edit_log_of_a_table_equals_the_fold(spark, seed):
    from evidentia.streaming import changes

    rng, rows = random.Random(seed), []
    for d in range(8):
        version, digest = 1, "d0"
        for seq in range(40):
            kind = rng.choices(["snapshot", "change", "repeat", "bad"], [2, 8, 2, 1])[0]
            if kind == "snapshot":
                version, digest = rng.randint(1, 5), f"d{rng.randint(0, 3)}"
                rows.append((f"doc{d}", seq, "snapshot", version, rng.choice([None, "x"]), digest))
            elif kind == "change":
                new = f"d{rng.randint(0, 3)}"
                rows.append((f"doc{d}", seq, "change", version + 1, digest, new))
                version, digest = version + 1, new
            elif kind == "repeat" and rows and rows[-1][0] == f"doc{d}":
                rows.append((f"doc{d}", seq, "change", *rows[-1][3:]))
            else:
                rows.append((f"doc{d}", seq, "change", rng.randint(1, 9), rng.choice([None, "d1"]), rng.choice([None, "d2"])))
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in changes.fold_batch(spark.createDataFrame(rows, changes.CHANGE)).collect())
    want = []
    for d in range(8):
        out, _ = changes.fold([r[1:] for r in sorted((r for r in rows if r[0] == f"doc{d}"), key=lambda r: r[1])], None)
        want += [(f"doc{d}", *o) for o in out]
    assert got == sorted(want)
