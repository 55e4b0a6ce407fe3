"""Places where the n-gram join's pairs meet: far more pairs arrive than a task may hold."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import ngram_join as N
from evidentia.llm.blocks import unpack


def place(sets: int, times: int, rows: int) -> pa.Table:
    """All pairs of a family, each told ``times`` times, as rows of packed pairs."""
    x, y = np.triu_indices(sets, 1)
    x, y = np.tile(x + (7 << 40), times), np.tile(y + (7 << 40), times)
    order = np.random.default_rng(5).permutation(len(x))
    ones = np.ones(len(x), np.int32)
    columns = [c[order] for c in (x, y, ones, 40 * ones, 40 * ones, np.where((x + y) % 3 == 0, times + 1, times).astype(np.int32))]
    cells = [[c[i::rows] for c in columns] for i in range(rows)]
    return pa.table({"p": pa.array([3] * rows, pa.int32()), "pairs": pa.array([len(c[0]) for c in cells], pa.int64()), "shared": pa.array([N.packed_pairs(c) for c in cells], pa.binary())})


def verified(made: pa.Table) -> list[tuple[int, int]]:
    found = []
    for g, value in zip(made.column("g").to_pylist(), made.column("task"), strict=True):
        if value.is_valid:
            ids, x, y = (np.asarray(unpack(value).column(c)[0].values) for c in ("ids", "x", "y"))
            sent = made.filter(pa.compute.and_(pa.compute.equal(made.column("g"), g), pa.compute.is_null(made.column("task")))).column("node").to_pylist()
            assert sorted(sent) == ids.tolist()
            found += zip(ids[x].tolist(), ids[y].tolist(), strict=True)
    return found


@pytest.mark.parametrize("most", [0, 3])
def test_slices_of_a_place_verify_the_same_pairs(monkeypatch, most):
    table = place(60, 4, 9)
    whole = verified(N.tasks(table, most))
    monkeypatch.setattr(N, "HELD", 500)
    monkeypatch.setattr(N, "PAIRS", 300)
    assert max(len(s[0]) for s in N.slices(table)) < 2_000 < sum(table.column("pairs").to_pylist())
    made = N.tasks(table, most)
    cut = verified(made)
    assert set(cut) == set(whole)
    if not most:
        assert len(cut) == len(whole) == sum((a + b) % 3 != 0 for a in range(60) for b in range(a)) and made.column("task").null_count < made.num_rows - 1


def test_a_place_is_not_held_unpacked():
    table = place(800, 10, 40)  # 3.2 million pairs arrive, 102 MB unpacked
    tracemalloc.start()
    N.tasks(table, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_a_family_of_many_pairs_has_several_spots(spark):
    sizes = {1: 3_000, 5: 1_900}
    home = spark.createDataFrame([(100_000 * h + i, h) for h, n in sizes.items() for i in range(n)], "node long, home long")
    found = {h: {} for h in sizes}
    for node, spot in N.spots(home).collect():
        found[node // 100_000].setdefault(spot, []).append(node)
    assert len(found[5]) == 1 and len(found[1]) == 3
    assert sum(map(len, found[1].values())) == 3_000 and max(map(len, found[1].values())) * 3_000 / 2 < 1.2 * N.MEETING
