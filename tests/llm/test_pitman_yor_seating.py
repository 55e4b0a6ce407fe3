"""A sweep of the bigram model reseats every customer, and table counts follow their distribution."""

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import pitman_yor


def alone(n, count, others, single, all_tables):
    """n pairs, each with its own context and word."""
    state = {"context": np.arange(n), "count": np.full(n, count), "hot": np.full(n, -1), "word": np.arange(n), "single": np.full(n, single), "size": np.full(n, count), "pair": np.arange(n)}
    heads = np.array([50, 25, 50, 25, 1000, 100_000, all_tables])  # discounts of 1/2
    return state, {"heads": heads}, lambda s: {"heads": heads, "tables": others + np.bincount(s["pair"], minlength=n)}


def test_frequent_pairs_get_their_tables():
    state, _, total = alone(1, 20_000, 2_000, 500, 1_000)
    pitman_yor.seat(state, pitman_yor.Model(total(state), 0), [0])
    assert len(state["size"]) > 100  # was at most one for each of a few steps
    assert state["size"].sum() == 20_000


@pytest.mark.parametrize("count", [2, 5, 16, 60])
def test_table_counts_follow_their_distribution(count):
    n, others, single, all_tables, d = 3_000, 30, 20, 400, 0.5
    state, _, total = alone(n, count, others, single, all_tables)
    means = []
    for number in range(40):
        pitman_yor.seat(state, pitman_yor.Model(total(state), 0), [number])
        if number >= 20:
            means.append(len(state["size"]) / n)
    assert (np.bincount(state["pair"], state["size"], n) == count).all()
    stirling = np.array([0.0, 1.0])  # generalised Stirling numbers of one customer
    for c in range(1, count):
        t = np.arange(c + 2)
        stirling = np.concatenate([[0.0], stirling[:c + 1]]) + np.concatenate([(c - d * t[: c + 1]) * stirling, [0.0]])
    t = np.arange(1, count + 1)
    step = np.log((1 + d * (others + t - 1)) * (single + t - 1 - d) / (1 + all_tables))
    log = np.log(stirling[1:]) + np.cumsum(step)
    p = np.exp(log - log.max())
    assert np.mean(means) == pytest.approx((p * t).sum() / p.sum(), rel=0.03)


def test_probabilities_sum_to_one_and_follow_the_seating():
    rng = np.random.default_rng(3)
    n_words, n_contexts = 40, 12  # the last word is in no training text
    count = np.maximum(rng.integers(-6, 9, (n_words, n_contexts)), 0) * rng.integers(1, 6, (n_words, n_contexts))
    count[-1] = 0
    count[:-1, 0] += 1  # every other word is known
    keys, contexts = np.arange(n_words, dtype=np.uint64) + 5, np.arange(n_contexts, dtype=np.uint64) + 100
    step = np.tile(np.arange(n_contexts) == 0, n_words).astype(np.int64)
    step[0] = 0
    data = pitman_yor.packed(keys=keys, hot=np.full(n_words, -1, np.int16), step=step, contexts=contexts, context=np.tile(np.arange(n_contexts), n_words), count=count.ravel().astype(np.int64))
    first = pitman_yor.gather(pa.table({"p": pa.array([0], pa.int32()), "bid": [0], "data": pa.array([data], pa.binary())}), 0, 1)
    kind = lambda t, *k: t.filter(pa.compute.is_in(t.column("kind"), pa.array(k, pa.int32())))
    total = {}
    for value in kind(first, pitman_yor.SUMS).column("data"):
        total |= pitman_yor.fields(value)
    register, state = pitman_yor.book(kind(first, pitman_yor.ASK)), first
    whole = kind(register, pitman_yor.WHOLE)
    for number in range(6):
        state = pitman_yor.reseat(pa.concat_tables([kind(state, pitman_yor.SEATS), kind(register, pitman_yor.TELL)]), total, 0, number)
        register = pitman_yor.change(pa.concat_tables([kind(register, pitman_yor.BOOK), kind(state, pitman_yor.ASK)]))
        for value in kind(state, pitman_yor.SUMS).column("data"):
            total["heads"] = total["heads"] + pitman_yor.fields(value)["heads"]
    model = pitman_yor.Model(total, 0)
    tag = lambda t: t.set_column(2, "tag", pa.array([0] * t.num_rows, pa.int64()))
    told = pitman_yor.last(pa.concat_tables([whole, tag(kind(register, pitman_yor.BOOK))]))
    out = pitman_yor.answer(pa.concat_tables([kind(first, pitman_yor.PAIRS, pitman_yor.SENT), tag(kind(state, pitman_yor.SEATS)), told]), [model])
    p = 10.0 ** pitman_yor.fields(out.column("data")[0])["log"].astype(float).reshape(n_words, n_contexts)
    assert p.sum(axis=0) == pytest.approx(np.ones(n_contexts), abs=1e-5)  # logarithms travel in single precision
    # the formula on the same seating, pair by pair
    (_, seats), tables = pitman_yor.of_kind(state, pitman_yor.SEATS)[0], (count > 0).astype(int)
    many = np.argwhere(count > 1)
    for (w, u), t in zip(many, np.bincount(seats["pair"], minlength=len(many)), strict=True):
        tables[w, u] = t
    assert (tables <= count).all() and (tables > 1).any() and tables.sum() == model.all_tables
    d1, d0, types = model.discount1, model.discount0, n_words - 1
    for w in range(n_words):
        n_w = tables[w].sum()
        parent = (n_w - d0 if n_w else 1 + d0 * types) / (1 + tables.sum())
        for u in range(n_contexts):
            expect = (count[w, u] - d1 * tables[w, u] + (1 + d1 * tables[:, u].sum()) * parent) / (1 + count[:, u].sum())
            assert p[w, u] == pytest.approx(expect, rel=1e-5)
