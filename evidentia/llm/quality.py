"""Quality by a generalised additive model with pairwise interactions.

Every document becomes a row of surface measures (`FEATURES`), each cut into at
most `BINS` bins at quantiles of the learning sample.  The model is an intercept,
one lookup table per measure, and one table per chosen pair of measures:

    log odds = b + sum_j f_j[bin_j] + sum_jk g_jk[bin_j, bin_k]

Tables are learnt by cyclic boosting: in turn each measure gets one shallow tree
over its bins (at most `LEAVES` leaves) fitted to the gradient of the log loss,
added with a small step; then the pairs with the strongest remaining interaction
get trees of one split per side.  A tree over bins is a step function, so the sum
of all trees is a table, and scoring is one addition per table for a whole batch.

Learning looks at no more than ``max_labelled`` labelled documents; scoring
covers every document and the whole of each text.

Cases: a null or empty text has all measures 0 and gets the score of those; a
very long text is measured whole; a null id is kept; repeated rows and equal texts
are scored alike, and learnt from once; of rows with one id the smallest text is
learnt from; without labels every score is 0.5, with one class only that class's
smoothed share; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.labelled import MAX_LABELLED, crc_part, labelled_texts, pick
from evidentia.llm.textblocks import WordSlice, mix, word_slices

BINS, COARSE, LEAVES, PAIRS = 32, 8, 3, 6
ROUNDS, PAIR_ROUNDS, STEP, LEAST = 250, 120, 0.1, 5.0
FEATURES = (
    "words", "mean_word", "long_words", "short_words", "upper", "digits", "symbols", "punctuation", "non_ascii",
    "word_symbol_tails", "bare_symbols", "repeats", "distinct", "distinct_pairs", "top_word", "words_a_line", "repeated_lines",
)

_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in "#$%&*|!~^<>{}[]\\/@_=+"]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[128:] = 6


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _groups(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and the count of its most frequent one."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
    size = np.diff(np.concatenate([first, [len(k)]]))
    top = np.zeros(n)
    np.maximum.at(top, d[first], size)
    return np.bincount(d[first], minlength=n).astype(float), top


def measures(s: WordSlice) -> np.ndarray:
    """One row of FEATURES for each document of a slice."""
    n, doc, words = s.n_docs, s.doc, s.counts.astype(float)
    length = (s.ends - s.starts).astype(float)
    kind = _CLASS[s.data]
    total = [np.concatenate([[0], np.cumsum(kind == c)]) for c in range(1, 7)]
    inside = [np.bincount(doc, t[s.ends] - t[s.starts], n) for t in total] if len(doc) else [np.zeros(n)] * 6
    letters = np.bincount(doc, length, n) if len(doc) else np.zeros(n)
    per = lambda mask: np.bincount(doc[mask], minlength=n).astype(float)
    tail = kind[s.ends - 1] if len(doc) else np.zeros(0, np.uint8)
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (s.hashes[1:] == s.hashes[:-1])
    distinct, top = _groups(doc, s.hashes, n)
    pairs = np.flatnonzero(doc[1:] == doc[:-1])
    distinct_pairs, _ = _groups(doc[pairs], mix(s.hashes[pairs] * np.uint64(3) + s.hashes[pairs + 1]), n)
    # lines: a line is its words in order; its hash is the sum of hashes by place
    breaks = np.concatenate([[0], np.cumsum(s.data == 10)])
    line = breaks[s.starts] if len(doc) else np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        placed = mix(s.hashes + (np.arange(len(doc)) - np.repeat(new, np.diff(np.concatenate([new, [len(doc)]])))).astype(np.uint64))
        lines = np.add.reduceat(placed, new) if len(new) else np.zeros(0, np.uint64)
    n_lines = np.bincount(doc[new], minlength=n).astype(float)
    distinct_lines, _ = _groups(doc[new], lines, n)
    return np.stack(
        [
            words, _share(letters, words), _share(per(length > 14), words), _share(per(length <= 3), words),
            *(_share(inside[c], letters) for c in (1, 2, 3, 4, 5)),
            _share(per((tail == 4) & (length > 1)), words), _share(per((tail == 4) & (length <= 3)), words), _share(per(same), words),
            _share(distinct, words), _share(distinct_pairs, words), _share(top, words), _share(words, n_lines), 1 - _share(distinct_lines, n_lines) * (n_lines > 0) - (n_lines == 0),
        ],
        axis=1,
    )


def feature_rows(column: pa.Array) -> np.ndarray:
    rows = [measures(s) for s in word_slices(column, False)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def coarse(self, j: int, bins: np.ndarray) -> np.ndarray:
        return bins * COARSE // (len(self.edges[j]) + 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[bins[:, j]]
        for j, k, table in self.pairs:
            out += table[self.coarse(j, bins[:, j]), self.coarse(k, bins[:, k])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -40, 40)))


def step_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values of the best tree over ordered bins with gradient sums g and curvature sums h."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + LEAST)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                v = gain(a, m) + gain(m, b) - gain(a, b)
                if v.max() > best[0]:
                    best = (v.max(), int(m[v.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + LEAST)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best tree that splits one side of a table once and each part once along the other side."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for m in range(1, len(a)):
            parts = [step_tree(a[:m].sum(0), b[:m].sum(0), 2), step_tree(a[m:].sum(0), b[m:].sum(0), 2)]
            value = float((parts[0] * a[:m].sum(0)).sum() + (parts[1] * a[m:].sum(0)).sum())
            if value > best[0]:
                table = np.concatenate([np.tile(parts[0], (m, 1)), np.tile(parts[1], (len(a) - m, 1))])
                best = (value, table.T if turned else table)
    return best[1], best[0]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model()
    model = Model(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    out = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-out))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            tree = STEP * step_tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)), LEAVES)
            table += tree
            out += tree[bins[:, j]]
    g, h = slopes()
    cells = {(j, k): model.coarse(j, bins[:, j]) * COARSE + model.coarse(k, bins[:, k]) for j in range(x.shape[1]) for k in range(j)}
    shape = lambda v, c: np.bincount(c, v, COARSE * COARSE).reshape(COARSE, COARSE)
    strength = {p: pair_tree(shape(g, c), shape(h, c))[1] for p, c in cells.items()}
    chosen = sorted(strength, key=lambda p: (-strength[p], p))[:PAIRS]
    model.pairs = [(j, k, np.zeros((COARSE, COARSE))) for j, k in chosen if strength[j, k] > 0]
    for _ in range(PAIR_ROUNDS):
        for j, k, table in model.pairs:
            g, h = slopes()
            tree = STEP * pair_tree(shape(g, cells[j, k]), shape(h, cells[j, k]))[0]
            table += tree
            out += tree.ravel()[cells[j, k]]
    for j, table in enumerate(model.tables):  # centred tables; the rest is the intercept
        mean = float(np.bincount(bins[:, j], minlength=len(table)) @ table / len(y))
        table -= mean
        model.intercept += mean
    return model


def learn(documents: DataFrame, labels: DataFrame, label: str, usable, max_labelled: int = MAX_LABELLED) -> Model:
    """Model from labelled rows for which ``usable`` (a Column over doc_id) holds; at most max_labelled rows reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y").cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    found = labelled_texts(documents, pick(labels, label, usable, max_labelled)).mapInArrow(rows, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(found.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return fit(x, found.column("y").to_numpy().astype(float))


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(feature_rows(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return documents.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Scores of all documents by a model learnt from the rows that are not held out."""
    scored = score(documents, learn(documents, labels, "quality", crc_part(3) != 1, max_labelled))
    return scored.select("doc_id", (crc_part(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
