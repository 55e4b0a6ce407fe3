"""Toxicity by a weighted lexicon with Aho-Corasick matching.

Folding: lower case, compatibility and accent folding of Latin letters,
look-alike letters of other alphabets, digits and signs that stand for letters in
a word or (one or two signs) at its ends, letters that single spaces or dots set
apart, zero-width characters removed.  As a 1 may be an i or an l, all three
become i, in entries as in texts.

A lexicon entry is a folded word, or a stem (``stem*``) that starts words, with the
logarithm of how much more frequent it is among the words of toxic documents.
Exception phrases (a matched word with a neighbour that keeps company with it
mostly in harmless documents) cancel a match.  A document's density is the sum of
the weights of its matches over the square root of its word count; the score is a
logistic function of the log density.

Learning: every word and every stem of STEM letters that stands in SUPPORT toxic
documents or more is a candidate.  It enters if it is in toxic documents more often
than chance allows (Z standard deviations) and its weight is at least LEAST_WEIGHT.
Of candidates of which one starts the other only the one that tells the most
stays: so inflected words, each too rare to tell, enter by their stem, and words
of their own enter whole.  Weights are learnt from two thirds of the labelled rows;
the density that divides the classes with the least mean of both error rates is
taken from the last third.

Learning looks at no more than ``max_labelled`` labelled documents (the ones first
in the order of a hash of the id; of rows with one id the smallest text, equal texts
once, toxic if half of them are), so that what reaches the driver and travels to
the tasks is bounded by them.  Scoring covers every document and the whole of each text.

Cases: a null or empty text has density 0 and thus the lowest score, not null;
very long texts are matched as a whole; a null id is kept; repeated rows and ties
are scored alike; without labels the lexicon is empty and every score is 0; an empty
table gives no rows; other columns are ignored, whatever their names (``harmless``
carries them).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.labelled import MAX_LABELLED, crc_part, labelled_texts, pick

# fixed values: letters of other alphabets that look like Latin ones, and what digits and signs stand for
LOOKALIKES = "аaеeоoрpсcуyхxіiјjѕsԁdɡgһhԛqԝwкkмmтtвbнhαaεeιiοoρpτtυuνvκkχxγyωwıiℓlƖl"
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
INVISIBLE = "­​‌‍⁠﻿"
STEM = (3, 16)  # letters of a stem
SUPPORT, Z, LEAST_WEIGHT, PHRASE_SUPPORT = 4, 5.0, 1.5, 3
KEYS_HELD = 200_000  # keys a task counts before it passes them on


def fold_table() -> dict[int, str]:
    out = {ord(a): b for a, b in zip(LOOKALIKES[::2], LOOKALIKES[1::2], strict=True)}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)):
        plain = unicodedata.normalize("NFKD", chr(c))
        if plain[0].isascii() and plain[0].isalnum():
            out[c] = DIGITS.get(plain[0], plain[0].lower())
    return out | {c: "" for c in (*map(ord, INVISIBLE), *range(0x300, 0x370))}


_FOLD = fold_table()
_DIGITS = str.maketrans(DIGITS)
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:([ .*_-])[^\W_])(?:\1[^\W_])+(?![^\W_])")
_SIGN = re.compile(r"(?<=[a-z0-9])[@$!|€+]+(?=[a-z0-9])|(?<![@$€])[@$€]{1,2}(?=[a-z])|(?<=[a-z])[@$€+]{1,2}(?![a-z0-9@$€+])")
_DIGIT = re.compile(r"[0-9]+[a-z]|[a-z][0-9]")
_MIXED = re.compile(r"[a-z]+[0-9][a-z0-9]*|[0-9]+[a-z][a-z0-9]*")
_WORD = re.compile(r"[^\W_]+")


def _joined(m: re.Match) -> str:
    letters = m[0].replace(m[1], "")
    return m[0] if letters.isdigit() else letters


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _SPACED.sub(_joined, text)
    if _SIGN.search(text):
        text = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    if _DIGIT.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_DIGITS), text)
    return text.replace("l", "i")


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # a word, or a stem and *
    exceptions: list[str] = field(default_factory=list)  # two words each
    centre: float = 0.0  # log density that divides the classes
    steep: float = 4.0
    max_labelled: int = MAX_LABELLED

    def automaton(self) -> ahocorasick.Automaton:
        """Patterns with (length, weight of the stem or nan, weight of the word or nan); an exception weighs 0."""
        forms: dict[str, list[float]] = {}
        for entry, weight in [*self.weights.items(), *((phrase, 0.0) for phrase in self.exceptions)]:
            form = fold(entry.removesuffix("*"))
            if form:
                forms.setdefault(form, [math.nan, math.nan])[not entry.endswith("*")] = weight
        a = ahocorasick.Automaton()
        for form, (stem, word) in forms.items():
            a.add_word(form, (len(form), stem, word))
        if len(a):
            a.make_automaton()
        return a


def matches(a: ahocorasick.Automaton, text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the matches outside exception phrases; of those at one start the heaviest counts."""
    found: dict[int, tuple[int, float]] = {}
    free = []
    for last, (n, stem, word) in a.iter(text):
        start, end = last + 1 - n, last + 1
        if start and text[start - 1].isalnum():
            continue
        weight = word if word == word and not (end < len(text) and text[end].isalnum()) else stem
        if weight == 0:
            free.append((start, end))
        elif weight == weight and weight > found.get(start, (0, 0.0))[1]:
            found[start] = (end, weight)
    return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(fs <= s < fe for fs, fe in free)]


def matched(a: ahocorasick.Automaton, text: str) -> tuple[float, int]:
    """Sum of weights and number of matches outside exception phrases."""
    kept = [w for _, _, w in matches(a, text)]
    return math.fsum(kept), len(kept)


def density(total: float, n_words: int) -> float:
    return total / math.sqrt(max(n_words, 1))


def score_of(lexicon: Lexicon, d: float) -> float:
    return 0.0 if d <= 0 else 1 / (1 + math.exp(-max(-500.0, min(500.0, lexicon.steep * (math.log(d) - lexicon.centre)))))


def keys_of(word: str) -> list[str]:
    """The word, and the stems that it starts with."""
    return [word, *(word[:k] + "*" for k in range(STEM[0], min(len(word), STEM[1]) + 1))]


_COUNTS = "w string, docs long, n long"


def counted(rows: DataFrame, keys: Iterable[str] | None = None) -> DataFrame:
    """(w, docs, n): in how many of the folded texts each key stands, and how often; key '' counts texts and words."""
    wanted = None if keys is None else frozenset(keys)

    def flush(seen: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["w", "docs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text in batch.column("folded"):
                words = Counter(_WORD.findall(text.as_py()))
                here = Counter({"": words.total()})
                for word, n in words.items():
                    for key in keys_of(word):
                        if wanted is None or key in wanted:
                            here[key] += n
                for key, n in here.items():
                    total = seen.setdefault(key, [0, 0])
                    total[0] += 1
                    total[1] += n
                if len(seen) >= KEYS_HELD:
                    yield flush(seen)
                    seen = {}
        yield flush(seen)

    return rows.select("folded").mapInArrow(run, _COUNTS).groupBy("w").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def entries(toxic: dict[str, tuple[int, int]], clean: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights of the keys that tell, from (documents, occurrences) of each key in either class."""
    (n_toxic, w_toxic), (n_clean, w_clean) = toxic[""], clean.get("", (0, 0))
    told = []
    for key, (docs, n) in toxic.items():
        others, m = clean.get(key, (0, 0))
        share = (docs + others) / (n_toxic + n_clean)
        spread = math.sqrt(max(n_toxic * share * (1 - share) * n_clean / (n_toxic + n_clean), 1e-9))
        rate, base = n / max(w_toxic, 1), (m + 0.5) / max(w_clean, 1)
        if key and docs >= SUPPORT and docs - n_toxic * share >= Z * spread and math.log(rate / base) >= LEAST_WEIGHT:
            told.append((n * math.log(rate / base) - w_toxic * (rate - base), key))
    chosen: dict[str, float] = {}
    stems: set[str] = set()
    starts: set[str] = set()  # of all that is chosen
    for _, key in sorted(told, key=lambda t: (-t[0], -len(t[1].removesuffix("*")), t[1])):
        body = key.removesuffix("*")
        if (body in starts if key != body else key + "*" in chosen) or any(body[:k] in stems for k in range(STEM[0], len(body))):
            continue
        chosen[key] = math.log(toxic[key][1] / max(w_toxic, 1) / ((clean.get(key, (0, 0))[1] + 0.5) / max(w_clean, 1)))
        starts.update(body[:k] for k in range(STEM[0], len(body) + 1))
        if key != body:
            stems.add(body)
    return chosen


def learn(documents: DataFrame, labels: DataFrame, label: str, usable, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """Lexicon from labelled rows for which ``usable`` (a Column over doc_id) holds.

    The folded rows, bounded by ``max_labelled``, are cached while they are learnt from:
    Spark starts a process for each checkpoint file on a local disk.
    """
    rows = labelled_texts(documents, pick(labels, label, usable, max_labelled))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([fold(t.as_py() or "") for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, batch.column("y")], ["doc_id", "folded", "y"])

    rows = rows.mapInArrow(folded, "doc_id long, folded string, y int").persist(StorageLevel.DISK_ONLY)
    try:
        return learnt_from(rows, max_labelled)
    finally:
        rows.unpersist()


def learnt_from(rows: DataFrame, max_labelled: int) -> Lexicon:
    """Lexicon from rows (doc_id, folded, y)."""
    last_third = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    learnt = rows.where(~last_third)
    toxic = {r["w"]: (r["docs"], r["n"]) for r in counted(learnt.where("y = 1")).where(f"docs >= {SUPPORT} or w = ''").collect()}
    if "" not in toxic:
        return Lexicon(max_labelled=max_labelled)
    # a longer stem as frequent as its start tells at least as much
    same = {key[:-2] + "*" for key, found in toxic.items() if key.endswith("*") and toxic.get(key[:-2] + "*") == found}
    toxic = {key: found for key, found in toxic.items() if key not in same}
    clean = {r["w"]: (r["docs"], r["n"]) for r in counted(learnt.where("y = 0"), toxic).collect()}
    lexicon = Lexicon(entries(toxic, clean), max_labelled=max_labelled)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            out = [(phrase, y) for text, y in zip(batch.column("folded"), batch.column("y").to_pylist(), strict=True) for phrase in phrases(a, text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32())], ["w", "y"])

    def judged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([density_of(a, text.as_py()) for text in batch.column("folded")], pa.float64()), batch.column("y")], ["d", "y"])

    if lexicon.weights:
        found = learnt.select("folded", "y").mapInArrow(neighbours, "w string, y int").groupBy("w").agg(F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic"))
        lexicon.exceptions = sorted(r["w"] for r in found.where(f"clean >= {PHRASE_SUPPORT} and clean > 4 * toxic").collect())

        def densities(some: DataFrame) -> list[tuple[float, int]]:
            return [(r["d"], r["y"]) for r in some.select("folded", "y").mapInArrow(judged_rows, "d double, y int").collect()]

        dens = densities(rows.where(last_third))
        if not any(d > 0 and y for d, y in dens):  # too few rows to hold some back
            dens += densities(learnt)
        lexicon.centre = centre_of(dens)
    return lexicon


def phrases(a: ahocorasick.Automaton, text: str) -> set[str]:
    """The matched words of a folded text, each with the word before and the word after."""
    hits = {start for start, _, _ in matches(a, text)} if len(a) and text else set()
    if not hits:
        return set()
    words = [(m.start(), m[0]) for m in _WORD.finditer(text)]
    return {f"{words[j][1]} {words[j + 1][1]}" for i, (start, _) in enumerate(words) if start in hits for j in (i - 1, i) if 0 <= j < len(words) - 1}


def centre_of(dens: list[tuple[float, int]]) -> float:
    """The log density that divides the classes with the least sum of both error rates; between equals, the middle one."""
    values = sorted({d for d, _ in dens if d > 0})
    if not values:
        return 0.0
    pos, neg = np.sort([d for d, y in dens if y == 1]), np.sort([d for d, y in dens if y == 0])
    cuts = [values[0] / 2, *(math.sqrt(a * b) for a, b in zip(values, values[1:], strict=False)), values[-1] * 2]
    errors = [int(np.searchsorted(pos, c)) / max(len(pos), 1) + 1 - int(np.searchsorted(neg, c)) / max(len(neg), 1) for c in cuts]
    best = [c for c, e in zip(cuts, errors, strict=True) if e <= min(errors) + 1e-12]
    return math.log(best[len(best) // 2] if best[0] > values[0] else best[0])


def density_of(a: ahocorasick.Automaton, folded: str) -> float:
    total, n = matched(a, folded) if len(a) and folded else (0.0, 0)
    return density(total, len(_WORD.findall(folded))) if n else 0.0


def score(documents: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_matches and density of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            rows = [judged(a, lexicon, value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.float64())))], ["doc_id", "score", "n_matches", "density"])

    return documents.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id long, score double, n_matches long, density double")


def judged(a: ahocorasick.Automaton, lexicon: Lexicon, text: str | None) -> tuple[float, int, float]:
    """Score, matches and density of one text."""
    folded = fold(text or "")
    total, n = matched(a, folded) if len(a) and folded else (0.0, 0)
    d = density(total, len(_WORD.findall(folded))) if n else 0.0
    return score_of(lexicon, d), n, d


def harmless(documents: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The documents that score below 0.5, with all their columns."""
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            yield batch.filter(pa.array([judged(a, lexicon, value.as_py())[0] < 0.5 for value in batch.column(at)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def classify(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Scores of all documents by a lexicon learnt from the rows that are not held out."""
    lexicon = learn(documents, labels, "toxic", crc_part(5) != 0, max_labelled)
    scored = score(documents, lexicon)
    return scored.select("doc_id", (crc_part(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches", "density")
