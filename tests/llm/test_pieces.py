"""SentencePiece ids, decoded texts and digests equal those of the library; decoding takes any ids."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import pieces
from evidentia.llm.bpe import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.load(PATH)


def same(model, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    for text, row in zip(texts, pieces.encoded(model, batch, True).to_pylist(), strict=True):
        ids = LIBRARY.encode(text or "")
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids and row["n_tokens"] == len(ids), text[:200]
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(), text[:200]


def test_odd_texts(model):
    same(model, ["", None, " ", "a", " a", "a ", "  ", "▁", "▁▁ x", "a\x00b", "�", "日本", "<s> x </s> <unk> <0x41>", "x" * 50, "a\r\n\tb", "￿", "\U0010ffff", "﻿a"])


def test_runs_of_spaces(model):
    same(model, [" " * k + "x" for k in range(150)] + ["y" + " " * k for k in range(150)] + ["▁" * 70 + " th" + " " * 99])


def test_every_character(model):
    same(model, ["".join(chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x32000, 256)])


@pytest.mark.parametrize("letters", ["aethionrs ", "aeth", "ab c\n", "abcdeéßñ  ▁\n\t019.,!<>&x日本語의한글😀‍﻿é́İſ"])
def test_random_letters(model, letters):
    rng = random.Random(letters)
    same(model, ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(600)])


def test_pieces_in_random_order(model):
    rng = random.Random(3)
    same(model, ["".join(rng.choice(model.text[259:]) for _ in range(rng.randint(1, 60))).replace("▁", " ") for _ in range(1500)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_texts(texts):
    same(pieces.load(PATH), texts)


def test_long_texts_in_stretches(model):
    rng = random.Random(5)
    same(model, [" " * 1_200_000 + "x", "x" * 1_100_000, "ab , " * 300_000 + "z", "日" * 1_100_000, "".join(rng.choices("abcdefghij", k=60_000))])


def test_decoding_takes_any_ids_in_any_parts(model):
    rng = random.Random(7)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 259, 28705, 0, 1]) for _ in range(rng.randint(1, 12))]
        cut, decoder = rng.randint(0, len(ids)), pieces.Decoder(model)
        text = decoder.feed(np.array(ids[:cut], np.int32)) + decoder.feed(np.array(ids[cut:], np.int32)) + decoder.close()
        assert text.decode() == LIBRARY.decode(ids), ids


def test_equal_keys_of_different_segments_are_seen(model, monkeypatch):
    monkeypatch.setattr(pieces, "_powers", lambda n: np.zeros(n, np.uint64))
    same(model, ["the cat sat on the mat", "tea eat ate"])


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m.model").write_bytes(b"")
    with pytest.raises(ValueError):
        pieces.Model(str(tmp_path / "m.model"))
