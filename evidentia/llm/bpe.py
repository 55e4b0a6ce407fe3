"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding reads a pre-token's symbols from left to right.  For every prefix the
merge list fixes one last token; it is the token ``t`` ending there whose
predecessor (the last token of the prefix before ``t``) may stand next to it,
that is, no merge would cross their border.  A later position can only reach
back one token, so once the chains of all positions within the longest token
(`Merges.lookahead` symbols) agree on a token, that token is final and leaves.
What is held is the unsettled tail, not the text.

Which pairs may stand side by side follows from the merge list alone: the right
edge of the left token and the left edge of the right token grow by merges of
known rank, and a merge across the border happens exactly if its rank comes
before either edge symbol is consumed (leftmost first among equals).

Decoding feeds ids through a state machine: token -> bytes -> text, holding back
an incomplete UTF-8 sequence.  A tokenizer file without a decoder section is
decoded as the tokenizers library does it: token strings joined by spaces.

Characters are classed and lower-cased by the Unicode versions of the tokenizers
library, which differ from those that Python and its regex module know (``NO_CLASS``,
``CASES``).

Cases: a null or empty text gives no ids, and their digest is that of no bytes; a null
id is carried; of pairs that the merge list names twice the earlier counts, and pairs of one
rank are merged from the left (ties); very long texts are encoded whole, in pieces that end before white space
where there is some; repeated rows give repeated results; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evidentia.llm.blocks import tidy

PIECE_CHARS = 1 << 16
CACHED = 250_000
# fixed values: letters and digits of later Unicode versions that are neither to the library's pattern engine
NO_CLASS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
# fixed values: capital letters (first, last, distance to the small ones) that the library lower-cases and Python does not know
CASES = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
_LATER = "".join(f"{chr(a)}-{chr(b)}" for a, b in NO_CLASS)
_NEWER = re.compile("[" + _LATER + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in CASES) + "]")
_LOWER = {c: c + step for a, b, step in CASES for c in range(a, b + 1)}
_NO_END = (-1, -2)  # no encoding ends here: a merge always goes across


def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte: itself where visible, else the next free character from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge list with the edge tables that decide which tokens may be neighbours."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.surface = [""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            self.surface[i] = text
        self.rank = {(vocab[a], vocab[b]): n for n, (a, b) in reversed(list(enumerate(merges)))}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], n) for n, (a, b) in reversed(list(enumerate(merges)))}
        for i, (a, b, n) in self.parts.items():
            if max(self.parts.get(a, (0, 0, -1))[2], self.parts.get(b, (0, 0, -1))[2]) >= n:
                raise ValueError(f"token {i} is merged before its parts: the merge list is not in training order")
        self.never = len(merges)
        cut = len(suffix)
        self.lookahead = max(len(t) - (cut if suffix and t.endswith(suffix) else 0) for t in vocab)
        self.beside: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.trie = self.grow()

    def edge(self, token: int, side: int, last: int) -> list[tuple[int, int]]:
        """(symbol, rank of the merge that consumes it) along one edge, from the token inwards."""
        out = [(token, last)]
        while token in self.parts:
            rank = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, rank))
        return out

    def crossed(self, left: int, right: int, last: int) -> bool:
        rank = self.rank
        for x, x_end in self.edge(left, 1, last):
            for y, y_end in self.edge(right, 0, last):
                n = rank.get((x, y))
                if n is not None and n < x_end and n <= y_end and n < last:
                    return True
        return False

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) >= 2 * CACHED:
                self.beside.clear()
            known = self.beside[key] = not self.crossed(left, right, self.never)
        return known

    def stands(self, token: int) -> bool:
        """Whether the token's own text is encoded as this one token."""
        known = self.whole.get(token)
        if known is None:
            known = True
            if token in self.parts:
                a, b, n = self.parts[token]
                known = self.stands(a) and self.stands(b) and not self.crossed(a, b, n)
            self.whole[token] = known
        return known

    def grow(self) -> dict:
        """Trie of the tokens' symbols, with each token that stands alone at the key ""."""
        root: dict = {}
        cut = len(self.suffix)
        for text, token in self.vocab.items():
            if not self.stands(token):
                continue
            body, ends = (text[:-cut], True) if cut and text.endswith(self.suffix) and len(text) > cut else (text, False)
            node = root
            for k, c in enumerate(body):
                node = node.setdefault(c + self.suffix if ends and k == len(body) - 1 else c, {})
            node[""] = token
        return root

    def step(self, active: list, chain: list, symbol: str) -> list:
        """Read one symbol: ``active`` holds the tokens begun, ``chain`` gets the last token of the longer prefix."""
        found, going, beside = None, [], self.beside
        for node, start in active:
            node = node.get(symbol)
            if node is None:
                continue
            going.append((node, start))
            if found is None and (token := node.get("")) is not None:
                before = chain[start][1]
                if before < 0:
                    found = (start, token)
                else:
                    fits = beside.get(before << 20 | token)
                    if fits or (fits is None and self.may_follow(before, token)):
                        found = (start, token)
        if found is None:
            chain.append(_NO_END)
        else:
            chain.append(found)
            going.append((self.trie, len(chain) - 1))
        return going

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Token ids of one pre-token, each as soon as it is final; ``symbols`` ends with the suffixed symbol."""
        reach = self.lookahead
        chain: list[tuple[int, int]] = [(-1, -1)]  # of each position from the settled one: start of its last token, the token
        active = [(self.trie, 0)]
        for symbol in symbols:
            active = self.step(active, chain, symbol)
            i = len(chain) - 1
            if i >= 4 * reach:  # settle what all open positions agree on
                paths = [self._path(chain, q) for q in range(i - reach + 1, i + 1) if chain[q] is not _NO_END]
                agreed = 0
                while all(len(p) > agreed and p[agreed] == paths[0][agreed] for p in paths):
                    agreed += 1
                if agreed and (cut := paths[0][agreed - 1]) <= i - reach:
                    for q in paths[0][:agreed]:
                        yield chain[q][1]
                    chain = [(-1, chain[cut][1])] + [(s - cut, t) if s >= cut else _NO_END for s, t in chain[cut + 1 :]]
                    active = [(node, start - cut) for node, start in active if start >= cut]
        for q in self._path(chain, len(chain) - 1):
            yield chain[q][1]

    def settle(self, symbols: Iterable[str]) -> list[int]:
        """The same for a short pre-token, all at its end."""
        chain: list[tuple[int, int]] = [(-1, -1)]
        active = [(self.trie, 0)]
        for symbol in symbols:
            active = self.step(active, chain, symbol)
        out, q = [], len(chain) - 1
        while q > 0:
            q, token = chain[q]
            out.append(token)
        return out[::-1]

    @staticmethod
    def _path(chain: list, q: int) -> list[int]:
        out = []
        while q > 0:
            out.append(q)
            q = chain[q][0]
        return out[::-1]


class Tokenizer:
    """A tokenizers JSON file of the kind NFC, white space, lower case, split, byte level, BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        surface = self.merges.surface
        surface.extend([""] * (max([*self.added.values(), 0]) + 1 - len(surface)))
        for text, i in self.added.items():
            surface[i] = text
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split).findall
        own = split.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{_LATER}])+").replace(r"[\p{L}]+", rf"(?:(?![{_LATER}])\p{{L}})+").replace(r"[\p{N}]", rf"(?![{_LATER}])\p{{N}}")
        self.split_newer = regex.compile(own).findall
        # the same pattern for ASCII text in lower case, by the faster engine
        self.split_ascii = re.compile(split.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.alphabet = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(self.alphabet)}
        self.joined = spec.get("decoder") is None
        self.known: dict[str, bytes] = {}

    def symbols(self, word: str) -> list[str]:
        out = [self.alphabet[b] for b in word.encode()]
        out[-1] += self.merges.suffix
        return out

    def word(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers; short ones are remembered."""
        if len(word) > 40:
            return np.fromiter(self.merges.stream(self.symbols(word)), np.uint32).astype("<u4").tobytes()
        ids = self.merges.settle(self.symbols(word))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.known) >= CACHED:
            self.known.clear()
        self.known[word] = out
        return out

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces that end before white space, where nothing composes, merges or splits."""
        at = 0
        while len(text) - at > PIECE_CHARS:
            m = _BREAK.search(text, at + PIECE_CHARS)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> Iterator[bytes]:
        """Little-endian ids, piece by piece."""
        for part in self.specials.split(text) if self.specials and "<|" in text else (text,):
            if part in self.added:
                yield self.added[part].to_bytes(4, "little")
                continue
            for piece in self.pieces(part):
                if piece.isascii():
                    words = self.split_ascii(piece.lower())
                elif _NEWER.search(piece):
                    words = self.split_newer(lowered(unicodedata.normalize("NFC", piece)).translate(_LOWER))
                else:
                    words = self.split(lowered(unicodedata.normalize("NFC", piece)))
                known, word = self.known, self.word
                yield b"".join([known.get(w) or word(w) for w in words])

    def decoder(self) -> Decoder:
        return Decoder(self)


_BREAK = re.compile(r"[ \n\t\r]")


def lowered(text: str) -> str:
    """Lower case of each character alone: a final sigma is not special."""
    return text.replace("Σ", "σ").lower()


class Decoder:
    """Ids to text in chunks: token to bytes to text, or token strings joined by spaces if the file has no decoder."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.first = tokenizer, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        surface = self.tokenizer.merges.surface
        words = [surface[i] for i in np.frombuffer(ids, "<u4").tolist()]
        if not words:
            return ""
        if self.tokenizer.joined:
            out = " ".join(words) if self.first else " " + " ".join(words)
            self.first = False
            return out
        return self.utf8.decode(b"".join(map(self._bytes, words)))

    def _bytes(self, surface: str) -> bytes:
        if surface in self.tokenizer.added:
            return surface.encode()
        suffix = self.tokenizer.merges.suffix
        ends = bool(suffix) and surface.endswith(suffix)
        body = surface[: -len(suffix)] if ends else surface
        return bytes(self.tokenizer.bytes_of[c] for c in body) + b" " * ends

    def close(self) -> str:
        return "" if self.tokenizer.joined else self.utf8.decode(b"", True)


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(documents: DataFrame, name: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: token count and digests of ids and decoded text; ``keep_ids`` adds the ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer_path(name))
        try:
            yield from _encoded(tok, batches, keep_ids)
        finally:  # a worker lives on after its task
            tok.known.clear()
            tok.merges.beside.clear()
            tidy()

    picked = documents.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return picked.mapInArrow(run, SCHEMA + ", ids binary" * keep_ids)


def _encoded(tok: Tokenizer, batches: Iterator[pa.RecordBatch], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            counts, ids_sha, out_sha, kept = [], [], [], []
            for text in part.column(1):
                text = text.as_py() or ""
                ids, out, n, all_ids, decoder = hashlib.sha256(), hashlib.sha256(), 0, [], tok.decoder()
                for chunk in tok.encode(text):
                    n += len(chunk) // 4
                    ids.update(chunk)
                    out.update(decoder.feed(chunk).encode())
                    if keep_ids:
                        all_ids.append(chunk)
                out.update(decoder.close().encode())
                counts.append(n)
                ids_sha.append(ids.hexdigest())
                out_sha.append(out.hexdigest())
                kept.append(b"".join(all_ids))
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)
