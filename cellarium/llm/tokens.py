"""Tokenising whole texts with a public tokenizer, each distinct chunk between spaces once.

A text is cut at single spaces, where the tokenizer's own pre-tokenisation always cuts, and the library encodes each
new chunk; bounded caches keep its ids, and those of its pieces, as bytes. Where a chunk begins or ends with white space, or two spaces meet,
and the pre-tokeniser lets white space into tokens, the library gets the whole text instead, as it does where the text
holds the string of an added token, such as an end mark. The ids are those that the library, as loaded, gives for the
whole text without special tokens around it, at several times the speed.
"""

from __future__ import annotations

import json
import os
import string
from array import array
from collections.abc import Iterable

import numpy as np
import regex

CACHE_CHUNKS, CACHE_PIECES, CHUNK_CHARS = 700_000, 300_000, 48
# Fixed value: the byte-level pre-tokeniser's own pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the printable stand-ins of bytes in byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
STAND_IN = {b: b if b in PLAIN else 256 + k for k, b in enumerate([*PLAIN, *(b for b in range(256) if b not in PLAIN)], -len(PLAIN))}


SPACE = chr(STAND_IN[32])


class Chunks(dict):
    """chunk -> ids as little-endian uint32 bytes; None where the chunk can't stand alone.

    When it is full it becomes the older generation, from which chunks that come again are taken back; so at most twice
    `most` are held, and what is frequent is never forgotten.
    """

    def __init__(self, encode, prefix: str, most: int):
        super().__init__()
        self.encode, self.prefix, self.most, self.old = encode, prefix, most, {}

    def __missing__(self, chunk: str) -> bytes | None:
        found = self.old.get(chunk)
        if found is None:
            if self.prefix and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
                return None
            found = self.encode(chunk)
        if len(chunk) <= CHUNK_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


class Encoder:
    """chunks: at most twice so many are held, and at most half as many pieces; a worker that turns to other work still holds them."""

    def __init__(self, path: str, chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        marks = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.marked = regex.compile("|".join(map(regex.escape, marks))).search
        self.hint = os.path.commonprefix(marks) if marks else None
        with open(path) as f:
            spec = json.load(f)
        pre, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
        steps = pre.get("pretokenizers", [])
        #: "prefix": an isolated space begins the next token; "dropped": white space is in no token; "whole": unknown.
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normal is None:
            self.kind = "prefix"
        elif [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and "\\s" in steps[0]["pattern"].get("Regex", "") and [x["type"] for x in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "dropped"
        self.lower, self.model = self.kind == "dropped", self.tokenizer.model.tokenize
        self.split = regex.compile(steps[0]["pattern"]["Regex"] if self.kind == "dropped" else BYTE_LEVEL).findall
        self.chunks = Chunks(self.chunk, " " if self.kind == "prefix" else "", chunks)
        self.pieces: dict[str, bytes] = {}
        self.most_pieces = min(CACHE_PIECES, chunks // 2)
        #: Whether a run of Latin letters is one piece, and the marks that are one piece of their own after such a run.
        latin = string.ascii_lowercase + "éßøæłž"
        self.letters = self.split(latin) == [latin]
        self.tails = {c for c in ".,;:!?" if self.letters and self.split(latin + c) == [latin, c]}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def fresh(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model(self.stand_ins(piece))]).tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.fresh(piece)
            if len(piece) <= CHUNK_CHARS:
                if len(self.pieces) >= self.most_pieces:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def stand_ins(self, piece: str) -> str:
        """The piece's bytes in the vocabulary's letters; printable ASCII stands for itself, and one space before it for its stand-in."""
        if piece.isascii() and piece[1:].isalpha():
            return piece if piece[0] != " " and piece.isalpha() else SPACE + piece[1:] if piece[0] == " " else piece.translate(STAND_IN)
        return piece.encode().decode("latin-1").translate(STAND_IN)

    def chunk(self, chunk: str) -> bytes:
        """Chunks of printable Latin letters and line feeds, which normalisation leaves as they are, go straight to the library's model, piece by piece."""
        plain = chunk.isascii()
        if not plain and (max(chunk) >= "\u0250" or "\u0130" in chunk):
            return self.whole(self.chunks.prefix + chunk)
        if self.letters and chunk.isalpha():
            return self.fresh(self.chunks.prefix + (chunk.lower() if self.lower else chunk))
        if chunk[-1:] in self.tails and chunk[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.piece(chunk[-1])
        if not (chunk and (chunk.isprintable() or chunk.replace("\n", "").isprintable())):
            return self.whole(self.chunks.prefix + chunk)
        return b"".join(map(self.piece, self.split(self.chunks.prefix + (chunk.lower() if self.lower else chunk))))

    def encode(self, text: str) -> bytes:
        """The text's ids, little-endian uint32."""
        if not text:
            return b""
        if self.hint is not None and self.hint in text and self.marked(text):
            return self.whole(text)
        get = self.chunks.__getitem__
        if self.kind == "dropped":
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        if self.kind == "prefix":
            first, *rest = text.split(" ")
            if not first or not first[-1].isspace():
                try:
                    return self.whole(first) + b"".join(map(get, rest))
                except TypeError:  # None: a chunk that can't stand alone
                    pass
        return self.whole(text)

    def encode_all(self, texts: Iterable[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, `end` after each text (null: empty), and the number of ids of each text with it."""
        mark = int(end).to_bytes(4, "little")
        found = [self.encode(t or "") + mark for t in texts]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, chunks: int = CACHE_CHUNKS) -> Encoder:
    """One per worker, tokenizer and size, kept between tasks."""
    if (path, chunks) not in _encoders:
        _encoders[path, chunks] = Encoder(path, chunks)
    return _encoders[path, chunks]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
