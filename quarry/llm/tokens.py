"""Cached byte-level BPE encoding, shared by the token operators.

Invented or rare words repeat, so a text is cut into chunks at single spaces
and line ends, and the ids of a chunk are kept as bytes.  A single space
between two other characters always begins a new pre-token, and a line end
between two such characters is one of its own; a text where white space
stands otherwise is cut by the pre-token pattern itself.  Either way each
pre-token is encoded alone, which is what byte-level BPE does.
"""

from __future__ import annotations

import string

import regex

from quarry.llm import vocabulary


class _Odd(Exception):
    """White space that the quick cut does not cover."""


class ChunkCache(dict):
    """chunk -> ids as little-endian 32-bit integers, of bounded size: when
    ``limit`` chunks are held, the older half goes."""

    def __init__(self, encode, limit: int = 400_000):
        super().__init__()
        self.encode, self.limit, self.old, self.pieces = encode, limit, {}, {}
        self.find = regex.compile(vocabulary.pattern()).findall
        self.odd = regex.compile(r"\s").search

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            body = chunk.rstrip(string.punctuation)
            if (body[1:] if chunk[:1] == " " else body).isalpha():  # letters, then a run of marks: a pre-token each
                ids = self.piece(body)
                if len(body) < len(chunk):
                    ids += self.piece(chunk[len(body):])
            elif chunk != "\n" and (chunk in ("", " ") or self.odd(chunk, 1 if chunk[0] == " " else 0)):
                raise _Odd
            else:
                ids = b"".join(map(self.piece, self.find(chunk)))
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.encode(piece)
            if len(self.pieces) >= self.limit:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """All ids of a text, as bytes."""
        if not text:
            return b""
        if "\x01" not in text:
            chunks = text.replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split("\x01")
            if chunks[0] == "" and text[0] == " ":
                del chunks[0]
            try:
                return b"".join(map(self.__getitem__, chunks))
            except _Odd:
                pass
        return b"".join(map(self.piece, self.find(text)))
