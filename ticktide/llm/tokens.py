"""Token ids of texts by public tokenizer files, word by word.

A tokenizer file is slow on whole texts, and texts repeat their words. Texts are
cut where no token can cross, each distinct piece is encoded once by the
``tokenizers`` library, and a bounded table keeps the ids. The result equals the
library's on the whole text (``tests/llm`` compare them).
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa

#: Pieces that a worker keeps; the table starts anew beyond that.
MOST_PIECES = 200_000
#: Bytes of ids in an Arrow batch that goes back to Spark.
BATCH_BYTES = 8 << 20
#: A place between words that one white-space character separates.
_BETWEEN = re.compile(r"(?<=\S)(?=[ \n]\S)")


class _Irregular(Exception):
    """A piece with white space at its edges: its neighbours matter."""


class _Pieces(dict):
    """Ids (unsigned 32-bit, little-endian) of pieces; a missing one is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = self.encode(piece)
        return out


def _symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Ends a word in the merges of a vocabulary that marks word ends; no byte of UTF-8.
_WORD_END = b"\xff"


def merger(path: str):
    """``encode_single_piece`` of tiktoken over a tokenizer file's merges: ids of one pre-token's bytes.

    Ids in these files follow the order of the merges, as ranks do. Word ends
    (``</w>``) become a byte that joins the last byte before any merge.
    """
    import tiktoken

    with open(path) as f:
        model = json.load(f)["model"]
    symbols, end = _symbols(), model.get("end_of_word_suffix") or ""
    ranks = {}
    for token, rank in model["vocab"].items():
        ended = end and token.endswith(end) and token != end
        body = token[: -len(end)] if ended else token
        if all(c in symbols for c in body) and not (token.startswith("<|") and token.endswith("|>")):
            ranks[bytes(symbols[c] for c in body) + (_WORD_END if ended else b"")] = rank
    encoding = tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    return encoding._core_bpe.encode_single_piece


class Encoder:
    """``encode(text)`` gives the ids as bytes.

    ``drops_space``: the tokenizer lower-cases, discards white space and marks
    word ends, so that words stand alone. Otherwise a word goes with the one
    white-space character before it, as in byte-level BPE; longer runs of white
    space stay inside a piece. Words of letters, with one mark at their end or none,
    go to the merges directly; all other pieces to the ``tokenizers`` library.

    The file's special tokens in a text get their own ids, as the library does
    unless told otherwise, and part the text; with ``specials_are_text`` their
    strings are ordinary text.
    """

    def __init__(self, path: str, drops_space: bool, specials_are_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_are_text
        self.added = {} if specials_are_text else self._added()
        self.parts = re.compile(f"({'|'.join(sorted(map(re.escape, self.added), reverse=True))})") if self.added else None
        self.drops_space, self.merge = drops_space, merger(path)
        self.marks = {c: self._by_library(c) for c in ".,;:!?"}
        self._new()

    def _new(self) -> None:
        self.words = _Pieces(self._bare if self.drops_space else self._spaced)
        self.whole = _Pieces(self._by_library)

    def _added(self) -> dict[str, bytes]:
        out = {}
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            if token.normalized or token.single_word or token.lstrip or token.rstrip:
                raise ValueError(f"special token {token.content!r} does not stand for its string alone")
            out[token.content] = struct.pack("<I", i)
        return out

    def _by_library(self, piece: str) -> bytes:
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merged(self, piece: bytes) -> bytes:
        ids = self.merge(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _bare(self, piece: str) -> bytes:
        if piece.isalpha():
            low = piece.lower()
            if low.isalpha() and "\u03a3" not in piece and unicodedata.is_normalized("NFC", piece):
                return self._merged(low.encode() + _WORD_END)
        elif piece[-1:] in self.marks and len(piece) > 1 and piece[:-1].isalpha():
            return self.words[piece[:-1]] + self.marks[piece[-1]]
        return self._by_library(piece)

    def _spaced(self, piece: str) -> bytes:
        """Ids of a piece after a space, or of one from a newline on."""
        if piece.isalpha():
            return self._merged(b" " + piece.encode())
        if piece[-1:] in self.marks and len(piece) > 1 and piece[:-1].isalpha():
            return self.words[piece[:-1]] + self.marks[piece[-1]]
        core = piece[1:] if piece[:1] == "\n" else piece
        if not core or core[0].isspace() or core[-1].isspace():
            raise _Irregular
        return self._by_library(piece if core is not piece else " " + piece)

    def encode(self, text: str) -> bytes:
        if len(self.words) + len(self.whole) > MOST_PIECES:
            self._new()
        if self.parts is None or not self.parts.search(text):
            return self._part(text)
        # every second part is a special token
        return b"".join(self.added[x] if k % 2 else self._part(x) if x else b"" for k, x in enumerate(self.parts.split(text)))

    def _part(self, text: str) -> bytes:
        if self.drops_space:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if rest and (first != first.rstrip() or not first and rest[0][:1] == "\n"):
                raise _Irregular
            return self.whole[first] + b"".join(map(self.words.__getitem__, rest))
        except _Irregular:
            return b"".join(map(self.whole.__getitem__, _BETWEEN.split(text)))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, drops_space)
    return _encoders[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def trim() -> None:
    """Give free memory back: a worker that waits for its next task keeps what it once used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batched(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of (bytes, row) pairs, each of about BATCH_BYTES."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 64
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
