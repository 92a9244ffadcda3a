"""Byte-level BPE ids of whole texts, by a public vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os
from array import array

from .common import worker_cache

END_ID = 1  # closes every document


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as `tokenizers` gives them for the JSON file, without special tokens.

    The rank file of the same vocabulary is several times faster in tiktoken, so that is used where
    there is one beside the JSON file; a test holds both against each other. A text is cut before
    single spaces between other characters, where the vocabulary's pattern always starts a new
    piece, and the ids of such pieces are kept.
    """

    def __init__(self, path: str):
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks) and importlib.util.find_spec("tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            core = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
            self.encode, self.letters = core.encode_ordinary, core._core_bpe.encode_single_piece
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids
            self.letters = lambda piece: self.encode(piece.decode())
        self.pieces = _Pieces(self)

    def ids(self, text: str | None) -> bytes:
        """Unsigned 32-bit ids, one after the other."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if first.isspace() or first[-1:].isspace():
                raise _MixedError
            return array("I", self.encode(first)).tobytes() + b"".join(map(self.pieces.__getitem__, rest))
        except _MixedError:
            return array("I", self.encode(text)).tobytes()


class _MixedError(Exception):
    """A space stands beside other white space or at an end of the text and may belong to the piece before it."""


class _Pieces(dict):
    """Text after a space -> ids of the space and the text."""

    LIMIT = 250_000

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():  # the pattern takes a space and letters as one
            ids = array("I", self.encoder.letters(b" " + piece.encode())).tobytes()
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            raise _MixedError
        else:
            ids = array("I", self.encoder.encode(" " + piece)).tobytes()
        if len(piece) < 40:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = ids
        return ids


def encoder(path: str) -> Encoder:
    cache = worker_cache("tokens")
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]
