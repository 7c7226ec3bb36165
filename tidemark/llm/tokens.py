"""Encoding of whole texts with a tokenizers file, by way of a bounded cache of text pieces.

Both supported pre-tokenizers never let a pre-token cross a place where a non-space character is
followed by white space, so a text falls into pieces there and equal pieces have equal ids. Only
pieces that the cache lacks go through the library.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from tidemark.llm.common import worker_cache

#: A letter run and a run of punctuation: the pre-tokenizers part them there.
_ENDED = re.compile(r"(\s?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)").fullmatch
#: A letter run that is one pre-token and that no normaliser changes but for its case.
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]{1,200}").fullmatch
_RUN = re.compile(r"(?<=\S)(?=[ \n])")
_TWO = re.compile(r"\s\s").search


#: Characters of a piece that is held; longer ones are encoded each time, so that a cache's bytes are bounded too.
LONGEST = 128


class Pieces(dict):
    """Token ids by piece, as little-endian bytes of `width` bytes an id; `encode` gives those of texts."""

    #: Pieces held in two generations: when the newer is full it replaces the older, and pieces still in use move up.
    LIMIT = 1_200_000

    def __init__(self, path: str, limit: int | None = None):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.LIMIT = limit or self.LIMIT
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self.merge = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as f:
            self.spaces_drop = json.load(f).get("normalizer") is not None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.pack = [struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack for n in range(800)]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(32, 256)}

    def split(self, text: str) -> list[str]:
        if self.spaces_drop:
            return text.replace("\n", " ").split(" ")
        if _TWO(text):
            return _RUN.split(text)  # a run of white space stays whole, before what follows it
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0") if "\0" not in text else [text]

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            if _LETTERS(piece):
                if self.spaces_drop and not piece.islower():
                    ids = self[piece.lower()]  # as the normaliser would
                else:  # one pre-token: the library's merges alone
                    got = [t.id for t in self.merge(piece.translate(self.spelled))]
                    ids = self.pack[len(got)](*got)
            elif m := _ENDED(piece):
                ids = self[m[1]] + self[m[2]]
            elif not self.spaces_drop and piece[:1] == "\n" and piece[1:2].isalpha():
                ids = self["\n"] + self[piece[1:]]
            else:
                ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        get = self.__getitem__
        for t in texts:
            out.append(b"".join(map(get, self.split(t))))
            if len(self) >= self.LIMIT // 2:
                self.old = dict(self)
                self.clear()
        return out


@worker_cache
def pieces(path: str, limit: int | None = None) -> Pieces:
    """One for each file and Python worker, so that its cache serves later tasks as well."""
    return Pieces(path, limit)
