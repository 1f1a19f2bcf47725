"""Token ids of whole texts by a public byte-level tokenizer, fast through a cache of pieces.

Pieces of a text that begin at a space or newline are tokenized alone: the
tokenizer's own rule begins a new word there, unless the white space goes on. Texts
with such longer white space are tokenized as a whole. The ids are the same.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np

#: White space that the rule may join across pieces: three in a row, or two at the end.
JOINED = re.compile(r"\s\s(?:\s|\Z)")
NEWLINE = "\x01"
MOST_PIECES = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def add(self, pieces: list[str], texts: list[str]) -> None:
        """Remember the ids of new pieces, each tokenized as the text given for it, all in one call."""
        made = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        lengths = np.bincount(np.array(made.word_ids, np.int64), minlength=len(texts)) if made.ids else np.zeros(len(texts), np.int64)
        first, need, total = len(self.number), len(self.number) + len(texts), self.size + len(made.ids)
        if need > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(need, len(self.ends)), np.int64)])
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.uint32)])
        self.ends[first:need] = self.size + np.cumsum(lengths)
        self.ids[self.size : total] = made.ids
        self.size = total
        self.number.update(zip(pieces, range(first, need)))

    def numbers(self, keys: list[str]) -> np.ndarray:
        """The number of each piece; new ones are tokenized."""
        at = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            pieces = list(dict.fromkeys(keys[i] for i in new.tolist()))
            self.add(pieces, list(map(as_text, pieces)))
            at[new] = [self.number[keys[i]] for i in new.tolist()]
        return at

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Ids of each text, and the numbers of its pieces (None for a text that was tokenized as a whole)."""
        out: list = [None] * len(texts)
        keys, sizes, cut = [], [], []
        for i, text in enumerate(texts):
            if not text or NEWLINE in text or "\0" in text or JOINED.search(text):
                whole = self.tokenizer.encode(text, add_special_tokens=False).ids if text else []
                out[i] = np.array(whole, np.uint32), None
                continue
            pieces = text.replace("\n", " " + NEWLINE).split(" ")
            pieces[0] = "\0" + pieces[0]  # nothing stands before the first piece
            keys += pieces if len(pieces[0]) > 1 else pieces[1:]
            cut.append(i)
            sizes.append(len(keys))
        at = self.numbers(keys)
        for i, a, b in zip(cut, [0, *sizes], sizes):
            own = at[a:b]
            stop = self.ends[own]
            start = np.where(own > 0, self.ends[own - 1], 0)
            lengths = stop - start
            shift = np.repeat(start - (np.cumsum(lengths) - lengths), lengths)
            out[i] = self.ids[np.arange(int(lengths.sum())) + shift], own
        return out


def as_text(piece: str) -> str:
    """What a piece stands for: the first of a text is marked by a zero byte, one after a newline by its mark, any other follows a space."""
    return piece[1:] if piece.startswith("\0") else "\n" + piece[1:] if piece.startswith(NEWLINE) else " " + piece


_READY: dict[str, Tokens] = {}


def tokens_at(path: str) -> Tokens:
    """One tokenizer, with its cache, for each process."""
    if path not in _READY:
        _READY[path] = Tokens(path)
    return _READY[path]
