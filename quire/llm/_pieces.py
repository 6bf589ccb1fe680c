"""Cutting a text where a byte-level BPE pre-tokenizer always cuts."""

from __future__ import annotations

import re

_SPACES = re.compile(r"\s\s")

#: Fixed value: the pre-tokenizer's pattern whose matches ``chunks`` never cuts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def chunks(text: str) -> list[str] | None:
    """Pieces whose joined encoding is the text's, or None.

    A single space between two other characters starts a new match of
    ``PATTERN``, and a single newline there is a match of its own.  So where no two
    white-space characters meet, a text may be cut before each space and
    around each newline.  Other texts (None) must be matched as a whole.
    """
    if "\0" in text or _SPACES.search(text):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def one_word(piece: str) -> bool:
    """Whether a piece is letters alone, with one space before them or none: one match of the pattern.

    Only letters that every Unicode version knows are taken for such.
    """
    word = piece[1:] if piece[:1] == " " else piece
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


#: The memos that this worker holds.
_held: list = []


def release() -> None:
    """Empty the worker's memos: a task of another kind needs the memory."""
    for memo in _held:
        memo.clear()


class Memo(dict):
    """Encoded pieces by piece, each encoded when first asked for.

    Bounded: a full memo starts anew, and the frequent pieces are soon back.
    Texts are cut where ``PATTERN`` cuts, unless ``cuts`` is false or the text
    holds one of ``uncut``: such are encoded by ``whole``.
    """

    def __init__(self, encode, most: int, longest: int, whole=None, uncut: tuple[str, ...] = (), cuts: bool = True):
        super().__init__()
        self.encode, self.most, self.longest = encode, most, longest
        self.whole, self.uncut, self.cuts = whole or encode, uncut, cuts
        _held[:] = [self]  # a worker has one at a time

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def text(self, text: str) -> bytes:
        """A whole text's ids."""
        parts = None if not self.cuts or any(u in text for u in self.uncut) else chunks(text)
        return self.whole(text) if parts is None else b"".join(map(self.__getitem__, parts))
