"""Cutting a text where no pre-token can span, and caches of encoded pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import regex

#: Fixed value: the pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WORDS = regex.compile(PATTERN)
_SPACE_AFTER_SPACE = re.compile(r"\s ")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def cut(text: str) -> list[str]:
    """Keys of the pieces of ``text``, in order; their encodings join to the encoding of the whole.

    A blank starts a pre-token or belongs to a run of white space, so a cut between a
    character that isn't white space and a blank never splits a pre-token; each piece
    sees the same pre-tokens as within the whole text.

    A key stands for a blank and itself, or, after a NUL, for the rest as it is.  So most
    texts are cut by one ``split``.
    """
    if not text:
        return []
    if "\0" in text or _SPACE_AFTER_SPACE.search(text):
        return ["\0" + p for p in _BEFORE_SPACE.split(text)]
    keys = text.split(" ")
    if keys[0]:
        keys[0] = "\0" + keys[0]
    else:
        del keys[0]
    return keys


def piece_of(key: str) -> str:
    return key[1:] if key[:1] == "\0" else " " + key


class PieceCache:
    """Encoded value of each piece, kept for the life of a Python worker.

    ``encode`` gets a list of unseen pre-tokens and returns their values; ``join`` adds up the
    values of a piece's pre-tokens.  A piece that holds one of ``special`` goes to ``encode``
    whole.  Pieces over ``longest`` characters are forgotten after their batch.  What was not
    met again while ``limit`` others were is forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], list], join: Callable[[list], object], special: tuple[str, ...] = (), limit: int = 500_000, longest: int = 40):
        self.encode, self.join, self.special, self.limit, self.longest = encode, join, special, limit, longest
        self.pieces: dict[str, object] = {}
        self.words: dict[str, object] = {}
        self.old_pieces: dict[str, object] = {}
        self.old_words: dict[str, object] = {}

    def _learn(self, missing: set[str]) -> None:
        split, new = {}, set()
        pieces, words, old_pieces, old_words = self.pieces, self.words, self.old_pieces, self.old_words
        for key in missing:
            if (value := old_pieces.get(key)) is not None:
                pieces[key] = value
                continue
            piece = piece_of(key)
            split[key] = own = [piece] if any(s in piece for s in self.special) else _WORDS.findall(piece)
            for w in own:
                if w not in words:
                    if (value := old_words.get(w)) is not None:
                        words[w] = value
                    else:
                        new.add(w)
        fresh = list(new)
        words.update(zip(fresh, self.encode(fresh), strict=True))
        for key, own in split.items():
            pieces[key] = words[own[0]] if len(own) == 1 else self.join([words[w] for w in own])
        for w in fresh:
            if len(w) > self.longest:
                del words[w]

    def batch(self, texts: Iterable[str | None]) -> list[list]:
        """For each text the values of its pieces."""
        if len(self.pieces) > self.limit:
            self.old_pieces, self.pieces = self.pieces, {}
        if len(self.words) > self.limit:
            self.old_words, self.words = self.words, {}
        known, rows, missing = self.pieces, [], set()
        for text in texts:
            keys = cut(text or "")
            values = list(map(known.get, keys))
            if None in values:
                missing.update(k for k, v in zip(keys, values, strict=True) if v is None)
                rows.append(keys)
            else:
                rows.append((values,))
        if missing:
            self._learn(missing)
        out = [row[0] if type(row) is tuple else list(map(known.__getitem__, row)) for row in rows]
        for key in missing:
            if len(key) > self.longest:
                known.pop(key, None)
        return out
