"""Byte-level BPE text cut at places that no context can move, with caches over the cuts.

The split pattern of the byte-level vocabularies is

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Stable cut: directly before a space that a non-space character follows. No
match of the pattern runs over such a place: the letter, digit and symbol
alternatives contain no inner white space, and ``\\s+(?!\\S)`` gives back the last
white-space character of a run that ends at a non-space. So a text equals the
concatenation of its pieces and the tokens of the text are the tokens of its
pieces, whatever stands around them. Pieces repeat, so they are looked up.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

#: Fixed value: the split of byte-level vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cached pieces per Python worker, those that came first. Once it is full the rest is encoded batch by batch.
CACHE_PIECES = 300_000
#: Longer pieces aren't kept.
CACHE_CHARS = 64


def pieces(text: str) -> list[str]:
    """text cut at every stable cut. Joined, the pieces are the text."""
    if not text:
        return []
    found = text.split(" ")
    out = [found[0]] if found[0] else []
    if len(found) == 1:
        return out
    pend = ""  # spaces that aren't followed by a non-space
    for piece in found[1:]:
        if piece and not piece[0].isspace():
            if pend:
                if out:
                    out[-1] += pend
                else:
                    out.append(pend)
                pend = ""
            out.append(" " + piece)
        else:
            pend += " " + piece
    if pend:
        if out:
            out[-1] += pend
        else:
            out.append(pend)
    return out


class PieceCache:
    """Encodes texts by looking their pieces up.

    Keys are pieces less their leading space; a text's first piece, which has
    none, is in a tuple. ``encode`` turns pieces into packed ids. A
    piece that is empty or begins with white space tells of a space that isn't a
    stable cut; its value is False and its text is cut again with care.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = CACHE_PIECES):
        self.encode, self.most = encode, most
        self.known: dict[str | tuple[str], bytes | bool] = {}

    def _learn(self, keys: set[str | tuple[str]]) -> dict[str | tuple[str], bytes | bool]:
        """Encodes keys that aren't known; gives those that aren't kept: long ones, and all once the cache is full."""
        found = list(keys)
        odd = [type(k) is str and (k == "" or k[0].isspace()) for k in found]
        plain = [k for k, o in zip(found, odd, strict=True) if not o]
        values: dict[str, bytes | bool] = dict.fromkeys(found, False)
        values.update(zip(plain, self.encode([" " + k if type(k) is str else k[0] for k in plain]), strict=True))
        room = self.most - len(self.known)
        if room > 0:
            self.known.update([x for x in islice(values.items(), room) if len(x[0] if type(x[0]) is str else x[0][0]) <= CACHE_CHARS])
        return values

    def _values(self, keys: list[str | tuple[str]]) -> list:
        values = [*map(self.known.get, keys)]
        if None in values:
            new = self._learn({k for k, v in zip(keys, values, strict=True) if v is None})
            return [new[k] if v is None else v for k, v in zip(keys, values, strict=True)]
        return values

    @staticmethod
    def _keys(text: str) -> list[str | tuple[str]]:
        found: list[str | tuple[str]] = text.split(" ")
        found[0] = (found[0],)
        return found

    def values_of(self, text: str) -> list[bytes]:
        """The encoded pieces of a text, one for each of pieces(text), in order."""
        cut = pieces(text)
        return self._values([p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace() else (p,) for p in cut]) if cut else []

    def texts(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text. Pieces that are new are encoded all at once."""
        out: list[bytes | None] = [None] * len(texts)
        new: set[str] = set()
        late = []
        for i, text in enumerate(texts):
            keys = self._keys(text)
            values = [*map(self.known.get, keys)]
            if None in values:
                new.update([k for k, v in zip(keys, values, strict=True) if v is None])
                late.append(i)
            else:
                out[i] = self._joined(text, values)
        found = self._learn(new) if new else {}
        for i in late:
            keys = self._keys(texts[i])
            out[i] = self._joined(texts[i], [found[k] if v is None else v for k, v in zip(keys, map(self.known.get, keys), strict=True)])
        return out

    def _joined(self, text: str, values: list) -> bytes:
        try:
            return b"".join(values)
        except TypeError:  # a space that is no stable cut
            return b"".join(self.values_of(text))
