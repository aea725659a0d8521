"""Cutting texts into units whose byte-level BPE tokens don't depend on what stands around them.

The pre-tokeniser's pattern lets a blank open a pre-token only if a character that is no white
space follows. A text can thus be cut before every blank that has such a character on either
side, and a unit between two cuts is met again and again, so its result is worth keeping.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import regex

#: The pattern of the pre-tokeniser (fixed value of the vocabulary files).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space on both sides of a blank, or a blank beside white space: no cut may be made there.
_TANGLED = re.compile(r"\s \s|  ")
#: The blanks that a text can be cut at where some are tangled.
_CUT = re.compile(r" (?=\S)|(?<=\S) ")


def vocabulary_path(name: str) -> str:
    """``name`` itself if it is a path, else the file of that name among the public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load_vocabulary(name: str) -> dict:
    with open(vocabulary_path(name), encoding="utf-8") as f:
        return json.load(f)


@functools.cache
def special_tokens(name: str) -> dict[str, int]:
    """The strings that the library takes out of a text before all else, with their ids."""
    return {t["content"]: t["id"] for t in load_vocabulary(name)["added_tokens"]}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the letters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class UnitCache(dict):
    """Results by unit, in two generations so that frequent units outlive rare ones.

    Holds ``2 * limit`` units at most; units longer than ``longest`` characters aren't kept, so
    the memory has a bound that doesn't grow with the corpus.
    """

    def __init__(self, compute: Callable[[str], object], limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest
        self.old: dict[str, object] = {}

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            value = self.compute(unit)
            if len(unit) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[unit] = value
        return value


def segments(text: str, specials: dict[str, int]) -> list[str | int]:
    """The text cut at special strings; an int is the id of such a string."""
    out: list[str | int] = [text]
    for s, number in specials.items():
        if s in text:
            cut: list[str | int] = []
            for part in out:
                if isinstance(part, int):
                    cut.append(part)
                    continue
                first, *rest = part.split(s)
                cut.append(first)
                for x in rest:
                    cut += (number, x)
            out = cut
    return out


def tangled(text: str) -> bool:
    return _TANGLED.search(text) is not None


def units(text: str) -> list[str]:
    """What stands before the first cut, and behind each cut without its blank."""
    return _CUT.split(text) if tangled(text) else text.split(" ")
