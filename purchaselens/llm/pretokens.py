"""Cutting text as the public tokenizers do.

The tokenizers' patterns speak of Unicode letters (``\\p{L}``) and numbers (``\\p{N}``), whose
extent depends on a Unicode version. Below U+0500 all versions in use agree; there the classes
are written out for ``re``. A text with any character from U+0500 on goes to the tokenizers
library's own pre-tokenizer, whole.
"""

from __future__ import annotations

import re
import unicodedata

_NEAR_END = 0x500


def _ranges(kind: str) -> str:
    out, start = [], None
    for c in range(_NEAR_END + 1):
        inside = c < _NEAR_END and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


_L, _N, _S = _ranges("L"), _ranges("N"), "\\t-\\r \\x85\\xa0"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"  # fixed value of the public patterns

_FAR = re.compile("[^\\x00-\\u04ff]")
# Letters are tried first: no suffix begins with one, and most words do.
_BYTE_LEVEL = re.compile(
    f" ?[{_L}]+|{_SUFFIXES}| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)

_WORD_LEVEL = re.compile(f"[{_L}]+|{_SUFFIXES}|[{_N}]|[^{_S}{_L}{_N}]+")
#: Code points from U+0250 on may change under NFC; FS, GS, RS and US are blanks to ``str.split``
#: alone.
_NOT_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\u024f]")


def byte_level(text: str) -> list[str]:
    """What the byte-level tokenizer's pre-tokenizer makes of a text."""
    if not _FAR.search(text):
        return _BYTE_LEVEL.findall(text)
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str(text)
    return [text[a:b] for _, (a, b) in cut]


def is_plain(text: str) -> bool:
    """Whether lower-casing is all that the word-level tokenizer's normalising does to a text."""
    return not _NOT_PLAIN.search(text)


def word_level_pieces(text: str) -> list[str]:
    """Lower-cased parts of a plain text between white space."""
    return text.lower().split()


def word_level(piece: str) -> list[str]:
    """The words of one of ``word_level_pieces``."""
    if piece.isalpha() and piece.isascii():
        return [piece]
    return _WORD_LEVEL.findall(piece)


class Specials:
    """Special tokens that stand in a text are ids of their own and cut it."""

    def __init__(self, added: list[dict]):
        for token in added:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError(f"special token {token['content']!r} is matched in a way not built here")
        self.ids = {t["content"]: t["id"] for t in added}
        longest = sorted(self.ids, key=len, reverse=True)
        self._any = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def parts(self, text: str) -> list[str]:
        """Text and special tokens in turn, text first; a lone text if there are none."""
        return self._any.split(text) if self._any else [text]
