"""Ids of many words at a time: each distinct word is worked out once and remembered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words that a worker remembers; all go at once.
REMEMBERED = 400_000
#: Longer words are worked out anew in every block of texts.
LONGEST = 64


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all elements of pieces given by start and length, and where each piece ends in them."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total), ends


class WordIds:
    """``learn`` gives little-endian 32-bit ids of words; ``fixed`` words have one id each."""

    def __init__(
        self, learn: Callable[[list[str]], list[bytes]], fixed: dict[str, int], remembered: int = REMEMBERED
    ):
        self.learn, self.fixed, self.remembered = learn, fixed, remembered
        self._forget()

    def _forget(self) -> None:
        self.known = {w: i for i, w in enumerate(self.fixed)}
        self.flat = np.fromiter(self.fixed.values(), np.uint32, len(self.fixed))
        self.starts = np.arange(len(self.fixed), dtype=np.int64)
        self.lengths = np.ones(len(self.fixed), np.int64)

    def _add(self, words: list[str]) -> dict[str, int]:
        """Work out words and return their places; those that are too long to remember only there."""
        ids = self.learn(words)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = len(self.lengths)
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), "<u4"))
        long = {}
        for i, w in enumerate(words, first):
            (self.known if len(w) <= LONGEST else long)[w] = i
        return long

    def encode(self, words: list[str], counts: list[int]) -> list[bytes]:
        """Ids of texts given as their words in a row and how many each has."""
        distinct = set(words)
        if len(self.known) + len(distinct) > self.remembered or len(self.flat) > 8 * self.remembered:
            self._forget()
        long = self._add(list(distinct - self.known.keys()))
        known = self.known | long if long else self.known
        slot = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        places, ends = ragged(self.starts[slot], self.lengths[slot])
        raw = self.flat[places].astype("<u4").tobytes()
        cuts = (np.append(0, ends)[np.cumsum([0, *counts])] * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
