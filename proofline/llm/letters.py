"""Words of a text as arrays of letters, and hashes of parts of them."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Words:
    """The runs of letters of a lower-cased text. `chars` has them one after another, each with a zero before it and one at the end.

    `starts` and `ends` bound the words in chars, `text_starts` and `text_ends` in the lower-cased text.
    """

    def __init__(self, text: str) -> None:
        self.text = text.lower()
        code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        letter = np.zeros(code.size + 2, np.int8)
        letter[1:-1] = _is_letter()[code]
        edge = np.flatnonzero(np.diff(letter))
        self.text_starts, self.text_ends = edge[::2], edge[1::2]
        n = self.text_ends - self.text_starts
        self.starts = np.cumsum(n + 1) - n
        self.ends = self.starts + n
        self.chars = np.zeros(int((n + 1).sum()) + 1, np.uint64)
        spots = np.ones(self.chars.size, bool)
        spots[self.starts - 1], spots[-1] = False, False
        self.chars[spots] = code[letter[1:-1].astype(bool)]

    def __len__(self) -> int:
        return self.starts.size


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ngrams(chars: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters from each place on (for the last places of those that are left)."""
    h = np.full(chars.size, n, np.uint64)
    for k in range(n):
        h[: chars.size - k] = (h[: chars.size - k] + chars[k:] + np.uint64(1)) * MULT
    return mixed(h)
