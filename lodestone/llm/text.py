"""Words of texts as 64-bit hashes, for whole batches of texts at a time."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

from lodestone.operators.batches import slices

__all__ = ["WORD", "batch_hashes", "batch_rolling", "mixed", "rolling", "slices", "word_hashes"]

#: A word is a maximal run of letters or digits, compared in lower case.
WORD = re.compile(r"[^\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash of each word seen by this worker; forgets when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, in order; a null text has none."""
    return np.fromiter(map(_HASHES.__getitem__, WORD.findall((text or "").lower())), dtype=np.uint64)


def batch_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and the place where each text begins (and the end of the last)."""
    found = [WORD.findall((t or "").lower()) for t in texts]
    places = np.zeros(len(found) + 1, dtype=np.int64)
    np.cumsum([len(f) for f in found], out=places[1:])
    return np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(found)), dtype=np.uint64, count=places[-1]), places


def batch_rolling(words: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the windows of ``length`` words that lie within one text, and the number of the text of each."""
    values = rolling(words, length)
    text = np.repeat(np.arange(len(places) - 1), np.diff(places))[: len(values)]
    whole = np.arange(len(values)) + length <= places[text + 1]
    return values[whole], text[whole]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, so that any range of them is a fair sample."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin value (modulo 2^64) of every window of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, span, have = None, 0, words, 1, length
        base = _MULTIPLIER
        # windows of 1, 2, 4, ... words; those in the binary form of ``length`` are joined
        while have:
            if have & 1:
                part = power[done : done + n]
                out = part if out is None else out * base + part
                done += span
            have >>= 1
            if have:
                power = power[:-span] * base + power[span:]
                span, base = span * 2, base * base
    return mixed(out)
