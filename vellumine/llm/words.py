"""Word runs and their hashes, shared by the operators on word sequences."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

#: Runs of letters and digits.
RUN = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[­؀-؅؜۝܏࢐࢑࣢᠎​-‏‪-‮⁠-⁤⁦-⁯﻿￹-￻\U000110bd\U000110cd\U00013430-\U0001343f\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0001\U000e0020-\U000e007f]")


def normal_words(text: str) -> list[str]:
    """Runs of letters and digits after NFKC, removal of format characters (Cf) and lower-casing."""
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return RUN.findall(text.lower())


class Hasher:
    """64-bit hashes of strings, remembered up to a bound on entries."""

    def __init__(self, bound: int = 1 << 20) -> None:
        self.known: dict[str, int] = {}
        self.bound = bound

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            for i, w in enumerate(words):
                if found[i] is None:
                    h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                    found[i] = known[w] = h - (1 << 64) if h >> 63 else h
        return np.array(found, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the sequences of ``k`` consecutive words, in order; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    w = words.view(np.uint64)
    for i in range(k):
        out = mix(out + w[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    return out
