"""Hashed character n-gram counts of whole texts, with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BITS = 15
DIM = 1 << BITS
BLOCK = 1 << 19
_LOW = 1 << 16


@lru_cache(maxsize=1)
def letters_table() -> np.ndarray:
    """Code point to lower-case letter, or to a space for all else (first plane)."""
    out = np.full(_LOW, 32, np.uint32)
    for c in range(_LOW):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch.lower()[0])
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letter_codes(points: np.ndarray) -> np.ndarray:
    low = letters_table()[np.minimum(points, _LOW - 1)]
    high = points >= _LOW
    if high.any():
        letters = np.array([c for c in np.unique(points[high]) if chr(int(c)).isalpha()], np.uint32)
        low = np.where(high, np.where(np.isin(points, letters), points, 32), low).astype(np.uint32)
    return low


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return any((letter_codes(code_points(text[a : a + BLOCK])) != 32).any() for a in range(0, len(text), BLOCK))


def ngram_counts(text: str | None, letters_only: bool = True) -> np.ndarray:
    """Counts of 1-, 2- and 3-grams in DIM hashed slots; texts of any length, in blocks."""
    total = np.zeros(DIM, np.int64)
    if not text:
        return total
    shift = np.uint32(32 - BITS)
    for at in range(0, len(text), BLOCK):
        points = code_points(text[max(0, at - 2) : at + BLOCK])
        c = letter_codes(points) if letters_only else points
        a = c * np.uint32(0x9E3779B1)
        b = (a[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        t = (b[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        skip = min(2, at)  # n-grams that end in the overlap were counted with the block before
        for n, h in ((1, a), (2, b), (3, t)):
            total += np.bincount(h[max(0, skip - n + 1) :] >> shift, minlength=DIM)
    return total


def sparse(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (1.0 + np.log(counts[at])).astype(np.float32)
