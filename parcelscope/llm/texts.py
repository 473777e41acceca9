"""Small helpers on one text, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xFF51AFD7ED558CCD)
CHUNK = 1 << 20


def split_words(text: str | None) -> list[bytes]:
    """Words without white space, A-Z lower-cased: both are what ``bytes`` methods do on UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """Hash of each word; the cache is emptied when it is full, so its size is bounded."""

    FULL = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.FULL:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * ODD
    return values ^ (values >> np.uint64(29))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words; with fewer words, of the whole sequence."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    n = len(hashes) - size + 1
    window = np.full(n, size, np.uint64)
    for at in range(size):
        window = mixed(window * GOLDEN + hashes[at : at + n])
    return window


def chunks(texts: list[str | None]) -> Iterator[slice]:
    """Neighbouring texts of about ``CHUNK`` characters together, so that memory doesn't follow the batch."""
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK or at == len(texts) - 1:
            yield slice(start, at + 1)
            start, size = at + 1, 0
