"""Sets of hashed word shingles, made with array operations."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: Words whose hash a task remembers; it starts anew beyond that.
REMEMBERED = 100000
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.random.default_rng(20240502).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Hashes()


def forget_words() -> None:
    """Called at the end of a task: its worker lives on."""
    _WORDS.clear()


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a UTF-8 text; all words as one where there are fewer.

    Words are runs without ASCII white space, A-Z lower-cased. A text without words has the empty set.
    """
    words = text.translate(_UPPER).split()  # bytes split at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    span = min(SHINGLE, len(hashes))
    count = len(hashes) - span + 1
    total = hashes[:count] * _ODD[0]
    for k in range(1, span):
        total += hashes[k:k + count] * _ODD[k]
    return np.unique(mixed(total + np.uint64(span)))
