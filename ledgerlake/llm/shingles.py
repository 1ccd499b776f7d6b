"""Word shingles as sorted sets of 64-bit hashes, with numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_PER_SHINGLE = 5
#: Odd multipliers, one for each place in a shingle.
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept for the words seen; emptied at LIMIT words, so that memory is bounded."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles; a text of fewer words has one, of all its words; a
    text without words, or null, has none. Words are parted by space, tab, LF, VT, FF and CR; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(WORDS_PER_SHINGLE, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for place in range(k):
        out += h[place : place + n] * _PLACE[place]
    return np.unique(mix(out))
