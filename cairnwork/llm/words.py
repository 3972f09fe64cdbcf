"""Words and word shingles of a run of texts, as numpy arrays.

A word is a longest run of the bytes 0-9, a-z and 0x80-0xFF after A-Z were lower-cased, which is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over the lower-cased text. All hashes are 64 bits wide
and the same in every process.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that nearby inputs get unlike outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    forth, back = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    forth[0] = back[0] = 1
    return np.multiply.accumulate(forth), np.multiply.accumulate(back)


@dataclass
class Words:
    """``first[d]`` to ``first[d + 1]`` are the words of text d."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, begin: int, end: int) -> list[str]:
        return [self.data[s:e].decode("utf-8", "replace") for s, e in zip(self.start[begin:end], self.end[begin:end], strict=True)]


def words_of(texts: list[bytes]) -> Words:
    """Tokenise a run of texts (a few MB at most: about 40 bytes of memory go to each byte)."""
    raw = b"\0".join(texts) + b"\0"
    low = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = _IS_WORD[low]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    opens = np.concatenate(([0], np.cumsum(sizes + 1)))
    first = np.searchsorted(start, opens)
    size = 1 << max(16, int(len(low)).bit_length())
    forth, back = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low * forth[: len(low)], dtype=np.uint64)))
        hashes = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    return Words(low.tobytes(), start, end, hashes, first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each place, and whether they all lie in one text."""
    n = len(words.hashes)
    places = max(0, n - k + 1)
    out = np.full(places, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * _STEP + words.hashes[j : j + places])
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts)
    return out, owner[:places] == owner[k - 1 : k - 1 + places] if places else np.zeros(0, bool)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; of 1 to k - 1 words, all of them are one shingle."""
    full, valid = shingles(words, k)
    short = {m: shingles(words, m)[0] for m in set(words.counts.tolist()) if 0 < m < k}
    out = []
    for begin, count in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if count >= k:
            out.append(np.unique(full[begin : begin + count - k + 1]))
        elif count:
            out.append(short[count][begin : begin + 1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out
