"""Word shingles of whole texts as 64-bit hashes, a batch of documents at a time in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words of more bytes are hashed one by one.
_LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, A-Z lower-cased, and the number of words of each text."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    flat = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True))
    first, length = edge[::2], edge[1::2] - edge[::2]
    ends = np.searchsorted(first, np.cumsum(size))
    counts = np.diff(ends, prepend=0)
    hashes = length.astype(np.uint64)
    left = np.flatnonzero(length <= _LONG)
    for at in range(int(length[left].max(initial=0))):
        left = left[length[left] > at]
        hashes[left] = hashes[left] * _A + flat[first[left] + at]
    for i in np.flatnonzero(length > _LONG):
        word = flat[first[i] : first[i] + length[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return mix(hashes), counts


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes.

    A text of fewer words is one shingle, a text without words has none. At 64
    bits two different shingles of a pair of texts meet with a chance of about
    their sizes' product over 2**64.
    """
    hashes, counts = word_hashes(texts)
    rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * _B + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    sets, start = [], 0
    for n in counts.tolist():
        if n >= words:
            sets.append(np.unique(rolled[start : start + n - words + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for h in hashes[start : start + n]:
                whole = whole * _B + h
            sets.append(mix(whole))
        else:
            sets.append(np.empty(0, np.uint64))
        start += n
    return sets


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, the same for equal sets only, up to chance."""
    filled = [s for s in sets if len(s)]
    out = np.zeros((2, len(sets)), np.uint64)
    if filled:
        flat = np.concatenate(filled)
        at = np.concatenate([[0], np.cumsum([len(s) for s in filled])[:-1]])
        rows = np.flatnonzero([len(s) > 0 for s in sets])
        out[0, rows] = np.add.reduceat(mix(flat * _A), at)
        out[1, rows] = np.add.reduceat(mix(flat ^ _B), at)
    return out[0].view(np.int64), out[1].view(np.int64)
