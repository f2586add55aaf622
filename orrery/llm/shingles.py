"""Word shingles of whole texts as 64-bit hashes, on numpy arrays over many texts at a time.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. A text's set has the hash of every run of ``k``
words, each once; a text of fewer words has the hash of the whole sequence; one without words has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: Texts are handled in groups of about so many bytes.
GROUP = 1 << 20
#: Longer words are hashed one by one, by a digest.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: eight bytes at a time are added to a state that is mixed after each, its length first.

    ``data`` has 8 bytes more than the words. Unlike a polynomial in the bytes this has no word pairs that always collide.
    """
    size = ends - starts
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    left = np.flatnonzero(size <= LONG)
    done = 0
    while len(left):
        out[left] = mix((out[left] ^ (eight[starts[left] + done] & _MASK[np.minimum(size[left] - done, 8)])) + np.uint64(0x9E3779B97F4A7C15))
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _group(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)]
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edge = edge if blank[0] else np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    words = word_hashes(data, starts, ends)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    grams = words.copy()
    for j in range(1, k):
        grams[:-j] = mix(grams[:-j] * np.uint64(0xD6E8FEB86659FD93) + words[j:]) if len(words) > j else grams[:-j]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            h = words[a : a + 1]
            for j in range(1, b - a):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[a + j : a + j + 1])
            yield mix(h + np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted set of each text, in order; null counts as empty."""
    group, n = [], 0
    with np.errstate(over="ignore"):
        for t in texts:
            group.append((t or "").encode())
            n += len(group[-1]) + 1
            if n >= GROUP:
                yield from _group(group, k)
                group, n = [], 0
        if group:
            yield from _group(group, k)
