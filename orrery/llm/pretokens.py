"""Texts cut into chunks that tokenize alike alone and in place, and a bounded memory of chunks seen, all on numpy arrays.

Natural text repeats its words, so a worker tokenizes a chunk once and looks it up after. Texts lie one after another in
one array of bytes; cuts are found by the kinds of neighbouring bytes. A chunk of up to 16 bytes is its own key, as two
64-bit numbers, so that no two chunks are ever taken for one; longer ones are keys of a dictionary.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Chunks kept, ids kept for them, and the longest chunk kept, in bytes. When full, the memory starts anew.
SIZE, POOL, LONGEST = 1_000_000, 16_000_000, 64
#: Texts are handled in groups of about so many bytes.
GROUP = 4_000_000

OTHER, LETTER, DIGIT, MARK, APOSTROPHE, BLANK, END = range(7)


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, dtype=np.uint8)
    for b in range(33, 127):
        kind[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
    kind[ord("'")] = APOSTROPHE
    kind[[9, 10, 13, 32]] = BLANK
    kind[0] = END
    return kind


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def _between(words: bool) -> np.ndarray:
    """Whether tokenizers of this kind always cut between bytes of two kinds, by kind and kind."""
    out = np.zeros((7, 7), dtype=bool)
    for a in (LETTER, DIGIT, MARK):
        for b in (LETTER, DIGIT, MARK):
            out[a, b] = a != b
    out[LETTER, APOSTROPHE] = out[DIGIT, APOSTROPHE] = True
    out[DIGIT, DIGIT] = words
    return out.ravel()


def load(path: str):
    """The library's tokenizer. One thread: Spark runs a worker per core already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.model._resize_cache(0)  # chunks come once each
    return out


def grouped(column: pa.Array, rows: int = 256) -> Iterator[list[str]]:
    """A column of texts in order in groups of about ``GROUP`` code points; null counts as empty."""
    group, n = [], 0
    for i in range(0, len(column), rows):
        for t in column.slice(i, rows).to_pylist():
            group.append(t or "")
            n += len(group[-1])
            if n >= GROUP:
                yield group
                group, n = [], 0
    if group:
        yield group


def _kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; two-byte letters of U+00C0 to U+017F count as letters, but for one that lower-cases to two characters."""
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    if len(lead):
        follow = data[lead + 1]
        first = data[lead]
        lead = lead[~((first == 0xC3) & ((follow == 0x97) | (follow == 0xB7))) & ~((first == 0xC4) & (follow == 0xB0))]
        kind[lead] = kind[lead + 1] = LETTER
    return kind


def _odd_places(data: np.ndarray, words: bool) -> np.ndarray:
    """Where special strings may start and, unless white space is dropped anyway, where there is some that the cuts don't know."""
    found = [np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))]
    if not words:
        found.append(np.flatnonzero((data < 32) & ((data == 0x0B) | (data == 0x0C) | (data >= 0x1C))))
        high = np.flatnonzero((data == 0xC2) | (data >= 0xE1))
        high = high[high + 2 < len(data)]
        a, b, c = data[high], data[high + 1], data[high + 2]
        found.append(high[
            (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
            | (a == 0xE2) & ((b == 0x80) & ((c <= 0x8D) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
            | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
        ])
    return np.concatenate(found)


def cuts(data: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks in texts that each end with a zero byte. Chunks don't hold that.

    ``words``: white space is dropped. Otherwise a blank goes with what follows, and what a run of white space has before
    its last character is a chunk.
    """
    kind = _kinds_of(data)
    before, here = kind[:-1], kind[1:]
    cut = np.empty(len(data), dtype=bool)
    cut[0] = True
    cut[1:] = _between(words)[before * np.uint8(7) + here]
    blank, end = kind == BLANK, kind == END
    after_gap = blank[:-1] | end[:-1] if words else end[:-1] | (blank[:-1] & (data[:-1] != 32))
    cut[1:] |= after_gap & ~blank[1:]
    cut[1:] |= blank[1:] & ~blank[:-1]
    cut[1:] |= end[1:]
    if not words:
        cut[:-1] |= blank[:-1] & ~(blank[1:] | end[1:])
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    keep = ~(end[starts] | blank[starts]) if words else ~end[starts]
    return starts[keep], ends[keep]


class Memory:
    """What ``make`` gives for chunks: how many ids each has and, if ``make`` gives them, which.

    ``make`` takes a list of chunks and gives their ids one after another, or None, and their counts.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray | None, np.ndarray]], words: bool, size: int = SIZE) -> None:
        self.make, self.words, self.size = make, words, size
        self._clear()

    def _clear(self) -> None:
        self.bits = 12
        self._slots()
        self.n, self.n_ids = 0, 0
        self.count, self.first = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64)
        self.ids = np.zeros(1 << 12, dtype=np.uint32)
        self.long: dict[bytes, int] = {}

    def _slots(self) -> None:
        self.low, self.high, self.entry = (np.zeros(1 << self.bits, dtype=t) for t in (np.uint64, np.uint64, np.int64))
        self.used = 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        out = np.full(len(low), -1, dtype=np.int64)
        slot, todo = self._slot(low, high), None
        while len(low):
            have = self.low[slot]
            hit = (have == low) & (self.high[slot] == high)
            if todo is None:
                out[hit] = self.entry[slot[hit]]
                todo = np.flatnonzero(~hit & (have != 0))
                low, high, slot = low[todo], high[todo], slot[todo]
            else:
                out[todo[hit]] = self.entry[slot[hit]]
                go = ~hit & (have != 0)
                todo, low, high, slot = todo[go], low[go], high[go], slot[go]
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return out

    def _put(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        """New keys, each once."""
        if 2 * (self.used + len(low)) > 1 << self.bits:
            old = self.low != 0
            low, high, entry = np.concatenate((self.low[old], low)), np.concatenate((self.high[old], high)), np.concatenate((self.entry[old], entry))
            while 2 * len(low) > 1 << self.bits:
                self.bits += 1
            self.bits += 1
            self._slots()
        self.used += len(low)
        slot = self._slot(low, high)
        while len(low):
            free = np.flatnonzero(self.low[slot] == 0)
            at, which = np.unique(slot[free], return_index=True)
            which = free[which]
            self.low[at], self.high[at], self.entry[at] = low[which], high[which], entry[which]
            left = np.ones(len(low), dtype=bool)
            left[which] = False
            low, high, entry = low[left], high[left], entry[left]
            slot = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Entries made for ``chunks``."""
        ids, counts = self.make(chunks)
        n = self.n + len(chunks)
        if n > len(self.count):
            self.count, self.first = (np.concatenate((x, np.zeros(n, dtype=np.int64))) for x in (self.count, self.first))
        self.count[self.n : n] = counts
        if ids is not None:
            self.first[self.n : n] = self.n_ids + np.cumsum(counts) - counts
            if self.n_ids + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(self.n_ids + len(ids), dtype=np.uint32)))
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.n_ids += len(ids)
        made = np.arange(self.n, n)
        self.n = n
        return made

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each chunk, good until the next call. ``data`` has 16 bytes more than the texts."""
        if self.n > self.size or self.n_ids > POOL:
            self._clear()
        size = ends - starts
        words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        out = np.empty(len(starts), dtype=np.int64)
        short = np.flatnonzero(size <= 16)
        at, n = starts[short], size[short]
        low = words[at] & _MASK[np.minimum(n, 8)]
        high = words[at + 8] & _MASK[np.maximum(n - 8, 0)]
        found = self._find(low, high)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            a, b = low[order], high[order]
            fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b = a[fresh], b[fresh]
            chunks = [c.decode() for c in np.stack((a, b), axis=1).astype("<u8").view("S16").ravel().tolist()]
            made = self._learn(chunks)
            self._put(a, b, made)
            found[order] = made[np.cumsum(fresh) - 1]
        out[short] = found
        long = np.flatnonzero(size > 16)
        if len(long):
            raw = data.tobytes()
            keys = [raw[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            new_keys = [k for k in dict.fromkeys(keys) if k not in self.long]
            self.long.update(zip(new_keys, self._learn([k.decode() for k in new_keys]).tolist(), strict=True))
            out[long] = [self.long[k] for k in keys]
            for k in new_keys:
                if len(k) > LONGEST:
                    del self.long[k]
        return out

    def look_up(self, texts: list[str], whole: Callable[[str], np.ndarray | int]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, np.ndarray | int]]]:
        """Once for all of ``texts``: the entries of their chunks, where each text's begin (and one end more), and ``whole`` of odd texts.

        An odd text has no chunks: one with a zero byte or a possible special string, or white space that the cuts don't know.
        """
        octets = [t.encode() for t in texts]
        odd = {i for i, t in enumerate(octets) if b"\0" in t}
        data = np.frombuffer(b"\0".join(b"" if i in odd else t for i, t in enumerate(octets)) + b"\0" + bytes(16), dtype=np.uint8)
        body = data[:-16]
        bounds = np.concatenate(([0], np.cumsum([1 if i in odd else len(t) + 1 for i, t in enumerate(octets)])))
        odd.update((np.searchsorted(bounds, _odd_places(body, self.words), side="right") - 1).tolist())
        if self.words:
            data = _LOWER[data]
        starts, ends = cuts(data[:-16], self.words)
        per_text = np.searchsorted(starts, bounds)
        if odd:
            keep = np.ones(len(starts), dtype=bool)
            for i in odd:
                keep[per_text[i] : per_text[i + 1]] = False
            starts, ends = starts[keep], ends[keep]
            per_text = np.searchsorted(starts, bounds)
        with np.errstate(over="ignore"):
            yield self.entries(data, starts, ends), per_text, {i: whole(texts[i]) for i in sorted(odd)}

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``entries`` one after another, and where each entry's begin (and one end more)."""
        counts = self.count[entries]
        ends = np.concatenate(([0], np.cumsum(counts)))
        at = np.repeat(self.first[entries] - ends[:-1], counts) + np.arange(ends[-1])
        return self.ids[at], ends
