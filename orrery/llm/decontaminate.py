"""Benchmark decontamination: finds benchmark passages in documents within an edit budget, by q-gram filtering and banded alignment.

Texts are compared as bytes with A-Z lower-cased and every run of other ASCII than letters and digits as one blank. An item
of m such bytes may differ by k = floor(rate * m) edits. An occurrence within k edits keeps at least m - q + 1 - k q of the
item's q-grams, on diagonals (place in the text less place in the item) that span at most k + 1. Diagonals are cut into
strips of k + 1; two neighbouring strips form a band, bands overlap by a strip, so one band has all of them. Bands with
fewer shared q-grams are dropped, the others are aligned by dynamic programming along the band.

A document can hold a part of an item only. So an item of more than ``WINDOW`` bytes is also searched for by its windows of
that size, ``STRIDE`` bytes apart and one at its end, each with an edit budget and bound of its own: a run of
``WINDOW + STRIDE - 1`` bytes of the item has one in full, and at a rate of 0.1 a run of ``WINDOW`` bytes is within the
budget of one. Shorter runs can go unreported.

Texts are never shuffled: the benchmark goes to the documents, in blocks of bounded size with one pass each. A text is
looked at in parts where it meets the items in very many places, down to a few times the longest item; beyond that only
an item that repeats itself, met by its like, takes memory with the square of its length.

Defined results: a null or empty text holds nothing. Items that are null or have no letter or digit match nothing. Items
too short for the bound at q = 8 have a shorter q, down to 1, so that the bound stays positive. Repeated documents and
items are each reported. Null ids are reported as null. Empty tables give an empty result. A document that holds an item
several times has one row for it, with the fewest edits and the first such place. Where only windows of an item are held,
that is the window with the fewest edits; edits and place are the window's.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

Q = 8
#: Bytes of a longer item that are searched for on their own, and from one such window to the next.
WINDOW = 100
STRIDE = 20
#: Bytes of benchmark text in a block, which travels with the tasks of one pass.
BLOCK_BYTES = 8 << 20
#: Texts are handled in groups of about so many bytes.
GROUP = 1 << 20
#: Pairs of a place in the text and one in an item that are looked at in one go; a text with more is halved.
PAIRS = 4 << 20

_FOLD = np.full(256, 32, dtype=np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _FOLD[_b] = _b + 32 if 65 <= _b <= 90 else _b


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as compared, and the place of each in ``data``. No blank comes first, and none after a blank."""
    out = _FOLD[data]
    blank = out == 32
    keep = ~(blank & np.concatenate(([True], blank[:-1])))
    at = np.flatnonzero(keep)
    return out[at], at


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each place on as one number, q <= 8."""
    n = max(0, len(data) - q + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        out = (out << np.uint64(8)) | data[j : j + n]
    return out


@dataclass
class _Class:
    """Items of one q: their q-grams in order, with where each stands."""

    q: int
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


class Index:
    """The q-grams of a block of items. Its entries are the items and, after them, the windows of each that is longer than a window."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float) -> None:
        self.ids: list[int | None] = []
        self.texts: list[np.ndarray] = []
        for item_id, text in items:
            t = folded(np.frombuffer((text or "").encode(), dtype=np.uint8))[0]
            t = t[:-1] if len(t) and t[-1] == 32 else t
            if len(t):
                self.ids.append(item_id)
                self.texts.append(t)
        lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.windows = np.where(lengths > WINDOW, -(-(lengths - WINDOW) // STRIDE) + 1, 0)
        self.first = len(lengths) + np.cumsum(self.windows) - self.windows
        self.owner, self.start = np.arange(len(lengths)), np.zeros(len(lengths), dtype=np.int64)
        if self.windows.any():
            owner = np.repeat(self.owner, self.windows)
            start = np.minimum(STRIDE * (np.arange(len(owner)) + len(lengths) - self.first[owner]), lengths[owner] - WINDOW)
            self.owner, self.start = np.concatenate((self.owner, owner)), np.concatenate((self.start, start))
            self.texts += [self.texts[i][at : at + WINDOW] for i, at in zip(owner.tolist(), start.tolist(), strict=True)]
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.edits = (rate * self.sizes).astype(np.int64)
        self.q = np.maximum(1, np.minimum(Q, self.sizes // (self.edits + 1)))
        self.least = np.maximum(1, self.sizes - self.q + 1 - self.edits * self.q)
        # An item's q-grams are indexed at its own q and, for its windows, at theirs.
        by_q: dict[int, list[int]] = defaultdict(list)
        for q, i in sorted({*zip(self.q.tolist(), self.owner.tolist(), strict=True)}):
            by_q[q].append(i)
        self.classes = [self._index(q, own) for q, own in sorted(by_q.items())]

    def _index(self, q: int, own: list[int]) -> _Class:
        parts = [grams(self.texts[i], q) for i in own]
        codes = np.concatenate(parts)
        item = np.repeat(own, [len(p) for p in parts])
        place = np.concatenate([np.arange(len(p)) for p in parts])
        order = np.argsort(codes, kind="stable")
        keys, first = np.unique(codes[order], return_index=True)
        seen = np.zeros(1 << 22, dtype=bool)
        seen[_slot(keys)] = True
        return _Class(q, keys, np.append(first, len(codes)), item[order], place[order], seen)

    def candidates(self, data: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, first diagonal and document of each band that meets the bound. ``doc`` is the document of each place.

        Text and items that repeat the same q-grams meet in very many pairs of places. Such a text is taken in halves, which
        overlap by the longest stretch that an item can take up, so that each stretch lies in one of them.
        """
        met = []
        for c in self.classes:
            codes = grams(data, c.q)
            may = np.flatnonzero(c.seen[_slot(codes)])
            at = np.minimum(np.searchsorted(c.keys, codes[may]), len(c.keys) - 1)
            hit = c.keys[at] == codes[may]
            met.append((c, may[hit], at[hit]))
        reach = int((self.sizes + self.edits).max()) + Q
        if sum(int((c.first[at + 1] - c.first[at]).sum()) for c, _, at in met) > PAIRS and len(data) > 4 * reach:
            middle = len(data) // 2
            left = self.candidates(data[: middle + reach], doc[: middle + reach])
            entry, low, held = self.candidates(data[middle:], doc[middle:])
            return tuple(np.concatenate(x) for x in zip(left, (entry, low + middle, held), strict=True))
        found = []
        for c, may, at in met:
            n = c.first[at + 1] - c.first[at]
            which = np.repeat(c.first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            item, where, place = c.item[which], np.repeat(may, n), c.place[which]
            own = self.q[item] == c.q
            found.append(self._bands(item[own], where[own], place[own], data, doc))
            own = self.windows[item] > 0
            if own.any() and self.q[self.first[item[own][0]]] == c.q:
                found.append(self._bands(*self._in_windows(item[own], where[own], place[own], data, doc, c.q), data, doc))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3

    def _strips(self, entry: np.ndarray, where: np.ndarray, place: np.ndarray, edits: np.ndarray, data: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, int, int]:
        """The strip of each q-gram's diagonal as one number with entry and document, and what to take it apart by.

        Diagonals are those of the item, also for its windows. They are counted from the item's length before the group, so
        that they are never negative. Band b has the strips b and b + 1.
        """
        n_docs, wide = int(doc[-1]) + 1 if len(doc) else 1, len(data) + int(self.sizes.max()) + 4
        return (entry * n_docs + doc[where]) * wide + (where - place + self.sizes[self.owner[entry]]) // (edits + 1) + 1, n_docs, wide

    def _in_windows(self, item: np.ndarray, where: np.ndarray, place: np.ndarray, data: np.ndarray, doc: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The q-grams of items once for each window that has them, without those whose bands have too few for any window."""
        window = self.first[item[0]]
        key, _, _ = self._strips(item, where, place, self.edits[window], data, doc)
        strips, own, count = np.unique(key, return_inverse=True, return_counts=True)
        near = np.zeros(len(strips), dtype=np.int64)
        beside = np.flatnonzero(np.diff(strips) == 1)
        near[beside] = count[beside + 1]
        near[beside + 1] = np.maximum(near[beside + 1], count[beside])
        keep = (count + near >= self.least[window])[own]
        item, where, place = item[keep], where[keep], place[keep]
        last = self.windows[item] - 1
        each = [(last, place >= self.start[self.first[item] + last])]
        for back in range(-(-WINDOW // STRIDE) + 1):
            k = place // STRIDE - back
            each.append((k, (k >= 0) & (k < last) & (place - k * STRIDE <= WINDOW - q)))
        windows = np.concatenate([(self.first[item] + k)[ok] for k, ok in each])
        return windows, np.concatenate([where[ok] for _, ok in each]), np.concatenate([place[ok] for _, ok in each])

    def _bands(self, entry: np.ndarray, where: np.ndarray, place: np.ndarray, data: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n_docs, wide = self._strips(entry, where, place, self.edits[entry], data, doc)
        strips, count = np.unique(key, return_counts=True)
        bands, both = np.unique(np.concatenate((strips, strips - 1)), return_inverse=True)
        both = np.bincount(both, weights=np.concatenate((count, count)), minlength=len(bands))
        bands = bands[both >= self.least[bands // wide // n_docs]]
        if not len(bands):
            return (np.zeros(0, dtype=np.int64),) * 3
        # What the bound counts are places in the item: a q-gram that the text repeats counts once.
        places = []
        for back in (0, 1):
            at = np.minimum(np.searchsorted(bands, key - back), len(bands) - 1)
            mine = bands[at] == key - back
            places.append(at[mine] * (int(self.sizes.max()) + 1) + place[mine])
        distinct = np.bincount(np.unique(np.concatenate(places)) // (int(self.sizes.max()) + 1), minlength=len(bands))
        entry_ = bands // wide // n_docs
        ok = distinct >= self.least[entry_]
        entry_, bands = entry_[ok], bands[ok]
        return entry_, (bands % wide - 1) * (self.edits[entry_] + 1) - self.sizes[self.owner[entry_]] + self.start[entry_], bands // wide % n_docs


def align(text: np.ndarray, item: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """The fewest edits between ``item`` and a part of ``text`` along the diagonals low to high - 1, and where that part ends."""
    width = high - low
    far = len(item) + len(text) + 1
    step = np.arange(width)
    at = low + step  # places in text at row 0
    row = np.where((at >= 0) & (at <= len(text)), 0, far)
    for i in range(len(item)):
        # Diagonal d at row i + 1 stands after text[i + d].
        at = low + step + i
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[at[inside]] == item[i]
        across = np.where(inside, row + ~same, far)
        down = np.concatenate((row[1:] + 1, [far]))  # a byte of the item is missing in the text
        now = np.minimum(across, down)
        now = np.where((at + 1 >= 0) & (at + 1 <= len(text)), now, far)
        row = np.minimum.accumulate(now - step) + step  # bytes of the text that the item lacks
    best = int(np.argmin(row))
    return int(row[best]), len(item) + low + best


def find_passages(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """Number of the text, of the item, edits, and first and last byte (excluded) of the place in the whole text."""
    group, first, n = [], 0, 0
    for i, t in enumerate(texts):
        group.append((t or "").encode())
        n += len(group[-1])
        if n >= GROUP or i == len(texts) - 1:
            for doc, *rest in _find(index, group):
                yield first + doc, *rest
            group, first, n = [], i + 1, 0


def _find(index: Index, group: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    if not index.ids:
        return
    raw = np.frombuffer(b"\n".join(group), dtype=np.uint8)
    data, origin = folded(raw)
    starts = np.concatenate(([0], np.cumsum([len(g) + 1 for g in group])))
    doc = np.searchsorted(starts, origin, side="right") - 1
    bounds = np.searchsorted(doc, np.arange(len(group) + 1))
    with np.errstate(over="ignore"):
        entry, low, held = index.candidates(data, doc)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    whole: set[tuple[int, int]] = set()
    for e, d, o in sorted({*zip(entry.tolist(), low.tolist(), held.tolist(), strict=True)}, key=lambda x: (x[2], x[0], x[1])):
        j, k, m = int(index.owner[e]), int(index.edits[e]), int(index.sizes[e])
        a, b = int(bounds[o]), int(bounds[o + 1])
        # The band, and k diagonals on either side for edits before and after the q-grams; cut to the document.
        # Items come before windows, which are looked at where the whole item is not held.
        if (o, j) in best and (not best[o, j][0] or e != j and (o, j) in whole):
            continue
        lo = d - k - a
        from_ = max(0, lo)
        text = data[a + from_ : max(a + from_, min(b, d + 2 * (k + 1) + k + m))]
        same = text.tobytes().find(index.texts[e].tobytes())
        edits, end = (0, same + m) if same >= 0 else align(text, index.texts[e], lo - from_, lo - from_ + 2 * (k + 1) + 2 * k)
        if edits <= k and ((o, j) not in best or edits < best[o, j][0]):
            start = max(0, end - m) + from_ + a
            whole |= {(o, j)} if e == j else set()
            best[o, j] = edits, int(origin[min(start, b - 1)] - starts[o]), int(origin[max(a, from_ + a + end - 1)] + 1 - starts[o])
    for (o, j), (edits, s, e) in best.items():
        yield o, j, edits, s, e


_last: tuple[str, Index] | None = None


def _index(sent: Broadcast, token: str, rate: float) -> Index:
    """The index of a block of items, made once in a worker."""
    global _last
    if _last is None or _last[0] != token:
        _last = token, Index(sent.value, rate)
    return _last[1]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about ``BLOCK_BYTES``, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for block in range(n):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block) if n > 1 else items
        yield [(r.item_id, r.text) for r in own.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """doc_id, item_id, n_edits, start_byte and end_byte in the UTF-8 text: about where the passage stands.

    Passes over ``docs``: one for each block of benchmark text.
    """
    names = ["doc_id", "item_id", "n_edits", "start_byte", "end_byte"]

    def one(items: list[tuple[int | None, str | None]]) -> DataFrame:
        sent, token = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(sent, token, rate)
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(ids[i], index.ids[j], *more) for i, j, *more in find_passages(index, b.column(1).to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))

    return reduce(DataFrame.unionByName, [one(items) for items in _blocks(benchmark)])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """The rows of ``docs`` that hold no item and no window of one; passes as ``find_leaks``, each on what the one before kept."""
    at = docs.columns.index("text")
    for items in _blocks(benchmark):
        sent, token = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            index = _index(sent, token, rate)
            for b in slices(batches):
                held = {i for i, *_ in find_passages(index, b.column(at).to_pylist())}
                yield b.filter(pa.array([i not in held for i in range(b.num_rows)], pa.bool_())) if held else b

        docs = docs.mapInArrow(run, docs.schema)
    return docs
