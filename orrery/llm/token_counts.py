"""Token counts by byte-pair encoding on numpy arrays.

All pre-tokens of a batch lie in one ragged array of symbols. In each round every pre-token finds its pair of lowest rank,
and all those pairs merge at once; pre-tokens without a pair in the merge table leave the batch. What survives is the
count. Merging all places of a pre-token's lowest pair in one round gives the same as one at a time, because a symbol's
own merges always rank after the merge that makes it; ``MergeTable`` checks that of its vocabulary when it is loaded.

Defined results: a null or empty text has 0 tokens. Repeated rows count each. Special strings inside a text are one token
each, as the library has them by default. Whole texts are counted; a word of any length is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from . import pretokens

NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it prints, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}
    return [letters[b] for b in range(256)]


#: The pre-tokens of ASCII letters in lower case, as the tokenizer file splits them.
_ASCII_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


class MergeTable:
    """The merges of a tokenizer file as sorted arrays of pair keys."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.n = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        born = np.full(self.n, -1, dtype=np.int64)
        born[made[::-1]] = np.arange(len(merges))[::-1]
        last = np.full(self.n, -1, dtype=np.int64)
        last[made] = np.arange(len(merges))
        rank = np.arange(len(merges))
        if (last[left] >= rank).any() or (last[right] >= rank).any() or (born != last).any():
            raise ValueError("a symbol's merges must rank after the one merge that makes it")
        order = np.argsort(left * self.n + right, kind="stable")
        self.keys, self.ranks, self.made = (left * self.n + right)[order], order.astype(np.int64), made
        #: Pairs by a hash of 22 bits first: most pairs asked for have no merge.
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[self._slot(self.keys)] = True
        #: The symbol of each byte, inside a word and at its end.
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B1)) >> 9) & ((1 << 22) - 1)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.n + b
        out = np.full(len(keys), NONE)
        may = np.flatnonzero(self.seen[self._slot(keys)])
        if len(may):
            at = np.minimum(np.searchsorted(self.keys, keys[may]), len(self.keys) - 1)
            hit = self.keys[at] == keys[may]
            out[may[hit]] = self.ranks[at[hit]]
        return out

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word, when no pair of neighbours is in the table any more. Words aren't empty."""
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = counts.copy()
        if not len(words):
            return out
        octets = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = np.arange(len(words))
        ends = np.cumsum(counts) - 1
        symbols = self.inner[octets]
        symbols[ends] = self.final[octets[ends]]
        ranks = np.full(len(symbols), NONE)
        ranks[:-1] = self.rank_of(symbols[:-1], symbols[1:])
        ranks[ends] = NONE
        while len(ids):
            starts = np.concatenate(([0], ends[:-1] + 1))
            lowest = np.minimum.reduceat(ranks, starts)
            live = lowest < NONE
            out[ids[~live]] = counts[~live]
            if not live.all():
                keep = np.repeat(live, counts)
                symbols, ranks, ids, counts, lowest = symbols[keep], ranks[keep], ids[live], counts[live], lowest[live]
                ends = np.cumsum(counts) - 1
                if not len(ids):
                    break
                starts = np.concatenate(([0], ends[:-1] + 1))
            chosen = ranks == np.repeat(lowest, counts)
            at = np.flatnonzero(chosen)
            # In a run of equal symbols the places overlap: from the left, every second one merges.
            fresh = np.concatenate(([True], np.diff(at) > 1))
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            word = np.searchsorted(ends, at)
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            counts = counts - np.bincount(word, minlength=len(counts))
            place = (np.cumsum(keep) - 1)[at]
            symbols, ranks = symbols[keep], ranks[keep]
            ends = np.cumsum(counts) - 1
            last = np.zeros(len(symbols), dtype=bool)
            last[ends] = True
            for p in (place, place[place > 0] - 1):
                p = p[~last[p]]
                ranks[p] = self.rank_of(symbols[p], symbols[p + 1])
            ranks[ends] = NONE
        return out


class TokenCounter:
    """Counts by the rules of a tokenizer file: its normalizer and pre-tokenizer from the library, its merges from here."""

    def __init__(self, path: str) -> None:
        self.library = pretokens.load(path)
        self.merges = MergeTable(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memory = pretokens.Memory(self._count_chunks, words=True)
        self.octet = {c: b for b, c in enumerate(byte_letters())}

    def _pieces(self, chunk: str) -> tuple[int, list[bytes]]:
        """Special strings in a chunk, and its pre-tokens as UTF-8."""
        if chunk.isascii() and "<|" not in chunk:
            return 0, _ASCII_WORD.findall(chunk.lower().encode())
        parts, n = [chunk], 0
        for s in self.special:
            if s in chunk:
                cut = [p.split(s) for p in parts]
                n += sum(len(p) - 1 for p in cut)
                parts = [x for p in cut for x in p]
        out: list[bytes] = []
        for p in filter(None, parts):
            normal = self.library.normalizer.normalize_str(p)
            if normal.isalpha():
                out.append(normal.encode())
            else:
                out += [bytes(map(self.octet.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal) if w]
        return n, out

    def _count_chunks(self, chunks: list[str]) -> tuple[None, np.ndarray]:
        base = np.zeros(len(chunks), dtype=np.int64)
        words: list[bytes] = []
        sizes: list[int] = []
        for i, c in enumerate(chunks):
            base[i], pieces = self._pieces(c)
            words += pieces
            sizes.append(len(pieces))
        np.add.at(base, np.repeat(np.arange(len(chunks)), sizes), self.merges.surviving(words))
        return None, base

    def counts(self, column: pa.Array) -> list[int]:
        out: list[int] = []
        for group in pretokens.grouped(column):
            for entries, per_text, odd in self.memory.look_up(group, lambda t: int(self._count_chunks([t])[1][0])):
                sums = np.concatenate(([0], np.cumsum(self.memory.count[entries])))[per_text]
                out += [odd.get(i, n) for i, n in enumerate(np.diff(sums).tolist())]
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row of ``docs``, in one pass without a shuffle.

    ``tokenizer`` is a tokenizer file whose pre-tokens never cross white space and which drops white space.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            n = c.counts(b.column(1))
            size = [x or 0 for x in pa.compute.binary_length(b.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
