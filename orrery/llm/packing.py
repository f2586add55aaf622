"""Packing of documents into training sequences by cutting stock.

A document's ids are cut into pieces of a sequence's length and one shorter rest. Lengths are counted in units of a 256th of
a sequence, rounded up; the histogram over these classes, which is all that reaches the driver, gives cutting patterns
(see ``cutting_stock``). Pieces are ranked within their class, and a pattern takes the next ranks of each class that it
holds, so a piece finds its sequence from its class and rank alone.

Ranks need no shuffle: the task that encodes a piece counts the pieces of its class, and a table of the tasks' counts gives
where each task's ranks begin, so a class with most of the pieces is no single task's. Ids are written once with these
counts, and shuffled once, by sequence, to be put together and padded.

Defined results: a null or empty text has the end id alone. Rows that repeat a document are packed each. Null ids are
packed as null. An empty table gives no sequences. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, small_batches, staged
from .cutting_stock import plan
from .token_ids import encoder

#: Classes of lengths: on average half of one is lost with each rest.
CLASSES = 256
#: Sequences put together before they are handed on.
BATCH = 256


def unit(length: int) -> int:
    """Ids in a class of lengths."""
    return -(-length // CLASSES)


def id_type(vocabulary: int) -> str:
    """What ids below ``vocabulary`` travel as."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian, of the tokenizer's ``id_type``); part, class and rank: the rank is within the class and part.

    A piece that no other can share a sequence with has the last class. What is returned must be written before it is used
    twice, so that part and rank are of one attempt.
    """
    each = unit(length)
    top = length // each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (top + 1)
        enc, end = encoder(tokenizer, words=True), np.array([end_id], dtype="<u4")
        kind_of_id = id_type(max(enc.vocabulary, end_id + 1))
        for b in batches:
            rows, parts = [], []
            for doc_id, data in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                ids = np.concatenate((np.frombuffer(data, dtype="<u4"), end)).astype(kind_of_id)
                for at in range(0, len(ids), length):
                    own = ids[at : at + length]
                    kind = min(top, -(-len(own) // each))
                    rows.append((doc_id, at, len(own), len(ids), part, kind, seen[kind]))
                    parts.append(own.tobytes())
                    seen[kind] += 1
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], [*_PIECE_NAMES, "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, part int, class int, rank long, ids binary")


_PIECE_NAMES = ["doc_id", "start", "length", "doc_tokens", "part", "class", "rank"]
_PIECE_TYPES = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()]


class Places:
    """Where the piece of a class and rank goes: the sequence, and the slot that orders it there. Small, and sent to tasks."""

    def __init__(self, cuts: list[tuple[dict[int, int], int]], top: int) -> None:
        first: list[list[int]] = [[] for _ in range(top + 1)]
        more: list[list[tuple[int, int, int]]] = [[] for _ in range(top + 1)]
        taken = [0] * (top + 1)
        sequence = 0
        for pattern, times in cuts:
            slot = 0
            for c, copies in sorted(pattern.items(), reverse=True):
                first[c].append(taken[c])
                more[c].append((sequence, copies, slot))
                taken[c] += copies * times
                slot += copies
            sequence += times
        self.first, self.more = [np.array(f) for f in first], [np.array(m).reshape(-1, 3) for m in more]

    def of(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(classes), dtype=np.int64), np.zeros(len(classes), dtype=np.int64)
        for c in np.unique(classes).tolist():
            own = np.flatnonzero(classes == c)
            at = np.searchsorted(self.first[c], ranks[own], side="right") - 1
            n, copies = ranks[own] - self.first[c][at], self.more[c][at, 1]
            sequence[own] = self.more[c][at, 0] + n // copies
            slot[own] = self.more[c][at, 2] + n % copies
        return sequence, slot


def _placed(table: DataFrame, length: int) -> DataFrame:
    """sequence_id, slot and a piece's own columns."""
    counts = table.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = staged(counts.select("class", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), "begins")
    top = length // unit(length)
    places = Places(plan({r["class"]: r["n"] for r in begins.groupBy("class").agg(F.sum("n").alias("n")).collect()}, top), top)
    own = ["doc_id", "start", "length", "doc_tokens", "ids"]
    ranked = table.join(begins.select("class", "part", "begin"), ["class", "part"]).select("class", (F.col("begin") + F.col("rank")).alias("rank"), *own)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, slot = places.of(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(sequence), pa.array(slot), *b.columns[2:]], ["sequence_id", "slot", *own])

    return ranked.mapInArrow(place, "sequence_id long, slot long, doc_id long, start long, length long, doc_tokens long, ids binary")


def sequences(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids and pieces of each sequence, written to the shared folder.

    ``ids`` (little-endian unsigned 32-bit) is the pieces' ids one after another, padded to ``length`` with ``pad_id`` except where ``n_tokens`` is a power of
    two. ``pieces`` is an array of doc_id, start (the document's ids before it), length, doc_tokens and offset (in ``ids``).
    """
    with small_batches(docs.sparkSession):
        table = staged(pieces(docs, tokenizer, end_id, length), "pieces", "zstd")
    dealt = _placed(table, length).repartition(partitions(docs.sparkSession), "sequence_id").sortWithinPartitions("sequence_id", "slot")
    kind_of_id, pad = id_type(max(encoder(tokenizer, words=True).vocabulary, end_id + 1)), np.array([pad_id], dtype="<u4").tobytes()
    piece = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "offset")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, bytes, list[dict]]] = []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), piece), strict=True)], ["sequence_id", "n_tokens", "ids", "pieces"])
            out.clear()
            return batch

        now, have, parts, own = None, 0, [], []

        def finish() -> None:
            if now is not None:
                fill = length - have if have & (have - 1) else 0
                out.append((now, have, np.frombuffer(b"".join(parts), dtype=kind_of_id).astype("<u4").tobytes() + pad * fill, own))

        for b in batches:
            for sequence, doc_id, start, n, doc_tokens, ids in zip(*[b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)], strict=True):
                if sequence != now:
                    finish()
                    now, have, parts, own = sequence, 0, [], []
                    if len(out) >= BATCH:
                        yield made()
                own.append({"doc_id": doc_id, "start": start, "length": n, "doc_tokens": doc_tokens, "offset": have})
                parts.append(ids)
                have += n
        finish()
        if out:
            yield made()

    with small_batches(docs.sparkSession):
        done = staged(dealt.mapInArrow(run, "sequence_id long, n_tokens long, ids binary, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"), "sequences", "zstd")
    discard(table)
    return done


def read_pieces(packed: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32 (of the ids read back), doc_tokens, sequence_id and offset of each piece of ``sequences``."""

    def read(p: Column) -> Column:
        own = F.substring("ids", (4 * p["offset"] + 1).cast("int"), (4 * p["length"]).cast("int"))
        return F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"), F.crc32(own).alias("ids_crc32"), p["doc_tokens"].alias("doc_tokens"), p["offset"].alias("offset"))

    rows = packed.select("sequence_id", F.explode(F.transform("pieces", read)).alias("p"))
    return rows.select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")
