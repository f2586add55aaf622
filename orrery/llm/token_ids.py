"""Token ids of texts in bit-packed binary files, and reading them back.

A file holds the ids of consecutive documents at a fixed width, the fewest bits that hold the vocabulary's largest id:

    8 bytes  magic ``ORRYIDS1``
    blocks   each of ``block`` ids (the last may have fewer), packed from the low bit of the first byte on
    footer   little-endian int64: the offset of every block and of the blocks' end, then doc_id, first id, ids of every document,
             then whether doc_id is null
    trailer  little-endian int64: documents, blocks, ids, ids in a block, bits, length of the footer

A block starts on a byte, so any range of ids is read by seeking to its blocks and unpacking them with numpy. Documents
are dealt to files by ranges of (doc_id, text hash); a file is written under a name of its own for each attempt and taken
up by the manifest only when its task has ended, so lost executors and repeated tasks leave no half files in use. The
files go to the shared folder through the filesystem that its URI names.

Defined results: a null or empty text has the end id alone. Rows that repeat a doc_id each have their ids, in order of a
hash of the text. Rows with a null doc_id come first. An empty table makes no file. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .common import new_folder, partitions, small_batches

MAGIC = b"ORRYIDS1"
TRAILER = struct.Struct("<6q")
BLOCK = 1 << 16
#: Chunks that the library encodes in one call.
ROW = 256


def width(vocabulary: int) -> int:
    """Bits for ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` each, from the low bit of the first byte on."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    flat = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """``n`` ids as uint32, back from ``pack``."""
    if bits in (16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Encoder:
    """Ids of texts as the library gives them without special tokens added, as little-endian unsigned 32-bit integers.

    ``words`` says whether the tokenizer drops white space (and lower-cases), or keeps it byte by byte. Chunks not seen yet
    are encoded in rows, many in one call, and told apart by the bytes that their tokens stand for.
    """

    def __init__(self, path: str, words: bool = False) -> None:
        self.library, self.words = pretokens.load(path), words
        self.memory = pretokens.Memory(self._encode, words)
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix") or ""
        vocab = self.library.get_vocab(with_added_tokens=False)
        #: One more than the largest id that the tokenizer can give.
        self.vocabulary = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.sizes = np.zeros(self.vocabulary, dtype=np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token) - len(suffix) * (bool(suffix) and token.endswith(suffix))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, c: str) -> bool:
        """Whether a chunk can be encoded in a row with others: no white space at its end, no change of length."""
        return (c.isascii() or unicodedata.is_normalized("NFC", c) and len(c.lower().encode()) == len(c.encode())) if self.words else c[-1] > " "

    def _row(self, row: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and counts of chunks encoded in a row; null if the tokens can't be told apart."""
        lead = np.array([not self.words and c[0] != " " for c in row])
        text = " ".join(row) if self.words else "".join([f"\n{c}" if x else c for c, x in zip(row, lead.tolist(), strict=True)])
        ids = self._whole([text])[0]
        ends = np.cumsum(np.array([len(c.encode()) for c in row]) + lead)
        reached = np.cumsum(self.sizes[ids])
        last = np.searchsorted(reached, ends)
        if not len(reached) or reached[-1] != ends[-1] or (reached[last] != ends).any():
            return None
        begin = np.concatenate(([0], last[:-1] + 1))
        keep = np.ones(len(ids), dtype=bool)
        keep[begin[lead]] = False
        return ids[keep], last + 1 - begin - lead

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[np.ndarray] = []
        counts = np.zeros(len(chunks), dtype=np.int64)
        order: list[int] = []
        plain = [i for i, c in enumerate(chunks) if self._plain(c)]
        alone = sorted(set(range(len(chunks))).difference(plain))
        for at in range(0, len(plain), ROW):
            own = plain[at : at + ROW]
            if found := self._row([chunks[i] for i in own]):
                out.append(found[0])
                counts[own] = found[1]
                order += own
            else:
                alone += own
        for i, ids in zip(alone, self._whole([chunks[i] for i in alone]), strict=True):
            out.append(ids)
            counts[i] = len(ids)
        order += alone
        flat = np.concatenate([np.zeros(0, dtype=np.uint32), *out])
        # What was encoded out of order goes back to the order of the chunks.
        first = np.zeros(len(chunks), dtype=np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        ends = np.cumsum(counts)
        return flat[np.repeat(first - ends + counts, counts) + np.arange(len(flat))], counts

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column, in order; null counts as empty."""
        for group in pretokens.grouped(column):
            for entries, per_text, odd in self.memory.look_up(group, lambda t: self._whole([t])[0]):
                ids, ends = self.memory.ids_of(entries)
                bounds, data = (4 * ends[per_text]).tolist(), ids.astype("<u4").tobytes()
                for i in range(len(group)):
                    yield odd[i].tobytes() if i in odd else data[bounds[i] : bounds[i + 1]]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, words: bool = False) -> Encoder:
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = Encoder(path, words)
    return _ENCODERS[path, words]


#: Schemes by which Spark and pyarrow name the same store.
SAME_STORE = {"s3a": "s3", "s3n": "s3"}


def filesystem(uri: str):
    """The filesystem and path that a URI, or a plain local path, names: those that pyarrow opens (file, hdfs, s3a, gs, abfss)."""
    import pyarrow.fs

    scheme, _, rest = uri.partition("://")
    if rest:
        return pyarrow.fs.FileSystem.from_uri(f"{SAME_STORE.get(scheme, scheme)}://{rest}")
    return pyarrow.fs.FileSystem.from_uri(uri if uri.startswith("file:") else f"file://{uri}")


class Writer:
    """One file of ids; holds a block of ids and 25 bytes a document at most."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK) -> None:
        fs, path = filesystem(uri)
        self.out, self.bits, self.block = fs.open_output_stream(path), bits, block
        self.out.write(MAGIC)
        self.at, self.n, self.waiting, self.have = len(MAGIC), 0, [], 0
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n)
        self.sizes.append(len(ids))
        self.n += len(ids)
        self.waiting.append(ids)
        self.have += len(ids)
        if self.have >= self.block:
            whole = np.concatenate(self.waiting)
            full = len(whole) - len(whole) % self.block
            for i in range(0, full, self.block):
                self._write(whole[i : i + self.block])
            self.waiting, self.have = [whole[full:].copy()], len(whole) - full

    def _write(self, ids: np.ndarray) -> None:
        if int(ids.max()) >> self.bits:
            raise ValueError(f"id {int(ids.max())} has more than {self.bits} bits")
        self.offsets.append(self.at)
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.have:
            self._write(np.concatenate(self.waiting))
        null = [d is None for d in self.docs]
        footer = b"".join(np.array(x, dtype="<i8").tobytes() for x in ([*self.offsets, self.at], [d or 0 for d in self.docs], self.starts, self.sizes, null))
        self.out.write(footer + TRAILER.pack(len(self.docs), len(self.offsets), self.n, self.block, self.bits, len(footer)))
        self.out.close()


class Reader:
    """Random access to a file of ids."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n_docs, n_blocks, self.n, self.block, self.bits, length = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a file of ids: {uri}")
        footer = np.frombuffer(self.file.read_at(length, size - TRAILER.size - length), dtype="<i8")
        self.offsets = footer[: n_blocks + 1]
        self.docs, self.starts, self.sizes, self.null = footer[n_blocks + 1 :].reshape(4, n_docs)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, reading only the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            at = int(self.offsets[b] - self.offsets[first])
            parts.append(unpack(data[at : at + int(self.offsets[b + 1] - self.offsets[b])], min(self.block, self.n - b * self.block), self.bits))
        return np.concatenate(parts)[start - first * self.block :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, first id in the file and ids, in order; a run of documents of about a block is read at once."""
        i = 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + self.block)))
            ids = self.ids(int(self.starts[i]), int(self.sizes[i:j].sum()))
            for k in range(i, j):
                at = int(self.starts[k] - self.starts[i])
                yield (None if self.null[k] else int(self.docs[k])), int(self.starts[k]), ids[at : at + int(self.sizes[k])]
            i = j


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int | None = None, folder: str | None = None) -> list[tuple[str, int]]:
    """Writes the files, and returns the manifest: each file's URI and number of ids, in order. One entry a task.

    ``vocabulary`` is one more than the largest id, by default of the tokenizer and ``end_id``; a larger id raises.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "ids")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    bits, end = width(vocabulary or max(encoder(tokenizer).vocabulary, end_id + 1)), np.array([end_id], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, out, uri = encoder(tokenizer), None, f"{folder}/{uuid.uuid4().hex}.ids"
        for b in batches:
            for doc_id, data in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                out = out or Writer(uri, bits)
                out.add(doc_id, np.concatenate([np.frombuffer(data, dtype="<u4"), end]))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "uri": [uri], "n": [out.n]})

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    with small_batches(spark):
        done = ordered.mapInArrow(run, "part int, uri string, n long").collect()
    return [(r.uri, r.n) for r in sorted(done)]


def read_ids(spark: SparkSession, manifest: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files of a manifest."""
    starts = np.cumsum([0, *(n for _, n in manifest)]).tolist()
    rows = [(i, uri, starts[i]) for i, (uri, _) in enumerate(manifest)]
    files = spark.createDataFrame(rows, "i int, uri string, base long").repartitionById(max(1, len(rows)), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        for b in batches:
            for uri, base in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows = []
                for doc_id, start, ids in Reader(uri).documents():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 4096:
                        yield make(rows)
                        rows = []
                if rows:
                    yield make(rows)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
