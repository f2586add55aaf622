"""Quality classifier: kernel ridge regression on document statistics by random Fourier features, calibrated by isotonic regression.

A document becomes a vector of statistics of its bytes, words and lines. Cosines of random projections of the standardised
vector approximate a Gaussian kernel. Each partition sums its part of the normal equations, a few tasks add the parts up,
and the driver solves one small system. Part of the labelled rows is held back from the fit and calibrates the raw scores:
pool-adjacent-violators, then straight lines between the blocks' centres, so that ranks within a block stay.

The fit uses at most about ``max_labels`` labelled documents and as many rows of theirs, drawn by hashes of doc_id and text.
Sums run over rows in the order of these hashes, so the scores don't depend on the order of rows. Scoring is one pass
without a shuffle.

Defined results: a null or empty text has all-zero statistics and is scored as such. Labels that are null or neither 0 nor
1 don't count; a document with several labels counts once for each; labels without a document don't count. Rows that
repeat a doc_id and its text are learnt from once, those of other texts under that id too. Equal raw scores are calibrated
together. With labels of one class or none, every score is the smoothed share of label 1. Rows with a null doc_id are
scored, never learnt from and not held out. Repeated rows get the same score. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, staged

N_STATS = 24
#: Tasks that add up the partitions' parts of the normal equations; the driver gets one matrix from each.
ADDERS = 8


def _classes() -> np.ndarray:
    """256 x 9: which bytes count for which share."""
    b = np.arange(256)
    ch = np.array([chr(i) for i in range(128)] + ["\x80"] * 128)
    among = lambda s: np.isin(ch, list(s))
    return np.stack(
        [
            (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57), b >= 128, among(" \t\n\r\x0b\x0c"),
            among(".,;:"), among("!?"), among("#$%&*+=<>@\\^_`|~/{}[]"), among("\"'()-"),
        ],
        axis=1,
    ).astype(np.float64)


_CLASSES = _classes()


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, all of it."""
    data = (text or "").encode()
    if not data:
        return [0.0] * N_STATS
    hist = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    shares = (hist @ _CLASSES / len(data)).tolist()
    p = hist[hist > 0] / len(data)
    words = data.split()
    n = max(1, len(words))
    lines = data.split(b"\n")
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))  # noqa: B905
    upper = sum(1 for w in words if not w.islower() and w.isupper())
    size = np.log1p(len(data))
    return [
        *shares, size, np.log1p(len(words)), len(data) / n, distinct / n, np.log1p(distinct), pairs / n, upper / n,
        len(lines) / n, len(set(lines)) / len(lines), np.log1p(max(map(len, words), default=0)), float(-(p * np.log(p)).sum()),
        sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128) / n, sum(1 for w in words if w[0] < 128 and not w[:1].isalnum()) / n,
        np.log1p(max(map(len, lines))), sum(1 for w in words if len(w) == 1) / n,
    ]


@dataclass(frozen=True)
class Model:
    """What scores a document; small, and sent along with the tasks."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  # calibration: raw scores, rising
    calibrated: np.ndarray

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.calibrated[0])
        return np.interp(features(self, stats) @ self.weights, self.raw, self.calibrated)


def features(m: Model, stats: np.ndarray) -> np.ndarray:
    """Random Fourier features, a constant and the standardised statistics themselves."""
    z = np.clip((stats - m.mean) / m.scale, -6, 6)
    return np.concatenate([np.sqrt(2 / len(m.phase)) * np.cos(z @ m.projection + m.phase), z / np.sqrt(z.shape[1]), np.ones((len(z), 1))], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centres and levels of the blocks of the rising step function nearest to (x, y). Equal x are one point, so centres rise strictly."""
    weight = np.ones(len(x)) if weight is None else weight
    points, which = np.unique(x, return_inverse=True)
    n = np.bincount(which, weights=weight)
    blocks: list[list[float]] = []  # sum of y, sum of x, n
    for a, b, c in zip(points.tolist(), np.bincount(which, weights=weight * y).tolist(), n.tolist(), strict=True):
        blocks.append([b, a * c, c])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            s, t, n_last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += t
            blocks[-1][2] += n_last
    return np.array([t / n for _, t, n in blocks]), np.array([s / n for s, _, n in blocks])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _stats_frame(docs: DataFrame, keep: str, kinds: str) -> DataFrame:
    """The columns ``keep`` (SQL types in ``kinds``) after text, and the statistics of text as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            stats = pa.array([statistics(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], stats], [*b.schema.names[1:], "stats"])

    return docs.select("text", *keep.split()).mapInArrow(run, f"{kinds}, stats array<double>")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    column = b.column(b.schema.get_field_index("stats"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def _learnt(docs: DataFrame, labels: DataFrame, max_labels: int, seed: int) -> DataFrame:
    """key, n and good (its labels, and those of 1), held and stats of the rows that are learnt from, staged in order of key."""
    valid = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.count("label").cast("double").alias("__n"), F.sum("label").cast("double").alias("__good"))
    n_labels = valid.count()
    if n_labels > max_labels:
        valid = valid.filter(F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(1_000_000)) < int(950_000 * max_labels / n_labels))
    # At most about max_labels rows of 24 bytes, one for each id: that bounds the broadcast.
    met = docs.select("doc_id", "text").join(F.broadcast(valid), F.col("doc_id") == F.col("__id"))
    held = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(4)) == 0
    own = met.select("text", F.xxhash64(F.lit(seed + 2), "doc_id", "text").alias("key"), F.col("__n").alias("n"), F.col("__good").alias("good"), held.alias("held"))
    made = _stats_frame(own, "key n good held", "key long, n double, good double, held boolean")
    # Copies of a row are one: a row's statistics follow from its key.
    rows = made.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "good", "held", "stats")])
    table = staged(rows.repartition(ADDERS, "key").sortWithinPartitions("key"), "statistics")
    if (n_rows := table.count()) > max_labels:
        fewer = table.filter(F.pmod(F.xxhash64(F.lit(seed + 3), "key"), F.lit(1_000_000)) < int(950_000 * max_labels / n_rows))
        small = staged(fewer.repartition(ADDERS, "key").sortWithinPartitions("key"), "statistics")
        discard(table)
        return small
    return table


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 40_000, n_features: int = 256, gamma: float = 0.05, ridge: float = 1e-3, seed: int = 7) -> Model:
    """``labels`` has doc_id and label; all of its rows may be learnt from. A quarter, by hash, calibrates."""
    table = _learnt(docs, labels, max_labels, seed)
    fitted = table.filter("not held")
    zero = np.zeros(0)
    flat = lambda p: Model(zero, zero, zero, zero, zero, np.array([0.0]), np.array([p]))
    kept = ~F.col("held")
    one = table.agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum(F.when(kept, F.col("n"))).alias("own_n"), F.sum(F.when(kept, F.col("good"))).alias("own_good"),
        *(f(F.when(kept, F.col("stats")[i])) for i in range(N_STATS) for f in (F.mean, F.stddev_pop)),
    ).first()
    n, good = one.n or 0.0, one.good or 0.0
    if not 0 < (one.own_good or 0) < (one.own_n or 0):
        discard(table)
        return flat((good + 1) / (n + 2))
    mean, scale = np.array(one[4::2], dtype=float), np.array(one[5::2], dtype=float)
    rng = np.random.default_rng(seed)
    # The kernel's width goes with the number of statistics, so gamma is for one of variance 1.
    m = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, np.sqrt(2 * gamma), (N_STATS, n_features)), rng.uniform(0, 2 * np.pi, n_features), zero, zero, zero)
    d = n_features + N_STATS + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for b in batches:
            if b.num_rows:
                x, w, y = features(m, _matrix(b)), b.column(0).to_numpy(), b.column(1).to_numpy()
                total += x.T @ np.concatenate([w[:, None] * x, y[:, None]], axis=1)
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    parts = fitted.select("n", "good", "stats").coalesce(ADDERS).mapInArrow(sums, "part binary").collect()
    total = np.sum([np.frombuffer(p.part).reshape(d, d + 1) for p in parts], axis=0)
    weights = solve(total[:, :d] + ridge * n * np.eye(d) / 10, total[:, d])
    m = Model(m.mean, m.scale, m.projection, m.phase, weights, zero, zero)
    held = table.filter("held").select("n", "good", "stats").toArrow()  # a quarter of max_labels rows
    w, y = (held[c].to_numpy() for c in ("n", "good"))
    if 0 < y.sum() < w.sum():
        x = np.asarray(held["stats"].combine_chunks().flatten()).reshape(-1, N_STATS)
        raw, level = isotonic(features(m, x) @ weights, y / w, w)
    else:
        raw, level = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    discard(table)
    # The outermost levels are reached only beyond the outermost blocks, so ranks go on there.
    wide = max(1.0, float(raw[-1] - raw[0]))
    return Model(m.mean, m.scale, m.projection, m.phase, weights, np.concatenate([[raw[0] - wide], raw, [raw[-1] + wide]]), np.concatenate([[level[0] / 2], level, [(1 + level[-1]) / 2]]))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with a x = b for a symmetric positive definite ``a``, by conjugate gradients, scaled by the diagonal.

    Only products of the matrix with a vector, elementwise: a linear algebra library's own threads would wait for cores
    that Spark's tasks hold.
    """
    scale = 1 / np.sqrt(np.diag(a))
    a, b = a * scale * scale[:, None], b * scale
    x, r = np.zeros(len(b)), b.copy()
    p, now = r.copy(), float((r * r).sum())
    end = 1e-28 * now
    for _ in range(20 * len(b)):
        if now <= end:
            break
        q = np.einsum("ij,j->i", a, p)
        step = now / float((p * q).sum())
        x += step * p
        r -= step * q
        before, now = now, float((r * r).sum())
        p = r + now / before * p
    return x * scale


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of ``text`` in the column ``name``, which replaces one of that name."""
    rest = [c for c in docs.columns if c != name]
    at = rest.index("text")
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            stats = np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(stats), pa.float64())], [*b.schema.names, name])

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)
