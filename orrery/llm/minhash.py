"""MinHash near-dedup: banded candidates, sequential Bayesian verification of signatures, exact verification of survivors.

1. A pass over the texts gives each shingle set's digest and signature. Equal sets are one class, stood for by its smallest
   doc_id; from here on copies cost nothing.
2. Classes that agree in all rows of a band share a bucket. In each bucket everyone is compared with the smallest, which is
   linear in the bucket's size. Signatures are compared batch by batch; a pair goes as soon as the posterior probability
   (uniform prior) of a similarity at the threshold or above falls under ``miss``; the others are verified on whole sets.
3. What is left are pairs of one bucket that no links join so far. Each bucket's members but its smallest are split into
   the largest group already joined and the rest. Buckets with the same largest group are put together; there the rest is
   compared with all others, in blocks of bounded size that numpy compares as arrays. A group joined already is never
   compared within itself, and only found links leave a task.
   Where the rest is over ``DENSE``, as when boilerplate puts many different texts in one bucket, the group is split first
   by prefix filtering: a linked pair shares one of the rarest shingles of either, so members meet only under shingles that
   are among their own rarest and that another member has. What they share with all costs nothing then, and only members
   whose similarity comes near to the threshold still meet in numbers.
4. Links give components; a document's is its class's.

With 32 bands of 4 rows a pair at a similarity of 0.85 shares no bucket with a probability of 5e-11 (0.8: 5e-8), and
``miss`` adds at most its own; every link reported is of whole sets of 64-bit shingle hashes.

Defined results: a text that is null, empty or blank has no shingles, is linked with nothing and is kept. Rows that repeat
a doc_id are one document, linked to all that any of its texts is linked to. Rows with a null doc_id take no part: their
component is null and they are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, small_batches, staged
from .components import components
from .shingles import mix, shingle_sets

#: Members of a block; two blocks are compared in one task.
BLOCK = 256
#: A group whose members not joined are more than so many is split by prefix filtering. In blocks each of n members comes
#: n / BLOCK times, by prefixes once for each rare shingle that it shares, so a few thousand members are cheaper in blocks.
DENSE = 8192
#: Signatures are compared in batches of so many rows.
BATCH = 16
#: Values of sets that are compared at a time with one set; a longer set is compared alone.
VALUES = 1 << 18


@dataclass(frozen=True)
class Rule:
    """Sets of ``k`` words are linked when 100 * intersection >= ``percent`` * union."""

    k: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    miss: float = 1e-9

    @property
    def n(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[int]:
        """For 0, BATCH, 2 * BATCH, ... rows compared: the fewest matches that a pair may go on with.

        After m matches of n the posterior under a uniform prior is Beta(m + 1, n - m + 1), and its mass above t is the
        probability of at most m successes in n + 1 trials at t.
        """
        t, out = self.percent / 100, [0]
        for n in range(BATCH, self.n + 1, BATCH):
            mass, m = 0.0, -1
            while mass < self.miss:
                m += 1
                mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append(m)
        return out

    def linked(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (a + b - both)


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed the smallest hash over the set, cut to 16 bits; equal minima stay equal."""
    low = np.full(len(seeds), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1024):
            low = np.minimum(low, ((shingles[None, i : i + 1024] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
        return (mix(low) >> np.uint64(48)).astype("<u2")


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(31).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (the set's digest), sig; null digests and signature without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, known = _seeds(rule.n), {}
        for b in batches:
            n, h1, h2, sigs = [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), rule.k):
                n.append(len(s))
                if not len(s):
                    h1.append(None), h2.append(None), sigs.append(None)
                    continue
                with np.errstate(over="ignore"):
                    digest = int(mix(s + np.uint64(1)).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                if digest not in known:
                    if len(known) >= 10_000:
                        known.clear()
                    known[digest] = signature(s, seeds).tobytes()
                h1.append(digest[0] - 2**63), h2.append(digest[1] - 2**63), sigs.append(known[digest])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _bands(rule: Rule, reps: DataFrame, *more: str) -> DataFrame:
    width = 2 * rule.rows
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(rule.bands)])
    return reps.select("rep", *more, F.explode(keys).alias("bucket"))


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first ``n_keys`` columns, of batches sorted by these."""
    key, rows = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield rows
                key, rows = row[:n_keys], []
            rows.append(row)
    if rows:
        yield rows


def _against_head(pairs: DataFrame, loads: DataFrame, check: Callable[[object, list], list[bool]], prepare: Callable[[list], list]) -> DataFrame:
    """The pairs (a, b) that ``check`` passes, given what ``prepare`` makes of their ``load`` in ``loads`` (rep, load).

    The pairs of one ``a`` are dealt over 64 salts, and its load travels once for each salt in use.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int").alias("salt"))
    heads = salted.select("a", "salt").distinct().join(loads.withColumnRenamed("rep", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "load")
    tails = salted.join(loads.withColumnRenamed("rep", "b"), "b").select("a", "salt", "b", "load")
    dealt = heads.unionByName(tails).repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def some(a: int, heads: list, members: list[tuple]) -> list[tuple[int, int]]:
        if not heads or not members:
            return []
        made = prepare([m[3] for m in members])
        found: set[int] = set()
        for h in prepare(heads):
            found.update(m[2] for m, yes in zip(members, check(h, made), strict=True) if yes)
        return [(a, b) for b in sorted(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads, members, out = None, [], [], []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:2] != key or len(members) >= BLOCK:
                    if key is not None:
                        out += some(key[0], heads, members)
                    heads, members = (heads if row[:2] == key else []), []
                    key = row[:2]
                if row[2] is None:
                    heads.append(row[3])
                else:
                    members.append(row)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
                out = []
        if key is not None:
            out += some(key[0], heads, members)
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return dealt.select("a", "salt", "b", "load").mapInArrow(run, "a long, b long")


def _signature_check(rule: Rule) -> tuple[Callable, Callable]:
    least = rule.least_matches()

    def check(head: np.ndarray, members: list[np.ndarray]) -> list[bool]:
        _, live = _pairs_live(head[None, :], np.stack(members), np.zeros(len(members), dtype=np.int64), np.arange(len(members)), least)
        return np.isin(np.arange(len(members)), live).tolist()

    return check, lambda loads: [np.frombuffer(x, dtype="<u2") for x in loads]


def _exact_check(rule: Rule) -> tuple[Callable, Callable]:
    def check(head: np.ndarray, members: list[np.ndarray]) -> list[bool]:
        sizes = np.array([len(m) for m in members])
        shared = _shared(head, members)
        return rule.linked(shared, len(head), sizes).tolist()

    return check, lambda loads: list(shingle_sets(loads, rule.k))


def _shared(head: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of ``head`` with each of ``sets``, which are laid side by side up to ``VALUES`` at a time."""
    out, first = [], 0
    while first < len(sets):
        n, last = len(sets[first]), first + 1
        while last < len(sets) and n + len(sets[last]) <= VALUES:
            n, last = n + len(sets[last]), last + 1
        flat, ends = np.concatenate(sets[first:last]), np.cumsum([len(s) for s in sets[first:last]])
        at = np.minimum(np.searchsorted(head, flat), max(0, len(head) - 1))
        hit = np.concatenate(([0], np.cumsum(head[at] == flat))) if len(head) else np.zeros(len(flat) + 1, dtype=np.int64)
        out.append(np.diff(hit[ends], prepend=0))
        first = last
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _block_links(rows: list[tuple], rule: Rule, least: list[int]) -> list[tuple[int, int]]:
    """Links between two blocks of members, or within one: a spanning set, given the groups joined already.

    A row is (group, i, j, side, rep, label, sig, text). Side 0 and 1 are the blocks i and j; with i == j all are on side 0.
    """
    left = [r for r in rows if r[3] == 0]
    right = [r for r in rows if r[3] == 1] or left
    if not left:
        return []
    one = right is left
    a, b = (np.stack([np.frombuffer(r[6], dtype="<u2") for r in side]) for side in (left, right))
    labels_a, labels_b = (np.array([r[5] for r in side]) for side in (left, right))
    live = labels_a[:, None] != labels_b[None, :]
    if one:
        live &= np.tri(len(left), k=-1, dtype=bool)
    rows_, cols = np.nonzero(live)
    pairs = _pairs_live(a, b, rows_, cols, least)
    if not len(pairs[0]):
        return []
    need = sorted({*pairs[0].tolist()}), sorted({*pairs[1].tolist()})
    sets_a = dict(zip(need[0], shingle_sets([left[i][7] for i in need[0]], rule.k), strict=True))
    sets_b = dict(zip(need[1], shingle_sets([right[i][7] for i in need[1]], rule.k), strict=True))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    order = np.argsort(pairs[0], kind="stable")
    i_all, j_all = pairs[0][order], pairs[1][order]
    cuts = np.flatnonzero(np.diff(i_all)) + 1
    for i_run, j_run in zip(np.split(i_all, cuts), np.split(j_all, cuts), strict=True):
        i = int(i_run[0])
        la = int(labels_a[i])
        todo = [j for j in j_run.tolist() if find(int(labels_b[j])) != find(la)]
        if not todo:
            continue
        sizes = np.array([len(sets_b[j]) for j in todo])
        yes = rule.linked(_shared(sets_a[i], [sets_b[j] for j in todo]), len(sets_a[i]), sizes)
        for j in np.array(todo)[yes].tolist():
            x, y = find(la), find(int(labels_b[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((left[i][4], right[j][4]))
    return out


def _pairs_live(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    matches = np.zeros(len(rows), dtype=np.int16)
    for i, low in enumerate(least[1:]):
        if not len(rows):
            break
        at = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (a[rows, at] == b[cols, at]).sum(axis=1, dtype=np.int16)
        keep = matches >= low
        rows, cols, matches = rows[keep], cols[keep], matches[keep]
    return rows, cols


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``. Runs its steps when called."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, rule)


def _near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    sigs = staged(_signatures(docs, rule), "signatures")
    known = sigs.filter("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    reps = staged(classes.select("h1", "h2", "rep", "sig"), "classes")
    bands = _bands(rule, reps)
    buckets = bands.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count("rep").alias("n")).filter("a <> z")
    shared = staged(bands.join(buckets.select("bucket", "a", "n"), "bucket").select("bucket", "a", "n", "rep"), "buckets")
    wanted = shared.select("rep").distinct()
    texts = staged(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep", "left_semi").distinct(), "texts")
    loads = reps.select("rep", F.col("sig").alias("load")).join(wanted, "rep", "left_semi")
    pairs = shared.filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    # Pairs are few beside the texts, so they are brought together first: else every task writes a file of next to nothing.
    likely = staged(_against_head(pairs, loads, *_signature_check(rule)).hint("rebalance"), "likely")
    links = staged(_against_head(likely, texts.withColumnRenamed("text", "load"), *_exact_check(rule)).hint("rebalance"), "star")
    more = staged(_rest_links(shared, reps, texts, links, rule).hint("rebalance"), "rest")
    edges = links.union(more).toDF("u", "v")
    # A repeated doc_id joins all classes that it is in.
    again = known.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("n")).filter("n > 1").select("doc_id")
    if not again.isEmpty():
        tied = known.join(again, "doc_id", "left_semi").join(reps.select("h1", "h2", "rep"), ["h1", "h2"])
        edges = edges.union(tied.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    found = components(edges)
    classed = sigs.select("doc_id", "n_shingles", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"], "left")
    out = classed.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    for df in (shared, texts, likely):
        discard(df)
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def _rest_links(shared: DataFrame, reps: DataFrame, texts: DataFrame, links: DataFrame, rule: Rule) -> DataFrame:
    """Step 3: links between members of a bucket, its smallest aside, that ``links`` don't join yet."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # Twice the smallest neighbour: who has the same label is joined by links.
    labels = low.join(low.select(F.col("u").alias("m"), F.col("m").alias("mm")), "m", "left").select(F.col("u").alias("rep"), F.coalesce("mm", "m").alias("label"))
    members = shared.filter("n > 2 and rep <> a").join(labels, "rep", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))
    by_label = members.groupBy("bucket", "label").agg(F.count("rep").alias("c"))
    # Written, so that the join below reads two plain shuffles and Spark can split a hot bucket.
    split = staged(by_label.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all")).filter("top.c < all").select("bucket", F.col("top.label").alias("main")), "split")
    # Buckets whose largest group is the same are handled as one: copies share many buckets, and so meet once.
    met = staged(members.join(split, "bucket").select("main", "rep", "label").distinct(), "met")
    return _compared(staged(_groups(met, texts, rule), "groups"), reps, texts, rule)


def _groups(met: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """group, rep, label, main: groups in which all pairs of different labels are to be compared, from main, rep, label."""
    rest = F.col("label") != F.col("main")
    size = met.groupBy("main").agg(F.sum(rest.cast("int")).alias("n")).filter(F.col("n") > DENSE).select("main")
    plain = met.join(size, "main", "left_anti").select(F.col("main").alias("group"), "rep", "label", "main")
    dense = met.join(size, "main", "left_semi")
    if size.isEmpty():
        return plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.astype(np.int64) for s in shingle_sets(b.column(1).to_pylist(), rule.k)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *sets])))], ["rep", "tokens"])

    own = texts.join(dense.select("rep").distinct(), "rep", "left_semi").select("rep", "text")
    # A repeated doc_id can have several sets.
    sets = staged(own.mapInArrow(run, "rep long, tokens array<long>").withColumn("which", F.xxhash64("tokens")), "tokens")
    tokens = dense.join(sets, "rep").select("main", "rep", "label", "which", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    counted = tokens.groupBy("main", "token").agg(F.count("rep").alias("df"))
    # Sets linked at a share of t have ceil(t * size) shingles in common at least, so one of the rest and one more is common.
    prefix = (F.col("size") - F.ceil(F.col("size") * rule.percent / 100 - 1e-9) + 1).cast("int")
    rarest = tokens.join(counted, ["main", "token"]).groupBy("main", "rep", "label", "which", "size").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("sorted"))
    posts = rarest.select("main", "rep", "label", F.explode(F.slice("sorted", F.lit(1), prefix)).alias("x")).filter("x.df > 1")
    return plain.union(posts.select(F.xxhash64("main", "x.token").alias("group"), "rep", "label", "main"))


def _compared(groups: DataFrame, reps: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links between members of a group whose labels differ."""
    blocks = lambda c: F.greatest(F.ceil(F.sum(c.cast("int")) / BLOCK), F.lit(1)).cast("int")
    rest = F.col("label") != F.col("main")
    sized = groups.groupBy("group").agg(blocks(~rest).alias("n_main"), blocks(rest).alias("n_rest"), F.count_distinct("label").alias("n")).filter("n > 1").drop("n")
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    # Blocks of the rest are 0 to n_rest - 1, those of the largest group follow.
    at = F.when(rest, own(F.col("n_rest"))).otherwise(own(F.col("n_main")) + F.col("n_rest"))
    others = F.sequence(F.lit(0), F.when(rest, F.col("n_rest") + F.col("n_main")).otherwise(F.col("n_rest")) - 1)
    sent = groups.join(sized, "group").withColumn("at", at).select("group", "rep", "label", "at", F.explode(others).alias("to"))
    dealt = sent.select("group", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), F.when(F.col("at") <= F.col("to"), 0).otherwise(1).alias("side"), "rep", "label")
    loaded = dealt.join(reps.select("rep", "sig"), "rep").join(texts, "rep").select("group", "i", "j", "side", "rep", "label", "sig", "text")
    ready = loaded.repartition(partitions(groups.sparkSession), "group", "i", "j").sortWithinPartitions("group", "i", "j")
    least = rule.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 3):
            if out := _block_links(rows, rule, least):
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return ready.mapInArrow(run, "a long, b long")
