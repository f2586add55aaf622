"""Line dedup: drops lines whose normalised form occurs in many documents, with DataFrame operations only.

Lines are exploded with their positions, normalised and hashed to 128 bits; distinct documents are counted by hash;
lines of hashes over the threshold go, and the others are joined again by position. Texts are read twice but only
shuffled once, when each meets the positions it loses; in between only hashes, ids and positions move. Distinct documents
are counted by line and document first. Lines meet the table of common ones by a broadcast if it is small, and otherwise
salted by document, so a line that most documents have is no single task's.

Defined results: a null or empty text is one empty line. A document is a doc_id: rows that repeat one count once, and all
rows with a null doc_id together count as one document. Each row keeps its own result, repeated rows alike. An empty
table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, fresh, joined, staged


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _kept_lines(lines: Column, lost: Column) -> Column:
    """Lines at all positions but those in the sorted array ``lost``, cut as the runs between them: linear in both."""
    ends = F.concat(lost, F.array(F.size(lines)))
    runs = F.transform(ends, lambda end, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.element_at(lost, F.greatest(i, F.lit(1))) + 1).alias("start"), end.alias("end")))
    return F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["end"] - r["start"])))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` made of the lines kept, and __n_lines, __n_dropped.

    A line goes when its key has at least ``min_chars`` code points and occurs in at least ``min_docs`` documents.
    """
    docs = docs.drop("__n_lines", "__n_dropped")
    lines = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(F.lit(3), "text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    hashed = staged(keyed.select("doc", "row", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")), "lines")
    found = F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("int"))
    common = staged(hashed.groupBy("h1", "h2").agg(found.alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2"), "common")
    hits = joined(hashed, common, ["h1", "h2"], "inner", F.struct("doc", "row"))
    doc, row, at, lost, kept = fresh(docs, "__doc", "__row", "__at", "__lost", "__kept")
    lose = hits.groupBy(F.col("doc").alias(doc), F.col("row").alias(row)).agg(F.sort_array(F.collect_set("pos")).alias(lost))
    own = docs.withColumn(at, F.xxhash64(F.lit(3), "text"))
    met = own.join(lose, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(at) == F.col(row)), "left").drop(doc, row, at)
    split = lines_of(F.col("text"))
    text = F.when(F.col(lost).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_kept_lines(split, F.col(lost)), "\n"))
    out = met.withColumns({"__n_lines": F.size(split).cast("long"), "__n_dropped": F.coalesce(F.size(lost), F.lit(0)).cast("long"), kept: text})
    return out.withColumn("text", F.col(kept)).drop(kept, lost)
