"""A corpus pipeline in five stages: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet and
reread as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, line_dedup, minhash, packing, quality
from orrery.llm.common import fresh, read_table, staged
from orrery.llm.queries import tokenizer_file

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of ``LEAST_QUALITY`` or more, by a classifier fitted on the labels of the documents at hand."""
    labels = read_table(spark, sf_dir, "labels").filter(quality.fold(F.col("doc_id")) != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    (score,) = fresh(docs, "__quality")
    return quality.score(docs, model, score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them have. ``n_chars`` follows the text."""
    out = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8.

    Rows that repeat a doc_id are one document, of which one row stays: the first in order of its columns. Rows without a
    doc_id have no group; of those that are alike in all columns one stays.
    """
    found = minhash.near_duplicates(docs, minhash.Rule(k=5, percent=80))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(found.filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*columns)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    again = staged(again, "repeated")
    is_repeated = kept["doc_id"].eqNullSafe(again["doc_id"])
    repeated = kept.join(again, is_repeated, "left_semi")
    rows = repeated.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return kept.join(again, is_repeated, "left_anti").unionByName(rows).unionByName(repeated.filter(F.col("doc_id").isNull()).distinct())


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, within a tenth of its length in edits."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"), rate=0.1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes padded sequences of 2048 ids, and gives the pieces read back from them."""
    return packing.read_pieces(packing.sequences(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, length=2048))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_distinct),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The classifier, signatures, alignment and tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
