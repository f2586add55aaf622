"""The registered queries: SQL where there is some, and the pipeline stage by stage."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import bench
import corpus_pipeline
from orrery.llm import decontaminate, queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(repr, map(tuple, df.select(*names).collect()))) == Counter(map(repr, cur.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = stage(spark, docs, small)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == columns and out.dtypes == docs.dtypes
        rows = out.collect()
        after = spark.createDataFrame(rows, docs.schema)
        assert len(rows) <= before and (name != "line_dedup" or len(rows) == before)
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "decontamination":
            bench = spark.read.parquet(f"{small}/benchmark.parquet")
            assert decontaminate.find_leaks(after, bench).count() == 0 and len(rows) == before - decontaminate.find_leaks(docs, bench).select("doc_id").distinct().count()
        docs = after


def test_one_row_of_a_group_stays(spark, small):
    """Repeated ids, repeated rows and rows without an id, with a column of a clashing name."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20).withColumn("__quality", F.lit("own"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    one = docs.limit(3)
    nameless = docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))
    more = docs.unionByName(one).unionByName(one.withColumn("text", F.lit("another text of this id, long enough for shingles"))).unionByName(nameless).unionByName(nameless)
    want = {r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, small).collect()}
    got = corpus_pipeline.keep_distinct(spark, more, small)
    rows = [r.doc_id for r in got.collect()]
    assert got.columns == docs.columns and rows.count(None) == 2 and len(rows) == len(set(rows)) + 1 and set(rows) - {None} <= want
    assert corpus_pipeline.keep_quality(spark, docs, small).columns == docs.columns


def test_stages_take_no_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_bench_times_every_query():
    assert sorted(bench.LLM) == sorted([*queries.queries(), "pipeline"])
