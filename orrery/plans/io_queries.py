"""Round trips through files. Files go to the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from .. import frame as of
from ..sources import csv, parquet
from .catalog import query, table


def folder(spark) -> str:
    """A new folder in ``spark.checkpoint.dir``; on a local master without that setting, in the machine's own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="orrery-io-")
    return f"{base.rstrip('/')}/orrery/io-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_roundtrip(spark, sf_dir):
    t, at = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_retailprice"), folder(spark)
    csv.to_csv(t, at, sep="|", partition=True)
    return csv.read_table(spark, at, sep="|", dtype={"p_partkey": "int64", "p_name": "string", "p_size": "int32", "p_retailprice": "float64"})


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey > 1 END AS flag, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS name FROM nation")
def csv_custom_na_bool(spark, sf_dir):
    t, at = table(spark, sf_dir, "nation"), folder(spark)
    flag = F.when(F.col("n_regionkey") == 2, "missing").when(F.col("n_regionkey") > 1, "yes").otherwise("no")
    csv.to_csv(t.select("n_nationkey", flag.alias("flag"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("name")), at, na_rep="missing")
    return csv.read_csv(spark, at, dtype={"n_nationkey": "int32", "flag": "bool", "name": "str"}, true_values=["yes"], false_values=["no"], na_values=["missing"])


@query("SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS d, date_trunc('month', o_orderdate)::TIMESTAMP AS m FROM orders")
def csv_dates(spark, sf_dir):
    t, at = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), folder(spark)
    csv.to_csv(t.select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("d"), F.date_format("o_orderdate", "MM/yyyy").alias("m")), at, header=False, partition=True)
    return csv.read_csv(spark, at, names=["o_orderkey", "d", "m"], dtype={"o_orderkey": "int64", "d": "string", "m": "string"}, parse_dates=["d", 2])


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def csv_nrows(spark, sf_dir):
    t, at = table(spark, sf_dir, "nation", "n_nationkey", "n_name").orderBy("n_nationkey"), folder(spark)
    csv.to_csv(t, at, header=False)
    return csv.read_csv(spark, at, names=["n_nationkey", "n_name"], dtype={"n_nationkey": "int32", "n_name": "string"}, nrows=5)


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def parquet_roundtrip_projection(spark, sf_dir):
    at = folder(spark)
    parquet.to_parquet(table(spark, sf_dir, "supplier"), at)
    return parquet.read_parquet(spark, at, columns=["s_suppkey", "s_acctbal"])


@query("SELECT n_name, n_nationkey FROM nation")
def parquet_labels_roundtrip(spark, sf_dir):
    """Labels are found again beside the columns asked for."""
    at = folder(spark)
    of.from_spark(table(spark, sf_dir, "nation", "n_name", "n_nationkey", "n_regionkey")).set_index("n_name").to_parquet(at)
    return of.read_parquet(at, columns=["n_nationkey"]).to_spark()


@query("SELECT p_size, p_partkey FROM part")
def csv_usecols_gzip(spark, sf_dir):
    """Two columns of a compressed file, by name and by place."""
    at = folder(spark)
    csv.to_csv(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size"), at, partition=True, compression="gzip")
    return csv.read_csv(spark, at, usecols=["p_partkey", "p_size"]).select("p_size", "p_partkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey > (SELECT min(s_suppkey) + 2 FROM supplier) AND s_suppkey < (SELECT max(s_suppkey) FROM supplier)")
def csv_skiprows_skipfooter(spark, sf_dir):
    t, at = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").orderBy("s_suppkey"), folder(spark)
    csv.to_csv(t, at, header=False)
    return csv.read_csv(spark, at, names=["s_suppkey", "s_name"], dtype={"s_suppkey": "int64", "s_name": "string"}, skiprows=3, skipfooter=1)


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def csv_index_col(spark, sf_dir):
    at = folder(spark)
    csv.to_csv(table(spark, sf_dir, "customer", "c_nationkey", "c_custkey", "c_acctbal"), at, partition=True)
    return of.read_csv(at, index_col="c_custkey").to_spark()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def interchange_roundtrip(spark, sf_dir):
    columns = of.from_spark(table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey"))
    return of.from_interchange(columns).to_spark().select("n_nationkey", "n_name", "n_regionkey")
