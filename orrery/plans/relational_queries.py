"""Queries of projections, filters, joins, reductions, groupings, sorts and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, dedup, filters, join, order, projection, scan, sets
from .catalog import query, rounded, table

# Tables have no NULL, so some queries make them.


def gapped_items(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    return t.select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("n"), F.nullif("l_quantity", F.lit(10.0)).alias("q"), F.nullif("l_returnflag", F.lit("A")).alias("f"))


GAPPED = "(SELECT l_orderkey, nullif(l_linenumber, 3) AS n, nullif(l_quantity, 10.0) AS q, nullif(l_returnflag, 'A') AS f FROM lineitem)"


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(l_orderkey) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY 1, 2""")
def flagship_pricing_summary(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = filters.where_rows(t, F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    spec = {"l_quantity": ["sum", "mean"], "l_extendedprice": "sum", "l_discount": "mean", "l_orderkey": "count"}
    out = aggregate.groupby(rows, ["l_returnflag", "l_linestatus"], spec)
    out = out.select("l_returnflag", "l_linestatus", F.round("l_quantity_sum", 2).alias("sum_qty"), F.round("l_extendedprice", 2).alias("sum_price"), F.round("l_quantity_mean", 6).alias("avg_qty"), F.round("l_discount", 6).alias("avg_disc"), F.col("l_orderkey").alias("n"))
    return order.sort_values(out, ["l_returnflag", "l_linestatus"])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def select_columns(spark, sf_dir):
    return projection.select(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders")
def assign_column(spark, sf_dir):
    return projection.assign(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), {"o_totalprice": F.col("o_totalprice") * 2})


@query("SELECT o_orderkey, o_custkey % 7 AS k, o_totalprice FROM orders")
def insert_drop(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return projection.drop(projection.insert(t, 1, "k", F.col("o_custkey") % 7), ["o_custkey"])


@query("SELECT n_nationkey AS p_key_s, n_name AS p_n_name_s, n_regionkey AS p_n_regionkey_s FROM nation")
def rename_prefix_suffix(spark, sf_dir):
    t = projection.rename(table(spark, sf_dir, "nation"), {"n_nationkey": "key"})
    return projection.add_suffix(projection.add_prefix(t, "p_"), "_s")


@query("SELECT n_name AS a, n_regionkey AS b FROM nation")
def set_labels(spark, sf_dir):
    return projection.set_labels(table(spark, sf_dir, "nation", "n_name", "n_regionkey"), ["a", "b"])


@query("SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1")
def shuffle_then_group(spark, sf_dir):
    return aggregate.group_sizes(projection.shuffle(table(spark, sf_dir, "orders", "o_custkey"), ["o_custkey"]), ["o_custkey"])


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_mask(spark, sf_dir):
    return filters.where_rows(table(spark, sf_dir, "orders"), (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F"))


@query(f"SELECT * FROM {GAPPED} WHERE q > 20")
def filter_null_mask(spark, sf_dir):
    return filters.where_rows(gapped_items(spark, sf_dir), F.col("q") > 20)


@query("SELECT * FROM lineitem WHERE (l_quantity + l_discount) / 2.0 > l_tax * 100 AND NOT (l_linenumber = 2) AND l_quantity >= 5 AND l_quantity < 40")
def query_expr(spark, sf_dir):
    return filters.query(table(spark, sf_dir, "lineitem"), "(l_quantity + l_discount) / 2.0 > l_tax * 100 and not l_linenumber == 2 and 5 <= l_quantity < 40")


@query("SELECT * FROM lineitem WHERE l_quantity * l_discount > 1.5 + l_tax AND l_linenumber % 3 = 1")
def query_external_ref(spark, sf_dir):
    delta, three = 1.5, 3  # noqa: F841  the expression names them
    return filters.query(table(spark, sf_dir, "lineitem"), "l_quantity * l_discount > @delta + l_tax and l_linenumber % @three == 1")


@query(f"SELECT * FROM {GAPPED} WHERE n IS NOT NULL AND q IS NOT NULL AND (n > 4 OR q > 20)")
def query_with_null(spark, sf_dir):
    return filters.query(gapped_items(spark, sf_dir), "n > 4 or q > 20")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE -1.0 END AS o_totalprice FROM orders")
def where_other(spark, sf_dir):
    from ..functions.missing import where

    t = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return t.withColumn("o_totalprice", where(F.col("o_totalprice"), F.col("o_totalprice") > 100000, F.lit(-1.0)))


@query(f"SELECT l_orderkey, CASE WHEN coalesce(q > 20, false) THEN NULL ELSE q END AS q, n FROM {GAPPED}")
def mask_null(spark, sf_dir):
    from ..functions.missing import mask

    t = gapped_items(spark, sf_dir)
    return t.select("l_orderkey", mask(F.col("q"), F.col("q") > 20).alias("q"), "n")


@query(f"SELECT l_orderkey, n IS NULL AS n, q IS NULL AS q, f IS NULL AS f FROM {GAPPED}")
def isna_columns(spark, sf_dir):
    t = gapped_items(spark, sf_dir)
    return t.select("l_orderkey", *[F.col(c).isNull().alias(c) for c in "nqf"])


@query(f"SELECT l_orderkey IS NOT NULL AS l_orderkey, n IS NOT NULL AS n, q IS NOT NULL AS q, f IS NOT NULL AS f FROM {GAPPED}")
def notna_columns(spark, sf_dir):
    return filters.notna(gapped_items(spark, sf_dir))


@query(f"SELECT bool_or(q IS NULL) AS hasnans FROM {GAPPED}")
def has_missing(spark, sf_dir):
    return filters.has_missing(gapped_items(spark, sf_dir), "q")


@query(f"SELECT * FROM {GAPPED} WHERE n IS NOT NULL AND q IS NOT NULL AND f IS NOT NULL")
def dropna_any(spark, sf_dir):
    return filters.dropna(gapped_items(spark, sf_dir))


@query(f"SELECT * FROM {GAPPED} WHERE NOT (n IS NULL AND q IS NULL AND f IS NULL)")
def dropna_all(spark, sf_dir):
    return filters.dropna(gapped_items(spark, sf_dir), how="all", subset=["n", "q", "f"])


@query(f"SELECT * FROM {GAPPED} WHERE (n IS NOT NULL)::INT + (q IS NOT NULL)::INT + (f IS NOT NULL)::INT >= 2")
def dropna_thresh(spark, sf_dir):
    return filters.dropna(gapped_items(spark, sf_dir), thresh=2, subset=["n", "q", "f"])


@query(f"SELECT l_orderkey, coalesce(n, 0) AS n, coalesce(q, 0.0) AS q, f FROM {GAPPED}")
def fillna_scalar(spark, sf_dir):
    return filters.fillna(gapped_items(spark, sf_dir), 0)


@query(f"SELECT l_orderkey, n, coalesce(q, -1.5) AS q, coalesce(f, 'none') AS f FROM {GAPPED}")
def fillna_dict(spark, sf_dir):
    return filters.fillna(gapped_items(spark, sf_dir), {"q": -1.5, "f": "none"})


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def scatter_assign(spark, sf_dir):
    return filters.assign_where(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus"), F.col("o_orderstatus") == "P", {"o_totalprice": 0.0})


# Rows by order


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 12")
def head_n(spark, sf_dir):
    return order.head(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), ["o_orderkey"], 12)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail_n(spark, sf_dir):
    return order.tail(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), ["o_orderkey"], 7)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS __rowid FROM orders")
def row_positions(spark, sf_dir):
    return order.with_rowid(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i >= 100 AND i < n - 50")
def iloc_slice(spark, sf_dir):
    return order.iloc(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), ["o_orderkey"], 100, -50)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN (SELECT min(o_orderkey) + 20 FROM orders) AND (SELECT min(o_orderkey) + 60 FROM orders)")
def loc_slice_inclusive(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    low = t.agg(F.min("o_orderkey")).first()[0]
    return order.loc_slice(t, "o_orderkey", ["o_orderkey"], low + 20, low + 60)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 = 1")
def loc_label_prefix(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority").withColumn("k", F.col("o_custkey") % 5).drop("o_custkey")
    return order.loc_label(t, ["o_orderstatus", "k"], ("F", 1))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def drop_label(spark, sf_dir):
    return order.drop_label(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), "c_mktsegment", "BUILDING")


@query("SELECT o_orderkey, 10 + 3 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS idx FROM orders")
def range_index(spark, sf_dir):
    return order.range_index(table(spark, sf_dir, "orders", "o_orderkey"), ["o_orderkey"], 10, 3, "idx")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey) - 1 AS pos FROM orders")
def sort_multi_mixed(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return order.with_rowid(t, ["o_orderstatus", "o_totalprice", "o_orderkey"], [False, True, True], name="pos")


@query("""SELECT o_orderkey, k, row_number() OVER (ORDER BY k DESC NULLS FIRST, o_orderkey) - 1 AS pos
FROM (SELECT o_orderkey, nullif(o_custkey % 4, 2) AS k FROM orders)""")
def sort_na_first(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.nullif(F.col("o_custkey") % 4, F.lit(2)).alias("k"))
    return order.with_rowid(t, ["k", "o_orderkey"], [False, True], "first", name="pos")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey")
def sort_stable(spark, sf_dir):
    return order.sort_values(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority"), ["o_orderpriority"], False, stable_by=["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    return order.top(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), 25, ["o_totalprice", "o_orderkey"], [False, True])


# Duplicates


@query("SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")
def drop_duplicates_first(spark, sf_dir):
    return dedup.drop_duplicates(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], "first", ["o_orderkey"])


@query("SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) = 1")
def drop_duplicates_last(spark, sf_dir):
    return dedup.drop_duplicates(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], "last", ["o_orderkey"])


@query("SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders) QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderstatus) = 1")
def drop_duplicates_none(spark, sf_dir):
    return dedup.drop_duplicates(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], False)


@query(f"SELECT DISTINCT n, q, f FROM {GAPPED}")
def distinct_rows(spark, sf_dir):
    return dedup.drop_duplicates(gapped_items(spark, sf_dir).select("n", "q", "f"))


# Joins


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_inner(spark, sf_dir):
    return join.merge(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice"), table(spark, sf_dir, "customer", "c_custkey", "c_name"), left_on="o_custkey", right_on="c_custkey").drop("c_custkey")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def merge_left(spark, sf_dir):
    return join.merge(table(spark, sf_dir, "customer", "c_custkey", "c_name"), table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "left", left_on="c_custkey", right_on="o_custkey", method="hash").drop("o_custkey")


@query("""SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT o_custkey AS k, count(*) AS x FROM orders WHERE o_custkey % 3 < 2 GROUP BY 1) a
FULL JOIN (SELECT o_custkey AS k, count(*) AS y FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1) b ON a.k = b.k""")
def merge_outer_coalesced(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_custkey").withColumnRenamed("o_custkey", "k")
    return join.merge(aggregate.group_sizes(t.filter("k % 3 < 2"), ["k"], "x"), aggregate.group_sizes(t.filter("k % 3 > 0"), ["k"], "y"), "outer", on="k")


@query("""SELECT a.k, a.o_orderkey, b.n_name FROM (SELECT o_orderkey, nullif(o_custkey % 25, 3)::INT AS k FROM orders) a
JOIN (SELECT nullif(n_nationkey, 7) AS k, n_name FROM nation) b ON a.k IS NOT DISTINCT FROM b.k""")
def merge_null_keys(spark, sf_dir):
    left = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.nullif(F.col("o_custkey") % 25, F.lit(3)).cast("int").alias("k"))
    right = table(spark, sf_dir, "nation", "n_nationkey", "n_name").select(F.nullif("n_nationkey", F.lit(7)).alias("k"), "n_name")
    return join.merge(left, right, on="k")


@query("""SELECT a.o_custkey, a.o_orderstatus, a.n, b.s FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) a
JOIN (SELECT o_custkey, o_orderstatus, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY ALL) b USING (o_custkey, o_orderstatus)""")
def merge_multikey(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice")
    keys = ["o_custkey", "o_orderstatus"]
    return rounded(join.merge(aggregate.group_sizes(t, keys, "n"), aggregate.groupby(t, keys, {"o_totalprice": "sum"}).withColumnRenamed("o_totalprice", "s"), on=keys), 2)


@query("SELECT a.n_nationkey, a.n_name AS n_name_a, b.n_name AS n_name_b FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")
def merge_suffixes(spark, sf_dir):
    t = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return join.merge(t, t, on="n_nationkey", suffixes=("_a", "_b"))


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def merge_broadcast(spark, sf_dir):
    return join.merge(table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey"), table(spark, sf_dir, "nation", "n_nationkey", "n_name"), left_on="s_nationkey", right_on="n_nationkey", method="broadcast").select("s_suppkey", "s_name", "n_name")


@query("SELECT s_suppkey, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def merge_on_index(spark, sf_dir):
    return join.merge_on_labels(table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation"), ["s_nationkey"], ["n_nationkey"], "left")


@query("SELECT r_regionkey, r_name, n FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey < 3 GROUP BY 1) ON r_regionkey = n_regionkey")
def join_left_index(spark, sf_dir):
    right = aggregate.group_sizes(table(spark, sf_dir, "nation", "n_regionkey").filter("n_regionkey < 3").withColumnRenamed("n_regionkey", "r_regionkey"), ["r_regionkey"], "n")
    return join.join(table(spark, sf_dir, "region"), right, ["r_regionkey"])


@query("SELECT a.o_orderpriority, a.o_orderkey, b.n FROM orders a JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) b USING (o_orderpriority)")
def merge_string_key(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderkey")
    return join.merge(t, aggregate.group_sizes(t, ["o_orderpriority"], "n"), on="o_orderpriority", method="sort")


@query("SELECT o_orderkey, o_orderdate, n FROM orders JOIN (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderdate = l_shipdate")
def merge_datetime_key(spark, sf_dir):
    sizes = aggregate.group_sizes(table(spark, sf_dir, "lineitem", "l_shipdate"), ["l_shipdate"], "n")
    return join.merge(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), sizes, left_on="o_orderdate", right_on="l_shipdate").drop("l_shipdate")


@query("SELECT r_name, count(*) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def merge_chained(spark, sf_dir):
    t = join.merge(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), table(spark, sf_dir, "nation"), left_on="c_nationkey", right_on="n_nationkey")
    return aggregate.group_sizes(join.merge(t, table(spark, sf_dir, "region"), left_on="n_regionkey", right_on="r_regionkey"), ["r_name"])


# Reductions


@query("SELECT round(sum(o_totalprice), 2) AS s, CAST(sum(o_orderkey) AS BIGINT) AS k, round(product(1 + o_totalprice / 1e10), 9) AS p FROM orders")
def reduce_sum_prod(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").withColumn("p", 1 + F.col("o_totalprice") / 1e10)
    s, p = aggregate.reduce_columns(t, "sum", ["o_totalprice", "o_orderkey"]).toDF("s", "k"), aggregate.reduce_columns(t, "prod", ["p"])
    return s.crossJoin(p).select(F.round("s", 2).alias("s"), "k", F.round("p", 9).alias("p"))  # one row each


@query("SELECT min(o_orderdate) AS o_orderdate, min(o_orderstatus) AS o_orderstatus, min(o_totalprice) AS o_totalprice FROM orders UNION ALL SELECT max(o_orderdate), max(o_orderstatus), max(o_totalprice) FROM orders")
def reduce_min_max_string(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderdate", "o_orderstatus", "o_totalprice")
    return sets.concat_rows([aggregate.reduce_columns(t, "min"), aggregate.reduce_columns(t, "max")])


@query("SELECT round(avg(o_totalprice), 4) AS mean, round(var_samp(o_totalprice), 2) AS var, round(stddev_samp(o_totalprice), 4) AS std FROM orders")
def reduce_mean_var_std(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_totalprice")
    one = [aggregate.aggregate(o, F.col("o_totalprice"), "double", False).alias(o) for o in ("mean", "var", "std")]
    return t.agg(*one).select(F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"), F.round("std", 4).alias("std"))


@query(f"SELECT 'l_orderkey' AS label, count(l_orderkey) AS value FROM {GAPPED} UNION ALL SELECT 'n', count(n) FROM {GAPPED} UNION ALL SELECT 'q', count(q) FROM {GAPPED} UNION ALL SELECT 'f', count(f) FROM {GAPPED}")
def reduce_count(spark, sf_dir):
    return aggregate.reduce_long(gapped_items(spark, sf_dir), "count")


@query(f"SELECT bool_or(n <> 0) AS a, bool_and(q <> 0) AS b, bool_and(n <> 1) AS c FROM {GAPPED}")
def reduce_any_all(spark, sf_dir):
    t = gapped_items(spark, sf_dir)
    return t.agg(aggregate.aggregate("any", F.col("n"), "int", False).alias("a"), aggregate.aggregate("all", F.col("q"), "double", False).alias("b"), aggregate.aggregate("all", F.col("n") - 1, "int", False).alias("c"))


@query("SELECT 0.0::DOUBLE AS s, 1.0::DOUBLE AS p, false AS a, true AS b, NULL::DOUBLE AS m, 0::BIGINT AS n")
def reduce_all_null_identity(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_totalprice").select(F.when(F.col("o_totalprice") < 0, F.col("o_totalprice")).alias("x"))
    ops = {"sum": "s", "prod": "p", "any": "a", "all": "b", "mean": "m", "count": "n"}
    return t.agg(*[aggregate.aggregate(o, F.col("x"), "double", False).alias(name) for o, name in ops.items()])


# Groupings


@query(f"SELECT n, round(sum(q), 2) AS q_sum, count(q) AS q_count, count(*) AS q_size FROM {GAPPED} WHERE n IS NOT NULL GROUP BY n")
def groupby_sum_count_size(spark, sf_dir):
    return rounded(aggregate.groupby(gapped_items(spark, sf_dir), ["n"], {"q": ["sum", "count", "size"]}), 2)


@query("SELECT l_linenumber, round(avg(l_quantity), 6) AS l_quantity_mean, round(var_samp(l_quantity), 6) AS l_quantity_var, round(stddev_samp(l_quantity), 6) AS l_quantity_std FROM lineitem GROUP BY 1")
def groupby_mean_var_std(spark, sf_dir):
    return rounded(aggregate.groupby(table(spark, sf_dir, "lineitem", "l_linenumber", "l_quantity"), ["l_linenumber"], ["mean", "var", "std"]))


@query("SELECT o_custkey, min(o_orderpriority) AS o_orderpriority_min, max(o_orderpriority) AS o_orderpriority_max, min(o_orderdate) AS o_orderdate_min, max(o_orderdate) AS o_orderdate_max FROM orders GROUP BY 1")
def groupby_min_max_string(spark, sf_dir):
    return aggregate.groupby(table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderdate"), ["o_custkey"], ["min", "max"])


@query("SELECT n_regionkey, round(product(1 + n_nationkey / 10.0), 6) AS x FROM nation GROUP BY 1")
def groupby_prod(spark, sf_dir):
    t = table(spark, sf_dir, "nation", "n_regionkey", "n_nationkey").select("n_regionkey", (1 + F.col("n_nationkey") / 10.0).alias("x"))
    return rounded(aggregate.groupby(t, ["n_regionkey"], "prod"))


@query("SELECT o_orderstatus, bool_or(o_totalprice > 400000) AS big_any, bool_and(o_totalprice > 1000) AS big_all FROM orders GROUP BY 1")
def groupby_any_all(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice")
    a = aggregate.groupby(t.select("o_orderstatus", (F.col("o_totalprice") > 400000).alias("big_any")), ["o_orderstatus"], "any")
    return join.merge(a, aggregate.groupby(t.select("o_orderstatus", (F.col("o_totalprice") > 1000).alias("big_all")), ["o_orderstatus"], "all"), on="o_orderstatus")


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity_sum, max(l_quantity) AS l_quantity_max, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1")
def groupby_multiagg(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_shipdate")
    return rounded(aggregate.groupby(t, ["l_returnflag"], {"l_quantity": ["sum", "max"], "l_shipdate": "min"}), 2)


@query("SELECT l_returnflag, l_linestatus, l_linenumber, round(sum(l_tax), 4) AS l_tax FROM lineitem GROUP BY ALL")
def groupby_multikey(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber", "l_tax")
    return rounded(aggregate.groupby(t, ["l_returnflag", "l_linestatus", "l_linenumber"], "sum"), 4)


@query(f"SELECT n, f, count(*) AS size FROM {GAPPED} WHERE n IS NOT NULL AND f IS NOT NULL GROUP BY ALL")
def groupby_null_keys_dropped(spark, sf_dir):
    return aggregate.group_sizes(gapped_items(spark, sf_dir), ["n", "f"])


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1 ORDER BY 1")
def groupby_sorted(spark, sf_dir):
    return rounded(aggregate.groupby(table(spark, sf_dir, "orders", "o_custkey", "o_totalprice"), ["o_custkey"], "sum", sort=True), 2)


@query("SELECT l_shipdate, count(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1")
def groupby_datetime_key(spark, sf_dir):
    return aggregate.groupby(table(spark, sf_dir, "lineitem", "l_shipdate", "l_orderkey"), ["l_shipdate"], "count")


@query("SELECT k, sum(x) AS x FROM (SELECT o_custkey % 10 AS k, CASE WHEN o_custkey % 10 <> 4 THEN o_custkey END AS x FROM orders) GROUP BY 1".replace("sum(x)", "CAST(sum(x) AS BIGINT)"))
def groupby_all_null_group(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_custkey").select((F.col("o_custkey") % 10).alias("k"), F.when(F.col("o_custkey") % 10 != 4, F.col("o_custkey")).alias("x"))
    return aggregate.groupby(t, ["k"], "sum")


# Cumulative operators


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 4) AS value FROM events")
def cumsum(spark, sf_dir):
    return rounded(scan.cumulate(table(spark, sf_dir, "events", "event_id", "value"), ["value"], ["event_id"], "cumsum"), 4)


@query("SELECT event_id, round(product(x) OVER (ORDER BY event_id), 8) AS x FROM (SELECT event_id, 1 + value / 1e8 AS x FROM events)")
def cumprod(spark, sf_dir):
    t = table(spark, sf_dir, "events", "event_id", "value").select("event_id", (1 + F.col("value") / 1e8).alias("x"))
    return rounded(scan.cumulate(t, ["x"], ["event_id"], "cumprod"), 8)


@query("""SELECT a.event_id, CASE WHEN x IS NOT NULL THEN min(x) OVER w END AS lo, CASE WHEN x IS NOT NULL THEN max(x) OVER w END AS hi
FROM (SELECT event_id, CASE WHEN user_id % 5 <> 2 THEN value END AS x FROM events) a WINDOW w AS (ORDER BY event_id)""")
def cummin_cummax(spark, sf_dir):
    t = table(spark, sf_dir, "events", "event_id", "value", "user_id").select("event_id", F.when(F.col("user_id") % 5 != 2, F.col("value")).alias("lo")).withColumn("hi", F.col("lo"))
    return scan.cumulate(scan.cumulate(t, ["lo"], ["event_id"], "cummin"), ["hi"], ["event_id"], "cummax")


@query("""SELECT event_id, CASE WHEN count(*) FILTER (x IS NULL) OVER w = 0 THEN CAST(sum(x) OVER w AS BIGINT) END AS x
FROM (SELECT event_id, CASE WHEN event_id <> 700 THEN user_id END AS x FROM events) WINDOW w AS (ORDER BY event_id)""")
def cumsum_skipna_false(spark, sf_dir):
    t = table(spark, sf_dir, "events", "event_id", "user_id").select("event_id", F.when(F.col("event_id") != 700, F.col("user_id")).alias("x"))
    return scan.cumulate(t, ["x"], ["event_id"], "cumsum", skipna=False)


# Unions


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def concat_rows(spark, sf_dir):
    a = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return sets.concat_rows([a, table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").toDF("k", "v")])


@query("SELECT a.o_orderkey, a.o_totalprice, b.x FROM orders a JOIN (SELECT o_orderkey, o_custkey * 2 AS x FROM orders) b USING (o_orderkey)")
def concat_columns(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return sets.concat_columns([t.select("o_orderkey", "o_totalprice"), t.select("o_orderkey", (F.col("o_custkey") * 2).alias("x"))], ["o_orderkey"])


@query("SELECT n_name AS name, n_regionkey AS r, NULL::DOUBLE AS b FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def append_outer_columns(spark, sf_dir):
    return sets.append([table(spark, sf_dir, "nation", "n_name", "n_regionkey").toDF("name", "r"), table(spark, sf_dir, "supplier", "s_name", "s_acctbal").toDF("name", "b")])


@query("SELECT true AS same, false AS other")
def equals_frames(spark, sf_dir):
    t = gapped_items(spark, sf_dir)
    same = sets.equals(t, t.orderBy("l_orderkey")).toDF("same")
    return same.crossJoin(sets.equals(t, filters.fillna(t, 0)).toDF("other"))  # one row each


# A pipeline in the style of loan performance data: filtered minima by key, left joins, month buckets.


@query("""
WITH per AS (SELECT o_custkey AS id, o_orderdate AS d, o_totalprice AS v FROM orders),
s30 AS (SELECT id, min(d) AS d30 FROM per WHERE v >= 100000 GROUP BY id), s90 AS (SELECT id, min(d) AS d90 FROM per WHERE v >= 300000 GROUP BY id),
late AS (SELECT per.id, year(d) * 12 + month(d) AS m, v, d30, d90 FROM per LEFT JOIN s30 USING (id) LEFT JOIN s90 USING (id)),
b AS (SELECT id, y, CAST(floor((m - 1 - y) / 12.0) AS BIGINT) AS bucket, max(v) AS v, min(d30) AS d30, min(d90) AS d90 FROM late, range(12) t(y) GROUP BY ALL)
SELECT y AS y, bucket AS bucket, count(*) AS n, round(sum(v), 2) AS v, count(d30) AS n30, count(d90) AS n90 FROM b GROUP BY ALL""")
def delinquency_style_etl(spark, sf_dir):
    per = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice").toDF("id", "d", "v")
    first = lambda least, name: aggregate.groupby(per.filter(F.col("v") >= least).select("id", F.col("d").alias(name)), ["id"], "min")
    late = join.merge(join.merge(per, first(100000, "d30"), "left", on="id"), first(300000, "d90"), "left", on="id")
    late = late.withColumn("m", F.year("d") * 12 + F.month("d"))
    months = late.withColumn("y", F.explode(F.array(*[F.lit(y).cast("bigint") for y in range(12)]))).withColumn("bucket", F.floor((F.col("m") - 1 - F.col("y")) / 12.0))
    buckets = aggregate.groupby(months, ["id", "y", "bucket"], {"v": "max", "d30": "min", "d90": "min"})
    out = aggregate.groupby(buckets, ["y", "bucket"], {"id": "count", "v": "sum", "d30": "count", "d90": "count"})
    return rounded(out.toDF("y", "bucket", "n", "v", "n30", "n90"), 2)
