"""Queries by the frame interface: labels, positions, alignment, label merges, group labels."""

from __future__ import annotations

from .. import frame as of
from .catalog import query, rounded, table


def orders(spark, sf_dir, *more, index=(), ordered=True):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", *more)
    return of.from_spark(t, list(index), ["o_orderkey"] if ordered else [])


def parts(spark, sf_dir, index=()):
    t = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    return of.from_spark(t, list(index))


@query("SELECT o_orderkey, o_orderstatus, o_custkey, o_totalprice FROM orders")
def set_reset_index(spark, sf_dir):
    return orders(spark, sf_dir, "o_orderstatus", ordered=False).set_index(["o_orderkey", "o_orderstatus"]).reset_index().to_spark()


@query("SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS o_orderkey, o_custkey, o_totalprice FROM orders")
def reset_index_level(spark, sf_dir):
    """One level becomes a column, the other goes; the labels are positions then."""
    f = orders(spark, sf_dir, "o_orderstatus").set_index(["o_orderstatus", "o_orderkey"]).reset_index(level="o_orderstatus").reset_index(drop=True)
    return f.to_spark().withColumnRenamed("index", "o_orderkey")


@query("SELECT o_custkey, o_totalprice FROM orders")
def droplevel(spark, sf_dir):
    return orders(spark, sf_dir, ordered=False).set_index(["o_orderkey", "o_custkey"]).droplevel("o_orderkey").to_spark()


@query("SELECT row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) - 1 AS place, o_orderkey, o_totalprice FROM orders")
def sort_index(spark, sf_dir):
    """Falling labels, ties in the order there was."""
    return orders(spark, sf_dir).set_index("o_custkey").sort_index(ascending=False, ignore_index=True).to_spark().withColumnRenamed("index", "place")


@query("SELECT row_number() OVER (ORDER BY o_orderstatus, o_custkey DESC, o_orderkey) - 1 AS place, o_orderkey FROM orders")
def sort_index_levels(spark, sf_dir):
    f = orders(spark, sf_dir, "o_orderstatus").set_index(["o_orderstatus", "o_custkey"]).sort_index(ascending=[True, False], ignore_index=True)
    return f[["o_orderkey"]].to_spark().withColumnRenamed("index", "place")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders) WHERE n >= 10 AND n < c - 20")
def iloc_slice(spark, sf_dir):
    return orders(spark, sf_dir).iloc[10:-20][["o_orderkey", "o_totalprice"]].to_spark().drop("index")


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_totalprice > 200000")
def loc_mask_columns(spark, sf_dir):
    f = orders(spark, sf_dir, ordered=False)
    return f.loc[f["o_totalprice"] > 200000, ["o_orderkey", "o_totalprice", "o_custkey"]].to_spark()


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n BETWEEN 30 AND 60")
def loc_label_slice(spark, sf_dir):
    """Both ends belong to a slice of labels."""
    return orders(spark, sf_dir).loc[30:60, ["o_orderkey", "o_totalprice"]].to_spark().drop("index")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN -1 ELSE o_custkey END AS o_custkey, o_totalprice FROM orders")
def loc_assign(spark, sf_dir):
    f = orders(spark, sf_dir, ordered=False)
    f.loc[f["o_totalprice"] > 200000, "o_custkey"] = -1
    return f.to_spark()


@query("SELECT o_orderkey, o_custkey, CASE WHEN n < 25 THEN 0.5 ELSE o_totalprice END AS o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders)")
def iloc_assign(spark, sf_dir):
    f = orders(spark, sf_dir)
    f.iloc[:25, 2] = 0.5
    return f.to_spark().drop("index")


@query("""SELECT a.o_orderkey, round(a.o_totalprice + 2 * b.o_totalprice, 6) AS total FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) a
JOIN (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM orders) b USING (n)""")
def align_by_position(spark, sf_dir):
    """Two tables of as many rows meet row by row."""
    a, b = orders(spark, sf_dir), of.from_spark(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), order_by=["o_totalprice", "o_orderkey"])
    a["total"] = a["o_totalprice"] + b["o_totalprice"] * 2
    return rounded(a[["o_orderkey", "total"]].to_spark().drop("index"))


@query("""SELECT a.o_orderkey, a.o_totalprice, b.o_totalprice AS b FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) a
JOIN (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM orders) b USING (n)""")
def concat_columns_by_position(spark, sf_dir):
    a, b = orders(spark, sf_dir)[["o_orderkey", "o_totalprice"]], of.from_spark(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), order_by=["o_totalprice", "o_orderkey"])
    return of.concat([a, b["o_totalprice"].rename("b")], axis=1).to_spark().drop("index")


@query("SELECT p_brand, round(sum(p_retailprice), 6) AS p_retailprice, max(p_size) AS p_size FROM part GROUP BY p_brand")
def groupby_as_index(spark, sf_dir):
    """The keys are labels of the result."""
    return rounded(parts(spark, sf_dir)[["p_brand", "p_size", "p_retailprice"]].groupby("p_brand").agg({"p_retailprice": "sum", "p_size": "max"}).to_spark())


@query("SELECT p_brand, p_size, round(avg(p_retailprice), 6) AS p_retailprice FROM part GROUP BY ALL")
def groupby_not_as_index(spark, sf_dir):
    return rounded(parts(spark, sf_dir)[["p_brand", "p_size", "p_retailprice"]].groupby(["p_brand", "p_size"], as_index=False).agg({"p_retailprice": "mean"}).to_spark())


@query("SELECT p_size, count(*) AS p_partkey, min(p_brand) AS p_brand FROM part GROUP BY p_size")
def groupby_level(spark, sf_dir):
    f = parts(spark, sf_dir).set_index(["p_size", "p_retailprice"])
    return f.groupby(level="p_size").agg({"p_partkey": "count", "p_brand": "min"}).to_spark()


@query("SELECT p_brand, round(sum(p_retailprice), 6) AS p_retailprice FROM part GROUP BY p_brand")
def groupby_tree(spark, sf_dir):
    """The method is a hint; partial sums come before the exchange either way."""
    return rounded(parts(spark, sf_dir)[["p_brand", "p_retailprice"]].groupby("p_brand", method="tree").sum().to_spark())


def customers(spark, sf_dir):
    return of.from_spark(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal"), ["c_custkey"])


JOINED = "SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_acctbal FROM orders {} JOIN customer ON o_custkey = c_custkey"


@query(JOINED.format("LEFT"))
def join_on_labels(spark, sf_dir):
    """A column against the labels of the other."""
    return orders(spark, sf_dir, ordered=False).join(customers(spark, sf_dir), on="o_custkey").to_spark()


@query("SELECT c_custkey, c_mktsegment, c_acctbal, n AS spent FROM customer FULL JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY ALL) USING (c_custkey)")
def merge_labels_outer(spark, sf_dir):
    """Labels against labels; those of either side stay."""
    o = orders(spark, sf_dir, ordered=False)
    spent = o[o["o_totalprice"] > 250000].groupby("o_custkey").agg({"o_orderkey": "count"}).rename(columns={"o_orderkey": "spent"})
    return customers(spark, sf_dir).merge(spent, how="outer", left_index=True, right_index=True).to_spark()


def _by_method(method, how):
    def f(spark, sf_dir):
        c = of.from_spark(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal"))
        out = orders(spark, sf_dir, ordered=False).merge(c, how, left_on="o_custkey", right_on="c_custkey", method=method)
        return out[["o_orderkey", "o_custkey", "o_totalprice", "c_mktsegment", "c_acctbal"]].to_spark()

    f.__name__ = f"merge_method_{method}"
    return f


merge_method_hash = query(JOINED.format(""))(_by_method("hash", "inner"))
merge_method_sort = query(JOINED.format("LEFT"))(_by_method("sort", "left"))


@query("SELECT o_orderkey, c_acctbal FROM orders JOIN customer ON o_custkey::DOUBLE = c_custkey::DOUBLE")
def merge_mixed_key_types(spark, sf_dir):
    """A double key against an integer one."""
    o = orders(spark, sf_dir, ordered=False).astype({"o_custkey": "float64"})
    c = of.from_spark(table(spark, sf_dir, "customer", "c_custkey", "c_acctbal"))
    return o.merge(c, left_on="o_custkey", right_on="c_custkey")[["o_orderkey", "c_acctbal"]].to_spark()


@query("SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::INTEGER AS l_extendedprice, trunc(l_quantity)::SMALLINT AS l_quantity FROM lineitem")
def astype_float_to_int(spark, sf_dir):
    f = of.from_spark(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"))
    return f.astype({"l_extendedprice": "int32", "l_quantity": "int16"}).to_spark()


@query("SELECT r_regionkey AS __id, r_name AS __k, n FROM region JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY ALL) USING (r_regionkey)")
def merge_underscored_columns(spark, sf_dir):
    """Columns whose names begin like internal ones stay, and can be keys."""
    r = of.from_spark(table(spark, sf_dir, "region", "r_regionkey", "r_name")).rename(columns={"r_regionkey": "__id", "r_name": "__k"})
    n = of.from_spark(table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")).groupby("n_regionkey", as_index=False).agg({"n_nationkey": "count"})
    return r.merge(n.rename(columns={"n_regionkey": "__id", "n_nationkey": "n"})).to_spark()
