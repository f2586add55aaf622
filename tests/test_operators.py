"""Operators on small tables with NULLs, ties, empty inputs and errors."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from orrery.functions import arithmetic, casts, datetimes, missing, strings
from orrery.operators import aggregate, dedup, filters, join, order, projection, scan, sets
from orrery.plans import catalog


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(1, None, "a"), (2, 2.0, None), (3, 2.0, "b"), (4, None, "b"), (5, -1.0, "a")], "k int, v double, s string")


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def lit(v, kind="bigint"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize("a", [7, -7, 0])
@pytest.mark.parametrize("b", [3, -3, 1])
def test_floor_division_and_remainder_follow_python(spark, a, b):
    assert one(spark, arithmetic.floordiv(lit(a), lit(b), True)) == a // b
    assert one(spark, arithmetic.mod(lit(a), lit(b), True)) == a % b
    assert one(spark, arithmetic.mod(lit(a, "double"), lit(b, "double"), False)) == a % b
    assert one(spark, arithmetic.floordiv(lit(a, "double"), lit(b, "double"), False)) == a // b


def test_division_by_zero(spark):
    assert one(spark, arithmetic.truediv(lit(1), lit(0))) == float("inf")
    assert one(spark, arithmetic.truediv(lit(-1), lit(0))) == float("-inf")
    assert one(spark, F.isnan(arithmetic.truediv(lit(0), lit(0))))
    assert one(spark, arithmetic.floordiv(lit(1), lit(0), True)) is None
    assert one(spark, arithmetic.mod(lit(1), lit(0), True)) is None
    assert one(spark, F.isnan(arithmetic.mod(lit(1, "double"), lit(0, "double"), False)))
    assert one(spark, arithmetic.truediv(lit(None), lit(0))) is None


def test_large_integers_divide_exactly(spark):
    n = 2**62 + 1
    assert one(spark, arithmetic.floordiv(lit(n), lit(2), True)) == n // 2


def test_unknown_operators(spark):
    with pytest.raises(ValueError):
        arithmetic.binary("nope", lit(1), lit(1))


@pytest.mark.parametrize("op", ["eq", "ne", "lt", "gt", "le", "ge"])
def test_comparisons_are_never_null(spark, op):
    assert one(spark, missing.compare(op, lit(None), lit(1))) is (op == "ne")


def test_casts(spark):
    assert one(spark, casts.astype(lit(300), "bigint", "int8")) == 44
    assert one(spark, casts.astype(lit(-129), "bigint", "int8")) == 127
    assert one(spark, casts.astype(lit(True, "boolean"), "boolean", str)) == "True"
    assert one(spark, casts.astype(F.lit("x"), "string", bool)) is False
    assert one(spark, casts.astype(F.lit("2020-01-02"), "string", "datetime64[ns]")).day == 2
    assert one(spark, casts.astype(F.lit("1969-12-31 23:59:59").cast("timestamp_ntz"), "timestamp_ntz", "int64")) == -(10**9)
    with pytest.raises(ValueError):
        casts.astype(lit(1), "bigint", "datetime64[ns]")
    with pytest.raises(ValueError):
        casts.spark_type("complex")


def test_strings(spark):
    assert one(spark, strings.pad(F.lit("abcd"), 3)) == "abcd"
    assert one(spark, strings.pad(F.lit("ab"), 5, "both", "*")) == "*ab**"
    assert one(spark, strings.zfill(F.lit("-7"), 4)) == "00-7"
    assert one(spark, strings.strip(F.lit("\t x y \n"))) == "x y"
    assert one(spark, strings.strip(F.lit("xxaxbx"), "x")) == "axb"
    assert one(spark, strings.swapcase(F.lit("aBé1"))) == "Abé1"
    for f in (strings.lower, strings.strip, lambda c: strings.pad(c, 3), lambda c: strings.contains(c, "a")):
        assert one(spark, f(lit(None, "string"))) is None
    with pytest.raises(TypeError):
        strings.pad(F.lit("a"), 3, "left", "ab")


@pytest.mark.parametrize(("text", "want"), [("01/2015", "2015-01-01"), ("12/31/2015", "2015-12-31"), ("2015-02", "2015-02-01"), ("2015/02/03", "2015-02-03"), ("02-03-2015 10:11:12", "2015-02-03"), ("", None), ("x", None), (None, None)])
def test_csv_dates(spark, text, want):
    got = one(spark, datetimes.parse_csv_date(lit(text, "string")))
    assert (got and str(got)[:10]) == want


def test_formats():
    assert datetimes.spark_format("%d.%m.%Y at %H") == "dd.MM.yyyy 'at' HH"
    with pytest.raises(ValueError):
        datetimes.spark_format("%Q")


def test_projection_errors(t):
    with pytest.raises(KeyError):
        projection.select(t, ["nope"])
    with pytest.raises(KeyError):
        projection.assign(t, {"k": 1, "new": 2})
    with pytest.raises(ValueError):
        projection.insert(t, 0, "k", 1)
    with pytest.raises(ValueError):
        projection.set_labels(t, ["a"])
    assert projection.insert(t, 1, "new", 0).columns == ["k", "new", "v", "s"]


def test_query(t):
    limit = 2
    assert values(filters.query(t, "v >= @limit or k == 5"), "k") == [(2,), (3,), (5,)]
    assert values(filters.query(t, "k // 2 == 1 and not k % 2 == 1"), "k") == [(2,)]
    assert values(filters.query(t, "-k ** 2 < -4"), "k") == [(3,), (4,), (5,)]
    assert values(filters.query(t, "s == 'b' and v > 1"), "k") == [(3,)]
    del limit
    for bad in ("f(k) > 1", "k.x > 1", "k[0] > 1", "nope > 1", "@nope > 1"):
        with pytest.raises((SyntaxError, NameError)):
            filters.query(t, bad)


def test_missing_values(t):
    assert values(filters.dropna(t), "k") == [(3,), (5,)]
    assert values(filters.dropna(t, thresh=2), "k") == [(1,), (2,), (3,), (4,), (5,)]
    assert values(filters.fillna(t, 0), "v") == values(filters.fillna(t, {"v": 0}), "v") == [(-1.0,), (0.0,), (0.0,), (2.0,), (2.0,)]
    assert filters.has_missing(t, "v").first()[0] is True
    with pytest.raises(ValueError):
        filters.dropna(t, how="some")


@pytest.mark.parametrize(("keep", "want"), [("first", [1, 2, 5]), ("last", [3, 4, 5]), (False, [5])])
def test_drop_duplicates(t, keep, want):
    assert [k for (k,) in values(dedup.drop_duplicates(t, ["v"], keep, ["k"]), "k")] == want


def test_join_keys(spark):
    left = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z"), (2, "w")], "k int, a string")
    right = spark.createDataFrame([(None, "p"), (2, "q"), (2, "r"), (3, "s")], "k int, a string")
    assert values(join.merge(left, right, on="k")) == sorted([(None, "y", "p"), (2, "z", "q"), (2, "z", "r"), (2, "w", "q"), (2, "w", "r")], key=repr)
    outer = join.merge(left, right, "outer", on="k")
    assert len(values(outer)) == 7 and (3, None, "s") in values(outer) and outer.columns == ["k", "a_x", "a_y"]
    for method in (None, "hash", "sort", "broadcast"):
        assert values(join.merge(left, right, "left", on="k", method=method)) == values(join.merge(left, right, "left", on="k"))
    empty = right.filter("false")
    assert values(join.merge(left, empty, "left", on="k")) == sorted([(1, "x", None), (None, "y", None), (2, "z", None), (2, "w", None)], key=repr)
    for bad in ({"how": "cross"}, {"on": "nope"}, {"left_on": "k"}, {"on": "k", "method": "x"}, {"on": "k", "suffixes": ("", "")}, {"on": "k", "how": "outer", "method": "broadcast"}):
        with pytest.raises((NotImplementedError, ValueError, KeyError)):
            join.merge(left, right, **bad)


def test_broadcast_is_checked(spark):
    big = spark.range(20_000_000).withColumn("x", F.col("id"))
    plan = join.merge(spark.range(5).toDF("id"), big, on="id", method="broadcast")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan


def test_reductions(t):
    empty = t.filter("false")
    assert aggregate.reduce_columns(empty, "sum").first().asDict() == {"k": 0, "v": 0.0}
    assert aggregate.reduce_columns(empty, "mean").first().asDict() == {"k": None, "v": None}
    assert aggregate.reduce_columns(t, "min").first().asDict() == {"k": 1, "v": -1.0, "s": "a"}
    assert values(aggregate.reduce_long(t, "count")) == [("k", 5), ("s", 4), ("v", 3)]
    assert values(aggregate.groupby(t, ["s"], "sum"), "s", "v") == [("a", -1.0), ("b", 2.0)]
    assert values(aggregate.groupby(t, ["s"], {"v": ["count", "size"]})) == [("a", 1, 2), ("b", 1, 2)]
    with pytest.raises(TypeError):
        aggregate.groupby(t, ["k"], {"s": "sum"}).collect()


def test_order(t):
    assert [r.k for r in order.head(t, ["k"], 2).collect()] == [1, 2]
    assert values(order.tail(t, ["k"], 2), "k") == [(4,), (5,)]
    assert values(order.iloc(t, ["k"], -3, -1), "k") == [(3,), (4,)]
    assert values(order.loc_slice(t, "s", ["k"], "a", "b"), "k") == [(1,), (2,), (3,), (4,)]
    assert [r.k for r in order.sort_values(t, ["v"], False, "first", ["k"]).collect()] == [1, 4, 2, 3, 5]
    assert [r.k for r in order.sort_values(t, ["v"], True, "last", ["k"]).collect()] == [5, 2, 3, 1, 4]
    assert values(order.drop_label(t, "s", "b"), "k") == [(1,), (2,), (5,)]
    with pytest.raises(KeyError):
        order.loc_slice(t, "s", ["k"], "nope", "b")
    with pytest.raises(ValueError):
        order.ordering(["k"], na_position="middle")


def test_positions_over_many_ranges(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_011).alias("k"), F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("g"))
    rows = order.with_rowid(df, ["g", "k"], [False, True], "first").collect()
    want = sorted(((r.g, r.k) for r in rows), key=lambda x: (x[0] is not None, -(x[0] or 0), x[1]))
    assert [(r.g, r.k) for r in sorted(rows, key=lambda r: r[order.ROWID])] == want
    assert sorted(r[order.ROWID] for r in rows) == list(range(30_000))


@pytest.mark.parametrize("op", scan.OPS)
@pytest.mark.parametrize("skipna", [True, False])
def test_cumulative_over_many_ranges(spark, op, skipna):
    import pandas as pd

    n = 20_000
    df = spark.range(n).select("id", F.when((F.col("id") % 7 != 0) | (F.col("id") < 9000 if not skipna else F.lit(False)), 1 + (F.col("id") * 37 % 101 - 50) / 1e5).alias("x"))
    got = scan.cumulate(df, ["x"], ["id"], op, skipna).orderBy("id").toPandas()["x"]
    want = getattr(df.orderBy("id").toPandas()["x"], op)(skipna=skipna)
    pd.testing.assert_series_equal(got, want, rtol=1e-9)


def test_unions(spark, t):
    other = spark.createDataFrame([("z", 9)], "s string, k int")
    both = sets.concat_rows([t, other])
    assert values(both, "k", "v", "s")[-1] == (9, None, "z") and both.count() == 6
    assert sets.equals(t, t.orderBy(F.desc("k"))).first()[0]
    assert not sets.equals(t, t.union(t)).first()[0]
    assert not sets.equals(t, t.withColumn("k", F.col("k").cast("bigint"))).first()[0]
    with pytest.raises(ValueError):
        sets.concat_rows([])


def test_columns_side_by_side(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "i int, a string")
    b = spark.createDataFrame([(None, 2.0), (1, 1.0)], "i int, b double")
    assert values(sets.concat_columns([a, b], ["i"]), "i", "a", "b") == sorted([(1, "x", 1.0), (None, "y", 2.0)], key=repr)
    with pytest.raises(Exception, match="row labels differ"):
        sets.concat_columns([a, b.filter("i = 1")], ["i"]).collect()


def test_large_floor_quotients(spark):
    for x, y in ((1e300, 3.0), (-1e20, 7.0), (9.5, -2.0), (2.0**53 + 2, 1.0)):
        assert one(spark, arithmetic.floordiv(lit(x, "double"), lit(y, "double"), False)) == (x / y if abs(x / y) >= 2**53 else x // y)


def test_negative_zero_quotients(spark):
    for x, y in ((0.0, -2.0), (-0.0, 3.0), (0.0, 3.0)):
        assert str(one(spark, arithmetic.floordiv(lit(x, "double"), lit(y, "double"), False))) == str(x / y)


def test_rounded_negative_zero(spark):
    got = catalog.rounded(spark.createDataFrame([(-0.0, 0.0, 1.26, None)], "a double, b double, c double, d double"), 1).first()
    assert [str(x) for x in got] == ["-0.0", "0.0", "1.3", "None"]


def test_category_codes(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 11 != 0, F.concat(F.lit("w"), F.lpad((F.col("id") * 7919 % 9001).cast("string"), 5, "0"))).alias("word"))
    rows = order.category_codes(df, "word").collect()
    place = {w: i for i, w in enumerate(sorted({r.word for r in rows if r.word is not None}))}
    assert len(rows) == 30_000 and all(r.code == place.get(r.word) for r in rows)
    assert order.category_codes(df.filter("id < 0"), "word").collect() == []


def test_more_ranges_in_larger_tables(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS", 10)
    monkeypatch.setattr(order, "LEAST", 5)
    df = spark.range(6000).select(F.when(F.col("id") % 3 != 0, F.col("id").cast("double")).alias("k"), "id")
    placed = df.select("k", "id", order.ranges(df, ["k", "id"], [False, True]).alias("r"))
    sizes = [r["count"] for r in placed.groupBy("r").count().collect()]
    assert len(sizes) > 400 and max(sizes) < 100
    rows = sorted(placed.collect(), key=lambda x: (x.k is None, -(x.k or 0), x.id))
    assert [x.r for x in rows] == sorted(x.r for x in rows)
