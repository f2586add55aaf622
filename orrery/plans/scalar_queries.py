"""Queries of scalar functions: arithmetic, comparison, strings, dates, categories, casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arithmetic, casts, datetimes, missing, strings
from ..operators import order
from .catalog import query, rounded, table


def signed(spark, sf_dir):
    """Integers and doubles of both signs, with zeros and NULLs."""
    t = table(spark, sf_dir, "events", "event_id", "user_id", "value")
    return t.select("event_id", (F.col("user_id") % 11 - 5).alias("a"), F.nullif(F.col("event_id") % 7 - 3, F.lit(2)).alias("b"), (F.col("value") - 50).alias("x"), F.nullif(F.col("event_id") % 5 - 2, F.lit(1)).cast("double").alias("y"))


SIGNED = "(SELECT event_id, user_id % 11 - 5 AS a, nullif(event_id % 7 - 3, 2) AS b, value - 50 AS x, nullif(event_id % 5 - 2, 1)::DOUBLE AS y FROM events)"


def operands():
    return F.col("a"), F.col("b"), F.col("x"), F.col("y")


@query(f"""SELECT event_id, a + b AS s, a - b AS d, a * b AS p, round(CASE WHEN b IS NULL THEN NULL WHEN b = 0 THEN CASE WHEN a > 0 THEN 'inf'::DOUBLE
WHEN a < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE a / b::DOUBLE END, 9) AS q FROM {SIGNED}""")
def arith_all(spark, sf_dir):
    A, B, X, Y = operands()  # noqa: N806
    return rounded(signed(spark, sf_dir).select("event_id", arithmetic.binary("add", A, B).alias("s"), arithmetic.binary("sub", A, B).alias("d"), arithmetic.binary("mul", A, B).alias("p"), arithmetic.binary("truediv", A, B).alias("q")), 9)


@query(f"SELECT event_id, CASE WHEN b <> 0 THEN floor(a / b::DOUBLE)::BIGINT END AS f, CASE WHEN b <> 0 THEN ((a % b) + b) % b END AS m FROM {SIGNED}")
def floordiv_mod_negative(spark, sf_dir):
    A, B, X, Y = operands()  # noqa: N806
    return signed(spark, sf_dir).select("event_id", arithmetic.binary("floordiv", A, B, integral=True).alias("f"), arithmetic.binary("mod", A, B, integral=True).alias("m"))


@query(f"SELECT event_id, CASE WHEN y <> 0 THEN floor(x / y) WHEN y = 0 THEN CASE WHEN x > 0 THEN 'inf'::DOUBLE WHEN x < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END END AS f FROM {SIGNED}")
def floordiv_float(spark, sf_dir):
    A, B, X, Y = operands()  # noqa: N806
    return signed(spark, sf_dir).select("event_id", arithmetic.binary("floordiv", X, Y).alias("f"))


@query(f"SELECT event_id, 10 - a AS d, round(CASE WHEN b = 0 THEN 'inf'::DOUBLE ELSE 10 / b::DOUBLE END, 9) AS q, CASE WHEN b <> 0 THEN ((10 % b) + b) % b END AS m, pow(2, a)::BIGINT AS p FROM {SIGNED} WHERE a >= 0")
def reverse_scalar_ops(spark, sf_dir):
    A, B, X, Y = operands()  # noqa: N806
    ten = F.lit(10).cast("bigint")
    t = signed(spark, sf_dir).filter("a >= 0")
    return rounded(t.select("event_id", arithmetic.binary("rsub", A, ten).alias("d"), arithmetic.binary("rtruediv", B, ten).alias("q"), arithmetic.binary("rmod", B, ten, integral=True).alias("m"), arithmetic.binary("rpow", A, F.lit(2), result="bigint").alias("p")), 9)


@query(f"SELECT event_id, coalesce(a = b, false) AS eq, coalesce(a <> b, true) AS ne, coalesce(a < b, false) AS lt, coalesce(a > b, false) AS gt, coalesce(a <= b, false) AS le, coalesce(a >= b, false) AS ge FROM {SIGNED}")
def compare_null_semantics(spark, sf_dir):
    A, B, X, Y = operands()  # noqa: N806
    return signed(spark, sf_dir).select("event_id", *[missing.compare(op, A, B).alias(op) for op in ("eq", "ne", "lt", "gt", "le", "ge")])


@query(f"SELECT event_id, a & b AS i_and, a | b AS i_or, xor(a, b) AS i_xor, (a > 0) AND (x > 0) AS b_and, (a > 0) OR (x > 0) AS b_or, (a > 0) <> (x > 0) AS b_xor FROM {SIGNED}")
def bitwise_ops(spark, sf_dir):
    A, B, X, Y = operands()  # noqa: N806
    t = signed(spark, sf_dir)
    return t.select("event_id", *[arithmetic.bitwise(op, A, B, False).alias(f"i_{op}") for op in ("and", "or", "xor")], *[arithmetic.bitwise(op, A > 0, X > 0, True).alias(f"b_{op}") for op in ("and", "or", "xor")])


@query(f"SELECT event_id, pow(a, 3)::BIGINT AS p, round(pow(abs(x), 0.5), 9) AS r, -a AS n, abs(b) AS m, ~a AS i, NOT (a > 0) AS t FROM {SIGNED}")
def pow_abs_neg_invert(spark, sf_dir):
    A, B, X, Y = operands()  # noqa: N806
    t = signed(spark, sf_dir).select("event_id", arithmetic.power(A, F.lit(3), "bigint").alias("p"), arithmetic.power(F.abs(X), F.lit(0.5)).alias("r"), (-A).alias("n"), F.abs(B).alias("m"), arithmetic.invert(A, False).alias("i"), arithmetic.invert(A > 0, True).alias("t"))
    return rounded(t, 9)


@query(f"SELECT event_id, a + coalesce(b, 100) AS s, 7 * 1 + a AS t FROM {SIGNED}")
def fill_value_align(spark, sf_dir):
    A, B, X, Y = operands()  # noqa: N806
    return signed(spark, sf_dir).select("event_id", arithmetic.binary("add", A, F.coalesce(B, F.lit(100))).alias("s"), arithmetic.binary("radd", A, F.lit(7).cast("bigint")).alias("t"))


@query("SELECT p_partkey, regexp_matches(p_name, '[aeiou]{2}|^s') AS hit FROM part")
def str_contains(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", strings.contains(F.col("p_name"), "[aeiou]{2}|^s").alias("hit"))


@query("""SELECT p_partkey, CASE WHEN n >= 12 THEN b ELSE repeat('*', 12 - n) || b END AS l, CASE WHEN n >= 12 THEN b ELSE b || repeat('*', 12 - n) END AS r,
CASE WHEN n >= 13 THEN b ELSE repeat('-', (13 - n) // 2) || b || repeat('-', 13 - n - (13 - n) // 2) END AS c, CASE WHEN n >= 9 THEN b ELSE repeat('0', 9 - n) || b END AS z
FROM (SELECT p_partkey, p_brand AS b, length(p_brand) AS n FROM part)""")
def str_pad_zfill(spark, sf_dir):
    b = F.col("p_brand")
    t = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    return t.select("p_partkey", strings.pad(b, 12, "left", "*").alias("l"), strings.pad(b, 12, "right", "*").alias("r"), strings.pad(b, 13, "both", "-").alias("c"), strings.zfill(b, 9).alias("z"))


@query("SELECT p_partkey, trim(chr(9) || ' ' || p_name || chr(10), ' ' || chr(9) || chr(10) || chr(13)) AS s, trim(p_brand, 'Brand#') AS t FROM part")
def str_strip(spark, sf_dir):
    t = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    return t.select("p_partkey", strings.strip(F.concat(F.lit("\t "), F.col("p_name"), F.lit("\n"))).alias("s"), strings.strip(F.col("p_brand"), "Brand#").alias("t"))


@query("SELECT p_partkey, lower(p_type) AS l, upper(p_name) AS u, translate(p_brand, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS s FROM part")
def str_case(spark, sf_dir):
    t = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand")
    return t.select("p_partkey", strings.lower(F.col("p_type")).alias("l"), strings.upper(F.col("p_name")).alias("u"), strings.swapcase(F.col("p_brand")).alias("s"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS d, NULL::TIMESTAMP AS bad FROM orders")
def to_datetime_format(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    text = F.date_format("o_orderdate", "dd.MM.yyyy")
    return t.select("o_orderkey", datetimes.to_datetime(text, "%d.%m.%Y").alias("d"), datetimes.to_datetime(F.concat(text, F.lit("x")), "%d.%m.%Y").alias("bad"))


@query("""SELECT event_id, year(ts)::SMALLINT AS year, month(ts)::SMALLINT AS month, day(ts)::SMALLINT AS day, hour(ts)::SMALLINT AS hour, minute(ts)::SMALLINT AS minute,
second(ts)::SMALLINT AS second, (isodow(ts) - 1)::SMALLINT AS weekday FROM events""")
def dt_fields(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "ts").select("event_id", *[datetimes.field(F.col("ts"), f).alias(f) for f in datetimes.FIELDS])


@query("""SELECT o_orderkey, CASE WHEN p IS NOT NULL THEN (dense_rank() OVER (ORDER BY p NULLS LAST) - 1)::INT END AS code
FROM (SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS p FROM orders)""")
def cat_codes(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("p"))
    return order.category_codes(t, "p").select("o_orderkey", "code")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus END AS c FROM orders")
def cat_known_values(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select("o_orderkey", casts.as_category(F.col("o_orderstatus"), ["O", "F"]).alias("c"))


@query("""SELECT event_id, user_id::VARCHAR AS s, trunc(value)::INT AS i, CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END AS b, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t,
epoch_us(ts) * 1000 AS n, ((event_id + 128) % 256 - 128)::TINYINT AS w, event_type = 'True' AS z, user_id <> 0 AS k FROM events""")
def astype_matrix(spark, sf_dir):
    t = table(spark, sf_dir, "events", "event_id", "user_id", "value", "ts", "event_type")
    return t.select(
        "event_id", casts.astype(F.col("user_id"), "bigint", "string").alias("s"), casts.astype(F.col("value"), "double", "int32").alias("i"),
        casts.astype(F.col("user_id") % 2 == 0, "boolean", str).alias("b"), casts.astype(F.col("ts"), "timestamp_ntz", "string").alias("t"),
        casts.astype(F.col("ts"), "timestamp_ntz", "int64").alias("n"), casts.astype(F.col("event_id"), "bigint", "int8").alias("w"),
        casts.astype(F.col("event_type"), "string", "bool").alias("z"), casts.astype(F.col("user_id"), "bigint", bool).alias("k"),
    )
