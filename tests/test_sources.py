"""Files and memory."""

import bz2
import gzip

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import values

from orrery.sources import csv, memory, parquet


@pytest.fixture
def path(tmp_path):
    def write(text, name="t.csv"):
        at = tmp_path / name
        data = text.encode()
        at.write_bytes(gzip.compress(data) if name.endswith(".gz") else bz2.compress(data) if name.endswith(".bz2") else data)
        return str(at)

    return write


def test_types_are_inferred(spark, path):
    df = csv.read_csv(spark, path("a,b,c,d\n1,1.5,x,True\n2,,y,False\n"))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "boolean")]
    assert values(df) == [(1, 1.5, "x", True), (2, None, "y", False)]


def test_names_without_header(spark, path):
    df = csv.read_csv(spark, path("1|x\n\n2|y\n"), sep="|", names=["a", "b"], dtype={"a": "int32", "b": "category"})
    assert values(df) == [(1, "x"), (2, "y")]


@pytest.mark.parametrize("name", ["t.csv.gz", "t.csv.bz2"])
def test_compressed(spark, path, name):
    assert values(csv.read_csv(spark, path("a\n1\n2\n", name))) == [(1,), (2,)]


def test_own_tokens(spark, path):
    df = csv.read_csv(spark, path("yes,1\nno,none\nNA,3\n"), names=["a", "b"], dtype={"a": bool, "b": float}, true_values=["yes"], false_values=["no"], na_values=["none"])
    assert values(df) == sorted([(True, 1.0), (False, None), (None, 3.0)], key=repr)


def test_quotes(spark, path):
    df = csv.read_csv(spark, path(':a,b:,x\n:c::d:,y\n'), names=["a", "b"], dtype=str, quotechar=":")
    assert values(df) == [("a,b", "x"), ("c:d", "y")]


def test_lines(spark, path):
    p = path("junk\na\n1\n2\n3\nfoot\n")
    assert values(csv.read_csv(spark, p, skiprows=1, skipfooter=1, names=["a"], header=0, dtype="int64")) == [(1,), (2,), (3,)]
    assert values(csv.read_csv(spark, path("a\n1\n2\n3\n", "u.csv"), nrows=2, dtype="int64")) == [(1,), (2,)]


def test_columns_and_labels(spark, path):
    p = path("a,b,c\n1,2,01/2015\n")
    assert csv.read_csv(spark, p, usecols=["c", 0]).columns == ["c", "a"]
    assert csv.read_csv(spark, p, index_col="b").columns == ["b", "a", "c"]
    assert str(csv.read_csv(spark, p, parse_dates=["c"]).first().c) == "2015-01-01 00:00:00"


def test_headers_are_verified(spark, path):
    a, b = path("a,b\n1,2\n", "1.csv"), path("a,c\n1,2\n", "2.csv")
    with pytest.raises(ValueError):
        csv.read_csv(spark, [a, b], verify_header=True)
    assert csv.read_csv(spark, [a, a], verify_header=True).count() == 2


@pytest.mark.parametrize(
    "bad",
    [{"sep": "ab"}, {"header": 3}, {"nrows": 1, "skipfooter": 1}, {"skiprows": -1}, {"compression": "zip"}, {"names": ["a", "a"]}, {"dtype": {"a": int}}, {"quotechar": ""}, {"parse_dates": [7]}, {"dtype": "complex"}],
)
def test_wrong_options(spark, path, bad):
    with pytest.raises(ValueError):
        csv.read_csv(spark, path("a,b\n1,2\n"), **bad)


@pytest.mark.parametrize("sep", [",", "|"])
@pytest.mark.parametrize("header", [True, False])
@pytest.mark.parametrize("partition", [True, False])
def test_csv_round_trip(spark, tmp_path, sep, header, partition):
    df = spark.createDataFrame([(1, None, "a,b"), (2, 2.5, 'q"x'), (3, -1.0, None)], "a int, b double, c string")
    at = str(tmp_path / "out")
    csv.to_csv(df, at, sep=sep, na_rep="NA", header=header, partition=partition)
    back = csv.read_csv(spark, at, sep=sep, header=0 if header else None, names=["a", "b", "c"], dtype={"a": "int32", "b": "float64", "c": "str"})
    assert values(back) == values(df)


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "a int, b double")
    at = str(tmp_path / "p")
    parquet.to_parquet(df, at)
    assert values(parquet.read_parquet(spark, at)) == [(1, None), (2, 1.0)]
    assert parquet.read_parquet(spark, at, ["b"]).columns == ["b"]
    with pytest.raises(Exception, match="exist"):
        parquet.to_parquet(df, at)
    with pytest.raises(ValueError):
        parquet.to_parquet(df, at + "2", compression="gzip")
    with pytest.raises(NotImplementedError):
        parquet.to_parquet(df, at + "2", partition_cols=["a"])


def test_memory(spark):
    frame = pd.DataFrame({"a": [1.0, np.nan], "c": pd.Categorical(["x", None]), "t": pd.to_datetime(["2020-01-01", None])})
    rows = memory.from_pandas(spark, frame).collect()
    assert (rows[0].a, rows[0].c, str(rows[0].t)) == (1.0, "x", "2020-01-01 00:00:00") and tuple(rows[1]) == (None, None, None)
    assert values(memory.from_dict(spark, {"a": [1, 2], "b": 0})) == [(1, 0), (2, 0)]
    assert memory.to_arrow(memory.from_arrow(spark, pa.table({"a": [1]}))).to_pydict() == {"a": [1]}
    assert memory.to_numpy(memory.from_dict(spark, {"a": [1, 2]})).tolist() == [[1], [2]]


def test_types_are_inferred_from_all_rows(spark, tmp_path):
    rows = [f"{i},{i},True,{i}.5,," for i in range(3000)] + ["late,1.5,2,x,,", ",,,,,"]
    (tmp_path / "a.csv").write_text("a,b,c,d,e,f\n" + "\n".join(rows) + "\n\n1,2,True,y,,7\n")
    got = csv.read_csv(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in got.dtypes] == ["string", "double", "string", "string", "double", "double"]
    # The row of empty fields stays; the blank line goes.
    assert got.count() == 3003 and got.filter("a is null and b is null and c is null and d is null").count() == 1


class Foreign:
    """An object with one protocol only."""

    def __init__(self, name, data):
        setattr(type(self), name, lambda self, *a, **k: getattr(data, name)(*a, **k))


@pytest.mark.parametrize("name", ["__arrow_c_stream__", "__dataframe__"])
def test_import_by_protocol(spark, name):
    kind = type("Foreign", (Foreign,), {})
    data = kind(name, pd.DataFrame({"a": [1, 2, 3], "b": [1.5, np.nan, 2.5], "c": ["x", None, "z"], "u": np.array([1, 2, 255], dtype="uint8")}))
    df = memory.from_interchange(spark, data)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "smallint"]
    assert values(df) == [(1, 1.5, "x", 1), (2, None, None, 2), (3, 2.5, "z", 255)]


def test_import_of_odd_columns(spark):
    table = pa.table({"d": pa.array(["x", None, "x"]).dictionary_encode(), "u": pa.array([2**64 - 1, 0, None], pa.uint64()), "n": pa.nulls(3)})
    assert values(memory.from_interchange(spark, table)) == sorted([("x", 2**64 - 1, None), (None, 0, None), ("x", None, None)], key=repr)
    assert memory.from_interchange(spark, pa.table({"a": pa.array([], pa.int32())})).count() == 0
    with pytest.raises(TypeError):
        memory.from_interchange(spark, object())


def test_frames_are_imported_and_exported(spark):
    from orrery import frame as of

    got = of.from_interchange(pa.table({"k": [3, 1, 2], "s": ["c", "a", None]}))
    assert got.to_pandas()["k"].tolist() == [3, 1, 2] and got.to_pandas().index.tolist() == [0, 1, 2]
    assert pa.table(got[["s"]])["s"].to_pylist() == ["c", "a", None]
