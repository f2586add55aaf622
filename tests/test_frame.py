"""The frame interface against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery import frame as of


@pytest.fixture(scope="module")
def pdf(spark):
    rng = np.random.default_rng(3)
    n = 60
    out = pd.DataFrame({"k": rng.integers(0, 5, n), "v": rng.normal(size=n).round(3), "w": rng.integers(-9, 9, n), "s": rng.choice(["ab", "Cd", " e", "fgh"], n)})
    out.loc[out.index % 7 == 3, "v"] = np.nan
    out.loc[out.index % 11 == 5, "s"] = None
    return out


@pytest.fixture(scope="module")
def df(pdf):
    return of.from_pandas(pdf)


def same(got, want, order=True):
    got = got.to_pandas() if isinstance(got, of.Frame) else got
    if not order:
        by = list(want.columns)
        got, want = (x.reset_index(drop=True).sort_values(by).reset_index(drop=True) for x in (got, want))
    if isinstance(want, pd.Series):
        pd.testing.assert_series_equal(got, want, check_dtype=False, check_index_type=False, check_names=False)
    else:
        pd.testing.assert_frame_equal(got, want, check_dtype=False, check_index_type=False, check_column_type=False, check_names=False)


@pytest.mark.parametrize(
    "f",
    [
        lambda d: d, lambda d: d[["v", "k"]], lambda d: d["v"], lambda d: d[d["w"] > 2], lambda d: d.loc[d["v"] < 0, ["k", "v"]], lambda d: d.head(7), lambda d: d.tail(3),
        lambda d: d.iloc[5:9], lambda d: d.iloc[-4:-1, 1], lambda d: d.iloc[:, :2], lambda d: d.loc[10:12], lambda d: d.loc[3:6, "v":"s"], lambda d: d[2:5], lambda d: d["w"][3:6],
        lambda d: d.query("v > 0.2 and w != 3"), lambda d: d.sort_values(["k", "w"], ascending=[False, True], kind="stable"), lambda d: d.sort_values("v", na_position="first", kind="stable"),
        lambda d: d["v"].sort_values(kind="stable"), lambda d: d.sort_values("w", ignore_index=True, kind="stable"), lambda d: d.sort_index(ascending=False), lambda d: d.dropna(), lambda d: d.dropna(thresh=4),
        lambda d: d.dropna(subset=["v"]), lambda d: d["v"].dropna(), lambda d: d.fillna({"v": 9.0, "s": "none"}), lambda d: d["s"].fillna("x"), lambda d: d.isna(), lambda d: d.notna(), lambda d: d.drop_duplicates(["k"]),
        lambda d: d.drop_duplicates(["k", "s"], keep="last"), lambda d: d.drop_duplicates(["k", "w"], keep=False), lambda d: d.drop(columns=["s"]), lambda d: d.drop(index=4), lambda d: d.rename(columns={"k": "z"}),
        lambda d: d.add_prefix("p_"), lambda d: d.add_suffix("_s"), lambda d: d.set_index("k"), lambda d: d.set_index(["k", "s"]).reset_index(), lambda d: d.set_index(["k", "s"]).droplevel("s"), lambda d: d.reset_index(),
        lambda d: d.reset_index(drop=True), lambda d: d.set_index("k").sort_index(kind="stable"), lambda d: d[["v", "w"]].cumsum(), lambda d: d["w"].cummax(), lambda d: d["v"].cumsum(skipna=False), lambda d: d["v"].cumprod(),
        lambda d: d["v"] + d["w"], lambda d: d["w"] // d["k"].where(d["k"] != 0, 3), lambda d: d["w"] % 4, lambda d: d["w"] // -4, lambda d: 10 - d["w"], lambda d: 2.0 ** d["w"].abs(), lambda d: d["w"] / 4, lambda d: d["w"] * 3 - d["v"],
        lambda d: d[["v", "w"]].add(d["k"], axis=0) if isinstance(d, pd.DataFrame) else d[["v", "w"]].add(d["k"]), lambda d: d[["v", "w"]] + d[["v", "w"]], lambda d: d["v"].add(d["w"], fill_value=1.0), lambda d: d["v"] > 0, lambda d: d["v"] != 0.5, lambda d: (d["w"] > 0) & (d["k"] < 3), lambda d: ~(d["w"] > 0) | (d["k"] == 1),
        lambda d: d["w"] ^ d["k"], lambda d: -d["w"], lambda d: abs(d["w"]), lambda d: d["v"].where(d["w"] > 0, -1.0), lambda d: d["v"].mask(d["w"] > 0), lambda d: d["k"].astype("float64"), lambda d: d.astype({"k": "float64"}), lambda d: d["k"].astype(str),
        lambda d: d["s"].str.upper(), lambda d: d["s"].str.strip(), lambda d: d["s"].str.swapcase(), lambda d: d["s"].str.zfill(4), lambda d: d["w"].to_frame(), lambda d: d.iloc[3:4],
    ],
)
def test_like_pandas(df, pdf, f):
    same(f(df), f(pdf))


def test_pad_on_both_sides_has_the_smaller_half_on_the_left(df, pdf):
    got = df["s"].str.pad(5, side="both", fillchar="*").to_pandas()
    want = [None if pd.isna(x) else "*" * ((5 - len(x)) // 2) + x + "*" * (5 - len(x) - (5 - len(x)) // 2) for x in pdf["s"]]
    assert [None if pd.isna(x) else x for x in got] == want


def test_merge_keeps_columns_with_underscores(df, pdf):
    names = {"k": "__id", "w": "__i0", "v": "__label_l0"}
    right = pd.DataFrame({"__id": [1, 2], "z": [5, 6]})
    same(df[["k", "w", "v"]].rename(columns=names).merge(of.from_pandas(right)), pdf[["k", "w", "v"]].rename(columns=names).merge(right), order=False)


def test_contains_keeps_missing(df, pdf):
    got = df["s"].str.contains("[aC]").to_pandas()
    assert [None if pd.isna(x) else bool(x) for x in got] == [None if x is None or pd.isna(x) else ("a" in x or "C" in x) for x in pdf["s"]]


@pytest.mark.parametrize("op", ["sum", "prod", "min", "max", "mean", "var", "std", "count"])
def test_reductions(df, pdf, op):
    want = getattr(pdf[["k", "v", "w"]], op)()
    got = getattr(df[["k", "v", "w"]], op)()
    assert np.allclose(got[["k", "v", "w"]].astype(float), want.astype(float))
    assert np.isclose(getattr(df["v"], op)(), getattr(pdf["v"], op)())


def test_more_reductions(df, pdf):
    assert df["s"].max() == pdf["s"].dropna().max() and (df["w"] > 100).any() is False and (df["w"] > -100).all() is True
    assert len(df) == 60 and df.shape == (60, 4) and df["v"].hasnans and not df["k"].hasnans
    with pytest.raises(TypeError):
        df["s"].sum()


@pytest.mark.parametrize(
    "f",
    [
        lambda d: d.groupby("k")[["v", "w"]].sum(), lambda d: d.groupby("k")["v"].mean() if isinstance(d, of.Frame) else d.groupby("k")[["v"]].mean(), lambda d: d.groupby("k")[["v"]].agg(["sum", "max"]),
        lambda d: d.groupby("k").agg({"v": "min", "w": "max"}), lambda d: d.groupby("k").agg({"v": ["min", "count"], "w": ["sum"]}), lambda d: d.groupby(["k", "s"])[["w"]].count(), lambda d: d.groupby("k")[["v"]].var(),
    ],
)
def test_groupings(df, pdf, f):
    got, want = f(df).to_pandas().sort_index(), f(pdf).sort_index()
    got.columns = pd.MultiIndex.from_tuples(got.columns) if isinstance(got.columns[0], tuple) else got.columns
    want.columns = pd.MultiIndex.from_tuples(want.columns) if isinstance(want.columns[0], tuple) else want.columns
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_index_type=False, check_names=False)


def test_group_options(df, pdf):
    same(df.groupby("k", as_index=False, sort=True).agg({"w": "sum"}), pdf.groupby("k", as_index=False).agg({"w": "sum"}))
    assert df.groupby("s").size().to_pandas().sort_index().tolist() == pdf.groupby("s").size().sort_index().tolist()
    levels = df.set_index(["k", "s"])[["w"]].groupby(level="k").sum().to_pandas().sort_index()
    pd.testing.assert_frame_equal(levels, pdf.groupby("k")[["w"]].sum(), check_dtype=False, check_index_type=False)


def test_merges(df, pdf):
    right = pd.DataFrame({"k": [1, 2, 2, 9], "w": [10, 20, 21, 90]})
    r = of.from_pandas(right)
    for how in ("inner", "left", "outer"):
        same(df[["k", "w"]].merge(r, how, on="k"), pdf[["k", "w"]].merge(right, how, on="k"), order=False)
    same(df[["k", "v"]].merge(r.set_index("k"), left_on="k", right_index=True), pdf[["k", "v"]].merge(right.set_index("k"), left_on="k", right_index=True), order=False)
    same(df[["k", "v"]].join(r.set_index("k"), on="k"), pdf[["k", "v"]].join(right.set_index("k"), on="k"), order=False)
    a, b = pdf[["k", "v"]].drop_duplicates("k").set_index("k"), right.set_index("k")
    # Rows of one label have no order of their own.
    in_order = lambda f: f.rename_axis("k").sort_values(["k", "w"])
    got = of.from_pandas(a).join(of.from_pandas(b)).to_pandas()
    pd.testing.assert_frame_equal(in_order(got), in_order(a.join(b)), check_dtype=False, check_index_type=False)


def test_unions(df, pdf):
    same(of.concat([df, df[["k"]]]), pd.concat([pdf, pdf[["k"]]]), order=False)
    same(of.concat([df["v"], df["w"]], axis=1), pd.concat([pdf["v"], pdf["w"]], axis=1))
    same(of.concat([df, of.from_pandas(pdf.add_suffix("2"))], axis=1), pd.concat([pdf, pdf.add_suffix("2")], axis=1))
    same(df.append(df), pd.concat([pdf, pdf]), order=False)


def test_frames_meet_by_known_positions(spark, monkeypatch):
    """Ordered frames are numbered once, when the order is given; a frame and what was computed from it meet without another join."""
    n = 500
    t = spark.range(n).select("id", ((F.col("id") * 37) % n).cast("double").alias("v"))
    a, b = of.from_spark(t, order_by=["id"]), of.from_spark(t, order_by=["v"])
    short = of.from_spark(t.filter("id > 0"), order_by=["v"])
    monkeypatch.setattr(of.order, "with_rowid", None)
    monkeypatch.setattr(of.order, "numbered", None, raising=False)
    a["total"] = a["v"] + b["v"] * 2
    a["again"] = b["id"]
    both = of.concat([a, (a["total"] - b["id"]).rename("left")], axis=1)
    plan = both.to_spark()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (") == 3 and plan.count("row_number()") == 4, plan
    pdf = pd.DataFrame({"id": range(n), "v": [i * 37 % n for i in range(n)]})
    other = pdf.sort_values("v").reset_index(drop=True)
    pdf["total"], pdf["again"] = pdf["v"] + other["v"] * 2, other["id"]
    same(both, pdf.assign(left=pdf["total"] - other["id"]))
    for meet in (lambda: a["v"] + short["v"], lambda: short["v"] + a["v"], lambda: of.concat([a, short], axis=1)):
        with pytest.raises(ValueError, match="same rows"):
            meet()


def test_frames_meet_after_filters(df, pdf):
    """Positions that a filter or a slice has left gaps in are counted anew."""
    x, y = df[df["w"] > 0].reset_index(drop=True), df[df["w"] < 0].reset_index(drop=True)
    n = min(len(x), len(y))
    px, py = pdf[pdf["w"] > 0].reset_index(drop=True), pdf[pdf["w"] < 0].reset_index(drop=True)
    same(x.head(n)["w"] - y.head(n)["w"], px.head(n)["w"] - py.head(n)["w"])
    c, p = df.copy(), pdf.copy()
    c["x"], p["x"] = c["w"] + df.sort_values("w", ignore_index=True)["w"], p["w"] + np.sort(p["w"])
    same(c[c["k"] > 1], p[p["k"] > 1])
    same(c.head(9)["x"] + c.head(9)["w"], p.head(9)["x"] + p.head(9)["w"])
    with pytest.raises(ValueError, match="same rows"):
        df["w"] + c[c["k"] > 1]["x"]


def test_assignment(df, pdf):
    d, p = df.copy(), pdf.copy()
    for x in (d, p):
        x["new"] = x["w"] * 2
        x["v"] = 1.5
        x.insert(1, "ins", x["k"] + 1)
        del x["k"]
    same(d, p)
    for x in (d, p):
        x.loc[x["w"] > 3, "new"] = -1
        x.iloc[2:5, 0] = 7
        x.loc[8, "v"] = 99.0
        x.columns = list("abcdef")[: len(x.columns)]
    same(d, p)
    d["z"] = list(range(60))
    assert d["z"].to_pandas().tolist() == list(range(60))
    with pytest.raises(KeyError):
        d[["a", "unknown"]] = 1


def test_labels(df, pdf):
    two, ptwo = df.set_index(["k", "w"]), pdf.set_index(["k", "w"])
    key = ptwo.index[0]
    assert sorted(two.loc[int(key[0])].to_pandas()["v"].dropna()) == sorted(ptwo.loc[key[0]]["v"].dropna())
    assert df.loc[7, "w"] == pdf.loc[7, "w"] and df.iloc[-1, 2] == pdf.iloc[-1, 2] and df.at[4, "k"] == pdf.at[4, "k"] and df["w"][5] == pdf["w"][5]
    with pytest.raises(KeyError):
        df.loc[999]
    with pytest.raises(IndexError):
        df.iloc[60]
    same(df.set_axis(list(range(100, 160))), pdf.set_axis(list(range(100, 160))))


def test_equals_and_alignment(df, pdf):
    assert df.equals(of.from_pandas(pdf)) and not df.equals(df.sort_index(ascending=False)) and not df.equals(df[["k"]])
    same(df["v"] + of.from_pandas(pdf)["w"], pdf["v"] + pdf["w"])
    same(df["v"] + pdf["w"].tolist(), pdf["v"] + pdf["w"])
    with pytest.raises(ValueError):
        df["v"] + of.series([1.0, 2.0])


def test_dates_and_categories(spark):
    p = pd.Series(pd.to_datetime(["2020-02-29 13:14:15", "1969-12-31 23:59:59", None]), name="t")
    s = of.from_pandas(p)
    for f in ("year", "month", "day", "hour", "minute", "second", "weekday"):
        same(getattr(s.dt, f), getattr(p.dt, f))
    text = of.series(["2020-01-02", "bad", None])
    assert [str(x)[:10] for x in of.to_datetime(text, "%Y-%m-%d").to_pandas()] == ["2020-01-02", "NaT", "NaT"]
    assert of.series(["b", "a", None, "b"]).cat.codes.to_pandas().tolist()[:2] == [1, 0]


def test_files(df, pdf, tmp_path):
    df.to_parquet(str(tmp_path / "p"), index=False)
    back = of.read_parquet(str(tmp_path / "p"), columns=["w", "k"], order_by=["k", "w"])
    same(back, pdf[["w", "k"]].sort_values(["k", "w"], ignore_index=True))
    df[["k", "w"]].to_csv(str(tmp_path / "c"), index=False)
    same(of.read_csv(str(tmp_path / "c")), pdf[["k", "w"]], order=False)
    with pytest.raises(ValueError, match="order"):
        of.read_parquet(str(tmp_path / "p")).head()


def test_parquet_labels(spark, tmp_path):
    p = pd.DataFrame({"k": [2, 1], "v": [1.5, 2.5]}, index=pd.MultiIndex.from_tuples([("a", 1), ("b", 2)], names=["name", None]))
    of.from_spark(spark.createDataFrame(p.rename_axis(["name", "level"]).reset_index())).set_index(["name", "level"]).to_parquet(str(tmp_path / "own"))
    back = of.read_parquet(str(tmp_path / "own"), columns=["v"])
    assert back._rows.index == ("name", "level") and sorted(map(tuple, back.to_spark().collect())) == [("a", 1, 1.5), ("b", 2, 2.5)]
    p.to_parquet(tmp_path / "two.parquet")
    back = of.read_parquet(str(tmp_path / "two.parquet"))
    assert back._rows.index == ("name", None) and sorted(map(tuple, back.to_spark().collect())) == [("a", 1, 2, 1.5), ("b", 2, 1, 2.5)]
    p.reset_index(drop=True).to_parquet(tmp_path / "range.parquet")
    assert of.read_parquet(str(tmp_path / "range.parquet"))._rows.index == ()


def test_scalars(spark):
    assert of.series([True]).bool() is True and int(of.series([3])) == 3 and of.frame({"a": [1]}).squeeze() == 1
    with pytest.raises(ValueError):
        bool(of.series([1]))
    assert "a" in repr(of.frame({"a": [1, 2]})) and np.asarray(of.series([1, 2])).tolist() == [1, 2]
