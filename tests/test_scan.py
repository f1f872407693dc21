import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions import scan


def frame(spark, x, symbol="s"):
    rows = [(symbol, i, None if v is None else float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts int, x double")


def out(df, c="y"):
    return df.orderBy("ts").toPandas()[c].to_numpy(float)


def test_affine_over_blocks(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(-1, 1, 1000), rng.normal(size=1000)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "ts": range(1000), "a": a, "b": b}))
    want, y = [], 0.0
    for p, q in zip(a, b):
        y = p * y + q
        want.append(y)
    for block in (1, 2, 7, 128, 5000):
        got = scan.affine_scan(df, {"y": (F.col("a"), F.col("b"))}, block=block)
        np.testing.assert_allclose(out(got), want, atol=1e-12)


def test_seeded_carries_over_gaps(spark):
    x = [None, 1.0, None, 3.0, 5.0, None, 2.0]
    got = out(scan.seeded_ewma(frame(spark, x), {"y": ("x", 0.5, 2)}))
    np.testing.assert_allclose(got, [np.nan, np.nan, np.nan, 2.0, 3.5, 3.5, 2.75])


def test_seeded_short_series_is_null(spark):
    assert np.isnan(out(scan.seeded_ewma(frame(spark, [1.0, 2.0]), {"y": ("x", 0.5, 5)}))).all()


def test_ewm_as_pandas(spark):
    x = np.random.default_rng(1).normal(size=600)
    df = frame(spark, x)
    np.testing.assert_allclose(out(scan.ewm(df, {"y": ("x", 0.1)}, adjust=True)), pd.Series(x).ewm(alpha=0.1).mean(), atol=1e-10)
    np.testing.assert_allclose(out(scan.ewm(df, {"y": ("x", 0.1)}, adjust=False, least=3)), pd.Series(x).ewm(alpha=0.1, adjust=False, min_periods=3).mean(), atol=1e-10)


def test_symbols_are_apart_and_columns_stay(spark):
    df = frame(spark, [1, 2, 3]).union(frame(spark, [10, 20, 30], "t")).withColumn("more", F.lit("m"))
    got = scan.ewm(df, {"y": ("x", 0.5)}, adjust=False)
    assert set(got.columns) == {"symbol", "ts", "x", "more", "y"}
    assert out(got.where("symbol = 't'")).tolist() == [10.0, 15.0, 22.5]


def test_null_symbols_are_one_series_and_columns_may_clash(spark):
    df = frame(spark, [1, 2, 3], None).union(frame(spark, [4], "t")).withColumn("_x", F.lit(1))
    got = scan.ewm(df, {"y": ("x", 0.5)}, adjust=False)
    assert out(got.where("symbol IS NULL")).tolist() == [1.0, 1.5, 2.25] and got.count() == 4 and "_x" in got.columns


def test_empty_series(spark):
    assert scan.seeded_ewma(frame(spark, []), {"y": ("x", 0.5, 2)}).count() == 0


def test_quantiles(spark):
    from barloom.functions.series import quantile

    df = spark.createDataFrame([(float(i),) for i in range(1, 5)], "x double")
    assert df.agg(quantile("x", 0.75)).first()[0] == 3.25 and df.agg(quantile("x", 0.75, exact=False)).first()[0] == 3.0
