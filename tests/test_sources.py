import pytest
from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.operators import indicators as ind
from barloom.sources import bars as src
from barloom.sources import sinks
from barloom.streaming.bars import streaming_bars, write_bars


def test_csv_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DateTime,Open,High,Low,Close\n2024-01-01 10:00:00,1,3,1,2\n2024-01-01 09:00:00,1,2,1,2\n")
    df = src.scan_bars(spark, [str(tmp_path / "none.csv"), str(tmp_path / "a.csv")])
    assert df.orderBy("ts").select("high").collect()[0][0] == 2.0
    with pytest.raises(FileNotFoundError):
        src.scan_bars(spark, [str(tmp_path / "none.csv")])


def test_fuzzy_scan(spark):
    df = spark.createDataFrame([("2024-01-01", "1", "x", "1", "2", "5")], "`trade date` string, `Open Price` string, high string, low string, close string, vol string")
    row = src.fuzzy_scan(df).first()
    assert (row["open"], row["high"], row["volume"], str(row["ts"])) == (1.0, None, 5.0, "2024-01-01 00:00:00")
    with pytest.raises(ValueError):
        src.fuzzy_scan(df.drop("close"))


def test_localized(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("bad",)], "date string")
    assert [str(r["ts"]) for r in src.localized(df).collect()] == ["2024-01-01 10:00:00"]
    aware = spark.sql("select timestamp'2024-01-01 00:00:00 UTC' as timestamp")
    assert str(src.localized(aware).first()["ts"]) == "2024-01-01 05:30:00"


def test_checked_parquet_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "f", "p")], "fold int, formula string, program string")
    sinks.write_parquet(df, str(tmp_path / "w"), drop=("formula", "program"))
    assert src.read_checked(spark, str(tmp_path / "w"), ["fold"]).columns == ["fold"]
    with pytest.raises(ValueError):
        src.read_checked(spark, str(tmp_path / "w"), ["fold", "regime"])
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    sinks.write_json({"a": df}, str(tmp_path / "j"))
    assert '"fold": 1' in spark.read.text(str(tmp_path / "j")).first()[0]
    sinks.write_markdown({"a": df}, str(tmp_path / "m"))
    assert "| fold | formula | program |" in sinks.markdown({"a": df})


def test_synthetic_bars(spark):
    df = src.synthetic_bars(spark, 400)
    assert df.count() == 400 and df.where("high < low or close <= 0 or hour(ts) < 9 or hour(ts) > 15").count() == 0


def test_bad_symbols_are_left_out(spark):
    rows = [("a", 1, 1.0, 2.0, 1.0, 1.5), ("b", 1, 1.0, 1.0, 2.0, 1.5), ("c", 1, -1.0, 2.0, 1.0, 1.5)]
    df = spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double")
    assert [r["symbol"] for r in src.valid_bars(df).collect()] == ["a"]


def test_wide_to_long_and_tensor(spark):
    wide = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None)], "ts int, a double, b double")
    long = src.wide_to_long(wide)
    assert long.count() == 3
    t = ft.feature_tensor(long, ["close"]).collect()
    assert len(t) == 1 and t[0]["x"] == [[1.0], [2.0]]


def test_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    q = write_bars(streaming_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = src.bars_from_events(events)
    both = got.select("symbol", F.to_timestamp_ntz("ts").alias("ts"), "open", "close", "volume").join(want.select("symbol", "ts", "open", "close", "volume"), ["symbol", "ts", "open", "close", "volume"])
    assert got.count() > 0.9 * want.count() and both.count() == got.count()


def test_causal_features_do_not_look_ahead(spark, sf):
    bars = src.hourly_bars(spark, sf).where("symbol = 'click'")
    cut = bars.where("ts < timestamp_ntz'2024-01-20'")
    p = ft.Profile(**{**ft.SHORT.__dict__, "causal": True})
    cols = [c for c in ft.build(cut, p).columns]
    a, b = (ft.build(x, p).where("ts < timestamp_ntz'2024-01-20'").select("ts", *[F.round(c, 8).alias(c) for c in cols if c not in ("symbol", "ts")]) for x in (bars, cut))
    assert a.exceptAll(b).count() == 0


def test_walks_are_bounded(spark, sf):
    df = ind.walks(src.hourly_bars(spark, sf)).toPandas()
    assert df["ta_kama"].notna().any() and df["ta_sar"].notna().any()
    ok = df.dropna(subset=["ta_ht_dcperiod"])
    assert ((ok["ta_ht_dcperiod"] >= 0) & (ok["ta_ht_dcperiod"] <= 50)).all() and set(df["ta_ht_trendmode"].dropna()) <= {0.0, 1.0}
    for _, g in df.groupby("symbol"):
        assert (g["ta_kama"].dropna() <= g["close"].max()).all()
