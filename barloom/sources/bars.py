"""Bar tables from events and files, and checks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import bars_window

PRICES = ["open", "high", "low", "close"]


def bars_from_events(events: DataFrame, width: str = "1 hour", symbol: str = "event_type", value: str = "value", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """symbol, ts, open, high, low, close, volume: one bar per symbol and time window with events of positive value."""
    order = F.struct(ts, tie)
    kept = events.select(F.col(symbol).alias("symbol"), ts, tie, value).where(F.col(value) > 0)
    bars = kept.groupBy("symbol", F.window(ts, width).alias("_w")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("volume")
    )
    return bars.select("symbol", F.col("_w.start").alias("ts"), *PRICES, "volume")


def hourly_bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    return bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), width)


def read_csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A headed file with text columns under lower-case names; of several paths the first that is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in [paths] if isinstance(paths, str) else paths:
        path = hadoop(p)
        if path.getFileSystem(conf).exists(path):
            df = spark.read.option("header", True).csv(p)
            return df.toDF(*[x.strip().lower() for x in df.columns])
    raise FileNotFoundError(f"none of {paths} is there")


def scan_bars(spark: SparkSession, paths: list[str] | str, symbol: str = "file") -> DataFrame:
    """Bars of a file with a ``datetime`` or ``date`` column."""
    df = read_csv(spark, paths)
    time = next((x for x in ("datetime", "date") if x in df.columns), None)
    if time is None or any(p not in df.columns for p in PRICES):
        raise ValueError(f"no time or price column among {df.columns}")
    volume = F.expr("try_cast(volume as double)") if "volume" in df.columns else F.lit(None).cast("double")
    return df.select(F.lit(symbol).alias("symbol"), F.to_timestamp_ntz(F.col(time)).alias("ts"), *[F.col(p).cast("double") for p in PRICES], volume.alias("volume"))


#: Names that a column may go by, in order of preference (fixed values).
ALIASES = {"ts": ["datetime", "timestamp", "date", "time"], "open": ["open"], "high": ["high"], "low": ["low"], "close": ["close"], "volume": ["volume", "vol"]}


def resolve(columns: list[str], wanted: list[str]) -> str | None:
    """The column that equals a wanted name, else the first that holds one."""
    low = {x.lower().strip(): x for x in columns}
    for name in wanted:
        if name in low:
            return low[name]
    return next((low[x] for name in wanted for x in low if name in x), None)


def fuzzy_scan(df: DataFrame, symbol: Column | None = None) -> DataFrame:
    """Bars of a text table whose columns only resemble the names; what is no number becomes NULL, and rows without any time are numbered."""
    found = {k: resolve(df.columns, names) for k, names in ALIASES.items()}
    if missing := [p for p in PRICES if found[p] is None]:
        raise ValueError(f"no column for {missing}")
    number = lambda x: F.expr(f"try_cast(`{x}` as double)") if x else F.lit(None).cast("double")
    cols = [number(found[p]).alias(p) for p in [*PRICES, "volume"]]
    time = F.expr(f"try_cast(`{found['ts']}` as timestamp_ntz)") if found["ts"] else F.lit(None).cast("timestamp_ntz")
    out = df.select((symbol if symbol is not None else F.lit("file")).alias("symbol"), time.alias("ts"), *cols)
    if found["ts"] is None:
        out = out.withColumn("row", F.monotonically_increasing_id())
    return out


def localized(df: DataFrame, zone: str = "Asia/Kolkata", time: str | None = None) -> DataFrame:
    """``ts`` as the session zone's wall time: naive times are taken as they are, others are converted; what can't be read is dropped."""
    name = time or next(x for x in ("timestamp", "date", "ts") if x in df.columns)
    kind = dict(df.dtypes)[name]
    if kind == "timestamp":
        ts = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(F.to_utc_timestamp(F.col(name), F.current_timezone())))
    elif kind == "timestamp_ntz":
        ts = F.col(name)
    else:
        ts = F.expr(f"try_cast(`{name}` as timestamp_ntz)")
    return df.withColumn("ts", ts).where(F.col("ts").isNotNull())


def read_checked(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A parquet table that must have the columns named."""
    df = spark.read.parquet(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path} lacks {missing}")
    return df


def validate(bars: DataFrame) -> DataFrame:
    """A row per symbol: n, and the faults that make it unfit (errors) or doubtful (warnings)."""
    bad = F.greatest(*[F.when(F.col(p) <= 0, 1).otherwise(0) for p in PRICES])
    some = [F.count("*").alias("n"), F.count("close").alias("n_close"), F.sum(bad).alias("not_positive"), F.count_if(F.col("high") < F.col("low")).alias("high_below_low")]
    some += [F.count_if((F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))).alias("close_outside"), F.count_if(F.expr(" or ".join(f"{p} is null" for p in PRICES))).alias("missing")]
    out = bars.groupBy("symbol").agg(*some)
    error = F.when(F.col("n_close") == 0, "no prices").when(F.col("not_positive") > 0, "prices not positive").when(F.col("high_below_low") > 0, "high below low")
    warning = F.concat_ws("; ", F.when(F.col("close_outside") > 0, "close outside range"), F.when(F.col("missing") > 0, "missing values"))
    return out.withColumns({"error": error, "warning": warning})


def valid_bars(bars: DataFrame) -> DataFrame:
    """Bars of the symbols without errors; one symbol's fault never stops the others."""
    return bars.join(validate(bars).where("error is not null").select("symbol"), "symbol", "left_anti")


def wide_to_long(prices: DataFrame, time: str = "ts") -> DataFrame:
    """A column per symbol becomes rows symbol, ts, close."""
    names = [x for x in prices.columns if x != time]
    return prices.unpivot([time], names, "symbol", "close").select("symbol", F.col(time).alias("ts"), "close").where("close is not null")


def synthetic_bars(spark: SparkSession, n: int = 10_000, seed: int = 42, drift: float = 0.0002, noise: float = 0.015, start: float = 100.0, symbol: str = "gbm") -> DataFrame:
    """Geometric Brownian bars of half an hour within the session 09:15 to 15:15, thirteen a day."""
    i = F.col("id")
    day, slot = F.floor(i / 13), i % 13
    ts = F.to_timestamp_ntz(F.lit("2020-01-01 09:15:00")) + F.make_dt_interval(day.cast("int"), F.lit(0), (slot * 30).cast("int"))
    raw = spark.range(n).select(F.lit(symbol).alias("symbol"), "id", ts.alias("ts"), (F.randn(seed) * noise + (drift - noise * noise / 2)).alias("r"), (F.abs(F.randn(seed + 1)) * 0.003).alias("up"), (F.abs(F.randn(seed + 2)) * 0.003).alias("down"))
    w = bars_window()
    close = raw.withColumn("close", F.lit(start) * F.exp(F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return close.select("symbol", "ts", F.coalesce(F.lag("close").over(w), F.lit(start)).alias("open"), (F.col("close") * (1 + F.col("up"))).alias("high"), (F.col("close") * (1 - F.col("down"))).alias("low"), "close")


BAR_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(p, T.DoubleType()) for p in PRICES], T.StructField("volume", T.LongType())])
