"""Queries of sources and sinks: tables are written by a sink, read by a source, and held against SQL over the tables they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.series import lag
from ..sources import bars as src
from ..sources import sinks
from ..sources.store import folder
from .base import WITH, bars, q, query, shown

PRICES = ("open", "high", "low", "close")


def place(spark, name: str) -> str:
    return f"{folder(spark)}/files/{name}-{uuid.uuid4().hex}"


def raw(spark, sf):
    return bars(spark, sf).select("symbol", "ts", *PRICES, F.col("volume").cast("double").alias("volume"))


ROWS = ", ".join(f"{q(x)} AS {x}" for x in (*PRICES, "volume::DOUBLE"))
ROWS = ROWS.replace("AS volume::DOUBLE", "AS volume")


@query(f"{WITH} SELECT 'file' AS symbol, ts, {ROWS} FROM bars")
def source_csv(spark, sf):
    """Bars out to a headed file and back; of several paths the first that is there is read."""
    path = place(spark, "csv")
    sinks.write_csv(raw(spark, sf).drop("symbol").withColumnRenamed("ts", "DateTime"), path)
    return shown(src.scan_bars(spark, [path + "-none", path]), *PRICES, "volume")


@query(f"{WITH} SELECT 'file' AS symbol, ts, {ROWS.replace('volume::DOUBLE', 'CASE WHEN volume = 1 THEN NULL ELSE volume END::DOUBLE')} FROM bars")
def source_fuzzy(spark, sf):
    """Columns that only resemble the names, and numbers that are none."""
    path = place(spark, "fuzzy")
    b = raw(spark, sf)
    volume = F.when(F.col("volume") == 1, "one").otherwise(F.col("volume").cast("string"))
    sinks.write_csv(b.select(F.col("ts").alias("Bar TimeStamp"), F.col("open").alias("Open price"), F.col("high").alias(" HIGH"), F.col("low").alias("the_low"), F.col("close").alias("Close"), volume.alias("Vol")), path)
    return shown(src.fuzzy_scan(src.read_csv(spark, path)), *PRICES, "volume")


@query(f"{WITH} SELECT symbol, ts + INTERVAL 330 MINUTE AS ts, {q('close')} AS close FROM bars")
def source_localized(spark, sf):
    """Instants become the wall time of a zone."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    b = raw(spark, sf).select("symbol", F.timestamp_seconds(seconds).alias("timestamp"), "close")
    return shown(src.localized(b), "close")


@query(f"{WITH} SELECT symbol, ts, {', '.join(f'{q(x)} AS {x}' for x in PRICES)} FROM bars")
def source_parquet(spark, sf):
    """A partitioned table without one of its columns, read under a check of those it must have."""
    path = place(spark, "parquet")
    sinks.write_parquet(raw(spark, sf), path, drop=("volume",), partition_by=("symbol",))
    return shown(src.read_checked(spark, path, ["symbol", "ts", *PRICES]), *PRICES)


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def sink_csv(spark, sf):
    path = place(spark, "nation")
    sinks.write_csv(spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"), path)
    return src.read_csv(spark, path)


COUNTS = "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"


def segments(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(COUNTS)
def sink_json(spark, sf):
    """A report's section, written as JSON and read again."""
    path = place(spark, "json")
    sinks.write_json({"Segments": segments(spark, sf)}, path)
    return spark.read.json(path).select(F.inline("Segments")).select("c_mktsegment", "n")


@query(f"SELECT '| ' || c_mktsegment || ' | ' || n || ' |' AS line FROM ({COUNTS}) UNION ALL SELECT unnest(['## Segments', '', '| c_mktsegment | n |', '|-|-|', '']) AS line")
def sink_markdown(spark, sf):
    path = place(spark, "text")
    sinks.write_markdown({"Segments": segments(spark, sf)}, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT TIMESTAMP '2020-01-01 09:15:00' + to_days((i // 13)::INT) + to_minutes((i % 13) * 30) AS ts, true AS sound FROM range(10000) t(i)")
def source_synthetic(spark, sf):
    """Times of synthetic bars, and whether each opens at the last close and holds its close in its range."""
    b = src.synthetic_bars(spark)
    sound = (F.col("high") >= F.col("close")) & (F.col("close") >= F.col("low")) & (F.col("low") > 0) & (F.col("open") == F.coalesce(lag("close"), F.lit(100.0)))
    return b.select("ts", sound.alias("sound"))
