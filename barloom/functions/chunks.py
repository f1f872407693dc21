"""Bounded frames over one long series in many tasks.

A window by symbol puts a symbol's rows in one task. Rows are numbered in two steps instead: counts per symbol and stretch of time add up to where each
stretch begins, and rows are numbered within their stretch. Chunks of numbers then go to tasks of their own, each with as many rows
of its neighbours as the frames reach, and these rows are left out again afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


def indexed(df: DataFrame, name: str = "_i", stretch: str = "30 days") -> DataFrame:
    """Rows numbered from 0 in order of time within their symbol, without a sort of the whole symbol in one task."""
    own = df.withColumn("_stretch", F.window("ts", stretch)["start"])
    before = own.groupBy("symbol", "_stretch").agg(F.count("*").alias("_k"))
    before = before.withColumn("_before", F.coalesce(F.sum("_k").over(Window.partitionBy("symbol").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("symbol", "_stretch").orderBy("ts")) - 1
    return own.withColumn(name, place).join(before.drop("_k"), ["symbol", "_stretch"]).withColumn(name, F.col(name) + F.col("_before")).drop("_stretch", "_before")


def placed(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows with their place (from 1) in a total order: partitions are sorted by ranges, each counts its own rows, and the counts of those before add up."""
    own = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sums = own.groupBy("_part").agg(F.count("*").alias("_k"), F.min("_id").alias("_first"))  # a row for each partition
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = own.join(F.broadcast(sums.select("_part", "_first", before.alias("_before"))), "_part")
    return out.withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1).drop("_part", "_id", "_first", "_before")


def by_chunks(df: DataFrame, f: Callable[[DataFrame], DataFrame], lookback: int, ahead: int = 0, rows: int = 200_000, stretch: str = "30 days") -> DataFrame:
    """f(df) for an ``f`` whose frames, by symbol and time, reach at most ``lookback`` rows back and ``ahead`` rows on, and which keeps the columns it gets.

    To ``f`` a chunk is a symbol of its own. With ``rows`` well over the reach, few rows are read twice.
    """
    if rows <= max(lookback, ahead):
        raise ValueError("a chunk must be longer than the frames reach")
    own = indexed(df, "_i", stretch)
    chunk = F.floor(F.col("_i") / rows)
    first, last = F.greatest(F.floor((F.col("_i") - ahead) / rows), F.lit(0)), F.floor((F.col("_i") + lookback) / rows)
    dealt = own.withColumn("_of", F.explode(F.sequence(first, last))).withColumns({"_own": F.col("_of") == chunk, "_symbol": F.col("symbol")})
    out = f(dealt.withColumn("symbol", F.concat_ws("\x1f", F.col("_of").cast("string"), F.col("symbol"))).drop("_of", "_i"))
    return out.where("_own").withColumn("symbol", F.col("_symbol")).drop("_own", "_symbol")
