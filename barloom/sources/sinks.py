"""Sinks of results: tables as parquet or CSV, small reports as JSON, Markdown or text."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, drop: tuple[str, ...] = (), partition_by: tuple[str, ...] = ()) -> None:
    out = df.drop(*drop).write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text into any store that Spark writes to."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def rows(df: DataFrame, most: int = 1000) -> list[dict]:
    """Rows of a small summary; a larger one is an error, not a report."""
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows")
    return [r.asDict(recursive=True) for r in got]


def write_json(sections: Mapping[str, DataFrame], path: str) -> None:
    spark = next(iter(sections.values())).sparkSession
    write_text(spark, json.dumps({k: rows(v) for k, v in sections.items()}, default=str), path)


def markdown(sections: Mapping[str, DataFrame]) -> str:
    out = []
    for title, df in sections.items():
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if x is None else str(x) for x in r.values()) + " |" for r in rows(df)] + [""]
    return "\n".join(out)


def write_markdown(sections: Mapping[str, DataFrame], path: str) -> None:
    write_text(next(iter(sections.values())).sparkSession, markdown(sections), path)
