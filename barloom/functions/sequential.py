"""Operators that must walk a symbol's rows in order: state machines over sorted partitions.

A symbol's rows stream through one task in batches, and only the machine's own bounded state is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def walk(df: DataFrame, machine: Callable[[], Callable[..., tuple]], inputs: list[str], outputs: str, keep: list[str] | None = None, key: str = "symbol", order: str = "ts") -> DataFrame:
    """``keep`` columns of ``df`` with the outputs of ``machine()``, made anew for each symbol and called on each row's inputs.

    Missing inputs arrive as None.
    """
    keep = keep or df.columns
    kinds = dict(df.dtypes)
    names = [x.split()[0] for x in outputs.split(",")]
    columns = list(dict.fromkeys([key, *keep, *inputs]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = None, None
        for pdf in batches:
            rows = zip(pdf[key].tolist(), *[pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in inputs])
            out = []
            for k, *values in rows:
                if step is None or k != at:
                    at, step = k, machine()
                out.append(step(*values))
            made = pd.DataFrame(out, columns=names, index=pdf.index)
            yield pd.concat([pdf[keep], made], axis=1)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + outputs
    return df.select(*columns).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)
