"""Triple-barrier labels: which of a long and a short trade's barriers is touched first within a horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import bars_window, lag

#: Event codes (fixed values).
EVENTS = {0: "INVALID", 1: "LONG_TP", 2: "SHORT_TP", 3: "LONG_SL", 4: "SHORT_SL", 5: "BOTH_TP", 6: "BOTH_SL", 7: "AMBIGUOUS", 8: "TIMEOUT", 9: "WIDE_CANDLE"}
SCHEMA_VERSION = "1"


def event_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(EVENTS[k]) for k in sorted(EVENTS)]), code + 1)


def triple_barrier(bars: DataFrame, horizon: int = 26, tp: float = 2.4, sl: float = 1.9, exclude_both_tp: bool = True, atr: str = "atr") -> DataFrame:
    """Bars that have an ``atr``, with event_code, target, event_bar_pos, entry_price, exit_price, atr_value, is_valid, event_type.

    Entry is the next bar's open; barriers lie ``tp`` and ``sl`` times the range measure away; each leg ends at its
    first touch within ``horizon`` bars. Positions count the rows that have an ``atr``. The last
    ``horizon`` bars of a symbol can't be decided and are left out. The look ahead is one bounded frame.
    """
    w = bars_window()
    own = bars.where(F.col(atr).isNotNull())
    ahead = F.collect_list(F.struct("high", "low", "close")).over(w.rowsBetween(1, horizon))
    own = own.withColumns({"_entry": lag("open", -1), "_path": ahead, "_pos": F.row_number().over(w) - 1}).where(F.size("_path") == horizon)
    e, up, down = F.col("_entry"), F.col(atr) * tp, F.col(atr) * sl

    def leg(high: Column, low: Column) -> Column:
        """First bar (from 1, else 0) that reaches a leg's upper or lower barrier."""
        return F.array_position(F.transform("_path", lambda b: (b["high"] >= high) | (b["low"] <= low)), True).cast("int")

    broken = F.array_position(F.transform("_path", lambda b: b["high"].isNull() | b["low"].isNull()), True)
    own = own.withColumns({"_l": leg(e + up, e - down), "_s": leg(e + down, e - up), "_broken": broken})
    bar = lambda at: F.get("_path", F.col(at) - 1)
    lhit, shit = bar("_l"), bar("_s")
    code = lambda at, good, bad: F.when(F.col(at) == 0, 0).when(good & bad, -2).when(good, 1).otherwise(-1)
    own = own.withColumns({"_lc": code("_l", lhit["high"] >= e + up, lhit["low"] <= e - down), "_sc": code("_s", shit["low"] <= e - up, shit["high"] >= e + down)})
    first = F.get("_path", F.lit(0))
    fine = e.isNotNull() & (e > 0) & (F.col(atr) > 0)
    wide = fine & (first["high"] - first["low"] >= 2 * down)
    done = (F.col("_l") > 0) & (F.col("_s") > 0)
    cut = (F.col("_broken") > 0) & (~done | (F.col("_broken") <= F.greatest("_l", "_s")))
    lc, sc = F.col("_lc"), F.col("_sc")
    event = (
        F.when(wide, 9).when(~fine | e.isNull() | cut, 0)
        .when((lc == 1) & (sc != 1), 1).when((sc == 1) & (lc != 1), 2).when((lc == 1) & (sc == 1), 5)
        .when((lc == -2) | (sc == -2), 7).when((lc == -1) & (sc == -1), 6).when((lc == -1) & (sc == 0), 3).when((sc == -1) & (lc == 0), 4).otherwise(8)
    )
    own = own.withColumn("event_code", event.cast("tinyint"))
    k = F.col("event_code")
    target = F.when(k == 1, 1.0).when(k == 2, -1.0).when(k == 5, -99.0 if exclude_both_tp else 1.0).when(k.isin(6, 9), -99.0).when(k.isin(3, 4, 7, 8), 0.0)
    both = F.when(done, F.least("_l", "_s")).otherwise(F.greatest("_l", "_s"))
    at = F.when(k == 9, 1).when(k.isin(1, 3), F.col("_l")).when(k.isin(2, 4), F.col("_s")).when(k.isin(5, 6, 7), both).when(k == 8, horizon)
    left = F.when(k == 1, e + up).when(k == 2, e - up).when(k == 3, e - down).when(k == 4, e + down).when(k == 6, F.when(F.col("_l") <= F.col("_s"), e - down).otherwise(e + down)).when(k == 8, F.element_at("_path", -1)["close"])
    own = own.withColumns(
        {
            "target": target.cast("float"),
            "event_bar_pos": (F.col("_pos") + at).cast("long"),
            "entry_price": F.when(k > 0, e),
            "exit_price": left,
            "atr_value": F.when(k > 0, F.col(atr)),
            "is_valid": k > 0,
            "event_type": event_name(k.cast("int")),
            "target_schema_version": F.lit(SCHEMA_VERSION),
            "pos": F.col("_pos").cast("long"),
        }
    )
    return own.drop(*[c for c in own.columns if c.startswith("_")])


def training_rows(labels: DataFrame) -> DataFrame:
    """Rows to learn from: valid, neither excluded nor undecided."""
    return labels.where("is_valid and target <> -99 and target <> 0")


def event_mix(labels: DataFrame) -> DataFrame:
    """symbol, event_type, n, share, and whether double stops are more than 15 % of the symbol's valid rows."""
    by = labels.where("is_valid").groupBy("symbol", "event_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("symbol"))
    share = F.col("n") / total
    return by.select("symbol", "event_type", "n", share.alias("share"), ((F.col("event_type") == "BOTH_SL") & (share > 0.15)).alias("many_double_stops"))
