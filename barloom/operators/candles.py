"""Candle patterns as conditions over the last five bars.

Rules are SQL conditions over columns with the bar's distance as suffix (0 is the current bar): prices o h l c, colour g (1 or -1),
body b, shadows u (upper) and d (lower), range r; averages of the bars before give: L long body, S short body, D doji, V and Y
no upper or lower shadow to speak of, us and ds short upper and lower shadow, and the distances n (near), f (far) and e (equal).
A rule gives 1, -1, or the sign of an expression; a pattern is NULL until its averages are full.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import bars_window

BARS = 5
PARTS = ["o", "h", "l", "c", "g", "b", "u", "d", "r", "L", "S", "D", "V", "Y", "us", "ds", "n", "f", "e"]


#: Spark's names don't tell cases apart, so the flags get longer ones there.
FLAGS = {"L": "lg", "S": "sm", "D": "dj", "V": "vu", "Y": "vl"}


def hi(k: int) -> str:
    return f"greatest(o{k}, c{k})"


def lo(k: int) -> str:
    return f"least(o{k}, c{k})"


def up(k: int, j: int) -> str:
    """The body of bar k lies over that of bar j."""
    return f"{lo(k)} > {hi(j)}"


def down(k: int, j: int) -> str:
    return f"{hi(k)} < {lo(j)}"


def white(*k: int) -> str:
    return " AND ".join(f"g{i} = 1" for i in k)


def black(*k: int) -> str:
    return " AND ".join(f"g{i} = -1" for i in k)


def inside(k: int, j: int) -> str:
    return f"{hi(k)} < {hi(j)} AND {lo(k)} > {lo(j)}"


def opens_in(k: int) -> str:
    """Bar k opens over the last open and not far over the last close."""
    return f"o{k} > o{k + 1} AND o{k} <= c{k + 1} + n{k + 1}"


RISING, FALLING = "c0 > c1 AND c1 > c2", "c0 < c1 AND c1 < c2"
SOLID = "L1 AND V1 AND Y1 AND L0 AND V0 AND Y0"
KICK = f"g1 = -g0 AND {SOLID} AND (g1 = -1 AND l0 > h1 OR g1 = 1 AND h0 < l1)"

#: name -> list of (condition, value).
RULES: dict[str, list[tuple[str, str]]] = {
    "2crows": [(f"{white(2)} AND L2 AND {black(1, 0)} AND {up(1, 2)} AND o0 < o1 AND o0 > c1 AND c0 > o2 AND c0 < c2", "-1")],
    "3blackcrows": [(f"{white(3)} AND {black(2, 1, 0)} AND Y2 AND Y1 AND Y0 AND o1 < o2 AND o1 > c2 AND o0 < o1 AND o0 > c1 AND h3 > c2 AND {FALLING}", "-1")],
    "3inside": [(f"L2 AND S1 AND {inside(1, 2)} AND {white(2)} AND {black(0)} AND c0 < o2", "-1"), (f"L2 AND S1 AND {inside(1, 2)} AND {black(2)} AND {white(0)} AND c0 > o2", "1")],
    "3linestrike": [
        (f"g3 = g2 AND g2 = g1 AND g0 = -g1 AND o2 >= {lo(3)} - n3 AND o2 <= {hi(3)} + n3 AND o1 >= {lo(2)} - n2 AND o1 <= {hi(2)} + n2 AND (g1 = 1 AND c1 > c2 AND c2 > c3 AND o0 > c1 AND c0 < o3 OR g1 = -1 AND c1 < c2 AND c2 < c3 AND o0 < c1 AND c0 > o3)", "g1")
    ],
    "3outside": [(f"{white(1)} AND {black(2)} AND c1 > o2 AND o1 < c2 AND c0 > c1", "1"), (f"{black(1)} AND {white(2)} AND o1 > c2 AND c1 < o2 AND c0 < c1", "-1")],
    "3starsinsouth": [(f"{black(2, 1, 0)} AND L2 AND d2 > b2 AND b1 < b2 AND o1 > c2 AND o1 <= h2 AND l1 < c2 AND l1 >= l2 AND NOT Y1 AND S0 AND V0 AND Y0 AND l0 > l1 AND h0 < h1", "1")],
    "3whitesoldiers": [(f"{white(2, 1, 0)} AND V2 AND V1 AND V0 AND {RISING} AND {opens_in(1)} AND {opens_in(0)} AND b1 > b2 - f2 AND b0 > b1 - f1 AND NOT S0", "1")],
    "abandonedbaby": [(f"L2 AND D1 AND NOT S0 AND {white(2)} AND {black(0)} AND c0 < c2 - b2 * 0.3 AND l1 > h2 AND h0 < l1", "-1"), (f"L2 AND D1 AND NOT S0 AND {black(2)} AND {white(0)} AND c0 > c2 + b2 * 0.3 AND h1 < l2 AND l0 > h1", "1")],
    "advanceblock": [
        (f"{white(2, 1, 0)} AND {RISING} AND {opens_in(1)} AND {opens_in(0)} AND L2 AND us2 AND (b1 < b2 - f2 AND b0 < b1 + n1 OR b0 < b1 - f1 OR b0 < b1 AND b1 < b2 AND (NOT us0 OR NOT us1) OR b0 < b1 AND u0 > b0)", "-1")
    ],
    "belthold": [("L0 AND (g0 = 1 AND Y0 OR g0 = -1 AND V0)", "g0")],
    "breakaway": [
        (f"L4 AND g4 = g3 AND g3 = g1 AND g1 = -g0 AND g4 = -1 AND {down(3, 4)} AND h2 < h3 AND l2 < l3 AND h1 < h2 AND l1 < l2 AND c0 > o3 AND c0 < c4", "1"),
        (f"L4 AND g4 = g3 AND g3 = g1 AND g1 = -g0 AND g4 = 1 AND {up(3, 4)} AND h2 > h3 AND l2 > l3 AND h1 > h2 AND l1 > l2 AND c0 < o3 AND c0 > c4", "-1"),
    ],
    "closingmarubozu": [("L0 AND (g0 = 1 AND V0 OR g0 = -1 AND Y0)", "g0")],
    "concealbabyswall": [(f"{black(3, 2, 1, 0)} AND V3 AND Y3 AND V2 AND Y2 AND {down(1, 2)} AND NOT V1 AND h1 > c2 AND h0 > h1 AND l0 < l1", "1")],
    "counterattack": [("g1 = -g0 AND L1 AND L0 AND abs(c0 - c1) <= e1", "g0")],
    "darkcloudcover": [(f"{white(1)} AND L1 AND {black(0)} AND o0 > h1 AND c0 > o1 AND c0 < c1 - b1 * 0.5", "-1")],
    "doji": [("D0", "1")],
    "dojistar": [(f"L1 AND D0 AND (g1 = 1 AND {up(0, 1)} OR g1 = -1 AND {down(0, 1)})", "-g1")],
    "dragonflydoji": [("D0 AND V0 AND NOT Y0", "1")],
    "engulfing": [("g0 = 1 AND g1 = -1 AND (c0 >= o1 AND o0 < c1 OR c0 > o1 AND o0 <= c1)", "1"), ("g0 = -1 AND g1 = 1 AND (o0 >= c1 AND c0 < o1 OR o0 > c1 AND c0 <= o1)", "-1")],
    "eveningdojistar": [(f"L2 AND {white(2)} AND D1 AND {up(1, 2)} AND NOT S0 AND {black(0)} AND c0 < c2 - b2 * 0.3", "-1")],
    "eveningstar": [(f"L2 AND {white(2)} AND S1 AND {up(1, 2)} AND NOT S0 AND {black(0)} AND c0 < c2 - b2 * 0.3", "-1")],
    "gapsidesidewhite": [
        (f"{up(1, 2)} AND {up(0, 2)} AND {white(1, 0)} AND abs(b0 - b1) <= n1 AND abs(o0 - o1) <= e1", "1"),
        (f"{down(1, 2)} AND {down(0, 2)} AND {white(1, 0)} AND abs(b0 - b1) <= n1 AND abs(o0 - o1) <= e1", "-1"),
    ],
    "gravestonedoji": [("D0 AND Y0 AND NOT V0", "1")],
    "hammer": [(f"S0 AND d0 > b0 AND V0 AND {lo(0)} <= l1 + n1", "1")],
    "hangingman": [(f"S0 AND d0 > b0 AND V0 AND {lo(0)} >= h1 - n1", "-1")],
    "harami": [(f"L1 AND S0 AND {inside(0, 1)}", "-g1")],
    "haramicross": [(f"L1 AND D0 AND {inside(0, 1)}", "-g1")],
    "highwave": [("S0 AND u0 > 2 * b0 AND d0 > 2 * b0", "g0")],
    "homingpigeon": [(f"{black(1, 0)} AND L1 AND S0 AND o0 < o1 AND c0 > c1", "1")],
    "identical3crows": [(f"{black(2, 1, 0)} AND Y2 AND Y1 AND Y0 AND {FALLING} AND abs(o1 - c2) <= e2 AND abs(o0 - c1) <= e1", "-1")],
    "inneck": [(f"{black(1)} AND L1 AND {white(0)} AND o0 < l1 AND c0 <= c1 + e1 AND c0 >= c1", "-1")],
    "invertedhammer": [(f"S0 AND u0 > b0 AND Y0 AND {down(0, 1)}", "1")],
    "kicking": [(KICK, "g0")],
    "kickingbylength": [(f"{KICK} AND b0 > b1", "g0"), (f"{KICK} AND b0 <= b1", "g1")],
    "ladderbottom": [(f"{black(4, 3, 2)} AND o4 > o3 AND o3 > o2 AND c4 > c3 AND c3 > c2 AND {black(1)} AND NOT V1 AND {white(0)} AND o0 > o1 AND c0 > h1", "1")],
    "longleggeddoji": [("D0 AND (d0 > b0 OR u0 > b0)", "1")],
    "longline": [("L0 AND us0 AND ds0", "g0")],
    "marubozu": [("L0 AND V0 AND Y0", "g0")],
    "matchinglow": [(f"{black(1, 0)} AND abs(c0 - c1) <= e1", "1")],
    "mathold": [
        (f"L4 AND S3 AND S2 AND S1 AND L0 AND {white(4)} AND {black(3)} AND {white(0)} AND {up(3, 4)} AND {lo(2)} < c4 AND {lo(1)} < c4 AND {lo(2)} > c4 - b4 * 0.5 AND {lo(1)} > c4 - b4 * 0.5 AND {hi(2)} < o3 AND {hi(1)} < {hi(2)} AND o0 > c1 AND c0 > greatest(h3, h2, h1)", "1")
    ],
    "morningdojistar": [(f"L2 AND {black(2)} AND D1 AND {down(1, 2)} AND NOT S0 AND {white(0)} AND c0 > c2 + b2 * 0.3", "1")],
    "morningstar": [(f"L2 AND {black(2)} AND S1 AND {down(1, 2)} AND NOT S0 AND {white(0)} AND c0 > c2 + b2 * 0.3", "1")],
    "onneck": [(f"{black(1)} AND L1 AND {white(0)} AND o0 < l1 AND abs(c0 - l1) <= e1", "-1")],
    "piercing": [(f"{black(1)} AND L1 AND {white(0)} AND L0 AND o0 < l1 AND c0 < o1 AND c0 > c1 + b1 * 0.5", "1")],
    "rickshawman": [(f"D0 AND d0 > b0 AND u0 > b0 AND {lo(0)} <= l0 + r0 / 2 + n0 AND {hi(0)} >= l0 + r0 / 2 - n0", "1")],
    "risefall3methods": [
        ("L4 AND S3 AND S2 AND S1 AND L0 AND g4 = -g3 AND g3 = g2 AND g2 = g1 AND g1 = -g0 AND " + " AND ".join(f"{lo(k)} < h4 AND {hi(k)} > l4" for k in (3, 2, 1)) + " AND c2 * g4 < c3 * g4 AND c1 * g4 < c2 * g4 AND o0 * g4 > c1 * g4 AND c0 * g4 > c4 * g4", "g4")
    ],
    "separatinglines": [("g1 = -g0 AND abs(o0 - o1) <= e1 AND L0 AND (g0 = 1 AND Y0 OR g0 = -1 AND V0)", "g0")],
    "shootingstar": [(f"S0 AND u0 > b0 AND Y0 AND {up(0, 1)}", "-1")],
    "shortline": [("S0 AND us0 AND ds0", "g0")],
    "spinningtop": [("S0 AND u0 > b0 AND d0 > b0", "g0")],
    "stalledpattern": [(f"{white(2, 1, 0)} AND {RISING} AND L2 AND L1 AND V1 AND {opens_in(1)} AND S0 AND o0 >= c1 - b0 - n1", "-1")],
    "sticksandwich": [(f"{black(2)} AND {white(1)} AND {black(0)} AND l1 > c2 AND abs(c0 - c2) <= e2", "1")],
    "takuri": [("D0 AND V0 AND d0 > 2 * b0", "1")],
    "tasukigap": [
        (f"{up(1, 2)} AND {white(1)} AND {black(0)} AND o0 < c1 AND o0 > o1 AND c0 < o1 AND c0 > {hi(2)} AND abs(b1 - b0) < n1", "1"),
        (f"{down(1, 2)} AND {black(1)} AND {white(0)} AND o0 < o1 AND o0 > c1 AND c0 > o1 AND c0 < {lo(2)} AND abs(b1 - b0) < n1", "-1"),
    ],
    "thrusting": [(f"{black(1)} AND L1 AND {white(0)} AND o0 < l1 AND c0 > c1 + e1 AND c0 <= c1 + b1 * 0.5", "-1")],
    "tristar": [(f"D2 AND D1 AND D0 AND {up(1, 2)} AND {hi(0)} < {hi(1)}", "-1"), (f"D2 AND D1 AND D0 AND {down(1, 2)} AND {lo(0)} > {lo(1)}", "1")],
    "unique3river": [(f"L2 AND {black(2, 1)} AND c1 > c2 AND o1 <= o2 AND l1 < l2 AND S0 AND {white(0)} AND o0 > l1", "1")],
    "upsidegap2crows": [(f"{white(2)} AND L2 AND {black(1)} AND S1 AND {up(1, 2)} AND {black(0)} AND o0 > o1 AND c0 < c1 AND c0 > c2", "-1")],
    "xsidegap3methods": [(f"g2 = g1 AND g1 = -g0 AND o0 < {hi(1)} AND o0 > {lo(1)} AND c0 < {hi(2)} AND c0 > {lo(2)} AND (g2 = 1 AND {up(1, 2)} OR g2 = -1 AND {down(1, 2)})", "g2")],
}
#: An inside bar whose range is then left on one side.
HIKKAKE = "h1 < h2 AND l1 > l2 AND (h0 < h1 AND l0 < l1 OR h0 > h1 AND l0 > l1)"
HIKKAKE_MOD = "h2 < h3 AND l2 > l3 AND h1 < h2 AND l1 > l2 AND (h0 < h1 AND l0 < l1 AND c2 <= l2 + n2 OR h0 > h1 AND l0 > l1 AND c2 >= h2 - n2)"
NAMES = sorted([*RULES, "hikkake", "hikkakemod"])


def used(rule: str) -> set[str]:
    return set(re.findall(r"\b([a-zA-Z]{1,2}\d)\b", rule))


def rule_sql(name: str) -> str:
    cases = " ".join(f"WHEN {cond} THEN {value}" for cond, value in RULES[name])
    return f"CASE {cases} ELSE 0 END"


def spark_text(sql: str) -> str:
    return re.sub(r"\b([LSDVY])(\d)\b", lambda m: FLAGS[m[1]] + m[2], sql)


def anatomy(bars: DataFrame) -> DataFrame:
    """Each bar's parts and what the bars before make of them."""
    w = bars_window()
    b, r = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    own = bars.withColumns({"o": F.col("open"), "h": F.col("high"), "l": F.col("low"), "c": F.col("close"), "g": F.when(F.col("close") >= F.col("open"), 1).otherwise(-1), "b": b, "r": r, "u": F.col("high") - F.greatest("open", "close"), "d": F.least("open", "close") - F.col("low")})
    mean = lambda x, n: F.when(F.count(x).over(w.rowsBetween(-n, -1)) >= n, F.avg(x).over(w.rowsBetween(-n, -1)))
    own = own.withColumns({"_b": mean("b", 10), "_r": mean("r", 10), "_q": mean("r", 5), "_s": mean(F.col("u") + F.col("d"), 10) / 2})
    x = F.col
    return own.withColumns(
        {"lg": x("b") > x("_b"), "sm": x("b") < x("_b"), "dj": x("b") <= 0.1 * x("_r"), "vu": x("u") < 0.1 * x("_r"), "vl": x("d") < 0.1 * x("_r"), "us": x("u") < x("_s"), "ds": x("d") < x("_s"), "n": 0.2 * x("_q"), "f": 0.6 * x("_q"), "e": 0.05 * x("_q")}
    ).drop("_b", "_r", "_q", "_s")


def candles(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """symbol, ts and a column ``ta_cdl<name>`` (-1, 0 or 1; a confirmed hikkake counts double) for each pattern."""
    names = names or NAMES
    w = bars_window()
    own = anatomy(bars.select("symbol", "ts", "open", "high", "low", "close"))
    parts = {f"{FLAGS.get(p, p)}{k}": (F.lag(FLAGS.get(p, p), k).over(w) if k else F.col(FLAGS.get(p, p))) for p in PARTS for k in range(BARS)}
    flat = own.select("symbol", "ts", F.row_number().over(w).alias("nth"), *[v.alias(k) for k, v in parts.items()])
    ready = F.col("nth") > 10 + BARS - 1
    cols = {f"ta_cdl{n}": F.when(ready, F.expr(spark_text(rule_sql(n)))) for n in names if n in RULES}
    flat = flat.withColumns(cols)
    for n, rule, inner in (("hikkake", HIKKAKE, 1), ("hikkakemod", HIKKAKE_MOD, 2)):
        if n in names:
            way = F.when(F.expr(f"({spark_text(rule)}) AND h0 < h1"), 1).when(F.expr(f"({spark_text(rule)}) AND h0 > h1"), -1).otherwise(0)
            flat = flat.withColumn(f"_{n}", way)
            flat = flat.withColumn(f"ta_cdl{n}", F.when(ready, confirmed(f"_{n}", inner, w)))
    return flat.select("symbol", "ts", *[f"ta_cdl{n}" for n in names])


def confirmed(way: str, inner: int, w) -> Column:
    """The pattern itself, or twice its sign where one of the last three bars had it and the close now leaves the inside bar on its side."""
    out = F.when(F.col(way) != 0, F.col(way))
    for k in (1, 2, 3):
        before = F.lag(way, k).over(w)
        high, low = F.lag("h0", k + inner).over(w), F.lag("l0", k + inner).over(w)
        out = out.when((before == 1) & (F.col("c0") > high), 2).when((before == -1) & (F.col("c0") < low), -2).when(before != 0, 0)
    return out.otherwise(0)
