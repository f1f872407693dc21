"""Queries of sources, relational primitives, series primitives, features and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.chunks import by_chunks, indexed, placed
from ..functions.series import bars_window, compounded, cumulative_log_return, diff, drawdown, lag, log_return, rank_in, rolling, rolling_mean, rolling_std, simple_return, true_range
from ..operators import features as ft
from ..operators import labels as lb
from ..sources import bars as src
from .base import BARS, ORACLES, OVER, WITH, bars, frame, plain_ewm, q, query, r, roll, seeded, shown

SHORT = ft.SHORT


@query(f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def bars_hourly(spark, sf):
    return bars(spark, sf)


@query(
    """SELECT event_type AS symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low,
last(value ORDER BY events.ts, event_id) AS close, count(*) AS volume FROM events WHERE value > 0 GROUP BY event_type, time_bucket(INTERVAL '4 hours', events.ts)"""
)
def bars_four_hours(spark, sf):
    return bars(spark, sf, "4 hours")


@query(
    f"""WITH {BARS} SELECT symbol, count(*) AS n, count(close) AS n_close, sum(CASE WHEN least(open, high, low, close) <= 0 THEN 1 ELSE 0 END)::BIGINT AS not_positive,
count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (close > high OR close < low) AS close_outside, 0::BIGINT AS missing, CAST(NULL AS VARCHAR) AS error, '' AS warning FROM bars GROUP BY symbol"""
)
def bars_validation(spark, sf):
    return src.validate(bars(spark, sf)).withColumn("not_positive", F.col("not_positive").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'")
def rel_filter(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").where("l_discount > 0.05 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT l_orderkey AS order_id, l_linenumber AS line, {q('l_extendedprice * (1 - l_discount)')} AS net FROM lineitem")
def rel_project(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumnsRenamed({"l_orderkey": "order_id", "l_linenumber": "line"})
    return li.withColumn("net", r(F.col("l_extendedprice") * (1 - F.col("l_discount")))).select("order_id", "line", "net")


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS place FROM orders")
def rel_sort(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return placed(o, "place", F.col("o_orderstatus"), F.desc("o_totalprice"), F.col("o_orderkey")).drop("o_totalprice")


@query(f"WITH {BARS}, h AS (SELECT symbol, ts, high FROM bars WHERE volume > 2) SELECT b.symbol, b.ts, b.close, h.high FROM bars b LEFT JOIN h USING (symbol, ts)")
def rel_left_align(spark, sf):
    b = bars(spark, sf)
    return b.select("symbol", "ts", "close").join(b.where("volume > 2").select("symbol", "ts", "high"), ["symbol", "ts"], "left")


@query(f"WITH {BARS}, h AS (SELECT symbol, ts, high FROM bars WHERE volume > 2), l AS (SELECT symbol, ts, low FROM bars WHERE volume < 5) SELECT symbol, ts, high, low FROM h JOIN l USING (symbol, ts)")
def rel_inner_align(spark, sf):
    b = bars(spark, sf)
    return b.where("volume > 2").select("symbol", "ts", "high").join(b.where("volume < 5").select("symbol", "ts", "low"), ["symbol", "ts"])


@query(f"WITH {BARS}, h AS (SELECT symbol, ts, high FROM bars WHERE volume > 3), l AS (SELECT symbol, ts, low FROM bars WHERE volume < 3) SELECT symbol, ts, high, low FROM h FULL JOIN l USING (symbol, ts)")
def rel_outer_align(spark, sf):
    b = bars(spark, sf)
    return b.where("volume > 3").select("symbol", "ts", "high").join(b.where("volume < 3").select("symbol", "ts", "low"), ["symbol", "ts"], "full")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def rel_semi(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{sf}/customer.parquet").join(o, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query(f"{WITH}, f AS (SELECT symbol, ts, lr, {roll('avg', 'close', 5)} AS m FROM b) SELECT symbol, ts, {q('lr')} AS lr, {q('m')} AS m FROM f WHERE lr IS NOT NULL AND m IS NOT NULL")
def rel_drop_missing(spark, sf):
    return shown(bars(spark, sf).select("symbol", "ts", log_return().alias("lr"), rolling_mean("close", 5).alias("m")).na.drop("any"), "lr", "m")


@query("SELECT l_shipdate::DATE AS day, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def rel_value_counts(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("day"), "l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts) AS times, count(*) - count(DISTINCT ts) AS repeated FROM events GROUP BY event_type")
def rel_distinct(spark, sf):
    n = F.count_distinct("ts")
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), n.alias("times"), (F.count("*") - n).alias("repeated"))


@query(f"{WITH}, n AS (SELECT symbol, ts, close, rn, max(rn) OVER (PARTITION BY symbol) AS top FROM b) SELECT symbol, ts, close, CASE WHEN rn <= 12 THEN 'first' ELSE 'last' END AS which FROM n WHERE rn <= 12 OR rn > top - 5")
def rel_first_last(spark, sf):
    w = Window.partitionBy("symbol")
    b = bars(spark, sf).withColumns({"first": F.row_number().over(w.orderBy("ts")), "last": F.row_number().over(w.orderBy(F.desc("ts")))})
    return b.where("first <= 12 or last <= 5").select("symbol", "ts", "close", F.when(F.col("first") <= 12, "first").otherwise("last").alias("which"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rel_top_k(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query(
    """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 2000)
SELECT k, 'both' AS part FROM (SELECT k FROM a INTERSECT SELECT k FROM s) UNION ALL SELECT k, 'first' FROM (SELECT k FROM a EXCEPT SELECT k FROM s)
UNION ALL SELECT k, 'any' FROM (SELECT k FROM a UNION SELECT k FROM s)"""
)
def rel_sets(spark, sf):
    a = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    s = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 2000").select(F.col("s_nationkey").alias("k"))
    named = lambda df, x: df.withColumn("part", F.lit(x))
    return named(a.intersect(s), "both").unionAll(named(a.exceptAll(s).distinct().join(s, "k", "left_anti"), "first")).unionAll(named(a.union(s).distinct(), "any"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS level FROM orders")
def rel_value_map(spark, sf):
    p = F.col("o_orderpriority")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).otherwise(2).alias("level"))


@query(f"{WITH}, f AS (SELECT symbol, ts, {roll('stddev_samp', 'close', 20, 5)} AS s, stddev_samp(close) OVER (PARTITION BY symbol) AS g FROM b) SELECT symbol, ts, {q('coalesce(s, g)')} AS vol FROM f")
def rel_fill(spark, sf):
    whole = F.stddev_samp("close").over(Window.partitionBy("symbol"))
    return shown(bars(spark, sf).withColumn("vol", F.coalesce(rolling_std("close", 20, 5), whole)), "vol")


@query(f"{WITH} SELECT symbol, ts, close, c1 AS before, lead(close) {OVER} AS after, lag(close, 26) {OVER} AS far FROM b")
def series_shift(spark, sf):
    return bars(spark, sf).select("symbol", "ts", "close", lag("close").alias("before"), lag("close", -1).alias("after"), lag("close", 26).alias("far"))


@query(f"{WITH} SELECT symbol, ts, {q('close - c1')} AS d1, {q(f'close - lag(close, 13) {OVER}')} AS d13 FROM b")
def series_diff(spark, sf):
    return shown(bars(spark, sf).withColumns({"d1": diff("close"), "d13": diff("close", 13)}), "d1", "d13")


@query(f"{WITH} SELECT symbol, ts, {q('lr')} AS log_ret, {q('(close - c1) / greatest(c1, 1e-12)')} AS ret, {q(f'ln(close / lag(close, 6) {OVER})')} AS log_ret_6 FROM b")
def series_returns(spark, sf):
    return shown(bars(spark, sf).withColumns({"log_ret": log_return(), "ret": simple_return(), "log_ret_6": cumulative_log_return(6)}), "log_ret", "ret", "log_ret_6")


@query(
    f"{WITH} SELECT symbol, ts, {q(roll('avg', 'close', 20))} AS mean, {q(roll('sum', 'close', 7))} AS total, {q(roll('min', 'low', 13))} AS low, {q(roll('max', 'high', 13, 5))} AS high, count(lr) {frame(20)} AS n FROM b"
)
def series_rolling(spark, sf):
    b = bars(spark, sf).withColumn("lr", log_return())
    n = F.count("lr").over(bars_window().rowsBetween(-19, 0))
    out = b.withColumns({"mean": rolling_mean("close", 20), "total": rolling(F.sum, "close", 7), "low": rolling(F.min, "low", 13), "high": rolling(F.max, "high", 13, 5), "n": n})
    return shown(out, "mean", "total", "low", "high").join(out.select("symbol", "ts", "n"), ["symbol", "ts"])


@query(f"{WITH}, u AS (SELECT *, CASE WHEN lr > 0 THEN lr END AS up FROM b) SELECT symbol, ts, {q(roll('stddev_samp', 'close', 26))} AS sd, {q(roll('stddev_samp', 'up', 20, 4))} AS sd_up FROM u")
def series_rolling_std(spark, sf):
    b = bars(spark, sf).withColumn("lr", log_return()).withColumn("up", F.when(F.col("lr") > 0, F.col("lr")))
    return shown(b.withColumns({"sd": rolling_std("close", 26), "sd_up": rolling_std("up", 20, 4)}), "sd", "sd_up")


RANK_SQL = f"""{WITH}, p AS (SELECT a.symbol, a.ts, a.rn, a.close, count(*) AS n, count(*) FILTER (o.close < a.close) AS below, count(*) FILTER (o.close = a.close) AS same
FROM b a JOIN b o ON o.symbol = a.symbol AND o.rn BETWEEN a.rn - 99 AND a.rn GROUP BY ALL)
SELECT symbol, ts, {q("CASE WHEN n >= 50 THEN (below + (same + 1) / 2) / n END")} AS pct, {q("(below + (same + 1) / 2) / n")} AS pct_or_expanding FROM p"""


@query(RANK_SQL)
def series_pct_rank(spark, sf):
    return shown(bars(spark, sf).withColumns({"pct": rank_in("close", 100, 50), "pct_or_expanding": rank_in("close", 100)}), "pct", "pct_or_expanding")


@query(f"{WITH} SELECT symbol, ts, max(close) {OVER} AS top, {q(f'(close - max(close) {OVER}) / max(close) {OVER}')} AS drawdown FROM b")
def series_drawdown(spark, sf):
    top = F.max("close").over(bars_window().rowsBetween(Window.unboundedPreceding, 0))
    b = bars(spark, sf).select("symbol", "ts", top.alias("top"), r(drawdown("close")).alias("drawdown"))
    return b


@query(f"{WITH}, g AS (SELECT *, least(greatest(coalesce(close / c1 - 1, 0) / 1000, -0.02), 0.02) AS g FROM b) SELECT symbol, ts, {q(f'product(1 + g) {OVER}')} AS nav FROM g")
def series_compound(spark, sf):
    b = bars(spark, sf).withColumn("g", F.least(F.greatest(F.coalesce(F.col("close") / lag("close") - 1, F.lit(0.0)) / 1000, F.lit(-0.02)), F.lit(0.02)))
    return shown(b.withColumn("nav", compounded("g")), "nav")


@query(f"{WITH}, {seeded('e', 'b', 'lr', 2 / 27, 26)} SELECT b.symbol, b.ts, {q('y')} AS y FROM b LEFT JOIN e USING (symbol, rn)")
def scan_seeded_ewma(spark, sf):
    return shown(scan.seeded_ewma(bars(spark, sf).withColumn("lr", log_return()), {"y": ("lr", 2 / 27, 26)}), "y")


@query(f"{WITH}, {plain_ewm('e', 'b', 'tr', 1 / 14, False)} SELECT b.symbol, b.ts, {q('CASE WHEN rn >= 14 THEN y END')} AS y FROM b LEFT JOIN e USING (symbol, rn)")
def scan_ewm_recursive(spark, sf):
    return shown(scan.ewm(bars(spark, sf).withColumn("tr", true_range()), {"y": ("tr", 1 / 14)}, adjust=False, least=14), "y")


@query(f"{WITH}, {plain_ewm('e', 'b', 'close', 2 / 15, True)} SELECT b.symbol, b.ts, {q('y')} AS y FROM b LEFT JOIN e USING (symbol, rn)")
def scan_ewm_adjusted(spark, sf):
    return shown(scan.ewm(bars(spark, sf), {"y": ("close", 2 / 15)}, adjust=True), "y")


@query(f"{WITH} SELECT symbol, ts, {q('tr')} AS tr, {q(roll('avg', 'tr', 14))} AS atr FROM b")
def atr_simple(spark, sf):
    b = bars(spark, sf).withColumn("_tr", true_range())
    return shown(b.withColumns({"tr": F.col("_tr"), "atr": ft.sma_atr(14)}), "tr", "atr")


@query(f"{WITH}, {seeded('e', 'b', 'tr', 1 / 14, 14)} SELECT b.symbol, b.ts, {q('y')} AS atr FROM b LEFT JOIN e USING (symbol, rn)")
def atr_wilder(spark, sf):
    return shown(ft.wilder_atr(bars(spark, sf), 14), "atr")


@query(f"{WITH}, {plain_ewm('e', 'b', 'tr', 1 / 14, False)} SELECT b.symbol, b.ts, {q('CASE WHEN rn >= 14 THEN y END')} AS atr FROM b LEFT JOIN e USING (symbol, rn)")
def atr_ewm(spark, sf):
    return shown(ft.ewm_atr(bars(spark, sf), 14), "atr")


SIGMA = f"{seeded('mu', 'b', 'lr', 2 / 27, 26)}, dv AS (SELECT b.symbol, b.rn, (b.lr - mu.y) * (b.lr - mu.y) AS x FROM b LEFT JOIN mu USING (symbol, rn)), {seeded('va', 'dv', 'x', 2 / 27, 26)}, sg AS MATERIALIZED (SELECT b.*, sqrt(va.y) AS s FROM b LEFT JOIN va USING (symbol, rn))"


@query(
    f"{WITH}, {SIGMA} SELECT symbol, ts, {q('s')} AS ewma_vol_span26, "
    + ", ".join(f"{q(f'CASE WHEN s > 1e-10 THEN ln(close / lag(close, {h}) {OVER}) / (s * sqrt({h})) END')} AS ret_norm_{h}d" for h in SHORT.horizons)
    + " FROM sg"
)
def feature_normalized_returns(spark, sf):
    return shown(ft.volatility_features(bars(spark, sf)), "ewma_vol_span26", *[f"ret_norm_{h}d" for h in SHORT.horizons])


@query(
    f"{WITH}, {SIGMA}, lv AS (SELECT *, ln(1 / s) AS v FROM sg) SELECT symbol, ts, {q('CASE WHEN v IS NOT NULL THEN least(greatest((v - avg(v) OVER (PARTITION BY symbol)) / stddev_samp(v) OVER (PARTITION BY symbol), -5), 5) END')} AS vs_factor_span26,"
    f" {q(f'CASE WHEN s IS NOT NULL AND lead(close) {OVER} IS NOT NULL THEN least(greatest(ln(lead(close) {OVER} / close) / s, -20), 20) END')} AS target_norm_ret FROM lv"
)
def feature_vol_factor_target(spark, sf):
    return shown(ft.volatility_features(bars(spark, sf), target=True), "vs_factor_span26", "target_norm_ret")


@query(
    f"{WITH}, {seeded('es', 'b', 'close', 2 / 9, 8)}, {seeded('el', 'b', 'close', 2 / 25, 8)}, qq AS (SELECT b.symbol, b.ts, b.rn, (es.y - el.y) / {roll('stddev_samp', 'close', 26)} AS qv FROM b LEFT JOIN es USING (symbol, rn) LEFT JOIN el USING (symbol, rn))"
    f" SELECT symbol, ts, {q('qv / ' + roll('stddev_samp', 'qv', 63))} AS macd_8_24 FROM qq"
)
def feature_macd(spark, sf):
    return shown(ft.macd(bars(spark, sf), 8, 24, 26, 63), "macd_8_24")


@query(
    f"{WITH}, m AS (SELECT *, greatest(close - c1, 0) + (c1 - c1) AS up, greatest(c1 - close, 0) + (c1 - c1) AS dn FROM b), {seeded('u', 'm', 'up', 1 / 14, 14)}, {seeded('d', 'm', 'dn', 1 / 14, 14)}"
    f" SELECT b.symbol, b.ts, {q('(100 - 100 / (1 + u.y / (d.y + 1e-10)) - 50) / 50')} AS feat_momentum_rsi FROM b LEFT JOIN u USING (symbol, rn) LEFT JOIN d USING (symbol, rn)"
)
def feature_rsi(spark, sf):
    return shown(ft.momentum_rsi(bars(spark, sf)), "feat_momentum_rsi")


def lim(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"


@query(
    f"""{WITH}, s AS (SELECT *, abs(close - c1) AS step, close - lag(close, 26) {OVER} AS mv,
CASE WHEN high - low < 1e-6 THEN 0.5 ELSE (close - low) / (high - low + 1e-10) END AS pos FROM b), t AS (SELECT *, {roll('sum', 'step', 26)} AS path, least(greatest(pos, 0), 1) * 2 - 1 AS ps FROM s)
SELECT symbol, ts, {q(lim('abs(mv) / (path + 1e-10) * sign(mv)', -1, 1))} AS feat_efficiency, {q(lim(roll('avg', 'ps', 13), -1, 1))} AS feat_icp FROM t"""
)
def feature_efficiency_icp(spark, sf):
    return shown(ft.frame_features(bars(spark, sf)), "feat_efficiency", "feat_icp")


@query(
    f"""{WITH}, s AS (SELECT *, CASE WHEN lr > 0 THEN lr END AS up, CASE WHEN lr < 0 THEN lr END AS dn FROM b), t AS (SELECT *, {roll('stddev_samp', 'up', 20, 4)} AS u, {roll('stddev_samp', 'dn', 20, 4)} AS d, {roll('max', 'high', 26)} AS hh, {roll('min', 'low', 26)} AS ll FROM s)
SELECT symbol, ts, {q(lim('(u - d) / (u + d + 1e-10)', -1, 1))} AS feat_vol_asymmetry, {q(lim('CASE WHEN hh - ll < 1e-6 THEN 0.5 ELSE (close - ll) / (hh - ll + 1e-10) END * 2 - 1', -1, 1))} AS feat_local_structure FROM t"""
)
def feature_asymmetry_structure(spark, sf):
    return shown(ft.frame_features(bars(spark, sf)), "feat_vol_asymmetry", "feat_local_structure")


@query(
    f"""{WITH}, s AS (SELECT *, (least(greatest(hour(ts) * 60 + minute(ts), 555), 930) - 555) / 375.0 * pi() AS angle FROM b)
SELECT symbol, ts, {q('sin(angle)')} AS feat_session_sin, {q('cos(angle)')} AS feat_session_cos, {q(roll('avg', 'tr', 5) + ' / (' + roll('avg', 'tr', 30) + ' + 1e-10)')} AS feat_vol_squeeze,
{q(lim('(high - greatest(open, close)) / (high - low + 1e-10)', 0, 1))} AS feat_rejection_upper, {q(lim('(least(open, close) - low) / (high - low + 1e-10)', 0, 1))} AS feat_rejection_lower FROM s"""
)
def feature_session_squeeze_rejection(spark, sf):
    return shown(ft.frame_features(bars(spark, sf)), "feat_session_sin", "feat_session_cos", "feat_vol_squeeze", "feat_rejection_upper", "feat_rejection_lower")


def mid(n: int) -> str:
    return f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"


@query(
    f"""{WITH}, s AS (SELECT symbol, ts, close, {mid(9)} AS t, {mid(26)} AS k, {mid(40)} AS sb FROM b), u AS (SELECT *, lag((t + k) / 2, 26) {OVER} AS a, lag(sb, 26) {OVER} AS z FROM s)
SELECT symbol, ts, {", ".join(f"{q(f'(close - {x}) / (close + 1e-10)')} AS feat_ichimoku_dist_{n}" for x, n in (("t", "tenkan"), ("k", "kijun"), ("a", "span_a"), ("z", "span_b")))} FROM u"""
)
def feature_ichimoku(spark, sf):
    return shown(ft.frame_features(bars(spark, sf)), *[f"feat_ichimoku_dist_{x}" for x in ("tenkan", "kijun", "span_a", "span_b")])


ORACLE_ICHIMOKU = ORACLES["feature_ichimoku"]


@query(ORACLE_ICHIMOKU)
def feature_frames_in_chunks(spark, sf):
    """The same features with each symbol cut into chunks."""
    out = by_chunks(bars(spark, sf), ft.frame_features, lookback=70, rows=150, stretch="3 days")
    return shown(out, *[f"feat_ichimoku_dist_{x}" for x in ("tenkan", "kijun", "span_a", "span_b")])


@query(f"{WITH} SELECT symbol, ts, rn - 1 AS i FROM b")
def series_index(spark, sf):
    return indexed(bars(spark, sf), "i", "2 days").select("symbol", "ts", F.col("i").cast("long").alias("i"))


def label_sql(h: int, tp: float, sl: float, atr: str = "wilder") -> str:
    """CTEs ending in lab(...): barrier labels by joining each bar with the bars ahead."""
    return f"""{seeded('wa', 'b', 'tr', 1 / 14, 14)}, v AS MATERIALIZED (SELECT b.symbol, b.ts, b.open, b.high, b.low, b.close, wa.y AS atr, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) - 1 AS i, count(*) OVER (PARTITION BY b.symbol) AS n
  FROM b JOIN wa USING (symbol, rn)),
hit AS MATERIALIZED (SELECT d.symbol, d.ts, d.i, d.atr, e.open AS entry, e.high - e.low AS range1, max(f.close) FILTER (f.i = d.i + {h}) AS last_close,
  min(f.i) FILTER (f.high >= e.open + d.atr * {tp} OR f.low <= e.open - d.atr * {sl}) AS l, min(f.i) FILTER (f.low <= e.open - d.atr * {tp} OR f.high >= e.open + d.atr * {sl}) AS s
  FROM v d JOIN v e ON e.symbol = d.symbol AND e.i = d.i + 1 JOIN v f ON f.symbol = d.symbol AND f.i BETWEEN d.i + 1 AND d.i + {h} WHERE d.i < d.n - {h} GROUP BY ALL),
leg AS (SELECT hit.*, CASE WHEN l IS NULL THEN 0 WHEN x.high >= hit.entry + hit.atr * {tp} AND x.low <= hit.entry - hit.atr * {sl} THEN -2 WHEN x.high >= hit.entry + hit.atr * {tp} THEN 1 ELSE -1 END AS lc,
  CASE WHEN s IS NULL THEN 0 WHEN y.low <= hit.entry - hit.atr * {tp} AND y.high >= hit.entry + hit.atr * {sl} THEN -2 WHEN y.low <= hit.entry - hit.atr * {tp} THEN 1 ELSE -1 END AS sc
  FROM hit LEFT JOIN v x ON x.symbol = hit.symbol AND x.i = hit.l LEFT JOIN v y ON y.symbol = hit.symbol AND y.i = hit.s),
ev AS (SELECT *, CASE WHEN range1 >= 2 * atr * {sl} THEN 9 WHEN lc = 1 AND sc <> 1 THEN 1 WHEN sc = 1 AND lc <> 1 THEN 2 WHEN lc = 1 AND sc = 1 THEN 5 WHEN lc = -2 OR sc = -2 THEN 7 WHEN lc = -1 AND sc = -1 THEN 6 WHEN lc = -1 THEN 3 WHEN sc = -1 THEN 4 ELSE 8 END AS code FROM leg),
lab AS MATERIALIZED (SELECT symbol, ts, i, atr, entry, code, CASE code WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 5 THEN -99 WHEN 6 THEN -99 WHEN 9 THEN -99 ELSE 0 END AS target,
  CASE WHEN code = 9 THEN i + 1 WHEN code IN (1, 3) THEN l WHEN code IN (2, 4) THEN s WHEN code = 8 THEN i + {h} WHEN l IS NOT NULL AND s IS NOT NULL THEN least(l, s) ELSE coalesce(l, s) END AS bar,
  CASE code WHEN 1 THEN entry + atr * {tp} WHEN 2 THEN entry - atr * {tp} WHEN 3 THEN entry - atr * {sl} WHEN 4 THEN entry + atr * {sl} WHEN 6 THEN CASE WHEN l <= s THEN entry - atr * {sl} ELSE entry + atr * {sl} END WHEN 8 THEN last_close END AS exit_price,
  ['INVALID','LONG_TP','SHORT_TP','LONG_SL','SHORT_SL','BOTH_TP','BOTH_SL','AMBIGUOUS','TIMEOUT','WIDE_CANDLE'][code + 1] AS event_type FROM ev)"""


def labelled(spark, sf, h=20, tp=1.0, sl=0.8):
    return lb.triple_barrier(ft.wilder_atr(bars(spark, sf), 14), h, tp, sl)


@query(f"{WITH}, {label_sql(20, 1.0, 0.8)} SELECT symbol, ts, code::TINYINT AS event_code, target::FLOAT AS target, bar::BIGINT AS event_bar_pos, {q('entry')} AS entry_price, {q('exit_price')} AS exit_price, {q('atr')} AS atr_value, event_type FROM lab")
def label_triple_barrier(spark, sf):
    x = labelled(spark, sf)
    return x.select("symbol", "ts", "event_code", "target", "event_bar_pos", r("entry_price").alias("entry_price"), r("exit_price").alias("exit_price"), r("atr_value").alias("atr_value"), "event_type")


@query(f"{WITH}, {label_sql(20, 0.6, 1.8)} SELECT symbol, ts, code::TINYINT AS event_code, bar::BIGINT AS event_bar_pos FROM lab")
def label_wide_stops(spark, sf):
    return labelled(spark, sf, 20, 0.6, 1.8).select("symbol", "ts", "event_code", "event_bar_pos")


@query(f"{WITH}, {label_sql(20, 1.0, 0.8)} SELECT symbol, ts, target::FLOAT AS target FROM lab WHERE target NOT IN (-99, 0)")
def label_training_rows(spark, sf):
    return lb.training_rows(labelled(spark, sf)).select("symbol", "ts", "target")


@query(
    f"{WITH}, {label_sql(20, 1.0, 0.8)} SELECT symbol, event_type, count(*) AS n, {q('count(*) / sum(count(*)) OVER (PARTITION BY symbol)')} AS share, event_type = 'BOTH_SL' AND count(*) / sum(count(*)) OVER (PARTITION BY symbol) > 0.15 AS many_double_stops FROM lab GROUP BY symbol, event_type"
)
def label_event_mix(spark, sf):
    return lb.event_mix(labelled(spark, sf)).withColumn("share", r("share"))
