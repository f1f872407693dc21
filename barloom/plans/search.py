"""Queries of splits, scaling, formulas, signals, backtests and regimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formula as fm
from ..functions.series import log_return
from ..operators import features as ft
from ..operators import regime as rg
from ..operators import search as se
from ..operators import signals as sg
from .base import BARS, OVER, WITH, bars, plain_ewm, q, query, r, roll, seeded, shown
from .series import label_sql, labelled

SPLIT = """sp AS MATERIALIZED (SELECT *, rn - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, floor(count(*) OVER (PARTITION BY symbol) * 0.8) AS cut FROM b),
parts AS MATERIALIZED (SELECT *, CASE WHEN cut <= 26 THEN NULL WHEN i < cut - 26 THEN 'train' WHEN i < cut THEN 'embargo' ELSE 'holdout' END AS part FROM sp)"""


@query(f"{WITH}, {SPLIT} SELECT symbol, ts, part FROM parts")
def split_temporal(spark, sf):
    return se.temporal_split(bars(spark, sf), 26).select("symbol", "ts", "part")


@query(
    f"{WITH}, {SPLIT}, f AS (SELECT symbol, greatest(quantile_cont(abs(lr), 0.75), 1e-8) AS s FROM parts WHERE part = 'train' GROUP BY symbol)"
    " SELECT symbol, ts, part, round(tanh(lr / s), 4) + 0.0 AS x FROM parts JOIN f USING (symbol) WHERE part <> 'embargo'"
)
def scale_tanh(spark, sf):
    df = se.temporal_split(bars(spark, sf), 26).withColumn("x", log_return())
    out = se.apply_tanh(df, se.fit_tanh(df.where("part = 'train'"), ["x"]), ["x"])
    return out.where("part <> 'embargo'").select("symbol", "ts", "part", r(F.col("x").cast("double"), 4).alias("x"))


@query(
    f"""WITH {BARS}, k AS (SELECT b.symbol, b.ts, f.fold, TIMESTAMP '2024-01-01' + f.fold * INTERVAL 1 MONTH AS a FROM b, (SELECT unnest([0, 1]) AS fold) f),
p AS (SELECT symbol, ts, fold, CASE WHEN ts >= a AND ts < a + INTERVAL 1 MONTH THEN 'train' WHEN ts >= a + INTERVAL 1 MONTH AND ts < a + INTERVAL 2 MONTH THEN 'test' END AS part FROM k),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold, part ORDER BY ts DESC) AS back FROM p WHERE part IS NOT NULL)
SELECT symbol, ts, fold::INTEGER AS fold, part FROM l WHERE part = 'test' OR back > 10"""
)
def split_walk_forward(spark, sf):
    return se.walk_forward(bars(spark, sf), "2024-01-01", 1, 1, 2, 10).select("symbol", "ts", "fold", "part")


#: Features that formulas are evaluated on: bounded columns of bars.
MATRIX = """m AS MATERIALIZED (SELECT symbol, ts, rn, coalesce(lr, 0) AS f0, (close - low) / (high - low + 1e-10) * 2 - 1 AS f1, (open - close) / (high + 1e-10) AS f2, tr / (high + 1e-10) AS f3,
CASE WHEN lead(close) OVER (PARTITION BY symbol ORDER BY ts) > close THEN 1.0 ELSE -1.0 END AS y FROM b)"""
NAMES = ["f0", "f1", "f2", "f3"]
FORMULAS = [
    "sub(f1, f0)",
    "add(mul(f0, f1), div(f2, f3))",
    "if_then(gt(f0, f1), max(f2, 0.25), min(f3, -0.5))",
    "neg(and(lt(f0, f2), or(f1, f3)))",
    "abs(div(f0, sub(f1, f1)))",
    "mul(neg(f0), add(f3, 0.1234))",
]


def matrix(spark, sf):
    b = bars(spark, sf)
    e, span = 1e-10, F.col("high") - F.col("low")
    from ..functions.series import lag, true_range

    return b.select(
        "symbol", "ts", F.coalesce(log_return(), F.lit(0.0)).alias("f0"), ((F.col("close") - F.col("low")) / (span + e) * 2 - 1).alias("f1"),
        ((F.col("open") - F.col("close")) / (F.col("high") + e)).alias("f2"), (true_range() / (F.col("high") + e)).alias("f3"),
        F.when(lag("close", -1) > F.col("close"), 1.0).otherwise(-1.0).alias("y"),
    )


@query(f"{WITH}, {MATRIX} SELECT symbol, ts, {', '.join(f'{q(fm.to_sql(f))} AS p{i}' for i, f in enumerate(FORMULAS))} FROM m")
def formula_evaluate(spark, sf):
    return shown(matrix(spark, sf).withColumns({f"p{i}": fm.to_column(f) for i, f in enumerate(FORMULAS)}), *[f"p{i}" for i in range(len(FORMULAS))])


def fitness_sql(p: str) -> str:
    lo = f"(count(*) FILTER (y = 1 AND {p} > 0) / (count(*) FILTER (y = 1) + 1e-8))"
    sh = f"(count(*) FILTER (y = -1 AND {p} < 0) / (count(*) FILTER (y = -1) + 1e-8))"
    return (
        f"0.7 * CASE WHEN stddev_pop({p}) < 1e-9 THEN 0 ELSE covar_pop(y, {p}) * count(*) / (stddev_pop(y) * stddev_pop({p}) * count(*) + 1e-8) END + 0.3 * 2 * {lo} * {sh} / ({lo} + {sh} + 1e-8)"
        f" - 0.25 * (coalesce(avg(greatest(0, -{p})) FILTER (y = 1), 0) + coalesce(avg(greatest(0, {p})) FILTER (y = -1), 0)) / 2 - 5.0 * greatest(0, 0.08 - stddev_pop({p}))"
    )


@query(f"{WITH}, {MATRIX} " + " UNION ALL ".join(f"SELECT symbol, '{f}' AS formula, {q(fitness_sql(fm.to_sql(f)))} AS fitness FROM m GROUP BY symbol" for f in FORMULAS))
def formula_fitness(spark, sf):
    out = se.score_formulas(matrix(spark, sf), FORMULAS, "y", ["symbol"])
    return out.withColumn("fitness", r("fitness"))


#: Formulas as text, to be looked into (cases of the guards).
TEXTS = [
    "div(macd_8_24, abs(ret_norm_21))", "max(vs_factor, vs_factor)", "sub(max(u, v), max(u, v))", "sub(u, v)", "add(w, neg(w))", "add(w, neg(max(u, w)))", "div(w, sub(min(u, v), min(u, v)))",
    "abs(add(div(u, v), neg(div(u, v))))", "or(gt(u, v), and(lt(v, w), or(u, s)))", "if_then(lt(u, w), add(v, s), max(r, t))", "mul(add(u, v), min(w, 0.5))", "neg(neg(abs(t)))",
]
KNOWN = ["macd_8_24", "ret_norm_21", "vs_factor", "r", "s", "t", "u", "v", "w"]


def texts(spark):
    return spark.createDataFrame([(i, f) for i, f in enumerate(TEXTS)], "id int, formula string")


TEXT_SQL = "t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(TEXTS)) + ") v(id, formula))"
LIST = "[" + ", ".join(f"'{x}'" for x in KNOWN) + "]"


@query(
    f"WITH {TEXT_SQL} SELECT id, sha256(formula) AS hash, array_to_string(list_sort(list_intersect(list_distinct(regexp_extract_all(formula, '[A-Za-z_]\\w*')), {LIST})), ',') AS used,"
    " len(regexp_extract_all(formula, '\\b(lt|gt|and|or)\\b'))::INTEGER AS n_logic, len(regexp_extract_all(formula, '\\b(lt|gt|and|or|add|sub|mul|div|max|min|abs|neg|if_then)\\b'))::INTEGER AS n_ops FROM t"
)
def formula_text(spark, sf):
    ops = lambda names: F.regexp_count("formula", F.lit(rf"\b({'|'.join(names)})\b"))
    return texts(spark).select("id", fm.formula_hash("formula").alias("hash"), F.concat_ws(",", fm.used_of("formula", KNOWN)).alias("used"), ops(fm.LOGIC).alias("n_logic"), ops(fm.ARITY).alias("n_ops"))


#: What the guards must say of each text, worked out by hand.
VERDICTS = [(2, True, "too few features"), (4, True, "too few features"), (6, True, "cancels"), (7, True, "too few features"), (8, False, "mostly logic"), (9, False, "good"), (10, False, "good")]


@query(
    f"WITH {TEXT_SQL}, v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {c}, '{t}')" for i, c, t in VERDICTS) + ") x(id, cancels, verdict))"
    " SELECT t.id, t.formula, coalesce(v.cancels, false) AS cancels, coalesce(v.verdict, 'too few features') AS verdict FROM t LEFT JOIN v USING (id)"
)
def formula_guards(spark, sf):
    """Cancellation at any depth and the other guards; parsing has no SQL form, so the SQL holds what each text's verdict must be."""
    def run(batches):
        for b in batches:
            parsed = [fm.parse(x) for x in b["formula"]]
            yield b.assign(cancels=[fm.cancels(p) for p in parsed], verdict=[fm.guard(p) or "good" for p in parsed])

    return texts(spark).mapInPandas(run, "id int, formula string, cancels boolean, verdict string")


@query(f"WITH {TEXT_SQL} SELECT name, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(formula, '[A-Za-z_]\\w*'))) AS name FROM t) WHERE list_contains({LIST}, name) GROUP BY name")
def rel_explode_count(spark, sf):
    return texts(spark).select(F.explode(fm.used_of("formula", KNOWN)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


QUALITY = f"""{WITH}, {MATRIX}, x AS MATERIALIZED (SELECT symbol, f1 AS x, min(f1) OVER (PARTITION BY symbol) AS lo, max(f1) OVER (PARTITION BY symbol) AS hi FROM m),
h AS (SELECT symbol, least(floor((x - lo) / (hi - lo) * 20), 19) AS bin, count(*) AS n FROM x GROUP BY ALL), e AS (SELECT symbol, -sum(p * ln(p + 1e-8)) / ln(20) AS norm_entropy FROM (SELECT symbol, n / (sum(n) OVER (PARTITION BY symbol) + 1e-8) AS p FROM h) GROUP BY symbol),
s AS (SELECT symbol, count(DISTINCT round_even(x, 5)) / count(*) AS unique_ratio, quantile_cont(x, 0.85) AS entry, quantile_cont(x, 0.15) AS exit FROM x GROUP BY symbol),
c AS (SELECT symbol, avg((x >= entry)::INT) AS long_cov, avg((x <= exit)::INT) AS short_cov FROM x JOIN s USING (symbol) GROUP BY symbol)
SELECT symbol, {', '.join(f'{q(x)} AS {x}' for x in ('unique_ratio', 'entry', 'exit', 'norm_entropy', 'long_cov', 'short_cov'))},
NOT (unique_ratio < 0.1 OR norm_entropy < 0.25 OR (long_cov > 0.55 AND short_cov < 0.03) OR (short_cov > 0.55 AND long_cov < 0.03) OR entry - exit < 0.05) AS good FROM s JOIN e USING (symbol) JOIN c USING (symbol)"""


@query(QUALITY)
def signal_quality(spark, sf):
    out = se.signal_quality(matrix(spark, sf), "f1")
    return out.select("symbol", *[r(x).alias(x) for x in ("unique_ratio", "entry", "exit", "norm_entropy", "long_cov", "short_cov")], "good")


SIGNALS = f"""{MATRIX}, k AS MATERIALIZED (SELECT a.symbol, a.ts, a.rn, a.f0, (count(*) FILTER (o.f0 < a.f0) + (count(*) FILTER (o.f0 = a.f0) + 1) / 2) / count(*) AS pct FROM m a JOIN m o ON o.symbol = a.symbol AND o.rn BETWEEN a.rn - 99 AND a.rn GROUP BY ALL),
en AS MATERIALIZED (SELECT *, pct >= 0.85 AND f0 >= 0.01 AS le, pct <= 0.15 AND f0 <= -0.01 AS se FROM k)"""


@query(f"{WITH}, {SIGNALS} SELECT symbol, ts, {q('pct')} AS rank, le AND NOT se AS long_entry, se AND NOT le AS short_entry FROM en")
def signal_entries(spark, sf):
    return sg.entries(matrix(spark, sf), "f0", 100).select("symbol", "ts", r("rank").alias("rank"), "long_entry", "short_entry")


EXECUTION = f"""{SIGNALS}, {plain_ewm("wt", "b", "tr", 1 / 14, False)},
ex AS MATERIALIZED (SELECT b.symbol, b.ts, b.open, b.close, CASE WHEN b.rn >= 14 THEN wt.y END AS atr, le AND NOT se AS long_entry, se AND NOT le AS short_entry,
  coalesce(lag(le AND NOT se) OVER (PARTITION BY b.symbol ORDER BY b.rn), false) AND b.rn >= 14 AND wt.y > 0 AS go_long, coalesce(lag(se AND NOT le) OVER (PARTITION BY b.symbol ORDER BY b.rn), false) AND b.rn >= 14 AND wt.y > 0 AS go_short
  FROM b JOIN en USING (symbol, rn) JOIN wt USING (symbol, rn))"""


def executable(spark, sf):
    b = ft.ewm_atr(bars(spark, sf), 14)
    m = sg.entries(matrix(spark, sf), "f0", 100).select("symbol", "ts", "long_entry", "short_entry")
    return sg.executable(b.join(m, ["symbol", "ts"]))


@query(f"{WITH}, {EXECUTION} SELECT symbol, ts, go_long, go_short, {q('CASE WHEN atr > 0 THEN atr / open * 3.5 END')} AS tp_pct, {q('CASE WHEN atr > 0 THEN atr / open * 2.0 END')} AS sl_pct FROM ex")
def signal_execution(spark, sf):
    return executable(spark, sf).select("symbol", "ts", "go_long", "go_short", r("tp_pct").alias("tp_pct"), r("sl_pct").alias("sl_pct"))


@query(
    f"{WITH}, {EXECUTION} SELECT symbol, count(*) FILTER (long_entry) AS n_long_raw, count(*) FILTER (short_entry) AS n_short_raw, count(*) FILTER (go_long) AS n_long, count(*) FILTER (go_short) AS n_short,"
    f" {q('(count(*) FILTER (long_entry) + count(*) FILTER (short_entry)) / count(*) * 100')} AS raw_coverage_pct, {q('(count(*) FILTER (go_long) + count(*) FILTER (go_short)) / count(*) * 100')} AS coverage_pct FROM ex GROUP BY symbol"
)
def signal_coverage(spark, sf):
    return sg.coverage(executable(spark, sf)).withColumns({"raw_coverage_pct": r("raw_coverage_pct"), "coverage_pct": r("coverage_pct")})


#: The ledger's rules step by step: what the bar asks for, a close or an entry at its open, then the barriers at its close.
LEDGER = f"""{EXECUTION}, xs AS MATERIALIZED (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, open AS o, close AS c, go_long::INT - go_short::INT AS want, atr / open * 3.5 AS up, atr / open * 2.0 AS dn FROM ex),
ld(symbol, k, ts, eq, side, entry, units, paid, tp, sl, opened, gain, why) AS (
  SELECT DISTINCT symbol, 0::BIGINT, NULL::TIMESTAMP, 1.0::DOUBLE, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0, NULL::DOUBLE, NULL::VARCHAR FROM xs
  UNION ALL
  SELECT symbol, k, ts, CASE WHEN out_c IS NULL THEN eq2 ELSE eq2 + gain_c END, CASE WHEN out_c IS NULL THEN side2 ELSE 0 END, entry2, units2, paid2, tp2, sl2, opened, CASE WHEN out_c IS NULL THEN gain_o ELSE gain_c END, coalesce(out_c, CASE WHEN turned THEN 'opposite' END)
  FROM (SELECT *, side2 * units2 * (c * (1 - side2 * {sg.SLIPPAGE}) - entry2) - paid2 - units2 * c * (1 - side2 * {sg.SLIPPAGE}) * {sg.FEES} AS gain_c,
      CASE WHEN side2 = 0 THEN NULL WHEN side2 * (c - entry2) / entry2 <= -sl2 THEN 'stop' WHEN side2 * (c - entry2) / entry2 >= tp2 THEN 'target' END AS out_c
    FROM (SELECT symbol, k, ts, c, turned, gain_o, CASE WHEN turned THEN eq + gain_o ELSE eq END AS eq2, CASE WHEN turned THEN 0 WHEN enters THEN want ELSE side END AS side2, CASE WHEN enters THEN want ELSE 0 END AS opened,
        CASE WHEN enters THEN o * (1 + want * {sg.SLIPPAGE}) ELSE entry END AS entry2, CASE WHEN enters THEN eq / (o * (1 + want * {sg.SLIPPAGE})) ELSE units END AS units2,
        CASE WHEN enters THEN eq * {sg.FEES} ELSE paid END AS paid2, CASE WHEN enters THEN up ELSE tp END AS tp2, CASE WHEN enters THEN dn ELSE sl END AS sl2
      FROM (SELECT l.symbol, x.k, x.ts, x.o, x.c, x.want, x.up, x.dn, l.eq, l.side, l.entry, l.units, l.paid, l.tp, l.sl, l.side <> 0 AND x.want = -l.side AS turned, l.side = 0 AND x.want <> 0 AND l.eq > 0 AS enters,
          CASE WHEN l.side <> 0 AND x.want = -l.side THEN l.side * l.units * (x.o * (1 - l.side * {sg.SLIPPAGE}) - l.entry) - l.paid - l.units * x.o * (1 - l.side * {sg.SLIPPAGE}) * {sg.FEES} END AS gain_o
        FROM ld l JOIN xs x ON x.symbol = l.symbol AND x.k = l.k + 1)))
), mk AS MATERIALIZED (SELECT l.symbol, l.ts, l.k, l.side, l.opened, l.gain, l.why, l.eq + CASE WHEN l.side <> 0 THEN l.side * l.units * (x.c - l.entry) - l.paid ELSE 0 END AS equity FROM ld l JOIN xs x USING (symbol, k))"""


@query(f"{WITH}, {LEDGER} SELECT symbol, ts, side::INT AS position, opened::INT AS opened, {q('gain')} AS gain, why, {q('equity')} AS equity FROM mk")
def backtest_simulate(spark, sf):
    """Position, trades and equity of each bar."""
    return sg.simulate(executable(spark, sf)).select("symbol", "ts", "position", "opened", r("gain").alias("gain"), "why", r("equity").alias("equity"))


STATS = ("return_pct", "sharpe", "max_dd", "win_rate", "profit_factor")


@query(
    f"""{WITH}, {LEDGER}, rt AS (SELECT *, equity / coalesce(lag(equity) OVER w, 1) - 1 AS r, 1 - equity / greatest(max(equity) OVER (PARTITION BY symbol ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS dd FROM mk WINDOW w AS (PARTITION BY symbol ORDER BY k)),
st AS (SELECT symbol, (arg_max(equity, k) - 1) * 100 AS return_pct, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(24 * 365), 0) AS sharpe, max(dd) * 100 AS max_dd, count(*) FILTER (gain > 0) * 100.0 / nullif(count(gain), 0) AS win_rate,
  coalesce(sum(gain) FILTER (gain > 0), 0) / nullif(-sum(gain) FILTER (gain <= 0), 0) AS profit_factor, count(gain) AS n_trades FROM rt GROUP BY symbol)
SELECT symbol, {', '.join(f'{q(x, 4)} AS {x}' for x in STATS)}, n_trades FROM st"""
)
def backtest_stats(spark, sf):
    out = sg.portfolio_stats(sg.simulate(executable(spark, sf)), 24 * 365)
    return out.select("symbol", *[r(x, 4).alias(x) for x in STATS], "n_trades")


HURST = f"""hl AS (SELECT symbol, k, stddev_pop(d) AS tau FROM (SELECT a.symbol, l.k, a.close - o.close AS d FROM b a, (SELECT unnest(range(2, 50)) AS k) l, b o WHERE o.symbol = a.symbol AND o.rn = a.rn - l.k) GROUP BY symbol, k),
hu AS (SELECT symbol, regr_slope(ln(tau), ln(k)) AS hurst FROM hl GROUP BY symbol)"""


@query(f"{WITH}, {HURST} SELECT symbol, {q('hurst')} AS hurst FROM hu")
def regime_hurst(spark, sf):
    return rg.hurst(bars(spark, sf)).withColumn("hurst", r("hurst"))


A = 2 / 15
ADX = f"""mv AS MATERIALIZED (SELECT *, greatest(high - lag(high) {OVER}, 0) AS up, greatest(lag(low) {OVER} - low, 0) AS dn FROM b),
m1 AS MATERIALIZED (SELECT symbol, rn - 1 AS rn, up, dn FROM mv WHERE rn > 1), {plain_ewm("ea", "b", "tr", A, True)}, {plain_ewm("eu", "m1", "up", A, True)}, {plain_ewm("ed", "m1", "dn", A, True)},
di AS MATERIALIZED (SELECT ea.symbol, ea.rn, CASE WHEN ea.rn >= 14 THEN 100 * eu.y / ea.y END AS p, CASE WHEN ea.rn >= 14 THEN 100 * ed.y / ea.y END AS m FROM ea LEFT JOIN eu ON eu.symbol = ea.symbol AND eu.rn = ea.rn - 1 LEFT JOIN ed ON ed.symbol = ea.symbol AND ed.rn = ea.rn - 1),
dx AS MATERIALIZED (SELECT symbol, rn, coalesce(CASE WHEN p + m <> 0 THEN 100 * abs(p - m) / (p + m) END, 0) AS x FROM di), {plain_ewm("ex1", "dx", "x", A, True)}, ad AS (SELECT symbol, last(y ORDER BY rn) AS adx FROM ex1 GROUP BY symbol)"""
CHOP = """ch AS (SELECT symbol, least(greatest(100 * log10(sum(tr) / (max(high) - min(low))) / log10(28), 0), 200) AS chop FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM b) WHERE back <= 28 GROUP BY symbol)"""


@query(f"{WITH}, {ADX} SELECT symbol, {q('adx')} AS adx FROM ad")
def regime_adx(spark, sf):
    return rg.adx(bars(spark, sf)).withColumn("adx", r("adx"))


@query(f"{WITH}, {CHOP} SELECT symbol, {q('chop')} AS chop FROM ch")
def regime_choppiness(spark, sf):
    return rg.choppiness(bars(spark, sf)).withColumn("chop", r("chop"))


DECIDE = "CASE WHEN hurst > 0.55 AND adx > 25 THEN 'trending' WHEN hurst < 0.45 THEN 'mean_reverting' WHEN chop > 61.8 THEN 'choppy_random_walk' WHEN chop < 38.2 OR adx > 25 THEN 'trending_random_walk' ELSE 'random_walk' END AS regime"


@query(f"{WITH}, {HURST}, {ADX}, {CHOP} SELECT symbol, {DECIDE} FROM hu JOIN ad USING (symbol) JOIN ch USING (symbol)")
def regime_classify(spark, sf):
    return rg.classify(bars(spark, sf)).select("symbol", "regime")


@query(f"WITH RECURSIVE {BARS.replace('FROM bars WINDOW', 'FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 200) WINDOW')}, {HURST}, {ADX}, {CHOP} SELECT symbol, {DECIDE} FROM hu JOIN ad USING (symbol) JOIN ch USING (symbol)")
def regime_current(spark, sf):
    return rg.current_regime(bars(spark, sf), 200).select("symbol", "regime")


__all__ = ["label_sql", "labelled", "roll", "seeded", "Window"]
