"""Queries of technical indicators and candle patterns."""

from __future__ import annotations

from ..operators import candles as cd
from ..operators import indicators as ind
from .base import OVER, WITH, bars, frame, q, query, r, roll, seeded, shown

FRAMES = {
    "ta_medprice": "(high + low) / 2", "ta_typprice": "(high + low + close) / 3", "ta_wclprice": "(high + low + 2 * close) / 4", "ta_bbands_0": f"{roll('avg', 'close', 5)} + 2 * {roll('stddev_pop', 'close', 5)}", "ta_bbands_2": f"{roll('avg', 'close', 5)} - 2 * {roll('stddev_pop', 'close', 5)}",
    "ta_sma": roll("avg", "close", 30), "ta_midpoint": f"({roll('max', 'close', 14)} + {roll('min', 'close', 14)}) / 2", "ta_midprice": f"({roll('max', 'high', 14)} + {roll('min', 'low', 14)}) / 2", "ta_mom": f"close - lag(close, 10) {OVER}",
    "ta_roc": f"(close / lag(close, 10) {OVER} - 1) * 100", "ta_rocr100": f"close / lag(close, 10) {OVER} * 100", "ta_apo": f"{roll('avg', 'close', 12)} - {roll('avg', 'close', 26)}", "ta_ppo": f"({roll('avg', 'close', 12)} - {roll('avg', 'close', 26)}) / {roll('avg', 'close', 26)} * 100",
    "ta_willr": f"CASE WHEN {roll('max', 'high', 14)} > {roll('min', 'low', 14)} THEN -100 * ({roll('max', 'high', 14)} - close) / ({roll('max', 'high', 14)} - {roll('min', 'low', 14)}) WHEN {roll('max', 'high', 14)} IS NOT NULL THEN 0 END",
    "ta_wma": "(" + " + ".join(f"lag(close, {29 - i}) {OVER} * {i + 1}" if i < 29 else "close * 30" for i in range(30)) + ") / 465.0", "ta_stddev": roll("stddev_pop", "close", 5), "ta_linearreg_slope": f"CASE WHEN count(close) {frame(14)} >= 14 THEN regr_slope(close, rn) {frame(14)} END",
    "ta_linearreg": f"CASE WHEN count(close) {frame(14)} >= 14 THEN avg(close) {frame(14)} + regr_slope(close, rn) {frame(14)} * 6.5 END", "ta_correl": f"CASE WHEN count(high) {frame(30)} >= 30 THEN coalesce(covar_pop(high, low) {frame(30)} / (stddev_pop(high) {frame(30)} * stddev_pop(low) {frame(30)}), 0) END",
}


@query(f"{WITH} SELECT symbol, ts, {', '.join(f'{q(s, 4)} AS {n}' for n, s in FRAMES.items())} FROM b")
def indicator_frames(spark, sf):
    return ind.frames(bars(spark, sf)).select("symbol", "ts", *[r(n, 4).alias(n) for n in FRAMES])


@query(
    f"""{WITH}, k AS MATERIALIZED (SELECT *, CASE WHEN {roll('max', 'high', 5)} > {roll('min', 'low', 5)} THEN 100 * (close - {roll('min', 'low', 5)}) / ({roll('max', 'high', 5)} - {roll('min', 'low', 5)}) WHEN {roll('max', 'high', 5)} IS NOT NULL THEN 0 END AS fk,
CASE WHEN c1 IS NOT NULL THEN close - least(low, c1) END AS bp, CASE WHEN c1 IS NOT NULL THEN greatest(high, c1) - least(low, c1) END AS rg, (high + low + close) / 3 AS tp FROM b),
s AS MATERIALIZED (SELECT *, {roll('avg', 'fk', 3)} AS sk FROM k),
ex AS (SELECT a.symbol, a.rn, max(o.rn) FILTER (o.high = m.hh) AS hi_at, max(o.rn) FILTER (o.low = m.ll) AS lo_at FROM b a JOIN (SELECT symbol, rn, {roll('max', 'high', 15)} AS hh, {roll('min', 'low', 15)} AS ll FROM b) m USING (symbol, rn) JOIN b o ON o.symbol = a.symbol AND o.rn BETWEEN a.rn - 14 AND a.rn GROUP BY a.symbol, a.rn),
cm AS (SELECT symbol, rn, tp, {roll('avg', 'tp', 14)} AS m FROM k), ca AS (SELECT a.symbol, a.rn, (a.tp - a.m) / (0.015 * avg(abs(o.tp - a.m))) AS v FROM cm a JOIN cm o ON o.symbol = a.symbol AND o.rn BETWEEN a.rn - 13 AND a.rn GROUP BY a.symbol, a.rn, a.tp, a.m)
SELECT s.symbol, s.ts, {q('fk', 4)} AS ta_stochf_0, {q('sk', 4)} AS ta_stochf_1, {q(roll('avg', 'sk', 3), 4)} AS ta_stoch_1, {q('100 * (14 - (rn - hi_at)) / 14', 4)} AS ta_aroon_1, {q('100 * (14 - (rn - lo_at)) / 14', 4)} AS ta_aroon_0,
{q('100 * (4 * ' + roll('sum', 'bp', 7) + ' / ' + roll('sum', 'rg', 7) + ' + 2 * ' + roll('sum', 'bp', 14) + ' / ' + roll('sum', 'rg', 14) + ' + ' + roll('sum', 'bp', 28) + ' / ' + roll('sum', 'rg', 28) + ') / 7', 4)} AS ta_ultosc, {q('ca.v', 4)} AS ta_cci
FROM s LEFT JOIN ex USING (symbol, rn) LEFT JOIN ca USING (symbol, rn)"""
)
def indicator_oscillators(spark, sf):
    return ind.frames(bars(spark, sf)).select("symbol", "ts", *[r(n, 4).alias(n) for n in ("ta_stochf_0", "ta_stochf_1", "ta_stoch_1", "ta_aroon_1", "ta_aroon_0", "ta_ultosc", "ta_cci")])


def y(name: str) -> str:
    return f"(SELECT symbol, rn, y FROM {name})"


@query(
    f"""{WITH}, {seeded('e1', 'b', 'close', 2 / 31, 30)}, j1 AS MATERIALIZED (SELECT b.symbol, b.rn, e1.y AS x FROM b LEFT JOIN e1 USING (symbol, rn)), {seeded('e2', 'j1', 'x', 2 / 31, 30)}, j2 AS MATERIALIZED (SELECT b.symbol, b.rn, e2.y AS x FROM b LEFT JOIN e2 USING (symbol, rn)), {seeded('e3', 'j2', 'x', 2 / 31, 30)}
SELECT b.symbol, b.ts, {q('e1.y', 4)} AS ta_ema, {q('2 * e1.y - e2.y', 4)} AS ta_dema, {q('3 * e1.y - 3 * e2.y + e3.y', 4)} AS ta_tema, {q('(e3.y / lag(e3.y) OVER (PARTITION BY b.symbol ORDER BY b.ts) - 1) * 100', 4)} AS ta_trix FROM b LEFT JOIN e1 USING (symbol, rn) LEFT JOIN e2 USING (symbol, rn) LEFT JOIN e3 USING (symbol, rn)"""
)
def indicator_ema(spark, sf):
    return shown(ind.ema_family(bars(spark, sf)).select("symbol", "ts", *[r(n, 4).alias(n) for n in ("ta_ema", "ta_dema", "ta_tema", "ta_trix")]), "ta_ema", "ta_dema", "ta_tema", "ta_trix")


@query(
    f"""{WITH}, lt AS MATERIALIZED (SELECT *, CASE WHEN rn > 14 THEN close END AS late FROM b), {seeded('f', 'lt', 'late', 2 / 13, 12)}, {seeded('sl', 'b', 'close', 2 / 27, 26)}, m AS MATERIALIZED (SELECT b.symbol, b.rn, f.y - sl.y AS x FROM b LEFT JOIN f USING (symbol, rn) LEFT JOIN sl USING (symbol, rn)), {seeded('sg', 'm', 'x', 0.2, 9)}
SELECT b.symbol, b.ts, {q('m.x', 4)} AS ta_macd_0, {q('sg.y', 4)} AS ta_macd_1, {q('m.x - sg.y', 4)} AS ta_macd_2 FROM b LEFT JOIN m USING (symbol, rn) LEFT JOIN sg USING (symbol, rn)"""
)
def indicator_macd(spark, sf):
    return ind.macd_ema(bars(spark, sf)).select("symbol", "ts", *[r(f"ta_macd_{i}", 4).alias(f"ta_macd_{i}") for i in range(3)])


@query(
    f"""{WITH}, mv AS MATERIALIZED (SELECT symbol, ts, rn, close, CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0) END AS g, CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END AS l, CASE WHEN c1 IS NOT NULL THEN tr END AS t,
CASE WHEN c1 IS NULL THEN NULL WHEN high - lag(high) {OVER} > lag(low) {OVER} - low AND high - lag(high) {OVER} > 0 THEN high - lag(high) {OVER} ELSE 0 END AS p, CASE WHEN c1 IS NULL THEN NULL WHEN lag(low) {OVER} - low > high - lag(high) {OVER} AND lag(low) {OVER} - low > 0 THEN lag(low) {OVER} - low ELSE 0 END AS m FROM b),
{', '.join(seeded(f'a{x}', 'mv', x, 1 / 14, 14) for x in 'gltpm')}, di AS MATERIALIZED (SELECT mv.symbol, mv.ts, mv.rn, ag.y AS g, al.y AS l, at1.y AS t, 100 * ap.y / at1.y AS pd, 100 * am.y / at1.y AS md FROM mv LEFT JOIN ag USING (symbol, rn) LEFT JOIN al USING (symbol, rn) LEFT JOIN at1 USING (symbol, rn) LEFT JOIN ap USING (symbol, rn) LEFT JOIN am USING (symbol, rn)),
dx AS MATERIALIZED (SELECT *, 100 * abs(pd - md) / (pd + md) AS x FROM di), {seeded('ad', 'dx', 'x', 1 / 14, 14)}
SELECT dx.symbol, dx.ts, {q('100 * g / (g + l)', 4)} AS ta_rsi, {q('100 * (g - l) / (g + l)', 4)} AS ta_cmo, {q('t', 4)} AS ta_atr, {q('pd', 4)} AS ta_plus_di, {q('md', 4)} AS ta_minus_di, {q('x', 4)} AS ta_dx, {q('ad.y', 4)} AS ta_adx FROM dx LEFT JOIN ad USING (symbol, rn)""".replace("at_p", "at1_p").replace("at AS", "at1 AS").replace("FROM at e", "FROM at1 e").replace("at e JOIN", "at1 e JOIN")
)
def indicator_scans(spark, sf):
    return ind.directional(bars(spark, sf)).select("symbol", "ts", *[r(n, 4).alias(n) for n in ("ta_rsi", "ta_cmo", "ta_atr", "ta_plus_di", "ta_minus_di", "ta_dx", "ta_adx")])


MORE_FRAMES = {
    "ta_bbands_1": roll("avg", "close", 5), "ta_ma": roll("avg", "close", 30), "ta_trima": "(" + " + ".join(f"lag(close, {29 - i}) {OVER} * {min(i + 1, 30 - i)}" if i < 29 else "close" for i in range(30)) + ") / 240.0",
    "ta_rocp": f"(close - lag(close, 10) {OVER}) / lag(close, 10) {OVER}", "ta_rocr": f"close / lag(close, 10) {OVER}", "ta_var": roll("var_pop", "close", 5),
    "ta_linearreg_intercept": f"CASE WHEN count(close) {frame(14)} >= 14 THEN avg(close) {frame(14)} - regr_slope(close, rn) {frame(14)} * 6.5 END", "ta_linearreg_angle": f"CASE WHEN count(close) {frame(14)} >= 14 THEN degrees(atan(regr_slope(close, rn) {frame(14)})) END",
    "ta_tsf": f"CASE WHEN count(close) {frame(14)} >= 14 THEN avg(close) {frame(14)} + regr_slope(close, rn) {frame(14)} * 7.5 END",
    "ta_stoch_0": "sk", "ta_macdext_0": "dm", "ta_macdext_1": roll("avg", "dm", 9), "ta_macdext_2": f"dm - {roll('avg', 'dm', 9)}",
    "ta_beta": f"CASE WHEN count(rh) {frame(5)} >= 5 THEN coalesce(covar_pop(rh, rl) {frame(5)} / nullif(var_pop(rh) {frame(5)}, 0), 0) END",
}


#: Ratios and weighted means of prices with two decimals often end in a five at the fourth digit; with more digits both engines round them alike.
DIGITS = {"ta_rocp": 9, "ta_rocr": 9, "ta_trima": 7, "ta_mavp": 7}


@query(
    f"""{WITH}, k AS MATERIALIZED (SELECT *, CASE WHEN {roll('max', 'high', 5)} > {roll('min', 'low', 5)} THEN 100 * (close - {roll('min', 'low', 5)}) / ({roll('max', 'high', 5)} - {roll('min', 'low', 5)}) WHEN {roll('max', 'high', 5)} IS NOT NULL THEN 0 END AS fk,
{roll('avg', 'close', 12)} - {roll('avg', 'close', 26)} AS dm, high / lag(high) {OVER} - 1 AS rh, low / lag(low) {OVER} - 1 AS rl, floor(least(greatest(low, 2), 30))::BIGINT AS span FROM b),
s AS MATERIALIZED (SELECT *, {roll('avg', 'fk', 3)} AS sk FROM k), mp AS (SELECT a.symbol, a.rn, avg(o.high) AS v FROM k a JOIN b o ON o.symbol = a.symbol AND o.rn BETWEEN a.rn - a.span + 1 AND a.rn WHERE a.rn >= 30 GROUP BY a.symbol, a.rn),
ex AS (SELECT a.symbol, a.rn, max(o.rn) FILTER (o.high = m.hh) - max(o.rn) FILTER (o.low = m.ll) AS d FROM b a JOIN (SELECT symbol, rn, {roll('max', 'high', 15)} AS hh, {roll('min', 'low', 15)} AS ll FROM b) m USING (symbol, rn) JOIN b o ON o.symbol = a.symbol AND o.rn BETWEEN a.rn - 14 AND a.rn GROUP BY a.symbol, a.rn)
SELECT s.symbol, s.ts, {', '.join(f'{q(x, DIGITS.get(n, 4))} AS {n}' for n, x in MORE_FRAMES.items())}, {q('100 * ex.d / 14', 4)} AS ta_aroonosc, {q("mp.v", 7)} AS ta_mavp FROM s LEFT JOIN mp USING (symbol, rn) LEFT JOIN ex USING (symbol, rn)"""
)
def indicator_more_frames(spark, sf):
    return ind.frames(bars(spark, sf)).select("symbol", "ts", *[r(n, DIGITS.get(n, 4)).alias(n) for n in (*MORE_FRAMES, "ta_aroonosc", "ta_mavp")])


def chained(names: list[str], alpha: float, seed: int) -> str:
    """CTEs of seeded means, each of the one before it, the first of closes."""
    out = [seeded(names[0], "b", "close", alpha, seed)]
    for before, n in zip(names, names[1:]):
        out += [f"{n}_i AS MATERIALIZED (SELECT b.symbol, b.rn, {before}.y AS x FROM b LEFT JOIN {before} USING (symbol, rn))", seeded(n, f"{n}_i", "x", alpha, seed)]
    return ", ".join(out)


MORE_SCANS = ("ta_t3", "ta_macdfix_0", "ta_macdfix_1", "ta_macdfix_2", "ta_trange", "ta_natr", "ta_plus_dm", "ta_minus_dm", "ta_adxr", "ta_stochrsi_0", "ta_stochrsi_1")
RISE, FALL = f"high - lag(high) {OVER}", f"lag(low) {OVER} - low"


@query(
    f"""{WITH}, {chained([f't{i}' for i in range(1, 7)], 1 / 3, 5)}, lt AS MATERIALIZED (SELECT *, CASE WHEN rn > 14 THEN close END AS late FROM b), {seeded('ff', 'lt', 'late', 0.15, 12)}, {seeded('fs', 'b', 'close', 0.075, 26)},
mf AS MATERIALIZED (SELECT b.symbol, b.rn, ff.y - fs.y AS x FROM b LEFT JOIN ff USING (symbol, rn) LEFT JOIN fs USING (symbol, rn)), {seeded('mg', 'mf', 'x', 0.2, 9)},
mv AS MATERIALIZED (SELECT symbol, ts, rn, close, CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0) END AS g, CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END AS l, CASE WHEN c1 IS NOT NULL THEN tr END AS t,
CASE WHEN c1 IS NULL THEN NULL WHEN {RISE} > {FALL} AND {RISE} > 0 THEN {RISE} ELSE 0 END AS p, CASE WHEN c1 IS NULL THEN NULL WHEN {FALL} > {RISE} AND {FALL} > 0 THEN {FALL} ELSE 0 END AS m FROM b),
{', '.join(seeded(f'w{x}', 'mv', x, 1 / 14, 14) for x in 'gltpm')}, di AS MATERIALIZED (SELECT mv.symbol, mv.ts, mv.rn, mv.close, mv.t AS tr, 100 * wg.y / (wg.y + wl.y) AS rsi, wt.y AS t, wp.y AS p, wm.y AS m FROM mv LEFT JOIN wg USING (symbol, rn) LEFT JOIN wl USING (symbol, rn) LEFT JOIN wt USING (symbol, rn) LEFT JOIN wp USING (symbol, rn) LEFT JOIN wm USING (symbol, rn)),
dx AS MATERIALIZED (SELECT *, 100 * abs(p - m) / (p + m) AS x FROM di), {seeded('ad', 'dx', 'x', 1 / 14, 14)},
sr AS MATERIALIZED (SELECT dx.*, ad.y AS adx, CASE WHEN {roll('max', 'rsi', 14)} > {roll('min', 'rsi', 14)} THEN 100 * (rsi - {roll('min', 'rsi', 14)}) / ({roll('max', 'rsi', 14)} - {roll('min', 'rsi', 14)}) WHEN {roll('max', 'rsi', 14)} IS NOT NULL THEN 0 END AS sk FROM dx LEFT JOIN ad USING (symbol, rn))
SELECT sr.symbol, sr.ts, {q('(-(0.7 ** 3)) * t6.y + (3 * 0.49 + 3 * 0.7 ** 3) * t5.y + (-6 * 0.49 - 3 * 0.7 - 3 * 0.7 ** 3) * t4.y + (1 + 3 * 0.7 + 0.7 ** 3 + 3 * 0.49) * t3.y', 4)} AS ta_t3,
{q('mf.x', 4)} AS ta_macdfix_0, {q('mg.y', 4)} AS ta_macdfix_1, {q('mf.x - mg.y', 4)} AS ta_macdfix_2, {q('sr.tr', 4)} AS ta_trange, {q('100 * sr.t / sr.close', 4)} AS ta_natr, {q('sr.p * 14', 4)} AS ta_plus_dm, {q('sr.m * 14', 4)} AS ta_minus_dm,
{q('(sr.adx + lag(sr.adx, 13) OVER (PARTITION BY sr.symbol ORDER BY sr.ts)) / 2', 4)} AS ta_adxr, {q('sr.sk', 4)} AS ta_stochrsi_0, {q('avg3', 4)} AS ta_stochrsi_1
FROM (SELECT *, {roll('avg', 'sk', 3)} AS avg3 FROM sr) sr LEFT JOIN t3 USING (symbol, rn) LEFT JOIN t4 USING (symbol, rn) LEFT JOIN t5 USING (symbol, rn) LEFT JOIN t6 USING (symbol, rn) LEFT JOIN mf USING (symbol, rn) LEFT JOIN mg USING (symbol, rn)"""
)
def indicator_more_scans(spark, sf):
    return ind.scans(bars(spark, sf)).select("symbol", "ts", *[r(n, 4).alias(n) for n in MORE_SCANS])


@query(
    f"""{WITH}, kp AS MATERIALIZED (SELECT *, lag(high) {OVER} AS h1, lag(low) {OVER} AS l1, lag(close, 30) {OVER} AS c30, sum(abs(close - c1)) {frame(30)} AS path FROM b),
kw AS MATERIALIZED (SELECT symbol, rn, close, c1, (CASE WHEN path > 0 THEN least(1, abs(close - c30) / path) ELSE 1 END * (2 / 3.0 - 2 / 31.0) + 2 / 31.0) ** 2 AS k FROM kp),
ka AS (SELECT symbol, rn, c1 + k * (close - c1) AS y FROM kw WHERE rn = 31 UNION ALL SELECT w.symbol, w.rn, e.y + w.k * (w.close - e.y) FROM ka e JOIN kw w ON w.symbol = e.symbol AND w.rn = e.rn + 1),
sa(symbol, rn, up, sar, far, f, y) AS (
  SELECT symbol, 1::BIGINT, NOT fell, CASE WHEN fell THEN h1 ELSE l1 END, CASE WHEN fell THEN low ELSE high END, 0.02::DOUBLE, NULL::DOUBLE FROM (SELECT *, l1 - low > high - h1 AND l1 - low > 0 AS fell FROM kp WHERE rn = 2)
  UNION ALL
  SELECT symbol, rn, now, CASE WHEN now THEN least(y + f2 * (far2 - y), l1, low) ELSE greatest(y + f2 * (far2 - y), h1, high) END, far2, f2, y
  FROM (SELECT *, CASE WHEN NOT turn THEN sar WHEN now THEN least(far, l1, low) ELSE greatest(far, h1, high) END AS y, CASE WHEN turn OR beyond THEN CASE WHEN now THEN high ELSE low END ELSE far END AS far2, CASE WHEN turn THEN 0.02 WHEN beyond THEN least(0.2, f + 0.02) ELSE f END AS f2
    FROM (SELECT s.symbol, p.rn, s.sar, s.far, s.f, p.high, p.low, p.h1, p.l1, CASE WHEN s.up THEN p.low <= s.sar ELSE p.high >= s.sar END AS turn, CASE WHEN s.up THEN p.low > s.sar ELSE p.high >= s.sar END AS now, CASE WHEN s.up THEN p.high > s.far ELSE p.low < s.far END AS beyond
      FROM sa s JOIN kp p ON p.symbol = s.symbol AND p.rn = s.rn + 1)))
SELECT b.symbol, b.ts, {q('ka.y', 4)} AS ta_kama, {q('sa.y', 4)} AS ta_sar, {q('CASE WHEN sa.up THEN sa.y ELSE -sa.y END', 4)} AS ta_sarext FROM b LEFT JOIN ka USING (symbol, rn) LEFT JOIN sa USING (symbol, rn)"""
)
def indicator_walks(spark, sf):
    return ind.walks(bars(spark, sf)).select("symbol", "ts", *[r(n, 4).alias(n) for n in ("ta_kama", "ta_sar", "ta_sarext")])


@query()
def indicator_cycles(spark, sf):
    """The dominant cycle and what follows from it: a machine without an SQL form; the tests hold its bounds."""
    return ind.walks(bars(spark, sf)).select("symbol", "ts", "ta_ht_dcperiod", "ta_ht_dcphase", "ta_ht_trendline", "ta_ht_trendmode", "ta_mama_0", "ta_mama_1")


NORMAL = ["ta_willr", "ta_sma", "ta_stddev", "ta_mom"]
Z = lambda x, b: f"CASE WHEN {x} IS NOT NULL THEN least(greatest(({x} - avg({x}) OVER p) / stddev_pop({x}) OVER p, -{b}), {b}) END"


@query(
    f"""{WITH}, i AS (SELECT symbol, ts, {FRAMES['ta_willr']} AS w, ({roll('avg', 'close', 30)} - close) / ({roll('avg', 'tr', 14)} + 1e-8) AS s, {roll('stddev_pop', 'close', 5)} AS sd, (close - lag(close, 10) {OVER} - close) / ({roll('avg', 'tr', 14)} + 1e-8) AS m FROM b)
SELECT symbol, ts, {q('CASE WHEN w IS NOT NULL THEN least(greatest(CASE WHEN min(w) OVER p < -50 THEN (w + 50) / 50 ELSE (w - 50) / 50 END, -1), 1) END', 4)} AS ta_willr, {q(Z('s', 6), 4)} AS ta_sma, {q(Z('sd', 5), 4)} AS ta_stddev, {q(Z('m', 6), 4)} AS ta_mom FROM i WINDOW p AS (PARTITION BY symbol)"""
)
def indicator_normalized(spark, sf):
    from ..functions.series import rolling_mean, true_range

    b = ind.frames(bars(spark, sf).withColumn("_tr", true_range())).withColumn("ta_atr", rolling_mean("_tr", 14))
    return ind.normalized(b, NORMAL).select("symbol", "ts", *[r(n, 4).alias(n) for n in NORMAL])


def avg_before(x: str, n: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {w} >= {n} THEN avg({x}) {w} END"


CANDLE_SQL = (
    f"""{WITH}, an AS MATERIALIZED (SELECT symbol, ts, rn, open AS o, high AS h, low AS l, close AS c, CASE WHEN close >= open THEN 1 ELSE -1 END AS g, abs(close - open) AS b, high - low AS r, high - greatest(open, close) AS u, least(open, close) - low AS d FROM b),
av AS MATERIALIZED (SELECT *, {avg_before('b', 10)} AS ab, {avg_before('r', 10)} AS ar, {avg_before('r', 5)} AS aq, {avg_before('u + d', 10)} AS asd FROM an),
fl AS MATERIALIZED (SELECT *, b > ab AS ll, b < ab AS ss, b <= 0.1 * ar AS dd, u < 0.1 * ar AS vv, d < 0.1 * ar AS yy, u < asd / 2 AS us, d < asd / 2 AS ds, 0.2 * aq AS n, 0.6 * aq AS f, 0.05 * aq AS e FROM av),
lg AS MATERIALIZED (SELECT symbol, ts, rn, """
    + ", ".join(f"lag({p2}, {k}) {OVER} AS {cd.FLAGS.get(p, p)}{k}" for p, p2 in [(p, {"L": "ll", "S": "ss", "D": "dd", "V": "vv", "Y": "yy"}.get(p, p)) for p in cd.PARTS if p != "l"] + [("lw", "l")] for k in range(cd.BARS))
    + " FROM fl) SELECT symbol, ts, "
)


def duck(sql: str) -> str:
    """DuckDB's names don't tell cases apart either; the low's columns are renamed."""
    import re

    return re.sub(r"\bl(\d)\b", r"lw\1", cd.spark_text(sql))


@query(CANDLE_SQL + ", ".join(f"(CASE WHEN rn > 14 THEN {duck(cd.rule_sql(n))} END)::INTEGER AS ta_cdl{n}" for n in sorted(cd.RULES)) + " FROM lg")
def candles(spark, sf):
    return cd.candles(bars(spark, sf), sorted(cd.RULES))


def confirmed(way: str, inner: int) -> str:
    """The pattern, or twice its sign where one of the last three bars had it and the close leaves the inside bar on its side."""
    later = " ".join(f"WHEN lag({way}, {k}) {OVER} <> 0 THEN CASE WHEN lag({way}, {k}) {OVER} = 1 AND c0 > lag(h0, {k + inner}) {OVER} THEN 2 WHEN lag({way}, {k}) {OVER} = -1 AND c0 < lag(lw0, {k + inner}) {OVER} THEN -2 ELSE 0 END" for k in (1, 2, 3))
    return f"(CASE WHEN rn <= 14 THEN NULL WHEN {way} <> 0 THEN {way} {later} ELSE 0 END)::INTEGER"


@query(
    CANDLE_SQL.removesuffix(" SELECT symbol, ts, ")
    + f""", hk AS MATERIALIZED (SELECT symbol, ts, rn, h0, lw0, c0, CASE WHEN h1 < h2 AND lw1 > lw2 THEN CASE WHEN h0 < h1 AND lw0 < lw1 THEN 1 WHEN h0 > h1 AND lw0 > lw1 THEN -1 ELSE 0 END ELSE 0 END AS plain,
CASE WHEN h2 < h3 AND lw2 > lw3 AND h1 < h2 AND lw1 > lw2 THEN CASE WHEN h0 < h1 AND lw0 < lw1 AND c2 <= lw2 + n2 THEN 1 WHEN h0 > h1 AND lw0 > lw1 AND c2 >= h2 - n2 THEN -1 ELSE 0 END ELSE 0 END AS modified FROM lg)
SELECT symbol, ts, {confirmed('plain', 1)} AS ta_cdlhikkake, {confirmed('modified', 2)} AS ta_cdlhikkakemod FROM hk"""
)
def candles_hikkake(spark, sf):
    return cd.candles(bars(spark, sf), ["hikkake", "hikkakemod"])
