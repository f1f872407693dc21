"""Queries of gates, feedback, grading and equity, over tables of candidates derived from orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import leaderboard as lb
from .base import q, query, r

KNOWN = [f"x{i}" for i in range(12)]
REGIMES = ["trending", "mean_reverting", "choppy_random_walk", "random_walk"]
LIST = "[" + ", ".join(f"'{x}'" for x in KNOWN) + "]"

#: Candidates: results from an order's numbers, a formula of three features; a run is the orders of ten neighbouring customers, so runs stay as long as they are when the table grows.
CANDS_SQL = """c AS MATERIALIZED (SELECT o_custkey // 10 AS run, row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderkey) AS gen, sha256('f' || o_orderkey) AS formula_hash,
'add(mul(x' || (o_orderkey % 12) || ', x' || (o_custkey % 12) || '), x' || (o_orderkey % 7) || ')' AS formula,
(o_orderkey % 13) / 7.0::DOUBLE - 0.5 AS return_pct, (o_custkey % 17 + o_orderkey % 3) / 4.0::DOUBLE - 0.25 AS sharpe, 30 + (o_custkey + o_orderkey) % 41 AS win_rate, (o_orderkey % 37)::DOUBLE AS max_dd, 0.9 + (o_custkey % 11) / 9.0::DOUBLE AS profit_factor,
o_orderkey % 50 AS n_long, o_custkey % 45 AS n_short, (o_orderkey % 60)::DOUBLE AS coverage_pct, (o_orderkey % 50 + o_custkey % 45) AS n_trades FROM orders)"""
REASON = "CASE WHEN n_trades < 30 THEN 'trades' WHEN return_pct <= 0.5 THEN 'return' WHEN sharpe <= 0.3 THEN 'sharpe' WHEN max_dd >= CASE WHEN sharpe > 3.5 THEN 35 ELSE 25 END THEN 'drawdown' WHEN profit_factor < 1.1 THEN 'profit factor' WHEN coverage_pct < 15 THEN 'coverage' END"
FOLDS_SQL = f"f AS MATERIALIZED (SELECT run, gen AS fold, sharpe, {REASON} IS NULL AS winner, ['trending','mean_reverting','choppy_random_walk','random_walk'][gen % 4 + 1] AS regime FROM c)"
WINS_SQL = f"w AS MATERIALIZED (SELECT run, gen AS fold, formula_hash, formula, return_pct, sharpe, win_rate, max_dd, profit_factor, n_long, n_short, coverage_pct FROM c WHERE {REASON} IS NULL)"
USED = f"list_sort(list_intersect(list_distinct(regexp_extract_all(formula, '[A-Za-z_]\\w*')), {LIST}))"
BASE = f"WITH {CANDS_SQL}"


def candidates(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    run = F.floor(u / 10).cast("long")
    return o.select(
        run.alias("run"), F.row_number().over(Window.partitionBy(run).orderBy("o_orderkey")).cast("long").alias("gen"), F.sha2(F.concat(F.lit("f"), s(k)), 256).alias("formula_hash"),
        F.concat(F.lit("add(mul(x"), s(k % 12), F.lit(", x"), s(u % 12), F.lit("), x"), s(k % 7), F.lit(")")).alias("formula"),
        (k % 13 / 7.0 - 0.5).alias("return_pct"), ((u % 17 + k % 3) / 4.0 - 0.25).alias("sharpe"), (30 + (u + k) % 41).alias("win_rate"), (k % 37).cast("double").alias("max_dd"), (0.9 + u % 11 / 9.0).alias("profit_factor"),
        (k % 50).alias("n_long"), (u % 45).alias("n_short"), (k % 60).cast("double").alias("coverage_pct"), (k % 50 + u % 45).alias("n_trades"),
    )


def folds(spark, sf):
    regime = F.element_at(F.array(*[F.lit(x) for x in REGIMES]), (F.col("gen") % 4 + 1).cast("int"))
    return lb.survivor_gate(candidates(spark, sf)).select("run", F.col("gen").alias("fold"), "sharpe", F.col("fail_reason").isNull().alias("winner"), regime.alias("regime"))


def wins(spark, sf):
    c = lb.survivor_gate(candidates(spark, sf)).where("fail_reason is null")
    return c.select("run", F.col("gen").alias("fold"), "formula_hash", "formula", "return_pct", "sharpe", "win_rate", "max_dd", "profit_factor", "n_long", "n_short", "coverage_pct")


@query(f"{BASE} SELECT run, gen, {REASON} AS fail_reason FROM c")
def gate_survivors(spark, sf):
    return lb.survivor_gate(candidates(spark, sf)).select("run", "gen", "fail_reason")


#: Results that only differ beyond what a signature rounds away.
SIG = f"""{BASE}, n AS (SELECT run, gen, gen // 5 AS e, gen % 3 AS k FROM c), s AS (SELECT run, gen, concat_ws('|', round_even(e % 3 / 4.0 + k / 1000.0, 2)::DOUBLE::VARCHAR, round_even(e % 2 + 0.5 - k / 1000.0, 2)::DOUBLE::VARCHAR, round_even(1.25 + k / 1000.0, 2)::DOUBLE::VARCHAR, (e % 2)::VARCHAR) AS signature FROM n),
k AS (SELECT *, CASE WHEN lag(signature) OVER (PARTITION BY run ORDER BY gen) = signature THEN 0 ELSE 1 END AS nw FROM s), i AS (SELECT *, sum(nw) OVER (PARTITION BY run ORDER BY gen) AS island FROM k),
z AS (SELECT run, gen, signature, row_number() OVER (PARTITION BY run, signature ORDER BY gen) AS seen, row_number() OVER (PARTITION BY run, island ORDER BY gen) - 1 AS lasted FROM i) SELECT *, lasted >= 2 AS stale, seen >= 3 AS repeated FROM z"""


@query(SIG)
def gate_signature_streaks(spark, sf):
    e, k = F.floor(F.col("gen") / 5), F.col("gen") % 3
    near = {"return_pct": e % 3 / 4.0 + k / 1000.0, "sharpe": e % 2 + 0.5 - k / 1000.0, "profit_factor": 1.25 + k / 1000.0, "n_trades": e % 2}
    out = lb.signature_streaks(candidates(spark, sf).withColumns(near))
    return out.select("run", "gen", "signature", F.col("seen").cast("long").alias("seen"), F.col("lasted").cast("long").alias("lasted"), "stale", "repeated")


@query(f"{BASE}, {WINS_SQL} SELECT run, gen FROM c WHERE formula_hash NOT IN (SELECT formula_hash FROM w)")
def gate_unseen(spark, sf):
    return lb.unseen(candidates(spark, sf), wins(spark, sf)).select("run", "gen")


LOSSES_SQL = f"{WINS_SQL}, h AS (SELECT DISTINCT run, unnest({USED}) AS feature FROM w), l AS (SELECT run, feature, count(*) AS losses FROM (SELECT run, unnest({USED}) AS feature FROM c WHERE {REASON} IS NOT NULL) x WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.run = x.run AND h.feature = x.feature) GROUP BY run, feature)"


def losses(spark, sf):
    return lb.loss_feedback(lb.survivor_gate(candidates(spark, sf)).where("fail_reason is not null"), wins(spark, sf), KNOWN)


@query(f"{BASE}, {LOSSES_SQL} SELECT * FROM l")
def feedback_losses(spark, sf):
    return losses(spark, sf)


@query(
    f"{BASE}, {LOSSES_SQL}, n AS (SELECT run, unnest({LIST}) AS feature FROM (SELECT DISTINCT run FROM c)), v AS (SELECT run, feature, count(*) AS wins FROM (SELECT run, unnest({USED}) AS feature FROM w) GROUP BY run, feature),"
    f" p AS (SELECT n.run, n.feature, greatest(coalesce(wins, 0) - 0.5 * coalesce(losses, 0), 0) * 0.4 + 5 AS m FROM n LEFT JOIN v USING (run, feature) LEFT JOIN l USING (run, feature)), z AS (SELECT run, feature, least(m / sum(m) OVER (PARTITION BY run), 1.8 / 12) AS z FROM p) SELECT run, feature, {q('z / sum(z) OVER (PARTITION BY run)')} AS prob FROM z"
)
def feedback_prior(spark, sf):
    return lb.feature_prior(wins(spark, sf), losses(spark, sf), KNOWN, candidates(spark, sf).select("run").distinct()).withColumn("prob", r("prob"))


@query(f"{BASE} SELECT formula_hash, sharpe FROM c ORDER BY sharpe DESC, formula_hash LIMIT 30")
def board_trim(spark, sf):
    return lb.trim(candidates(spark, sf), 30).select("formula_hash", "sharpe")


@query(
    f"""{BASE}, {WINS_SQL}, a AS (SELECT formula, 'winner' AS origin, 0 AS o, sharpe AS s FROM w ORDER BY sharpe DESC, formula LIMIT 8), b AS (SELECT formula, 'elite' AS origin, 1 AS o, return_pct AS s FROM c ORDER BY return_pct DESC, formula LIMIT 20)
SELECT formula, origin FROM (SELECT * FROM a UNION ALL SELECT * FROM b ORDER BY o, s DESC, formula LIMIT 20)"""
)
def board_seed_pool(spark, sf):
    return lb.seed_pool(wins(spark, sf), candidates(spark, sf).withColumn("fitness", F.col("return_pct")), 20)


KEYS = "run, formula_hash, fold"
FW = f"""{FOLDS_SQL}, {WINS_SQL}, la AS (SELECT w.run, w.formula_hash, w.fold, f.fold AS ff, f.sharpe AS s, f.winner AS win, row_number() OVER (PARTITION BY w.run, w.formula_hash, w.fold ORDER BY f.fold)::DOUBLE AS i FROM w LEFT JOIN f ON f.run = w.run AND f.fold > w.fold),
ag AS (SELECT {KEYS}, count(ff) AS n, count(*) FILTER (s > 0) AS pos, avg(s) AS m, stddev_samp(s) AS sd, stddev_pop(s) AS sp, count(*) FILTER (win) AS wn, regr_slope(s, i) AS k FROM la GROUP BY {KEYS}),
fw AS MATERIALIZED (SELECT {KEYS}, n AS fw_n_folds, CASE WHEN n >= 2 THEN pos / n END AS fw_survival_rate, CASE WHEN n >= 2 THEN m END AS fw_mean_sharpe, CASE WHEN n >= 2 THEN sd END AS fw_std_sharpe,
CASE WHEN n >= 2 THEN pos ELSE 0 END AS fw_positive_folds, CASE WHEN n >= 2 THEN wn ELSE 0 END AS fw_winner_folds, CASE WHEN n >= 2 THEN CASE WHEN n >= 3 AND sp > 1e-8 THEN k ELSE 0 END END AS fw_sharpe_decay, n >= 2 AS fw_data_sufficient FROM ag)"""
FW_COLS = ("fw_survival_rate", "fw_mean_sharpe", "fw_std_sharpe", "fw_sharpe_decay")


@query(f"{BASE}, {FW} SELECT {KEYS}, fw_n_folds, fw_positive_folds, fw_winner_folds, fw_data_sufficient, {', '.join(f'{q(x)} AS {x}' for x in FW_COLS)} FROM fw")
def board_forward_walk(spark, sf):
    out = lb.forward_walk(wins(spark, sf), folds(spark, sf))
    return out.withColumns({x: r(x) for x in FW_COLS})


FRESH_SQL = f"""u AS MATERIALIZED (SELECT {KEYS}, {USED} AS x FROM w), lt AS (SELECT a.run, a.formula_hash, a.fold, b.x, row_number() OVER (PARTITION BY a.run, a.formula_hash, a.fold ORDER BY b.fold DESC, b.formula_hash DESC) AS p FROM u a JOIN u b ON b.run = a.run AND b.fold > a.fold),
sn AS (SELECT {KEYS}, list_distinct(flatten(list(x))) AS seen FROM lt WHERE p <= 5 GROUP BY {KEYS}), fr AS MATERIALIZED (SELECT {KEYS}, x, CASE WHEN len(x) = 0 THEN 0 WHEN seen IS NULL THEN NULL ELSE len(list_intersect(x, seen)) / len(x) END AS feature_freshness FROM u LEFT JOIN sn USING ({KEYS}))"""


@query(f"{BASE}, {WINS_SQL}, {FRESH_SQL} SELECT {KEYS}, {q('feature_freshness')} AS feature_freshness FROM fr")
def board_freshness(spark, sf):
    return lb.freshness(wins(spark, sf), KNOWN).select("run", "formula_hash", "fold", r("feature_freshness").alias("feature_freshness"))


REG_SQL = """rc AS (SELECT w.run, w.formula_hash, w.fold, coalesce(o.regime, 'unknown') AS discovery_regime, list_sort(list_distinct(list_append(coalesce(list(l.regime) FILTER (l.regime IS NOT NULL), []), coalesce(o.regime, 'unknown')))) AS names
FROM w LEFT JOIN f o ON o.run = w.run AND o.fold = w.fold LEFT JOIN f l ON l.run = w.run AND l.fold > w.fold AND l.winner GROUP BY w.run, w.formula_hash, w.fold, o.regime)"""


@query(f"{BASE}, {FOLDS_SQL}, {WINS_SQL}, {REG_SQL} SELECT {KEYS}, discovery_regime, len(names)::INTEGER AS n_regimes, array_to_string(names, '|') AS regimes FROM rc")
def board_regimes(spark, sf):
    return lb.regime_coverage(wins(spark, sf), folds(spark, sf))


DRAWS = 200
U_SQL = "(('0x' || substr(md5('42:' || d || ':' || i || ':{}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE"
DRAWS_SQL = f"""dr AS (SELECT d, i, sqrt(-2 * ln({U_SQL.format('r')})) * cos(2 * pi() * {U_SQL.format('a')}) AS x FROM (SELECT unnest(range({DRAWS})) AS d), (SELECT unnest(range(1, (SELECT max(n_trades) FROM {{0}}) + 1)) AS i)),
so AS (SELECT i, avg(x) OVER (PARTITION BY d ORDER BY i) AS m, stddev_pop(x) OVER (PARTITION BY d ORDER BY i) AS sd FROM dr), ra AS MATERIALIZED (SELECT i AS n_trades, list(CASE WHEN sd < 1e-8 THEN 0 ELSE m / greatest(sd, 1e-8) * sqrt(i) END) AS x FROM so WHERE i >= 10 GROUP BY i)"""
P_VALUE = f"coalesce(len(list_filter(ra.x, lambda y: y >= sharpe)) / {DRAWS}.0::DOUBLE, 1.0)"


@query(f"{BASE}, {DRAWS_SQL.format('c')} SELECT run, gen, {q(P_VALUE)} AS p_value FROM c LEFT JOIN ra USING (n_trades)")
def board_significance(spark, sf):
    return lb.significance(candidates(spark, sf).select("run", "gen", F.col("n_trades").cast("int").alias("n_trades"), "sharpe"), DRAWS).select("run", "gen", r("p_value").alias("p_value"))


KELLY_SQL = "CASE WHEN profit_factor > 1 AND win_rate > 0 AND win_rate < 100 AND (win_rate / 100 * (profit_factor - 1) - (1 - win_rate / 100)) / (profit_factor - 1) > 0 THEN least((win_rate / 100 * (profit_factor - 1) - (1 - win_rate / 100)) / (profit_factor - 1) * 0.25, 0.2) ELSE 0 END"


@query(f"{BASE} SELECT run, gen, {q(KELLY_SQL.replace('profit_factor', '(profit_factor + 1.5)'))} AS size FROM c")
def board_kelly(spark, sf):
    return candidates(spark, sf).select("run", "gen", r(lb.kelly(F.col("win_rate"), F.col("profit_factor") + 1.5, F.lit(0.2))).alias("size"))


WT = "wt AS MATERIALIZED (SELECT *, n_long + n_short AS n_trades FROM w)"
GRADE_SQL = f"""{FW}, {FRESH_SQL}, {REG_SQL}, {WT}, {DRAWS_SQL.format('wt')}, g0 AS (SELECT wt.*, {P_VALUE} AS p_value, fw.* EXCLUDE ({KEYS}), len(rc.names) AS n_regimes, rc.discovery_regime, fr.feature_freshness FROM wt LEFT JOIN ra USING (n_trades) JOIN fw USING ({KEYS}) JOIN rc USING ({KEYS}) JOIN fr USING ({KEYS})),
g1 AS (SELECT *, (CASE WHEN fw_data_sufficient AND fw_sharpe_decay < -0.2 THEN 2 ELSE 0 END + CASE WHEN NOT fw_data_sufficient OR fw_survival_rate < 0.3 THEN 1 ELSE 0 END + CASE WHEN n_regimes < 1 THEN 1 ELSE 0 END + CASE WHEN feature_freshness < 0.3 THEN 1 ELSE 0 END + CASE WHEN fw_std_sharpe > 1.5 THEN 1 ELSE 0 END) AS strikes,
(CASE WHEN fw_data_sufficient AND fw_survival_rate >= 0.6 THEN 1 ELSE 0 END + CASE WHEN n_regimes >= 2 THEN 1 ELSE 0 END + CASE WHEN feature_freshness >= 0.6 THEN 1 ELSE 0 END + CASE WHEN fw_std_sharpe <= 0.8 THEN 1 ELSE 0 END) AS points FROM g0),
g AS MATERIALIZED (SELECT *, CASE WHEN p_value > 0.1 OR (fw_data_sufficient AND fw_survival_rate < 0.1) OR strikes >= 3 THEN 'DISCARD' WHEN points >= 3 AND strikes = 0 THEN 'A' WHEN points >= 2 AND strikes <= 1 THEN 'B' ELSE 'C' END AS grade FROM g1)"""


def graded(spark, sf):
    w, f = wins(spark, sf), folds(spark, sf)
    keys = ["run", "formula_hash", "fold"]
    p = lb.significance(w.withColumn("n_trades", (F.col("n_long") + F.col("n_short")).cast("int")), DRAWS)
    return lb.grade(p.join(lb.forward_walk(w, f), keys).join(lb.regime_coverage(w, f), keys).join(lb.freshness(w, KNOWN), keys))


@query(f"{BASE}, {GRADE_SQL} SELECT {KEYS}, grade FROM g")
def board_grade(spark, sf):
    return graded(spark, sf).select("run", "formula_hash", "fold", "grade")


@query(
    f"{BASE}, {GRADE_SQL} SELECT {KEYS}, {q('''CASE grade WHEN 'A' THEN least(max_dd * 2, 37.5) WHEN 'B' THEN least(max_dd * 1.5, 25) ELSE 5 END''')} AS kill_dd_pct, (CASE grade WHEN 'A' THEN 8 WHEN 'B' THEN 5 ELSE 3 END)::INTEGER AS kill_consec_losses,"
    f" {q('''CASE grade WHEN 'A' THEN greatest(0, sharpe * 0.3) WHEN 'B' THEN greatest(0, sharpe * 0.5) ELSE 0 END''')} AS kill_rolling_sharpe FROM g"
)
def board_kill_switch(spark, sf):
    return lb.kill_switch(graded(spark, sf)).select("run", "formula_hash", "fold", r("kill_dd_pct").alias("kill_dd_pct"), "kill_consec_losses", r("kill_rolling_sharpe").alias("kill_rolling_sharpe"))


CAP = "CASE grade WHEN 'A' THEN 0.2 WHEN 'B' THEN 0.1 ELSE 0 END"
BONUS = "discovery_regime = 'trending' AND grade IN ('A', 'B')"
BOARD_SQL = f"""{GRADE_SQL}, tp AS (SELECT run, max(fold) AS top FROM f GROUP BY run), k0 AS (SELECT g.*, top, {KELLY_SQL.replace('0.2)', CAP + ')')} AS size, fold / top AS rc0 FROM g JOIN tp USING (run)),
k1 AS (SELECT *, CASE WHEN {BONUS} THEN least(size * 1.2, {CAP}) ELSE size END AS frac, 0.35 * coalesce(fw_survival_rate, 0) + 0.2 * n_regimes / 5 + 0.15 * coalesce(feature_freshness, 0.5) + 0.1 * (1 / (1 + coalesce(fw_std_sharpe, 1))) + 0.1 * rc0 + 0.1 * (1 - p_value) AS score FROM k0),
k2 AS (SELECT *, round_even(score, 4) AS composite FROM k1)"""


@query(
    f"{BASE}, {BOARD_SQL} SELECT {KEYS}, grade, round(composite, 6) + 0.0 AS composite_score, round(round_even(rc0, 3), 6) + 0.0 AS recency_score, round(round_even(frac, 4), 6) + 0.0 AS position_size_frac, p_value < 0.05 AS significant_p05, {BONUS} AS regime_size_bonus FROM k2"
)
def board_build(spark, sf):
    """The whole board."""
    out = lb.build_board(wins(spark, sf), folds(spark, sf), KNOWN, "trending", DRAWS)
    return out.select("run", "formula_hash", "fold", "grade", r("composite_score").alias("composite_score"), r("recency_score").alias("recency_score"), r("position_size_frac").alias("position_size_frac"), "significant_p05", "regime_size_bonus")


@query(f"{BASE}, {BOARD_SQL} SELECT run, grade, count(*) AS n, max(rank)::INTEGER AS last_rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE grade WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END, composite DESC, formula_hash) AS rank FROM k2) GROUP BY run, grade")
def board_ranks(spark, sf):
    """Where each grade's ranks end in its run."""
    out = lb.build_board(wins(spark, sf), folds(spark, sf), KNOWN, "trending", DRAWS)
    return out.groupBy("run", "grade").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank"))


EQ = f"{BASE}, e AS MATERIALIZED (SELECT run, gen AS fold, sharpe, win_rate, product(1 + return_pct / 100) OVER w AS nav_end FROM c WINDOW w AS (PARTITION BY run ORDER BY gen)), d AS MATERIALIZED (SELECT *, coalesce(lag(nav_end) OVER w, 1) AS nav_start, (nav_end - max(nav_end) OVER w) / max(nav_end) OVER w AS drawdown FROM e WINDOW w AS (PARTITION BY run ORDER BY fold))"


def stitched(spark, sf):
    return lb.stitch_equity(candidates(spark, sf).withColumnRenamed("gen", "fold"))


@query(f"{EQ} SELECT run, fold, {q('nav_start')} AS nav_start, {q('nav_end')} AS nav_end, {q('drawdown')} AS drawdown FROM d")
def equity_stitch(spark, sf):
    return stitched(spark, sf).select("run", "fold", r("nav_start").alias("nav_start"), r("nav_end").alias("nav_end"), r("drawdown").alias("drawdown"))


@query(f"{EQ} SELECT run, {q('(last(nav_end ORDER BY fold) - 1) * 100')} AS return_pct, {q('avg(sharpe)')} AS sharpe, {q('min(drawdown) * 100')} AS worst_dd_pct, {q('avg(win_rate)')} AS win_rate, round(CASE WHEN min(drawdown) <> 0 THEN (last(nav_end ORDER BY fold) / first(nav_end ORDER BY fold) - 1) / abs(min(drawdown)) END, 4) + 0.0 AS calmar FROM d GROUP BY run")
def equity_summary(spark, sf):
    out = lb.equity_summary(stitched(spark, sf))
    return out.select("run", *[r(x).alias(x) for x in ("return_pct", "sharpe", "worst_dd_pct", "win_rate")], r("calmar", 4).alias("calmar"))
