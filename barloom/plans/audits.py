"""Queries of the audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.series import log_return
from ..operators import audit as au
from ..operators import features as ft
from ..operators import search as se
from .base import BARS, OVER, WITH, bars, frame, q, query, r, roll, seeded
from .search import SPLIT
from .series import label_sql, labelled

rounded = lambda df, *cols: df.withColumns({c: r(c) for c in cols})


@query(
    f"""{WITH}, d AS (SELECT *, date_diff('second', lag(ts) {OVER}, ts) AS gap FROM b) SELECT symbol, count(*) AS rows, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS null_rows,
count(*) - count(DISTINCT (ts, open, high, low, close)) AS duplicated_rows, count(*) - count(DISTINCT ts) AS duplicated_timestamps, count(*) FILTER (high < low) AS high_lt_low, count(*) FILTER (open > high OR open < low) AS open_outside_hl,
count(*) FILTER (close > high OR close < low) AS close_outside_hl, count(*) FILTER (least(open, high, low, close) <= 0) AS nonpositive_prices, count(*) FILTER (gap <= 0) AS non_monotonic FROM d GROUP BY symbol"""
)
def audit_integrity(spark, sf):
    return au.integrity(bars(spark, sf))


@query(f"{WITH}, d AS (SELECT symbol, date_diff('second', lag(ts) {OVER}, ts) AS seconds FROM b), n AS (SELECT symbol, seconds, count(*) AS n FROM d WHERE seconds IS NOT NULL GROUP BY ALL) SELECT symbol, seconds, n, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, seconds)::INTEGER AS place FROM n QUALIFY place <= 5")
def audit_time_deltas(spark, sf):
    return au.top_deltas(bars(spark, sf))


DIST = ("mean", "std", "least", "most")


@query(
    f"""{WITH}, t AS (SELECT symbol, lr AS x, abs(lr) AS a FROM b WHERE lr IS NOT NULL) SELECT symbol, count(*) AS n, {q('avg(x)')} AS mean, {q('stddev_pop(x)')} AS std, {q('min(x)')} AS least, {q('max(x)')} AS most, count(*) FILTER (x = 0) AS exact_zero, count(*) FILTER (a <= 1e-12) AS eps_zero,
count(*) FILTER (a < 1e-8) AS lt_1e8, count(*) FILTER (a < 1e-6) AS lt_1e6, count(*) FILTER (a > 0 AND a < 0.01) AS to_01, count(*) FILTER (a >= 0.01 AND a < 0.03) AS to_03, count(*) FILTER (a >= 0.03 AND a < 0.05) AS to_05, count(*) FILTER (a >= 0.05 AND a < 0.1) AS to_10,
count(*) FILTER (a >= 0.1) AS from_10, count(*) FILTER (a <= 0.02) AS flat, count(*) FILTER (x > 0) AS positive, count(*) FILTER (x < 0) AS negative FROM t GROUP BY symbol"""
)
def audit_target_distribution(spark, sf):
    return rounded(au.target_distribution(bars(spark, sf).withColumn("lr", log_return()).where("lr is not null"), "lr"), *DIST)


LAB = f"{WITH}, {label_sql(20, 1.0, 0.8)}"


@query(f"{LAB}, k AS (SELECT symbol, ts, target, CASE WHEN target = 1 THEN 'positive' WHEN target = -1 THEN 'negative' WHEN target = 0 THEN 'zero' END AS kind FROM lab) SELECT symbol, ts, kind AS \"case\", row_number() OVER (PARTITION BY symbol, kind ORDER BY ts)::INTEGER AS place FROM k WHERE kind IS NOT NULL QUALIFY place <= 10")
def audit_examples(spark, sf):
    t = F.col("target")
    return au.examples(labelled(spark, sf), {"positive": t == 1, "negative": t == -1, "zero": t == 0}).select("symbol", "ts", "case", "place")


CORRS = ["fwd_1", "fwd_2", "fwd_3", "past_1", "past_2", "past_3", "same_bar", "leakage_risk"]
RET = "(close - c1) / greatest(c1, 1e-12)"


@query(
    f"""{LAB}, v2 AS (SELECT l.symbol, l.ts, l.target::DOUBLE AS y, v.close, lag(v.close) OVER (PARTITION BY l.symbol ORDER BY l.ts) AS c1 FROM lab l JOIN v USING (symbol, ts)),
rr AS (SELECT symbol, ts, y, {RET} AS r FROM v2), x AS (SELECT *, {', '.join(f'lead(r, {k}) {OVER} AS fwd_{k}, lag(r, {k}) {OVER} AS past_{k}' for k in (1, 2, 3))}, r AS same_bar FROM rr),
o AS (SELECT symbol, {', '.join(f'corr({c}, y) AS {c}' for c in CORRS[:-1])} FROM x GROUP BY symbol) SELECT symbol, {', '.join(f'{q(c)} AS {c}' for c in CORRS[:-1])}, {q('greatest(abs(past_1), abs(past_2), abs(past_3), abs(same_bar))')} AS leakage_risk FROM o"""
)
def audit_label_correlations(spark, sf):
    return rounded(au.label_correlations(labelled(spark, sf), "target"), *CORRS)


RATES = {"tp_hit_rate": (1, 2, 5), "sl_first_rate": (3, 4, 6), "timeout_rate": (8,), "neutral_rate": (7, 9)}


def rate(codes: tuple[int, ...]) -> str:
    return f"count(*) FILTER (code IN ({', '.join(map(str, codes))})) / count(*)"


@query(f"{LAB} SELECT symbol, {', '.join(f'{q(rate(k))} AS {n}' for n, k in RATES.items())}, {rate((3, 4, 6))} = 0 AND {rate((1, 2, 5))} > 0 AS anomaly FROM lab GROUP BY symbol")
def audit_outcome_rates(spark, sf):
    return rounded(au.outcome_rates(labelled(spark, sf)), *RATES)


@query(
    f"""{LAB} SELECT symbol, count(*) AS n_total, count(*) FILTER (target = 1) AS n_long, count(*) FILTER (target = -1) AS n_short, count(*) FILTER (target = 0) AS n_neutral, count(*) FILTER (target = -99) AS n_whipsaw, count(*) FILTER (code IN (1, 2)) AS tp_count,
count(*) FILTER (code IN (3, 4)) AS sl_count, count(*) FILTER (code = 8) AS timeout_count, count(*) FILTER (code = 5) AS both_tp_count, count(*) FILTER (code = 6) AS both_sl_count, count(*) FILTER (code = 7) AS ambiguous_count, count(*) FILTER (code = 9) AS wide_candle_count,
{q('avg(bar - (i + 1))')} AS avg_hold, {q('count(*) FILTER (target IN (1, -1)) / count(*)')} AS signal_pct FROM lab GROUP BY symbol"""
)
def audit_labels(spark, sf):
    return rounded(au.label_audit(labelled(spark, sf)), "avg_hold", "signal_pct")


@query(f"{LAB}, d AS (SELECT symbol, ts AS decision, row_number() {OVER} AS k FROM lab QUALIFY k <= 8) SELECT d.symbol, decision, k::INTEGER AS k, (x.rn - y.rn)::INTEGER AS step, x.ts, x.close FROM d JOIN b y ON y.symbol = d.symbol AND y.ts = d.decision JOIN b x ON x.symbol = d.symbol AND x.rn BETWEEN y.rn AND y.rn + 20")
def audit_forward_windows(spark, sf):
    return au.forward_windows(labelled(spark, sf), bars(spark, sf), 20).select("symbol", "decision", "k", "step", "ts", "close")


#: Features of the audits: some of one price, so that collinear pairs are there.
FEATS = ["lr", "lr2", "icp", "rng", "one"]
FEAT_SQL = f"""{SPLIT}, ft AS MATERIALIZED (SELECT symbol, ts, part, lr, lr * 2 + 0.01 * sign(lr) AS lr2, CASE WHEN high - low < 1e-6 THEN 0.0 ELSE (close - low) / (high - low + 1e-10) * 2 - 1 END AS icp, tr / (high + 1e-10) AS rng, 1.0 AS one,
CASE WHEN lead(close) {OVER} > close THEN 1.0 WHEN lead(close) {OVER} IS NOT NULL THEN -1.0 END AS y FROM parts),
lf AS MATERIALIZED ({' UNION ALL '.join(f"SELECT symbol, ts, part, y, '{f}' AS feature, {f}::DOUBLE AS value FROM ft" for f in FEATS)})"""


def feature_table(spark, sf):
    from ..functions.series import lag, true_range

    b = se.temporal_split(bars(spark, sf), 26).withColumn("lr", log_return())
    span, e = F.col("high") - F.col("low"), 1e-10
    ahead = lag("close", -1)
    return b.select(
        "symbol", "ts", "part", "lr", (F.col("lr") * 2 + 0.01 * F.signum("lr")).alias("lr2"), F.when(span < 1e-6, 0.0).otherwise((F.col("close") - F.col("low")) / (span + e) * 2 - 1).alias("icp"), (true_range() / (F.col("high") + e)).alias("rng"), F.lit(1.0).alias("one"),
        F.when(ahead > F.col("close"), 1.0).when(ahead.isNotNull(), -1.0).alias("y"),
    )


def long(spark, sf):
    return au.long_form(feature_table(spark, sf), FEATS, ["part", "y"])


REPORT = "rp AS (SELECT feature, avg((value IS NULL)::INT) AS nan_pct, count(DISTINCT value) AS n_unique, stddev_samp(value) AS std, avg(value) AS mean, min(value) AS least, max(value) AS most, avg((abs(value) >= 0.999)::INT) AS sat FROM lf GROUP BY feature)"


@query(f"{WITH}, {FEAT_SQL}, {REPORT} SELECT feature, n_unique, n_unique <= 1 AS dead, {', '.join(f'{q(c)} AS {c}' for c in ('nan_pct', 'std', 'mean', 'least', 'most'))}, {q('CASE WHEN n_unique > 2 THEN sat END')} AS saturated_pct FROM rp")
def audit_features(spark, sf):
    return rounded(au.feature_report(long(spark, sf)), "nan_pct", "std", "mean", "least", "most", "saturated_pct")


@query(f"{WITH}, {FEAT_SQL}, {REPORT} SELECT {q('max(std)')} AS max_std, {q('min(std)')} AS min_std, {q('median(std)')} AS median_std, {q('max(std) / median(std)')} AS max_over_median, max(std) / median(std) <= 20 AS ok FROM rp WHERE std > 0")
def audit_scale_dominance(spark, sf):
    return rounded(au.scale_dominance(au.feature_report(long(spark, sf))), "max_std", "min_std", "median_std", "max_over_median")


@query(f"{WITH}, {FEAT_SQL}, c AS (SELECT feature, corr(value, y) AS c FROM lf WHERE value IS NOT NULL AND y IS NOT NULL AND feature <> 'one' GROUP BY feature), t AS (SELECT *, row_number() OVER (ORDER BY abs(c) DESC, feature) AS p FROM c) SELECT max(feature) FILTER (p = 1) AS feature, {q('max(c) FILTER (p = 1)')} AS corr, {q('max(abs(c)) FILTER (p = 1) / max(abs(c)) FILTER (p = 2)')} AS top_over_second, max(abs(c)) FILTER (p = 1) / max(abs(c)) FILTER (p = 2) <= 3 AS ok FROM t")
def audit_predictive_dominance(spark, sf):
    return rounded(au.predictive_dominance(au.target_corr(long(spark, sf).where("feature <> 'one'"), "y")), "corr", "top_over_second")


@query(f"{WITH}, {FEAT_SQL}, p AS (SELECT * FROM ft WHERE lr IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {q(f'corr({a}, {b})')} AS corr FROM p HAVING abs(corr({a}, {b})) >= 0.6" for a, b in (("lr", "lr2"), ("lr", "icp"), ("lr", "rng"), ("lr2", "icp"), ("lr2", "rng"), ("icp", "rng"))))
def audit_collinearity(spark, sf):
    return rounded(au.collinear_pairs(feature_table(spark, sf).where("lr is not null"), FEATS[:4], 0.6), "corr")


@query(
    f"{WITH}, {FEAT_SQL} SELECT symbol, count(*) AS rows, '' AS high_nan, 'one' AS dead, CASE WHEN abs(corr(lr, y)) > 0.95 THEN 'lr' ELSE '' END AS leaky, count(*) - count(DISTINCT ts) AS repeated_times, greatest(floor(count(*) * 0.8) - 26, 0)::BIGINT AS train_rows, (count(*) - floor(count(*) * 0.8))::BIGINT AS holdout_rows, 'dead' AS flags FROM ft GROUP BY symbol"
)
def audit_readiness(spark, sf):
    return au.readiness(feature_table(spark, sf), FEATS, "y", 26)


PROF = ("mean", "std", "skew", "kurtosis", "p25", "p75", "p99", "over_95", "over_99")


@query(f"{WITH}, {FEAT_SQL} SELECT feature, count(*)::DOUBLE AS n, {q('avg(value)')} AS mean, {q('stddev_samp(value)')} AS std, {q('skewness(value)')} AS skew, {q('kurtosis(value)')} AS kurtosis, {', '.join(f'{q(f'quantile_cont(value, {p})')} AS {n}' for p, n in ((0.25, 'p25'), (0.75, 'p75'), (0.99, 'p99')))}, {q('avg((abs(value) > 0.95)::INT)')} AS over_95, {q('avg((abs(value) > 0.99)::INT)')} AS over_99 FROM lf WHERE value IS NOT NULL AND feature <> 'one' GROUP BY feature")
def audit_profile(spark, sf):
    return rounded(au.profile(long(spark, sf).where("feature <> 'one'")), *PROF)


@query(
    f"""{WITH}, s AS (SELECT symbol, ts, {roll('avg', 'ps', 13)} AS feat_icp, (high - greatest(open, close)) / (high - low + 1e-10) AS up FROM (SELECT *, CASE WHEN high - low < 1e-6 THEN 0.0 ELSE least(greatest((close - low) / (high - low + 1e-10), 0), 1) * 2 - 1 END AS ps FROM b)),
u AS (SELECT 'feat_icp' AS feature, least(greatest(feat_icp, -1), 1) AS v, -1 AS lo, 1 AS hi FROM s WHERE feat_icp IS NOT NULL UNION ALL SELECT 'feat_rejection_upper', least(greatest(up, 0), 1), 0, 1 FROM s)
SELECT feature, {q('min(v)')} AS least, {q('max(v)')} AS most, {q('avg((v BETWEEN lo AND hi)::INT)')} AS in_bounds, false AS violates, false AS exceeds FROM u GROUP BY feature"""
)
def audit_bounds(spark, sf):
    f = ["feat_icp", "feat_rejection_upper"]
    return rounded(au.bounds_compliance(au.long_form(ft.frame_features(bars(spark, sf)), f)), "least", "most", "in_bounds")


TANH_SQL = "sc AS (SELECT symbol, greatest(quantile_cont(abs(lr), 0.75), 1e-8) AS s FROM ft WHERE part = 'train' GROUP BY symbol), th AS MATERIALIZED (SELECT ft.symbol, ts, part, y, lr, tanh(lr / s) AS z FROM ft JOIN sc USING (symbol))"


def scaled(spark, sf):
    df = feature_table(spark, sf)
    fit = se.fit_tanh(df.where("part = 'train'"), ["lr"])
    return df.join(fit, "symbol").withColumn("z", F.tanh(F.col("lr") / F.col("_scale_lr")))


@query(f"{WITH}, {FEAT_SQL}, {TANH_SQL} SELECT symbol, {q('avg((abs(z) > 0.95)::INT)')} AS over_95, {q('avg((abs(z) > 0.99)::INT)')} AS over_99 FROM th WHERE z IS NOT NULL GROUP BY symbol")
def audit_tanh_saturation(spark, sf):
    z = scaled(spark, sf).select("symbol", F.col("z").alias("value")).withColumn("feature", F.lit("z"))
    return rounded(au.profile(z, ("symbol",)).select("symbol", "over_95", "over_99"), "over_95", "over_99")


RANKS = "rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry"


@query(f"{WITH}, {FEAT_SQL}, k AS (SELECT feature, value, y, {RANKS} FROM lf WHERE value IS NOT NULL AND y IS NOT NULL AND feature <> 'one') SELECT feature, {q('corr(value, y)')} AS pearson, {q('corr(rx, ry)')} AS spearman FROM k GROUP BY feature")
def audit_correlations(spark, sf):
    return rounded(au.correlations(long(spark, sf).where("feature <> 'one'"), "y"), "pearson", "spearman")


@query(
    f"""{WITH}, {FEAT_SQL}, z AS (SELECT feature, value, y FROM lf WHERE value IS NOT NULL AND y IS NOT NULL AND feature <> 'one'), e AS (SELECT feature, quantile_cont(value, [{', '.join(str(i / 20) for i in range(1, 20))}]) AS q FROM z GROUP BY feature),
cd AS (SELECT z.feature, len(list_filter(list_distinct(q), lambda t: t <= value)) AS cx, y FROM z JOIN e USING (feature)), n AS (SELECT feature, cx, y, count(*) AS n FROM cd GROUP BY ALL),
p AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p, sum(n) OVER (PARTITION BY feature, cx) / sum(n) OVER (PARTITION BY feature) AS px, sum(n) OVER (PARTITION BY feature, y) / sum(n) OVER (PARTITION BY feature) AS py FROM n)
SELECT feature, {q('sum(p * ln(p / (px * py + 1e-12) + 1e-12))')} AS mi FROM p GROUP BY feature"""
)
def audit_mutual_information(spark, sf):
    return rounded(au.mutual_information(long(spark, sf).where("feature <> 'one'"), "y"), "mi")


@query(
    f"""{WITH}, {FEAT_SQL}, v AS (SELECT feature, value, count(*) FILTER (part = 'train') AS a, count(*) FILTER (part = 'holdout') AS h FROM lf WHERE value IS NOT NULL AND part IN ('train', 'holdout') AND feature <> 'one' GROUP BY ALL),
g AS (SELECT feature, abs(sum(a) OVER o / sum(a) OVER w - sum(h) OVER o / sum(h) OVER w) AS gap, lead(value) OVER (PARTITION BY feature ORDER BY value) - value AS wd FROM v WINDOW o AS (PARTITION BY feature ORDER BY value), w AS (PARTITION BY feature))
SELECT feature, {q('max(gap)')} AS ks, {q('sum(gap * coalesce(wd, 0))')} AS wasserstein FROM g GROUP BY feature"""
)
def audit_drift(spark, sf):
    return rounded(au.drift(long(spark, sf).where("feature <> 'one'")).select("feature", "ks", "wasserstein"), "ks", "wasserstein")


@query(f"{WITH}, {FEAT_SQL}, {TANH_SQL}, k AS (SELECT symbol AS feature, rank() OVER (PARTITION BY symbol ORDER BY lr) + (count(*) OVER (PARTITION BY symbol, lr) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol ORDER BY z) + (count(*) OVER (PARTITION BY symbol, z) - 1) / 2 AS c FROM th WHERE z IS NOT NULL AND abs(z) < 0.999999) SELECT feature, {q('corr(a, c)')} AS spearman FROM k GROUP BY feature")
def audit_rank_preservation(spark, sf):
    z = scaled(spark, sf).where("abs(z) < 0.999999").select(F.col("symbol").alias("feature"), F.col("lr").alias("value"), "z")
    return rounded(au.correlations(z, "z").select("feature", "spearman"), "spearman")


__all__ = ["BARS", "frame", "seeded"]
