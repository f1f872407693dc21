"""Whole jobs: search for formulas over a symbol's bars, grade what was found, and audit bars, labels and features."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formula as fm
from ..functions.formula import show
from ..operators import audit as au
from ..operators import evolve as ev
from ..operators import features as ft
from ..operators import labels as lb
from ..operators import leaderboard as bd
from ..operators import orderblocks as ob
from ..operators import regime as rg
from ..operators import search as se
from ..operators import signals as sg
from ..sources import sinks
from ..sources.store import cut

META = "run string, fold long, regime string, formula_hash string, formula string, return_pct double, sharpe double, max_dd double, win_rate double, profit_factor double, n_trades long, n_long long, n_short long, coverage_pct double, prog_length int, n_features int, winner boolean, fail_reason string, buy_threshold double, sell_threshold double"


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("feat_", "ret_norm_", "macd_", "vs_factor_", "ewma_vol_"))]


def prepare(bars: DataFrame, p: ft.Profile = ft.SHORT, horizon: int = 26, tp: float = 2.4, sl: float = 1.9, zones: bool = True) -> DataFrame:
    """Bars with features and labels; rows without a value of any feature are left out."""
    df = cut(ft.build(bars, p))
    if zones:
        df = df.join(ob.order_blocks(bars), ["symbol", "ts"])
    names = feature_names(df)
    labels = lb.triple_barrier(ft.wilder_atr(bars), horizon, tp, sl).select("symbol", "ts", "atr", "target", "event_type", "event_code", "is_valid", "event_bar_pos", "pos")
    return df.join(labels, ["symbol", "ts"]).na.drop("any", subset=names)


def discover(bars: DataFrame, symbol: str, settings: ev.Settings, generations: int = 50, p: ft.Profile = ft.SHORT, horizon: int = 26, window: int = 500, out: str | None = None, seed: int = 0, zones: bool = False) -> tuple[DataFrame, DataFrame]:
    """(generations, winners) of a search over one symbol; written below ``out`` if it is given.

    Labels that say a side train the programs; the holdout's bars, all of them in a row, test each generation's best.
    """
    spark = bars.sparkSession
    own = cut(prepare(cut(bars.where(F.col("symbol") == symbol)), p, horizon, zones=zones))
    names = feature_names(own)
    split = se.temporal_split(own, horizon)
    _, scaled_names = ft.Buckets().split(names)
    fit = se.fit_tanh(split.where("part = 'train'"), scaled_names)
    scaled = cut(se.apply_tanh(split, fit, scaled_names))
    train = cut(lb.training_rows(scaled.where("part = 'train'")).select("ts", "target", *names))
    if train.isEmpty():
        raise ValueError(f"no rows to train on for {symbol}")
    hold = scaled.where("part = 'holdout'")
    regime = rg.classify(own.where(F.col("ts") < hold.agg(F.min("ts")).first()[0]).select("symbol", "ts", "open", "high", "low", "close")).first()
    regime = regime["regime"] if regime else "random_walk"
    settings = ev.for_regime(settings, regime)
    state, rows, seen = ev.Outer([], {}, []), [], Counter()
    for gen in range(1, generations + 1):
        won = spark.createDataFrame([(symbol, w["formula"]) for w in state.winners], "run string, formula string")
        lost = spark.createDataFrame([(symbol, *x) for x in state.losses.items()], "run string, feature string, losses double")
        prior = {r["feature"]: r["prob"] for r in bd.feature_prior(won, lost, names, spark.createDataFrame([(symbol,)], "run string")).collect()}
        result = ev.evolve_rows(train, names, "target", ["ts"], settings, seed + gen, [prior[n] for n in names], state.pool)
        row = dict.fromkeys([x.split()[0] for x in META.split(", ")]) | {"run": symbol, "fold": gen, "regime": regime, "winner": False}
        if result.best is None:
            rows.append(row | {"fail_reason": "too long"})
            continue
        text = show(result.best)
        digest = spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]
        used = fm.features_used(result.best)
        row |= {"formula": text, "formula_hash": digest, "prog_length": len(result.best), "n_features": len(used)}
        score = fm.to_column(result.best)
        reason = fm.guard(result.best)
        good = reason is None and se.signal_quality(scaled.where("part = 'train'").withColumn("gp_score", score), "gp_score").first()
        if reason is None and not good["good"]:
            reason = "degenerate signal"
        if reason is None and digest in {w["formula_hash"] for w in state.winners}:
            reason = "known winner"
        if reason is None:
            row |= {"buy_threshold": good["entry"], "sell_threshold": good["exit"]} | evaluate(hold.withColumn("gp_score", score), window)
            signature = (round(row["return_pct"] or 0, 2), round(row["sharpe"] or 0, 2), round(row["profit_factor"] or 0, 2), row["n_trades"])
            seen[signature] += 1
            reason = bd.survivor_gate(spark.createDataFrame([tuple(row.values())], META)).first()["fail_reason"]
            if reason is None:
                row["winner"] = True
                state.winners = sorted([*state.winners, row], key=lambda w: -w["sharpe"])[:100]
            else:
                held = {f for w in state.winners for f in fm.features_used(w["formula"])}
                for f in used - held:
                    state.losses[f] = state.losses.get(f, 0.0) + 1.0
                if seen[signature] >= 3:
                    state.losses, state.pool = {}, []
        rows.append(row | {"fail_reason": reason})
        state = ev.outer_step(state, result, digest, settings)
    meta = spark.createDataFrame([tuple(r.values()) for r in rows], META)
    wins = meta.where("winner")
    if out:
        sinks.write_parquet(meta, f"{out}/generations")
        sinks.write_csv(meta.drop("formula"), f"{out}/generations_csv")
        sinks.write_parquet(wins, f"{out}/winners")
        curve = bd.stitch_equity(wins)
        sinks.write_parquet(curve, f"{out}/equity")
        sinks.write_csv(curve, f"{out}/equity_csv")
    return meta, wins


def evaluate(scored: DataFrame, window: int) -> dict:
    """Trades of a score on the holdout, as figures."""
    df = sg.executable(sg.entries(scored, "gp_score", window))
    cover = sg.coverage(df).first()
    stats = sg.portfolio_stats(sg.simulate(df)).first()
    figures = {k: stats[k] for k in ("return_pct", "sharpe", "max_dd", "win_rate", "profit_factor", "n_trades")}
    return figures | {"n_long": cover["n_long"], "n_short": cover["n_short"], "coverage_pct": cover["coverage_pct"]}


def grade(wins: DataFrame, folds: DataFrame, names: list[str], out: str, regime: str | None = None) -> DataFrame:
    """The graded board, written as parquet, CSV and a text of its best."""
    board = bd.build_board(wins, folds, names, regime)
    sinks.write_parquet(board, f"{out}/board")
    sinks.write_csv(board, f"{out}/board_csv")
    best = board.orderBy("rank").select("rank", "formula_hash", "grade", "composite_score", "position_size_frac", "grade_reasons").limit(20)
    counts = board.groupBy("grade").agg(F.count("*").alias("n")).orderBy("grade")
    sinks.write_markdown({"Grades": counts, "Best": best}, f"{out}/board_text")
    return board


def audit(bars: DataFrame, out: str, p: ft.Profile = ft.SHORT, horizon: int = 26) -> dict[str, DataFrame]:
    """Reports of bars, labels and features, written as JSON and Markdown."""
    bars = cut(bars)
    df = cut(prepare(bars, p, horizon, zones=False))
    names = feature_names(df)
    labels = cut(lb.triple_barrier(ft.wilder_atr(bars), horizon))
    part = se.temporal_split(df, horizon)
    long = au.long_form(part, names, ["part", "target"])
    features = au.feature_report(long)
    train = long.where("part = 'train' and target in (1, -1)")
    reports = {
        "Bars": au.integrity(bars), "Time deltas": au.top_deltas(bars), "Outcomes": au.outcome_rates(labels), "Labels": au.label_audit(labels), "Label correlations": au.label_correlations(labels, "target"),
        "Targets": au.target_distribution(labels.where("is_valid"), "target"), "Readiness": au.readiness(df, names, "target", horizon), "Features": features, "Scale": au.scale_dominance(features),
        "Predictive": au.predictive_dominance(au.target_corr(train, "target")), "Collinear": au.collinear_pairs(df, names), "Bounds": au.bounds_compliance(long), "Correlations": au.correlations(train, "target"),
        "Information": au.mutual_information(train, "target"), "Drift": au.drift(long),
    }
    sinks.write_json(reports, f"{out}/audit_json")
    sinks.write_markdown(reports, f"{out}/audit_text")
    return reports


__all__ = ["SparkSession", "audit", "discover", "evaluate", "grade", "prepare"]
