"""Gates, feedback and grading of formulas found, and the curve that their returns make together.

Tables: ``wins`` (run, fold, formula_hash, formula, return_pct, sharpe, win_rate, max_dd, profit_factor, n_long, n_short, coverage_pct)
and ``folds`` (run, fold, sharpe, winner, regime, ...). One schema serves the search that writes and the grading that reads. Runs are graded each by itself:
what the later folds of a run say comes from a walk over the run's folds, and is joined to the wins on run, formula and fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formula import used_of
from ..functions.moments import following

#: Columns of both tables (fixed values).
WINS = ["fold", "formula_hash", "return_pct", "sharpe", "win_rate", "max_dd", "profit_factor", "buy_threshold", "sell_threshold", "n_long", "n_short", "coverage_pct"]
FOLDS = ["fold", "return_pct", "sharpe", "max_dd", "win_rate", "n_features", "prog_length", "coverage_pct", "winner", "regime"]

#: Gates of a survivor, and grading thresholds (fixed values).
MIN_TRADES, MIN_RETURN, MIN_SHARPE, MAX_DD, MAX_DD_HIGH, HIGH_SHARPE, MIN_PF, MIN_COVERAGE = 30, 0.5, 0.3, 25.0, 35.0, 3.5, 1.1, 15.0
SURVIVAL, REGIMES, FRESH, SPREAD = (0.60, 0.30), (2, 1), (0.60, 0.30), (0.80, 1.50)
LEAST_FOLDS, KELLY_CAPS, RECENT = 2, {"A": 0.20, "B": 0.10}, 5


def survivor_gate(df: DataFrame) -> DataFrame:
    """``fail_reason`` of the first gate missed, else NULL."""
    limit = F.when(F.col("sharpe") > HIGH_SHARPE, MAX_DD_HIGH).otherwise(MAX_DD)
    reason = (
        F.when(F.col("n_trades") < MIN_TRADES, "trades").when(F.col("return_pct") <= MIN_RETURN, "return").when(F.col("sharpe") <= MIN_SHARPE, "sharpe")
        .when(F.col("max_dd") >= limit, "drawdown").when(F.col("profit_factor") < MIN_PF, "profit factor").when(F.col("coverage_pct") < MIN_COVERAGE, "coverage")
    )
    return df.withColumn("fail_reason", reason)


def signature_streaks(df: DataFrame, order: str = "gen", key: str = "run", stale: int = 2, repeat: int = 3) -> DataFrame:
    """``signature`` of rounded results, how often it came so far, how long it has lasted, and whether either calls for a fresh pool."""
    parts = [F.bround(F.col(c), 2).cast("string") for c in ("return_pct", "sharpe", "profit_factor")]
    w = Window.partitionBy(key).orderBy(order)
    out = df.withColumn("signature", F.concat_ws("|", *parts, F.col("n_trades").cast("string")))
    out = out.withColumn("_new", F.when(F.lag("signature").over(w).eqNullSafe(F.col("signature")), 0).otherwise(1))
    out = out.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumns({"seen": F.row_number().over(Window.partitionBy(key, "signature").orderBy(order)), "lasted": F.row_number().over(Window.partitionBy(key, "_island").orderBy(order)) - 1})
    return out.withColumns({"stale": F.col("lasted") >= stale, "repeated": F.col("seen") >= repeat}).drop("_new", "_island")


def unseen(candidates: DataFrame, winners: DataFrame) -> DataFrame:
    """Candidates whose formula hash no winner has."""
    return candidates.join(winners.select("formula_hash").distinct(), "formula_hash", "left_anti")


def loss_feedback(failed: DataFrame, winners: DataFrame, known: list[str], key: str = "run") -> DataFrame:
    """run, feature, losses: features of failed formulas that no winner of the run holds."""
    lost = failed.select(key, F.explode(used_of("formula", known)).alias("feature")).groupBy(key, "feature").agg(F.count("*").alias("losses"))
    held = winners.select(key, F.explode(used_of("formula", known)).alias("feature")).distinct()
    return lost.join(held, [key, "feature"], "left_anti")


def feature_prior(winners: DataFrame, losses: DataFrame, known: list[str], runs: DataFrame, alpha: float = 5.0, decay: float = 0.4, penalty: float = 0.5, most: float = 1.8, key: str = "run") -> DataFrame:
    """run, feature, prob for each of ``runs`` (run): smoothed wins less losses, capped at a multiple of the even share."""
    wins = winners.select(key, F.explode(used_of("formula", known)).alias("feature")).groupBy(key, "feature").agg(F.count("*").alias("wins"))
    names = runs.select(key, F.explode(F.array(*[F.lit(x) for x in known])).alias("feature"))
    out = names.join(wins, [key, "feature"], "left").join(losses, [key, "feature"], "left")
    net = F.greatest(F.coalesce("wins", F.lit(0)) - penalty * F.coalesce("losses", F.lit(0)), F.lit(0.0)) * decay + alpha
    whole = Window.partitionBy(key)
    out = out.withColumn("p", net / F.sum(net).over(whole)).withColumn("p", F.least("p", F.lit(most / len(known))))
    return out.select(key, "feature", (F.col("p") / F.sum("p").over(whole)).alias("prob"))


def trim(board: DataFrame, most: int = 100) -> DataFrame:
    """The best by Sharpe ratio."""
    return board.orderBy(F.desc("sharpe"), "formula_hash").limit(most)


def seed_pool(winners: DataFrame, elite: DataFrame, size: int = 200, share: float = 0.4) -> DataFrame:
    """formula, origin: at most ``share`` of the pool from winners, the rest from the elite, best first."""
    first = winners.orderBy(F.desc("sharpe"), "formula").limit(max(1, int(size * share))).select("formula", F.lit("winner").alias("origin"), F.lit(0).alias("_o"), F.col("sharpe").alias("_s"))
    rest = elite.orderBy(F.desc("fitness"), "formula").limit(size).select("formula", F.lit("elite").alias("origin"), F.lit(1).alias("_o"), F.col("fitness").alias("_s"))
    return first.union(rest).orderBy("_o", F.desc("_s"), "formula").limit(size).select("formula", "origin")


# Grading.


def forward_walk(wins: DataFrame, folds: DataFrame, key: str = "run") -> DataFrame:
    """run, formula_hash, fold and what the run's later folds say: number, survival, mean and deviation of the ratio, winners, slope.

    Slopes and deviations add the later folds up in their order, as the grades' thresholds are met exactly and the last bit then decides. A run's folds lie in one
    task; the steps are its winners times their later folds, a fold further for all winners at once.
    """
    no = F.lit(None)
    kinds = {c: t for c, t in wins.dtypes if c in (key, "formula_hash", "fold")}
    rows = folds.select(key, "fold", F.lit(0).alias("_own"), F.col("sharpe").cast("double").alias("_s"), F.coalesce(F.col("winner").cast("int"), F.lit(0)).alias("_w"), no.cast(kinds["formula_hash"]).alias("formula_hash"))
    own = wins.select(key, "fold", F.lit(1).alias("_own"), no.cast("double").alias("_s"), F.lit(0).alias("_w"), "formula_hash")
    rows = rows.union(own).where(F.col(key).isNotNull() & F.col("fold").isNotNull())
    names = {"_n": "long", "_pos": "long", "_win": "long", "_m": "double", "_sd": "double", "_sp": "double", "_k": "double"}
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", " + ", ".join(f"{c} {t}" for c, t in names.items())

    def later(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of whole runs."""
        is_own = pdf["_own"].to_numpy() == 1
        run = pdf[key].ne(pdf[key].shift()).cumsum().to_numpy() - 1
        before = np.cumsum(~is_own)
        end = np.zeros(run[-1] + 1, dtype=np.int64)
        end[run] = before  # the last row of each run stays
        start = before[is_own]
        end = end[run[is_own]]
        s = pdf["_s"].to_numpy(float)[~is_own]
        pos, win = (np.concatenate([[0], np.cumsum(x)]) for x in (s > 0, pdf["_w"].to_numpy()[~is_own]))
        m = following(s, start, end - start)
        made = {"_n": end - start, "_pos": pos[end] - pos[start], "_win": win[end] - win[start], "_m": m["mean"], "_sd": m["sd"], "_sp": m["sp"], "_k": m["slope"]}
        return pdf.loc[is_own, list(kinds)].assign(**made)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            last = (pdf[key] == pdf[key].iloc[-1]).to_numpy()
            if held and (not last.all() or pdf[key].iloc[0] != held[-1][key].iloc[-1]):
                whole = pd.concat([*held, pdf[~last]], ignore_index=True)
                held = []
                yield later(whole)
            elif not last.all():
                yield later(pdf[~last].reset_index(drop=True))
            held.append(pdf[last])
        if held:
            yield later(pd.concat(held, ignore_index=True))

    out = rows.repartition(key).sortWithinPartitions(key, "fold", "_own", "_s").mapInPandas(walk, schema)
    enough = F.col("_n") >= LEAST_FOLDS
    slope = F.when((F.col("_n") >= 3) & (F.col("_sp") > 1e-8), F.col("_k")).otherwise(0.0)
    when = lambda c: F.when(enough, c)
    return out.select(
        key, "formula_hash", "fold", F.col("_n").alias("fw_n_folds"), when(F.col("_pos") / F.col("_n")).alias("fw_survival_rate"), when(F.col("_m")).alias("fw_mean_sharpe"), when(F.col("_sd")).alias("fw_std_sharpe"),
        F.when(enough, F.col("_pos")).otherwise(0).alias("fw_positive_folds"), F.when(enough, F.col("_win")).otherwise(0).alias("fw_winner_folds"), when(slope).alias("fw_sharpe_decay"), enough.alias("fw_data_sufficient"),
    )


def freshness(wins: DataFrame, known: list[str], recent: int = RECENT, key: str = "run") -> DataFrame:
    """run, formula_hash, fold, feature_freshness: share of a formula's features in the last later winners of its run; 0 without features or where those have none, NULL without later winners.

    The last later winners are, of the run's last ``recent``, those after the formula's fold.
    """
    own = wins.select(key, "formula_hash", "fold", used_of("formula", known).alias("features"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("fold"), F.desc("formula_hash")))
    last = own.withColumn("_p", place).where(F.col("_p") <= recent).groupBy(key).agg(F.collect_list(F.struct("fold", "features")).alias("_last"))
    later = F.filter("_last", lambda x: x["fold"] > F.col("fold"))
    out = own.join(last, key).withColumn("_later", later)
    seen = F.flatten(F.transform("_later", lambda x: x["features"]))
    share = F.when(F.size("features") == 0, 0.0).when(F.size("_later") == 0, None).otherwise(F.size(F.array_intersect("features", seen)) / F.greatest(F.size("features"), F.lit(1)))
    return out.select(key, "formula_hash", "fold", "features", share.alias("feature_freshness"))


def regime_coverage(wins: DataFrame, folds: DataFrame, key: str = "run") -> DataFrame:
    """run, formula_hash, fold, discovery_regime, n_regimes, regimes: of its own fold and of the run's later winning folds; each regime's last winning fold tells."""
    own = wins.select(key, "formula_hash", "fold").join(folds.select(key, "fold", F.col("regime").alias("discovery_regime")), [key, "fold"], "left").withColumn("discovery_regime", F.coalesce("discovery_regime", F.lit("unknown")))
    last = folds.where("winner and regime is not null").groupBy(key, F.col("regime").alias("_r")).agg(F.max("fold").alias("_f"))
    last = last.groupBy(key).agg(F.collect_list(F.struct("_r", "_f")).alias("_last"))
    later = F.transform(F.filter(F.coalesce("_last", F.array()), lambda x: x["_f"] > F.col("fold")), lambda x: x["_r"])
    names = F.array_sort(F.array_distinct(F.concat(F.array("discovery_regime"), later)))
    out = own.join(last, key, "left").withColumn("_names", names)
    return out.select(key, "formula_hash", "fold", "discovery_regime", F.size("_names").alias("n_regimes"), F.array_join("_names", "|").alias("regimes"))


def uniform(seed: int, *parts: Column) -> Column:
    """Between 0 and 1 from an MD5, so SQL knows the same numbers."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def null_ratios(spark: SparkSession, trades: int, draws: int, seed: int) -> DataFrame:
    """n_trades, ratios: sorted Sharpe ratios of ``draws`` strategies without an edge, after each number of trades up to ``trades``."""
    d = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(trades))).alias("i"))
    x = F.sqrt(-2 * F.ln(uniform(seed, F.col("draw"), F.col("i"), F.lit("r")))) * F.cos(2 * math.pi * uniform(seed, F.col("draw"), F.col("i"), F.lit("a")))
    so_far = Window.partitionBy("draw").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("x", x).select("i", F.avg("x").over(so_far).alias("m"), F.stddev_pop("x").over(so_far).alias("sd"))
    ratio = F.when(F.col("sd") < 1e-8, 0.0).otherwise(F.col("m") / F.greatest("sd", F.lit(1e-8)) * F.sqrt("i"))
    return d.groupBy(F.col("i").alias("n_trades")).agg(F.sort_array(F.collect_list(ratio)).alias("ratios"))


#: Numbers in the table of draws up to which it is broadcast.
BROADCAST_DRAWS = 4_000_000


def significance(df: DataFrame, draws: int = 2000, seed: int = 42) -> DataFrame:
    """``p_value``: share of ``draws`` strategies without an edge and with as many trades that do as well; 1 below 10 trades.

    The draws are a table by number of trades, joined to the rows. ``n_trades`` must be a whole number.
    """
    top = df.agg(F.max("n_trades")).first()[0]
    if top is None or top < 10:
        return df.withColumn("p_value", F.lit(1.0))
    (name, ratios) = (next(c for c in (n + "_" * k for k in range(9)) if c not in df.columns) for n in ("trades_drawn", "ratios"))
    table = null_ratios(df.sparkSession, int(top), draws, seed).where("n_trades >= 10").select(F.col("n_trades").alias(name), F.col("ratios").alias(ratios))
    table = F.broadcast(table) if int(top) * draws <= BROADCAST_DRAWS else table
    out = df.join(table, df["n_trades"] == F.col(name), "left")
    as_well = F.size(F.filter(ratios, lambda x: x >= F.col("sharpe"))) / float(draws)
    return out.withColumn("p_value", F.when(F.col(name).isNull(), 1.0).otherwise(as_well)).drop(name, ratios)


def kelly(win_rate: Column, profit_factor: Column, cap: Column, fraction: float = 0.25) -> Column:
    """A quarter of the Kelly share, with odds of the profit factor less one, up to ``cap``."""
    w, b = win_rate / 100, profit_factor - 1
    full = F.try_divide(w * b - (1 - w), b)
    return F.when((profit_factor > 1) & (win_rate > 0) & (win_rate < 100) & (full > 0), F.least(full * fraction, cap)).otherwise(0.0)


def to_even(c: Column, digits: int) -> Column:
    """Rounded to even as SQL's ``round_even`` does it, on the scaled double: 0.30925 times 10,000 is just above 3092.5, so it goes up, where ``bround`` sees a tie in the digits."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def grade(df: DataFrame) -> DataFrame:
    """``grade`` and ``grade_reasons`` from significance, survival, regimes, freshness and steadiness."""
    surv, reg, fresh, sd, enough, decay = (F.col(c) for c in ("fw_survival_rate", "n_regimes", "feature_freshness", "fw_std_sharpe", "fw_data_sufficient", "fw_sharpe_decay"))
    no = lambda c: F.coalesce(c, F.lit(False))
    one = lambda c: F.when(no(c), 1).otherwise(0)
    severe = enough & (decay < -0.20)
    strikes = 2 * one(severe) + one(~enough | (surv < SURVIVAL[1])) + one(reg < REGIMES[1]) + one(fresh < FRESH[1]) + one(sd > SPREAD[1])
    points = one(enough & (surv >= SURVIVAL[0])) + one(reg >= REGIMES[0]) + one(fresh >= FRESH[0]) + one(sd <= SPREAD[0])
    insignificant, collapsed = F.col("p_value") > 0.10, no(enough & (surv < 0.10))
    letter = F.when(insignificant | collapsed | (strikes >= 3), "DISCARD").when((points >= 3) & (strikes == 0), "A").when((points >= 2) & (strikes <= 1), "B").otherwise("C")
    text = [
        F.when(severe, "severe decay"),
        F.when(~enough, "too few later folds").when(surv >= SURVIVAL[0], None).when(surv >= SURVIVAL[1], F.concat(F.lit("moderate survival "), percent(surv))).otherwise(F.concat(F.lit("weak survival "), percent(surv))),
        F.when(reg >= REGIMES[0], None).when(reg >= REGIMES[1], "single regime").otherwise("no regime"),
        F.when(fresh.isNull(), "freshness unknown").when(fresh >= FRESH[0], None).when(fresh >= FRESH[1], "moderate freshness").otherwise("stale features"),
        F.when(sd.isNull() | (sd <= SPREAD[0]), None).when(sd <= SPREAD[1], "moderate spread").otherwise("unsteady"),
    ]
    reasons = F.when(insignificant, "insignificant").when(collapsed, "collapsed").otherwise(F.array_join(F.array_compact(F.array(*text)), " | "))
    return df.withColumns({"grade": letter, "grade_reasons": F.when(reasons == "", "all criteria met").otherwise(reasons)})


def kill_switch(df: DataFrame) -> DataFrame:
    """Per grade: drawdown, losses in a row, rolling ratio and folds at which trading stops for a review."""
    g, dd, s = F.col("grade"), F.col("max_dd"), F.col("sharpe")
    pick = lambda a, b, c: F.when(g == "A", a).when(g == "B", b).otherwise(c)
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "kill_dd_pct": pick(F.least(dd * 2, F.lit(MAX_DD * 1.5)), F.least(dd * 1.5, F.lit(MAX_DD)), F.lit(5.0)),
            "kill_consec_losses": pick(F.lit(8), F.lit(5), F.lit(3)),
            "kill_rolling_sharpe": pick(F.greatest(zero, s * 0.30), F.greatest(zero, s * 0.50), zero),
            "review_after_folds": pick(F.lit(3), F.lit(2), F.lit(1)),
        }
    )


def build_board(wins: DataFrame, folds: DataFrame, known: list[str], regime: str | None = None, draws: int = 2000, key: str = "run") -> DataFrame:
    """A graded, sized and ranked row per formula; ranks count within a run."""
    keys = [key, "formula_hash", "fold"]
    df = wins.withColumn("n_trades", (F.col("n_long") + F.col("n_short")).cast("int"))
    df = significance(df, draws).join(forward_walk(wins, folds, key), keys).join(regime_coverage(wins, folds, key), keys).join(freshness(wins, known, key=key), keys)
    df = kill_switch(grade(df))
    match = F.col("discovery_regime").eqNullSafe(F.lit(regime)) if regime else F.lit(False)
    cap = F.when(F.col("grade") == "A", KELLY_CAPS["A"]).when(F.col("grade") == "B", KELLY_CAPS["B"]).otherwise(0.0)
    size = kelly(F.col("win_rate"), F.col("profit_factor"), cap)
    bonus = match & F.col("grade").isin("A", "B")
    df = df.join(folds.groupBy(key).agg(F.max("fold").alias("_top")), key, "left")
    df = df.withColumns({"current_regime_match": match, "position_size_frac": to_even(F.when(bonus, F.least(size * 1.2, cap)).otherwise(size), 4), "regime_size_bonus": bonus})
    recency = F.when(F.col("_top") > 0, F.col("fold") / F.col("_top")).otherwise(0.0)
    steady = 1 / (1 + F.coalesce("fw_std_sharpe", F.lit(1.0)))
    # A fifth of the regimes is taken in tenths, as SQL's decimals are: 0.2 * 3 is 0.6000000000000001 in doubles.
    score = 0.35 * F.coalesce("fw_survival_rate", F.lit(0.0)) + 2 * F.col("n_regimes") / 10.0 / 5 + 0.15 * F.coalesce("feature_freshness", F.lit(0.5)) + 0.10 * steady + 0.10 * recency + 0.10 * (1 - F.col("p_value"))
    df = df.withColumns({"recency_score": to_even(recency, 3), "composite_score": to_even(score, 4), "significant_p05": F.col("p_value") < 0.05, "features_used": F.when(F.size("features") > 0, F.array_join("features", "|")).otherwise("unknown")})
    order = F.when(F.col("grade") == "A", 0).when(F.col("grade") == "B", 1).when(F.col("grade") == "C", 2).otherwise(3)
    place = Window.partitionBy(key).orderBy(order, F.desc("composite_score"), "formula_hash")
    return df.withColumn("rank", F.row_number().over(place)).drop("_top", "features")


def stitch_equity(wins: DataFrame, order: str = "fold", key: str = "run") -> DataFrame:
    """nav_start, nav_end and drawdown of returns compounded in order of the folds; the drawdown counts from the first fold's end."""
    w = Window.partitionBy(key).orderBy(order)
    nav = F.exp(F.sum(F.log1p(F.col("return_pct") / 100)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = wins.withColumn("nav_end", nav).withColumn("nav_start", F.coalesce(F.lag("nav_end").over(w), F.lit(1.0)))
    top = F.max("nav_end").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("drawdown", (F.col("nav_end") - top) / top)


def equity_summary(stitched: DataFrame, order: str = "fold", key: str = "run") -> DataFrame:
    """Return, mean ratio, worst drawdown, mean win rate, and return since the first fold over the drawdown."""
    last, first = F.max_by("nav_end", order), F.min_by("nav_end", order)
    worst = F.min("drawdown")
    return stitched.groupBy(key).agg(
        ((last - 1) * 100).alias("return_pct"), F.avg("sharpe").alias("sharpe"), (worst * 100).alias("worst_dd_pct"), F.avg("win_rate").alias("win_rate"), F.when(worst != 0, (last / first - 1) / F.abs(worst)).alias("calmar")
    )
