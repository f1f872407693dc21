"""Evolution of formulas: the population is a small list of programs, scored on the executors.

``evolve`` scores against a matrix at hand, ``evolve_rows`` against all rows of a table of any size: each batch of rows gives every program's counts, means and
squares, and these add up, so a generation is one pass over the rows and a few numbers per program.

Programs are prefix tuples (see functions.formula). A generation bags its rows, scores every program, keeps an elite,
and fills up by tournaments, subtree crossover and three mutations; offspring over the limits is retried.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import ARITY, Program, evaluate, features_used, parse, show
from .search import DIRECTION, PEARSON, REJECTED, SPREAD, SPREAD_FLOOR, WRONG, shallow_penalty


@dataclass(frozen=True)
class Settings:
    population: int = 3000
    generations: int = 60
    phases: tuple[int, int, int] = (15, 25, 20)
    parsimony: tuple[float, float, float] = (0.001, 0.0005, 0.003)
    crossover: float = 0.60
    subtree: float = 0.12
    hoist: float = 0.05
    point: float = 0.15
    tournament: int = 7
    elite: float = 0.05
    depth: tuple[int, int] = (2, 6)
    most_depth: int = 8
    most_nodes: int = 40
    bag: float = 0.9
    retries: int = 4
    pearson: float = PEARSON
    direction: float = DIRECTION

    def __post_init__(self) -> None:
        if sum(self.phases) != self.generations:
            raise ValueError("the phases must add up to the generations")


#: Changes of the settings by regime (fixed values).
BY_REGIME = {
    "trending": {"parsimony": (0.001, 0.0003, 0.005), "crossover": 0.70, "most_depth": 6, "tournament": 12, "pearson": 0.40, "direction": 0.60},
    "mean_reverting": {"parsimony": (0.001, 0.003, 0.008), "crossover": 0.55, "most_depth": 6, "tournament": 7},
    "choppy_random_walk": {"parsimony": (0.002, 0.005, 0.010), "crossover": 0.50, "most_depth": 5, "tournament": 5},
    "trending_random_walk": {"parsimony": (0.001, 0.004, 0.010), "crossover": 0.65, "most_depth": 6, "tournament": 10},
    "random_walk": {"parsimony": (0.001, 0.0005, 0.003), "crossover": 0.60, "most_depth": 8, "tournament": 7},
}


def for_regime(s: Settings, regime: str) -> Settings:
    """An unknown regime counts as a random walk."""
    return replace(s, **BY_REGIME.get(regime, BY_REGIME["random_walk"]))


#: What a batch of rows tells of a program: rows, means and squares around them, and both sides' hits and wrong sizes.
MOMENTS = ["n", "y1", "p1", "yy", "pp", "yp", "n_up", "n_down", "hit_up", "hit_down", "wrong_up", "wrong_down"]


def moments(y: np.ndarray, p: np.ndarray) -> list[float]:
    if not np.isfinite(p).all():
        return [float(len(y)), *[math.nan] * (len(MOMENTS) - 1)]
    up, down = p[y == 1], p[y == -1]
    a, b = y - y.mean(), p - p.mean()
    return [float(x) for x in (len(y), y.mean(), p.mean(), (a * a).sum(), (b * b).sum(), (a * b).sum(), len(up), len(down), (up > 0).sum(), (down < 0).sum(), np.maximum(0, -up).sum(), np.maximum(0, down).sum())]


def score_of(m: dict[str, float], pearson: float, direction: float) -> float:
    """As operators.search.fitness, from the moments of all rows."""
    sy, sp = math.sqrt(m["yy"] / m["n"]), math.sqrt(m["pp"] / m["n"])
    corr = 0.0 if sp < 1e-9 else m["yp"] / (sy * sp * m["n"] + 1e-8)
    a, b = m["hit_up"] / (m["n_up"] + 1e-8), m["hit_down"] / (m["n_down"] + 1e-8)
    wrong = (m["wrong_up"] / m["n_up"] if m["n_up"] else 0.0) + (m["wrong_down"] / m["n_down"] if m["n_down"] else 0.0)
    return pearson * corr + direction * 2 * a * b / (a + b + 1e-8) - WRONG * wrong / 2 - SPREAD * max(0.0, SPREAD_FLOOR - sp)


def directional_score(y: np.ndarray, p: np.ndarray, pearson: float, direction: float) -> float:
    return score_of(dict(zip(MOMENTS, moments(y, p))), pearson, direction)


def penalty(p: Program, parsimony: float) -> float:
    return shallow_penalty(len(p), len(features_used(p))) + parsimony * len(p)


def program_score(p: Program, columns: dict[str, np.ndarray], y: np.ndarray, parsimony: float, s: Settings) -> float:
    out = evaluate(p, columns, len(y))
    if not np.isfinite(out).all():
        return REJECTED
    return directional_score(y, out, s.pearson, s.direction) - penalty(p, parsimony)


class Maker:
    """Random programs over features, drawn by a prior."""

    def __init__(self, features: Sequence[str], prior: Sequence[float] | None, s: Settings, rng: random.Random):
        self.features, self.s, self.rng = list(features), s, rng
        p = np.array(prior if prior is not None else [1.0] * len(self.features), float)
        self.edges = np.cumsum(p / p.sum())

    def terminal(self) -> str | float:
        if self.rng.random() < 1 / (len(self.features) + 1):
            return round(self.rng.uniform(-1, 1), 4)
        return self.features[min(int(np.searchsorted(self.edges, self.rng.random(), side="right")), len(self.features) - 1)]

    def tree(self, least: int, most: int) -> Program:
        height = self.rng.randint(least, most)

        def grow(depth: int) -> list:
            if depth >= height or depth >= least and self.rng.random() < 0.1:
                return [self.terminal()]
            f = self.rng.choice(list(ARITY))
            return [f, *[x for _ in range(ARITY[f]) for x in grow(depth + 1)]]

        return tuple(grow(0))

    def subtree(self, p: Program) -> tuple[int, int]:
        at = self.rng.randrange(len(p))
        return at, end_of(p, at)

    def cross(self, a: Program, b: Program) -> Program:
        (i, j), (k, m) = self.subtree(a), self.subtree(b)
        return a[:i] + b[k:m] + a[j:]

    def replace_subtree(self, a: Program) -> Program:
        i, j = self.subtree(a)
        return a[:i] + self.tree(0, 2) + a[j:]

    def hoist(self, a: Program) -> Program:
        i, j = self.subtree(a)
        k, m = self.subtree(a[i:j])
        return a[:i] + a[i:j][k:m] + a[j:]

    def point(self, a: Program, share: float = 0.1) -> Program:
        out = list(a)
        for i, x in enumerate(out):
            if self.rng.random() < share:
                same = [f for f in ARITY if isinstance(x, str) and x in ARITY and ARITY[f] == ARITY[x]]
                out[i] = self.rng.choice(same) if same else self.terminal()
        return tuple(out)

    def fits(self, p: Program) -> bool:
        return len(p) <= self.s.most_nodes and depth_of(p) <= self.s.most_depth

    def child(self, pick) -> Program:
        parent = pick()
        for _ in range(self.s.retries):
            x = self.rng.random()
            for share, make in ((self.s.crossover, lambda: self.cross(parent, pick())), (self.s.subtree, lambda: self.replace_subtree(parent)), (self.s.hoist, lambda: self.hoist(parent)), (self.s.point, lambda: self.point(parent))):
                if x < share:
                    made = make()
                    break
                x -= share
            else:
                return parent
            if self.fits(made):
                return made
        return parent

    def sane(self, p: Program) -> Program:
        """A seed whose unknown features give way to random ones."""
        return tuple(self.terminal() if isinstance(x, str) and x not in ARITY and x not in self.features else x for x in p)


def end_of(p: Program, at: int) -> int:
    need = 1
    while need:
        x = p[at]
        need += (ARITY[x] if isinstance(x, str) and x in ARITY else 0) - 1
        at += 1
    return at


def depth_of(p: Program) -> int:
    stack: list[int] = []
    for x in reversed(p):
        n = ARITY[x] if isinstance(x, str) and x in ARITY else 0
        stack.append(1 + max(stack.pop() for _ in range(n)) if n else 0)
    return stack[0]


def score_population(spark: SparkSession | None, programs: list[Program], columns: dict[str, np.ndarray], y: np.ndarray, parsimony: float, s: Settings, slices: int = 16) -> list[float]:
    """Scores in order: on the executors in slices, against the matrix as one broadcast, or here without a session."""
    distinct = {show(p): p for p in programs}
    if spark is None:
        known = {k: program_score(p, columns, y, parsimony, s) for k, p in distinct.items()}
    else:
        data = spark.sparkContext.broadcast((columns, y))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cols, target = data.value
            for pdf in batches:
                yield pdf.assign(score=[program_score(parse(f), cols, target, parsimony, s) for f in pdf["formula"]])

        table = spark.createDataFrame([(k,) for k in distinct], "formula string").repartition(slices)
        known = {r["formula"]: r["score"] for r in table.mapInPandas(run, "formula string, score double").collect()}
        data.destroy()
    return [known[show(p)] for p in programs]


def score_rows(df: DataFrame, programs: list[Program], names: Sequence[str], y: str, parsimony: float, s: Settings) -> list[float]:
    """Scores in order, over all rows of ``df``; without rows every program is rejected."""
    distinct = {show(p): p for p in programs}
    texts = list(distinct)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed = [parse(t) for t in texts]
        for pdf in batches:
            columns, target = {n: pdf[n].to_numpy(np.float64) for n in names}, pdf[y].to_numpy(np.float64)
            if len(target):
                rows = [(i, *moments(target, evaluate(p, columns, len(target)))) for i, p in enumerate(parsed)]
                yield pd.DataFrame(rows, columns=["i", *MOMENTS])

    parts = df.select(*names, F.col(y).cast("double").alias(y)).mapInPandas(run, "i int, " + ", ".join(f"{m} double" for m in MOMENTS))
    n, n_y, n_p = (F.sum(F.col("n") * x) for x in (F.lit(1.0), F.col("y1"), F.col("p1")))
    around = {"yy": F.sum(F.col("yy") + F.col("n") * F.col("y1") ** 2) - n_y * n_y / n, "pp": F.sum(F.col("pp") + F.col("n") * F.col("p1") ** 2) - n_p * n_p / n, "yp": F.sum(F.col("yp") + F.col("n") * F.col("y1") * F.col("p1")) - n_y * n_p / n}
    sums = parts.groupBy("i").agg(n.alias("n"), *[F.greatest(c, F.lit(0.0)).alias(m) if m != "yp" else c.alias(m) for m, c in around.items()], *[F.sum(m).alias(m) for m in MOMENTS[6:]])
    known = {}
    for r in sums.collect():  # a row for each program
        p = distinct[texts[r["i"]]]
        known[texts[r["i"]]] = REJECTED if any(r[m] is None or math.isnan(r[m]) for m in ("pp", "yp")) else score_of(r.asDict(), s.pearson, s.direction) - penalty(p, parsimony)
    return [known.get(show(p), REJECTED) for p in programs]


@dataclass
class Result:
    best: Program | None
    score: float
    population: list[Program]
    scores: list[float]
    history: list[dict]

    def predict(self, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
        if self.best is None:
            raise ValueError("no program survived")
        return evaluate(self.best, columns, n)


def evolve(columns: dict[str, np.ndarray], y: np.ndarray, s: Settings, seed: int = 0, prior: Sequence[float] | None = None, seeds: Sequence[Program] = (), spark: SparkSession | None = None) -> Result:
    """The best program of the last generation; None if it is longer than allowed. The same seed gives the same result."""
    np_rng = np.random.default_rng(seed)

    def score(pool: list[Program], gen: int, parsimony: float) -> list[float]:
        rows = np.sort(np_rng.permutation(len(y))[: max(1, int(len(y) * s.bag))])
        return score_population(spark, pool, {k: v[rows] for k, v in columns.items()}, y[rows], parsimony, s)

    return breed(list(columns), score, s, seed, prior, seeds)


def evolve_rows(df: DataFrame, names: Sequence[str], y: str, row: Sequence[str], s: Settings, seed: int = 0, prior: Sequence[float] | None = None, seeds: Sequence[Program] = ()) -> Result:
    """As ``evolve``, over all rows of ``df``, which are read once a generation; ``row`` names the columns that tell rows apart, by which they are bagged."""

    def score(pool: list[Program], gen: int, parsimony: float) -> list[float]:
        bag = F.pmod(F.xxhash64(*row, F.lit(seed), F.lit(gen)), F.lit(1_000_000)) < int(s.bag * 1_000_000)
        return score_rows(df.where(bag), pool, names, y, parsimony, s)

    return breed(list(names), score, s, seed, prior, seeds)


def breed(names: list[str], score, s: Settings, seed: int, prior: Sequence[float] | None, seeds: Sequence[Program]) -> Result:
    """Generations under ``score(pool, generation, parsimony)``."""
    rng = random.Random(seed)
    maker = Maker(names, prior, s, rng)
    pool = [maker.sane(p) for p in list(seeds)[: s.population // 5]]
    pool += [maker.tree(*s.depth) for _ in range(s.population - len(pool))]
    history, scores = [], []
    for gen in range(s.generations):
        phase = 0 if gen < s.phases[0] else 1 if gen < s.phases[0] + s.phases[1] else 2
        scores = score(pool, gen, s.parsimony[phase])
        order = sorted(range(len(pool)), key=lambda i: (-scores[i], show(pool[i])))
        history.append({"gen": gen, "best": scores[order[0]], "mean": float(np.mean([x for x in scores if x > REJECTED] or [REJECTED])), "length": len(pool[order[0]])})
        if gen == s.generations - 1:
            break
        keep = [pool[i] for i in order[: max(1, int(s.elite * s.population))]]
        pick = lambda: pool[max((rng.randrange(len(pool)) for _ in range(s.tournament)), key=lambda i: scores[i])]  # noqa: E731, B023
        pool = keep + [maker.child(pick) for _ in range(s.population - len(keep))]
    order = sorted(range(len(pool)), key=lambda i: (-scores[i], show(pool[i])))
    best = pool[order[0]]
    return Result(best if len(best) <= s.most_nodes else None, scores[order[0]], [pool[i] for i in order], [scores[i] for i in order], history)


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)} or {text}


def elite(programs: Sequence[Program], scores: Sequence[float], top: int, copies: int = 2, diversity: float = 0.3) -> list[Program]:
    """The best, with at most ``copies`` of a text; the last ``diversity`` of them farthest from those taken, weighted towards the better."""
    count: dict[str, int] = {}
    pool = []
    for p, _ in sorted(zip(programs, scores), key=lambda x: -x[1]):
        t = show(p)
        if count.get(t, 0) < copies:
            count[t] = count.get(t, 0) + 1
            pool.append((p, trigrams(t)))
    if len(pool) <= top:
        return [p for p, _ in pool]
    first = max(1, int(top * (1 - diversity)))
    taken = list(range(first))
    far = lambda i, j: 1 - len(pool[i][1] & pool[j][1]) / max(1, len(pool[i][1] | pool[j][1]))
    near = {i: min(far(i, j) for j in taken) for i in range(first, len(pool))}
    while len(taken) < top and near:
        i = max(near, key=lambda i: (near[i] * (0.3 + 0.7 * (1 - i / len(pool))), -i))
        del near[i]
        taken.append(i)
        for j in near:
            near[j] = min(near[j], far(j, i))
    return [pool[i][0] for i in taken]


def formula_distances(df: DataFrame, text: str = "formula") -> DataFrame:
    """a, b, jaccard: overlap of the trigrams of every two different texts of a small pool."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(3))))
    g = df.select(F.col(text).alias("a"), grams.alias("x")).distinct()
    both = g.join(g.select(F.col("a").alias("b"), F.col("x").alias("y")), F.col("a") < F.col("b"))
    return both.select("a", "b", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))


def promote(result: Result, trade_score, top: int = 20) -> Program | None:
    """Of the best ``top`` programs the one whose trades score best by ``trade_score(program)``."""
    pool = [p for p, x in zip(result.population[:top], result.scores[:top]) if x > REJECTED]
    return max(pool, key=lambda p: (trade_score(p), -len(p)), default=None)


@dataclass
class Outer:
    """What the outer search remembers between generations; all of it is small."""

    winners: list[dict]
    losses: dict[str, float]
    pool: list[Program]
    last_hash: str | None = None
    same: int = 0


def outer_step(state: Outer, result: Result, formula_hash: str, settings: Settings, size: int = 200, share: float = 0.4, stale: int = 2) -> Outer:
    """The next seed pool: winners up to ``share``, then the elite; a best formula that stays for ``stale`` generations empties it and damps the losses."""
    same = state.same + 1 if formula_hash == state.last_hash else 0
    if same >= stale:
        damped = {k: math.floor(v * 0.3) for k, v in state.losses.items()}
        return Outer(state.winners, {k: v for k, v in damped.items() if v > 0}, [])
    first = [parse(w["formula"]) for w in state.winners][: max(1, int(size * share))] if state.winners else []
    pool = first + elite(result.population, result.scores, size - len(first))
    return Outer(state.winners, state.losses, pool[:size], formula_hash, same)
