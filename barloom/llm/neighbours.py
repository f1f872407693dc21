"""Approximate nearest neighbours on shifted space-filling curves.

Vectors get one more coordinate that makes their norms equal, so the largest inner product becomes the nearest
point. Each curve projects them with a rotation and a shift of its own and orders them along a Hilbert curve. Spark range-partitions the
rows by curve and key; a query meets the ``w`` items before and behind its own key on every curve, first inside its
partition, then across the border to the next one. Items travel as one byte a component with a bound on what that leaves out, so a window
gives all that may be among its best; the windows merge, and what remains is ranked by exact inner products.

``w`` is measured, not set: all rows are searched for a sample of queries, the places of their true neighbours on every curve are counted, and half of the
sample sets the window; the other half, which had no part in it, gives the recall that is returned with the rows. Where
a window would be longer than a task should hold, the number of curves doubles. On vectors without any structure that a
projection can follow windows grow with the table; on clustered ones they hold a small share of it (README).

Equal vectors are one class: it is searched once, and its smallest ids stand for it.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those of another than the most
common dimension take no part, as an inner product needs one dimension; ties go to the smaller id; rows that share an id and a vector count once; an id with
two different vectors is two candidates and, as a query, has a ranking for each; columns other than vec_id and
embedding are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, mix64, small_batches, table, written
from .dedup import groups

CURVES, DIMENSIONS, BITS = 12, 8, 6
#: Queries that set the window, as many that measure it, the share of neighbours to hold, items in a half window at least, and from which on there are more curves.
SAMPLE, RECALL, LEAST, LONG, MOST_CURVES = 96, 0.955, 32, 400_000, 96
#: Rows of a partition of the curves, and partitions at most (a partition is streamed, so larger ones do no harm).
ROWS, PARTITIONS = 100_000, 20_000

def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place along a Hilbert curve of points with integer coordinates below 2**bits (n x d, bits * d below 64), after Skilling (2004)."""
    x = x.astype(np.int64).copy()
    d = x.shape[1]
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(d):
            one = (x[:, i] & q) != 0
            swap = np.where(one, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(one, p, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, d - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


class Curves:
    """Keys of vectors on every curve. ``longest`` is the largest norm of a candidate."""

    def __init__(self, dim: int, longest: float, curves: int = CURVES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.longest, self.dim = longest, dim
        d = min(DIMENSIONS, dim + 1)
        self.turn = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, :d] for _ in range(curves)]
        self.shift = rng.uniform(-0.25, 0.25, (curves, d))

    def keys(self, v: np.ndarray, ids: np.ndarray, query: bool) -> np.ndarray:
        """n x curves; the last 14 bits, from the id, keep equal places apart."""
        if query:
            v = np.hstack([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))])
        else:
            v = v / self.longest
            v = np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1, keepdims=True)))])
        tie = (mix64(ids.astype(np.uint64)) >> np.uint64(50)).astype(np.int64)
        out = np.empty((len(v), len(self.turn)), np.int64)
        for c, (turn, shift) in enumerate(zip(self.turn, self.shift)):
            y = (v @ turn) * (np.sqrt(self.dim + 1) / 8) + 0.5 + shift / 8
            out[:, c] = hilbert(np.clip(np.floor(y * (1 << BITS)), 0, (1 << BITS) - 1), BITS) << 14 | tie
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(q: np.ndarray, items: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of the k largest inner products of each query."""
    s = q @ items.T
    floor = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else np.full((len(q), 1), -np.inf)
    i, j = np.nonzero(s >= floor)
    return i, ids[j], s[i, j]


def largest(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of each query, the smaller id first among equals."""
    order = np.lexsort((ids, -score, i))
    return order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and two hashes of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    good = good.where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    top = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = top["dim"] if top else 0
    return good.where(F.size("embedding") == dim).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64("embedding", F.lit(1))})


class Codes:
    """Vectors as bytes: each component in steps of a 127th of the largest, with the norm of what the steps leave out.

    Inner products with codes are off by at most the query's norm times that rest, so what may be among the best is known for certain.
    """

    SIZE = 16  # step and rest, before the components

    @staticmethod
    def of(v: np.ndarray) -> pa.Array:
        step = np.abs(v).max(1, keepdims=True) / 127
        code = np.rint(v / step).astype(np.int8)
        rest = np.sqrt(((v - code * step) ** 2).sum(1)) + 1e-6 * np.sqrt((v * v).sum(1))
        raw = np.hstack([np.column_stack([step[:, 0], rest]).view(np.uint8).reshape(len(v), Codes.SIZE), code.view(np.uint8)])
        return binary(raw)

    @staticmethod
    def read(blobs: pa.Array) -> np.ndarray:
        return unbinary(blobs)

    @staticmethod
    def parts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Components (float32), steps, rests."""
        head = np.ascontiguousarray(raw[:, : Codes.SIZE]).view(np.float64)
        return np.ascontiguousarray(raw[:, Codes.SIZE :]).view(np.int8).astype(np.float32), head[:, 0], head[:, 1]


def binary(raw: np.ndarray) -> pa.Array:
    """Rows of bytes, all of one length, as binary values."""
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def unbinary(blobs: pa.Array) -> np.ndarray:
    if not len(blobs):
        return np.zeros((0, Codes.SIZE), np.uint8)
    return np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(len(blobs), -1)


def candidates(q: np.ndarray, codes: np.ndarray, k: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, low, high) of all items in [lo, hi) of each query that may be among its k best, with bounds of their products."""
    size = np.sqrt((q * q).sum(1))
    unit = (q / size[:, None]).astype(np.float32)
    out: list[list[np.ndarray]] = [[], [], [], []]
    a, b = int(lo.min()), int(hi.max())
    v, step, rest = Codes.parts(codes[a:b])
    rows = max(1, 2_000_000 // max(1, b - a))
    for at in range(0, len(q), rows):
        part = slice(at, at + rows)
        s = (unit[part] @ v.T) * step
        place = np.arange(a, b)
        s[(place < lo[part, None]) | (place >= hi[part, None])] = -np.inf
        low, high = s - rest, s + rest
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k, None] if low.shape[1] > k else np.full((len(s), 1), -np.inf)
        i, j = np.nonzero((high >= floor) & (s > -np.inf))
        for o, x in zip(out, (i + at, j + a, low[i, j] * size[i + at], high[i, j] * size[i + at])):
            o.append(x)
    return tuple(map(np.concatenate, out))


NEAR = [("q", pa.int64()), ("rep", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("curve", pa.int32()), ("border", pa.int32()), ("place", pa.int64()), ("kind", pa.int32()), ("code", pa.binary())]
NEAR_SCHEMA = "q bigint, rep bigint, low double, high double, curve int, border int, place bigint, kind int, code binary"


def rows_of(n: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols and not isinstance(cols[c], pa.Array) else cols.get(c, pa.nulls(n, t)) for c, t in NEAR], [c for c, _ in NEAR])


class Run:
    """One curve's rows in one task, in order of their keys; a window of items is held, and queries wait until theirs is complete."""

    def __init__(self, curve: int, border: int, w: int, k: int):
        self.curve, self.border, self.w, self.k = curve, border, w, k
        self.first, self.total = 0, 0  # number of the first item held, and of all seen
        self.codes, self.reps = np.zeros((0, 0), np.uint8), np.zeros(0, np.int64)
        self.head: list[tuple[np.ndarray, np.ndarray]] = []
        self.head_n = 0
        self.wait: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places, ids and bytes of queries
        self.early: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, kind: np.ndarray, reps: np.ndarray, raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        item = kind == 1
        before = self.total + np.cumsum(item) - item
        codes = np.frombuffer(b"".join(r for r, x in zip(raw, item) if x), np.uint8).reshape(int(item.sum()), -1)
        if (~item).any():
            asked = np.frombuffer(b"".join(r for r, x in zip(raw, item) if not x), np.uint8).reshape(int((~item).sum()), -1)
            self.wait.append((before[~item], reps[~item], asked))
            if (early := before[~item] < self.w).any():
                self.early.append((before[~item][early], reps[~item][early], asked[early]))
        if len(codes):
            if self.head_n < self.w:
                self.head.append((codes[: self.w - self.head_n], reps[item][: self.w - self.head_n]))
                self.head_n += len(self.head[-1][0])
            self.new.append((codes, reps[item]))
            self.total += len(codes)
        if self.total - self.first > 4 * self.w + 8192:
            yield from self.settle(False)

    def settle(self, end: bool) -> Iterator[pa.RecordBatch]:
        """Answers of the queries whose windows are complete; what no window needs any more goes."""
        if self.new:
            codes, reps = zip(*self.new)
            self.codes = np.concatenate([self.codes.reshape(-1, codes[0].shape[1]), *codes])
            self.reps, self.new = np.concatenate([self.reps, *reps]), []
        if self.wait:
            place, ids, raw = (np.concatenate(x) for x in zip(*self.wait))
            n = len(place) if end else int(np.searchsorted(place, self.total - self.w, side="right"))
            for at in range(0, n, 128):
                yield from self.answer(place[at : min(n, at + 128)], ids[at : min(n, at + 128)], raw[at : min(n, at + 128)])
            self.wait = [(place[n:], ids[n:], raw[n:])] if n < len(place) else []
        keep = min([self.total, *(int(p[0]) for p, _, _ in self.wait)]) - self.w
        if keep > self.first:
            self.codes, self.reps, self.first = self.codes[keep - self.first :], self.reps[keep - self.first :], keep

    def answer(self, place: np.ndarray, ids: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo, hi = np.maximum(place - self.w, 0) - self.first, np.minimum(place + self.w, self.total) - self.first
        if not len(self.codes) or int(hi.max()) <= int(lo.min()):
            return
        i, j, low, high = candidates(np.ascontiguousarray(raw).view(np.float64), self.codes, self.k, lo, hi)
        if len(i):
            yield rows_of(len(i), q=ids[i], rep=self.reps[j], low=low, high=high)

    def close(self) -> Iterator[pa.RecordBatch]:
        """The last answers, and both edges for the neighbouring runs: places count from the border."""
        w, n = self.w, self.total
        late = [(p[x], i[x], r[x]) for p, i, r in self.wait if (x := p > n - w).any()]
        yield from self.settle(True)
        items = [(self.border, np.arange(self.head_n), *map(np.concatenate, zip(*self.head)))] if self.head else []
        tail = slice(max(0, len(self.codes) - w), None)
        items.append((self.border + 1, np.arange(n - len(self.reps[tail]), n) - n, self.codes[tail], self.reps[tail]))
        asked = [(self.border, p, i, r) for p, i, r in self.early] + [(self.border + 1, p - n, i, r) for p, i, r in late]
        for border, place, codes, reps in items:
            if len(reps):
                yield self.edge(border, place, reps, codes, 1)
        for border, place, ids, raw in asked:
            yield self.edge(border, place, ids, raw, 2 if border == self.border else 0)

    def edge(self, border: int, place: np.ndarray, ids: np.ndarray, raw: np.ndarray, kind: int) -> pa.RecordBatch:
        n = len(ids)
        return rows_of(n, rep=ids, curve=np.full(n, self.curve), border=np.full(n, border), place=place, kind=np.full(n, kind), code=binary(raw))


def walk(w: int, k: int):
    """Rows sorted by curve and key to answers and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now = TaskContext.get().partitionId(), None
        for b in batches:
            curve = b.column("curve").to_numpy()
            kind, reps, raw = b.column("kind").to_numpy(), b.column("rep").to_numpy(), b.column("code").to_pylist()
            edges = [0, *(np.flatnonzero(curve[1:] != curve[:-1]) + 1).tolist(), b.num_rows]
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                if now is None or now.curve != curve[x]:
                    if now is not None:
                        yield from now.close()
                    now = Run(int(curve[x]), part, w, k)
                yield from now.add(kind[x:y], reps[x:y], raw[x:y])
        if now is not None:
            yield from now.close()

    return run


def across(w: int, k: int):
    """Answers of queries near a border from the items on its other side; rows come grouped by curve and border."""

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, place, ids = (t.column(c).to_numpy() for c in ("kind", "place", "rep"))
        raw = t.column("code").to_pylist()
        for ask, side in ((0, place >= 0), (2, place < 0)):
            of, at = np.flatnonzero(kind == ask), np.flatnonzero((kind == 1) & side)
            if not len(of) or not len(at):
                continue
            at = at[np.argsort(place[at])]
            codes = np.frombuffer(b"".join(raw[x] for x in at), np.uint8).reshape(len(at), -1)
            q = np.frombuffer(b"".join(raw[x] for x in of), np.float64).reshape(len(of), -1)
            lo = np.zeros(len(of), np.int64) if ask == 0 else np.searchsorted(place[at], place[of] - w)
            hi = np.searchsorted(place[at], place[of] + w) if ask == 0 else np.full(len(of), len(at))
            some = hi > lo
            if some.any():
                i, j, low, high = candidates(q[some], codes, k, lo[some], hi[some])
                yield rows_of(len(i), q=ids[of[some][i]], rep=ids[at[j]], low=low, high=high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["curve", "border"]):
            yield from meet(t)

    return run


def true_neighbours(reps: DataFrame, q: np.ndarray, own: np.ndarray, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vector, id) of the k best of few queries among all rows, each query's own left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            rep = b.column("rep").to_numpy()
            more = best(q, matrix(b.column("embedding"), dim), rep, k + 1)
            i, ids, score = (np.concatenate(x) for x in zip((i, ids, score), more))
            keep = largest(i, ids, score, k + 1)
            i, ids, score = i[keep], ids[keep], score[keep]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(ids), pa.array(score)], ["q", "rep", "score"])

    rows = reps.mapInArrow(run, "q int, rep bigint, score double").toArrow()  # k + 1 for each sampled query and task
    i, ids, score = (rows.column(c).to_numpy().astype(t) for c, t in (("q", np.int64), ("rep", np.int64), ("score", float)))
    other = ids != own[i]
    i, ids, score = i[other], ids[other], score[other]
    keep = largest(i, ids, score, k)
    i, ids = i[keep], ids[keep]
    wanted = reps.sparkSession.createDataFrame([(int(x),) for x in np.unique(ids)], "rep bigint")
    found = reps.join(F.broadcast(wanted), "rep").toArrow()
    rep, v = found.column("rep").to_numpy(), matrix(found.column("embedding").combine_chunks(), dim)
    order = np.argsort(rep)
    return i, v[order[np.searchsorted(rep, ids, sorter=order)]], ids


def ranks(reps: DataFrame, curves: Curves, bounds: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """How many items come before each of ``bounds`` (sorted) on each curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(x) + 1, np.int64) for x in bounds]
        for b in batches:
            keys = curves.keys(matrix(b.column("embedding"), dim), b.column("rep").to_numpy(), False)
            for c, x in enumerate(bounds):
                sums[c] += np.bincount(np.searchsorted(x, keys[:, c], side="right"), minlength=len(x) + 1)
        for c, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(at, pa.int32()), pa.array(s[at])], ["curve", "at", "n"])

    out = [np.zeros(len(x) + 1, np.int64) for x in bounds]
    for r in reps.mapInArrow(run, "curve int, at int, n bigint").groupBy("curve", "at").agg(F.sum("n").alias("n")).collect():  # as many as bounds
        out[r["curve"]][r["at"]] = r["n"]
    return [np.cumsum(x)[:-1] for x in out]


def measured(reps: DataFrame, sample: tuple[np.ndarray, np.ndarray], dim: int, longest: float, k: int, recall: float, curves: int) -> tuple[Curves, int, float]:
    """Curves, half window, and the recall of queries that had no part in choosing it."""
    q, own = sample
    i, v, ids = true_neighbours(reps, q, own, dim, k)
    while True:
        made = Curves(dim, longest, curves)
        if not len(i):
            return made, LEAST, 1.0
        asked, found = made.keys(q, own, True)[i], made.keys(v, ids, False)
        bounds = [np.unique(np.concatenate([asked[:, c], found[:, c]])) for c in range(curves)]
        before = ranks(reps, made, bounds, dim)
        gap = np.stack([n[np.searchsorted(x, found[:, c])] - n[np.searchsorted(x, asked[:, c])] for c, (x, n) in enumerate(zip(bounds, before))], axis=1)
        need = np.where(gap >= 0, gap + 1, -gap).min(axis=1)
        fit = np.sort(need[i % 2 == 0]) if (i % 2 == 0).any() else np.sort(need)
        w = max(LEAST, int(fit[min(len(fit) - 1, int(np.ceil(recall * len(fit))))]))
        test = need[i % 2 == 1]
        if w <= LONG or 2 * curves > MOST_CURVES:
            return made, w, float((test <= w).mean()) if len(test) else 1.0
        curves *= 2


def search(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL, curves: int = CURVES, rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``; window (items read to each side on each curve), curves, recall (as measured)."""
    spark = vectors.sparkSession
    small_batches(spark)
    good = written(valid(vectors), "ann-rows")
    ranked = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    firsts = good.select("h1", "h2", "vec_id").distinct().withColumn("place", ranked).where(F.col("place") <= k + 1)
    classes = firsts.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    # A class has a number of its own, as an id may stand in several; numbers follow the smallest ids, so ties do too.
    classes = written(classes.orderBy("first", "h1", "h2").withColumn("rep", F.monotonically_increasing_id()), "ann-classes")
    reps = good.join(classes.select("h1", "h2", F.col("first").alias("vec_id"), "rep"), ["h1", "h2", "vec_id"]).dropDuplicates(["rep"]).select("rep", "embedding")
    reps = written(reps, "ann-reps")
    asked = good.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "h1", "h2")
    asked = written(asked.join(classes.drop("ids", "first"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "rep").distinct(), "ann-asked", good)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    n, longest, dim = reps.agg(F.count("*"), F.max(norm), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, window bigint, curves int, recall double")
    queries = written(reps.join(asked.select("rep").distinct(), "rep", "left_semi"), "ann-queries")
    picked = queries.orderBy(F.xxhash64("rep")).limit(2 * SAMPLE).toArrow()  # a documented sample
    sample = matrix(picked.column("embedding").combine_chunks(), dim) if picked.num_rows else np.zeros((0, dim)), picked.column("rep").to_numpy()
    made, w, held = measured(reps, sample, dim, longest, k, recall, curves)
    curves = len(made.turn)

    def keyed(frame: DataFrame, kind: int) -> DataFrame:
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            v, rep = matrix(b.column("embedding"), dim), b.column("rep").to_numpy()
            keys = made.keys(v, rep, kind == 0)
            code = Codes.of(v) if kind else binary(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1))
            take = pa.array(np.tile(np.arange(len(v)), curves))
            cols = [pa.array(np.repeat(np.arange(curves), len(v)), pa.int32()), pa.array(keys.T.ravel()), pa.array(np.full(keys.size, kind), pa.int32())]
            return pa.RecordBatch.from_arrays([*cols, b.column("rep").take(take), code.take(take)], ["curve", "key", "kind", "rep", "code"])

        return map_batches(frame, batch, "curve int, key bigint, kind int, rep bigint, code binary")

    parts = max(1, min(PARTITIONS, n * curves // max(rows, 8 * w)))
    order = ["curve", "key", "kind", "rep"]  # queries stand before the items of their key
    dealt = keyed(reps, 1).union(keyed(queries, 0)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    near = written(dealt.mapInArrow(walk(w, k + 1), NEAR_SCHEMA), "ann-near")
    edges = near.where("border is not null").repartition("curve", "border").sortWithinPartitions("curve", "border")
    pairs = near.where("border is null").select("q", "rep", "low", "high").union(edges.mapInArrow(across(w, k + 1), NEAR_SCHEMA).select("q", "rep", "low", "high"))
    pairs = pairs.groupBy("q", "rep").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
    floor = F.max(F.when(F.col("r") == k + 1, F.col("low"))).over(Window.partitionBy("q"))
    pairs = pairs.withColumn("r", place).withColumn("floor", floor).where("floor is null or high >= floor").select("q", "rep")
    product = F.aggregate(F.zip_with("u", "embedding", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    exact = pairs.join(queries.select(F.col("rep").alias("q"), F.col("embedding").alias("u")), "q").join(reps, "rep").select("q", "rep", product.alias("score"))
    ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    top = exact.withColumn("r", ranked).where(F.col("r") <= k + 1).join(classes.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    listed = top.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k + 1).alias("list"))
    out = asked.join(listed.withColumnRenamed("q", "rep"), "rep")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("place", "x"))
    figures = [F.lit(w).cast("long").alias("window"), F.lit(curves).alias("curves"), F.lit(held).alias("recall")]
    found = out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"), *figures)
    return written(found, "ann-found", near, queries, asked, classes, reps)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
