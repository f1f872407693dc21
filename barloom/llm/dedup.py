"""Near-duplicate documents by SetSketch registers.

A document is the set of its runs of five words. A register holds the minimum of exponentially distributed hashes of the
set's elements, on an exponential scale truncated to 16 bits; registers of a union are the maxima of its parts' registers.
Bands of registers propose pairs, a joint maximum-likelihood estimate from the counts of larger, smaller and
equal registers sifts them, and the full sets confirm links.

1. Documents with equal sets are one class; only its smallest id goes on.
2. In each bucket of a band every member is paired with the bucket's smallest id, which is linear in the bucket.
3. Components of the confirmed links. A bucket whose members are in one component is done.
4. In any other bucket, members outside its largest component meet all others: in pairs of blocks among themselves, and the
   largest component's members pass by each block. Members of different components that look alike by
   their registers are confirmed on full sets; pairs that a link just found has joined are skipped, for they can't
   change a component.

Defined results: null and empty texts have empty sets and are linked with nothing; a null id is linked with
nothing, its component is null and it is kept; rows that share an id are one document, with the text of the
largest set; very long texts are read whole; of equal sets the smallest id stands for all; an empty table gives an empty result; columns other than doc_id and text are
ignored, and kept as they are, whatever their names, by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, fresh, map_batches, mix64, remove, shingle_hashes, table, text_bytes, written
from .graph import components

WORDS = 5
#: Registers, and registers in a band. A pair of similarity 0.75 misses all 32 bands with a probability below 6e-6.
REGISTERS, ROWS = 128, 4
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Estimates from here on are confirmed: 0.75 less five standard errors of the estimate.
CUT = 0.56
BLOCK = 256
#: In place of a block's number: a member of its bucket's largest component.
MAIN = -1
BROADCAST_IDS = 500_000
FACTORS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: bytes, hashes: WordHash, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of runs of ``k`` lower-cased words."""
    return np.unique(shingle_hashes(hashes.of(text.lower().split()), k))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each."""
    out = np.empty((len(sets), REGISTERS), np.uint16)
    size = np.array([len(s) for s in sets], np.int64)
    at = 0
    while at < len(sets):  # pieces that fit the processor's cache
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 60_000)) + at)
        x = np.concatenate(sets[at:to])
        starts = np.cumsum(size[at:to]) - size[at:to]
        low = np.empty((to - at, REGISTERS))
        v = np.empty_like(x)
        for i in range(REGISTERS):
            np.multiply(x, FACTORS[i], out=v)
            low[:, i] = np.minimum.reduceat(v, starts)
        u = (low + 0.5) / 2.0**64
        out[at:to] = np.clip(np.floor(1 - np.log(-np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE) / np.log(BASE)), 0, TOP)
        at = to
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity of rows of registers whose sets have na and nb elements.

    A register of a is larger with probability p(u - vJ) and smaller with p(v - uJ), where u and v are the sets' shares of
    na + nb and p(x) = -log_b(1 - x (b - 1) / b). The likelihood is concave in J; its maximum is found by bisection of the slope.
    """
    up, down = (a > b).sum(-1), (a < b).sum(-1)
    same = REGISTERS - up - down
    u, v = na / (na + nb), nb / (na + nb)
    c = (BASE - 1) / BASE
    lo, hi = np.zeros(up.shape), np.minimum(u / v, v / u)
    for _ in range(24):
        j = (lo + hi) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = -np.log1p(-x * c) / np.log(BASE), -np.log1p(-y * c) / np.log(BASE)
        dp, dq = -v * c / (1 - x * c) / np.log(BASE), -u * c / (1 - y * c) / np.log(BASE)
        slope = up * dp / p + down * dq / q - same * (dp + dq) / np.maximum(1 - p - q, 1e-12)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2 (which stand for the set), sketch."""
    hashes = WordHash()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, hashes) for t in text_bytes(b.column("text"))]
        full = [i for i, s in enumerate(sets) if len(s)]
        sketch: list[bytes | None] = [None] * len(sets)
        for i, r in zip(full, registers([sets[i] for i in full])):
            sketch[i] = r.tobytes()
        h1 = pa.array([int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets], pa.int64())
        h2 = pa.array([int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0 for s in sets], pa.int64())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), h1, h2, pa.array(sketch, pa.binary())], ["doc_id", "n", "h1", "h2", "sketch"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), batch, "doc_id bigint, n bigint, h1 bigint, h2 bigint, sketch binary")


def sets_of(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """id, set for the documents named in ``ids`` (a written table), computed again from their texts."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    hashes = WordHash()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, hashes).view(np.int64) for t in text_bytes(b.column("text"))]
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    own = docs.select(docs["doc_id"].cast("long").alias("id"), "text").join(few, "id", "left_semi")
    sets = written(map_batches(own, batch, "id bigint, set array<bigint>"), name)
    if sets.groupBy("id").count().where("count > 1").limit(1).count():  # rows that share an id give way to the largest set
        sets = written(sets.groupBy("id").agg(F.max(F.struct(F.size("set"), "set"))["set"].alias("set")), name, sets)
    return sets


def similar(frame: DataFrame) -> DataFrame:
    """Rows of a, b, na, nb, sa, sb whose sizes allow a link and whose estimate reaches the cut."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
        na, nb = (b.column(c).to_numpy().astype(float) for c in ("na", "nb"))
        good = pa.array(estimate(x, y, na, nb) >= CUT)
        return pa.RecordBatch.from_arrays([b.column("a").filter(good), b.column("b").filter(good)], ["a", "b"])

    fits = frame.where("100 * least(na, nb) >= 75 * greatest(na, nb)")
    return map_batches(fits.select("a", "b", "na", "nb", "sa", "sb"), batch, "a bigint, b bigint")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= 75 * (F.size("x") + F.size("y") - common)).select("a", "b")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches; a run may span batches."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = [b.column(c).to_numpy() for c in keys]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in k], axis=0)) + 1
        if rest and any(rest[-1].column(c)[-1].as_py() != x[0].item() for c, x in zip(keys, k)):
            yield pa.Table.from_batches(rest)
            rest = []
        start = 0
        for e in edges.tolist():
            yield pa.Table.from_batches([*rest, b.slice(start, e - start)])
            rest, start = [], e
        rest.append(b.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)


def look_alike(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a block pair's members that are in different components, may be linked by size, look alike by their registers, and meet nowhere else."""
    comp, n, mine, pivot, ids = (t.column(c).to_numpy() for c in ("component", "n", "mine", "pivot", "id"))
    r = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
    left, right = np.flatnonzero(mine == bi), np.flatnonzero((mine == bj) | (mine == MAIN) & (bi == bj))
    xs, ys = [], []
    for i in left.tolist():
        j = right[(comp[right] != comp[i]) & ((right > i) | (bi != bj) | (mine[right] == MAIN)) & (100 * np.minimum(n[right], n[i]) >= 75 * np.maximum(n[right], n[i])) & (ids[i] != pivot[i]) & (ids[right] != pivot[i])]
        if len(j):
            j = j[estimate(r[i], r[j], float(n[i]), n[j].astype(float)) >= CUT]
            xs.append(np.full(len(j), i))
            ys.append(j)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, int), np.zeros(0, int))


KEYS = ["key", "bi", "bj"]
MEMBER = "key bigint, bi int, bj int, id bigint, mine int, component bigint, n bigint, pivot bigint, sketch binary"


def remaining_links(docs: DataFrame, members: DataFrame, found: DataFrame, sketch: DataFrame) -> DataFrame | None:
    """Links between different components within the buckets of ``members`` (key, id, pivot, size)."""
    joined = components(found)
    now = members.where("size > 2").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    now = written(now, "near-members", joined)
    parts = now.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("m"), F.count("*").alias("parts"))
    main = written(main.where("parts > 1").select("key", (-F.col("m.c")).alias("main"), F.col("m.n").alias("main_n")), "near-open")
    blocks = F.ceil((F.col("size") - F.col("main_n")) / BLOCK).cast("int")
    mine = F.when(F.col("component") == F.col("main"), MAIN).otherwise(F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rows = now.join(main, "key").withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    own = F.col("mine") == MAIN
    rows = rows.withColumns({"bi": F.when(own, F.col("other")).otherwise(F.least("mine", "other")), "bj": F.when(own, F.col("other")).otherwise(F.greatest("mine", "other"))}).join(sketch, "id")
    cols = [x.split()[0] for x in MEMBER.split(", ")]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said outright, as little data means much work here
    dealt = rows.select(*cols).repartition(tasks, *KEYS).sortWithinPartitions(*KEYS, "id")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, KEYS):
            x, y = look_alike(t)
            if len(x):
                yield from t.take(np.union1d(x, y)).to_batches()

    seen = written(dealt.mapInArrow(alike, MEMBER), "near-alike")
    ids = written(seen.select("id").distinct(), "near-ids")
    if not ids.limit(1).count():
        remove(now, main, seen, ids)
        return None
    sets = sets_of(docs, ids, "near-sets")
    again = seen.join(sets, "id").select(*cols, "set").repartition(tasks, *KEYS).sortWithinPartitions(*KEYS, "id")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, KEYS):
            x, y = look_alike(t)
            ids, comp = t.column("id").to_pylist(), t.column("component").to_pylist()
            sets = [s.values.to_numpy() for s in t.column("set").combine_chunks()] if t.num_rows else []
            up: dict[int, int] = {}

            def top(c: int) -> int:
                while c in up:
                    c = up[c]
                return c

            out = []
            for i, j in zip(x.tolist(), y.tolist()):
                p, q = top(comp[i]), top(comp[j])
                if p != q:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                        up[p] = q
                        out.append((ids[i], ids[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return written(again.mapInArrow(linked, "a bigint, b bigint"), "near-links", now, main, seen, ids, sets)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    all_docs = written(sketches(docs), "near-sketches")
    full = all_docs.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "near-classes")
    member = full.select("doc_id", "h1", "h2", "n", "sketch").join(classes, ["h1", "h2", "n"])
    copies = written(member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "near-copies")
    sketch = member.where("doc_id = rep").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.struct("n", "sketch")).alias("s")).select("id", "s.n", "s.sketch")
    sketch = written(sketch, "near-reps")

    width = 2 * ROWS
    band = lambda b: F.xxhash64(b, F.col("sketch").substr(b * width + 1, F.lit(width)))
    bands = sketch.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), band)).alias("key"))
    buckets = written(bands.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).where("size > 1"), "near-buckets")
    members = written(bands.join(buckets, "key"), "near-members")

    side = lambda s: sketch.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    pairs = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = written(similar(pairs.join(side("a"), "a").join(side("b"), "b")), "near-pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    sets = sets_of(docs, ids, "near-sets")
    links = written(confirm(pairs, sets), "near-links", pairs, ids, sets)
    more = remaining_links(docs, members, links, sketch)
    remove(members, buckets, sketch)
    found = components((links if more is None else links.union(more)).union(copies.distinct()))
    remove(links, more, copies, classes)
    out = all_docs.select("doc_id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-found", all_docs, found)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, whatever their names, one document of each group of near duplicates; rows that repeat an id give way to one of them."""
    found = near_duplicates(docs)
    (name,) = fresh(docs, "gone")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(name))
    repeated = written(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name)), "near-repeated")
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    own = F.col("doc_id").cast("long") == F.col(name)
    left = docs.join(few(gone), own, "left_anti")
    if not repeated.limit(1).count():
        return left
    ids = few(repeated)
    return left.join(ids, own, "left_anti").unionByName(left.join(ids, own, "left_semi").dropDuplicates(["doc_id"]))


def op10_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Sets of shingles as rows, pairs that share any, and who reaches whom.
SQL = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * k >= 75 * (m.n + o.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id"""
