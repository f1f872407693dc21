"""Best-fit packing of documents into sequences.

An item is a vector of tokens, documents and attention cost (tokens squared); a bin has a capacity for each.
Items go longest first into the open bin that fits under every constraint and scores best: by least weighted norm
of what remains, or by largest weighted dot product of item and residual. All three dimensions score; a caller who names no other capacity than the tokens' gets one
for documents and one for cost that no bin of so many tokens can exceed.

An item's vector follows from its length, and lengths are bounded by the capacity. So the histogram of
lengths, a few thousand numbers at any size of the corpus, decides the whole packing: equal bins are handled as ranges, and
each piece finds its place by its rank among the pieces of its length. The ranges are a file in the shared folder that workers map: for each length there are at most as
many as there are ranges of open bins, which grow by no more than three a length.

Defined results: a null or empty text is one piece that holds only the end token; a document over the capacity is cut into full
pieces, of which the first may be shorter; a null id is kept; rows with the same id are packed each by itself; pieces of one length that tie in every column may change places; very
long texts are encoded whole; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, mapped, new_path, save, table, written
from .tokens import Encoder

CAPACITY = 2048
END = 0
#: Of tokens, documents and attention cost.
WEIGHTS = (1.0, 1.0, 1.0)


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of each document's ids and end token: doc_id, piece, start, length, ids_crc32."""
    state: list[Encoder] = []

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Encoder(path))
        rows: list[tuple] = []
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            ids = np.append(state[0].encode(t or ""), np.uint32(END)).astype("<u4")
            at = len(ids) % capacity
            edges = [0, *range(at or capacity, len(ids) + 1, capacity)]
            for k, (x, y) in enumerate(zip(edges, edges[1:])):
                rows.append((i, k, x, y - x, zlib.crc32(ids[x:y].tobytes())))
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), batch, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(histogram: dict[int, int], capacity: tuple[float, float, float], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first rank, bins, items per bin, first bin, offset in the bin) and the number of bins.

    Within a slot, rank r stands in bin first + r // items, at offset + length * (r % items). Bins with the same
    residual vector are alike, so they are kept as ranges under that vector.
    """
    cap, w = np.array(capacity, float), np.array(weights, float) / np.array(capacity, float) ** 2
    ranges: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    slots: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        item = np.array([length, 1, length * length], float)
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens fits in no bin")
        keys = [k for k in ranges if ranges[k] and all(a >= b for a, b in zip(k, item))]
        left = np.array(keys, float).reshape(-1, 3)
        score = (w * (left - item) ** 2).sum(1) if rule == "norm" else -(w * item * left).sum(1)
        heap = [(s, k) for s, k in zip(score.tolist(), keys)]
        heapq.heapify(heap)
        while todo:
            if heap:
                _, key = heapq.heappop(heap)
                first, n = ranges[key].pop()
                if ranges[key]:
                    heapq.heappush(heap, (_, key))
            else:
                key, first = tuple(cap.tolist()), bins
                each = int(min(c // i for c, i in zip(cap, item)))
                n = -(-todo // each)
                bins += n
            each = int(min(a // b for a, b in zip(key, item)))
            whole = min(n, todo // each)
            parts = [(whole, each)] if whole else []
            if whole < n and todo % each and todo - whole * each < each:
                parts.append((1, todo - whole * each))
            at = first
            for count, items in parts:
                slots.append((length, rank, count, items, at, int(cap[0] - key[0])))
                ranges[tuple(a - items * b for a, b in zip(key, item.tolist()))].append((at, count))
                rank += count * items
                todo -= count * items
                at += count
            if at < first + n:
                ranges[key].append((at, first + n - at))
    return slots, bins


@lru_cache(maxsize=2)
def slots_at(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots, mapped, and what they are searched by: length and first rank."""
    at = mapped(path).view(np.int64).reshape(-1, 6)
    return at, at[:, 0] << 44 | at[:, 1]


def pack(docs: DataFrame, capacity: int = CAPACITY, most_docs: int | None = None, most_cost: float | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", path: str | None = None, group: int = 4096) -> DataFrame:
    """A row per piece with its sequence and offset. ``group``: pieces of one length that are ranked together, on average."""
    pieces = written(cut(docs, capacity, path), "pack-pieces")
    total = pieces.count()
    parts = max(1, total // group)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    # A rank in its length: the length's pieces are dealt to parts, ranked there, and the parts' counts added up.
    sums = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long"))
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length up to the capacity
    slots, _ = plan(histogram, (capacity, most_docs or capacity, most_cost or float(capacity) ** 2), weights, rule)
    slots.sort()
    path_of_slots = new_path(docs.sparkSession, "pack-slots")
    save(path_of_slots, np.array(slots, np.int64).reshape(-1, 6))

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        at, key = slots_at(path_of_slots)
        length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
        s = at[np.searchsorted(key, length << 44 | rank, side="right") - 1]
        r = rank - s[:, 1]
        where = [pa.array(s[:, 4] + r // s[:, 3], pa.int64()), pa.array(s[:, 5] + length * (r % s[:, 3]), pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *where], [*names, "sequence_id", "offset"])

    return map_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
