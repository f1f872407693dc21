"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and stored as sorted hash arrays.

Counts travel as packed arrays: a task adds up what it reads, and sends each shard its keys, sorted, with their counts.
Shards merge them and write raw sorted arrays to the shared folder:

* words: 64-bit hashes, sorted over all shards, so that a word's place is its id; counts beside them;
* bigrams: hashes of pairs of ids, sorted over all shards too, so a frequent word's pairs spread over all shards; the hash can be
  undone, so it is exact;
* statistics of each id: tokens and discount mass as a context, and distinct words before it;
* for an ``order`` above 2, n-grams of each length: chained 64-bit hashes with counts, and the hashes of their contexts with tokens and discount mass. Below the
  highest length, an n-gram's count is that of the different words before it; texts are padded with as many beginnings as the order needs.

Workers map the shards they need into memory and look words and n-grams up by binary search; at most ``MAPS`` files are open in a worker. The number of shards
follows the bytes of the corpus. Nothing that grows with the corpus reaches the driver but a row for each shard. Ids take 32 bits: a vocabulary may have up to 4.2 billion
different words, more is an error. Counts take 64 bits, in 32 where all of a shard's fit. Words are told apart by 64-bit hashes (of a billion different words, one pair
in 37 such corpora would collide), n-grams above bigrams likewise.

Defined results: a null text counts as empty and is one end token; a null id counts as empty text for the choice of held-out
rows; without training rows, N and V are 0 and every token has the probability of an unknown one, 1; repeated rows count as often as they
occur; an empty table gives an empty result; columns other than doc_id and text are ignored; very long texts are read whole, in slices.
"""

from __future__ import annotations

import uuid
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FACTOR, crc_column, drop_path, map_batches, mapped, mix64, new_path, remove, save, table, text_bytes, written

END, BEGIN = b" </s>", b" <s>"  # with a blank, so no word is like them
#: Tokens that are worked on together, entries that a task gathers before it sends them, and tokens behind them (so 32 bits hold a task's counts).
SLICE, GATHER, MOST_TOKENS = 1_000_000, 2_000_000, 1 << 31
#: Bytes of text for a shard, and files that a worker holds open.
SHARD_BYTES, MAPS = 32_000_000, 2_000
WORDS, PAIRS, STATS, GRAMS, CONTEXTS = "words", "pairs", "stats", "grams", "contexts"


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """By ranges of hashes, so sorted shards are sorted together."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def merge(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their values (rows)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first, axis=0, dtype=values.dtype) if len(first) else values[:0]


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint32)


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of mix64: shifts are undone step by step, factors by their inverses modulo 2**64."""
    for shift, factor in ((31, 0x319642B2D24D8EC3), (27, 0x96DE1B173F119089)):
        x = x ^ (x >> np.uint64(shift)) ^ (x >> np.uint64(2 * shift))
        x = x * np.uint64(factor)
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


# Files of the shared folder.

#: A shard's file as a worker needs it: its own name, rows, and whether its counts take 64 bits.
File = tuple[str, int, bool]
NONE: File = ("", 0, False)


def put(path: str, name: str, *arrays: np.ndarray) -> str:
    """Write arrays to a file of a name of its own, so a repeated task does no harm; the name counts that reaches the driver."""
    own = f"{name}-{uuid.uuid4().hex}"
    save(f"{path}/{own}", *arrays)
    return own


def narrow(counts: np.ndarray) -> tuple[np.ndarray, bool]:
    """Counts in 32 bits if all fit, and whether they do not."""
    wide = bool(len(counts)) and int(counts.max()) > 0xFFFFFFFF
    return counts.astype(np.int64 if wide else np.uint32), wide


class Maps:
    """Files of a folder, mapped when they are first needed; the one unused for longest goes when there are too many."""

    def __init__(self, path: str):
        self.path, self.open = path, OrderedDict()

    def __getitem__(self, name: str) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
        else:
            if len(self.open) >= MAPS:
                self.open.popitem(last=False)
            self.open[name] = mapped(f"{self.path}/{name}")
        return self.open[name]


class Shards:
    """Sorted hash arrays over shards by ranges of hashes: files of hashes and, after them, values of given kinds (None: counts of 32 or 64 bits)."""

    def __init__(self, maps: Maps, files: tuple[File, ...], *kinds: type | None):
        self.maps, self.files, self.kinds = maps, files, kinds
        self.first = np.cumsum([0, *(n for _, n, _ in files)])

    def arrays(self, s: int) -> list[np.ndarray]:
        name, n, wide = self.files[s]
        raw = self.maps[name]
        out, at = [raw[: 8 * n].view(np.uint64)], 8 * n
        for k in self.kinds:
            kind = np.dtype(k or (np.int64 if wide else np.uint32))
            out.append(raw[at : at + kind.itemsize * n].view(kind))
            at += kind.itemsize * n
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Place of each hash over all shards, -1 where it is not, and its values, else 0."""
        order = np.argsort(h)
        h = h[order]
        edges = np.searchsorted(shard_of(h, len(self.files)), np.arange(len(self.files) + 1))
        place = np.full(len(h), -1, np.int64)
        values = [np.zeros(len(h), k or np.int64) for k in self.kinds]
        for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            if self.files[s][1]:
                own, *held = self.arrays(s)
                part = slice(edges[s], edges[s + 1])
                at = np.minimum(np.searchsorted(own, h[part]), len(own) - 1)
                hit = own[at] == h[part]
                place[part] = np.where(hit, at + self.first[s], -1)
                for v, x in zip(values, held):
                    v[part] = np.where(hit, x[at], 0)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return place[back], [v[back] for v in values]


class Slots(dict):
    """Words to slots; a worker holds what it knows of its words by slot, and starts anew beyond ``most`` of them."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most, self.fresh = most, []

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        self.fresh.append(w)
        return n

    def of(self, tokens: list[bytes]) -> tuple[np.ndarray, list[bytes], bool]:
        """Slots of tokens, the words that are new in order of their slots, and whether slots start anew."""
        if anew := len(self) > self.most:
            self.clear()
        self.fresh = []
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens)), self.fresh, anew


class Words:
    """Ids and training counts of words, from the sorted hash arrays, by slot."""

    def __init__(self, path: str, files: tuple[File, ...]):
        self.shards, self.slots = Shards(Maps(path), files, np.int64), Slots()
        self.id, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, bool]:
        """Slots of tokens, ids of the slots added, and whether slots start anew."""
        slots, fresh, anew = self.slots.of(tokens)
        place, (count,) = self.shards.find(np.fromiter(map(word_hash, fresh), np.uint64, len(fresh)))
        keep = slice(0, 0) if anew else slice(None)
        self.id, self.count = np.append(self.id[keep], place), np.append(self.count[keep], count)
        return slots, place, anew


@lru_cache(maxsize=2)
def words_at(path: str, files: tuple[File, ...]) -> Words:
    return Words(path, files)


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64))


def gram_key(ids: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams: of the first two ids' pair, and then chained."""
    k = pair_key(ids[0], ids[1])
    with np.errstate(over="ignore"):
        for w in ids[2:]:
            k = mix64(k * FACTOR + w.astype(np.uint64) + np.uint64(1))
    return k


def before(ids: np.ndarray, starts: np.ndarray, back: int, begin: int) -> list[np.ndarray]:
    """Ids ``back`` to 1 places before each token, ``begin`` before a text's first, and the tokens' own."""
    out = [ids]
    for _ in range(back):
        x = np.concatenate(([begin], out[0][:-1]))
        x[starts] = begin
        out.insert(0, x)
    return out


class Model:
    """The whole model as workers see it. ``first``, ``second``: discounts of bigrams and of words by distinct contexts; ``above``: (n-grams, contexts, discounts) for each higher length."""

    def __init__(self, path: str, words: tuple[File, ...], pairs: tuple[File, ...], stats: tuple[File, ...], n: int, first: tuple, second: tuple, contexts: int, mass: float, above: tuple):
        self.words, self.n, self.first, self.second, self.contexts, self.mass = Words(path, words), n, np.array((0, *first)), np.array((0, *second)), contexts, mass
        self.vocabulary = sum(f[1] for f in words)
        self.maps = Maps(path)
        self.pairs, self.stats = Shards(self.maps, pairs, None), stats
        self.above = [(Shards(self.maps, g, None), Shards(self.maps, c, np.float64, np.float64), np.array((0, *d))) for g, c, d in above]
        self.edges = np.cumsum([0, *(f[1] for f in stats)])
        self.low, self.size, self.mix = np.zeros(0), np.zeros(0), np.zeros(0)
        self.begin = tuple(float(x[0]) for x in self.by_id(np.array([self.vocabulary]))[:2]) if self.vocabulary else (0.0, 1.0)

    def by_id(self, ids: np.ndarray) -> list[np.ndarray]:
        """Tokens and discount mass of ids as contexts, and words before them; 0 for -1."""
        out = [np.zeros(len(ids), np.float64) for _ in range(3)]
        of = np.searchsorted(self.edges, ids, side="right") - 1
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(len(self.stats) + 1))
        for s in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            i = order[ends[s] : ends[s + 1]]
            name, n, _ = self.stats[s]
            raw = self.maps[name]
            for k, (o, kind) in enumerate(zip(out, (np.float64, np.float64, np.int64))):
                o[i] = raw[8 * k * n : 8 * (k + 1) * n].view(kind)[ids[i] - self.edges[s]]
        return out

    def score(self, tokens: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts, and log10 probabilities after the words before, of tokens of texts that begin at ``starts``."""
        v, fresh, anew = self.words.look_up(tokens)
        if not self.vocabulary:
            return np.zeros(len(v), np.int64), np.zeros(len(v))
        size, gamma, c = self.by_id(fresh)
        low = np.maximum(c - self.second[np.minimum(c, 3).astype(np.int64)], 0) / self.contexts + self.mass / (self.vocabulary + 1)
        mix = np.where(size > 0, gamma, 1.0)
        keep = slice(0, 0) if anew else slice(None)
        self.low, self.size, self.mix = (np.append(old[keep], new) for old, new in ((self.low, low), (self.size, size), (self.mix, mix)))
        u = np.concatenate(([0], v[:-1]))
        size, mix, left = self.size[u], self.mix[u], self.words.id[u]
        size[starts], mix[starts], left[starts] = *self.begin, self.vocabulary
        right = self.words.id[v]
        p = mix * self.low[v]
        known = np.flatnonzero((left >= 0) & (right >= 0) & (size > 0))
        _, (c,) = self.pairs.find(pair_key(left[known], right[known]))
        p[known] += np.maximum(c - self.first[np.minimum(c, 3)], 0) / size[known]
        for length, (grams, contexts, d) in enumerate(self.above, 3):
            ids = before(right, starts, length - 1, self.vocabulary)
            known = np.flatnonzero(np.all([x >= 0 for x in ids[:-1]], axis=0))
            _, (size, gamma) = contexts.find(gram_key([x[known] for x in ids[:-1]]))
            known, size, gamma = known[size > 0], size[size > 0], gamma[size > 0]
            count = np.zeros(len(known), np.int64)
            whole = right[known] >= 0
            _, (count[whole],) = grams.find(gram_key([x[known[whole]] for x in ids]))
            p[known] = np.maximum(count - d[np.minimum(count, 3)], 0) / size + gamma * p[known]
        return self.words.count[v], np.log10(p)


@lru_cache(maxsize=1)
def model_at(*args: object) -> Model:
    return Model(*args)


def slices(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """Tokens of texts, some texts at a time: (tokens, index of each text's end token, first text)."""
    tokens: list[bytes] = []
    ends: list[int] = []
    first = 0
    for i, t in enumerate(texts):
        tokens += t.lower().split()
        ends.append(len(tokens))
        tokens.append(END)
        if len(tokens) >= SLICE:
            yield tokens, np.array(ends), first
            tokens, ends, first = [], [], i + 1
    if ends:
        yield tokens, np.array(ends), first


def gathered(batches: Iterator[pa.RecordBatch], parts: Callable[[list[bytes]], Iterator[tuple[np.ndarray, np.ndarray | None]]], shards: int) -> Iterator[pa.RecordBatch]:
    """Sums of a task's hashes, packed for the shards; parts give hashes with counts, or as they come."""
    held: list[tuple[np.ndarray, np.ndarray | None]] = []
    size = tokens = 0

    def out() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for k, _ in held])
        keys, values = tally(keys) if held[0][1] is None else merge(keys, np.concatenate([v for _, v in held]))
        yield from packed(shard_of(keys, shards), shards, keys, values)

    for b in batches:
        for keys, values in parts(text_bytes(b.column("text"))):
            held.append((keys, values))
            size += len(keys)
            tokens += len(keys) if values is None else int(values.sum(dtype=np.int64))
            if size > GATHER or tokens > MOST_TOKENS:
                yield from out()
                held, size, tokens = [], 0, 0
    if held:
        yield from out()


def packed(of: np.ndarray, shards: int, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard with what of each array is its own; ``of`` rises."""
    edges = np.searchsorted(of, np.arange(shards + 1))
    full = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
    blobs = [[np.ascontiguousarray(a[edges[s] : edges[s + 1]]).tobytes() for s in full] for a in arrays]
    if full:
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(b, pa.binary()) for b in blobs]], ["shard", *"kvw"[: len(arrays)]])


def by_shard(df: DataFrame, shards: int, f: Callable[[int, list[list[bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f(shard, columns of blobs) for each shard; the shards are dealt to as many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*cols):
                if row[0] != at:
                    if held:
                        yield from f(at, list(map(list, zip(*held))))
                    at, held = row[0], []
                held.append(row[1:])
        if held:
            yield from f(at, list(map(list, zip(*held))))

    # A shard's number is its partition's, as numbers would collide under a hash and a range would be sampled first.
    return df.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(run, schema)


def joined(blobs: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the numbers of entries with counts 1 to 4 (Chen and Goodman, 1999)."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 * (k + 1) for k in range(3)]
    return tuple(min(max(d, 0.1 * (k + 1)), k + 1 - 0.05) for k, d in enumerate(raw))


def wide_joined(keys: list[bytes], values: list[bytes], columns: int) -> np.ndarray:
    """Rows of counts that each blob holds in 32 or 64 bits, as its length tells beside its 32-bit keys."""
    return np.concatenate([np.frombuffer(v, np.uint32 if len(v) == len(k) * columns else np.int64).astype(np.int64).reshape(-1, columns) for k, v in zip(keys, values)])


def kinds_of(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == i).sum()) for i in range(1, 5)]


FILE = pa.schema([("shard", pa.int32()), ("k", pa.binary()), ("v", pa.binary()), ("name", pa.string()), ("wide", pa.bool_()), ("n", pa.list_(pa.int64()))])
FILE_SCHEMA = "shard int, k binary, v binary, name string, wide boolean, n array<bigint>"


def told(shard: int, name: str, wide: bool, *n: int) -> pa.RecordBatch:
    """A row about a shard's file, under a negative number."""
    return pa.RecordBatch.from_pydict({"shard": [-1 - shard], "k": [None], "v": [None], "name": [name], "wide": [wide], "n": [list(n)]}, FILE)


def sent(batch: pa.RecordBatch, offset: int = 0) -> pa.RecordBatch:
    """Packed rows for other shards, in the same form; ``offset`` keeps two kinds of shards apart."""
    n, cols = batch.num_rows, dict(zip(batch.schema.names, batch.columns))
    shard = pa.array(cols["shard"].to_numpy() + offset, pa.int32())
    return pa.RecordBatch.from_arrays([shard, cols["k"], cols["v"], pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.list_(pa.int64()))], schema=FILE)


def files_of(rows: DataFrame, shards: int) -> tuple[tuple[File, ...], list[list[int]]]:
    """Files that rows tell of, in order of shards, and their figures."""
    own = {-1 - r["shard"]: r for r in rows.where("shard < 0").select("shard", "name", "wide", "n").collect()}  # a row for each shard
    return tuple((own[s]["name"], own[s]["n"][0], own[s]["wide"]) if s in own else NONE for s in range(shards)), [r["n"] for r in own.values()]


def long_grams(texts: DataFrame, path: str, words: tuple[File, ...], v: int, length: int, shards: int, above: DataFrame | None) -> tuple[DataFrame, tuple]:
    """Counts of n-grams of one length above 2: rows for the next shorter length, and (n-grams, contexts, discounts).

    Of the highest length counts are occurrences; below it they come from ``above``, which tells of each n-gram's longer ones.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_at(path, words)
        for b in batches:
            for tokens, ends, _ in slices(text_bytes(b.column("text"))):
                slots, _, _ = known.look_up(tokens)
                ids = before(known.id[slots], np.concatenate(([0], ends[:-1] + 1)), length - 1, v)
                keys = gram_key(ids)
                order = np.argsort(keys, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
                at = order[first]
                parts = [x[at] for x in ids]
                counts = np.diff(np.append(first, len(keys)))
                values = np.stack([gram_key(parts[:-1]), gram_key(parts[1:]), counts.astype(np.uint64)], axis=1)
                yield from packed(shard_of(keys[at], shards), shards, keys[at], values)

    raw = texts.mapInArrow(count, "shard int, k binary, v binary")
    lower = above is not None
    if lower:
        raw = raw.union(above.where(f"shard between 0 and {shards - 1}").select("shard", "k", "v"))

    def merged(shard: int, blobs: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        own = [(k, x) for k, x in zip(*blobs) if len(x) == 3 * len(k)]
        keys = joined([k for k, _ in own], np.uint64)
        values = joined([x for _, x in own], np.uint64).reshape(-1, 3)
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        counts = np.add.reduceat(values[:, 2], first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        keys, context, suffix = keys[first], values[first, 0], values[first, 1]
        if lower:
            other = [(k, x) for k, x in zip(*blobs) if len(x) != 3 * len(k)]
            _, counts = merge(joined([k for k, _ in other], np.uint64), joined([x for _, x in other], np.uint32).astype(np.int64))
        stored, wide = narrow(counts)
        yield told(shard, put(path, f"{GRAMS}{length}", keys, stored), wide, len(keys), *kinds_of(counts))
        c, sums = merge(context, np.stack([counts, counts == 1, counts == 2, counts > 2], axis=1).astype(np.int64))
        for x in packed(shard_of(c, shards), shards, c, sums):
            yield sent(x, shards)
        for x in packed_tally(suffix, shards):
            yield sent(x)

    out = written(by_shard(raw, shards, merged, FILE_SCHEMA), f"lm-grams{length}", above)
    grams, figures = files_of(out, shards)
    d = discounts([sum(x[k] for x in figures) for k in range(1, 5)])
    weights = np.array(d)

    def contexts(shard: int, blobs: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        c, sums = merge(joined(blobs[0], np.uint64), joined(blobs[1], np.int64).reshape(-1, 4))
        yield told(shard, put(path, f"{CONTEXTS}{length}", c, sums[:, 0].astype(float), (sums[:, 1:] @ weights) / np.maximum(sums[:, 0], 1)), False, len(c))

    rows = out.where(f"shard >= {shards}").select((F.col("shard") - shards).alias("shard"), "k", "v")
    kept = written(by_shard(rows, shards, contexts, FILE_SCHEMA), f"lm-contexts{length}")
    files, _ = files_of(kept, shards)
    remove(kept)
    return out, (grams, files, d)


def packed_tally(keys: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    keys, counts = tally(keys)
    return packed(shard_of(keys, shards), shards, keys, counts)


def train(docs: DataFrame, shards: int | None = None, order: int = 2) -> tuple[str, tuple]:
    """Path of the model's files, and the arguments for Model."""
    spark = docs.sparkSession
    path = new_path(spark, "lm")
    texts = docs.select("text")
    if not shards:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def count_words(batches):
        known: dict[bytes, int] = {}

        def parts(texts):
            for tokens, _, _ in slices(texts):
                counts = Counter(tokens)
                new = counts.keys() - known.keys()
                if len(known) + len(new) > 600_000:
                    known.clear()
                    new = counts.keys()
                known.update(zip(new, map(word_hash, new)))
                yield np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts)), np.fromiter(counts.values(), np.uint32, len(counts))

        return gathered(batches, parts, shards)

    def save_words(shard, blobs):
        keys, counts = merge(joined(blobs[0], np.uint64), joined(blobs[1], np.uint32).astype(np.int64))
        yield told(shard, put(path, WORDS, keys, counts), True, len(keys), int(counts.sum()))

    rows = written(by_shard(texts.mapInArrow(count_words, "shard int, k binary, v binary"), shards, save_words, FILE_SCHEMA), "lm-words")
    words, figures = files_of(rows, shards)
    remove(rows)
    total, v = sum(x[1] for x in figures), sum(f[1] for f in words)
    if v >= (1 << 32) - 1:
        raise ValueError("more than 4.2 billion different words")

    above, longer = None, []
    for length in range(order, 2, -1):
        above, found = long_grams(texts, path, words, v, length, shards, above)
        longer.insert(0, found)

    def count_pairs(batches):
        known = words_at(path, words)

        def parts(texts):
            for tokens, ends, _ in slices(texts):
                slots, _, _ = known.look_up(tokens)
                left, right = before(known.id[slots], np.concatenate(([0], ends[:-1] + 1)), 1, v)
                yield pair_key(left, right), None

        return gathered(batches, parts, shards)

    edges = np.cumsum([0, *(f[1] for f in words)])

    def save_pairs(shard, blobs):
        """Write the shard's bigrams; what they tell of contexts and of words goes to the words' shards."""
        keys, counts = merge(joined(blobs[0], np.uint64), joined(blobs[1], np.uint32).astype(np.int64))
        stored, wide = narrow(counts)
        name = put(path, PAIRS, keys, stored)
        pair = unmix64(keys)
        u, w = pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)
        stats = np.stack([counts, counts == 1, counts == 2, counts > 2, np.zeros_like(counts)], axis=1).astype(np.int64)
        a, sa = merge(u, stats)
        b, sb = merge(w, np.tile(np.array([0, 0, 0, 0, 1]), (len(w), 1)))
        ids, values = merge(np.concatenate([a, b]), np.concatenate([sa, sb]))
        of = np.searchsorted(edges, ids.astype(np.int64), side="right") - 1
        of = np.where(ids == v, shards, of)
        values, _ = narrow(values)
        for x in packed(of, shards + 1, ids.astype(np.uint32), values):
            yield sent(x)
        yield told(shard, name, wide, len(keys), *kinds_of(counts))

    found = texts.mapInArrow(count_pairs, "shard int, k binary, v binary") if above is None else above.where(f"shard between 0 and {shards - 1}").select("shard", "k", "v")
    rows = written(by_shard(found, shards, save_pairs, FILE_SCHEMA), "lm-stats", above)
    pairs, figures = files_of(rows, shards)
    contexts = sum(f[1] for f in pairs)
    first = discounts([sum(x[k] for x in figures) for k in range(1, 5)])
    d = np.array(first)

    def save_stats(shard, blobs):
        start, size = (v, 1) if shard == shards else (int(edges[shard]), words[shard][1])
        ids, s = merge(joined(blobs[0], np.uint32).astype(np.int64), wide_joined(blobs[0], blobs[1], 5))
        tokens, gamma, left = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        at = ids - start
        tokens[at], left[at] = s[:, 0], s[:, 4]
        gamma[at] = (s[:, 1:4] @ d) / np.maximum(s[:, 0], 1)
        yield told(shard, put(path, STATS, tokens, gamma, left), True, size, *kinds_of(left), int((left > 2).sum()))

    counts = written(by_shard(rows.where("shard >= 0").select("shard", "k", "v"), shards + 1, save_stats, FILE_SCHEMA), "lm-mass", rows)
    stats, figures = files_of(counts, shards + 1)
    remove(counts)
    n = [sum(x[k] for x in figures) for k in range(1, 6)]
    second = discounts(n[:4])
    mass = (second[0] * n[0] + second[1] * n[1] + second[2] * n[4]) / max(1, contexts)
    return path, (path, words, pairs, stats, total, first, second, contexts, mass, tuple(longer))


NAMES = ["n_tokens", "n_known", "base_score", "score"]


def scored(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        m = model_at(*model)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for tokens, ends, _ in slices(text_bytes(b.column("text"))):
            starts = np.concatenate(([0], ends[:-1] + 1))
            counts, score = m.score(tokens, starts)
            base = np.log10((counts + 1) / (m.n + m.vocabulary + 1))
            for c, x in zip(out, (np.ones(len(counts), np.int64), (counts > 0).astype(np.int64), base, score)):
                c.append(np.add.reduceat(x, starts))
        cols = [np.concatenate(c) for c in out]
        n = np.full(b.num_rows, m.n, np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *[pa.array(x) for x in (cols[0], cols[1], n, cols[2], cols[3])]], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_batches(docs, batch, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def perplexity_scores(docs: DataFrame, modulus: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """Train on the rows that aren't held out, score all; the model's files go when the scores are written."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (crc_column("doc_id") % modulus == held).alias("held_out"), "text")
    path, model = train(own.where(~F.col("held_out")), order=order)
    out = written(scored(own, model), "lm-scores")
    drop_path(docs.sparkSession, path)
    return out


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_scores(table(spark, sf_dir, "documents"))
