"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six white-space bytes that separate words; every other byte belongs to a word.
SPACE = b" \t\n\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one named in ``spark.checkpoint.dir``; only where that is unset, as in tests on one
    machine, a folder of our own is made and set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", top)
        spark.sparkContext.setCheckpointDir(top)
        atexit.register(shutil.rmtree, top[7:], ignore_errors=True)
    return top


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts or sets are large: the session's default of rows in an Arrow batch is lowered, another setting is kept."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1500")


def written(df: DataFrame, name: str, *done: DataFrame | None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and lost executors cost nothing.

    ``done``: tables written before that nothing reads any more; they are removed.
    """
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    remove(*done)
    return out


def remove(*done: DataFrame | None) -> None:
    """Remove written tables that nothing reads any more."""
    for d in done:
        if d is not None and (path := getattr(d, "written_at", None)):
            drop_path(d.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` made different from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows numbered from 0 in the given order: each sorted partition counts its own, and the counts add up."""
    own = written(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(name, 33)
    sums = own.groupBy(part.alias("numbered_part")).agg(F.count("*").alias("numbered_n"))  # a row for each partition
    before = F.coalesce(F.sum("numbered_n").over(Window.orderBy("numbered_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("numbered_part", before.alias("numbered_n"))
    out = own.join(F.broadcast(sums), part == F.col("numbered_part"))
    return out.withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("numbered_n")).drop("numbered_part", "numbered_n")


def save(path: str, *arrays: np.ndarray) -> None:
    """Write arrays one after the other; a repeated task writes the same bytes under a name of its own."""
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    with system.open_output_stream(place) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())


def mapped(path: str) -> np.ndarray:
    """The file's bytes, mapped into memory; from a store that can't be mapped, a copy that vanishes when it is let go."""
    system, place = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(place, np.uint8, "r") if os.path.getsize(place) else np.zeros(0, np.uint8)
    with tempfile.NamedTemporaryFile() as copy:
        with system.open_input_stream(place) as read:
            while block := read.read(1 << 24):
                copy.write(block)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r") if copy.tell() else np.zeros(0, np.uint8)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def portions(b: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes, so what Python makes of them stays small."""
    rows = max(1, b.num_rows * most // max(1, b.nbytes))
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b):
                out = f(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


class WordHash(dict):
    """64-bit hashes of words, remembered up to ``most`` words; the memory is bounded, the hashes do not depend on it."""

    def __init__(self, most: int = 250_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd factor for rolling combinations of hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order; of the whole, if it is shorter; none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h + words[i : i + n]) * FACTOR
            h ^= h >> np.uint64(29)
    return mix64(h)


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_of(ids: list) -> np.ndarray:
    """crc32 of the ids written as decimal text; a null id counts as empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], np.uint32)


def crc_column(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
