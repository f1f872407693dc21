"""Linear recurrences y_t = a_t * y_{t-1} + b_t as blocked scans of native expressions.

Maps y -> a y + b compose, so a long series needs no single pass. Rows are sorted into ranges of symbol and time, which cut through a long
symbol, and are written once; blocks of neighbouring rows are folded in tasks of their own, only the blocks' maps (one slim row
for each block) are brought in order for each symbol, and each block is expanded from the value before it. The work per row does not grow with
the series, and no task sees a whole symbol's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut

#: Rows of a block, and blocks of a block of blocks.
BLOCK, BLOCKS = 128, 256


def ranged(df: DataFrame, key: str, order: str, block: int = BLOCK) -> DataFrame:
    """Rows in sorted ranges, written, with ``_id``, which grows with key and order, and ``_block``, of at most ``block`` neighbours."""
    own = df.orderBy(key, order).withColumn("_id", F.monotonically_increasing_id())
    return cut(own.withColumn("_block", F.expr(f"_id div {block}")))


def with_blocks(rows: DataFrame, of_blocks: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of their block in ``of_blocks`` (_key, _of, ...)."""
    return rows.join(of_blocks, (F.col("_block") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key"))).drop("_of", "_key")


def so_far(rows: DataFrame, inputs: dict[str, str], key: str) -> DataFrame:
    """``rows`` with ``_seen_<name>``, the values so far, and ``_mean_<name>``, their mean: sums of blocks add up."""
    cols = [c for i, x in enumerate(inputs.values()) for c in (F.count(x).alias(f"_k{i}"), F.sum(x).alias(f"_s{i}"))]
    sums = rows.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_of")).agg(*cols)
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_key", "_of", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for i in range(len(inputs)) for c in (f"_k{i}", f"_s{i}")])
    own = Window.partitionBy(key, "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    out = with_blocks(rows, before, key)
    out = out.withColumns({f"_k{i}": F.col(f"_k{i}") + F.count(x).over(own) for i, x in enumerate(inputs.values())} | {f"_s{i}": F.col(f"_s{i}") + F.coalesce(F.sum(x).over(own), F.lit(0)) for i, x in enumerate(inputs.values())})
    done = {f"_seen_{n}": F.col(f"_k{i}") for i, n in enumerate(inputs)} | {f"_mean_{n}": F.try_divide(f"_s{i}", f"_k{i}") for i, n in enumerate(inputs)}
    return out.withColumns(done).drop(*[f"_{c}{i}" for i in range(len(inputs)) for c in "ks"])


def in_order(rows: Column) -> Column:
    """Structs that begin with ``_id`` (different in all rows), sorted by it."""
    return F.array_sort(F.collect_list(rows))


def folded(rows: str, i: int) -> Column:
    """The map of all rows of a block."""
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(rows, one, lambda y, x: F.struct((x[f"_a{i}"] * y["a"]).alias("a"), (x[f"_a{i}"] * y["b"] + x[f"_b{i}"]).alias("b")))


def expanded(rows: str, start: Column, i: int, before: bool) -> Column:
    """The values after each row of a block, or before it."""

    def step(s: Column, x: Column) -> Column:
        y = x[f"_a{i}"] * s["y"] + x[f"_b{i}"]
        return F.struct(y.alias("y"), F.concat(s["all"], F.array(s["y"] if before else y)).alias("all"))

    return F.aggregate(rows, F.struct(start.alias("y"), F.array().cast("array<double>").alias("all")), step, lambda s: s["all"])


def carried(maps: DataFrame, k: int) -> DataFrame:
    """_key, _of and the value before each block, from the blocks' maps: they are folded in blocks again, and the few maps of these one after the other."""
    w = Window.partitionBy("_key").orderBy("_id")
    pairs = [f"_{c}{i}" for i in range(k) for c in "ab"]
    supers = maps.withColumn("_super", F.floor((F.row_number().over(w) - 1) / BLOCKS)).groupBy("_key", "_super").agg(in_order(F.struct("_id", *pairs)).alias("_maps"))
    supers = supers.withColumns({f"_m{i}": folded("_maps", i) for i in range(k)})
    earlier = Window.partitionBy("_key").orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda i: F.aggregate(F.collect_list(f"_m{i}").over(earlier), F.lit(0.0), lambda y, m: m["a"] * y + m["b"])
    supers = supers.withColumns({f"_from{i}": start(i) for i in range(k)})
    values = [expanded("_maps", F.col(f"_from{i}"), i, True).alias(f"_y{i}") for i in range(k)]
    out = supers.select("_key", F.explode(F.arrays_zip(F.col("_maps._id").alias("_of"), *values)).alias("_x"))
    return out.select("_key", "_x._of", *[F.col(f"_x._y{i}").alias(f"_from{i}") for i in range(k)])


def solved(rows: DataFrame, maps: dict[str, tuple[Column, Column]], key: str) -> DataFrame:
    """``rows`` (as ``ranged`` gives them) without ``_id`` and ``_block``, with a column for each of ``maps``."""
    k, keep = len(maps), [c for c in rows.columns if c not in ("_id", "_block")]
    own = rows.withColumns({f"_{c}{i}": m.cast("double") for i, pair in enumerate(maps.values()) for c, m in zip("ab", pair)})
    pairs = [f"_{c}{i}" for i in range(k) for c in "ab"]
    slim = own.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_id")).agg(in_order(F.struct("_id", *pairs)).alias("_rows"))
    slim = slim.select("_key", "_id", *[folded("_rows", i).alias(f"_m{i}") for i in range(k)])
    slim = slim.select("_key", "_id", *[F.col(f"_m{i}.{c}").alias(f"_{c}{i}") for i in range(k) for c in "ab"])
    row = F.struct("_id", *pairs, F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))
    blocks = own.groupBy(F.col(key), "_block").agg(in_order(row).alias("_rows"))
    blocks = with_blocks(blocks, carried(slim, k), key)
    values = [expanded("_rows", F.col(f"_from{i}"), i, False).alias(f"_y{i}") for i in range(k)]
    out = blocks.select(F.explode(F.arrays_zip(F.col("_rows._row").alias("_row"), *values)).alias("_x"))
    return out.select("_x._row.*", *[F.col(f"_x._y{i}").alias(n) for i, n in enumerate(maps)])


def affine_scan(df: DataFrame, maps: dict[str, tuple[Column, Column]], key: str = "symbol", order: str = "ts", block: int = BLOCK) -> DataFrame:
    """``df`` with a column for each of ``maps``: name -> (a, b). The value before the first row counts as 0."""
    made = {f"_in{c}{i}": m for i, pair in enumerate(maps.values()) for c, m in zip("ab", pair)}
    rows = ranged(df.withColumns(made), key, order, block)
    return solved(rows, {n: (F.col(f"_ina{i}"), F.col(f"_inb{i}")) for i, n in enumerate(maps)}, key).drop(*made)


def seeded_ewma(df: DataFrame, series: dict[str, tuple[str, float, int]], key: str = "symbol", order: str = "ts") -> DataFrame:
    """Columns name -> (input, alpha, seed): NULL until ``seed`` values were seen, then their mean, then
    alpha * x + (1 - alpha) * y; a NULL input carries y on."""
    rows = so_far(ranged(df, key, order), {n: x for n, (x, _, _) in series.items()}, key)
    maps = {}
    for n, (x, alpha, seed) in series.items():
        v, k = F.col(x), F.col(f"_seen_{n}")
        a = F.when((k < seed) | ((k == seed) & v.isNotNull()), 0.0).when(v.isNull(), 1.0).otherwise(1 - alpha)
        b = F.when((k == seed) & v.isNotNull(), F.col(f"_mean_{n}")).when((k < seed) | v.isNull(), 0.0).otherwise(alpha * v)
        maps[n] = (a, b)
    done = {n: F.when(F.col(f"_seen_{n}") >= seed, F.col(n)) for n, (_, _, seed) in series.items()}
    return solved(rows, maps, key).withColumns(done).drop(*[f"_{c}_{n}" for n in series for c in ("seen", "mean")])


def wilder(df: DataFrame, name: str, x: str, period: int) -> DataFrame:
    """Wilder's mean: seeded with the plain mean of the first ``period`` values."""
    return seeded_ewma(df, {name: (x, 1.0 / period, period)})


def ewm(df: DataFrame, series: dict[str, tuple[str, float]], adjust: bool, least: int = 1, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Exponentially weighted means that start with the first value; with ``adjust``, of weights (1 - alpha)^i that add up to one."""
    rows = so_far(ranged(df, key, order), {n: x for n, (x, _) in series.items()}, key)
    maps = {}
    for n, (x, alpha) in series.items():
        v, first = F.col(x), F.col(f"_seen_{n}") <= 1
        if adjust:
            maps[n] = (F.lit(1 - alpha), F.coalesce(v, F.lit(0.0)))
            maps[f"_weight_{n}"] = (F.lit(1 - alpha), F.when(v.isNotNull(), 1.0).otherwise(0.0))
        else:
            maps[n] = (F.when(v.isNull(), 1.0).when(first, 0.0).otherwise(1 - alpha), F.when(v.isNull(), 0.0).when(first, v).otherwise(alpha * v))
    value = lambda n: F.col(n) / F.col(f"_weight_{n}") if adjust else F.col(n)
    done = {n: F.when(F.col(f"_seen_{n}") >= least, value(n)) for n in series}
    return solved(rows, maps, key).withColumns(done).drop(*[f"_{c}_{n}" for n in series for c in ("seen", "mean")], *[m for m in maps if m.startswith("_weight_")])
