"""Mixing sources to target weights.

Token totals per source give a repetition rate for each source; a document is taken
``floor(rate)`` times, plus once more with a probability equal to the fraction: one Bernoulli draw, decided by the MD5
of a seed and the document's id. All of it is DataFrame expressions.

A source's taken words differ from its target as independent draws do: with p the fraction, the standard deviation is
sqrt(p (1 - p) sum(size ** 2)), so a source of a few very long documents may end some way off; reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, the last one; a null id draws as an empty one; rows
with the same id decide alike, each row by itself; a source without any word has target 0, so its documents are not
taken; very long texts are counted whole; an empty table gives an empty result; columns other than doc_id, text and source
are ignored by ``mix`` and kept as they are by ``emit``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, numbered, table, word_count, written

#: Sources up to this number, and this many bytes of names, may be broadcast.
BROADCAST_SOURCES, BROADCAST_BYTES = 100_000, 8_000_000
SEED = 20_251


def source_plan(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """A row per source: source, source_size, target, whole (copies for sure), part (probability of one more).

    Sources in code-point order, null last, weigh ``weights`` in turn. Water filling: a target is the
    lesser of ``most`` times the source's size and its weight times a level. The level starts as all tokens by all weights; sources
    that would stand above their bound give up the excess, which raises the level, until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = numbered(per, "place", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    per = written(per.withColumns({"weight": w, "full": most * F.col("source_size")}), "mix-sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, over = 0.0, -1
    while True:
        above = F.col("full") < F.col("weight") * F.lit(level)
        n, bound, rest = per.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("full"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == over or not rest:
            break
        level, over = (float(total) - bound) / rest, n
    per = per.withColumn("target", F.least("full", F.col("weight") * F.lit(level)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.select("source", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"))


def chance(seed: int) -> Column:
    """A number in [0, 1) from a seed and the document's id: the first 52 bits of their MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def decide(docs: DataFrame, weights: tuple[float, ...], most: float) -> tuple[DataFrame, DataFrame, bool]:
    """Sizes of documents, the plan, and whether the plan is small enough to be broadcast."""
    sizes = written(docs.select("doc_id", "source", word_count("text").alias("size")), "mix-sizes")
    plan = written(source_plan(sizes, weights, most), "mix-plan")
    n, width = plan.agg(F.count("*"), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    return sizes, plan, n <= BROADCAST_SOURCES and 4 * width <= BROADCAST_BYTES


def joined_plan(frame: DataFrame, plan: DataFrame, small: bool) -> tuple[DataFrame, str]:
    """``frame`` with its source's row of ``plan`` as one struct, and that column's name, which is new."""
    of, name = fresh(frame, "of", "plan")
    p = plan.select(F.col("source").alias(of), F.struct(*plan.columns).alias(name))
    return frame.join(F.broadcast(p) if small else p, frame["source"].eqNullSafe(p[of])).drop(of), name


def copies_of(plan: str, seed: int) -> Column:
    return (F.col(f"{plan}.whole") + F.when(chance(seed) < F.col(f"{plan}.part"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = SEED) -> DataFrame:
    """Rows doc_id, size, source_size, target, copies, taken."""
    sizes, plan, small = decide(docs, weights, most)
    rows, p = joined_plan(sizes, plan, small)
    copies = copies_of(p, seed)
    return rows.select("doc_id", "size", f"{p}.source_size", f"{p}.target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emit(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = SEED) -> DataFrame:
    """``docs`` with the same columns, each row as often as the mix takes it."""
    _, plan, small = decide(docs, weights, most)
    rows, p = joined_plan(docs, plan, small)
    n, copy = fresh(rows, "copies", "copy")
    each = rows.withColumn(n, copies_of(p, seed).cast("int")).where(F.col(n) > 0)
    return each.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3.0::DOUBLE * source_size AS bound FROM s),
f AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total, coalesce(sum(bound) OVER (ORDER BY bound / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (ORDER BY bound / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
v AS (SELECT arg_min((total - before) / rest, bound / weight) AS level FROM f WHERE (total - before) / rest <= bound / weight),
t AS (SELECT source, source_size, least(bound, weight * level) AS target FROM w, v),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
x AS (SELECT doc_id, size, source_size, target, (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM x"""
