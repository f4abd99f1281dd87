"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source of ``n`` rows whose target share is ``w`` of a mixture of ``total`` rows has the rate
``w * total / n``. Each row's copies are the inverse of the Poisson distribution with that rate at a uniform
number hashed from seed and id, so the choice is the same however often and wherever a task runs. The
distribution's cumulative probabilities are summed once for each source, where they matter to the hash's
resolution, and looked up by bisection. Rows are exploded by their count, large counts in steps that are dealt
out in between, and the whole mixture is shuffled by a hash of seed, id and copy.

Without ``weights`` a source's share is proportional to ``n ** alpha``. Sources that ``weights`` does not
name get rate 0. A null source is a source of its own, a null id hashes as the text ``null``; rows with
the same id, repeated ones too, get the same count. Empty tables give empty mixtures. Texts are not looked at.
Columns ``copy`` and ``order_key`` of the input are replaced, others stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources are broadcast only up to this many, and this many probabilities; beyond it the join shuffles.
BROADCAST_SOURCES, BROADCAST_STEPS = 10_000, 1_000_000
#: Copies that one row of an exploded table stands for before the second explosion.
STRIDE = 1000
_BITS = 48
#: Numbers below this have their factorial's logarithm from a table, others from Stirling's series.
_SMALL = 32


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _BITS // 4), 16, 10).cast("double") / float(2**_BITS)


def log_factorial(k: Column) -> Column:
    """ln k! in double precision."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(_SMALL)])
    x = F.greatest(k, F.lit(_SMALL)).cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k < _SMALL, F.get(table, k.cast("int"))).otherwise(series)


def poisson_thresholds(rates: DataFrame) -> DataFrame:
    """``(source, rate)`` with ``low`` and ``steps``: probabilities of at most low, low + 1, ... copies.

    Counts so far from the rate that the hash can't draw them are left out on both sides.
    """
    rate = F.col("rate")
    spread = 12 * F.sqrt(rate) + 30
    low, high = F.greatest(F.floor(rate - spread), F.lit(0)), F.ceil(rate + spread)
    counts = rates.filter("rate > 0").select("source", "rate", low.alias("low"), F.explode(F.sequence(low, high)).alias("k"))
    chance = F.exp(F.col("k") * F.log(rate) - rate - log_factorial(F.col("k")))
    so_far = F.sum(chance).over(Window.partitionBy("source", "rate").orderBy("k"))
    steps = counts.withColumn("c", so_far).groupBy("source", "rate").agg(F.min("low").alias("low"), F.sort_array(F.collect_list("c")).alias("steps"))
    return steps.unionByName(rates.filter("rate <= 0").select("source", "rate", F.lit(0).cast("long").alias("low"), F.array(F.lit(1.0)).alias("steps")))


def copies(low: Column, steps: Column, u: Column) -> Column:
    """``low`` and the number of steps not above ``u``, by bisection."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(steps).cast("double") + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("a"), F.size(steps).alias("z"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["a"] + acc["z"]) / 2).cast("int")
        below = (acc["a"] < acc["z"]) & (F.get(steps, middle) <= u)
        return F.struct(
            F.when(below, middle + 1).otherwise(acc["a"]).alias("a"), F.when((acc["a"] < acc["z"]) & ~below, middle).otherwise(acc["z"]).alias("z")
        )

    return low + F.aggregate(halvings, start, halve, lambda acc: acc["a"])


def source_rates(docs: DataFrame, source_column: str, weights: dict | None, total: int | None, alpha: float) -> tuple[DataFrame, int, float]:
    """``(source, rate)`` of every source, how many there are, and the highest rate."""
    counts = docs.groupBy(F.col(f"`{source_column}`").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        raw = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    counts = counts.withColumn("w", raw)
    whole = counts.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("sources"), F.max(F.col("w") / F.col("n")).alias("most")).first()
    size = float(whole["n"] or 0) if total is None else float(total)
    if not whole["w"]:
        return counts.select("source", F.lit(0.0).alias("rate")), whole["sources"], 0.0
    rate = F.col("w") / F.lit(whole["w"]) * F.lit(size) / F.col("n")
    return counts.select("source", rate.alias("rate")), whole["sources"], whole["most"] / whole["w"] * size


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    weights: dict | None = None,
    total: int | None = None,
    alpha: float = 0.5,
    seed: int = 17,
) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled, with ``copy`` (from 1) and ``order_key`` added."""
    rates, sources, highest = source_rates(docs, source_column, weights, total, alpha)
    steps = poisson_thresholds(rates)
    if sources <= BROADCAST_SOURCES and sources * (24 * highest**0.5 + 60) <= BROADCAST_STEPS:
        steps = F.broadcast(steps)
    kept = [c for c in docs.columns if c not in ("copy", "order_key")]
    # the caller's columns travel in one struct, so that none clashes with a name used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").alias("of"))
    drawn = rows.join(steps, F.col("of").eqNullSafe(F.col("source")), "inner").select("row", "id", copies(F.col("low"), F.col("steps"), uniform(seed, F.col("id"))).alias("n")).filter("n > 0")
    first = F.lit(1).cast("long")
    if highest > STRIDE:
        drawn = drawn.select("row", "id", "n", F.explode(F.sequence(first, F.col("n"), F.lit(STRIDE).cast("long"))).alias("first")).repartition(F.xxhash64("id", "first"))
        first = F.col("first")
    last = F.least(first + (STRIDE - 1), F.col("n")) if highest > STRIDE else F.col("n")
    many = drawn.select("row", "id", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("copy"))
    keyed = many.select("row", "copy", uniform(seed + 1, F.col("id"), F.col("copy")).alias("order_key"))
    return (
        keyed.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "copy", "order_key")
        .repartition(F.xxhash64("order_key", F.lit(seed)))
        .sortWithinPartitions("order_key")
    )


ORACLE = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, pow(n::DOUBLE, 0.5) / (sum(pow(n::DOUBLE, 0.5)) OVER ()) * (sum(n) OVER ())::DOUBLE / n AS rate FROM counts),
steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates),
cumulative AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
drawn AS (SELECT doc_id, source, CAST('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 12) AS BIGINT)::DOUBLE / 281474976710656 AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.source, count(*) AS n FROM drawn d JOIN cumulative c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u
  GROUP BY d.doc_id, d.source),
copies AS (SELECT doc_id, source, unnest(range(1, n + 1))::INTEGER AS copy FROM counted)
SELECT doc_id, source, copy,
  CAST('0x' || substr(md5('18:' || doc_id::VARCHAR || ':' || copy::VARCHAR), 1, 12) AS BIGINT)::DOUBLE / 281474976710656 AS order_key
FROM copies
"""
