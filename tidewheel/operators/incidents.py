"""Incident windows as a table: which items were closed inside any of them, however many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.mapping import Window
from tidewheel.operators.components import checkpointed


def window_table(spark: SparkSession, windows: list[Window]) -> DataFrame:
    return spark.createDataFrame([(w.start, w.end, w.reason) for w in windows], "start long, end long, reason string")


def window_bins(windows: DataFrame) -> DataFrame:
    """``windows`` (start, end) as at most two bins a window, and one row a bin, whatever lies in it.

    A window is cut at bins of the least power of two that holds its length, its ``level``. In a bin, what reaches the left
    edge adds up to one span, and so does what reaches the right edge; what does neither is longer than half the bin, so it
    holds the middle, and those too are one span: ``(level, bin, left_end, mid_start, mid_end, right_start)``. Rows
    without a start before their end cover nothing.
    """
    spans = windows.select("start", "end").filter(F.col("start") < F.col("end")).withColumn("level", F.length(F.bin(F.col("end") - F.col("start") - 1)))
    cut = spans.withColumn("bin", F.explode(F.expr("sequence(shiftright(start, level), shiftright(end - 1, level))")))
    edges = cut.withColumn("low", F.expr("shiftleft(bin, level)")).withColumn("high", F.expr("shiftleft(bin + 1, level)"))
    left, right = F.col("start") <= F.col("low"), F.col("end") >= F.col("high")
    inside = ~left & ~right
    return edges.groupBy("level", "bin").agg(
        F.max(F.when(left, F.least("end", "high"))).alias("left_end"), F.min(F.when(inside, F.col("start"))).alias("mid_start"),
        F.max(F.when(inside, F.col("end"))).alias("mid_end"), F.min(F.when(right, F.greatest("start", "low"))).alias("right_start"),
    )


def covered(moments: DataFrame, windows: DataFrame) -> DataFrame:
    """The distinct ``at`` (epoch milliseconds) of ``moments`` that lie in any half-open window.

    A moment looks up one bin for each level that occurs, of which there are at most 63, so it meets no window by itself.
    """
    bins = checkpointed(window_bins(windows))
    levels = sorted(r["level"] for r in bins.select("level").distinct().collect())
    asked = moments.select("at").distinct()
    if not levels:
        return asked.limit(0)
    looked = asked.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("bin", F.expr("shiftright(at, level)"))
    hit = (F.col("at") < F.col("left_end")) | (F.col("at") >= F.col("right_start")) | ((F.col("at") >= F.col("mid_start")) & (F.col("at") < F.col("mid_end")))
    return looked.join(bins, ["level", "bin"]).filter(F.coalesce(hit, F.lit(False))).select("at").distinct()


#: Rows of items that are not closed go to the join by as many keys, as they have no time to go by.
SPREAD = 4096


def mark_incidents(items: DataFrame, windows: DataFrame, name: str = "incident_closed") -> DataFrame:
    """``items`` with a boolean: closed inside any window of ``windows`` (start, end in epoch milliseconds).

    Equal to ``mapping.incident_closed`` with the same windows, for any number of them. False where the state or the time
    is null. A column of that name is replaced; others stay, also ones named like those of ``windows``. A moment at which very
    many items were closed is one key of the last join, whose other side has it once; adaptive execution splits it.
    """
    closed = (F.col("state") == "closed") & F.col("closed_at").isNotNull()
    moment = F.when(closed, F.unix_millis(F.col("closed_at")))
    hits = covered(items.select(moment.alias("at")).filter("at is not null"), windows).select((F.col("at") * 2).alias("__key"), F.lit(True).alias("__hit"))
    names = [F.col(c) for c in ("repo", "number", "item_id") if c in items.columns]
    # even keys are times, odd ones only spread what has none
    apart = 1 + 2 * F.pmod(F.xxhash64(*names), F.lit(SPREAD)) if names else F.lit(1)
    keyed = items.withColumn("__key", F.coalesce(F.when(closed, moment * 2), apart.cast("bigint")))
    return keyed.join(hits, "__key", "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")
