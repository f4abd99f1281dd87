"""Global numbering without a global window: sorted ranges, counted, then offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.components import checkpointed


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with its rows numbered from ``start`` in a total order.

    Rows are dealt in ranges and sorted where they land; only the count of each range comes to the driver.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(
        sorted_.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())
    offsets, total = {}, start
    for part, n in counts:
        offsets[part], total = total, total + n
    base = F.lit(0)
    if offsets:
        base = F.get(F.array(*[F.lit(offsets.get(k, 0)) for k in range(max(offsets) + 1)]), F.col("__part"))
    return placed.withColumn(name, (F.col("__at") + base).cast("int")).drop("__part", "__at")
