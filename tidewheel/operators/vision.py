"""Vision documents: sections of a markdown outline and the text embedded for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, SECTION, LEAST = 8000, 6000, 20


def read_document(spark: SparkSession, *paths: str) -> DataFrame:
    """``(text)`` of the first path that can be read."""
    for path in paths[:-1]:
        try:
            df = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
            df.head(1)
            return df
        except Exception:  # noqa: BLE001 - any unreadable path falls through to the next
            continue
    return spark.read.text(paths[-1], wholetext=True).withColumnRenamed("value", "text")


def sections(documents: DataFrame) -> DataFrame:
    """``(doc, idx, heading, text)``: text under headings of one to three #, longer than twenty characters.

    ``documents``: (doc, text). What precedes the first heading is the document's overview.
    """
    lines = documents.select("doc", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    heading = F.regexp_extract("line", "^#{1,3}\\s+(.+)", 1)
    is_heading = F.col("line").rlike("^#{1,3}\\s+.")
    running = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("h", F.when(is_heading, heading)).withColumn("idx", F.count("h").over(running))
    grouped = marked.groupBy("doc", "idx").agg(
        F.coalesce(F.max("h"), F.lit("Document Overview")).alias("heading"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("h").isNull(), F.struct("i", "line")))), lambda s: s["line"]), "\n").alias("text"),
    )
    trimmed = grouped.withColumn("text", F.regexp_replace("text", "^\\s+|\\s+$", ""))
    return trimmed.filter(F.length("text") > LEAST).select("doc", F.col("idx").cast("int").alias("idx"), "heading", "text")


def embedding_inputs(documents: DataFrame) -> DataFrame:
    """Sections with what is embedded for them; a short document also stands there whole, before them."""
    parts = sections(documents).withColumn("input", F.concat("heading", F.lit("\n\n"), F.substring("text", 1, SECTION)))
    whole = documents.filter(F.length("text") < WHOLE).select(
        "doc", F.lit(-1).alias("idx"), F.lit("Full Document").alias("heading"), "text", F.col("text").alias("input")
    )
    return whole.unionByName(parts)
