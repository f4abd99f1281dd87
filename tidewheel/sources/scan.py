"""The scan job: paged records to items, what changed, vectors for it, the store, a report."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewheel.functions.mapping import Window, earliest_window
from tidewheel.functions.vectors import is_zero
from tidewheel.operators.components import checkpointed
from tidewheel.sources import ingest
from tidewheel.sources.ingest import EmbeddingProvider
from tidewheel.sources.store import GEOMETRY, Store

#: Metadata whose change alone rewrites an item.
METADATA = ["state", "author", "author_is_bot", "closed_at", "labels", "ci_status", "review_count", "additions", "deletions", "changed_files", "has_tests", "node_id", "head_ref_oid", "closes_issues"]


@dataclass(frozen=True)
class ScanReport:
    """What a scan found and did."""

    repo: str
    fetched: int
    new: int
    updated: int
    missing_vector: int
    unchanged: int
    refreshed: int
    embedded: int
    zero_vectors: int

    def lines(self) -> list[str]:
        out = [f"{self.repo}: {self.fetched} fetched, {self.new} new, {self.updated} updated, {self.unchanged} unchanged, {self.refreshed} with new metadata, {self.embedded} embedded"]
        if self.zero_vectors:
            out.append(f"warning: {self.zero_vectors} items have no usable vector and match nothing")
        return out


def fetch_plan(windows: list[Window]) -> list[dict]:
    """Options of the source reads of a scan: open items, and closed ones since the first window where any is declared."""
    first = earliest_window(windows)
    since = None if first is None else datetime.fromtimestamp(first / 1000).astimezone().isoformat()
    return [{"state": "open"}, *([{"state": "closed", "since": since}] if since else [])]


#: Items that are embedded and saved at once.
SLICE_ITEMS = 50_000


def embed_slices(store: Store, pending: DataFrame, provider: EmbeddingProvider, model: str | None = None, slice_items: int = SLICE_ITEMS) -> int:
    """Embed items and save their vectors slice by slice, so a failure loses one slice at most; how many vectors are zero.

    Slices are of ids by hash, dealt to a folder each under the store once, so that a slice reads its own items only; the
    folder goes when all is done. Each slice is one delta of the store, committed before the next begins; what a vector was made of
    stands beside it, so who comes again embeds only what has no vector of its present text (``missing_vectors``).
    """
    slices = max(1, -(-pending.count() // slice_items))
    spark, zero = pending.sparkSession, 0
    cores = spark.sparkContext.defaultParallelism
    folder = f"{store.path}/_pending-{uuid.uuid4().hex}"
    needed = pending.select("item_id", "title", *[c for c in ("full_body", "body") if c in pending.columns])
    if slices > 1:
        number, part = F.pmod(F.xxhash64("item_id"), F.lit(slices)), F.pmod(F.xxhash64(F.lit(1), "item_id"), F.lit(cores))
        needed.withColumn("slice", number.cast("int")).repartition("slice", part).write.partitionBy("slice").parquet(folder)
    try:
        for k in range(slices):
            # the schema is given, as a slice may have no file to tell it
            mine = needed if slices == 1 else spark.read.schema(StructType([*needed.schema, StructField("slice", IntegerType())])).parquet(folder).filter(F.col("slice") == k).drop("slice").repartition(cores)
            made = checkpointed(ingest.embed(mine, provider, model=model))
            done = made.agg(F.count("*").alias("n"), F.count_if(is_zero(F.col("embedding"))).alias("zero")).first()
            if done["n"]:
                store.upsert("embeddings", made)
                zero += done["zero"]
    finally:
        if slices > 1:
            store.drop_folder(folder)
    return zero


def missing_vectors(items: DataFrame, vectors: DataFrame, space: str, model: str | None = None) -> DataFrame:
    """Items without a vector of their present text in an embedding space."""
    keyed = items.withColumn("text_key", ingest.text_key(ingest.prepared_text(items, model)))
    have = vectors.filter(F.col("embedding_space") == space).select("item_id", "text_key")
    return keyed.join(have, ["item_id", "text_key"], "left_anti").drop("text_key")


def reembed(store: Store, provider: EmbeddingProvider, model: str | None = None, slice_items: int = SLICE_ITEMS) -> None:
    """Vectors of all items in a provider's space, slice by slice; one that failed is resumed where it stopped.

    The space is stamped first as unfinished, so nothing takes old and new vectors for one space, and as done last.
    """
    space = ingest.embedding_space(provider.name, model or provider.name, provider.dims)
    store.set_metas({"embedding_space": f"unfinished {space}"})
    embed_slices(store, checkpointed(missing_vectors(store.read("items"), store.read("embeddings"), space, model)), provider, model, slice_items)
    kept = store.read("embeddings").join(store.read("items").select("item_id"), "item_id", "left_semi").filter(F.col("embedding_space") == space)
    if kept.count() != store.read("embeddings").count():
        store.replace("embeddings", checkpointed(kept))
    store.set_metas({"embedding_space": space, "geometry": GEOMETRY})


def scan(store: Store, repo: str, fetched: DataFrame, provider: EmbeddingProvider, model: str | None = None, slice_items: int = SLICE_ITEMS) -> ScanReport:
    """Bring a store up to date with ``fetched`` items (``ingest.fetched_items``) of a repository.

    Items whose text may have changed, or that have no vector of it, are embedded; others keep theirs. The items are
    written before the vectors and the vectors slice by slice, so a scan that fails in between finds what is missing the next time.
    """
    space = ingest.embedding_space(provider.name, model or provider.name, provider.dims)
    store.guard(space, provider.dims)
    stored, vectors = store.read("items").filter(F.col("repo") == repo), store.read("embeddings")
    changes = checkpointed(ingest.classify_changes(fetched, stored, vectors, ingest.text_key(ingest.prepared_text(fetched, model))))
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    same = changes.filter(F.col("change").isin("unchanged", "missing-vector"))
    dirty = checkpointed(ingest.dirty_metadata(same, stored, METADATA))
    write = changes.filter(F.col("change").isin("new", "updated")).unionByName(changes.join(dirty, "item_id", "left_semi").filter(F.col("change").isin("unchanged", "missing-vector")))
    if not write.isEmpty():
        store.upsert("items", write)
    pending = changes.filter("change <> 'unchanged'")
    embedded, zero = sum(n for c, n in counts.items() if c != "unchanged"), 0
    if embedded:
        # stamped first: whatever slice a failing scan has saved is of this space
        store.set_metas({"embedding_space": space, "geometry": GEOMETRY})
        zero = embed_slices(store, pending, provider, model, slice_items)
    return ScanReport(
        repo, sum(counts.values()), counts.get("new", 0), counts.get("updated", 0), counts.get("missing-vector", 0), counts.get("unchanged", 0),
        dirty.count(), embedded, zero,
    )
