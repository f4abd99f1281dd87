"""A store of Parquet tables under one folder, merged on read: writes add small immutable folders, manifests name them.

A manifest ``table@number`` is one line of JSON: the base folders with the hash buckets of the key that each stands for,
and the delta folders written since, with theirs. An upsert writes its own rows only, a file a touched bucket, and a
manifest that lists one delta more. A reader takes buckets without deltas as they are; in the others a base row gives way to
a delta's row of its key, and of several deltas the newest counts. ``compact`` rewrites the touched buckets alone.

Manifests are written aside and renamed, which fails where that number exists: of two writers the later one lists its
delta after the other's, so no upsert is lost; a replacement that another write overtook is refused. A writer that
dies leaves folders that no manifest names. Folders are deleted with the last manifest that names them, of which
``KEPT_VERSIONS`` stay for readers that planned on them. The file system must rename atomically (HDFS and local ones do).
"""

from __future__ import annotations

import functools
import json
import operator
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.vectors import unit
from tidewheel.sources import items as S
from tidewheel.sources.ingest import EmbeddingProvider, latest_rows

GEOMETRY = "1"
#: Versions of a table whose files stay for readers that planned on them.
KEPT_VERSIONS = 3
#: Deltas after which a table is compacted, and their share of its rows; rows that stand for a bucket, and the most buckets.
MOST_DELTAS, DELTA_SHARE, BUCKET_ROWS, MOST_BUCKETS = 16, 0.2, 250_000, 4096
#: Delta rows whose keys are broadcast to the base when it is read.
BROADCAST_KEYS = 200_000
_DDL = {"items": S.ITEM_DDL, "embeddings": S.EMBEDDING_DDL, "diffs": S.DIFF_DDL, "reviews": S.REVIEW_DDL, "author_stats": S.AUTHOR_DDL, "intents": S.INTENT_DDL, "meta": "key string, value string"}
#: What identifies a row of each table, and the time by which the later of two rows is told.
KEYS = {
    "items": (["item_id"], "updated_at"), "embeddings": (["item_id"], None), "diffs": (["repo", "number"], "fetched_at"),
    "reviews": (["repo", "number", "type"], "reviewed_at"), "author_stats": (["repo", "author"], "cached_at"), "meta": (["key"], None), "intents": (["event_id", "action"], None),
}
#: Columns whose first known value stays, whatever is upserted later.
KEEP = {"items": ["created_at"], "intents": ["delivered_at"]}


@dataclass
class Manifest:
    """A version of a table: ``base`` as (folder, buckets, rows), ``deltas`` as (number, folder, buckets, rows)."""

    number: int = 0
    buckets: int = 1
    base: list = field(default_factory=list)
    deltas: list = field(default_factory=list)

    def folders(self) -> set[str]:
        return {x[0] for x in self.base} | {x[1] for x in self.deltas}

    def touched(self) -> list[int]:
        return sorted({b for x in self.deltas for b in x[2]})

    def text(self) -> str:
        return json.dumps({"buckets": self.buckets, "base": self.base, "deltas": self.deltas})


def bucket_count(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    # ---------------------------------------------------------------- manifests

    def versions(self, name: str) -> list[int]:
        """Numbers of a table's versions that are kept, the current one last."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(int(x.split("@")[1]) for x in names if x.startswith(f"{name}@"))

    def manifest(self, name: str, number: int | None = None) -> Manifest:
        """A version of a table, or the current one; an empty one where none was written."""
        if number is None:
            known = self.versions(name)
            if not known:
                return Manifest()
            number = known[-1]
        stream = self._fs.open(self._path(self._named(name, number)))
        try:
            return Manifest(number, **json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _named(self, name: str, number: int) -> str:
        return f"{self.path}/{name}@{number:012d}"

    def _commit(self, name: str, made: Manifest) -> bool:
        """Name a version; False where its number is taken."""
        aside = self._path(f"{self.path}/_{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(made.text().encode()))
        stream.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path(self._named(name, made.number))), none)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        self._forget(name)
        return True

    def _forget(self, name: str) -> None:
        """Drop manifests beyond those that are kept, and folders that only they name."""
        known = self.versions(name)
        old = [self.manifest(name, n) for n in known[:-KEPT_VERSIONS]]
        live = {f for n in known[-KEPT_VERSIONS:] for f in self.manifest(name, n).folders()} if old else set()
        for m in old:
            self._fs.delete(self._path(self._named(name, m.number)), False)
            for folder in m.folders() - live:
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    # ---------------------------------------------------------------- rows

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*KEYS[name][0]), F.lit(buckets)).cast("int")

    def _write(self, name: str, df: DataFrame, buckets: int) -> tuple[str, list[int], int]:
        """Write rows to a folder of their own, a file a bucket in key order; its name, its buckets and its rows."""
        folder = f"{name}-{uuid.uuid4().hex}"
        dealt = df.withColumn("b", self._bucket(name, buckets)).repartition("b").sortWithinPartitions("b", *KEYS[name][0])
        dealt.write.partitionBy("b").parquet(f"{self.path}/{folder}")
        held = self._files(name, folder).groupBy("b").agg(F.count("*").alias("n")).collect()  # a row a bucket
        return folder, sorted(r["b"] for r in held), sum(r["n"] for r in held)

    def _files(self, name: str, folder: str) -> DataFrame:
        # the schema is given, as a version without rows has no file to tell it
        return self.spark.read.schema(f"{_DDL[name]}, b int").parquet(f"{self.path}/{folder}")

    def _base(self, name: str, m: Manifest) -> DataFrame | None:
        parts = [self._files(name, folder).filter(F.col("b").isin(buckets)) for folder, buckets, _ in m.base if buckets]
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    def _merged(self, name: str, m: Manifest, base: DataFrame | None) -> DataFrame:
        """Rows of the touched buckets: what deltas say, and the base's rows whose keys they do not have."""
        key, keep = KEYS[name][0], KEEP.get(name, [])
        said = functools.reduce(DataFrame.unionByName, [self._files(name, x[1]).withColumn("__v", F.lit(x[0])) for x in m.deltas])
        few = F.broadcast if sum(x[3] for x in m.deltas) <= BROADCAST_KEYS else lambda df: df
        if len(m.deltas) == 1:
            newest, now = said.select(*key), said
        else:
            last = said.groupBy(*key).agg(F.max("__v").alias("__v"))
            newest, now = last.select(*key), said.join(few(last), [*key, "__v"], "left_semi")
        now = now.drop("__v")
        if base is None and len(m.deltas) == 1:
            return now
        for c in keep:
            known = said.filter(F.col(c).isNotNull()).select(*key, "__v", c)
            if base is not None:
                known = known.unionByName(base.join(few(newest), key, "left_semi").filter(F.col(c).isNotNull()).select(*key, F.lit(0).alias("__v"), c))
            first = known.groupBy(*key).agg(F.min(F.struct("__v", c))[c].alias("__first"))
            now = now.join(few(first), key, "left").withColumn(c, F.coalesce("__first", c)).drop("__first")
        return now if base is None else base.join(few(newest), key, "left_anti").unionByName(now)

    def read(self, name: str, version: int | None = None, where: dict | None = None) -> DataFrame:
        """A version of a table, by default the current one; an empty table of its schema where none was written.

        ``where`` gives a whole key, of which one bucket alone is read.
        """
        m = self.manifest(name, version)
        if not m.folders():
            return self.spark.createDataFrame([], _DDL[name])
        base, touched, columns = self._base(name, m), m.touched(), self._files(name, next(iter(m.folders()))).drop("b").columns
        if where is not None:
            key = KEYS[name][0]
            kinds = self.spark.createDataFrame([], _DDL[name]).schema
            mine = self.spark.range(1).select(*[F.lit(where[k]).cast(kinds[k].dataType).alias(k) for k in key]).select(self._bucket(name, m.buckets)).first()[0]
            here = functools.reduce(operator.and_, [F.col(k) == F.lit(where[k]) for k in key])
            base = None if base is None else base.filter((F.col("b") == mine) & here)
            if mine in touched:
                base = self._merged(name, m, base).filter((F.col("b") == mine) & here)
            return self.spark.createDataFrame([], _DDL[name]) if base is None else base.select(*columns)
        if not touched and base is None:
            return self.spark.createDataFrame([], _DDL[name])
        if not touched:
            return base.select(*columns)
        if base is None:
            return self._merged(name, m, None).select(*columns)
        merged = self._merged(name, m, base.filter(F.col("b").isin(touched)))
        clean = base.filter(~F.col("b").isin(touched))
        return (merged if len(touched) == m.buckets else clean.unionByName(merged)).select(*columns)

    def replace(self, name: str, df: DataFrame) -> None:
        """A new version of these rows alone, whose keys must be unique; refused where another write came between."""
        before = self.manifest(name)
        rows = df.select(*self._files_columns(name))
        buckets = bucket_count(rows.count())
        folder, held, n = self._write(name, rows, buckets)
        if not self._commit(name, Manifest(before.number + 1, buckets, [[folder, held, n]])):
            raise RuntimeError(f"another writer changed {name} meanwhile")

    def _files_columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], _DDL[name]).columns

    def upsert(self, name: str, incoming: DataFrame) -> None:
        """Insert or replace rows by the table's key; of incoming rows with one key the latest counts.

        Writes the incoming rows alone, then compacts where deltas have become many.
        """
        key, latest = KEYS[name]
        fitted = S.with_columns(incoming, _DDL[name])
        now = self.manifest(name)
        buckets = now.buckets if now.number else bucket_count(fitted.count())
        folder, held, n = self._write(name, latest_rows(fitted, key, latest), buckets)
        while True:
            if now.number and now.buckets != buckets:
                raise RuntimeError(f"another writer replaced {name} meanwhile")
            number = now.number + 1
            if self._commit(name, Manifest(number, buckets, now.base, [*now.deltas, [number, folder, held, n]])):
                break
            now = self.manifest(name)
        if len(now.deltas) + 1 >= MOST_DELTAS or sum(x[3] for x in now.deltas) + n > max(DELTA_SHARE * sum(x[2] for x in now.base), BUCKET_ROWS):
            self.compact(name)

    def compact(self, name: str) -> None:
        """Rewrite the buckets that deltas touch into one base folder; upserts that come meanwhile stay deltas."""
        now = self.manifest(name)
        touched = now.touched()
        if not touched:
            return
        base = self._base(name, now)
        merged = self._merged(name, now, None if base is None else base.filter(F.col("b").isin(touched))).drop("b")
        folder, held, n = self._write(name, merged, now.buckets)
        counts = {r["b"]: r["n"] for r in base.groupBy("b").agg(F.count("*").alias("n")).collect()} if base is not None else {}  # a row a bucket
        rest = [[f, left, sum(counts.get(b, 0) for b in left)] for f, bs, _ in now.base if (left := [b for b in bs if b not in touched])]
        newest = now
        while True:
            if (newest.base, newest.buckets) != (now.base, now.buckets):
                raise RuntimeError(f"another writer replaced {name} meanwhile")
            later = [x for x in newest.deltas if x[0] > now.number]
            if self._commit(name, Manifest(newest.number + 1, now.buckets, [*rest, [folder, held, n]], later)):
                return
            newest = self.manifest(name)

    def drop_folder(self, path: str) -> None:
        """Delete a folder of the store that no manifest names."""
        self._fs.delete(self._path(path), True)

    def upsert_items(self, incoming: DataFrame) -> None:
        self.upsert("items", incoming)

    def item(self, item_id: str) -> DataFrame:
        """The one item of an id, or no row."""
        return self.read("items", where={"item_id": item_id})

    def by_number(self, repo: str, number: int, kind: str | None = None) -> DataFrame:
        """Items of a repository and number; files are in the order of ids, so the filter skips row groups."""
        kept = self.read("items").filter((F.col("repo") == repo) & (F.col("number") == number))
        return kept if kind is None else kept.filter(F.col("type") == kind)

    def vector(self, item_id: str) -> DataFrame:
        """The one vector of an id, or no row."""
        return self.read("embeddings", where={"item_id": item_id})

    def drop_vectors(self) -> None:
        """Forget all vectors, and what space and geometry they had; items stay."""
        self.replace("embeddings", self.read("embeddings").limit(0))
        self.replace("meta", self.read("meta").filter(~F.col("key").isin("embedding_space", "geometry", "dims")))

    def reset(self) -> None:
        """Forget everything."""
        for name in _DDL:
            if self.versions(name):
                self.replace(name, self.read(name).limit(0))

    def meta(self, key: str) -> str | None:
        row = self.read("meta", where={"key": key}).select("value").first()
        return row["value"] if row else None

    def set_meta(self, key: str, value: str) -> None:
        self.set_metas({key: value})

    def set_metas(self, pairs: dict[str, str]) -> None:
        """Several keys as one version."""
        self.upsert("meta", self.spark.createDataFrame(list(pairs.items()), "key string, value string"))

    def has_embeddings(self) -> bool:
        return not self.read("embeddings").isEmpty()

    def guard(self, space: str | None = None, dims: int | None = None) -> None:
        """Refuse vectors of an unstamped geometry, of another embedding space or of another length."""
        if self.has_embeddings():
            if (found := self.meta("geometry") or "0") != GEOMETRY:
                raise ValueError(f"vectors have geometry {found}, not {GEOMETRY}: backfill first")
            if space is not None and (held := self.meta("embedding_space")) not in (None, space):
                raise ValueError(f"vectors belong to {held}, not {space}: re-embed first")
            if dims is not None and (held := self.read("embeddings").select(F.size("embedding").alias("n")).filter(F.col("n") != dims).first()):
                raise ValueError(f"vectors have {held['n']} dimensions, not {dims}: re-embed first")

    def backfill_geometry(self) -> None:
        """Normalise all vectors and stamp the version last."""
        self.replace("embeddings", self.read("embeddings").withColumn("embedding", unit(F.col("embedding"))))
        self.set_meta("geometry", GEOMETRY)

    def reembed(self, provider: EmbeddingProvider, model: str | None = None) -> None:
        """Vectors of all items anew, slice by slice; space and geometry are stamped last."""
        from tidewheel.sources.scan import reembed

        reembed(self, provider, model)

    def repos(self) -> list[str]:
        return [r[0] for r in self.read("items").select("repo").distinct().orderBy("repo").collect()]
