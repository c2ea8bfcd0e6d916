"""Vector collections: a table of vectors with metadata, and the operations of a vector store over it.

A collection is a folder of Parquet versions. Each write adds a version and a numbered pointer to it, one small file that comes to its name by a rename; the greatest number is current. No file
changes once it is there, so readers see the old version or the new one, and of two writers that started from one version the second is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import vector_scores

SCHEMA = "id string, embedding array<float>, metadata map<string,string>, document string, updated_at timestamp"
_PARTS = "bucket int, folder string, n bigint"


@dataclass
class Collection:
    """buckets: files of a version are dealt by the hash of the id, and a write makes new files of those buckets alone in which an id is touched. When one has more than `most` rows,
    the collection is dealt anew into as many buckets as bring them below half of that on average."""

    spark: SparkSession
    path: str
    dimension: int
    metric: str = "cosine"
    buckets: int = 16
    most: int = 200_000
    _number: int = 0

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def create(self) -> Collection:
        return self._point([])

    def _point(self, parts: list[tuple[int, str, int]]) -> Collection:
        """Make parts (bucket, folder, rows) the current version."""
        version = f"{self.path}/m-{uuid.uuid4().hex}"
        self.spark.createDataFrame(parts, _PARTS).coalesce(1).write.json(version)
        moved = self.spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\") AS t").first().t
        add_pointer(self.spark, self.path, self._number + 1, json.dumps({"version": version, "dimension": self.dimension, "metric": self.metric, "buckets": self.buckets, "moved": moved}))
        self._number += 1
        return self

    def _parts(self) -> dict[int, tuple[str, int]]:
        """Folder and rows of each bucket that has any: as many as there are buckets at most. The number of buckets is the current version's."""
        self._number, now = pointer(self.spark, self.path)
        self.buckets = now["buckets"]
        return {r.bucket: (r.folder, r.n) for r in self.spark.read.schema(_PARTS).json(now["version"]).collect()}

    def _save(self, rows: DataFrame, touched: set[int], kept: dict[int, tuple[str, int]]) -> Collection:
        """rows are all of the touched buckets; kept are the others."""
        version = f"{self.path}/v-{uuid.uuid4().hex}"
        if touched:
            rows.withColumn("bucket", self._bucket()).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(version)
        written = {r.bucket: r["count"] for r in self.spark.read.parquet(version).groupBy("bucket").count().collect()} if touched and self._has_files(version) else {}
        parts = kept | {b: (f"{version}/bucket={b}", n) for b, n in written.items()}
        largest, total = max((n for _, n in parts.values()), default=0), sum(n for _, n in parts.values())
        if largest > self.most and -(-2 * total // self.most) > self.buckets:
            whole = self.spark.read.schema(SCHEMA).parquet(*(f for f, _ in parts.values()))
            self.buckets = -(-2 * total // self.most)
            return self._save(whole, set(range(self.buckets)), {})
        return self._point(sorted((b, f, n) for b, (f, n) in parts.items()))

    def _has_files(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return any(s.getPath().getName().startswith("bucket=") for s in files.listStatus(path))

    def rows(self, buckets: set[int] | None = None) -> DataFrame:
        return self._read(self._parts(), buckets)

    def _read(self, parts: dict[int, tuple[str, int]], buckets: set[int] | None = None) -> DataFrame:
        folders = [f for b, (f, _) in sorted(parts.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def upsert(self, new: DataFrame) -> Collection:
        """Add rows; an id that is there is replaced; of several rows with one id the latest wins. Wrong dimensions are refused."""
        if new.where(F.size("embedding") != self.dimension).limit(1).count():
            raise ValueError(f"vectors must have {self.dimension} places")
        last = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc_nulls_last("document"))
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        new = new.select(*names).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        parts = self._parts()
        touched = {r[0] for r in new.select(self._bucket()).distinct().collect()}
        own = self._read(parts, touched).join(new.select("id"), "id", "left_anti").select(*names).unionByName(new)
        return self._save(own, touched, {b: x for b, x in parts.items() if b not in touched})

    def delete(self, condition: Column) -> Collection:
        hit = F.coalesce(condition, F.lit(False))
        parts = self._parts()
        touched = {r[0] for r in self._read(parts).where(hit).select(self._bucket()).distinct().collect()}
        return self._save(self._read(parts, touched).where(~hit), touched, {b: x for b, x in parts.items() if b not in touched})

    def get(self, ids: list[str]) -> DataFrame:
        return self.rows().where(F.col("id").isin(ids))

    def count(self, where: Column | None = None) -> int:
        return (self.rows() if where is None else self.rows().where(where)).count()

    def info(self) -> dict:
        """dimension, metric, buckets, count and the time of the last write."""
        now = pointer(self.spark, self.path)[1]
        return {"dimension": now["dimension"], "metric": now["metric"], "buckets": now["buckets"], "updated_at": datetime.fromisoformat(now["moved"]), "count": self.count()}

    def search(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """(query_id, id, score, rank); the condition holds before the k best are taken."""
        return vector_scores(queries, self.rows(), self.metric, where, "id", "embedding", k=k)


def _pointers(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointers")
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number and content of a collection's current pointer."""
    at, files = _pointers(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)]
    name = max(n for n in names if n[0].isdigit())
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(at, name))
    try:
        return int(name), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def add_pointer(spark: SparkSession, path: str, number: int, text: str) -> None:
    """Writes a pointer beside its name and renames it, which fails if the number is taken."""
    fs = spark._jvm.org.apache.hadoop.fs
    at, files = _pointers(spark, path)
    files.mkdirs(at)
    beside, name = fs.Path(at, f"_{uuid.uuid4().hex}"), fs.Path(at, f"{number:012d}")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    plain = spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    plain[0] = getattr(fs, "Options$Rename").NONE
    try:
        fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(beside), files.makeQualified(name), plain)
    except Exception as e:
        if files.exists(name):
            files.delete(beside, False)
            raise RuntimeError(f"another write made version {number} first") from e
        raise


@dataclass
class Store:
    """Collections by name, in namespaces: a folder for each."""

    spark: SparkSession
    path: str

    def _folder(self, name: str, namespace: str) -> str:
        if "/" in name + namespace or not name or not namespace:
            raise ValueError("names are one part of a path")
        return f"{self.path}/{namespace}/{name}"

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def create(self, name: str, dimension: int, metric: str = "cosine", namespace: str = "default", buckets: int = 16) -> Collection:
        if self.exists(name, namespace):
            raise ValueError(f"{name} is there already")
        return Collection(self.spark, self._folder(name, namespace), dimension, metric, buckets).create()

    def open(self, name: str, namespace: str = "default") -> Collection:
        now = pointer(self.spark, self._folder(name, namespace))[1]
        return Collection(self.spark, self._folder(name, namespace), now["dimension"], now["metric"], now["buckets"])

    def exists(self, name: str, namespace: str = "default") -> bool:
        at, files = self._files(f"{self._folder(name, namespace)}/pointers")
        return files.exists(at)

    def list(self, namespace: str = "default") -> list[str]:
        at, files = self._files(f"{self.path}/{namespace}")
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def drop(self, name: str, namespace: str = "default") -> bool:
        """Whether there was such a collection; its files go."""
        at, files = self._files(self._folder(name, namespace))
        return files.delete(at, True)


def migrate(source: DataFrame, target: DataFrame, skip_existing: bool = True, vector: Column | None = None, metadata: Column | None = None, new_id: Column | None = None, where: Column | None = None) -> DataFrame:
    """Rows of source as they go into target: filtered, transformed, without ids that target has."""
    rows = source if where is None else source.where(where)
    for name, c in (("embedding", vector), ("metadata", metadata), ("id", new_id)):
        rows = rows if c is None else rows.withColumn(name, c)
    return rows.join(target.select("id"), "id", "left_anti") if skip_existing else rows
