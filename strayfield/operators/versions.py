"""A keyed store in hash buckets, kept in versions: a batch rewrites the buckets of its own keys and leaves all others where they are.

``folder/data/<write>/_bucket=B`` holds the rows of a bucket as one write left them; ``folder/manifests/v=N`` says for version N in which write each
bucket lies. Data are written first and a manifest last, so a version is whole or isn't there; what a failed write leaves is in no manifest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import upsert

MANIFEST = "bucket int, data string, outer int, inner int"


@dataclass(frozen=True)
class Store:
    """Rows with a unique ``key`` and the columns ``created_at`` and ``absent_count``, as ``upsert`` takes them.

    The ``group`` of a row (its source) picks one of ``outer`` ranges of buckets, its key one of ``inner`` buckets of that range. So the batch of one
    group touches ``inner`` buckets at most, and a large group still has that many tasks. A folder keeps the numbers it was begun with: choose ``inner``
    so that a bucket of the largest group fits a task. Bucket lists, of at most outer * inner numbers, are all that the driver sees.
    """

    spark: SparkSession
    folder: str
    schema: StructType | str
    key: str = "key"
    group: str = "source_name"
    outer: int = 16
    inner: int = 16

    def bucket(self) -> Column:
        """Null where the key is null; a null group is a group."""
        place = F.pmod(F.xxhash64(self.group), F.lit(self.outer)) * self.inner + F.pmod(F.xxhash64(F.lit("key"), F.col(self.key)), F.lit(self.inner))
        return F.when(F.col(self.key).isNotNull(), place.cast("int"))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys. Rows without a key have no place in a store: an error, so that none is lost unseen."""
        found = [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]
        if None in found:
            raise ValueError(f"rows without {self.key} can't be stored")
        return sorted(found)

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _whole(self, version: int) -> bool:
        path, fs = self._path("manifests", f"v={version}", "_SUCCESS")
        return fs.exists(path)

    def versions(self) -> list[int]:
        """The versions that are whole, oldest first. Version 0, the empty store, is never written."""
        return [v for v in sorted(int(n.removeprefix("v=")) for n in self._children("manifests") if n.startswith("v=")) if self._whole(v)]

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict[int, str]:
        """For each bucket that has rows the write that holds them."""
        if version == 0:
            return {}
        if not self._whole(version):
            raise ValueError(f"there is no version {version} in {self.folder}")
        found = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/v={version}").collect()
        if any((r.outer, r.inner) != (self.outer, self.inner) for r in found):
            raise ValueError(f"{self.folder} was begun with {found[0].outer} x {found[0].inner} buckets")
        return {r.bucket: r.data for r in found}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, by default the latest; of ``buckets`` alone where they are given, so that no other file is opened."""
        held = self.manifest(self.latest() if version is None else version)
        paths = [f"{self.folder}/data/{w}/_bucket={b}" for b, w in sorted(held.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, rows: DataFrame, version: int, buckets: list[int] | None = None) -> list[int]:
        """Make ``version`` from the one before it and ``rows``, one for each key; the buckets rewritten. A version that is whole stays as it is: a retry
        changes nothing. ``buckets``, where the caller knows them, are those of ``touched(rows)``."""
        if self._whole(version):
            return []
        held = self.manifest(version - 1)
        buckets = self.touched(rows) if buckets is None else buckets
        if buckets:
            write = uuid.uuid4().hex
            old = self.read(version - 1, buckets)
            merged = upsert(old, rows.select(old.columns), self.key).select(old.columns).withColumn("_bucket", self.bucket())
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/data/{write}")
            held = held | dict.fromkeys(buckets, write)
        lines = [(b, w, self.outer, self.inner) for b, w in sorted(held.items())]
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/v={version}")
        return buckets

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions, and the buckets that none of those needs; how many buckets went. Not to be run beside a writer."""
        if keep < 1:
            raise ValueError("at least one version must stay")
        kept = self.versions()[-keep:]
        needed = {(w, b) for v in kept for b, w in self.manifest(v).items()}
        for name in self._children("manifests"):
            if name.startswith("v=") and int(name.removeprefix("v=")) not in kept:
                path, fs = self._path("manifests", name)
                fs.delete(path, True)
        gone = 0
        for write in self._children("data"):
            here = [n for n in self._children(f"data/{write}") if n.startswith("_bucket=")]
            idle = [n for n in here if (write, int(n.removeprefix("_bucket="))) not in needed]
            for parts in [(write,)] if len(idle) == len(here) else [(write, n) for n in idle]:
                path, fs = self._path("data", *parts)
                fs.delete(path, True)
            gone += len(idle)
        return gone
