"""The chunk index as versioned tables: upsert, orphans, snapshots, restore, state.

A table is a folder of versions and of numbered pointer files; the one with the
highest number names the current version.  A version is written whole, then its
pointer is made, which fails if another writer has made that number first.  No
pointer is ever replaced, so there is no moment without a current version.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: snapshots that stay.
KEEP = 3


# --- Set operations on chunk tables


def upsert(current: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    return current.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_outcome(fresh: DataFrame, dims: int | None = None, key: str = "id") -> DataFrame:
    """One row: how many chunks can be written and how many fail for a missing key or a vector of another size."""
    good = F.col(key).isNotNull()
    if dims and "vector" in fresh.columns:
        good = good & (F.col("vector").isNull() | (F.size("vector") == dims))
    return fresh.agg(F.count_if(good).alias("n_ok"), F.count_if(~good).alias("n_failed"))


def orphans(existing: DataFrame, stale: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Chunk ids of stale documents (``stale(key)``, upper case) that the run did not upload again."""
    of_stale = existing.where("document_id is not null").join(stale.select("key"), F.upper("document_id") == F.col("key"), "left_semi")
    return of_stale.select("id").join(uploaded.select("id"), "id", "left_anti")


def delete(current: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return current.join(gone.select(key), key, "left_anti")


def chunks_of(existing: DataFrame, documents: DataFrame) -> DataFrame:
    return existing.join(documents.select("document_id"), "document_id", "left_semi").select("id")


def snapshot_merge(previous: DataFrame, stale: DataFrame, fresh: DataFrame) -> DataFrame:
    """What stays of the last snapshot, and the new chunks."""
    kept = previous.join(stale.select("key"), F.upper("document_id") == F.col("key"), "left_anti")
    return kept.unionByName(fresh)


def prune(snapshots: DataFrame, keep: int = KEEP) -> DataFrame:
    """``snapshots(path, written)`` with ``kept``: the newest stay."""
    rank = F.row_number().over(Window.orderBy(F.desc("written"), F.desc("path")))  # one row for each snapshot
    return snapshots.withColumn("kept", rank <= keep)


def evict(cache: DataFrame, live: DataFrame) -> DataFrame:
    """The cache without the rows that no live chunk needs."""
    return cache.join(live.select("content_hash").distinct(), "content_hash", "left_semi")


def evicted(cache: DataFrame, live: DataFrame) -> DataFrame:
    """Cache rows that no live chunk needs."""
    return cache.join(live.select("content_hash").distinct(), "content_hash", "left_anti")


def restore(snapshot: DataFrame, cache: DataFrame) -> DataFrame:
    """Snapshot rows with their vectors; a missing vector stays null and the row is kept."""
    vectors = cache.groupBy("content_hash").agg(F.max("vector").alias("vector"))  # the same one at every run
    return snapshot.join(vectors, "content_hash", "left").withColumn("missing", F.col("vector").isNull())


# --- Versioned tables


def _number(pointer: str) -> int:
    return int(pointer.removeprefix("current-").removesuffix(".json"))


class Table:
    """One versioned table; ``root`` may be on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        """Names in the folder, the newest first; a folder that is not there is empty, any other failure is raised."""
        root = self._jvm.org.apache.hadoop.fs.Path(self.root)
        if not self._fs.exists(root):
            return []
        return sorted((n for n in (s.getPath().getName() for s in self._fs.listStatus(root)) if n.startswith(prefix)), reverse=True)

    def _content(self, name: str) -> dict | None:
        """A pointer's content; one that a writer did not finish is none."""
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def state(self) -> dict | None:
        """Version, schema and number of the current pointer; none only where the table has no finished one."""
        return self._newest(self._names("current-"))

    def _newest(self, names: list[str]) -> dict | None:
        for name in names:
            found = self._content(name)
            if found is not None:
                return found | {"number": _number(name)}
        return None

    def ensure(self, schema: StructType) -> None:
        if self.state() is None:
            self.write(self.spark.createDataFrame([], schema))

    def recreate(self, schema: StructType) -> None:
        """An empty current version, whatever there was."""
        self.write(self.spark.createDataFrame([], schema))

    def read(self) -> DataFrame | None:
        state = self.state()
        return None if state is None else self.spark.read.schema(StructType.fromJson(state["schema"])).parquet(f"{self.root}/{state['version']}")

    def write(self, rows: DataFrame, expected: str | None | bool = False) -> bool:
        """Make ``rows`` the current version; with ``expected`` only if that is the current one still, else false."""
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{version}")
        content = bytearray(json.dumps({"version": version, "schema": json.loads(rows.schema.json())}).encode())
        while True:
            names = self._names("current-")
            if expected is not False and (self._newest(names) or {}).get("version") != expected:
                self._fs.delete(self._path(version), True)
                return False
            number = 1 + max(map(_number, names[:1]), default=0)  # after an unfinished one, too
            try:
                stream = self._fs.create(self._path(f"current-{number:012d}.json"), False)
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                    raise
                continue  # another writer was first: look again
            stream.write(content)
            stream.close()
            return True

    def drop(self) -> None:
        """The table and all its versions go: what one stage handed to the next has been read."""
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(self.root), True)

    def versions(self) -> list[tuple[str, int]]:
        found = [s for s in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.root)) if s.getPath().getName().startswith("v-")]
        return sorted(((s.getPath().getName(), s.getModificationTime()) for s in found), key=lambda v: -v[1])

    def prune(self, keep: int = KEEP) -> int:
        current = (self.state() or {}).get("version")
        gone = [name for name, _ in self.versions()[keep:] if name != current]
        for name in self._names("current-")[keep:]:
            if (self._content(name) or {}).get("version") != current:
                self._fs.delete(self._path(name), False)
        for name in gone:
            self._fs.delete(self._path(name), True)
        return len(gone)

    def statistics(self) -> tuple[int, int]:
        """Rows and bytes of the current version."""
        rows, state = self.read(), self.state()
        return (0, 0) if rows is None else (rows.count(), self._fs.getContentSummary(self._path(state["version"])).getLength())
