"""Shared helpers: tables in the shared folder, Arrow batch slicing, reading inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker looks at together; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir or '.'}/{name}.parquet")
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many partitions as there are cores, if they are in fewer (a file of one row group is one task)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where a local session names none (runs and tests on one machine) is one made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusflow-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, key: str, number: str) -> DataFrame:
    """``docs`` (written) with a number for each row in column ``number``, in the order of ``key`` (nulls last) and then of the text.

    If ``key`` has no nulls or repeats it is the number itself and nothing is written.
    """
    spare = docs.select(F.col(key).cast("long").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    if spare.where("k is null or n > 1").isEmpty():
        return docs.withColumn(number, F.col(key).cast("long"))
    order = [F.col(key).cast("long").asc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit("")))]
    parts = shuffle_partitions(docs.sparkSession)
    return materialize(docs.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id()), "numbered")


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getParent().getName() == "corpusflow":
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` text bytes; whole texts only."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        stop = int(np.searchsorted(ends, base + most, side="right"))
        stop = min(max(stop, begin + 1), begin + SLICE_ROWS)
        yield batch.slice(begin, stop - begin)
        begin = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
