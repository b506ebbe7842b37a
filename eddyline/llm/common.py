"""What the operators share: tables, the shared folder, bounded Arrow blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text that one block of a Python operator holds at most, unless one row alone has more.
BLOCK_BYTES = 4 << 20


#: Folders that this driver has made in the shared folder and not deleted.
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under the one that the cluster shares (spark.checkpoint.dir).

    Only where that is unset, as in tests on a local master, a temporary folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir() + "/eddyline-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that no later step reads."""
    if path in _made:
        _made.remove(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard_all(spark: SparkSession) -> None:
    """Delete all intermediate results of this driver: once the results that read them are stored or read."""
    for path in list(_made):
        discard(spark, path)


def blocks(batches: Iterable[pa.RecordBatch], column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named column holds about `limit` bytes a block."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(1, batch.column(column).nbytes)
        step = max(1, int(n * limit / size)) if size > limit else n
        for i in range(0, n, step):
            yield batch.slice(i, step)
