"""Running streams to their end: results and progress are files in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder stands in for it in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="ledgerlake-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return _local[0]


def place(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark)}/ledgerlake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder, and read from there."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB (on disk, beyond the heap); the session's own setting
    comes back afterwards, a running query keeps what it started with."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there of the stream to the files under path. A restart goes on after the last batch that
    ended; the file sink lists each batch's files once."""
    with large_state(stream.sparkSession):
        running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()


def drained(stream: DataFrame, name: str = "drained", mode: str = "append") -> DataFrame:
    """What a stream gives when all that is there has run: its rows in append mode, or the last state in
    complete mode (each batch overwrites the one before)."""
    spark = stream.sparkSession
    path, checkpoint = place(spark, name), place(spark, f"{name}-checkpoint")
    if mode == "append":
        run_to_end(stream, path, checkpoint)
    else:
        foreach_batch(stream, lambda batch, _: batch.write.mode("overwrite").parquet(path), checkpoint, mode)
    return spark.read.schema(stream.schema).parquet(path)


def foreach_batch(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """each(rows, number) for all micro-batches that are there; a batch may come again with the same number."""
    with large_state(stream.sparkSession):
        running = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
