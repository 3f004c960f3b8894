"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java pattern of a word: a run of anything but space and the ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A broadcast side has at most this many bytes in its columns, by its counted rows; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Bytes of a value of the types that have a fixed width.
_WIDTH = {"boolean": 1, "integer": 4, "long": 8, "double": 8}

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local one is made only in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="ledgerlake-"))
        atexit.register(shutil.rmtree, _local_dir[0], True)
    return _local_dir[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and makes row ids stable."""
    path = f"{shared_dir(df.sparkSession)}/ledgerlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing still to be computed reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Free memory goes back to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_held: dict[object, object] = {}


def held(key: object, build: Callable[[], object]) -> object:
    """In a Python worker: what build() gives, kept until another key is asked for or a task ends (see
    releasing). So a worker that serves one operator after another holds the tables and caches of one only."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; after the last one the worker keeps nothing, as it may idle beside other work."""
    yield from batches
    _held.clear()
    give_back()


def blocks(column: pa.Array, most: int) -> Iterator[tuple[int, list]]:
    """The values of a column in runs of at most `most` bytes (or of one value), with each run's first row."""
    at, run, total = 0, [], 0
    for i, value in enumerate(column):
        x = value.as_py()
        if run and total + len(x) > most:
            yield at, run
            at, run, total = i, [], 0
        run.append(x)
        total += len(x)
    if run:
        yield at, run


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table; one in fewer partitions than there are cores is dealt out over them."""
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns or "*")
    cores = spark.sparkContext.defaultParallelism
    return read.repartition(cores) if read.rdd.getNumPartitions() < cores else read


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sized(df: DataFrame, rows: int, **known: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are known to fit BROADCAST_BYTES, else as it is (the join
    then shuffles). known: bytes of a column without a fixed width; others of that kind are never broadcast."""
    widths = [known.get(f.name, _WIDTH.get(f.dataType.typeName())) for f in df.schema.fields]
    return F.broadcast(df) if None not in widths and rows * sum(widths) <= BROADCAST_BYTES else df


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, rows: int | None = None, **known: int) -> DataFrame:
    """Left outer join on one key column; right has one row for each key and `weight`, the key's rows in left
    (so the weights add up to `total`, left's rows, at most). rows: right's, if counted; known: see sized.

    A right side of known small size is broadcast. Else keys with over 1/1000 of the rows (so at most 1000
    keys) are broadcast; the other keys shuffle, and left rows of heavy or null keys are dealt by a salt
    there, so no task gets more than a small share. Columns _h, _k, _s and those that begin with _h_ are
    taken.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    small = right.select(key, *values)
    if rows is not None and (hinted := sized(small, rows, **known)) is not small:
        return left.join(hinted, key, "left").select(*left.columns, *values)
    heavy = F.col(weight) > max(1, total // 1000)
    strong = right.where(heavy).select(key, *[F.col(c).alias(f"_h_{c}") for c in values], F.lit(True).alias("_h"))
    weak = right.where(~heavy).select(F.col(key).alias("_k"), F.lit(0).alias("_s"), *values)
    marked = left.join(F.broadcast(strong), key, "left")
    away = F.col("_h").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn("_s", F.when(away, 1 + F.pmod(F.xxhash64(*left.columns), F.lit(1 << 20)).cast("int")).otherwise(0))
    joined = marked.join(weak, (F.col(key) == F.col("_k")) & (marked["_s"] == weak["_s"]), "left")
    return joined.select(*[F.col(c) for c in left.columns], *[F.coalesce(F.col(f"_h_{c}"), F.col(c)).alias(c) for c in values])


def text_of(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


LONG, INT, DOUBLE, BOOL, STRING, BINARY = T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.BinaryType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
