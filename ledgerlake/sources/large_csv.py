"""CSV files of any size in byte ranges: where records start follows from the quotes before a range.

A first pass counts the quotes of each range; their sum over the ranges before tells whether a range begins
within quotes. A second pass counts the records that start in each range, so that rows keep their numbers in
the file; then every range is parsed by itself, from its first record's start to the end of its last record. Files of one
range need neither pass.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .statements import RAW, blank, record_batches

RANGE_BYTES, BLOCK = 16 << 20, 1 << 20


def read_large_statements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, row_number, headers, cells of every record of the CSV files under path, as read_statements gives
    them, but for files of any size: a range of a file is one task's work.

    Quotes must stand as RFC 4180 has them (around whole fields, doubled within). The folder must be one that
    pyarrow.fs opens. Empty files and files with nothing but a header have no rows. A record is read by the task in
    whose range it starts, blockwise; it must fit a worker.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where(F.lower("path").endswith(".csv") & (F.col("length") > 0))
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = files.select("path", F.explode(starts).alias("at"), F.col("length").alias("size")).repartition(tasks, "path", "at")
    before = W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    deal = lambda df: df.repartition(tasks, "path", "at")

    def quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [_quotes(r["path"], r["at"], min(r["size"], r["at"] + range_bytes)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=["path", "at", "size", "n"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, headers = [], []
            for r in batch.to_pylist():
                records = _records(**r, step=range_bytes)
                first = next(records, None)
                n.append((first is not None) + sum(1 for _ in records))
                headers.append([h.strip() for h in first] if first is not None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(headers, pa.list_(pa.string()))], names=["path", "at", "size", "inside", "n", "header"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                base, header = r.pop("base"), r.pop("header")
                records = _records(**r, step=range_bytes)
                first = next(records, None) if base == 0 else None  # the header
                if header is None and first is not None:
                    header = [h.strip() for h in first]
                if header is not None:
                    yield from record_batches(r["path"], header, max(2, base + 1), records)

    # a file of one range starts outside quotes, at record 1
    single = ranges.where(F.col("size") <= range_bytes).select("path", "at", "size", F.lit(False).alias("inside"), F.lit(0).cast("long").alias("base"), F.lit(None).cast("array<string>").alias("header"))
    ranges = ranges.where(F.col("size") > range_bytes)
    counted = ranges.mapInArrow(quotes, "path string, at long, size long, n long")
    known = counted.select("path", "at", "size", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    numbered = deal(known).mapInArrow(counts, "path string, at long, size long, inside boolean, n long, header array<string>")
    header = F.first("header", True).over(W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    placed = numbered.select("path", "at", "size", "inside", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), header.alias("header"))
    return deal(placed.where("header IS NOT NULL").unionByName(single)).mapInArrow(cells, RAW)


def _open(path: str) -> pa.NativeFile:
    files, name = FileSystem.from_uri(path)
    return files.open_input_file(name)


def _quotes(path: str, at: int, stop: int) -> int:
    with _open(path) as f:
        return sum(f.read_at(min(BLOCK, stop - place), place).count(b'"') for place in range(at, stop, BLOCK))


def _line_ends(f: pa.NativeFile, begin: int, stop: int, inside: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Block by block where lines end outside quotes in [begin, stop)."""
    for place in range(begin, stop, BLOCK):
        data = np.frombuffer(f.read_at(min(BLOCK, stop - place), place), np.uint8)
        quoted = (np.cumsum(data == 34) + inside) % 2 == 1
        yield place, np.flatnonzero((data == 10) & ~quoted)
        inside = bool(quoted[-1]) if len(quoted) else inside


def _records(path: str, at: int, size: int, inside: bool, step: int) -> Iterator[list[str]]:
    """The records that start within a range, blank ones left out."""
    stop = min(size, at + step)
    with _open(path) as f:
        begin = at
        if at and (inside or f.read_at(1, at - 1) != b"\n"):
            begin = next((place + int(ends[0]) + 1 for place, ends in _line_ends(f, at, stop, inside) if len(ends)), stop)
        if begin >= stop:
            return

        def lines() -> Iterator[str]:
            rest, mark = b"", "utf-8-sig" if begin == 0 else "utf-8"
            for place in range(begin, size, BLOCK):
                *whole, rest = (rest + f.read_at(min(BLOCK, size - place), place)).split(b"\n")
                for x in whole:
                    yield (x + b"\n").decode(mark, "replace")
                    mark = "utf-8"
            if rest:
                yield rest.decode(mark, "replace")

        starts = 1 + sum(len(ends) for _, ends in _line_ends(f, begin, stop - 1, False))
        for record in islice(csv.reader(lines()), starts):
            if not blank(record):
                yield record
