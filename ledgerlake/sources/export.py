"""CSV export as a data source writer: one file with header and CRLF line ends for each user, whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .statements import HEADER, export_lines

FORMAT = "ledgerlake_user_csv"


@dataclass
class Folder(WriterCommitMessage):
    """What a task leaves: the folder it wrote, if it had rows."""

    name: str | None


class UserFiles(DataSource):
    """Rows (user_id, line) in order of user_id as files `user_id=<id>.csv`; option path: the target folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return UserFileWriter(self.options["path"], overwrite)


class UserFileWriter(DataSourceArrowWriter):
    """Tasks write to a staging folder; the commit moves their folders to the target, one move a task. What a
    failed or repeated task left behind is in the staging folder only, and goes with it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f"{path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Folder:
        files, root = FileSystem.from_uri(self.staging)
        own, out, user, seen = f"part-{uuid.uuid4().hex}", None, None, False
        try:
            for batch in iterator:
                for key, line in zip(batch.column("user_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                    if out is None or key != user:
                        if out is not None:
                            out.close()
                        if not seen:
                            files.create_dir(f"{root}/{own}", recursive=True)
                        out, user, seen = files.open_output_stream(f"{root}/{own}/user_id={key}.csv"), key, True
                        out.write(f"{HEADER}\r\n".encode())
                    out.write(f"{line}\r\n".encode())
        finally:
            if out is not None:
                out.close()
        return Folder(own if seen else None)

    def commit(self, messages: list[Folder | None]) -> None:
        files, root = FileSystem.from_uri(self.path)
        staging = FileSystem.from_uri(self.staging)[1]
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(FileSelector(root)):
                if old.base_name.startswith("part-"):
                    files.delete_dir(old.path)
        for m in messages:
            if m is not None and m.name is not None:
                files.move(f"{staging}/{m.name}", f"{root}/{m.name}")
        self._clear()
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Folder | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, staging = FileSystem.from_uri(self.staging)
        if files.get_file_info(staging).is_file or files.get_file_info(staging).type.name == "Directory":
            files.delete_dir(staging)


def write_export(ledger: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The ledger as files for each user under path, latest entries first. A user's file is one task's work, line by
    line. mode: overwrite (what was exported there goes when the new files are whole) or append."""
    ledger.sparkSession.dataSource.register(UserFiles)
    lines = export_lines(ledger).where("user_id IS NOT NULL").repartition("user_id").sortWithinPartitions("user_id", "date", "id", ascending=[True, False, True])
    lines.select("user_id", "line").write.format(FORMAT).mode(mode).option("path", path).save()


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """file and the columns of the header, as strings; quoted line ends and doubled quotes come back."""
    columns = ", ".join(f"{c} string" for c in HEADER.split(","))
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\r\n").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).schema(columns).csv(path)
    return rows.selectExpr("_metadata.file_path AS file", "*")
