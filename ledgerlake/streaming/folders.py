"""Tables in numbered folders, by bucket of users: each change is a folder of its own that counts once it is whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .run import delete

#: Buckets of users, and folders from which they are written together anew.
BUCKETS, MANY = 256, 16
_WHOLE = "all"


def bucket_of(user: str = "user_id") -> Column:
    return F.pmod(F.xxhash64(F.col(user)), F.lit(BUCKETS)).cast("int")


class Folders:
    """Changes of a table under path, in order. With `newest` a folder replaces the buckets that it holds (so a
    state), else folders add up (so a history). A label is written once: a repeat of a change is left out.

    A folder holds a row without `user_id` for each bucket it stands for, so an emptied bucket replaces an
    older one too. Rows need a user_id. Whoever writes must be alone, as a streaming query is.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, newest: bool):
        self.spark, self.path, self.newest = spark, path, newest
        self.schema = T.StructType([f for f in schema.fields if f.name != "bucket"])
        self._stored = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])

    def _names(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def done(self) -> list[tuple[int, str]]:
        """Number and label of the whole folders that count, in order."""
        found = sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in self._names(self.path) if n[:1].isdigit())
        found = [x for x in found if "_SUCCESS" in self._names(self._folder(*x))]
        since = max((n for n, label in found if label == _WHOLE), default=-1)
        return [x for x in found if x[0] > since or x == (since, _WHOLE)]

    def has(self, label: str) -> bool:
        return any(x == label for _, x in self.done())

    def _folder(self, number: int, label: str) -> str:
        return f"{self.path}/{number:09d}-{label}"

    def part(self, label: str) -> DataFrame:
        """The rows of one change."""
        (number,) = (n for n, x in self.done() if x == label)
        return self._read(self._folder(number, label)).where("user_id IS NOT NULL").select(*self.schema.names)

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(folder)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table as it is now, or what some buckets hold of it; only their files are read."""
        wanted = set(range(BUCKETS) if buckets is None else buckets)
        out = self.spark.createDataFrame([], self.schema)
        for number, label in reversed(self.done()):
            folder = self._folder(number, label)
            here = {int(n.split("=")[1]) for n in self._names(folder) if n.startswith("bucket=")} & wanted
            if here:
                out = out.unionByName(self._read(folder).where(F.col("bucket").isin(sorted(here)) & F.col("user_id").isNotNull()).select(*self.schema.names))
            if self.newest:
                wanted -= here
        return out

    def write(self, rows: DataFrame, label: str, buckets: list[int] | None = None) -> None:
        """One change. buckets: those it stands for (for a state), else those that its rows are in."""
        if self.has(label):
            return
        self._put(rows, max((n for n, _ in self.done()), default=-1) + 1, label, buckets)
        if len(self.done()) > MANY:
            self.compact()

    def _put(self, rows: DataFrame, number: int, label: str, buckets: list[int] | None) -> None:
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], bucket_of().alias("bucket"))
        if buckets:
            heads = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
            rows = rows.unionByName(heads, allowMissingColumns=True)
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self._folder(number, label))

    def compact(self) -> None:
        """All but the newest folder (which may be asked to repeat) become one; the old ones go after that."""
        *old, last = self.done()
        if len(old) < 2:
            return
        held = Folders(self.spark, self.path, self.schema, self.newest)
        held.done = lambda: old  # type: ignore[method-assign]
        number = old[-1][0]
        self._put(held.read(), number, _WHOLE, list(range(BUCKETS)) if self.newest else None)
        for n, label in old:
            if (n, label) != (number, _WHOLE):
                delete(self.spark, self._folder(n, label))
