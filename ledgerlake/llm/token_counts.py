"""Token counts by prefix dynamic programming.

For every text the operator stores how many tokens each of its prefixes has, as differences of one byte
a character, so questions of truncation and budget are answered by a running sum without encoding again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, releasing, text_of

#: Bytes of texts that are counted together.
BLOCK_BYTES = 4 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def prefix_token_counts(df: DataFrame, text: str = "text", path: str | None = None, out_prefix: str = "") -> DataFrame:
    """Add n_bytes, n_tokens, prefix_width and prefix_table to df's other columns; the text itself goes.

    prefix_table holds signed differences of prefix_width bytes (1, or 4 where one does not do), one for each
    character. Null and empty texts have 0 bytes, 0 tokens and an empty table. Strings of added tokens
    inside a text count as the library counts them by default: one token. Columns of df with the names of
    the results give way; repeated rows are counted each by itself. One pass, no shuffle.
    """
    path = path or default_vocabulary()
    names = [out_prefix + x for x in ("n_bytes", "n_tokens", "prefix_width", "prefix_table")]
    kept = [c for c in df.columns if c != text and c not in names]
    fields = [df.schema[c] for c in kept]
    out = T.StructType([*fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.IntegerType()), T.StructField(names[3], T.BinaryType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ledgerlake.llm.bpe import prefix_counts

        counter = prefix_counts(path)
        for whole in releasing(batches):
            for at, texts in blocks(whole.column(len(kept)), BLOCK_BYTES):
                batch = whole.slice(at, len(texts))
                sizes, tokens, widths, tables = [], [], [], []
                for x, d in zip(texts, counter.tables(texts), strict=True):
                    if d.dtype != np.int8:
                        d = d.astype(np.int8 if np.abs(d).max(initial=0) < 128 else np.int32)
                    sizes.append(len(x) if x.isascii() else len(x.encode()))
                    tokens.append(int(d.sum(dtype=np.int64)))
                    widths.append(d.dtype.itemsize)
                    tables.append(d.tobytes())
                made = [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(widths, pa.int32()), pa.array(tables, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, *names])

    return df.select(*[F.col(f"`{c}`") for c in kept], text_of(text).alias("_text")).mapInArrow(count, out)


def longest_prefix(counted: DataFrame, budget: int) -> DataFrame:
    """Add fits long: the characters of the longest prefix that has at most `budget` tokens."""
    fields = T.StructType([*counted.schema.fields, T.StructField("fits", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for width, stored in zip(batch.column("prefix_width"), batch.column("prefix_table"), strict=True):
                counts = np.cumsum(np.frombuffer(stored.as_py(), f"<i{width.as_py()}"), dtype=np.int64)
                good = np.flatnonzero(counts <= budget)
                fits.append(int(good[-1]) + 1 if len(good) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fits, pa.int64())], names=[*batch.schema.names, "fits"])

    return counted.mapInArrow(cut, fields)
