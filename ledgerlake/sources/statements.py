"""Bank statements: CSV files of any known layout, parsed to rows with an error column."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..functions import vocabulary as V
from ..operators.balance import reconstruct

#: Larger files are refused, so a file fits a task.
MOST_BYTES = 5 << 20

#: Records of an Arrow batch.
ROWS = 5000
RAW = "file string, row_number int, headers array<string>, cells map<string,string>"


def blank(record: list[str]) -> bool:
    return not record or (len(record) == 1 and not record[0].strip())


def split_records(name: str, content: bytes) -> Iterator[tuple[str, int, list[str], dict[str, str | None]]]:
    """Records of one file; the first is the header. Numbers start at 2 and count records, not lines; blank
    lines are skipped, short records lack cells, extra cells are left out."""
    header: list[str] | None = None
    number = 1
    for record in csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"))):
        if blank(record):
            continue
        if header is None:
            header = [h.strip() for h in record]
            continue
        number += 1
        cells = {h: (v.strip() or None) for h, v in zip(header, record, strict=False)}
        yield name, number, header, cells


def record_batches(name: str, header: list[str], number: int, records: Iterable[list[str]]) -> Iterator[pa.RecordBatch]:
    """The records of a file, numbered from `number` on, as batches of RAW, built column by column. Of headers
    that are alike the last one's cell counts, as in split_records."""
    records, width, alike = iter(records), len(header), len(set(header)) < len(header)
    while some := list(islice(records, ROWS)):
        if alike:
            made = [{h: v.strip() or None for h, v in zip(header, r, strict=False)} for r in some]
            keys, values, sizes = [h for d in made for h in d], [v for d in made for v in d.values()], [len(d) for d in made]
        else:
            sizes = [min(len(r), width) for r in some]
            values = [v.strip() or None for r in some for v in r[:width]]
            keys = header * len(some) if min(sizes) == width else [h for n in sizes for h in header[:n]]
        n, ends = len(some), np.concatenate([[0], np.cumsum(sizes)])
        cells = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
        headers = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(header * n, pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(number, number + n), pa.int32()), headers, cells], names=["file", "row_number", "headers", "cells"])
        number += n


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """file, row_number, headers, cells of every record of the CSV files under path, one task for some files.
    Empty, larger than 5 MB and other than .csv files give one row without headers, which parse_statements
    turns into an error."""
    return records_of(spark.read.format("binaryFile").load(path))


def records_of(found: DataFrame) -> DataFrame:
    """The same of files that are at hand (path, length, content)."""
    fits = (F.col("length") > 0) & (F.col("length") <= MOST_BYTES) & F.lower("path").endswith(".csv")
    files = found.where(fits)
    refused = found.where(~fits).select(F.col("path").alias("file"), F.lit(0).alias("row_number"), F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("map<string,string>").alias("cells"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                found = (r for r in csv.reader(io.StringIO(content.as_py().decode("utf-8-sig", "replace"))) if not blank(r))
                header = next(found, None)
                if header is not None:
                    yield from record_batches(name.as_py(), [h.strip() for h in header], 2, found)

    return files.select("path", "content").mapInArrow(records, RAW).unionByName(refused)


#: The role of each spelling of a header.
ROLES = {s: r for r, spellings in V.HEADERS.items() for s in spellings} | {"merchant": "merchant"}


def header_of(role: str) -> Column:
    """The first header that is a spelling of the role, or null; _roles: the headers' roles."""
    return F.get("headers", F.array_position("_roles", role).cast("int") - 1)


def layout() -> Column:
    """EXPLICIT_AMOUNT if there is an amount, debit or credit column, BALANCE_ONLY with date, description and
    balance, else UNKNOWN."""
    has = {r: F.col(f"_is_{r}").isNotNull() for r in V.HEADERS}
    return F.when(has["amount"] | has["debit"] | has["credit"], "EXPLICIT_AMOUNT").when(has["date"] & has["description"] & has["balance"], "BALANCE_ONLY").otherwise("UNKNOWN")


def with_cells(raw: DataFrame) -> DataFrame:
    """raw with layout and a string column for each role, and merchant if there is such a header."""
    roles = [*V.HEADERS, "merchant"]
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    rows = raw.withColumn("_roles", F.transform("headers", lambda h: F.try_element_at(known, F.lower(text.trimmed(h))))).withColumns({f"_is_{r}": header_of(r) for r in roles})
    cell = lambda r: F.when(F.col(f"_is_{r}").isNotNull(), F.try_element_at("cells", F.col(f"_is_{r}")))
    return rows.withColumns({f"_{r}": cell(r) for r in roles} | {"layout": layout()}).drop("_roles", *[f"_is_{r}" for r in roles])


def parse_statements(raw: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """file, row_number, layout, date, description, amount, is_debit, merchant, raw_text, confidence, error.

    Rows with an error have it in words and no amount; rows of balance-only files get their amounts from
    the change of balance. A file with unknown layout gives one error row.

    Each layout has a branch of its own over the records' cells. keep stores them (persisted, or as files), so
    that the three branches do not read and split the files three times.
    """
    rows = with_cells(raw).withColumn("raw_text", F.to_json("cells")).drop("headers", "cells")
    rows = keep(rows).withColumn("date", parsing.parse_date(F.col("_date")))
    money = {r: F.col(f"_{r}_money") for r in ("amount", "debit", "credit", "balance")}
    rows = rows.withColumns({f"_{r}_money": parsing.parse_money(F.col(f"_{r}")) for r in money})
    bad = [F.when(F.col(f"_{r}").isNotNull() & money[r].isNull() & parsing.bad_money(F.col(f"_{r}")), F.lit(f"invalid {r}")) for r in ("debit", "credit", "amount")]
    explicit = rows.where("layout = 'EXPLICIT_AMOUNT'").withColumn("_r", parsing.resolve_amount(money["amount"], money["debit"], money["credit"], F.col("_type")))
    what = F.coalesce(F.when(F.col("date").isNull(), F.lit("invalid date")), *bad, F.when(F.col("_r").isNull(), F.lit("No amount")))
    error = F.when(what.isNotNull(), F.concat(F.lit("Row "), F.col("row_number"), F.lit(": "), what))
    keep = ["file", "row_number", "layout", "date", F.coalesce("_description", F.lit("")).alias("description")]
    tail = [F.col("_merchant").alias("merchant"), "raw_text"]
    one = F.lit(1).cast("decimal(5,4)")
    out = explicit.select(*keep, F.when(error.isNull(), F.col("_r.amount")).alias("amount"), F.when(error.isNull(), F.col("_r.is_debit")).alias("is_debit"), *tail, one.alias("confidence"), error.alias("error"))
    balances = rows.where("layout = 'BALANCE_ONLY'").select(*keep, money["balance"].alias("balance"), *tail)
    changed = reconstruct(balances, ["file"])
    changed = changed.where("kind IN ('TRANSACTION', 'MISSING')")
    missing = F.when(F.col("kind") == "MISSING", F.concat(F.lit("Row "), F.col("row_number"), F.lit(": missing date or balance")))
    out = out.unionByName(changed.select("file", "row_number", "layout", "date", "description", "amount", "is_debit", "merchant", "raw_text", "confidence", missing.alias("error")))
    unknown = rows.where("layout = 'UNKNOWN'").groupBy("file").agg(F.min("row_number").alias("row_number"))
    nothing = {"date": "date", "description": "string", "amount": "decimal(19,4)", "is_debit": "boolean", "merchant": "string", "raw_text": "string", "confidence": "decimal(5,4)"}
    unknown = unknown.select("file", "row_number", F.lit("UNKNOWN").alias("layout"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.when(F.col("row_number") == 0, "empty, too large or not a CSV file").otherwise("unknown statement layout").alias("error"))
    return out.unionByName(unknown)


def to_ledger(parsed: DataFrame, user_id: Column, currency: Column | None = None) -> DataFrame:
    """Ledger rows of parsed ones without error: cleaned, merchant extracted if not given, categorised."""
    return ledger_rows(parsed.where("error IS NULL"), user_id, currency)


def ledger_rows(parsed: DataFrame, user_id: Column, currency: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """The same of all rows, those with an error included, with more of their columns."""
    cleaned = text.clean_description(F.col("description"))
    rows = parsed.withColumn("merchant", F.coalesce(F.when(text.trimmed(F.col("merchant")) != "", F.col("merchant")), text.merchant_of(F.col("description"))))
    rows = text.with_category(rows.withColumn("description", cleaned).withColumnRenamed("confidence", "_c"))
    return rows.select(
        F.xxhash64("file", "row_number").alias("id"), user_id.cast("long").alias("user_id"), "amount", "date", "description", "merchant", "category",
        F.when(F.col("is_debit"), "DEBIT").otherwise("CREDIT").alias("type"), F.coalesce(F.upper(currency) if currency is not None else F.lit(None), F.lit("INR")).alias("currency"),
        F.least("confidence", "_c").alias("confidence"), "raw_text", F.lit("CSV").alias("source"), *also,
    )


def summary(parsed: DataFrame) -> DataFrame:
    """file, records, imported, skipped, first, last, total, errors of an import."""
    ok = F.col("error").isNull()
    return parsed.groupBy("file").agg(
        F.count("*").alias("records"), F.count(F.when(ok, 1)).alias("imported"), F.count(F.when(~ok, 1)).alias("skipped"), F.min(F.when(ok, F.col("date"))).alias("first"), F.max(F.when(ok, F.col("date"))).alias("last"),
        F.coalesce(F.sum(F.when(ok, F.col("amount"))), F.lit(0)).cast("decimal(29,4)").alias("total"),
        F.transform(F.sort_array(F.collect_list(F.when(~ok, F.struct("row_number", "error")))), lambda x: x["error"]).alias("errors"),
    )


def export_lines(ledger: DataFrame) -> DataFrame:
    """user_id, date, id, line: the CSV line of each entry, text that a spreadsheet would run as a formula quoted."""
    safe = lambda c: F.when(F.col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c))
    quoted = lambda c: F.when(c.rlike(r'[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    has = lambda c, other: F.col(c) if c in ledger.columns else F.lit(other)
    cells = [F.date_format("date", "yyyy-MM-dd"), safe("description"), safe("merchant"), F.col("category"), F.col("type"), F.col("amount").cast("string"), has("currency", "INR"), has("source", "CSV"), has("reviewed", "false").cast("string"), has("notes", "")]
    return ledger.select("user_id", "date", "id", F.concat_ws(",", *[quoted(c.cast("string")) for c in cells]).alias("line"))


HEADER = "date,description,merchant,category,type,amount,currency,source,reviewed,notes"
