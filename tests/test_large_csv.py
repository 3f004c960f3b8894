"""CSV files cut into byte ranges against the parse of whole files."""

import os
import random

import pytest

from ledgerlake.sources import large_csv, statements


def texts(rng, n):
    """Records with commas, doubled quotes, line ends and blank lines within quotes; blank lines between."""
    cell = lambda: "".join(rng.choices(["a", "é", "日", ",", '""', "\n", "\r\n", " ", "\n\n", "x" * 30], k=rng.randint(0, 6)))
    out = ["﻿date, description,amount"]
    for k in range(n):
        out.append(rng.choices(["", "  ", f'2024-01-05,"{cell()}",{k}', f"2024-01-06,plain {k},{k},extra", f'"{cell()}",{k}', '""'], (1, 1, 9, 9, 3, 1))[0])
    return rng.choice(["\n", "\r\n"]).join(out) + rng.choice(["", "\n", "\n\n"])


def rows_of(df):
    return sorted((r.file.rsplit("/", 1)[1], r.row_number, tuple(r.headers), tuple(sorted(r.cells.items()))) for r in df.collect())


def whole(folder):
    out = []
    for name in os.listdir(folder):
        with open(f"{folder}/{name}", "rb") as f:
            out += [(n, number, tuple(h), tuple(sorted(c.items()))) for n, number, h, c in statements.split_records(name, f.read())]
    return sorted(out)


@pytest.mark.parametrize(("size", "block"), [(1, 1), (7, 3), (64, 1 << 20), (1000, 17)])
def test_ranges_hold_each_record_once(tmp_path, monkeypatch, size, block):
    monkeypatch.setattr(large_csv, "BLOCK", block)
    rng = random.Random(size)
    for k in range(6):
        path, data = f"{tmp_path}/{k}.csv", texts(rng, 25).encode()
        with open(path, "wb") as f:
            f.write(data)
        got, quotes = [], 0
        for at in range(0, len(data), size):
            got += list(large_csv._records(path, at, len(data), quotes % 2 == 1, size))
            quotes += large_csv._quotes(path, at, min(len(data), at + size))
        header, *records = got
        assert [{h.strip(): v.strip() or None for h, v in zip(header, r, strict=False)} for r in records] == [c for *_, c in statements.split_records("x", data)]


def test_files_equal_their_whole_parse(spark, tmp_path):
    rng = random.Random(1)
    for k in range(4):
        with open(f"{tmp_path}/f{k}.csv", "wb") as f:
            f.write(texts(rng, 60 * k).encode())
    open(f"{tmp_path}/empty.csv", "w").close()
    assert rows_of(large_csv.read_large_statements(spark, str(tmp_path), range_bytes=500)) == whole(tmp_path)


def test_one_large_file_is_many_tasks(spark, tmp_path):
    """30 MB with line ends in quotes (200 MB take the same way)."""
    block = "".join(f'2024-01-{k % 28 + 1:02d},"line one of {k}\nand ""two"", quoted",{k}.50\n' for k in range(20_000))
    with open(f"{tmp_path}/large.csv", "w") as f:
        f.write("date,description,amount\n")
        for _ in range(30):
            f.write(block)
    rows = large_csv.read_large_statements(spark, str(tmp_path), range_bytes=4 << 20)
    got = rows.selectExpr("count(*)", "count(DISTINCT row_number)", "min(row_number)", "max(row_number)", "sum(CAST(cells['amount'] AS DECIMAL(19,2)))", "min(cells['description'])").first()
    assert tuple(got)[:4] == (600_000, 600_000, 2, 600_001) and int(got[4]) == 30 * sum(range(20_000)) + 300_000 and got[5] == 'line one of 0\nand "two", quoted'
    parsed = statements.parse_statements(rows.where("row_number < 100"))
    assert parsed.where("error IS NULL AND amount IS NOT NULL").count() == 98
