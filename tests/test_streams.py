"""Streams with state: restarts, repeated batches, compaction, and the corner cases of the state machines."""

import glob
import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import recurring
from ledgerlake.sources import statements
from ledgerlake.streaming import folders, ingest, rescan, run, state
from ledgerlake.streaming.folders import Folders

T0 = datetime(2024, 1, 1)


def forget_last_commit(checkpoint):
    """As if the process had died after the last batch's output and before its commit."""
    last = max((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
    for f in glob.glob(f"{checkpoint}/commits/*{last}*") + glob.glob(f"{checkpoint}/commits/.{last}*"):
        os.remove(f)


TOKEN_ROWS = [  # (user, id, hours, action, token, new token), outcome, revoked
    ((1, 1, 0, "ISSUE", "a", None), "ISSUED", 0),
    ((1, 2, 1, "ROTATE", "a", "b"), "ROTATED", 0),
    ((2, 3, 1, "ROTATE", "a", "x"), "INVALID", 0),  # another user's token
    ((1, 4, 2, "ISSUE", "c", None), "ISSUED", 0),
    ((1, 5, 3, "ROTATE", "a", "z"), "REUSED", 2),  # b and c
    ((1, 6, 4, "ROTATE", "b", "y"), "REUSED", 0),
    ((1, 7, 4, "ROTATE", "y", "w"), "INVALID", 0),  # never issued
    ((1, 8, 5, "ISSUE", "d", None), "ISSUED", 0),
    ((1, 9, 5 + 24 * 8, "ROTATE", "d", "e"), "EXPIRED", 0),
    ((1, 10, 200, "REVOKE", "d", None), "REVOKED", 1),
    ((1, 11, 201, "REVOKE", "d", None), "IGNORED", 0),
    ((1, 12, 202, "REVOKE", None, None), "IGNORED", 0),
    ((1, 13, 203, "RESET_REQUEST", "r1", None), "ISSUED", 0),
    ((1, 14, 203.1, "RESET_REQUEST", "r2", None), "ISSUED", 0),
    ((1, 15, 203.2, "ISSUE", "f", None), "ISSUED", 0),
    ((1, 16, 203.3, "RESET_CONSUME", "r1", None), "RESET", 1),
    ((1, 17, 203.4, "RESET_CONSUME", "r1", None), "INVALID", 0),
    ((1, 18, 203.4, "RESET_CONSUME", "r2", None), "INVALID", 0),  # ended with r1
    ((1, 19, 203.5, "ROTATE", "r2", "q"), "INVALID", 0),  # not a session
    ((1, 20, 204, "RESET_REQUEST", "r3", None), "ISSUED", 0),
    ((1, 21, 205, "RESET_CONSUME", "r3", None), "INVALID", 0),  # after half an hour
    ((1, 22, 206, "ISSUE", "g", None), "ISSUED", 0),
    ((1, 23, 207, "REVOKE_ALL", None, None), "REVOKED", 1),
    ((1, 24, 24 * 40, "ROTATE", "a", "h"), "INVALID", 0),  # dead for over 30 days
    ((1, 25, 24 * 40, "DANCE", "a", "h"), "IGNORED", 0),
]


def token_rows(spark):
    rows = [(u, i, T0 + timedelta(hours=h), a, t, n) for (u, i, h, a, t, n), _, _ in TOKEN_ROWS]
    return spark.createDataFrame([*rows, (None, 90, T0, "ISSUE", "a", None), (1, 91, None, "ISSUE", "a", None)], "user_id long, id long, at timestamp, action string, token string, new_token string")


@pytest.mark.parametrize("cuts", [[], [4, 9, 17, 23]])
def test_tokens_in_one_run_and_over_restarts(spark, tmp_path, cuts):
    rows, source = token_rows(spark), f"{tmp_path}/in"
    spark.createDataFrame([], rows.schema).write.parquet(source)
    bounds = [0, *cuts, 1000]
    for low, high in zip(bounds, bounds[1:], strict=False):
        rows.where(f"id > {low} AND id <= {high}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        run.run_to_end(state.token_outcomes(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    got = {r.id: (r.outcome, r.revoked) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {row[1]: (outcome, revoked) for row, outcome, revoked in TOKEN_ROWS}


def test_counters_of_every_batch(spark, tmp_path):
    """After each batch the counters equal those of the batch function; rows of a batch come in any order."""
    rng, source, rows = random.Random(6), f"{tmp_path}/in", []
    schema = "user_id long, kind string, at timestamp"
    for number in range(4):
        part = [(rng.randint(1, 9), rng.choices(("INCREMENT", "RESET"), (9, 1))[0], T0 + timedelta(days=number, seconds=rng.randint(0, 80_000))) for _ in range(60)]
        part += [(None, "RESET_ALL", T0 + timedelta(days=number, seconds=40_000))] if number in (1, 3) else []
        part += [(None, "INCREMENT", T0), (1, "INCREMENT", None), (1, "OTHER", T0)]
        rows += part
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run.run_to_end(state.counter_changes(stream, buckets=3), f"{tmp_path}/out", f"{tmp_path}/check")
        want = {}
        for user in {u for u, kind, at in rows if u and at and kind != "OTHER"}:
            last = max((at for u, kind, at in rows if at and (kind == "RESET" and u == user or kind == "RESET_ALL")), default=datetime.min)
            want[user] = sum(u == user and kind == "INCREMENT" and at is not None and at > last for u, kind, at in rows)
        assert {r.user_id: r["count"] for r in state.latest_counts(spark.read.parquet(f"{tmp_path}/out")).collect()} == want


HEAD = "date,description,merchant,type,amount\n"


def test_ingest_equals_the_batch_and_repeats_add_nothing(spark, tmp_path):
    source, path, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    files = {
        "user=1/a.csv": HEAD + '2024-01-05,"swiggy, order\n2",Swiggy,DEBIT,120.50\n2024-01-05,salary,,CREDIT,1000\nsoon,x,,DEBIT,1\n',
        "user=2/b.csv": HEAD + "2024-02-01,uber trip,,DEBIT,80\n",
        "user=2/broken.csv": "some,other\nfile,1\n",
        "nobody/c.csv": HEAD + "2024-02-02,uber trip,,DEBIT,80\n",
    }
    user = F.regexp_extract("file", r"user=(\d+)", 1)
    for part in (list(files)[:1], list(files)[1:]):
        for name in part:
            os.makedirs(os.path.dirname(f"{source}/{name}"), exist_ok=True)
            with open(f"{source}/{name}", "w") as f:
                f.write(files[name])
        ingest.ingest(ingest.arriving(spark, source), path, check, user)
    once = sorted(map(str, ingest.entries(spark, path).collect())), sorted(map(str, ingest.sums(spark, path).collect())), sorted(map(str, ingest.imports(spark, path).drop("batch").collect()))
    forget_last_commit(check)
    ingest.ingest(ingest.arriving(spark, source), path, check, user)  # the last batch comes again
    assert once == (sorted(map(str, ingest.entries(spark, path).collect())), sorted(map(str, ingest.sums(spark, path).collect())), sorted(map(str, ingest.imports(spark, path).drop("batch").collect())))
    parsed = statements.parse_statements(statements.records_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)))
    want = statements.to_ledger(parsed.where(user.try_cast("long").isNotNull()), user.try_cast("long"))
    assert sorted(map(str, ingest.entries(spark, path).drop("month").select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() == 3
    assert sorted(map(str, ingest.sums(spark, path).drop("month").collect())) == sorted(map(str, ingest.daily_sums(want).collect()))
    errors = {r.file.rsplit("/", 1)[1]: r.errors for r in ingest.imports(spark, path).collect()}
    assert errors == {"a.csv": ["Row 4: invalid date"], "b.csv": [], "broken.csv": ["unknown statement layout"], "c.csv": ["no user"]}
    plan = ingest.entries(spark, path).where("month = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_folders_replace_add_up_and_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "MANY", 4)
    schema = spark.createDataFrame([], "user_id long, n long").schema
    kept, log = (Folders(spark, f"{tmp_path}/{x}", schema, newest) for x, newest in (("state", True), ("log", False)))
    want = {}
    for i in range(11):
        user = i % 3
        rows = spark.createDataFrame([(user, i)], schema)
        bucket = [r[0] for r in rows.select(folders.bucket_of()).collect()]
        gone = i == 9
        kept.write(rows.where(F.lit(not gone)), f"b{i}", bucket)
        kept.write(rows, f"b{i}", bucket)  # a repeat of the label
        log.write(rows, f"b{i}")
        want[user] = i
        if gone:
            del want[user]
    assert {r.user_id: r.n for r in kept.read().collect()} == want
    assert sorted(r.n for r in log.read().collect()) == list(range(11))
    assert len(kept.done()) <= 5 and any(label == "all" for _, label in kept.done())
    assert kept.part("b10").collect()[0].n == 10
    os.remove(f"{kept._folder(*kept.done()[-1])}/_SUCCESS")  # a change that was not finished does not count
    assert not kept.has("b10") and kept.read([]).count() == 0


def patterns_ledger(spark, users, months):
    rows = [(u * 100 + m, u, 100 + u, date(2024, m, 5), "d", f"shop{u}", "SUBSCRIPTIONS", "DEBIT") for u in users for m in months]
    return spark.createDataFrame(rows, "id long, user_id long, amount int, date date, description string, merchant string, category string, type string").withColumn("amount", F.col("amount").cast("decimal(19,4)"))


def test_rescan_keeps_what_users_said_and_computes_touched_users_only(spark, tmp_path):
    source, path, check = (f"{tmp_path}/{x}" for x in ("in", "state", "check"))
    seen = []

    def detect(rows):
        if rows.schema.names and rows.take(1):
            seen.append(sorted(r.user_id for r in rows.select("user_id").distinct().collect()))
        return recurring.detect(rows, date(2024, 12, 31), key="merchant", name="")

    def batch(users, months):
        patterns_ledger(spark, users, months).coalesce(1).write.mode("append").parquet(source)
        rescan.rescan(spark.readStream.schema(patterns_ledger(spark, [1], [1]).schema).parquet(source), detect, path, check)

    schema = rescan.pattern_schema(recurring.detect(patterns_ledger(spark, [1], [1]), date(2024, 12, 31), key="merchant", name=""))
    now = lambda: {r.user_id: (r.payments, r.dismissed, r.confirmed) for r in rescan.state(spark, path, schema).read().collect()}
    batch([1, 2, 3], [1, 2, 3])
    assert now() == {u: (3, False, False) for u in (1, 2, 3)}
    said = spark.createDataFrame([(1, "shop1", "MONTHLY", 1, "dismiss"), (2, "shop2", "MONTHLY", 1, "confirm")], "user_id long, key string, period string, at long, action string")
    for _ in range(2):  # the second time it is there already
        rescan.act(spark, said, schema, path, "first")
    batch([1, 2], [4])
    assert now() == {1: (3, True, False), 2: (4, False, True), 3: (3, False, False)} and seen[-1] == [1, 2]
    forget_last_commit(check)
    batch([3], [5, 6])  # the last batch comes again, then the new one
    assert now() == {1: (3, True, False), 2: (4, False, True), 3: (5, False, False)} and seen[-1] == [3]


def test_log_by_time_is_dealt_to_files_in_one_pass(spark, monkeypatch):
    """Each file is written from its own part, so the rows are not read once for every file."""
    from ledgerlake.plans import stream_queries

    places, place = [], stream_queries.run.place
    monkeypatch.setattr(stream_queries, "BATCH_ROWS", 100)
    monkeypatch.setattr(stream_queries.run, "place", lambda s, name: places.append((name, place(s, name))) or places[-1][1])
    rows = spark.range(1000).selectExpr("id", "timestamp_seconds(1700000000 + (id * 7919) % 1000) AS at")
    stream_queries.by_time(rows, "t", 4)
    places = dict(places)
    parts = spark.read.parquet(places["t-parts"]).groupBy("_part").agg({"at": "max", "id": "count"}).orderBy("_part").collect()
    assert len(parts) == 10 and sum(r["count(id)"] for r in parts) == 1000
    files = spark.read.parquet(places["t-by-time"]).selectExpr("*", "_metadata.file_path AS f", "_metadata.file_modification_time AS m").groupBy("f", "m").agg({"at": "max", "id": "count"}).orderBy("m").collect()
    assert [(r["max(at)"], r["count(id)"]) for r in files] == [(r["max(at)"], r["count(id)"]) for r in parts]


def test_ingest_parses_a_row_once(spark, tmp_path, monkeypatch):
    """What became of the files is told from the parsed rows that the entries were made of, not from a parse of its own."""
    plans, summary = [], statements.summary
    monkeypatch.setattr(ingest.statements, "summary", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or summary(rows))
    os.makedirs(f"{tmp_path}/in/user=1")
    with open(f"{tmp_path}/in/user=1/a.csv", "w") as f:
        f.write(HEAD + "2024-01-05,uber trip,,DEBIT,120.50\n")
    ingest.ingest(ingest.arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", F.regexp_extract("file", r"user=(\d+)", 1))
    assert len(plans) == 1 and "gettimestamp" in plans[0] and "gettimestamp" not in plans[0].split("InMemoryRelation")[0]


class KeptList:
    """A list state and the timers of one key, with the number of its calls."""

    def __init__(self):
        self.values, self.calls, self.timers = [], [], []

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return iter(self.values)

    def appendValue(self, value):
        self.calls.append("append")
        self.values.append(value)

    def put(self, values):
        self.values = list(values)

    def clear(self):
        self.values = []

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_bucket_of_tokens_is_read_and_appended_to_once_a_batch():
    """However many events and users it holds; timers are one a day and leave the tokens that are not dead for long."""
    import pandas as pd

    kept, kept.now = KeptList(), 0
    tokens = state.TokenStates(state.SESSION, state.RESET, state.KNOWN)
    tokens.init(kept)
    day = state.DAY
    hash_ = lambda user, n: bytes([user, n]) * 16
    for batch in (0, 1):  # each user's token is rotated 20 times in a batch, then the first comes back
        rows = [("1" + str(n), batch * day + n, user, "ROTATE", hash_(user, n - 1), hash_(user, n)) for user in (1, 2, 3) for n in range(batch * 20 + 1, batch * 20 + 21)]
        rows += [("0", 0, user, "ISSUE", hash_(user, 0), None) for user in (1, 2, 3) if batch == 0]
        frame = pd.DataFrame(rows, columns=["id", "us", "user_id", "action", "hash", "new_hash"])
        out = pd.concat(tokens.handleInputRows((0,), iter([frame[:7], frame[7:]]), kept))
        assert set(out.outcome) == ({"ISSUED", "ROTATED"} if batch == 0 else {"ROTATED"}) and len(out) == len(rows)
    back = pd.DataFrame([("9", 2 * day, 2, "ROTATE", hash_(2, 0), None), (None, 2 * day, 3, None, None, None)], columns=["id", "us", "user_id", "action", "hash", "new_hash"])
    out = pd.concat(tokens.handleInputRows((0,), iter([back]), kept))
    assert [tuple(r) for r in out[["user_id", "id", "action", "outcome", "revoked"]].itertuples(index=False)] == [(3, None, None, "IGNORED", 0), (2, "9", "ROTATE", "REUSED", 1)]
    assert kept.calls == ["get", "append"] * 3 and len(set(kept.timers)) == 2
    kept.now = kept.timers[0]  # 38 days on, the tokens of the first day are dead for long, those of the second are not
    list(tokens.handleExpiredTimer((0,), kept, None))
    assert len(kept.values) == 1 and {t[1] for t in tokens.entries()} == {hash_(u, n) for u in (1, 2, 3) for n in range(40, 41) if u != 2}
    kept.now += 10**9
    list(tokens.handleExpiredTimer((0,), kept, None))
    assert kept.values == []
