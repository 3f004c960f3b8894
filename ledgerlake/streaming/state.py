"""Keyed state machines over event logs: session and reset tokens, and counters that are reset.

State is kept by bucket of users in the state store; logs are read in files that come in order of time. Rows
of one bucket in one micro-batch are ordered in memory, so what a trigger takes (for a file source
maxFilesPerTrigger) bounds them.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from datetime import timedelta
from struct import Struct

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: How long a session token and a reset token live, and how long a dead one is known.
SESSION, RESET, KNOWN = timedelta(days=7), timedelta(minutes=30), timedelta(days=30)
ACTIONS = ("ISSUE", "ROTATE", "REVOKE", "REVOKE_ALL", "RESET_REQUEST", "RESET_CONSUME")


def micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


#: A token in state: user, SHA-256, kind, and when it expires, was consumed and was revoked, in microseconds.
ENTRY = Struct("<q32sBqqq")
SESSION_KIND, RESET_KIND = 0, 1
#: What a step reads of an event; id as text, since pandas would round whole numbers beside nulls.
EVENT = ("us", "id", "user_id", "action", "hash", "new_hash")
NEVER, DAY = (1 << 63) - 1, micros(timedelta(days=1))


class TokenStates(StatefulProcessor):
    """The tokens of a bucket of users by hash: kind, when they expire, were consumed and were revoked, in microseconds.

    State is a list with one value for each micro-batch, the packed entries of the tokens that it changed; a token's last
    entry counts. So a bucket is read and appended to once a batch, not once for each event, and a token, which changes
    three times at most (added, consumed, revoked), is never written again with others.
    """

    def __init__(self, session: timedelta, reset: timedelta, known: timedelta):
        self.session, self.reset, self.known = micros(session), micros(reset), micros(known)

    def init(self, handle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "entries binary")

    def find(self, hash_: bytes | None, kind: int, at: int) -> tuple | None:
        """The token, unless it is unknown or dead for so long that it counts as purged."""
        token = self.tokens.get(hash_) if hash_ is not None else None
        return token if token is not None and token[2] == kind and not self.purged(token, at) else None

    def purged(self, token: tuple, at: int) -> bool:
        return min(token[3:]) < at - self.known

    def update(self, hash_: bytes, kind: int, expires: int, consumed: int = NEVER, revoked: int = NEVER) -> None:
        self.tokens[hash_] = self.changed[self.user, hash_] = (self.user, hash_, kind, expires, consumed, revoked)

    def end_live(self, kind: int, at: int, revoke: bool) -> int:
        """Revoke (or consume) all of the user's live tokens of a kind; how many."""
        live = [t for t in self.tokens.values() if t[2] == kind and t[4] == t[5] == NEVER and t[3] > at]
        for _, hash_, _, expires, _, _ in live:
            self.update(hash_, kind, expires, NEVER if revoke else at, at if revoke else NEVER)
        return len(live)

    def add(self, hash_: bytes | None, kind: int, expires: int) -> None:
        self.update(hash_ or bytes(32), kind, expires)
        self.ends.add((expires + self.known) // DAY + 1)

    def step(self, action: str, hash_: bytes | None, new: bytes | None, at: int) -> tuple[str, int]:
        if action == "ISSUE":
            self.add(hash_, SESSION_KIND, at + self.session)
            return "ISSUED", 0
        if action == "ROTATE":
            token = self.find(hash_, SESSION_KIND, at)
            if token is None:
                return "INVALID", 0
            *_, expires, consumed, revoked = token
            if consumed != NEVER or revoked != NEVER:  # a token that was used before: taken for theft
                return "REUSED", self.end_live(SESSION_KIND, at, revoke=True)
            if expires <= at:
                return "EXPIRED", 0
            self.update(hash_, SESSION_KIND, expires, at)
            self.add(new, SESSION_KIND, at + self.session)
            return "ROTATED", 0
        if action == "REVOKE":  # silent on what is unknown or revoked already
            token = self.find(hash_, SESSION_KIND, at)
            if token is None or token[5] != NEVER:
                return "IGNORED", 0
            self.update(hash_, SESSION_KIND, token[3], token[4], at)
            return "REVOKED", 1
        if action == "REVOKE_ALL":
            return "REVOKED", self.end_live(SESSION_KIND, at, revoke=True)
        if action == "RESET_REQUEST":
            self.add(hash_, RESET_KIND, at + self.reset)
            return "ISSUED", 0
        if action == "RESET_CONSUME":
            token = self.find(hash_, RESET_KIND, at)
            if token is None or token[4] != NEVER or token[3] <= at:
                return "INVALID", 0
            self.update(hash_, RESET_KIND, token[3], at)
            self.end_live(RESET_KIND, at, revoke=False)  # other links of the user
            return "RESET", self.end_live(SESSION_KIND, at, revoke=True)
        return "IGNORED", 0

    def entries(self) -> Iterator[tuple]:
        for (packed,) in self.log.get():
            yield from ENTRY.iter_unpack(packed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = [[x for part in parts for x in part] for parts in zip(*[[r[c].tolist() for c in EVENT] for r in rows], strict=True)]
        events = sorted(zip(*columns, strict=True), key=lambda e: (e[0], int(e[1]) if e[1] is not None else -NEVER))
        users: dict[int, dict] = {user: {} for user in columns[2]}
        for token in self.entries():
            if (tokens := users.get(token[0])) is not None:
                tokens[token[1]] = token
        self.changed, self.ends, found = {}, set(), []
        for at, _, self.user, action, hash_, new in events:
            self.tokens = users[self.user]
            found.append(self.step(action, hash_, new, at))
        if self.changed:
            self.log.appendValue((self.packed(self.changed),))
        if timerValues.getCurrentWatermarkInMs() >= 0:
            for day in self.ends:  # a timer a day, not one for each token
                self.handle.registerTimer(day * DAY // 1000)
        us, ids, user_ids, actions, _, _ = zip(*events, strict=True)
        outcomes, revoked = zip(*found, strict=True)
        yield pd.DataFrame({"user_id": user_ids, "id": ids, "us": us, "action": actions, "outcome": outcomes, "revoked": revoked})

    def packed(self, tokens: dict[tuple, tuple]) -> bytes:
        return b"".join(ENTRY.pack(*t) for t in tokens.values())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        tokens = {t[:2]: t for t in self.entries()}
        tokens = {of: t for of, t in tokens.items() if not self.purged(t, now)}
        if tokens:
            self.log.put([(self.packed(tokens),)])
        else:
            self.log.clear()
        return iter(())

    def close(self) -> None:
        pass


def token_outcomes(log: DataFrame, late: str = "1 day", session: timedelta = SESSION, reset: timedelta = RESET, known: timedelta = KNOWN, buckets: int = 256) -> DataFrame:
    """user_id, id, at, action, outcome, revoked of a stream of token events (user_id, id, at, action, token, new_token).

    ISSUE and RESET_REQUEST add a token. ROTATE consumes a session token and adds new_token; a consumed or
    revoked one that comes back revokes all live sessions of the user (REUSED). RESET_CONSUME works once, ends
    the user's other reset links and all sessions. State holds SHA-256 hashes only; what is dead for `known`
    counts as never seen, and timers remove it once the watermark is beyond. Rows without user or time go;
    those over `late` behind are dropped by the watermark. A task holds one bucket of users at a time: its tokens
    (65 bytes for each change) and its rows of a micro-batch.
    """
    rows = log.where("user_id IS NOT NULL AND at IS NOT NULL")
    hash_ = lambda c: F.unhex(F.sha2(F.col(c).cast("string"), 256))
    hashed = rows.select(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int").alias("bucket"), "user_id", F.col("id").cast("string").alias("id"), "at", F.unix_micros("at").alias("us"), "action", hash_("token").alias("hash"), hash_("new_token").alias("new_hash"))
    made = "user_id long, id string, us long, action string, outcome string, revoked int"
    out = hashed.withWatermark("at", late).groupBy("bucket").transformWithStateInPandas(TokenStates(session, reset, known), made, "append", "eventTime")
    return out.select("user_id", F.col("id").cast("long").alias("id"), F.timestamp_micros("us").alias("at"), "action", "outcome", "revoked")


class CounterStates(StatefulProcessor):
    """The counters of a bucket of users, and when all were reset last."""

    def init(self, handle) -> None:
        self.counts = handle.getMapState("counts", "user_id long", "count long, reset long")
        self.all = handle.getValueState("all", "reset long, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        had = self.all.get()
        bulk, version = (had[0], had[1]) if had is not None else (None, 0)
        added: dict[int, array] = {}
        resets: dict[int, int] = {}
        before = bulk
        for r in rows:
            if r.kind == "RESET_ALL":
                bulk = r.us if bulk is None else max(bulk, r.us)
            elif r.kind == "RESET":
                resets[r.user_id] = max(resets.get(r.user_id, r.us), r.us)
            elif r.kind == "INCREMENT":
                added.setdefault(r.user_id, array("q")).append(r.us)
        version += 1
        self.all.update((bulk, version))
        touched = added.keys() | resets.keys()
        if bulk != before:  # every counter of the bucket changes
            touched |= {k[0] for k, _ in self.counts.iterator()}
        for user in sorted(touched):
            state = self.counts.getValue((user,))
            count, reset = (state[0], state[1]) if state is not None else (0, None)
            last = max((t for t in (reset, resets.get(user), bulk) if t is not None), default=None)
            if last is not None and last != reset:  # what was counted in earlier batches came before
                count = 0
            count += sum(t > last for t in added.get(user, ())) if last is not None else len(added.get(user, ()))
            self.counts.updateValue((user,), (count, last))
            yield Row(user_id=user, version=version, count=count)

    def close(self) -> None:
        pass


def counter_changes(events: DataFrame, buckets: int = 256, key: str = "user_id") -> DataFrame:
    """user_id, version, count: the counters that each micro-batch of a stream (key, kind, at) changed.

    INCREMENT adds one, RESET sets a key's counter to 0, RESET_ALL all of them: it goes to every bucket, so no
    list of keys is needed. Batches come in order of time; within one, rows may be in any order, and a reset
    clears what is not later. Rows without time go, as do increments and resets without a key.
    """
    rows = events.where("at IS NOT NULL AND kind IN ('INCREMENT', 'RESET', 'RESET_ALL')").where((F.col("kind") == "RESET_ALL") | F.col(key).isNotNull())
    own = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    dealt = rows.withColumn("bucket", F.explode(F.when(F.col("kind") == "RESET_ALL", F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(own))))
    return dealt.select("bucket", F.col(key).cast("long").alias("user_id"), "kind", F.unix_micros("at").alias("us")).groupBy("bucket").transformWithState(CounterStates(), "user_id long, version long, count long", "append", "none")


def latest_counts(changes: DataFrame) -> DataFrame:
    """user_id, count after the last change."""
    return changes.groupBy("user_id").agg(F.max_by("count", "version").alias("count"))
