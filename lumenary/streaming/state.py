"""Telemetry with keyed state: withdrawals, sessions and retention as streams that equal their batch twins, and a windowed dashboard.

State is kept by key in the state store, so a stream that stops goes on from its checkpoint. Rows are applied in the order of
their time within a micro-batch; what they leave does not depend on the order across batches, so a stream's final state is the
batch function of all its input. Outputs are updates with a running number by key; `latest` folds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with several variables and timers needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Keyed(StatefulProcessor):
    """A processor without timers."""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return iter(())

    def close(self) -> None:
        pass


class Withdrawals(_Keyed):
    """Events of a session until it withdraws; then they are taken back, and a tombstone lets no later one in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tombstone = handle.getValueState("withdrawn", "at long")
        self.held = handle.getListState("events", "event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        rows = list(rows)  # of one session in one micro-batch
        gone = [r["at"] for r in rows if r.event_id is None]
        if self.tombstone.exists():
            return
        if gone:
            self.tombstone.update((min(gone),))
            for (event_id,) in self.held.get():
                yield Row(session_id=key[0], event_id=event_id, present=False)
            self.held.clear()
            return
        self.held.appendList([(r.event_id,) for r in rows])  # one call of the state store, not one for each event
        for r in rows:
            yield Row(session_id=key[0], event_id=r.event_id, present=True)


class Sessions(_Keyed):
    """First and last sight of a session, its consent by version, and the lowest and highest reference."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, first long, last long, low string, high string")
        self.versions = handle.getMapState("versions", "version string", "consented long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n, first, last, low, high = self.seen.get() if self.seen.exists() else (0, None, None, None, None)
        new: dict[str, tuple] = {}
        for r in rows:
            n += 1
            at = r["at"]
            first, last = (at, at) if first is None else (min(first, at), max(last, at))
            if r.ref is not None:
                low, high = (r.ref, r.ref) if low is None else (min(low, r.ref), max(high, r.ref))
            a, b = new.get(r.consent_version, (at, at))
            new[r.consent_version] = (min(a, at), max(b, at))
        for version, (a, b) in new.items():
            if self.versions.containsKey((version,)):
                c, d = self.versions.getValue((version,))
                a, b = min(a, c), max(b, d)
            self.versions.updateValue((version,), (a, b))
        self.seen.update((n, first, last, low, high))
        known = [(b, v[0], a) for v, (a, b) in self.versions.iterator()]
        _, version, consented = max(known, key=lambda x: x[:2])
        yield Row(session_id=key[0], n=n, first_seen=first, last_seen=last, consent_version=version, consented=consented, ref_conflict=low != high)


class Retention(StatefulProcessor):
    """Rows of a table and day, counted until the watermark passes the end of the term; then the day is forgotten."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.rows.exists()
        n = (self.rows.get()[0] if known else 0) + sum(1 for _ in rows)
        self.rows.update((n,))
        if not known:
            end = datetime.combine(key[1], datetime.min.time(), UTC) + timedelta(days=self.days + 1)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        yield Row(table=key[0], day=key[1], n=n, expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        n = self.rows.get()[0] if self.rows.exists() else 0
        self.rows.clear()
        yield Row(table=key[0], day=key[1], n=n, expired=True)

    def close(self) -> None:
        pass


def withdrawal_stream(events: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Updates (session_id, event_id, present); both streams have session_id and created_at, events an event_id."""
    both = events.select("session_id", F.unix_micros("created_at").alias("at"), "event_id").unionByName(withdrawals.select("session_id", F.unix_micros("withdrawn_at").alias("at"), F.lit(None).cast("long").alias("event_id")))
    return both.groupBy("session_id").transformWithState(Withdrawals(), "session_id long, event_id long, present boolean", "Update", "None")


def present_events(updates: DataFrame) -> DataFrame:
    """(session_id, event_id) of events that were let in and not taken back."""
    return updates.groupBy("session_id", "event_id").agg(F.min("present").alias("present")).where("present").drop("present")


def session_stream(events: DataFrame) -> DataFrame:
    """Updates of the state of sessions, with the number of rows that each has seen."""
    schema = "session_id long, n long, first_seen long, last_seen long, consent_version string, consented long, ref_conflict boolean"
    out = events.select("session_id", F.unix_micros("created_at").alias("at"), "consent_version", "ref").groupBy("session_id").transformWithState(Sessions(), schema, "Update", "None")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen", "consented")})


def latest(updates: DataFrame, key: list[str], number: str = "n") -> DataFrame:
    """The last update of each key."""
    rest = [c for c in updates.columns if c not in key]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*rest), number).alias("u")).select(*key, *[F.col(f"u.{c}").alias(c) for c in rest if c != number])


def retention_stream(rows: DataFrame, days: int = 90, delay: str = "1 hour") -> DataFrame:
    """Updates (table, day, n, expired) of rows (table, created_at): a day of rows expires `days` days after it ended, by the watermark."""
    dated = rows.withWatermark("created_at", delay).withColumn("day", F.to_date("created_at"))
    return dated.groupBy("table", "day").transformWithState(Retention(days), "table string, day date, n long, expired boolean", "Update", "EventTime")


def retention_totals(updates: DataFrame) -> DataFrame:
    """(table, expired, kept): rows by table, of days that have expired and of others."""
    day = updates.groupBy("table", "day").agg(F.max("n").alias("n"), F.max("expired").alias("expired"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return day.groupBy("table").agg(count(F.col("expired")).alias("expired"), count(~F.col("expired")).alias("kept"))


def dashboard(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes", delay: str | None = None) -> DataFrame:
    """By sliding window: distinct sessions, events, completed and failed answers, and the median duration by a mergeable sketch.

    `length` is a multiple of `slide`. First by window and session, then by window, so sessions are counted exactly and a task's sketches merge; with `delay` a
    stream with a watermark, whose windows come out once they are complete. The sketch's median is within 1.5 % of the ranks.
    """
    if delay:
        events = events.withWatermark("created_at", delay)
    done = F.when(F.col("name") == "oracle.completed", F.col("duration_ms"))
    by_session = events.groupBy(F.window("created_at", length, slide).alias("w"), "session_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("name") == "oracle.completed").alias("completed"), F.count_if(F.col("name") == "oracle.failed").alias("failed"), F.count(done).alias("measured"), F.kll_sketch_agg_bigint(done).alias("sketch"))
    # A window's last slide tells the window, and is the one event time that a stream may carry on.
    whole = by_session.groupBy(F.window(F.window_time("w"), slide).alias("last")).agg(
        F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in ("events", "completed", "failed", "measured")], F.kll_merge_agg_bigint("sketch").alias("sketch"))
    median = F.when(F.col("measured") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5)))
    return whole.select((F.col("last.end") - F.expr(f"INTERVAL {length}")).alias("start"), F.col("last.end").alias("end"), "sessions", "events", "completed", "failed", median.alias("median_ms"))


def exact_median(values: DataFrame, c: str) -> DataFrame:
    """One row, `median`: the mean of the two middle values, from counts of distinct values, so a task holds each value once."""
    counts = values.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
    upto: Column = F.expr("sum(n) OVER (ORDER BY v)")
    placed = counts.withColumn("upto", upto).withColumn("total", F.expr("sum(n) OVER ()"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return placed.agg(((at(F.floor((F.col("total") - 1) / 2)) + at(F.ceil((F.col("total") - 1) / 2))) / 2).alias("median"))
