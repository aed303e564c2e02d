"""Product telemetry: validation, deduplication, keyed state and windows, as batch functions and as streams of the same rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import exact_median

#: What intake allows. Names and scenes of events, codes of errors, bounds of numbers, versions of consent and those with a journey.
NAMES = ["session.started", "scene.viewed", "module.clicked", "oracle.submitted", "oracle.completed", "oracle.failed", "feedback.submitted"]
SCENES = ["oracle", "research", "science", "ecosystem", "simulate", "analytics", "database", "map", "papers", "dev", "inventory", "other"]
ERROR_CODES = ["network", "model_unavailable", "session_expired", "unknown"]
MOST_DURATION_MS, MOST_SOURCES, MOST_ELAPSED_MS = 3_600_000, 1000, 86_400_000
JOURNEY_VERSIONS = ["2026-10-29-journey-v1", "2026-10-29-demo-v1"]
CONSENT_VERSIONS = [*JOURNEY_VERSIONS, "2026-10-29-chat-v1"]
UUID4 = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
WINDOWS_MIN = [15, 60, 1440, 10080, 129600]
TERMINAL = ["completed", "failed", "cancelled"]


def reject_reason() -> Column:
    """Why intake refuses an event; null if it does not. The same expression serves batches and streams.

    Columns: consent, consent_version, session_id, event_id, name, scene, elapsed_ms, duration_ms, source_count, error_code. The
    session is judged before the event, and of an event its journey, numbers, code, id, name, scene and elapsed time in turn.
    """
    known = lambda c, values: F.coalesce(F.col(c).isin(values), F.lit(False))
    uuid4 = lambda c: F.coalesce(F.col(c).rlike(UUID4), F.lit(False))
    beyond = lambda c, most: F.col(c).isNotNull() & ~F.col(c).between(0, most)
    journey = F.col("elapsed_ms").isNotNull() | F.coalesce(F.col("name") == "module.clicked", F.lit(False))
    rules = [
        (~F.coalesce("consent", F.lit(False)) | ~known("consent_version", CONSENT_VERSIONS), "consent"), (~uuid4("session_id"), "session id"),
        (F.col("event_id").isNull() | F.col("name").isNull() | F.col("scene").isNull(), "missing"), (journey & ~known("consent_version", JOURNEY_VERSIONS), "journey consent"),
        (beyond("duration_ms", MOST_DURATION_MS), "duration"), (beyond("source_count", MOST_SOURCES), "source count"), (F.col("error_code").isNotNull() & ~known("error_code", ERROR_CODES), "error code"),
        (~uuid4("event_id"), "event id"), (~known("name", NAMES), "name"), (~known("scene", SCENES), "scene"), (beyond("elapsed_ms", MOST_ELAPSED_MS), "elapsed time")]
    return reduce(lambda out, rule: F.when(rule[0], rule[1]).otherwise(out), reversed(rules), F.lit(None).cast("string"))


def validate_events(df: DataFrame) -> DataFrame:
    return df.withColumn("reason", reject_reason())


def dedupe_events(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The first write of each key; ties by the rest of the row."""
    keys = keys or ["event_id"]
    rest = [c for c in df.columns if c not in keys and c != "created_at"]
    return df.groupBy(*keys).agg(F.min(F.struct("created_at", *rest)).alias("e")).select(*keys, "e.*")


def dedupe_stream(stream: DataFrame, keys: list[str] | None = None, delay: str = "1 day") -> DataFrame:
    return stream.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(keys or ["event_id"])


def intake_counts(df: DataFrame, key: str = "event_id") -> DataFrame:
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("accepted"), (F.sum("n") - F.count("*")).alias("duplicates"))


def fold_turns(rows: list[tuple[str, int, str, str]]) -> tuple[str, int, str, str] | None:
    """(owner, revision, status, text) after revisions in order of arrival: a higher one of the same owner replaces while the held one is `submitted`."""
    held = None
    for row in rows:
        if held is None or (held[2] == "submitted" and row[1] > held[1] and row[0] == held[0]):
            held = row
    return held


def owner_of(df: DataFrame) -> DataFrame:
    """The identity of a turn in one column: session, conversation, index and question, as far as they are known."""
    parts = [c for c in ("session_id", "conversation_id", "turn_index", "question") if c in df.columns]
    return df.withColumn("owner", F.to_json(F.struct(*parts)) if parts else F.lit(""))


def latest_turn(df: DataFrame) -> DataFrame:
    """The state of each turn after all its revisions by arrival: (turn_id, owner, revision, status, content, rejected).

    The first arrival holds; while it is `submitted`, each later higher revision of the same identity (`owner`) replaces it.
    Arrivals under the turn's id with another identity are rejected and counted. A turn has few revisions.
    """
    arrived = F.array_sort(F.collect_list(F.struct("arrival", "owner", "revision", "status", "content")))
    first = F.get("r", F.lit(0))
    step = F.aggregate(F.slice("r", 2, F.size("r")), first, lambda a, x: F.when((a["status"] == "submitted") & (x["revision"] > a["revision"]) & (x["owner"] == a["owner"]), x).otherwise(a))
    rejected = F.size(F.filter("r", lambda x: x["owner"] != first["owner"])).cast("long")
    out = owner_of(df) if "owner" not in df.columns else df
    return out.groupBy("turn_id").agg(arrived.alias("r")).withColumns({"held": step, "rejected": rejected}).select("turn_id", "held.owner", "held.revision", "held.status", "held.content", "rejected")


def _rises(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows by arrival, without those that an earlier one of the same identity equals or exceeds: no fold ever takes these."""
    rows = rows.sort_values(["arrival", "owner", "revision", "status", "content"], kind="stable", na_position="first", ignore_index=True)
    before = rows.groupby("owner", dropna=False)["revision"].cummax().groupby(rows["owner"], dropna=False).shift()
    return rows[before.isna() | (rows["revision"] > before)]


def latest_turn_stream(stream: DataFrame) -> DataFrame:
    """The stream of state changes by turn, state kept per key: (turn_id, owner, revision, status, content).

    A micro-batch may bring a turn in many pieces of any order; of each piece only the rising revisions of an identity are
    held, and all of them are applied by arrival.
    """
    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        changed, rows = False, None
        for pdf in batches:
            rows = _rises(pdf if rows is None else pd.concat([rows, pdf]))
        for row in rows.itertuples() if rows is not None else ():
            if held is None or (held[2] == "submitted" and row.revision > held[1] and row.owner == held[0]):
                held, changed = (row.owner, int(row.revision), row.status, row.content), True
        if changed:
            state.update(held)
            yield pd.DataFrame([(key[0], *held)], columns=["turn_id", "owner", "revision", "status", "content"])
    schema = "owner string, revision long, status string, content string"
    out = owner_of(stream) if "owner" not in stream.columns else stream
    return out.groupBy("turn_id").applyInPandasWithState(run, f"turn_id string, {schema}", schema, "update", "NoTimeout")


def answer_number(events: DataFrame) -> DataFrame:
    """Ordinal of completed answers within each session; every second may be rated."""
    done = events.where(F.col("name") == "oracle.completed")
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "event_id"))
    return done.select("event_id", "session_id", n.alias("answer_number")).withColumn("may_rate", F.col("answer_number") % 2 == 0)


def apply_withdrawals(events: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Events of sessions that never withdrew; the tombstones themselves stay."""
    return events.join(withdrawals.select("session_id"), "session_id", "left_anti")


def session_state(events: DataFrame) -> DataFrame:
    """First and last sight, consent of the latest version with the time it was first given, and whether references conflict."""
    per_version = events.groupBy("session_id", "consent_version").agg(F.min("created_at").alias("consented"), F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.min("ref").alias("ref_low"), F.max("ref").alias("ref_high"))
    latest = F.max_by(F.struct("consent_version", "consented"), F.struct("last", "consent_version"))
    return per_version.groupBy("session_id").agg(F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), latest.alias("c"), (F.min("ref_low") != F.max("ref_high")).alias("ref_conflict")).select("session_id", "first_seen", "last_seen", "c.consent_version", "c.consented", F.coalesce("ref_conflict", F.lit(False)).alias("ref_conflict"))


def in_window(now: Column, minutes: int, at: str = "created_at") -> Column:
    return F.col(at).between(now - F.make_interval(mins=F.lit(minutes)), now)


def dashboard_totals(events: DataFrame, feedback: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Distinct sessions over events and feedback, counts, and the continuous median of completed durations, in a closed window."""
    if minutes not in WINDOWS_MIN:
        raise ValueError(f"window of {minutes} minutes")
    ev, fb = events.where(in_window(now, minutes)), feedback.where(in_window(now, minutes))
    sessions = ev.select("session_id").union(fb.select("session_id")).agg(F.countDistinct("session_id").alias("sessions"))
    one = ev.agg(F.count("*").alias("events"), F.count_if(F.col("name") == "oracle.completed").alias("completed"), F.count_if(F.col("name") == "oracle.failed").alias("failed"))
    median = exact_median(ev.where(F.col("name") == "oracle.completed"), "duration_ms").select(F.col("median").alias("median_ms"))
    return one.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(sessions)).crossJoin(F.broadcast(fb.agg(F.count("*").alias("feedback"))))


def scene_counts(events: DataFrame, name: str = "scene.viewed") -> DataFrame:
    return events.where(F.col("name") == name).groupBy("scene").agg(F.count("*").alias("n"))


def pseudonym(c: str = "session_id") -> Column:
    return F.concat(F.lit("s_"), F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 12))


def activity_feed(events: DataFrame, n: int = 50) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(min(50, n)).select("event_id", "created_at", "name", "scene", pseudonym().alias("who"))


def conversation_rollup(turns: DataFrame, since: int) -> DataFrame:
    out = turns.groupBy("conversation_id").agg(F.count("*").alias("turns"), F.min("turn_index").alias("first"), F.max("turn_index").alias("last"))
    return out.where(F.col("last") >= since)


def journey(questions: DataFrame, feedback: DataFrame, n: int = 100) -> DataFrame:
    """Questions and feedback (with a text from rating and category where it has none), newest first."""
    text = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.concat_ws(" ", F.lit("rated"), F.col("rating").cast("string"), "category"))
    both = questions.select("id", "session_id", "created_at", F.lit("question").alias("kind"), "text").unionByName(feedback.select("id", "session_id", "created_at", F.lit("feedback").alias("kind"), text.alias("text")))
    return both.orderBy(F.desc("created_at"), F.desc("id"), "kind").limit(n)


def transcript_page(turns: DataFrame, conversation: int, after: int, n: int) -> DataFrame:
    """The next n turns and whether more follow, found by one row beyond the page."""
    probe = turns.where((F.col("conversation_id") == conversation) & (F.col("turn_index") > after)).orderBy("turn_index").limit(n + 1)
    rows = probe.withColumn("nth", F.row_number().over(Window.partitionBy("conversation_id").orderBy("turn_index"))).withColumn("seen", F.count("*").over(Window.partitionBy("conversation_id")))
    return rows.where(F.col("nth") <= n).withColumn("has_more", F.col("seen") > n).drop("nth", "seen")


def error_feed(events: DataFrame, n: int = 50) -> DataFrame:
    return events.where(F.col("name") == "oracle.failed").orderBy(F.desc("created_at"), F.desc("event_id")).limit(n)


def retention(tables: dict[str, tuple[DataFrame, str]], now: Column, days: int = 90) -> DataFrame:
    """Rows older than the term and rows kept, by table; each table has its own time column."""
    out = None
    for name, (df, at) in sorted(tables.items()):
        old = F.col(at) < now - F.make_interval(days=F.lit(days))
        one = df.agg(F.count_if(old).alias("expired"), F.count_if(~old).alias("kept")).select(F.lit(name).alias("table"), "expired", "kept")
        out = one if out is None else out.unionByName(one)
    return out


def sanitise_aggregates(df: DataFrame, metrics: list[str], most: float = 1e15) -> DataFrame:
    """Whitelisted metrics and plain dimensions; numbers (also as text) within bounds, all others null; rows without any number drop."""
    number = lambda c: F.when(F.col(c).try_cast("double").between(0, most), F.col(c).try_cast("double"))
    fields = [c for c in df.columns if c not in ("metric", "dimension")]
    out = df.where(F.col("metric").isin(metrics) & F.col("dimension").rlike(r"^[A-Za-z0-9_.-]{1,40}$")).withColumns({c: number(c) for c in fields})
    return out.where(F.coalesce(*fields).isNotNull())


def quota(attempts: DataFrame, most: int = 10) -> DataFrame:
    """Running sum by project and day; an attempt over the limit is refused, and one export per span is made unless it failed."""
    day = F.to_date("tried_at")
    w = Window.partitionBy("project", "day").orderBy("tried_at", "attempt_id").rowsBetween(Window.unboundedPreceding, 0)
    out = attempts.withColumn("day", day).withColumn("used", F.sum("n").over(w)).withColumn("allowed", F.col("used") <= most)
    nth = F.row_number().over(Window.partitionBy("project", "day", "span").orderBy(F.col("failed").cast("int"), "tried_at", "attempt_id"))
    return out.withColumn("is_export", F.col("allowed") & ~F.col("failed") & (nth == 1))


def copy_reconcile(src: DataFrame, dst: DataFrame, key: str) -> DataFrame:
    """inserted, same and conflict counts of a copy that only adds."""
    cols = [c for c in src.columns if c != key]
    both = src.select(F.col(key), F.xxhash64(*cols).alias("h")).join(dst.select(F.col(key), F.xxhash64(*cols).alias("g")), key, "left")
    return both.agg(F.count_if(F.col("g").isNull()).alias("inserted"), F.count_if(F.col("g") == F.col("h")).alias("same"), F.count_if(F.col("g").isNotNull() & (F.col("g") != F.col("h"))).alias("conflicts"))


def merge_withdrawals(src: DataFrame, dst: DataFrame) -> DataFrame:
    return src.unionByName(dst).groupBy("session_id").agg(F.min("withdrawn_at").alias("withdrawn_at"))


def windowed_activity(events: DataFrame, kind: str = "tumbling", delay: str | None = None) -> DataFrame:
    """Events by name and window: tumbling hours, sliding 2 hours every hour, or sessions with a gap of 30 minutes. With `delay`, a stream with a watermark."""
    if delay:
        events = events.withWatermark("created_at", delay)
    w = {"tumbling": F.window("created_at", "1 hour"), "sliding": F.window("created_at", "2 hours", "1 hour")}.get(kind)
    if w is None:
        out = events.groupBy(F.session_window("created_at", "30 minutes").alias("w"), "session_id").agg(F.count("*").alias("n"))
        return out.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    return events.groupBy(w.alias("w"), "name").agg(F.count("*").alias("n")).select("name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
