"""Telemetry queries, and streams of the same rules run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ADAPTERS, oracle
from ..registry import ORACLES, QUERIES, query
from ..sources.streams import run_stream
from ..streaming import state as K
from ..streaming import telemetry as J

NOW = "TIMESTAMP '2024-01-20 00:00:00'"
ADAPTERS["feedback"] = """
    SELECT event_id AS id, user_id AS session_id, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN concat('text ', CAST(event_id AS STRING)) END AS text,
           CAST(event_id % 5 + 1 AS INT) AS rating, event_type AS category FROM events WHERE event_type IN ('click', 'error')"""
ADAPTERS["repeats"] = "SELECT CAST(floor(event_id / 3) AS BIGINT) AS event_id, user_id AS session_id, ts AS created_at, event_type AS name FROM events"
ADAPTERS["withdrawals"] = "SELECT user_id AS session_id, min(ts) AS withdrawn_at FROM events WHERE event_type = 'error' AND value > 40 AND user_id % 3 = 0 GROUP BY 1"
ADAPTERS["revisions"] = """
    SELECT concat('t', CAST(user_id % 400 AS STRING)) AS turn_id, CASE WHEN event_id % 6 = 0 THEN 'another' ELSE 'one' END AS session_id, event_id AS arrival, event_id % 5 AS revision,
           CASE WHEN event_id % 4 = 0 THEN 'completed' WHEN event_id % 11 = 0 THEN 'failed' ELSE 'submitted' END AS status, props AS content FROM events"""
ADAPTERS["consents"] = "SELECT user_id AS session_id, ts AS created_at, concat('v', CAST(event_id % 3 AS STRING)) AS consent_version, CASE WHEN event_id % 7 = 0 THEN concat('r', CAST(user_id % 2 + event_id % 2 AS STRING)) END AS ref FROM events"
ADAPTERS["attempts"] = "SELECT event_id AS attempt_id, ts AS tried_at, user_id % 20 AS project, CAST(event_id % 3 AS INT) + 1 AS n, CAST(event_id % 4 AS INT) AS span, event_id % 5 = 0 AS failed FROM events"
#: Intake as it arrives: ids made version-4-like from hashes, and each rule broken by some rows.
_ID = "concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-{v}', substr({h}, 14, 3), '-{n}', substr({h}, 18, 3), '-', substr({h}, 21, 12))"
_own = lambda c, v=4, n="a": _ID.format(h=f"md5(CAST({c} AS STRING))", v=v, n=n)
ADAPTERS["intake"] = f"""
    SELECT event_id AS row_id, event_id % 41 <> 1 AS consent, CASE event_id % 7 WHEN 0 THEN '2026-10-29-chat-v1' WHEN 1 THEN '2026-10-29-demo-v1' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'old' ELSE '2026-10-29-journey-v1' END ELSE '2026-10-29-journey-v1' END AS consent_version,
           CASE WHEN user_id % 23 = 5 THEN {_own("user_id", 1)} WHEN user_id % 29 = 6 THEN upper({_own("user_id")}) ELSE {_own("user_id")} END AS session_id,
           CASE WHEN event_id % 53 = 2 THEN NULL WHEN event_id % 59 = 3 THEN {_own("event_id", 4, "c")} WHEN event_id % 61 = 4 THEN 'x' ELSE {_own("event_id")} END AS event_id,
           CASE WHEN event_id % 37 = 7 THEN 'odd' WHEN event_id % 43 = 8 THEN NULL WHEN event_type = 'click' THEN 'module.clicked' WHEN event_type = 'view' THEN 'scene.viewed' WHEN event_type = 'signup' THEN 'session.started' WHEN event_type = 'purchase' THEN 'oracle.completed' WHEN event_id % 2 = 0 THEN 'oracle.failed' ELSE 'feedback.submitted' END AS name,
           CASE event_id % 14 WHEN 0 THEN 'oracle' WHEN 1 THEN 'research' WHEN 2 THEN 'science' WHEN 3 THEN 'ecosystem' WHEN 4 THEN 'simulate' WHEN 5 THEN 'analytics' WHEN 6 THEN 'database' WHEN 7 THEN 'map' WHEN 8 THEN 'papers' WHEN 9 THEN 'dev' WHEN 10 THEN 'inventory' WHEN 11 THEN 'other' WHEN 12 THEN 'inventory' ELSE 'nowhere' END AS scene,
           CASE event_id % 31 WHEN 0 THEN 86400001 WHEN 1 THEN 86400000 WHEN 2 THEN 0 WHEN 3 THEN -1 END AS elapsed_ms, CASE event_id % 47 WHEN 0 THEN 3600001 WHEN 1 THEN 3600000 WHEN 2 THEN -1 WHEN 3 THEN 700000 END AS duration_ms,
           CASE event_id % 67 WHEN 0 THEN 1001 WHEN 1 THEN 1000 END AS source_count, CASE event_id % 11 WHEN 0 THEN 'network' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'odd' ELSE 'unknown' END END AS error_code FROM events"""


@query("j1_validate_events", "intake", r"""SELECT row_id, CASE WHEN NOT consent OR consent_version = 'old' THEN 'consent' WHEN NOT regexp_matches(lower(session_id), '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') THEN 'session id' WHEN event_id IS NULL OR name IS NULL THEN 'missing'
 WHEN (elapsed_ms IS NOT NULL OR name = 'module.clicked') AND consent_version = '2026-10-29-chat-v1' THEN 'journey consent' WHEN duration_ms < 0 OR duration_ms > 3600000 THEN 'duration' WHEN source_count > 1000 THEN 'source count' WHEN error_code = 'odd' THEN 'error code'
 WHEN NOT regexp_matches(lower(event_id), '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') THEN 'event id' WHEN name = 'odd' THEN 'name' WHEN scene = 'nowhere' THEN 'scene' WHEN elapsed_ms < 0 OR elapsed_ms > 86400000 THEN 'elapsed time' END AS reason FROM intake""")
def j1(intake):
    return J.validate_events(intake).select("row_id", "reason")


@query("j2_dedupe_events", "repeats", "SELECT event_id, session_id, created_at, name FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at, session_id, name) AS k FROM repeats) WHERE k = 1")
def j2(repeats):
    return J.dedupe_events(repeats)


@query("j2_intake_counts", "repeats", "SELECT count(DISTINCT event_id) AS accepted, count(*) - count(DISTINCT event_id) AS duplicates FROM repeats")
def j2b(repeats):
    return J.intake_counts(repeats)


@query("j3_latest_turn", "revisions", """, l AS (SELECT turn_id, list(struct_pack(o := session_id, r := revision, s := status, c := content) ORDER BY arrival) AS x FROM revisions GROUP BY 1),
f AS (SELECT turn_id, list_reduce(x, lambda a, b: CASE WHEN a.s = 'submitted' AND b.r > a.r AND b.o = a.o THEN b ELSE a END) AS h, len(list_filter(x, lambda b: b.o <> x[1].o)) AS rejected FROM l)
SELECT turn_id, concat('{"session_id":"', h.o, '"}') AS owner, h.r AS revision, h.s AS status, h.c AS content, rejected FROM f""")
def j3(revisions):
    return J.latest_turn(revisions)


@query("j4_answer_number", "telemetry", "SELECT *, answer_number % 2 = 0 AS may_rate FROM (SELECT event_id, session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, event_id) AS INT) AS answer_number FROM telemetry WHERE name = 'oracle.completed')")
def j4(telemetry):
    return J.answer_number(telemetry)


@query("j5_apply_withdrawals", "telemetry withdrawals", "SELECT * FROM telemetry WHERE session_id NOT IN (SELECT session_id FROM withdrawals)")
def j5(telemetry, withdrawals):
    return J.apply_withdrawals(telemetry, withdrawals)


@query("j6_session_state", "consents", """, v AS (SELECT session_id, consent_version, min(created_at) AS consented, max(created_at) AS last FROM consents GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last DESC, consent_version DESC) AS k FROM v),
a AS (SELECT session_id, min(created_at) AS first_seen, max(created_at) AS last_seen, count(DISTINCT ref) > 1 AS ref_conflict FROM consents GROUP BY 1) SELECT session_id, first_seen, last_seen, consent_version, consented, ref_conflict FROM a JOIN l USING (session_id) WHERE k = 1""")
def j6(consents):
    return J.session_state(consents)


@query("j7_dashboard_totals", "telemetry feedback", f""", e AS (SELECT * FROM telemetry WHERE created_at BETWEEN {NOW} - INTERVAL 10080 MINUTE AND {NOW}), f AS (SELECT * FROM feedback WHERE created_at BETWEEN {NOW} - INTERVAL 10080 MINUTE AND {NOW})
SELECT count(*) AS events, count(*) FILTER (WHERE name = 'oracle.completed') AS completed, count(*) FILTER (WHERE name = 'oracle.failed') AS failed, quantile_cont(duration_ms::DOUBLE, 0.5) FILTER (WHERE name = 'oracle.completed') AS median_ms, (SELECT count(*) FROM (SELECT session_id FROM e UNION SELECT session_id FROM f)) AS sessions, (SELECT count(*) FROM f) AS feedback FROM e""")
def j7(telemetry, feedback):
    return J.dashboard_totals(telemetry, feedback, F.expr(NOW), 10080)


@query("j8_scene_counts", "telemetry", "SELECT scene, count(*) AS n FROM telemetry WHERE name = 'scene.viewed' GROUP BY 1")
def j8(telemetry):
    return J.scene_counts(telemetry)


@query("j8_module_clicks", "telemetry", "SELECT scene, count(*) AS n FROM telemetry WHERE name = 'module.clicked' GROUP BY 1")
def j8b(telemetry):
    return J.scene_counts(telemetry, "module.clicked")


@query("j9_activity_feed", "telemetry", "SELECT event_id, created_at, name, scene, concat('s_', substr(sha256(CAST(session_id AS VARCHAR)), 1, 12)) AS who FROM telemetry ORDER BY created_at DESC, event_id DESC LIMIT 50")
def j9(telemetry):
    return J.activity_feed(telemetry)


@query("j10_conversation_rollup", "turns", "SELECT conversation_id, count(*) AS turns, min(turn_index) AS first, max(turn_index) AS last FROM turns GROUP BY 1 HAVING max(turn_index) >= 4")
def j10(turns):
    return J.conversation_rollup(turns, 4)


@query("j11_journey", "telemetry feedback", """, b AS (SELECT event_id AS id, session_id, created_at, 'question' AS kind, scene AS text FROM telemetry WHERE name = 'oracle.completed' UNION ALL SELECT id, session_id, created_at, 'feedback', coalesce(nullif(trim(text), ''), concat_ws(' ', 'rated', rating, category)) FROM feedback)
SELECT * FROM b ORDER BY created_at DESC, id DESC, kind LIMIT 100""")
def j11(telemetry, feedback):
    questions = telemetry.where("name = 'oracle.completed'").select(F.col("event_id").alias("id"), "session_id", "created_at", F.col("scene").alias("text"))
    return J.journey(questions, feedback)


@query("j12_transcript_page", "turns", "SELECT *, (SELECT count(*) FROM turns WHERE conversation_id = 3 AND turn_index > 0) > 3 AS has_more FROM turns WHERE conversation_id = 3 AND turn_index > 0 ORDER BY turn_index LIMIT 3")
def j12(turns):
    return J.transcript_page(turns, 3, 0, 3)


@query("j13_error_feed", "telemetry", "SELECT * FROM telemetry WHERE name = 'oracle.failed' ORDER BY created_at DESC, event_id DESC LIMIT 50")
def j13(telemetry):
    return J.error_feed(telemetry)


@query("j14_retention", "telemetry orders", "SELECT 'orders' AS \"table\", count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY) AS expired, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY) AS kept FROM orders UNION ALL SELECT 'telemetry', count(*) FILTER (WHERE created_at < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY), count(*) FILTER (WHERE created_at >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY) FROM telemetry")
def j14(telemetry, orders):
    return J.retention({"telemetry": (telemetry, "created_at"), "orders": (orders, "o_orderdate")}, F.expr("TIMESTAMP '1998-01-01 00:00:00'"))


@query("j15_sanitise_aggregates", "events", r""", s AS (SELECT event_type AS metric, CASE WHEN event_id % 9 = 0 THEN 'a b' ELSE concat('d', user_id) END AS dimension, CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN '-3' END AS total, CASE WHEN event_id % 6 = 0 THEN '1e20' ELSE CAST(event_id AS VARCHAR) END AS views FROM events),
n AS (SELECT metric, dimension, CASE WHEN try_cast(total AS DOUBLE) BETWEEN 0 AND 1e15 THEN try_cast(total AS DOUBLE) END AS total, CASE WHEN try_cast(views AS DOUBLE) BETWEEN 0 AND 1e15 THEN try_cast(views AS DOUBLE) END AS views FROM s WHERE metric IN ('view', 'click') AND regexp_full_match(dimension, '[A-Za-z0-9_.-]{1,40}')) SELECT * FROM n WHERE coalesce(total, views) IS NOT NULL""")
def j15(events):
    e = F.col("event_id")
    raw = events.select(F.col("event_type").alias("metric"), F.when(e % 9 == 0, "a b").otherwise(F.concat(F.lit("d"), F.col("user_id"))).alias("dimension"), F.when(e % 4 == 0, "x").when(e % 4 == 1, F.col("value").cast("string")).when(e % 4 == 2, "-3").alias("total"), F.when(e % 6 == 0, "1e20").otherwise(e.cast("string")).alias("views"))
    return J.sanitise_aggregates(raw, ["view", "click"])


@query("j16_quota", "attempts", """, u AS (SELECT attempt_id, project, CAST(tried_at AS DATE) AS day, span, failed, tried_at, CAST(sum(n) OVER (PARTITION BY project, CAST(tried_at AS DATE) ORDER BY tried_at, attempt_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM attempts)
SELECT attempt_id, used, used <= 10 AS allowed, used <= 10 AND NOT failed AND row_number() OVER (PARTITION BY project, day, span ORDER BY failed, tried_at, attempt_id) = 1 AS is_export FROM u""")
def j16(attempts):
    return J.quota(attempts).select("attempt_id", "used", "allowed", "is_export")


@query("j17_copy_reconcile", "telemetry", "SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS inserted, count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 10 <> 1) AS same, count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 10 = 1) AS conflicts FROM telemetry")
def j17(telemetry):
    held = telemetry.withColumn("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 10**12).otherwise(F.col("event_id"))).withColumn("scene", F.when(F.col("event_id") % 10 == 1, "elsewhere").otherwise(F.col("scene")))
    return J.copy_reconcile(telemetry, held, "event_id")


@query("j17_merge_withdrawals", "withdrawals telemetry", "SELECT session_id, min(w) AS withdrawn_at FROM (SELECT session_id, withdrawn_at AS w FROM withdrawals UNION ALL SELECT session_id, created_at FROM telemetry WHERE name = 'oracle.failed') GROUP BY 1")
def j17b(withdrawals, telemetry):
    return J.merge_withdrawals(withdrawals, telemetry.where("name = 'oracle.failed'").select("session_id", F.col("created_at").alias("withdrawn_at")))


_TUM = "SELECT name, date_trunc('hour', created_at) AS start, date_trunc('hour', created_at) + INTERVAL 1 HOUR AS \"end\", count(*) AS n FROM telemetry GROUP BY 1, 2, 3"


@query("j18_tumbling", "telemetry", _TUM)
def j18(telemetry):
    return J.windowed_activity(telemetry)


@query("j18_sliding", "telemetry", "SELECT name, s AS start, s + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM (SELECT name, unnest([date_trunc('hour', created_at), date_trunc('hour', created_at) - INTERVAL 1 HOUR]) AS s FROM telemetry) GROUP BY 1, 2, 3")
def j18b(telemetry):
    return J.windowed_activity(telemetry, "sliding")


@query("j18_sessions", "telemetry", """, l AS (SELECT session_id, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM telemetry), g AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS grp FROM l)
SELECT session_id, min(created_at) AS start, max(created_at) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY session_id, grp""")
def j18c(telemetry):
    return J.windowed_activity(telemetry, "session")


def _stream_query(name: str, build, mode: str, finish=None, sql_of: str | None = None, sql: tuple[str, str] | None = None, settings=None) -> None:
    """A query that runs a stream over the events table to its end and returns what the sink holds."""
    def run(spark, sf_dir):
        out = run_stream(spark, f"{sf_dir}/events.parquet", lambda s: build(spark, s), mode, settings=settings)
        return finish(out) if finish else out

    run.__name__ = name
    QUERIES[name] = run
    if sql_of:
        ORACLES[name] = ORACLES[sql_of]
    if sql:
        ORACLES[name] = oracle(tuple(sql[0].split()), sql[1])


def _telemetry(stream):
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "session.started", "view", "scene.viewed", "click", "module.clicked", "purchase", "oracle.completed")])
    return stream.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"), F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("oracle.failed")).alias("name"))


#: The given events have ids of their own, so the stream lets all of them through; repeats are dropped in the tests.
_stream_query("j2_dedupe_stream", lambda spark, s: J.dedupe_stream(_telemetry(s)), "append", lambda df: df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), sql=("telemetry", "SELECT event_id, session_id, created_at, name FROM telemetry"))
_stream_query("j18_tumbling_stream", lambda spark, s: J.windowed_activity(_telemetry(s), delay="1 hour"), "update", lambda df: df.groupBy("name", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end")).agg(F.max("n").alias("n")), "j18_tumbling")
_stream_query("j3_latest_turn_stream", lambda spark, s: J.latest_turn_stream(s.select(F.concat(F.lit("t"), (F.col("user_id") % 400).cast("string")).alias("turn_id"), F.when(F.col("event_id") % 6 == 0, "another").otherwise("one").alias("session_id"), F.col("event_id").alias("arrival"), (F.col("event_id") % 5).alias("revision"),
              F.when(F.col("event_id") % 4 == 0, "completed").when(F.col("event_id") % 11 == 0, "failed").otherwise("submitted").alias("status"), F.col("props").alias("content"))), "update",
              lambda df: K.latest(df.withColumn("n", F.col("revision")), ["turn_id"]))
#: A turn's later states have higher revisions, so the last update is the state; it is that of the batch.
ORACLES["j3_latest_turn_stream"] = f"SELECT turn_id, owner, revision, status, content FROM ({ORACLES['j3_latest_turn']})"


def _withdrawn(s):
    """The same rows as events and, where they say so, as withdrawals: a session withdraws at its failed orders of over 40."""
    out = s.where("event_type = 'error' AND value > 40 AND user_id % 3 = 0")
    return out.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("withdrawn_at"))


def _plain(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _consents(s):
    e = F.col("event_id")
    return s.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"), F.concat(F.lit("v"), e % 3).alias("consent_version"), F.when(e % 7 == 0, F.concat(F.lit("r"), F.col("user_id") % 2 + e % 2)).alias("ref"))


_stream_query("j5_withdrawal_stream", lambda spark, s: K.withdrawal_stream(_telemetry(s), _withdrawn(s)), "update", K.present_events,
              sql=("telemetry withdrawals", "SELECT session_id, event_id FROM telemetry WHERE session_id NOT IN (SELECT session_id FROM withdrawals)"), settings=K.STORE)
_stream_query("j6_session_stream", lambda spark, s: K.session_stream(_consents(s)), "update", lambda df: _plain(K.latest(df, ["session_id"]), "first_seen", "last_seen", "consented"), "j6_session_state", settings=K.STORE)
#: A day has expired once the watermark, an hour before the latest row, has passed ten days from its end.
_stream_query("j14_retention_stream", lambda spark, s: K.retention_stream(s.select(F.col("event_type").alias("table"), F.col("ts").cast("timestamp").alias("created_at")), 10), "update", K.retention_totals,
              sql=("events", """SELECT event_type AS "table", count(*) FILTER (WHERE date_trunc('day', ts) + INTERVAL 11 DAY <= m) AS expired, count(*) FILTER (WHERE date_trunc('day', ts) + INTERVAL 11 DAY > m) AS kept FROM events, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS m FROM events) GROUP BY 1"""), settings=K.STORE)


def _answers(s):
    name = F.create_map(*[F.lit(x) for x in ("signup", "session.started", "view", "scene.viewed", "click", "module.clicked", "purchase", "oracle.completed")])
    return s.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"), F.coalesce(F.try_element_at(name, F.col("event_type")), F.lit("oracle.failed")).alias("name"),
                    F.when(F.col("event_type") == "purchase", F.floor(F.col("value") * 10).cast("long")).alias("duration_ms"))


_DASH = """, w AS (SELECT t.*, s AS start FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, created_at) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, created_at) - INTERVAL 12 HOUR, time_bucket(INTERVAL 6 HOUR, created_at) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, created_at)]) AS s FROM telemetry) t)
SELECT start, start + INTERVAL 24 HOUR AS "end", count(DISTINCT session_id) AS sessions, count(*) AS events, count(*) FILTER (WHERE name = 'oracle.completed') AS completed, count(*) FILTER (WHERE name = 'oracle.failed') AS failed FROM w GROUP BY 1"""


@query("j7_sliding_dashboard", "telemetry", _DASH)
def j7b(telemetry):
    return _plain(K.dashboard(telemetry.withColumn("created_at", F.col("created_at").cast("timestamp")), "24 hours", "6 hours").drop("median_ms"), "start", "end")


#: A stream gives the windows that have ended by its last watermark.
_stream_query("j7_dashboard_stream", lambda spark, s: K.dashboard(_answers(s), "24 hours", "6 hours", "1 hour"), "append", lambda df: _plain(df.drop("median_ms"), "start", "end"),
              sql=("telemetry", f"""{_DASH} HAVING start + INTERVAL 24 HOUR <= (SELECT max(created_at) FROM telemetry) - INTERVAL 1 HOUR"""))
