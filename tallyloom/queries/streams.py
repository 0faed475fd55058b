"""Event-time queries, each on a stream and as its batch twin.

Windows on a stream come out once they are closed: DELAY after their end, by the latest event. Their SQL has just those.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.shared import new_path
from ..streaming import windows as S
from .define import Book

book = Book()
add = book.add

_TUMBLING = "SELECT time_bucket(INTERVAL '{0}', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
_CLOSED = " HAVING time_bucket(INTERVAL '{0}', ts) + INTERVAL '{0}' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'"
DELAY = "1 hour"
_CHANGES = "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type"
_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""
_FIRST = "SELECT user_id, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2"


def rounded(d):
    return d.withColumn("total", F.round("total", 4))


@add("t05_tumbling_batch", _TUMBLING.format("5 minutes"))
def _(t):
    return rounded(S.tumbling(t.events, "5 minutes"))


@add("t05_tumbling_stream", (_TUMBLING + _CLOSED).format("5 minutes"))
def _(t):
    return rounded(S.run_available(S.tumbling(S.event_stream(t.spark, t.folder).withWatermark("ts", DELAY), "5 minutes"), "tumbling"))


@add("t06_hourly_batch", _TUMBLING.format("1 hour"))
def _(t):
    return rounded(S.tumbling(t.events, "1 hour"))


@add("t06_hourly_stream", (_TUMBLING + _CLOSED).format("1 hour"))
def _(t):
    return rounded(S.run_available(S.tumbling(S.event_stream(t.spark, t.folder).withWatermark("ts", DELAY), "1 hour"), "hourly"))


@add("t09_resumed_stream", (_TUMBLING + _CLOSED).format("1 day"))
def _(t):
    """A run that goes on where the one before ended: the second adds nothing, nor does it lose anything."""
    at, days = new_path(t.spark, "resumed"), lambda: S.tumbling(S.event_stream(t.spark, t.folder).withWatermark("ts", DELAY), "1 day")
    S.run_available(days(), "resumed", at)
    return rounded(S.run_available(days(), "resumed", at))


@add("t04_sliding_rate", "SELECT event_id, user_id, recent FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent >= 2")
def _(t):
    return S.over_rate(t.events, 3600, 2).select("event_id", "user_id", "recent")


@add("t04_sliding_windows", "SELECT s AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '5 minutes', ts), time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes']) AS s FROM events) GROUP BY 1")
def _(t):
    return S.sliding(t.events, "10 minutes", "5 minutes")


@add("t02_changes_batch", _CHANGES)
def _(t):
    return S.changes_batch(t.events)


@add("t02_changes_stream", _CHANGES)
def _(t):
    stream = S.event_stream(t.spark, t.folder).withWatermark("ts", DELAY)
    return S.run_available(S.changes_stream(stream, "31 days"), "changes")


@add("t11_sessions_batch", _SESSIONS)
def _(t):
    return S.sessions(t.events, "30 minutes")


@add("t11_sessions_stream", _SESSIONS + " HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'")
def _(t):
    return S.run_available(S.sessions(S.event_stream(t.spark, t.folder).withWatermark("ts", DELAY), "30 minutes"), "sessions")


@add("t08_idempotent_stream", _FIRST)
def _(t):
    twice = S.event_stream(t.spark, t.folder).withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_k")
    d = S.run_available(S.first_in_time(twice, ["event_id"], "31 days"), "first")
    return d.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


QUERIES = book.queries
