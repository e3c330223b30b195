"""Query of navigation sessions: the events of each user as fixes, new routes and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.plans.registry import query
from umbra.streaming import session

_KIND = "CASE WHEN event_id % 23 = 0 THEN 'route' WHEN event_id % 11 = 1 THEN 'error' ELSE 'fix' END"


def _events(read):
    c = F.col
    n = c("event_id")
    return read("events").select(
        "user_id", "event_id", c("ts").cast("timestamp").alias("ts"), F.expr(_KIND).alias("kind"), (n * 13 % 900).cast("double").alias("along_m"), (n * 7 % 90).cast("double").alias("offset_m"),
        (n % 130).cast("double").alias("accuracy_m"), (n * 3 % 800 + 10).cast("double").alias("direct_m"), (900 + c("user_id") % 300).cast("double").alias("total_m"), (n % 4 != 3).alias("in_area"),
    )


@query("stm_02_sessions", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_ms(ts) AS now, {_KIND} AS kind, (event_id * 13 % 900)::DOUBLE AS along, (event_id * 7 % 90)::DOUBLE AS off, (event_id % 130)::DOUBLE AS acc,
        (event_id * 3 % 800 + 10)::DOUBLE AS direct, (900 + user_id % 300)::DOUBLE AS total, event_id % 4 <> 3 AS inside, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::DOUBLE AS along, 0 AS strikes, false AS waits, 0::BIGINT AS quiet, false AS arrived, '' AS action, NULL::DOUBLE AS total FROM e WHERE i = 1
        UNION ALL SELECT user_id, i, event_id, CASE WHEN action = 'route' THEN NULL WHEN moves AND (off <= 20 OR was IS NULL) THEN place ELSE was END, CASE WHEN action IN ('route', 'reroute', 'outside') THEN 0 ELSE strikes END,
            CASE WHEN action IN ('route', 'failed') THEN false WHEN action = 'reroute' THEN true ELSE waits END,
            CASE action WHEN 'route' THEN now + 8000 WHEN 'failed' THEN now + 15000 WHEN 'outside' THEN now + 60000 ELSE quiet END, arrived OR (moves AND there), CASE WHEN moves AND there THEN 'arrived' ELSE action END, total FROM (
            SELECT *, action = 'progress' AS moves, direct <= 15 OR (off <= 35 AND total - least(total, greatest(0.0, CASE WHEN off <= 20 OR was IS NULL THEN place ELSE was END)) <= 15) AS there FROM (
                SELECT *, CASE WHEN kind = 'route' THEN 'route' WHEN kind = 'error' THEN CASE WHEN waits THEN 'failed' ELSE 'ignored' END WHEN arrived THEN 'ignored' WHEN counts AND strikes >= 3 THEN CASE WHEN inside THEN 'reroute' ELSE 'outside' END
                    WHEN waits THEN 'waiting' ELSE 'progress' END AS action FROM (
                    SELECT e.user_id, e.i, e.event_id, e.now, e.kind, e.along AS place, e.off, e.direct, e.total, e.inside, s.along AS was, s.waits, s.quiet, s.arrived,
                        kind = 'fix' AND NOT s.arrived AND NOT s.waits AND e.now >= s.quiet AND acc <= 100 AS counts,
                        CASE WHEN kind = 'fix' AND NOT s.arrived AND NOT s.waits AND e.now >= s.quiet AND acc <= 100 THEN CASE WHEN off > greatest(35, acc) THEN s.strikes + 1 ELSE 0 END ELSE s.strikes END AS strikes
                    FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))))
    SELECT event_id, action, along AS along_m, CASE WHEN along IS NOT NULL THEN total - least(total, greatest(0.0, along)) END AS remaining_m, strikes FROM s WHERE i > 0""")
def _(read):
    events = _events(read)
    return session.replayed(events.sparkSession, events).select("event_id", "action", "along_m", "remaining_m", "strikes")
