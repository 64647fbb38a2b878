"""Queries for the streaming jobs (K).

Window and group jobs are checked in their batch form and, by the same SQL, as
a stream over the event log (``_live``); jobs with custom state run as a stream.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import jobs
from . import bindings as b
from .registry import ORACLES, query


def calls(spark, d):
    return b.events(spark, d).select(
        (F.col("user_id") % 5).alias("caller"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed")
    )


@query(
    "stream_rate_limit",
    """SELECT user_id % 5 AS caller, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS minute_us, count(*) AS calls, greatest(count(*) - 3, 0) AS refused FROM events GROUP BY 1, 2""",
)
def stream_rate_limit(spark, d):
    out = jobs.rate_limit(calls(spark, d), limit=3, minute="1 hour")
    return out.select("caller", b.micros("minute").alias("minute_us"), "calls", "refused")


@query(
    "stream_login_throttle",
    """WITH f AS (SELECT user_id % 5 AS caller, ts FROM events WHERE event_type = 'error'),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY caller ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM f),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY caller ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT caller, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 2 HOUR) AS ended_us, count(*) AS failures, count(*) >= 4 AS blocked FROM s GROUP BY caller, run""",
)
def stream_login_throttle(spark, d):
    out = jobs.login_throttle(calls(spark, d), limit=4, life="2 hours")
    return out.select("caller", b.micros("started").alias("started_us"), b.micros("ended").alias("ended_us"), "failures", "blocked")


@query(
    "stream_login_throttle_clear",
    """WITH RECURSIVE x AS (SELECT user_id % 5 AS caller, event_id AS seq, epoch_us(ts) AS us, event_type = 'error' AS failed,
      row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT caller, seq, n, false AS refused, CASE WHEN failed THEN 1 ELSE 0 END AS held, CASE WHEN failed THEN us + 7200000000 ELSE 0 END AS until FROM x WHERE n = 1
      UNION ALL
      SELECT caller, seq, n, full_now, CASE WHEN full_now THEN c WHEN failed THEN c + 1 ELSE 0 END,
        CASE WHEN full_now THEN until WHEN failed THEN us + 7200000000 ELSE 0 END
      FROM (SELECT x.caller, x.seq, x.n, x.us, x.failed, r.until, CASE WHEN x.us >= r.until THEN 0 ELSE r.held END AS c, c >= 4 AS full_now FROM r JOIN x ON x.caller = r.caller AND x.n = r.n + 1))
    SELECT caller, seq, refused FROM r""",
)
def stream_login_throttle_clear(spark, d):
    raw = event_stream(spark, d)
    logins = raw.select((F.col("user_id") % 5).alias("caller"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    out = jobs.run_available(jobs.throttle_with_clear(logins, limit=4, life_seconds=7200), "throttle")
    return out.select("caller", "seq", "refused")


@query(
    "stream_rate_10m",
    """WITH m AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS m FROM events WHERE event_type = 'purchase'),
    e AS (SELECT m + to_minutes(i) AS tick FROM m, (SELECT unnest(range(1, 11)) AS i))
    SELECT epoch_us(tick) AS at_us, count(*) AS n, round(count(*) / 10.0::DOUBLE, 6) AS rate FROM e GROUP BY 1""",
)
def stream_rate_10m(spark, d):
    out = jobs.rate_10m(b.events(spark, d).filter("event_type = 'purchase'"))
    return out.select(b.micros("at").alias("at_us"), "n", F.round("rate", 6).alias("rate"))


def event_stream(spark, d):
    return jobs.event_stream(spark, d, b.table(spark, d, "events").schema)


@query(
    "stream_debounce",
    """WITH RECURSIVE s AS (SELECT DISTINCT event_type AS scope, epoch_us(ts) // 1000000 AS second FROM events),
    r AS (SELECT scope, min(second) AS bump FROM s GROUP BY scope
      UNION ALL
      SELECT r.scope, greatest(min(s.second), r.bump + 3600) FROM r JOIN s ON s.scope = r.scope AND s.second > r.bump GROUP BY r.scope, r.bump)
    SELECT scope, bump FROM r""",
)
def stream_debounce(spark, d):
    changes = event_stream(spark, d).select(F.col("event_type").alias("scope"), "ts")
    return jobs.run_available(jobs.debounce(changes, every=3600), "debounce").select("scope", "bump")


def requests(events):
    return events.filter(F.col("event_type").isin("signup", "purchase")).select(
        F.col("user_id").alias("item_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "signup").alias("request")
    )


@query(
    "stream_notify_join",
    """WITH x AS (SELECT user_id AS item_id, event_id AS seq, ts, event_type = 'signup' AS request FROM events WHERE event_type IN ('signup', 'purchase')),
    y AS (SELECT *, lag(request) OVER w AS preq, lag(ts) OVER w AS pts, lag(seq) OVER w AS pseq FROM x WINDOW w AS (PARTITION BY item_id ORDER BY ts, seq))
    SELECT item_id, pseq AS request_seq, seq AS done_seq, epoch_us(ts) - epoch_us(pts) AS waited_us FROM y WHERE NOT request AND preq AND ts - pts <= INTERVAL 6 HOUR""",
)
def stream_notify_join(spark, d):
    return jobs.notify_join(requests(b.events(spark, d)))


@query(
    "stream_ingest",
    """WITH p AS (SELECT 'https://feeds.example/' || event_id % 1000003 AS url, event_id AS seq, sha256(props) AS sha256 FROM events),
    f AS (SELECT url, min(seq) AS seq, arg_min(sha256, seq) AS sha256 FROM p GROUP BY url)
    SELECT arg_min(url, seq) AS url, min(seq) AS seq, sha256 FROM f GROUP BY sha256""",
)
def stream_ingest(spark, d):
    raw = event_stream(spark, d)
    posts = raw.select(
        F.concat(F.lit("https://feeds.example/"), F.col("event_id") % 1000003).alias("url"), "ts", F.col("event_id").alias("seq"),
        F.sha2(F.col("props"), 256).alias("sha256"),
    )
    table = scratch_path(spark, "ingest")
    writer = jobs.ingest_to(posts, table).option("checkpointLocation", scratch_path(spark, "ingest-offsets"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table).select("url", "seq", "sha256")


@query(
    "stream_counters",
    "SELECT user_id AS owner, event_type AS outcome, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_counters(spark, d):
    return jobs.counters(b.events(spark, d).select(F.col("user_id").alias("owner"), F.col("event_type").alias("outcome")))


@query(
    "stream_retry_state",
    """WITH RECURSIVE x AS (SELECT user_id AS item_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'other' ELSE 'transient' END AS outcome,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT DISTINCT item_id, 0::BIGINT AS n, 'pending' AS status, 0::BIGINT AS attempts, 0::BIGINT AS transient, NULL::DOUBLE AS delay FROM x
      UNION ALL
      SELECT item_id, n, CASE WHEN o = 'done' THEN 'done' WHEN o = 'other' AND a >= 3 THEN 'failed' ELSE 'pending' END,
        CASE WHEN o = 'done' THEN 0 ELSE a END, CASE WHEN o = 'done' THEN 0 ELSE t END,
        CASE WHEN o = 'transient' THEN least(3600, 60 * power(2, least(t - 1, 6))) WHEN o = 'other' AND a < 3 THEN 60 * power(2, a - 1) END
      FROM (SELECT x.item_id, x.n, CASE WHEN x.outcome = 'transient' AND r.transient >= 12 THEN 'other' ELSE x.outcome END AS o,
          r.attempts + CASE WHEN o = 'other' THEN 1 ELSE 0 END AS a, r.transient + CASE WHEN o = 'transient' THEN 1 ELSE 0 END AS t
        FROM r JOIN x ON x.item_id = r.item_id AND x.n = r.n + 1))
    SELECT item_id, arg_max(status, n) AS status, arg_max(attempts, n) AS attempts, arg_max(transient, n) AS transient,
      max(struct_pack(n := n, delay := delay)).delay AS delay FROM r GROUP BY item_id""",
)
def stream_retry_state(spark, d):
    kind = F.col("event_type")
    failures = event_stream(spark, d).select(
        F.col("user_id").alias("item_id"), "ts", F.col("event_id").alias("seq"),
        F.when(kind == "purchase", "done").when(kind == "click", "other").otherwise("transient").alias("outcome"),
    )
    return jobs.run_available(jobs.retry_state(failures), "retries", "update").drop("batch")  # the table is one file, so one batch


@query(
    "stream_latest_state",
    "SELECT user_id AS item_id, arg_max(event_type, ts) AS status, epoch_us(max(ts)) AS at_us FROM events GROUP BY 1",
)
def stream_latest_state(spark, d):
    log = b.events(spark, d).select(F.col("user_id").alias("item_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return jobs.latest_state(log).select("item_id", "status", b.micros("ts").alias("at_us"))


# the same jobs run on a stream: what the last batch says of each key


@query("stream_rate_limit_live", ORACLES["stream_rate_limit"])
def stream_rate_limit_live(spark, d):
    raw = event_stream(spark, d).select((F.col("user_id") % 5).alias("caller"), "ts")
    out = jobs.newest(jobs.run_available(jobs.rate_limit(raw, limit=3, minute="1 hour"), "calls", "update"), ["caller", "minute"])
    return out.select("caller", b.micros("minute").alias("minute_us"), "calls", "refused")


@query("stream_rate_10m_live", ORACLES["stream_rate_10m"])
def stream_rate_10m_live(spark, d):
    done = event_stream(spark, d).filter("event_type = 'purchase'").select("ts")
    out = jobs.newest(jobs.run_available(jobs.rate_10m(done), "rate", "update"), ["at"])
    return out.select(b.micros("at").alias("at_us"), "n", F.round("rate", 6).alias("rate"))


@query("stream_latest_state_live", ORACLES["stream_latest_state"])
def stream_latest_state_live(spark, d):
    log = event_stream(spark, d).select(F.col("user_id").alias("item_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    out = jobs.newest(jobs.run_available(jobs.latest_state(log), "latest", "update"), ["item_id"])
    return out.select("item_id", "status", b.micros("ts").alias("at_us"))
