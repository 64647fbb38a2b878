"""Queries for reports (G), work selection (H) and the overview (L1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import classify_error
from ..operators import reports, work
from . import bindings as b
from .basics import TRANSIENT_SQL
from .ingest import load_events
from .registry import query

AS_OF = f"TIMESTAMP '{b.AS_OF}'"


def deliveries(spark, d):
    """Deliveries to three consumers, by document."""
    i = F.col("doc_id")
    return b.table(spark, d, "documents").filter(i % 3 != 0).select(
        (i % 3).alias("consumer"), i.alias("item_id"), F.when(i % 5 != 0, F.concat(F.lit("f"), i)).otherwise("").alias("file_id"),
        F.when(i % 5 == 0, "blocked").otherwise("").alias("error"), (i % 4).alias("attempts"),
    )


DELIVERIES_SQL = """
deliveries AS (SELECT doc_id % 3 AS consumer, doc_id AS item_id, CASE WHEN doc_id % 5 <> 0 THEN 'f' || doc_id ELSE '' END AS file_id,
  CASE WHEN doc_id % 5 = 0 THEN 'blocked' ELSE '' END AS error, doc_id % 4 AS attempts FROM documents WHERE doc_id % 3 <> 0)
"""


@query(
    "corpus_stats",
    f"""WITH {b.ITEMS_SQL} SELECT 'total' AS facet, '' AS key, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM items
    UNION ALL SELECT 'status', status, count(*), sum(size_bytes)::BIGINT FROM items GROUP BY status
    UNION ALL SELECT 'kind', kind, count(*), sum(size_bytes)::BIGINT FROM items GROUP BY kind
    UNION ALL SELECT 'provider', provider, count(*), sum(size_bytes)::BIGINT FROM items WHERE provider <> '' GROUP BY provider
    UNION ALL SELECT 'hidden', hidden::VARCHAR, count(*), sum(size_bytes)::BIGINT FROM items GROUP BY hidden""",
)
def corpus_stats(spark, d):
    return reports.corpus_stats(b.items(spark, d))


@query("status_counts", f"WITH {b.ITEMS_SQL} SELECT status, count(*) AS n FROM items GROUP BY ROLLUP (status)")
def status_counts(spark, d):
    return reports.status_counts(b.items(spark, d))


@query("recent_failures", f"WITH {b.ITEMS_SQL} SELECT id, error FROM items WHERE status = 'failed' ORDER BY updated_at DESC, id DESC LIMIT 10")
def recent_failures(spark, d):
    return reports.recent_failures(b.items(spark, d)).select("id", "error")


@query(
    "delivery_stats",
    f"""WITH {b.ITEMS_SQL}, {DELIVERIES_SQL} SELECT 'uploaded' AS metric, count(*) FILTER (WHERE visible AND delivery_id <> '') AS value FROM items
    UNION ALL SELECT 'waiting', count(*) FILTER (WHERE visible AND delivery_id = '' AND delivery_error = '') FROM items
    UNION ALL SELECT 'failed', count(*) FILTER (WHERE visible AND delivery_id = '' AND delivery_error <> '') FROM items
    UNION ALL SELECT 'relayed', count(*) FILTER (WHERE file_id <> '') FROM deliveries
    UNION ALL SELECT 'relay_failed', count(*) FILTER (WHERE error <> '') FROM deliveries""",
)
def delivery_stats(spark, d):
    return reports.delivery_stats(b.items(spark, d), deliveries(spark, d))


@query(
    "media_stats",
    f"""WITH {b.ITEMS_SQL}, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE media_ok) AS ok,
      count(*) FILTER (WHERE NOT media_ok AND media_error = '') AS todo, count(*) FILTER (WHERE NOT media_ok AND media_error <> '' AND media_attempts < 3) AS retrying,
      count(*) FILTER (WHERE NOT media_ok AND media_error <> '' AND media_attempts >= 3) AS failed,
      count(*) FILTER (WHERE NOT media_ok AND media_error = '' AND kind = 'video') AS videos FROM items WHERE thumb_path <> '')
    SELECT t.*, (SELECT count(*) FROM items WHERE kind = 'video' AND status = 'done' AND transcript = '' AND NOT speech_checked) AS speech,
      round(ok * 100.0::DOUBLE / total, 6) AS percent FROM t""",
)
def media_stats(spark, d):
    return reports.media_stats(b.items(spark, d))


@query(
    "media_failures",
    f"""WITH {b.ITEMS_SQL} SELECT id, kind, media_attempts::BIGINT AS attempts, epoch_us(media_failed_at) AS failed_us FROM items
    WHERE media_error <> '' ORDER BY media_failed_at DESC NULLS LAST, id DESC LIMIT 5""",
)
def media_failures(spark, d):
    return reports.media_failures(b.items(spark, d)).select(
        "id", "kind", F.col("media_attempts").cast("bigint").alias("attempts"), b.micros("media_failed_at").alias("failed_us")
    )


@query("analyzed_since", f"WITH {b.ITEMS_SQL} SELECT count(*) AS n FROM items WHERE analyzed_at > {AS_OF} - INTERVAL 1 DAY")
def analyzed_since(spark, d):
    return reports.analyzed_since(b.items(spark, d), b.as_of(), 86400)


@query(
    "throughput_eta",
    f"""WITH {b.ITEMS_SQL}, x AS (SELECT count(*) FILTER (WHERE status IN ('pending', 'processing')) AS left_over,
      count(*) FILTER (WHERE analyzed_at > {AS_OF} - INTERVAL 1 HOUR) AS per_hour FROM items)
    SELECT left_over, per_hour, CASE WHEN per_hour > 0 THEN round(left_over / per_hour::DOUBLE, 6) END AS hours FROM x""",
)
def throughput_eta(spark, d):
    return reports.throughput_eta(b.items(spark, d), b.as_of())


def job_events(spark, d):
    """Jobs from the event log: lane by user, state by event type."""
    u = F.col("user_id")
    kind = F.col("event_type")
    return b.events(spark, d).select(
        F.col("event_id").alias("job_id"), F.when(u % 3 == 0, "high").when(u % 3 == 1, "mid").otherwise("low").alias("lane"),
        F.when(kind == "error", "delayed").when(kind == "click", "in_flight").otherwise("waiting").alias("state"),
    )


@query(
    "backlog",
    """SELECT CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE 'low' END AS lane,
    CASE event_type WHEN 'error' THEN 'delayed' WHEN 'click' THEN 'in_flight' ELSE 'waiting' END AS state, count(*) AS n FROM events GROUP BY 1, 2""",
)
def backlog(spark, d):
    return reports.backlog(job_events(spark, d))


@query(
    "loads_recent",
    "SELECT user_id AS load, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 5",
)
def loads_recent(spark, d):
    return reports.loads_recent(load_events(spark, d).groupBy("load").agg(F.count("*").alias("n")))


@query("feeds_list", f"WITH {b.FEEDS_SQL} SELECT feed_id, name, enabled, added, filtered FROM feeds")
def feeds_list(spark, d):
    return reports.feeds_list(b.feeds(spark, d)).select("feed_id", "name", "enabled", "added", "filtered")


# --- work -------------------------------------------------------------------


@query(
    "select_scope",
    f"""WITH {b.ITEMS_SQL}, s AS (SELECT 'failed' AS scope, * FROM items WHERE status = 'failed'
      UNION ALL SELECT 'transient', * FROM items WHERE status = 'failed' AND regexp_matches(error, '(?i){TRANSIENT_SQL}')
      UNION ALL SELECT 'pending', * FROM items WHERE status = 'pending'
      UNION ALL SELECT 'stuck', * FROM items WHERE status IN ('processing', 'pending') AND updated_at < {AS_OF} - INTERVAL 30 MINUTE
      UNION ALL SELECT 'all', * FROM items UNION ALL SELECT 'done', * FROM items WHERE status = 'done')
    SELECT scope, id, CASE WHEN status = 'done' THEN 'done' ELSE 'pending' END AS status FROM s""",
)
def select_scope(spark, d):
    return work.select_scopes(b.items(spark, d), b.as_of()).select("scope", "id", "status")


@query("scope_ids", f"WITH {b.ITEMS_SQL} SELECT id FROM items WHERE status IN ('done', 'failed')")
def scope_ids(spark, d):
    return work.scope_ids(b.items(spark, d), "all")


@query(
    "stale_jobs",
    f"""WITH {b.ITEMS_SQL}, p AS (SELECT id FROM items WHERE (status = 'processing' AND updated_at < {AS_OF} - INTERVAL 30 MINUTE)
      OR (status = 'pending' AND updated_at < {AS_OF} - INTERVAL 30 MINUTE) ORDER BY id LIMIT 5000)
    SELECT id FROM p WHERE id NOT IN (SELECT doc_id FROM labels)""",
)
def stale_jobs(spark, d):
    locked = b.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return work.stale_jobs(b.items(spark, d), locked, b.as_of())


@query(
    "auto_retry",
    f"""WITH {b.ITEMS_SQL} SELECT id, (auto_retries + 1)::BIGINT AS auto_retries FROM items WHERE status = 'failed' AND auto_retries < 3
    AND regexp_matches(error, '(?i){TRANSIENT_SQL}') AND updated_at < {AS_OF} - to_minutes(15 * (auto_retries + 1)) ORDER BY id LIMIT 500""",
)
def auto_retry(spark, d):
    return work.auto_retry(b.items(spark, d), b.as_of()).withColumn("auto_retries", F.col("auto_retries").cast("bigint"))


@query(
    "media_retry_due",
    f"""WITH {b.ITEMS_SQL} SELECT id FROM items WHERE media_error <> '' AND media_attempts < 3
    AND epoch_us(media_failed_at) < epoch_us({AS_OF}) - (600000000 * power(3, media_attempts - 1))::BIGINT""",
)
def media_retry_due(spark, d):
    return work.media_retry_due(b.items(spark, d), b.as_of())


@query(
    "repair_todo",
    f"WITH {b.ITEMS_SQL} SELECT id FROM items WHERE NOT media_ok AND media_error = '' AND thumb_path <> '' ORDER BY id DESC LIMIT 20",
)
def repair_todo(spark, d):
    return work.repair_todo(b.items(spark, d))


@query(
    "hash_todo",
    f"WITH {b.ITEMS_SQL} SELECT id FROM items WHERE id % 3 = 0 AND thumb_path <> '' AND id > (SELECT max(id) * 9 // 10 FROM items) // 9 ORDER BY id LIMIT 500",
)
def hash_todo(spark, d):
    missing = F.when(F.col("id") % 3 != 0, F.array(F.lit(1).cast("bigint")))
    return work.hash_todo(b.items(spark, d).withColumn("phash", missing), after_id=b.cursor(spark, d) // 9)


@query(
    "speech_todo",
    f"WITH {b.ITEMS_SQL} SELECT id FROM items WHERE kind = 'video' AND status = 'done' AND transcript = '' AND NOT speech_checked ORDER BY id DESC LIMIT 10",
)
def speech_todo(spark, d):
    return work.speech_todo(b.items(spark, d))


@query(
    "delivery_todo",
    f"""WITH {b.ITEMS_SQL} SELECT id, (id IN (SELECT item_id * 5 FROM benchmark))::INT::BIGINT AS priority FROM items
    WHERE delivery_id = '' AND delivery_error = '' AND visible ORDER BY priority DESC, id DESC LIMIT 30""",
)
def delivery_todo(spark, d):
    asked = b.table(spark, d, "benchmark").select((F.col("item_id") * 5).alias("id"))
    return work.delivery_todo(b.items(spark, d), asked).select("id", F.col("priority").cast("bigint").alias("priority"))


@query(
    "relay_todo",
    f"""WITH {b.ITEMS_SQL}, {DELIVERIES_SQL} SELECT id FROM items WHERE delivery_id <> '' AND visible AND id < (SELECT max(id) * 9 // 10 FROM items)
    AND id NOT IN (SELECT item_id FROM deliveries WHERE consumer = 2) ORDER BY id DESC LIMIT 30""",
)
def relay_todo(spark, d):
    return work.relay_todo(b.items(spark, d), deliveries(spark, d), consumer=2, before_id=b.cursor(spark, d))


@query(
    "delivery_retry_due",
    f"""WITH {b.ITEMS_SQL} SELECT id FROM items WHERE delivery_error <> '' AND delivery_attempts < 3
    AND delivery_failed_at < {AS_OF} - to_hours(delivery_attempts)""",
)
def delivery_retry_due(spark, d):
    return work.delivery_retry_due(b.items(spark, d), b.as_of())


@query(
    "delivery_upsert",
    f"""WITH {DELIVERIES_SQL}, n AS (SELECT user_id % 3 AS consumer, user_id AS item_id, arg_max(CASE WHEN event_type = 'error' THEN '' ELSE 'n' || event_id END, event_id) AS file_id,
      arg_max(CASE WHEN event_type = 'error' THEN 'blocked' ELSE '' END, event_id) AS error, count(*) FILTER (WHERE event_type = 'error') AS more FROM events GROUP BY 1, 2)
    SELECT coalesce(d.consumer, n.consumer) AS consumer, coalesce(d.item_id, n.item_id) AS item_id, coalesce(n.file_id, d.file_id) AS file_id,
      coalesce(n.error, d.error) AS error, coalesce(d.attempts, 0) + coalesce(n.more, 0) AS attempts
    FROM deliveries d FULL JOIN n ON d.consumer = n.consumer AND d.item_id = n.item_id""",
)
def delivery_upsert(spark, d):
    bad = F.col("event_type") == "error"
    new = b.events(spark, d).select(
        (F.col("user_id") % 3).alias("consumer"), F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"),
        F.when(bad, "").otherwise(F.concat(F.lit("n"), "event_id")).alias("file_id"), F.when(bad, "blocked").otherwise("").alias("error"),
    )
    return work.delivery_upsert(deliveries(spark, d), new)


@query(
    "due_feeds",
    f"""WITH {b.FEEDS_SQL} SELECT feed_id, epoch_us({AS_OF} + INTERVAL 30 MINUTE) AS next_us FROM feeds
    WHERE enabled AND next_poll_at <= {AS_OF} ORDER BY next_poll_at, feed_id LIMIT 20""",
)
def due_feeds(spark, d):
    return work.due_feeds(b.feeds(spark, d), b.as_of()).select("feed_id", b.micros("next_poll_at").alias("next_us"))


@query(
    "backoff",
    """WITH x AS (SELECT user_id AS key, event_id AS seq, ts, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    y AS (SELECT *, coalesce(max(CASE WHEN NOT failed THEN n END) OVER (PARTITION BY key ORDER BY n), 0) AS good FROM x),
    z AS (SELECT key, seq, CASE WHEN failed THEN n - good ELSE 0 END AS streak FROM y)
    SELECT key, seq, streak, least(power(2, streak - 1), 30)::DOUBLE AS feed_minutes, CASE WHEN streak >= 6 THEN 'failed' ELSE 'pending' END AS feed_status,
      (60 * power(2, streak - 1))::DOUBLE AS item_seconds, least(3600, 60 * power(2, least(streak - 1, 6)))::DOUBLE AS passing_seconds FROM z WHERE streak > 0""",
)
def backoff(spark, d):
    polls = b.events(spark, d).select(
        F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed")
    )
    s = F.col("streak")
    minutes, status = work.feed_backoff(s)
    return work.failure_streaks(polls).filter("streak > 0").select(
        "key", "seq", s.cast("bigint").alias("streak"), minutes.alias("feed_minutes"), status.alias("feed_status"),
        work.item_backoff(s).alias("item_seconds"), work.transient_backoff(s).alias("passing_seconds"),
    )


@query(
    "fail_or_retry",
    f"""WITH {b.ITEMS_SQL}, x AS (SELECT id, status, attempts, id % 16 + 1 AS n, CASE WHEN id % 9 = 0 THEN 300.0 END AS delay,
      CASE id % 7 WHEN 0 THEN 'limit' WHEN 1 THEN 'auth' WHEN 2 THEN 'transient' WHEN 3 THEN 'transient' WHEN 5 THEN 'transient' ELSE 'other' END AS c FROM items),
    y AS (SELECT *, c = 'transient' AND n <= 12 AS passing, NOT (c = 'transient' AND n <= 12) AND c NOT IN ('limit', 'auth') AS counted FROM x),
    z AS (SELECT *, counted AND attempts >= 3 AS dead FROM y)
    SELECT id, c AS error_class, CASE WHEN dead THEN CASE WHEN status = 'done' THEN 'done' ELSE 'failed' END WHEN status IN ('processing', 'pending') THEN 'pending' ELSE status END AS status,
      CASE WHEN counted THEN attempts ELSE greatest(attempts - 1, 0) END AS attempts,
      CASE WHEN dead THEN NULL WHEN passing THEN least(3600.0, 60 * power(2, least(n - 1, 6))) ELSE coalesce(delay, 60 * power(2, greatest(attempts - 1, 0))) END::DOUBLE AS delay FROM z""",
)
def fail_or_retry(spark, d):
    i = F.col("id")
    errors = F.element_at(F.array(*[F.lit(e) for e in b.ERRORS]), (i % 7 + 1).cast("int"))
    failures = b.items(spark, d).select(
        "id", "status", "attempts", (i % 16).alias("transient_count"), classify_error(errors).alias("error_class"),
        F.when(i % 9 == 0, F.lit(300.0)).alias("delay"),
    )
    out = work.fail_or_retry(failures)
    return out.select("id", "error_class", "status", F.col("attempts").cast("bigint").alias("attempts"), "delay")


@query(
    "skip_superseded",
    f"""WITH {b.ITEMS_SQL}, j AS (SELECT e.event_id AS job_id, i.*, i.id AS item_id, e.event_id % 3 <> 0 OR i.analyzed_at IS NULL AS want, e.event_id % 5 AS k,
      i.id IN (SELECT vec_id FROM embeddings) AND i.id IN (SELECT vec_id - 1 FROM embeddings) AS embedded FROM events e JOIN items i ON i.id = e.user_id),
    x AS (SELECT *, want AND coalesce(analyzed_at >= {AS_OF} - to_minutes(k * 600), false) AS late FROM j)
    SELECT job_id, item_id, CASE WHEN late AND status = 'done' AND embedded THEN 'skip' WHEN late OR locked OR NOT want THEN 'embed' ELSE 'full' END AS action FROM x""",
)
def skip_superseded(spark, d):
    e = F.col("event_id")
    jobs = b.events(spark, d).select(
        e.alias("job_id"), F.col("user_id").alias("item_id"), (e % 3 != 0).alias("analyze"), b.minutes_before(e % 5 * 600).alias("queued_at")
    )
    return work.skip_superseded(jobs, b.items_with_vectors(spark, d))


@query(
    "cleanup_deleted",
    """SELECT doc_id AS id, toxic = 1 AS gone FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def cleanup_deleted(spark, d):
    flags = b.table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_deleted"))
    media = b.table(spark, d, "documents").join(flags, "doc_id", "left").select(F.col("doc_id").alias("id"), "is_deleted")
    gone, left = work.cleanup_deleted(media)
    return gone.select("id", F.lit(True).alias("gone")).unionByName(left.select("id", F.lit(False).alias("gone")))


@query(
    "reset_failures",
    f"""WITH {b.ITEMS_SQL}, {DELIVERIES_SQL} SELECT 'changed' AS part, (SELECT count(*) FROM items WHERE delivery_id = '' AND delivery_error <> '') AS uploads,
      (SELECT count(*) FROM items WHERE media_error <> '') AS media, (SELECT count(*) FROM deliveries WHERE error <> '') AS relays
    UNION ALL SELECT 'left', (SELECT count(*) FROM items WHERE delivery_error <> '' AND delivery_id <> ''), 0, 0""",
)
def reset_failures(spark, d):
    fixed, kept, changed = work.reset_failures(b.items(spark, d), deliveries(spark, d))
    left = fixed.agg(F.count_if(F.col("delivery_error") != "").alias("uploads"), F.count_if(F.col("media_error") != "").alias("media"))
    relays = kept.agg(F.count_if(F.col("error") != "").alias("relays"))
    return changed.select(F.lit("changed").alias("part"), "uploads", "media", "relays").unionByName(
        left.join(F.broadcast(relays)).select(F.lit("left").alias("part"), "uploads", "media", "relays")
    )


@query(
    "assign_lane",
    f"""WITH {b.ITEMS_SQL} SELECT e.event_id AS job_id, CASE WHEN e.event_type = 'signup' THEN 'high' WHEN i.source IN ('zip', 'inbox', 'upload') THEN 'mid' ELSE 'low' END AS lane
    FROM events e JOIN items i ON i.id = e.user_id""",
)
def assign_lane(spark, d):
    jobs = b.events(spark, d).join(b.items(spark, d).select(F.col("id").alias("user_id"), "source"), "user_id")
    jobs = jobs.select(F.col("event_id").alias("job_id"), "source", (F.col("event_type") == "signup").alias("explicit"), F.col("ts").alias("queued_at"))
    return work.assign_lane(jobs).select("job_id", "lane")


@query(
    "admin_overview",
    """WITH u AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS t FROM customer), m AS (SELECT o_orderkey AS id, o_orderpriority AS name, o_orderdate AS t FROM orders)
    SELECT 'users' AS part, '' AS key, count(*) AS value FROM u UNION ALL SELECT 'media', '', count(*) FROM m
    UNION ALL SELECT 'active_prompts', '', count(*) FROM part WHERE p_size > 25
    UNION ALL (SELECT 'newest_user', name, id FROM u ORDER BY t DESC, id DESC LIMIT 5) UNION ALL (SELECT 'newest_media', name, id FROM m ORDER BY t DESC, id DESC LIMIT 5)""",
)
def admin_overview(spark, d):
    users = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("created_at"))
    media = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("created_at"))
    prompts = b.table(spark, d, "part").select((F.col("p_size") > 25).alias("is_active"))
    return reports.admin_overview(users, media, prompts)
