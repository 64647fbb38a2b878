"""Work selection, retries and job state as table jobs (H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import transient_error
from ..model import is_visible
from ..scale import broadcast_if_small
from .labels import reset_status

IMPORT_SOURCES = ("zip", "inbox", "upload")
SCOPES = ("failed", "transient", "pending", "stuck", "all", "done")
MAX_ATTEMPTS = 3


def before(as_of: Column, minutes: int | Column) -> Column:
    """The instant ``minutes`` before ``as_of``, as microseconds."""
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.unix_micros(as_of) - (m.cast("double") * 60_000_000).cast("bigint")


def older(col: str, as_of: Column, minutes: int | Column) -> Column:
    return F.unix_micros(col) < before(as_of, minutes)


def in_scope(scope: str, as_of: Column) -> Column:
    """H1: the rows a reset of this scope covers."""
    status = F.col("status")
    return {
        "failed": status == "failed",
        "transient": (status == "failed") & transient_error("error"),
        "pending": status == "pending",
        "stuck": status.isin("processing", "pending") & older("updated_at", as_of, 30),
        "all": F.lit(True),
        "done": status == "done",
    }[scope]


def select_scope(items: DataFrame, scope: str, as_of: Column) -> DataFrame:
    """H1: the chosen items after their reset; finished ones stay finished."""
    return _reset(items.filter(in_scope(scope, as_of)), as_of)


def select_scopes(items: DataFrame, as_of: Column, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """H1 for several scopes in one pass over the items: a row with its ``scope`` for each that covers the item."""
    named = F.array(*[F.when(in_scope(s, as_of), F.lit(s)) for s in scopes])
    return _reset(items.select("*", F.explode(F.array_compact(named)).alias("scope")), as_of)


def _reset(items: DataFrame, as_of: Column) -> DataFrame:
    return items.withColumns({"status": reset_status(), "error": F.lit(""), "attempts": F.lit(0), "updated_at": as_of})


def scope_ids(items: DataFrame, scope: str) -> DataFrame:
    """H2: ids to embed again: finished ones, with "all" also failed ones."""
    wanted = ("done", "failed") if scope == "all" else ("done",)
    return items.filter(F.col("status").isin(*wanted)).select("id").orderBy("id")


def stale_jobs(
    items: DataFrame, locked: DataFrame, as_of: Column, timeout: int = 900, startup: bool = False, drained: bool = True,
    limit: int = 5000,
) -> DataFrame:
    """H3: items stuck in work and not held by a worker, by id."""
    working = (F.col("status") == "processing") & (F.lit(startup) | older("updated_at", as_of, timeout * 2 // 60))
    waiting = F.lit(drained) & (F.col("status") == "pending") & older("updated_at", as_of, 30)
    page = items.filter(working | waiting).select("id").orderBy("id").limit(limit)
    return page.join(broadcast_if_small(locked.select("id")), "id", "left_anti")


def auto_retry(items: DataFrame, as_of: Column, retries: int = 3, limit: int = 500) -> DataFrame:
    """H4: items that failed on a passing error and waited 15 minutes more each time."""
    due = (
        (F.col("status") == "failed")
        & (F.col("auto_retries") < retries)
        & transient_error("error")
        & older("updated_at", as_of, (F.col("auto_retries") + 1) * 15)
    )
    return items.filter(due).select("id", (F.col("auto_retries") + 1).alias("auto_retries")).orderBy("id").limit(limit)


def media_retry_due(items: DataFrame, as_of: Column, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """H5: media errors whose wait (10 minutes, three times longer each time) is over."""
    wait = F.pow(F.lit(3.0), F.col("media_attempts") - 1) * 10
    due = (F.col("media_error") != "") & (F.col("media_attempts") < attempts) & older("media_failed_at", as_of, wait)
    return items.filter(due).select("id")


def repair_todo(items: DataFrame, limit: int = 20) -> DataFrame:
    """H6: items whose media was not checked, newest first."""
    todo = ~F.col("media_ok") & (F.col("media_error") == "") & (F.col("thumb_path") != "")
    return items.filter(todo).select("id").orderBy(F.desc("id")).limit(limit)


def hash_todo(items: DataFrame, after_id: int = 0, limit: int = 500) -> DataFrame:
    """H6: items without a hash after the cursor, in order."""
    todo = F.col("phash").isNull() & (F.col("thumb_path") != "") & (F.col("id") > after_id)
    return items.filter(todo).select("id").orderBy("id").limit(limit)


def speech_todo(items: DataFrame, limit: int = 10) -> DataFrame:
    """H6: finished videos never transcribed, newest first."""
    todo = (F.col("kind") == "video") & (F.col("status") == "done") & (F.col("transcript") == "") & ~F.col("speech_checked")
    return items.filter(todo).select("id").orderBy(F.desc("id")).limit(limit)


def delivery_todo(items: DataFrame, asked: DataFrame, limit: int = 30) -> DataFrame:
    """H7: visible items not yet uploaded, asked-for ids first."""
    open_items = items.filter((F.col("delivery_id") == "") & (F.col("delivery_error") == "") & is_visible())
    first = asked.select("id", F.lit(1).alias("priority")).distinct()
    out = open_items.select("id").join(broadcast_if_small(first), "id", "left").na.fill(0, ["priority"])
    return out.orderBy(F.desc("priority"), F.desc("id")).limit(limit)


def relay_todo(items: DataFrame, deliveries: DataFrame, consumer: int, before_id: int = 1 << 62, limit: int = 30) -> DataFrame:
    """H8: uploaded visible items this consumer has not got, newest first."""
    have = deliveries.filter(F.col("consumer") == consumer).select(F.col("item_id").alias("id"))
    ready = items.filter((F.col("delivery_id") != "") & is_visible() & (F.col("id") < before_id)).select("id")
    return ready.join(have, "id", "left_anti").orderBy(F.desc("id")).limit(limit)


def delivery_retry_due(items: DataFrame, as_of: Column, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """H9: failed uploads that waited an hour per attempt."""
    due = (
        (F.col("delivery_error") != "")
        & (F.col("delivery_attempts") < attempts)
        & older("delivery_failed_at", as_of, F.col("delivery_attempts") * 60)
    )
    return items.filter(due).select("id")


def delivery_upsert(deliveries: DataFrame, results: DataFrame) -> DataFrame:
    """Deliveries after new results; failed attempts add up, the latest result stays."""
    keys = ["consumer", "item_id"]
    new = results.groupBy(*keys).agg(
        F.max(F.struct("seq", "file_id", "error")).alias("last"),
        F.count_if(F.col("error") != "").cast("bigint").alias("more"),
    )
    both = deliveries.join(new, keys, "full")
    return both.select(
        *keys,
        F.coalesce("last.file_id", "file_id").alias("file_id"),
        F.substring(F.coalesce("last.error", "error"), 1, 500).alias("error"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("attempts"),
    )


def due_feeds(feeds: DataFrame, as_of: Column, minutes: int = 30, limit: int = 20) -> DataFrame:
    """Feeds to poll now, longest waiting first, with their next time."""
    due = feeds.filter(F.col("enabled") & (F.col("next_poll_at") <= as_of))
    page = due.orderBy("next_poll_at", "feed_id").limit(limit)
    return page.select("feed_id", F.timestamp_micros(before(as_of, -minutes)).alias("next_poll_at"))


def item_backoff(attempts: Column) -> Column:
    """Seconds to wait after a counted failure: 60, 120, 240, …"""
    return F.lit(60) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0)))


def transient_backoff(n: Column) -> Column:
    """Seconds to wait after the n-th passing error, at most an hour."""
    return F.least(F.lit(3600.0), F.lit(60) * F.pow(F.lit(2.0), F.least(n - 1, F.lit(6))))


def feed_backoff(streak: Column, poll_minutes: int = 30) -> tuple[Column, Column]:
    """Minutes to wait after the n-th network failure in a row, and the feed's status."""
    wait = F.least(F.pow(F.lit(2.0), streak - 1), F.lit(float(poll_minutes)))
    return wait, F.when(streak >= 6, "failed").otherwise("pending")


def failure_streaks(polls: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """``streak`` of failures in a row up to each poll ``key, ts, seq, failed``.

    A streak is the distance to the last good poll.  A busy key is cut into
    time buckets: polls are numbered inside their bucket, and only one summary
    row per bucket is carried along the key.
    """
    bucket = F.floor(F.unix_micros("ts") / (bucket_seconds * 1_000_000)).alias("bucket")
    inside = Window.partitionBy("key", "bucket").orderBy("ts", "seq")
    rows = polls.select("*", bucket)
    rows = rows.withColumn("n", F.row_number().over(inside))
    rows = rows.withColumn("good", F.max(F.when(~F.col("failed"), F.col("n"))).over(inside))
    sums = rows.groupBy("key", "bucket").agg(F.max("n").alias("size"), F.max("good").alias("last_good"))
    past = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("size").over(past), F.lit(0)))
    sums = sums.withColumn("carry", F.coalesce(F.max(F.col("start") + F.col("last_good")).over(past), F.lit(0)))
    at = rows.join(sums.select("key", "bucket", "start", "carry"), ["key", "bucket"])
    last = F.coalesce(F.col("start") + F.col("good"), F.col("carry"))
    streak = F.when(F.col("failed"), F.col("start") + F.col("n") - last).otherwise(0)
    return at.withColumn("streak", streak).select(*polls.columns, "streak")


def fail_or_retry(failures: DataFrame, max_attempts: int = MAX_ATTEMPTS, max_transient: int = 12) -> DataFrame:
    """Next ``status, attempts, delay`` of failed jobs.

    ``failures`` is ``status, attempts, error_class, transient_count, delay``
    with the attempt already counted.  A passing error gives the attempt back
    until it has happened too often; a NULL delay doubles from a minute.
    """
    n = F.col("transient_count") + 1
    passing = (F.col("error_class") == "transient") & (n <= max_transient)
    waiting = F.col("error_class").isin("limit", "auth")
    counted = ~(passing | waiting)
    attempts = F.when(counted, F.col("attempts")).otherwise(F.greatest(F.col("attempts") - 1, F.lit(0)))
    dead = counted & (F.col("attempts") >= max_attempts)
    delay = (
        F.when(dead, None)
        .when(passing, transient_backoff(n))
        .otherwise(F.coalesce("delay", item_backoff(F.col("attempts"))))
    )
    status = (
        F.when(dead, F.when(F.col("status") == "done", "done").otherwise("failed"))
        .when(F.col("status").isin("processing", "pending"), "pending")
        .otherwise(F.col("status"))
    )
    return failures.select(
        *[c for c in failures.columns if c not in ("status", "attempts", "delay", "transient_count")],
        status.alias("status"),
        attempts.alias("attempts"),
        delay.alias("delay"),
        F.when(passing, n).otherwise(F.col("transient_count")).alias("transient_count"),
    )


def skip_superseded(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """``action`` of every job: ``skip``, ``embed`` or ``full``; unknown items drop out."""
    facts = items.select(
        F.col("id").alias("item_id"), "analyzed_at", "status", "locked",
        (F.col("clip_vec").isNotNull() & F.col("text_vec").isNotNull()).alias("embedded"),
    )
    out = jobs.join(facts, "item_id")
    full = F.col("analyze") | F.col("analyzed_at").isNull()
    late = full & F.coalesce(F.col("analyzed_at") >= F.col("queued_at"), F.lit(False))
    action = (
        F.when(late & (F.col("status") == "done") & F.col("embedded"), "skip")
        .when(late | F.col("locked") | ~full, "embed")
        .otherwise("full")
    )
    return out.select("job_id", "item_id", action.alias("action"))


def cleanup_deleted(media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows marked as deleted, and the rows that stay."""
    gone = F.coalesce(F.col("is_deleted"), F.lit(False))
    return media.filter(gone), media.filter(~gone)


def reset_failures(items: DataFrame, deliveries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items and deliveries ready for another try, and how many rows changed."""
    upload = (F.col("delivery_id") == "") & (F.col("delivery_error") != "")
    media = F.col("media_error") != ""
    fixed = (
        items.withColumn("delivery_attempts", F.when(upload, 0).otherwise(F.col("delivery_attempts")))
        .withColumn("delivery_error", F.when(upload, "").otherwise(F.col("delivery_error")))
        .withColumn("media_attempts", F.when(media, 0).otherwise(F.col("media_attempts")))
        .withColumn("media_error", F.when(media, "").otherwise(F.col("media_error")))
    )
    kept = deliveries.filter("error = ''")
    changed = items.agg(F.count_if(upload).alias("uploads"), F.count_if(media).alias("media")).join(
        F.broadcast(deliveries.agg(F.count_if(F.col("error") != "").alias("relays")))
    )
    return fixed, kept, changed


def assign_lane(jobs: DataFrame) -> DataFrame:
    """Explicit requests high, imported work in the middle, other work low."""
    lane = (
        F.when(F.col("explicit"), "high").when(F.col("source").isin(*IMPORT_SOURCES), "mid").otherwise("low")
    )
    order = F.when(lane == "high", 0).when(lane == "mid", 1).otherwise(2)
    return jobs.withColumn("lane", lane).withColumn("_order", order).orderBy("_order", "queued_at", "job_id").drop("_order")
