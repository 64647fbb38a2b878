"""Feed cursors, history, links and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..scale import broadcast_if_small, first_per_key, top_k

BATCH = 300
MAX_SECONDS = 180


def incremental_posts(posts: DataFrame, feeds: DataFrame, batch: int = BATCH) -> DataFrame:
    """A10: posts after each feed's cursor, in ascending order.

    A feed without a cursor gets only its newest posts, at most
    ``min(batch, backfill_limit)`` (a limit of 0 means no limit of its own).
    """
    cursor = broadcast_if_small(feeds.select("feed_id", "last_post_id", "backfill_limit"))
    unique = posts.dropDuplicates(["feed_id", "post_id"])
    joined = unique.join(cursor, "feed_id").filter(F.col("post_id") > F.col("last_post_id"))
    later = joined.filter("last_post_id > 0")
    own = F.when(F.col("backfill_limit") > 0, F.least(F.col("backfill_limit"), F.lit(batch))).otherwise(batch)
    newest = top_k(joined.filter("last_post_id = 0"), ["feed_id"], [F.desc("post_id")], batch, "k")
    first = newest.filter(F.col("k") <= own).drop("k")
    return later.unionByName(first).drop("last_post_id", "backfill_limit").orderBy("feed_id", "post_id")


def history_backfill(posts: DataFrame, feeds: DataFrame, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Older posts to load now, and the state of each feed's history after it.

    ``posts`` is ``feed_id, post_id, failed``.  Posts before the oldest known
    one are taken newest first within the budget; the first failed one stops
    the feed and is tried again next time.
    """
    limit, have = F.col("backfill_limit"), F.col("history_posts")
    budget = F.when(limit > 0, F.least(F.lit(batch), limit - have)).otherwise(batch)
    before = F.when(F.col("oldest_post_id") > 0, F.col("oldest_post_id")).otherwise(F.col("last_post_id") + 1)
    open_feeds = feeds.filter("not history_done").select(
        "feed_id", "oldest_post_id", "history_posts", "backfill_limit", budget.alias("budget"), before.alias("before")
    )
    older = posts.join(broadcast_if_small(open_feeds.select("feed_id", "budget", "before")), "feed_id").filter(
        "post_id < before"
    )
    counts = older.groupBy("feed_id").agg(F.count(F.lit(1)).alias("older"))
    chosen = top_k(older, ["feed_id"], [F.desc("post_id")], batch, "k").filter("k <= budget")
    so_far = Window.partitionBy("feed_id").orderBy("k")
    marked = chosen.withColumn("stopped", F.max("failed").over(so_far))
    handled = marked.filter("not stopped").select("feed_id", "post_id", "k")
    after = marked.groupBy("feed_id").agg(
        F.count_if(~F.col("stopped")).alias("handled"),
        F.min(F.when(~F.col("stopped"), F.col("post_id"))).alias("reached"),
        F.max("stopped").alias("stopped"),
    )
    state = open_feeds.join(counts, "feed_id", "left").join(after, "feed_id", "left")
    n, all_older = F.coalesce("handled", F.lit(0)), F.coalesce("older", F.lit(0))
    running = ~F.coalesce("stopped", F.lit(False))
    full = (limit > 0) & (have + n >= limit) & (n >= F.col("budget"))
    done = (F.col("budget") <= 0) | (
        running & (((n == all_older) & (n < F.col("budget"))) | (F.col("reached") <= 1) | full)
    )
    return handled, state.select(
        "feed_id",
        F.coalesce("reached", "oldest_post_id").alias("oldest_post_id"),
        (have + n).alias("history_posts"),
        F.coalesce(done, F.lit(False)).alias("history_done"),
    )


COUNTERS = ("added", "duplicates", "skipped", "failed", "filtered")


def feed_progress(feeds: DataFrame, results: DataFrame) -> DataFrame:
    """Counters plus a batch of post results, and the cursor moved on.

    The cursor stops before the first post that is held for another try.
    """
    hold = results.groupBy("feed_id").agg(F.min(F.when(F.col("held"), F.col("post_id"))).alias("hold"))
    with_hold = results.join(broadcast_if_small(hold), "feed_id")
    free = F.col("hold").isNull() | (F.col("post_id") < F.col("hold"))
    sums = with_hold.groupBy("feed_id").agg(
        *[F.sum(c).alias(f"d_{c}") for c in COUNTERS], F.max(F.when(free, F.col("post_id"))).alias("reached")
    )
    out = feeds.join(sums, "feed_id", "left")
    for c in COUNTERS:
        out = out.withColumn(c, F.col(c) + F.coalesce(f"d_{c}", F.lit(0)))
    cursor = F.greatest("last_post_id", F.coalesce("reached", F.lit(0)))
    return out.withColumn("last_post_id", cursor).drop("reached", *[f"d_{c}" for c in COUNTERS])


def link_source(links: DataFrame, sources: DataFrame) -> DataFrame:
    """New origin links; the first writer of an address wins."""
    first = first_per_key(links, ["url"], [F.asc("ord")])
    fresh = first.join(sources.select("url"), "url", "left_anti")
    return fresh.withColumn("caption", F.substring("caption", 1, 4000)).drop("ord")


def skip_item(media: DataFrame, sources: DataFrame, max_seconds: int = MAX_SECONDS) -> DataFrame:
    """Adds ``action``: ``linked`` already, ``skipped`` for its size, or ``take``."""
    known = sources.select("url", F.lit(True).alias("known")).distinct()
    out = media.join(known, "url", "left")
    big = (F.col("kind") == "too_big") | (F.lit(max_seconds > 0) & (F.col("duration") > max_seconds))
    action = F.when(F.col("known"), "linked").when(F.coalesce(big, F.lit(False)), "skipped").otherwise("take")
    return out.withColumn("action", action).drop("known")


def transcript_from_segments(segments: DataFrame, languages: DataFrame) -> DataFrame:
    """``item_id, transcript``: heard segments in order, '' when not trusted."""
    heard = F.when(F.col("no_speech_prob") < 0.7, F.struct("seq", strip("text").alias("text")))
    joined = segments.groupBy("item_id").agg(F.sort_array(F.collect_list(heard)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    out = joined.join(languages, "item_id", "left").withColumn("t", text)
    doubt = (F.coalesce("language_prob", F.lit(0.0)) < 0.4) | (F.char_length("t") < 3)
    return out.select("item_id", F.when(doubt, "").otherwise(strip("t")).alias("transcript"))


def patch_feeds(feeds: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Sparse edits; NULL leaves a value, a new limit decides ``history_done`` again."""
    p = patches.select(
        "feed_id", F.col("enabled").alias("p_enabled"), F.col("backfill_limit").alias("p_limit"), "check_now"
    )
    out = feeds.join(p, "feed_id", "left")
    done = F.when(F.col("p_limit").isNull(), F.col("history_done")).otherwise(
        (F.col("p_limit") > 0) & (F.col("history_posts") >= F.col("p_limit"))
    )
    return (
        out.withColumn("enabled", F.coalesce("p_enabled", "enabled"))
        .withColumn("history_done", done)
        .withColumn("backfill_limit", F.coalesce("p_limit", "backfill_limit"))
        .withColumn("next_poll_at", F.when(F.col("check_now"), now).otherwise(F.col("next_poll_at")))
        .drop("p_enabled", "p_limit", "check_now")
    )


def rebuild_feed_cursor(feeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Oldest post and history size of each feed, taken from the data."""
    oldest = sources.filter("feed_id is not null").groupBy("feed_id").agg(F.min("post_id").alias("oldest"))
    out = feeds.join(oldest, "feed_id", "left")
    total = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    return out.withColumn("oldest_post_id", F.coalesce("oldest", F.lit(0))).withColumn("history_posts", total).drop("oldest")
