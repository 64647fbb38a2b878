"""State-of-corpus reports (G) and the older overview (L1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import is_visible


def unpivot(df: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """A one-row report as ``metric, value`` rows."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).cast("bigint").alias(value)) for c in df.columns]
    return df.select(F.inline(F.array(*pairs)))


def corpus_stats(items: DataFrame) -> DataFrame:
    """G1: ``facet, key, n, bytes``: the total and counts by status, kind, provider and hidden."""
    small = items.groupBy("status", "kind", "provider", "hidden").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")
    )
    sets = small.groupingSets(
        [[], ["status"], ["kind"], ["provider"], ["hidden"]], "status", "kind", "provider", "hidden"
    ).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.grouping_id().alias("g"))
    facet = (
        F.when(F.col("g") == 15, "total").when(F.col("g") == 7, "status").when(F.col("g") == 11, "kind")
        .when(F.col("g") == 13, "provider").otherwise("hidden")
    )
    key = F.coalesce("status", "kind", "provider", F.col("hidden").cast("string"), F.lit(""))
    return sets.select(facet.alias("facet"), key.alias("key"), "n", "bytes").filter(
        ~((F.col("facet") == "provider") & (F.col("key") == ""))
    )


def status_counts(items: DataFrame) -> DataFrame:
    """Count by status with the total (status NULL), in order."""
    return items.rollup("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_last("status"))


def recent_failures(items: DataFrame, limit: int = 10) -> DataFrame:
    """Failed items, latest change first."""
    return items.filter("status = 'failed'").orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def delivery_stats(items: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Uploads among visible items, and relayed copies."""
    none = F.col("delivery_id") == ""
    own = items.filter(is_visible()).agg(
        F.count_if(~none).alias("uploaded"),
        F.count_if(none & (F.col("delivery_error") == "")).alias("waiting"),
        F.count_if(none & (F.col("delivery_error") != "")).alias("failed"),
    )
    relay = deliveries.agg(
        F.count_if(F.col("file_id") != "").alias("relayed"), F.count_if(F.col("error") != "").alias("relay_failed")
    )
    return unpivot(own).unionByName(unpivot(relay))


def media_stats(items: DataFrame, max_attempts: int = 3) -> DataFrame:
    """State of the media check, the speech backlog and the finished share."""
    bad, err = ~F.col("media_ok"), F.col("media_error") != ""
    has_thumb = F.col("thumb_path") != ""
    speech = (F.col("kind") == "video") & (F.col("status") == "done") & (F.col("transcript") == "") & ~F.col("speech_checked")
    row = items.agg(
        F.count_if(has_thumb).alias("total"),
        F.count_if(has_thumb & F.col("media_ok")).alias("ok"),
        F.count_if(has_thumb & bad & ~err).alias("todo"),
        F.count_if(has_thumb & bad & err & (F.col("media_attempts") < max_attempts)).alias("retrying"),
        F.count_if(has_thumb & bad & err & (F.col("media_attempts") >= max_attempts)).alias("failed"),
        F.count_if(has_thumb & bad & ~err & (F.col("kind") == "video")).alias("videos"),
        F.count_if(speech).alias("speech"),
    )
    share = F.when(F.col("total") > 0, F.col("ok") * 100.0 / F.col("total")).otherwise(0.0)
    return row.withColumn("percent", F.round(share, 6))


def media_failures(items: DataFrame, limit: int = 5) -> DataFrame:
    """Failed media checks, latest first, unknown times last."""
    return items.filter("media_error <> ''").orderBy(F.desc_nulls_last("media_failed_at"), F.desc("id")).limit(limit)


def analyzed_since(items: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """How many items were analysed in the last ``seconds``."""
    start = F.unix_micros(as_of) - seconds * 1_000_000
    return items.filter(F.unix_micros("analyzed_at") > start).agg(F.count(F.lit(1)).alias("n"))


def throughput_eta(items: DataFrame, as_of: Column, seconds: int = 3600) -> DataFrame:
    """Items left, items analysed in the last hour and the hours left at that pace."""
    left = items.agg(F.count_if(F.col("status").isin("pending", "processing")).alias("left_over"))
    rate = analyzed_since(items, as_of, seconds).withColumnRenamed("n", "per_hour")
    both = left.join(F.broadcast(rate))
    hours = F.when(F.col("per_hour") > 0, F.col("left_over") / F.col("per_hour"))
    return both.withColumn("hours", F.round(hours, 6))


def backlog(jobs: DataFrame) -> DataFrame:
    """Jobs by lane and state."""
    return jobs.groupBy("lane", "state").agg(F.count(F.lit(1)).alias("n"))


def loads_recent(loads: DataFrame, limit: int = 5) -> DataFrame:
    """Newest loads first."""
    return loads.orderBy(F.desc("load")).limit(limit)


def feeds_list(feeds: DataFrame) -> DataFrame:
    """Feeds by id."""
    return feeds.orderBy("feed_id")


def admin_overview(users: DataFrame, media: DataFrame, prompts: DataFrame, newest: int = 5) -> DataFrame:
    """L1: ``part, key, value``: totals, active prompts, newest users and media."""

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("part"), F.lit("").alias("key"), "value")

    def latest(df: DataFrame, name: str) -> DataFrame:
        top = df.orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
        return top.select(F.lit(name).alias("part"), F.col("name").alias("key"), F.col("id").alias("value"))

    return (
        total(users, "users")
        .unionByName(total(media, "media"))
        .unionByName(total(prompts.filter("is_active"), "active_prompts"))
        .unionByName(latest(users, "newest_user"))
        .unionByName(latest(media, "newest_media"))
    )
