"""Schemas of the data model and the predicates used everywhere.

An empty string, not NULL, means "none" in text columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEMS = """
id bigint, sha256 string, kind string, mime string, ext string, status string, hidden boolean,
hidden_reason string, title string, ocr_text string, description string, transcript string,
song string, sounds array<string>, template string, tags array<string>, objects array<string>,
people array<string>, caption string, mood string, lang string, nsfw boolean, locked boolean,
provider string, model string, source string, source_ref string, original_name string,
size_bytes bigint, created_at timestamp, updated_at timestamp, analyzed_at timestamp,
error string, attempts int, auto_retries int, media_ok boolean, media_error string,
media_attempts int, media_failed_at timestamp, file_path string, thumb_path string,
blurhash string, speech_checked boolean, delivery_id string, delivery_error string,
delivery_attempts int, delivery_failed_at timestamp,
phash array<bigint>, clip_vec array<float>, text_vec array<float>
"""
SOURCES = """
source_id bigint, item_id bigint, url string, source string, feed_id bigint, post_id bigint,
caption string, posted_at timestamp, created_at timestamp
"""
FEEDS = """
feed_id bigint, name string, enabled boolean, backfill_limit int, last_post_id bigint,
oldest_post_id bigint, history_done boolean, history_posts bigint, status string, error string,
added bigint, duplicates bigint, skipped bigint, failed bigint, filtered bigint,
next_poll_at timestamp
"""
PAIRS = "a bigint, b bigint, sim double, label string, verdict string, reason string, checked_at timestamp"
DELIVERIES = "consumer bigint, item_id bigint, file_id string, error string, attempts int, updated_at timestamp"

KINDS = ("image", "gif", "video")
STATUSES = ("pending", "processing", "done", "failed")


def is_visible() -> Column:
    return (F.col("status") == "done") & ~F.col("hidden")


def visible(items: DataFrame, kind: str = "") -> DataFrame:
    """Searchable rows, optionally of one kind (a partition column)."""
    out = items.filter(is_visible())
    return out.filter(F.col("kind") == kind) if kind else out


def valid_items(items: DataFrame) -> DataFrame:
    """Rows whose closed-set columns hold known values."""
    return items.filter(F.col("kind").isin(*KINDS) & F.col("status").isin(*STATUSES))


def write_items(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink: Parquet partitioned by kind, so kind filters prune folders."""
    items.write.mode(mode).partitionBy("kind").parquet(path)
