"""Aggregation of model output and edits of items (F)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sounds import MUSIC, RUSSIAN, SKIP
from ..functions.text import tokens
from ..scale import broadcast_if_small, first_per_key, top_k

MIN_SCORE = 0.15
TOP = 10


def audio_tags(scores: DataFrame, minimum: float = MIN_SCORE, top: int = TOP) -> DataFrame:
    """F1: ``item_id, label, score, r``: the best score of a label over all windows.

    The minimum is tested before rounding; equal scores are in label order.
    """
    best = scores.groupBy("item_id", "label").agg(F.max("score").alias("best"))
    kept = best.filter((F.col("best") >= minimum) & ~F.col("label").isin(*SKIP))
    rounded = kept.select("item_id", "label", F.bround("best", 3).alias("score"))
    return top_k(rounded, ["item_id"], [F.desc("score"), F.asc("label")], top, "r")


def sound_names(spark) -> DataFrame:
    return spark.createDataFrame(list(RUSSIAN.items()), "label string, russian string")


def tag_labels(tags: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``item_id, sounds``: "english / russian" labels, strongest first."""
    names = sound_names(tags.sparkSession) if names is None else names
    low = F.lower("label")
    text = F.when(F.col("russian").isNull(), low).otherwise(F.concat(low, F.lit(" / "), "russian"))
    named = tags.join(broadcast_if_small(names), "label", "left").withColumn("text", text)
    return named.groupBy("item_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]).alias("sounds")
    )


def has_music(tags: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``item_id, music``: a music label is heard clearly enough."""
    hit = F.col("label").isin(*MUSIC) & (F.col("score") >= threshold)
    return tags.groupBy("item_id").agg(F.bool_or(hit).alias("music"))


def norm(vec: Column) -> Column:
    """Length of a vector; 1 for the zero vector."""
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(length == 0, 1.0).otherwise(length)


def mean_embedding(frames: DataFrame) -> DataFrame:
    """``item_id, vec``: unit mean of the unit vectors of an item's frames.

    Averages are kept per coordinate, so the frames of a long item are summed
    where they lie and only one row per coordinate is shuffled.
    """
    flat = frames.withColumn("n", norm(F.col("vec"))).select("item_id", "n", F.posexplode("vec").alias("pos", "x"))
    mean = flat.groupBy("item_id", "pos").agg(F.avg(F.col("x").cast("double") / F.col("n")).alias("m"))
    packed = mean.groupBy("item_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v")
    )
    return packed.withColumn("n", norm(F.col("v"))).select(
        "item_id", F.transform("v", lambda x: x / F.col("n")).alias("vec")
    )


KNOWN_WORDS = 200_000


def hashing_encoder(dim: int) -> Callable[[list[list[str]]], np.ndarray]:
    """Default encoder: signed feature hashing of words, the same on every run."""

    places: dict[str, tuple[int, float]] = {}

    def place(word: str) -> tuple[int, float]:
        if word not in places:
            h = md5(word.encode()).hexdigest()
            places[word] = int(h[:6], 16) % dim, 1.0 if int(h[6], 16) < 8 else -1.0
        return places[word]

    def encode(texts: list[list[str]]) -> np.ndarray:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes, words = pd.factorize(np.array([w for words in texts for w in words], object))
        if len(places) > KNOWN_WORDS:
            places.clear()
        at, sign = np.array([place(w) for w in words]).reshape(-1, 2).T
        cell = np.repeat(np.arange(len(texts)), sizes) * dim + at.astype(np.int64)[codes]
        return np.bincount(cell, sign[codes], len(texts) * dim).reshape(len(texts), dim)

    return encode


def embed_batch(
    texts: DataFrame, purpose: str = "passage", dim: int = 384, encoder: Callable[[], Callable] | None = None
) -> DataFrame:
    """``id, vec`` of ``id, text``; the encoder is built once per task.

    ``purpose`` (``query`` or ``passage``) is put before the text, as the
    encoder family expects.
    """
    make = encoder or (lambda: hashing_encoder(dim))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for words in batches:
            m = encode(words.tolist())
            n = np.linalg.norm(m, axis=1, keepdims=True)
            n[n == 0] = 1
            yield pd.Series(list((m / n).astype(np.float32)))

    return texts.select("id", embed(tokens(F.concat(F.lit(f"{purpose}: "), "text"))).alias("vec"))


TEXT_COLUMNS = (
    "title", "description", "ocr_text", "transcript", "objects", "tags", "people", "template", "lang", "mood", "nsfw",
)


def merge_analysis(items: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """items with model results ``id, analysis, clip_vec, text_vec, phash, blurhash, …``.

    ``analysis`` is the struct of ``parse_analysis`` or NULL for vectors only.
    Locked items keep their text; a hash or blurhash that was not computed
    leaves the old one.
    """
    names = [f for f in TEXT_COLUMNS if f in items.columns and f in results.schema["analysis"].dataType.names]
    r = results.select(
        "id", F.lit(True).alias("_hit"), F.col("analysis").alias("_a"), F.col("provider").alias("_provider"),
        F.col("phash").alias("_phash"), F.col("blurhash").alias("_blurhash"), F.col("media_ok").alias("_media_ok"),
    )
    out = items.join(r, "id", "left")
    hit, described = F.col("_hit").isNotNull(), F.col("_a").isNotNull()
    for name in names:
        out = out.withColumn(
            name, F.when(described & ~F.col("locked"), F.col(f"_a.{name}")).otherwise(F.col(name))
        )
    sets = {
        "status": F.lit("done"),
        "error": F.lit(""),
        "provider": F.coalesce("_provider", F.lit("")),
        "phash": F.coalesce("_phash", "phash"),
        "blurhash": F.when(F.coalesce("_blurhash", F.lit("")) != "", F.col("_blurhash")).otherwise(F.col("blurhash")),
        "media_ok": F.col("_media_ok"),
        "media_error": F.lit(""),
        "media_attempts": F.lit(0),
        "updated_at": now,
    }
    for name, value in sets.items():
        if name in items.columns:
            out = out.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    out = out.withColumn("analyzed_at", F.when(described, now).otherwise(F.col("analyzed_at")))
    return out.drop("_hit", "_a", "_provider", "_phash", "_blurhash", "_media_ok")


PATCH_TEXT = ("title", "description", "ocr_text", "transcript", "tags", "objects", "people", "template")


def patch_items(items: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """sparse human edits, NULL = unchanged.

    Touching text locks the item unless the edit says otherwise; showing a
    hidden item clears the reason.
    """
    names = [c for c in patches.columns if c != "id"]
    out = items.join(patches.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in names]), "id", "left")
    touched = F.lit(False)
    for c in names:
        if c in PATCH_TEXT:
            touched = touched | F.col(f"_{c}").isNotNull()
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    if "locked" not in names:
        out = out.withColumn("_locked", F.lit(None).cast("boolean"))
    out = out.withColumn("locked", F.when(touched & F.col("_locked").isNull(), True).otherwise(F.col("locked")))
    if "hidden" in names:
        shown = F.coalesce(~F.col("_hidden"), F.lit(False))
        out = out.withColumn("hidden_reason", F.when(shown, "").otherwise(F.col("hidden_reason")))
    out = out.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
    return out.select(*items.columns)


def reset_status() -> Column:
    """Back to the queue, except that a finished item never moves backwards."""
    return F.when(F.col("status") == "done", "done").otherwise("pending")


def bulk_actions(items: DataFrame, actions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """F8: items after ``id, action`` (hide, unhide, delete, reprocess, embed), and the deleted rows."""
    wanted = first_per_key(actions, ["id"], [F.asc("action")])
    out = items.join(wanted, "id", "left")
    deleted = out.filter("action = 'delete'").drop("action")
    rest = out.filter("action is null or action <> 'delete'")
    act = F.col("action")
    again, veil = act == "reprocess", act.isin("hide", "unhide")
    sets = {
        "hidden": F.when(act == "hide", True).when(act == "unhide", False),
        "hidden_reason": F.when(veil, ""),
        "status": F.when(again, reset_status()),
        "error": F.when(again, ""),
        "attempts": F.when(again, 0),
        "updated_at": F.when(again | veil, now),
    }
    for name, value in sets.items():
        if name in items.columns:
            rest = rest.withColumn(name, F.coalesce(value, F.col(name)))
    return rest.drop("action"), deleted


def hide_flagged(items: DataFrame, sources: DataFrame, verdicts: DataFrame, feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hide refused items whose own link came from a feed; count them per feed.

    Locked or already hidden items stay as they are.
    """
    own = sources.filter("feed_id is not null").select(
        F.col("item_id").alias("id"), F.col("url").alias("source_ref"), "feed_id"
    )
    refused = verdicts.filter("verdict <> ''")
    hit = (
        items.filter(~F.col("locked") & ~F.col("hidden"))
        .select("id", "source_ref")
        .join(own, ["id", "source_ref"])
        .join(refused, "id")
    )
    hit = first_per_key(hit, ["id"], [F.asc("feed_id")]).select("id", "feed_id", "verdict")
    out = items.join(hit.select("id", "verdict"), "id", "left")
    out = (
        out.withColumn("hidden", F.col("hidden") | F.col("verdict").isNotNull())
        .withColumn("hidden_reason", F.coalesce("verdict", "hidden_reason"))
        .drop("verdict")
    )
    counts = hit.groupBy("feed_id").agg(F.count(F.lit(1)).alias("more"))
    counted = feeds.join(counts, "feed_id", "left")
    counted = counted.withColumn("filtered", F.col("filtered") + F.coalesce("more", F.lit(0))).drop("more")
    return out, counted
