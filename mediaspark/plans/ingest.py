"""Queries for sources and ingest (A) and for aggregation of model output (F, E6)."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.sounds import MUSIC, RUSSIAN, SKIP
from ..operators import labels
from ..sources import feeds as fd
from ..sources import files, pages
from . import bindings as b
from .basics import POSTS_SQL, PROMO_SQL, VERDICT_SQL, answers, posts
from .copies import HI_SQL
from .registry import query


@query("scan_files")
def scan_files(spark, d):
    return files.scan_files(spark, d, (".parquet",)).select("name", "size")


def archives(spark, d):
    """A zip archive per document: its text, a dot file and a resource fork."""

    @F.pandas_udf("binary")
    def pack(ids: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for i, text in zip(ids, texts, strict=True):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as z:
                z.writestr(f"docs/{i}.txt", text)
                z.writestr("docs/.hidden", "x")
                z.writestr("__MACOSX/x.txt", "x")
            out.append(buf.getvalue())
        return pd.Series(out)

    docs = b.table(spark, d, "documents")
    return docs.select(F.concat(F.lit("a"), "doc_id", F.lit(".zip")).alias("name"), pack("doc_id", "text").alias("content"))


@query(
    "scan_archive",
    """SELECT 'a' || doc_id || '.zip:docs/' || doc_id || '.txt' AS ref, doc_id || '.txt' AS name, strlen(text) AS size,
    strlen(text) > 5000 AS too_large, CASE WHEN strlen(text) <= 5000 THEN sha256(text) END AS sha256 FROM documents""",
)
def scan_archive(spark, d):
    out = files.scan_archive(archives(spark, d), max_bytes=5000)
    return out.select("ref", "name", "size", "too_large", F.sha2("content", 256).alias("sha256"))


def batch(spark, d):
    """Files to ingest: every document; every fourth content is in the corpus already."""
    return b.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("sha256"))


def corpus(spark, d):
    rows = b.table(spark, d, "documents").filter("doc_id % 4 = 1")
    return rows.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min(F.col("doc_id") + 1000000).alias("id"))


INGEST_SQL = """
corpus AS (SELECT sha256(text) AS sha256, min(doc_id + 1000000) AS id FROM documents WHERE doc_id % 4 = 1 GROUP BY 1),
batch AS (SELECT doc_id AS seq, sha256(text) AS sha256 FROM documents),
ingest AS (SELECT b.seq, b.sha256, CASE WHEN c.id IS NULL AND b.seq = min(b.seq) OVER (PARTITION BY b.sha256) THEN 'added' ELSE 'duplicate' END AS outcome,
  c.id AS item_id, min(b.seq) OVER (PARTITION BY b.sha256) AS owner FROM batch b LEFT JOIN corpus c USING (sha256))
"""


@query("exact_dedup_ingest", f"WITH {INGEST_SQL} SELECT seq, sha256, outcome, item_id, owner FROM ingest")
def exact_dedup_ingest(spark, d):
    return files.exact_dedup_ingest(batch(spark, d), corpus(spark, d))


@query(
    "load_counters",
    f"""WITH {INGEST_SQL}, o AS (SELECT seq % 7 AS load, CASE WHEN seq % 11 = 0 THEN 'unsupported' WHEN seq % 13 = 0 THEN 'failed' ELSE outcome END AS outcome FROM ingest)
    SELECT load, count(*) AS total, count(*) FILTER (WHERE outcome = 'added') AS added, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates,
    count(*) FILTER (WHERE outcome = 'unsupported') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM o GROUP BY load""",
)
def load_counters(spark, d):
    out = files.exact_dedup_ingest(batch(spark, d), corpus(spark, d))
    seq = F.col("seq")
    outcome = F.when(seq % 11 == 0, "unsupported").when(seq % 13 == 0, "failed").otherwise(F.col("outcome"))
    return files.load_counters(out.select((seq % 7).alias("load"), outcome.alias("outcome")))


@query("page_to_posts")
def page_to_posts(spark, d):
    p = pages.posts_of(pages.page_to_posts(previews(spark, d)))
    return p.select("page_id", "post_id", "text", F.array_join("links", " ").alias("links"), "buttons", F.col("posted_at").cast("string").alias("posted_at"))


def previews(spark, d):
    """Feed preview pages: the whole markup of each page inside a post.

    A photo post, a post of another feed, and a video whose length follows
    the page number; every third video lacks its source.
    """
    p = F.col("page_id").cast("string")
    feed = F.concat(F.lit("feed_"), (F.col("page_id") % 7).cast("string"))
    parts = [
        F.lit('<html><head><meta property="og:title" content=" News "></head><body><div class="tgme_channel_info"></div>'),
        F.lit('<div class="tgme_widget_message" data-post="'), feed, F.lit("/"), p, F.lit("1\">"),
        F.lit("<a class=\"tgme_widget_message_photo_wrap x\" style=\"width:8px;background-image:url('"), F.col("url"),
        F.lit("')\" href=\"https://t.me/f/"), p, F.lit('1?single"></a><div class="tgme_widget_message_text">'), F.col("html"),
        F.lit('</div><a class="tgme_widget_message_date"><time datetime="2025-03-01T10:00:00+00:00">10:00</time></a></div>'),
        F.lit('<div class="tgme_widget_message" data-post="other/9"></div>'),
        F.lit('<div class="tgme_widget_message" data-post="'), feed, F.lit("/"), p, F.lit('3"><a class="tgme_widget_message_video_player" href="">'),
        F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('<video src="v'), p, F.lit('.mp4"></video>'))).otherwise(""),
        F.lit('<time class="message_video_duration">1:'), F.lpad(F.col("page_id") % 60, 2, "0"), F.lit("</time></a></div></body></html>"),
    ]
    return b.table(spark, d, "pages").select("page_id", feed.alias("feed"), F.concat(*parts).alias("html"))


@query(
    "posts_to_media",
    """SELECT page_id, page_id * 10 + 1 AS post_id, page_id * 10 + 1 AS item_id, 'photo' AS kind, url, NULL::BIGINT AS duration FROM pages
    UNION ALL SELECT page_id, page_id * 10 + 3, page_id * 10 + 3, CASE WHEN page_id % 3 = 0 THEN 'too_big' ELSE 'video' END,
    CASE WHEN page_id % 3 = 0 THEN '' ELSE 'v' || page_id || '.mp4' END, 60 + page_id % 60 FROM pages""",
)
def posts_to_media(spark, d):
    return pages.posts_to_media(pages.posts_of(pages.page_to_posts(previews(spark, d))))


def feed_posts(spark, d):
    return b.table(spark, d, "documents").select(
        F.substring("source", 4, 9).cast("bigint").alias("feed_id"), F.col("doc_id").alias("post_id"), "n_chars"
    )


FEED_POSTS_SQL = "fposts AS (SELECT substr(source, 4)::BIGINT AS feed_id, doc_id AS post_id, n_chars FROM documents)"


@query(
    "incremental_posts",
    f"""WITH {b.FEEDS_SQL}, {FEED_POSTS_SQL}, x AS (SELECT p.*, f.last_post_id, f.backfill_limit,
      row_number() OVER (PARTITION BY p.feed_id ORDER BY p.post_id DESC) AS k FROM fposts p JOIN feeds f USING (feed_id) WHERE p.post_id > f.last_post_id)
    SELECT feed_id, post_id, n_chars FROM x WHERE last_post_id > 0 OR k <= CASE WHEN backfill_limit > 0 THEN least(backfill_limit, 300) ELSE 300 END""",
)
def incremental_posts(spark, d):
    return fd.incremental_posts(feed_posts(spark, d), b.feeds(spark, d))


def feeds_with_history(spark, d):
    return b.feeds(spark, d).withColumn("oldest_post_id", F.col("last_post_id"))


HISTORY_SQL = f"""{b.FEEDS_SQL}, {FEED_POSTS_SQL},
hf AS (SELECT feed_id, last_post_id AS oldest, history_posts, backfill_limit AS lim,
  CASE WHEN backfill_limit > 0 THEN least(40, backfill_limit - history_posts) ELSE 40 END AS budget,
  CASE WHEN last_post_id > 0 THEN last_post_id ELSE last_post_id + 1 END AS bef FROM feeds),
hp AS (SELECT p.feed_id, p.post_id, p.n_chars % 9 = 0 AS failed, f.budget, row_number() OVER (PARTITION BY p.feed_id ORDER BY p.post_id DESC) AS k
  FROM fposts p JOIN hf f USING (feed_id) WHERE p.post_id < f.bef),
hm AS (SELECT *, bool_or(failed) OVER (PARTITION BY feed_id ORDER BY k) AS stopped FROM hp WHERE k <= budget)
"""


@query("history_backfill", f"WITH {HISTORY_SQL} SELECT feed_id, post_id, k FROM hm WHERE NOT stopped")
def history_backfill(spark, d):
    rows = feed_posts(spark, d).withColumn("failed", F.col("n_chars") % 9 == 0)
    handled, _ = fd.history_backfill(rows, feeds_with_history(spark, d), batch=40)
    return handled.withColumn("k", F.col("k").cast("bigint"))


@query(
    "history_state",
    f"""WITH {HISTORY_SQL}, c AS (SELECT feed_id, count(*) AS older FROM hp GROUP BY 1),
    a AS (SELECT feed_id, count(*) FILTER (WHERE NOT stopped) AS n, min(post_id) FILTER (WHERE NOT stopped) AS reached, bool_or(stopped) AS stopped FROM hm GROUP BY 1)
    SELECT f.feed_id, coalesce(a.reached, f.oldest) AS oldest_post_id, f.history_posts + coalesce(a.n, 0) AS history_posts,
      coalesce(f.budget <= 0 OR (NOT coalesce(a.stopped, false) AND ((coalesce(a.n, 0) = coalesce(c.older, 0) AND coalesce(a.n, 0) < f.budget) OR coalesce(a.reached <= 1, false)
        OR (f.lim > 0 AND f.history_posts + coalesce(a.n, 0) >= f.lim AND coalesce(a.n, 0) >= f.budget))), false) AS history_done
    FROM hf f LEFT JOIN c USING (feed_id) LEFT JOIN a USING (feed_id)""",
)
def history_state(spark, d):
    rows = feed_posts(spark, d).withColumn("failed", F.col("n_chars") % 9 == 0)
    _, state = fd.history_backfill(rows, feeds_with_history(spark, d), batch=40)
    return state


def results(spark, d):
    n = F.col("n_chars")
    return feed_posts(spark, d).select(
        "feed_id", "post_id", (n % 2).alias("added"), (n % 3).alias("duplicates"), (n % 5).alias("skipped"),
        (n % 7 == 0).cast("bigint").alias("failed"), F.lit(0).cast("bigint").alias("filtered"), (n % 97 == 0).alias("held"),
    )


@query(
    "feed_progress",
    f"""WITH {b.FEEDS_SQL}, {FEED_POSTS_SQL}, h AS (SELECT feed_id, min(post_id) FILTER (WHERE n_chars % 97 = 0) AS hold FROM fposts GROUP BY 1),
    s AS (SELECT p.feed_id, sum(n_chars % 2)::BIGINT AS a, sum(n_chars % 3)::BIGINT AS du, sum(n_chars % 5)::BIGINT AS sk, count(*) FILTER (WHERE n_chars % 7 = 0) AS fa,
      max(post_id) FILTER (WHERE h.hold IS NULL OR post_id < h.hold) AS reached FROM fposts p JOIN h USING (feed_id) GROUP BY 1)
    SELECT f.feed_id, added + a AS added, duplicates + du AS duplicates, skipped + sk AS skipped, failed + fa AS failed, filtered,
      greatest(last_post_id, coalesce(reached, 0)) AS last_post_id FROM feeds f JOIN s USING (feed_id)""",
)
def feed_progress(spark, d):
    return fd.feed_progress(b.feeds(spark, d), results(spark, d)).select("feed_id", *fd.COUNTERS, "last_post_id")


@query(
    "link_source",
    f"""WITH {b.SOURCES_SQL}, n AS (SELECT doc_id AS item_id, 'https://feeds.example/' || source || '/' || (doc_id // 2 * 2 + 1) AS url, text AS caption, doc_id AS ord FROM documents)
    SELECT url, arg_min(item_id, ord) AS item_id, sha256(substr(arg_min(caption, ord), 1, 4000)) AS caption_hash FROM n
    WHERE url NOT IN (SELECT url FROM sources) GROUP BY url""",
)
def link_source(spark, d):
    i = F.col("doc_id")
    links = b.table(spark, d, "documents").select(
        i.alias("item_id"),
        F.concat(F.lit("https://feeds.example/"), "source", F.lit("/"), F.floor(i / 2) * 2 + 1).alias("url"),
        F.col("text").alias("caption"), i.alias("ord"),
    )
    out = fd.link_source(links, b.sources(spark, d))
    return out.select("url", "item_id", F.sha2("caption", 256).alias("caption_hash"))


@query(
    "skip_item",
    f"""WITH {b.SOURCES_SQL} SELECT doc_id AS id, CASE WHEN 'https://feeds.example/' || source || '/' || doc_id IN (SELECT url FROM sources) THEN 'linked'
      WHEN doc_id % 10 = 0 OR (doc_id % 3 <> 0 AND n_chars % 400 > 180) THEN 'skipped' ELSE 'take' END AS action FROM documents""",
)
def skip_item(spark, d):
    i = F.col("doc_id")
    media = b.table(spark, d, "documents").select(
        i.alias("id"), F.concat(F.lit("https://feeds.example/"), "source", F.lit("/"), i).alias("url"),
        F.when(i % 10 == 0, "too_big").otherwise("video").alias("kind"), F.when(i % 3 != 0, F.col("n_chars") % 400).alias("duration"),
    )
    return fd.skip_item(media, b.sources(spark, d)).select("id", "action")


@query(
    "insert_candidate_near",
    f"""WITH {HI_SQL}, inb AS (SELECT i.id AS seq, i.sha256, h.video, h.x FROM items i JOIN hi h ON h.id = i.id WHERE i.id % 4 <> 1),
    uniq AS (SELECT sha256, min(id) AS id FROM items WHERE id % 4 = 1 GROUP BY 1),
    incorp AS (SELECT u.id, u.sha256, h.video, h.x FROM uniq u JOIN hi h ON h.id = u.id),
    nn AS (SELECT b.seq, c.id AS near, row_number() OVER (PARTITION BY b.seq ORDER BY bit_count(xor(b.x, c.x)), c.id) AS k FROM inb b JOIN incorp c
      ON b.video = c.video AND bit_count(xor(b.x, c.x)) <= 12)
    SELECT b.seq, CASE WHEN u.id IS NOT NULL OR b.seq > min(b.seq) OVER (PARTITION BY b.sha256) THEN 'duplicate' WHEN n.near IS NOT NULL THEN 'near' ELSE 'added' END AS outcome,
      CASE WHEN u.id IS NOT NULL OR b.seq > min(b.seq) OVER (PARTITION BY b.sha256) THEN u.id ELSE n.near END AS item_id
    FROM inb b LEFT JOIN uniq u USING (sha256) LEFT JOIN nn n ON n.seq = b.seq AND n.k = 1""",
)
def insert_candidate_near(spark, d):
    rows = b.items_with_hashes(spark, d).select("id", "sha256", "kind", "phash")
    new = rows.filter("id % 4 <> 1").withColumnRenamed("id", "seq")
    have = rows.filter("id % 4 = 1")
    # the corpus holds each content once
    first = have.groupBy("sha256").agg(F.min("id").alias("id"))
    stored = first.join(have.select("id", "kind", "phash"), "id")
    return files.insert_candidate_near(new, stored)


@query(
    "insert_in_order",
    f"""WITH RECURSIVE {HI_SQL}, inb AS MATERIALIZED (SELECT i.id AS seq, i.sha256, h.video, h.x, h.bits FROM items i LEFT JOIN hi h ON h.id = i.id WHERE i.id % 4 <> 1),
    uniq AS (SELECT sha256, min(id) AS id FROM items WHERE id % 4 = 1 GROUP BY 1),
    incorp AS MATERIALIZED (SELECT u.id, h.video, h.x, h.bits FROM uniq u JOIN hi h ON h.id = u.id),
    old AS MATERIALIZED (SELECT b.seq, min(struct_pack(d := bit_count(xor(b.x, c.x)), new := false, id := c.id)) AS best FROM inb b JOIN incorp c
      ON b.video = c.video AND bit_count(xor(b.x, c.x)) <= 12 GROUP BY 1),
    cand AS MATERIALIZED (SELECT b.seq, b.video, b.x, row_number() OVER (ORDER BY b.seq) AS k FROM inb b WHERE b.x IS NOT NULL AND b.seq NOT IN (SELECT seq FROM old) AND b.sha256 NOT IN (SELECT sha256 FROM uniq)),
    edge AS MATERIALIZED (SELECT x.seq AS a, y.seq AS b, bit_count(xor(x.x, y.x)) AS d FROM cand x JOIN inb y ON x.video = y.video AND x.seq < y.seq AND bit_count(xor(x.x, y.x)) <= 12),
    turn AS MATERIALIZED (SELECT c.k, c.seq, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS nb FROM cand c LEFT JOIN edge e ON e.b = c.seq GROUP BY ALL),
    fold AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS ins UNION ALL
      SELECT t.k, CASE WHEN list_has_any(f.ins, t.nb) THEN f.ins ELSE list_append(f.ins, t.seq) END FROM fold f JOIN turn t ON t.k = f.k + 1),
    ins AS MATERIALIZED (SELECT unnest(arg_max(ins, k)) AS seq FROM fold),
    new AS (SELECT e.b AS seq, min(struct_pack(d := e.d, new := true, id := e.a)) AS best FROM edge e JOIN ins i ON i.seq = e.a GROUP BY 1),
    j AS (SELECT b.seq, u.id AS stored, least(o.best, n.best) AS best, min(b.seq) OVER (PARTITION BY b.sha256) AS first, b.x IS NULL AS bare
      FROM inb b LEFT JOIN uniq u ON u.sha256 = b.sha256 LEFT JOIN old o ON o.seq = b.seq LEFT JOIN new n ON n.seq = b.seq),
    s AS (SELECT *, first < seq AND (bare OR coalesce(best.new AND best.id = first, false)) AS same FROM j)
    SELECT seq, CASE WHEN stored IS NOT NULL OR same THEN 'duplicate' WHEN best IS NOT NULL THEN 'near' ELSE 'added' END AS outcome,
      CASE WHEN stored IS NOT NULL THEN stored WHEN NOT best.new THEN best.id END AS item_id,
      CASE WHEN stored IS NOT NULL THEN NULL WHEN same THEN first WHEN best.new THEN best.id END AS owner FROM s""",
)
def insert_in_order(spark, d):
    rows = b.items_with_hashes(spark, d).select("id", "sha256", "kind", "phash")
    new = rows.filter("id % 4 <> 1").withColumnRenamed("id", "seq")
    have = rows.filter("id % 4 = 1")
    first = have.groupBy("sha256").agg(F.min("id").alias("id"))
    return files.insert_in_order(new, first.join(have.select("id", "kind", "phash"), "id"))


@query(
    "transcript_from_segments",
    rf"""WITH s AS (SELECT conv_id AS item_id, turn, regexp_replace(text, '^{tx.WS}+|{tx.WS}+$', '', 'g') AS t, (turn * 37 + conv_id) % 10 < 7 AS heard FROM conversations),
    j AS (SELECT item_id, coalesce(string_agg(t, ' ' ORDER BY turn) FILTER (WHERE heard), '') AS t FROM s GROUP BY 1)
    SELECT item_id, CASE WHEN item_id % 10 < 4 OR length(t) < 3 THEN '' ELSE regexp_replace(t, '^{tx.WS}+|{tx.WS}+$', '', 'g') END AS transcript FROM j""",
)
def transcript_from_segments(spark, d):
    c = b.table(spark, d, "conversations")
    seg = c.select(
        F.col("conv_id").alias("item_id"), F.col("turn").alias("seq"), "text",
        ((F.col("turn") * 37 + F.col("conv_id")) % 10 / 10.0).alias("no_speech_prob"),
    )
    lang = c.select(F.col("conv_id").alias("item_id")).distinct().withColumn("language_prob", F.col("item_id") % 10 / 10.0)
    return fd.transcript_from_segments(seg, lang)


@query(
    "patch_feeds",
    f"""WITH {b.FEEDS_SQL} SELECT feed_id, CASE WHEN feed_id % 2 = 0 THEN false ELSE enabled END AS enabled,
    CASE WHEN feed_id % 3 = 0 THEN 5 ELSE backfill_limit END AS backfill_limit, CASE WHEN feed_id % 3 = 0 THEN history_posts >= 5 ELSE history_done END AS history_done,
    epoch_us(CASE WHEN feed_id % 5 = 0 THEN TIMESTAMP '{b.AS_OF}' ELSE next_poll_at END) AS next_us FROM feeds""",
)
def patch_feeds(spark, d):
    f = b.feeds(spark, d)
    i = F.col("feed_id")
    patches = f.select(
        "feed_id", F.when(i % 2 == 0, False).alias("enabled"), F.when(i % 3 == 0, 5).alias("backfill_limit"), (i % 5 == 0).alias("check_now")
    )
    out = fd.patch_feeds(f, patches, b.as_of())
    return out.select("feed_id", "enabled", F.col("backfill_limit").cast("bigint").alias("backfill_limit"), "history_done", b.micros("next_poll_at").alias("next_us"))


LOAD_TYPES = {"view": "progress", "signup": "received", "click": "started", "purchase": "done", "error": "failed"}


def load_events(spark, d):
    kind = F.col("event_type")
    name = F.lit("")
    for event, what in LOAD_TYPES.items():
        name = F.when(kind == event, what).otherwise(name)
    return b.events(spark, d).select(
        F.col("user_id").alias("load"), "ts", F.col("event_id").alias("seq"), name.alias("type"), F.round(F.col("value") * 100).cast("bigint").alias("bytes")
    )


@query(
    "load_lifecycle",
    f"""WITH x AS (SELECT user_id AS load, arg_max(event_type, ts) AS t, max(round(value * 100)::BIGINT) AS bytes_done FROM events GROUP BY 1)
    SELECT load, CASE t WHEN 'view' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS status,
    CASE WHEN t = 'view' THEN '{files.RESTARTED}' ELSE '' END AS error, bytes_done FROM x""",
)
def load_lifecycle(spark, d):
    return files.load_lifecycle(load_events(spark, d), restarted=True)


@query(
    "rebuild_feed_cursor",
    f"""WITH {b.FEEDS_SQL}, {b.SOURCES_SQL}, o AS (SELECT feed_id, min(post_id) AS oldest FROM sources WHERE feed_id IS NOT NULL GROUP BY 1)
    SELECT f.feed_id, coalesce(o.oldest, 0) AS oldest_post_id, added + duplicates + skipped + failed + filtered AS history_posts FROM feeds f LEFT JOIN o USING (feed_id)""",
)
def rebuild_feed_cursor(spark, d):
    return fd.rebuild_feed_cursor(b.feeds(spark, d), b.sources(spark, d)).select("feed_id", "oldest_post_id", "history_posts")


# --- model output -----------------------------------------------------------

SOUND_OF = {"view": "Music", "signup": "Speech", "error": "Dog", "click": "Laughter", "purchase": "Unlisted sound"}


def sound_scores(spark, d):
    label = F.lit("")
    for event, what in SOUND_OF.items():
        label = F.when(F.col("event_type") == event, what).otherwise(label)
    return b.events(spark, d).select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("window"), label.alias("label"), (F.col("value") / 400.0).alias("score")
    )


SOUND_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOUND_OF.items()) + " END"
TAGS_F_SQL = f"""
best AS (SELECT user_id AS item_id, {SOUND_CASE} AS label, max(value / 400.0) AS best FROM events GROUP BY 1, 2),
atags AS (SELECT item_id, label, score, r FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, label) AS r FROM (
  SELECT item_id, label, round_even(best, 3) AS score FROM best WHERE best >= 0.15 AND label NOT IN {SKIP!r})) WHERE r <= 10)
"""


@query("audio_tags", f"WITH {TAGS_F_SQL} SELECT item_id, label, score, r FROM atags")
def audio_tags(spark, d):
    return labels.audio_tags(sound_scores(spark, d)).withColumn("r", F.col("r").cast("bigint"))


NAMES_SQL = "CASE label " + " ".join(f"WHEN '{v}' THEN ' / {RUSSIAN[v]}'" for v in SOUND_OF.values() if v in RUSSIAN) + " ELSE '' END"


@query("tag_labels", f"WITH {TAGS_F_SQL} SELECT item_id, string_agg(lower(label) || {NAMES_SQL}, '; ' ORDER BY r) AS sounds FROM atags GROUP BY 1")
def tag_labels(spark, d):
    out = labels.tag_labels(labels.audio_tags(sound_scores(spark, d)))
    return out.select("item_id", F.array_join("sounds", "; ").alias("sounds"))


@query("has_music", f"WITH {TAGS_F_SQL} SELECT item_id, bool_or(label IN {MUSIC!r} AND score >= 0.3) AS music FROM atags GROUP BY 1")
def has_music(spark, d):
    return labels.has_music(labels.audio_tags(sound_scores(spark, d)))


@query(
    "mean_embedding",
    """WITH n AS (SELECT label AS item_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
    f AS (SELECT item_id, unnest(v) / CASE WHEN n = 0 THEN 1 ELSE n END AS x, generate_subscripts(v, 1) - 1 AS pos FROM n),
    m AS (SELECT item_id, pos, avg(x) AS m FROM f GROUP BY 1, 2), k AS (SELECT item_id, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
    SELECT m.item_id, m.pos::BIGINT AS pos, round(m.m / k.n, 6) AS x FROM m JOIN k USING (item_id)""",
)
def mean_embedding(spark, d):
    frames = b.table(spark, d, "embeddings").select(F.col("label").alias("item_id"), F.col("embedding").alias("vec"))
    out = labels.mean_embedding(frames).select("item_id", F.posexplode("vec").alias("pos", "x"))
    return out.select("item_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query(
    "embed_batch",
    r"""WITH w AS (SELECT doc_id AS id, md5(unnest(list_concat(['passage'], regexp_extract_all(lower(text), '[\p{L}\p{N}]+')))) AS h FROM documents),
    s AS (SELECT id, ('0x' || substr(h, 1, 6))::BIGINT % 384 AS pos, sum(CASE WHEN substr(h, 7, 1) < '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM w GROUP BY 1, 2),
    n AS (SELECT id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1)
    SELECT s.id, s.pos, round(x / n.n, 4) AS x FROM s JOIN n USING (id) WHERE x <> 0""",
)
def embed_batch(spark, d):
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    out = labels.embed_batch(docs).select("id", F.posexplode("vec").alias("pos", "x")).filter("x <> 0")
    return out.select("id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("x").cast("double"), 4).alias("x"))


def analyses(spark, d):
    """Model results for two thirds of the items, half of them without text."""
    raw = answers(spark, d).filter("id % 3 <> 2")
    parsed = tx.parse_analysis("raw")
    return raw.select(
        "id",
        F.when(F.col("id") % 2 == 0, parsed).alias("analysis"),
        F.lit("primary").alias("provider"),
        F.lit(None).cast("array<bigint>").alias("phash"),
        F.when(F.col("id") % 5 == 0, "hash").otherwise("").alias("blurhash"),
        F.lit(True).alias("media_ok"),
    )


@query(
    "merge_analysis",
    f"""WITH {b.ITEMS_SQL}, x AS (SELECT *, id % 3 <> 2 AS hit, id % 3 <> 2 AND id % 2 = 0 AS described, id % 4 = 3 AS bad FROM items)
    SELECT id, CASE WHEN hit THEN 'done' ELSE status END AS status, CASE WHEN hit THEN 'primary' ELSE provider END AS provider,
      CASE WHEN described AND NOT locked THEN CASE WHEN bad THEN '' ELSE template END ELSE title END AS title,
      CASE WHEN described AND NOT locked THEN CASE WHEN bad THEN '' ELSE 'plain' END ELSE description END AS description,
      CASE WHEN hit AND id % 5 = 0 THEN 'hash' ELSE '' END AS blurhash,
      epoch_us(CASE WHEN described THEN TIMESTAMP '{b.AS_OF}' ELSE analyzed_at END) AS analyzed_us FROM x""",
)
def merge_analysis(spark, d):
    items = b.items_with_hashes(spark, d)
    out = labels.merge_analysis(items, analyses(spark, d), b.as_of())
    return out.select("id", "status", "provider", "title", "description", "blurhash", b.micros("analyzed_at").alias("analyzed_us"))


@query(
    "patch_items",
    f"""WITH {b.ITEMS_SQL} SELECT id, CASE WHEN id % 4 = 0 THEN 'edited' ELSE title END AS title, CASE WHEN id % 6 = 0 THEN false ELSE hidden END AS hidden,
    CASE WHEN id % 6 = 0 THEN '' WHEN hidden THEN 'flagged' ELSE '' END AS hidden_reason,
    CASE WHEN id % 8 = 0 THEN false WHEN id % 4 = 0 THEN true ELSE locked END AS locked FROM items""",
)
def patch_items(spark, d):
    items = b.items(spark, d)
    i = F.col("id")
    patches = items.filter("id % 2 = 0").select(
        "id", F.when(i % 4 == 0, "edited").alias("title"), F.when(i % 6 == 0, False).alias("hidden"), F.when(i % 8 == 0, False).alias("locked")
    )
    return labels.patch_items(items, patches, b.as_of()).select("id", "title", "hidden", "hidden_reason", "locked")


@query(
    "bulk_actions",
    f"""WITH {b.ITEMS_SQL}, a AS (SELECT *, ['hide', 'unhide', 'delete', 'reprocess', 'embed', '', ''][CAST(id % 7 + 1 AS INT)] AS act FROM items)
    SELECT 'left' AS part, id, CASE act WHEN 'hide' THEN true WHEN 'unhide' THEN false ELSE hidden END AS hidden,
      CASE WHEN act = 'reprocess' AND status <> 'done' THEN 'pending' ELSE status END AS status, CASE WHEN act = 'reprocess' THEN '' ELSE error END AS error
    FROM a WHERE act <> 'delete' UNION ALL SELECT 'deleted', id, hidden, status, error FROM a WHERE act = 'delete'""",
)
def bulk_actions(spark, d):
    items = b.items(spark, d)
    names = F.array(*[F.lit(x) for x in ("hide", "unhide", "delete", "reprocess", "embed", "", "")])
    actions = items.select("id", F.element_at(names, (F.col("id") % 7 + 1).cast("int")).alias("action")).filter("action <> ''")
    rest, deleted = labels.bulk_actions(items, actions, b.as_of())
    cols = ["id", "hidden", "status", "error"]
    return rest.select(F.lit("left").alias("part"), *cols).unionByName(deleted.select(F.lit("deleted").alias("part"), *cols))


@query(
    "hide_flagged",
    f"""WITH {b.ITEMS_SQL}, {b.SOURCES_SQL}, {b.FEEDS_SQL}, {POSTS_SQL}, {PROMO_SQL}, {VERDICT_SQL},
    hit AS (SELECT i.id, s.feed_id, v.verdict FROM items i JOIN sources s ON s.item_id = i.id AND s.url = i.source_ref JOIN verdicts v ON v.id = i.id
      WHERE s.feed_id IS NOT NULL AND NOT i.locked AND NOT i.hidden AND v.verdict <> '')
    SELECT 'item' AS part, i.id, (i.hidden OR h.id IS NOT NULL)::INT::BIGINT AS n, coalesce(h.verdict, CASE WHEN i.hidden THEN 'flagged' ELSE '' END) AS reason
      FROM items i LEFT JOIN hit h USING (id)
    UNION ALL SELECT 'feed', f.feed_id, f.filtered + (SELECT count(*) FROM hit WHERE hit.feed_id = f.feed_id), '' FROM feeds f""",
)
def hide_flagged(spark, d):
    from ..functions.rules import post_verdict

    verdicts = posts(spark, d).select("id", post_verdict("text", "links", "buttons", "feed", "has_media").alias("verdict"))
    items, feeds = labels.hide_flagged(b.items(spark, d), b.sources(spark, d), verdicts, b.feeds(spark, d))
    return items.select(
        F.lit("item").alias("part"), "id", F.col("hidden").cast("bigint").alias("n"), F.col("hidden_reason").alias("reason")
    ).unionByName(feeds.select(F.lit("feed").alias("part"), F.col("feed_id").alias("id"), F.col("filtered").alias("n"), F.lit("").alias("reason")))
