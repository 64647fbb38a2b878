"""How the given tables stand in for items, posts, feeds and the other roles.

Every binding exists twice, as a DataFrame and as a SQL fragment, and both
describe the same rows over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import gradient_hash, hash_text
from ..functions.text import tokens
from ..scale import broadcast_if_small, spread
from ..session import cut_lineage

TEXT_TABLES = ("documents", "pages", "conversations")
AS_OF = "2024-03-01 00:00:00"

# Failure texts given to failed items, by id.
ERRORS = [
    "You have hit your usage limit",
    "401 unauthorized: refresh token expired",
    "stream disconnected before completion",
    "errno 11: resource temporarily unavailable",
    "model returned invalid JSON",
    "Connection reset by peer",
    "decode failed",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def minutes_before(minutes):
    return F.timestamp_micros(F.unix_micros(as_of()) - minutes.cast("bigint") * 60_000_000)


def micros(col):
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without vectors and hashes: ``documents`` with ``labels``."""
    flags = (
        table(spark, sf_dir, "labels")
        .groupBy("doc_id")
        .agg((F.max("toxic") == 1).alias("toxic"))
    )
    # a small side spares the whole texts a shuffle
    flags = broadcast_if_small(flags)
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    status = (
        F.when(i % 17 == 0, "failed").when(i % 19 == 0, "pending").when(i % 23 == 0, "processing").otherwise("done")
    )
    errors = F.array(*[F.lit(e) for e in ERRORS])
    none = F.array().cast("array<string>")
    sha = F.sha2("text", 256)
    cols = {
        "id": i,
        "sha256": sha,
        "kind": F.when(i % 5 == 0, "gif").when(i % 5 == 1, "video").otherwise("image"),
        "status": status,
        "hidden": F.coalesce("toxic", F.lit(False)),
        "hidden_reason": F.when(F.coalesce("toxic", F.lit(False)), "flagged").otherwise(""),
        "title": F.split("text", "\n")[0],
        "ocr_text": F.col("text"),
        "description": F.lit(""),
        "transcript": F.when(i % 7 == 3, F.col("source")).otherwise(""),
        "song": F.lit(""),
        "sounds": none,
        "template": F.col("source"),
        # all distinct words of the whole text
        "tags": F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))),
        "objects": none,
        "people": F.array(
            F.concat(F.lit("p"), F.col("n_chars") % 40), F.concat(F.lit("p"), i % 25)
        ),
        "caption": F.when(i % 3 == 0, F.col("source")).otherwise(""),
        "lang": F.col("lang"),
        "locked": i % 29 == 0,
        "provider": F.when(i % 4 == 0, "").when(i % 4 == 1, "primary").otherwise("fallback"),
        "model": F.lit(""),
        "source": F.element_at(F.array(*[F.lit(s) for s in ("zip", "inbox", "upload", "feed")]), (i % 4 + 1).cast("int")),
        "source_ref": F.when(i % 4 == 3, F.concat(F.lit("https://feeds.example/"), "source", F.lit("/"), i)).otherwise(""),
        "size_bytes": F.col("n_chars"),
        "created_at": minutes_before(i * 31 % 40000),
        "updated_at": minutes_before(i * 7919 % 20160),
        "analyzed_at": F.when((status == "done") & (i % 7 != 0), minutes_before(i * 104729 % 2880)),
        "error": F.when(status == "failed", F.element_at(errors, (i % 7 + 1).cast("int"))).otherwise(""),
        "attempts": (i % 5).cast("int"),
        "auto_retries": (i % 4).cast("int"),
        "media_ok": i % 3 == 0,
        "media_error": F.when((i % 3 == 1) & (i % 4 == 0), "decode failed").otherwise(""),
        "media_attempts": (i % 5).cast("int"),
        "media_failed_at": F.when((i % 3 == 1) & (i % 4 == 0) & (i % 11 != 0), minutes_before(i * 31 % 600)),
        "thumb_path": F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("thumbs/"), sha)),
        "blurhash": F.lit(""),
        "speech_checked": i % 2 == 0,
        "delivery_id": F.when(i % 2 == 0, F.concat(F.lit("f"), i)).otherwise(""),
        "delivery_error": F.when(i % 6 == 1, "upload failed").otherwise(""),
        "delivery_attempts": (i % 4).cast("int"),
        "delivery_failed_at": F.when(i % 6 == 1, minutes_before(i * 17 % 400)),
    }
    return docs.join(flags, "doc_id", "left").select(*[v.alias(k) for k, v in cols.items()])


def cursor(spark: SparkSession, sf_dir: str) -> int:
    """Where a reader of the item list has got to: nine tenths of the highest id."""
    return int(table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0) * 9 // 10


ITEMS_SQL = f"""
flags AS (SELECT doc_id, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
items0 AS (
  SELECT d.doc_id AS id, sha256(d.text) AS sha256,
    CASE d.doc_id % 5 WHEN 0 THEN 'gif' WHEN 1 THEN 'video' ELSE 'image' END AS kind,
    CASE WHEN d.doc_id % 17 = 0 THEN 'failed' WHEN d.doc_id % 19 = 0 THEN 'pending'
         WHEN d.doc_id % 23 = 0 THEN 'processing' ELSE 'done' END AS status,
    coalesce(f.toxic, false) AS hidden,
    string_split(d.text, chr(10))[1] AS title, d.text AS ocr_text, '' AS description,
    CASE WHEN d.doc_id % 7 = 3 THEN d.source ELSE '' END AS transcript, '' AS song,
    d.source AS template, 'p' || (d.n_chars % 40) AS p1, 'p' || (d.doc_id % 25) AS p2,
    CASE WHEN d.doc_id % 3 = 0 THEN d.source ELSE '' END AS caption, d.lang AS lang,
    d.doc_id % 29 = 0 AS locked,
    CASE d.doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'primary' ELSE 'fallback' END AS provider,
    ['zip','inbox','upload','feed'][CAST(d.doc_id % 4 + 1 AS INT)] AS source,
    CASE WHEN d.doc_id % 4 = 3 THEN 'https://feeds.example/' || d.source || '/' || d.doc_id ELSE '' END AS source_ref,
    d.n_chars AS size_bytes,
    TIMESTAMP '{AS_OF}' - to_minutes(d.doc_id * 31 % 40000) AS created_at,
    TIMESTAMP '{AS_OF}' - to_minutes(d.doc_id * 7919 % 20160) AS updated_at,
    {ERRORS!r}[CAST(d.doc_id % 7 + 1 AS INT)] AS err,
    d.doc_id % 5 AS attempts, d.doc_id % 4 AS auto_retries, d.doc_id % 3 = 0 AS media_ok,
    CASE WHEN d.doc_id % 3 = 1 AND d.doc_id % 4 = 0 THEN 'decode failed' ELSE '' END AS media_error,
    d.doc_id % 5 AS media_attempts,
    CASE WHEN d.doc_id % 3 = 1 AND d.doc_id % 4 = 0 AND d.doc_id % 11 <> 0
         THEN TIMESTAMP '{AS_OF}' - to_minutes(d.doc_id * 31 % 600) END AS media_failed_at,
    CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE 'thumbs/' || sha256(d.text) END AS thumb_path,
    d.doc_id % 2 = 0 AS speech_checked,
    CASE WHEN d.doc_id % 2 = 0 THEN 'f' || d.doc_id ELSE '' END AS delivery_id,
    CASE WHEN d.doc_id % 6 = 1 THEN 'upload failed' ELSE '' END AS delivery_error,
    d.doc_id % 4 AS delivery_attempts,
    CASE WHEN d.doc_id % 6 = 1 THEN TIMESTAMP '{AS_OF}' - to_minutes(d.doc_id * 17 % 400) END AS delivery_failed_at
  FROM documents d LEFT JOIN flags f ON f.doc_id = d.doc_id),
items AS (SELECT *, CASE WHEN status = 'failed' THEN err ELSE '' END AS error,
    CASE WHEN status = 'done' AND id % 7 <> 0
         THEN TIMESTAMP '{AS_OF}' - to_minutes(id * 104729 % 2880) END AS analyzed_at,
    status = 'done' AND NOT hidden AS visible FROM items0)
"""

TAGS_SQL = r"""
words0 AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents),
words1 AS (SELECT id, unnest(w) AS tag, generate_subscripts(w, 1) AS p FROM words0),
words2 AS (SELECT id, tag, min(p) AS p FROM words1 GROUP BY ALL),
item_tags AS (SELECT id, tag, pos FROM (
  SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY p) AS pos FROM words2)),
tag_lists AS (SELECT id, list(tag ORDER BY pos) AS tags FROM item_tags GROUP BY id)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, clip_vec, text_vec``; about half of the items have vectors."""
    e = table(spark, sf_dir, "embeddings")
    clip = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("clip_vec"))
    text = e.filter("vec_id > 0").select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("text_vec"))
    return clip.join(text, "id", "full")


def items_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a small side spares the whole texts a shuffle
    return items(spark, sf_dir).join(broadcast_if_small(vectors(spark, sf_dir)), "id", "left")


VECTORS_SQL = """
clip AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
tvec AS (SELECT vec_id - 1 AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id > 0)
"""


def hash_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, grid``: a 16 x 17 grid of word counts, the words placed by their md5."""
    cell = F.conv(F.substring(F.md5("w"), 1, 6), 16, 10).cast("bigint") % 272
    cells = (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("id"), F.explode(tokens("text")).alias("w"))
        .select("id", F.floor(cell / 17).cast("int").alias("row"), (cell % 17).cast("int").alias("at"))
    )
    counts = F.array(*[F.count_if(F.col("at") == i) for i in range(17)])
    zeros = F.array_repeat(F.lit(0).cast("bigint"), 17)

    return (
        cells.groupBy("id", "row")
        .agg(counts.alias("counts"))
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("row", "counts"))).alias("rows"))
        .select("id", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda r: F.coalesce(F.element_at("rows", r), zeros))).alias("grid"))
    )


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, phash``: the gradient hash of each grid, stored once as an ingest would."""
    return cut_lineage(hash_grids(spark, sf_dir).select("id", gradient_hash("grid").alias("phash")))


def items_with_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).join(hashes(spark, sf_dir), "id", "left")


def hash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_grids(spark, sf_dir).select("id", hash_text(gradient_hash("grid")).alias("bits"))


# one row per item: 256 characters '0'/'1'
HASH_SQL = r"""
htok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents),
hcell AS (SELECT id, ('0x' || substr(md5(w), 1, 6))::BIGINT % 272 AS cell, count(*) AS n FROM htok GROUP BY ALL),
hgrid AS (SELECT i.id, g.cell, coalesce(h.n, 0) AS n
  FROM (SELECT DISTINCT id FROM htok) i CROSS JOIN (SELECT unnest(range(272)) AS cell) g
  LEFT JOIN hcell h ON h.id = i.id AND h.cell = g.cell),
hbit AS (SELECT a.id, a.cell // 17 * 16 + a.cell % 17 AS pos, CASE WHEN a.n > b.n THEN '1' ELSE '0' END AS b
  FROM hgrid a JOIN hgrid b ON a.id = b.id AND b.cell = a.cell + 1 WHERE a.cell % 17 < 16),
hashes AS MATERIALIZED (SELECT id, string_agg(b, '' ORDER BY pos) AS bits FROM hbit GROUP BY id),
hw AS MATERIALIZED (SELECT id, bits, bits::BIT AS x, length(replace(bits, '0', '')) AS ones FROM hashes)
"""


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``q, text``: a short search for every benchmark passage.

    Its first three words, by id also as a quoted phrase, as alternatives, or
    with an excluded fourth word.
    """
    w = F.col("w")
    return (
        table(spark, sf_dir, "benchmark")
        .select(F.col("item_id").alias("q"), tokens("text").alias("w"))
        .select(
            "q",
            F.when(
                F.col("q") % 4 == 1, F.concat(F.lit('"'), w[0], F.lit(" "), w[1], F.lit('" '), w[2])
            )
            .when(F.col("q") % 4 == 2, F.concat_ws(" ", w[0], w[1], F.lit("or"), w[2]))
            .when(F.col("q") % 4 == 3, F.concat(w[0], F.lit(" "), w[1], F.lit(" -"), w[3]))
            .otherwise(F.concat_ws(" ", w[0], w[1], w[2]))
            .alias("text"),
        )
    )


# (q, alt, unit, neg, j, len, term): the same searches as parsed terms
SEARCH_TERMS_SQL = r"""
bw AS (SELECT item_id AS q, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
sq AS (SELECT q, CASE q % 4 WHEN 1 THEN '"' || w[1] || ' ' || w[2] || '" ' || w[3]
    WHEN 2 THEN w[1] || ' ' || w[2] || ' or ' || w[3]
    WHEN 3 THEN w[1] || ' ' || w[2] || ' -' || w[4]
    ELSE w[1] || ' ' || w[2] || ' ' || w[3] END AS text FROM bw),
sterms AS (
  SELECT q, 0 AS alt, 0 AS unit, false AS neg, 1 AS j, 1 AS len, w[1] AS term FROM bw WHERE q % 4 <> 1
  UNION ALL SELECT q, 0, 1, false, 1, 1, w[2] FROM bw WHERE q % 4 <> 1
  UNION ALL SELECT q, 0, 2, false, 1, 1, w[3] FROM bw WHERE q % 4 = 0
  UNION ALL SELECT q, 1, 3, false, 1, 1, w[3] FROM bw WHERE q % 4 = 2
  UNION ALL SELECT q, 0, 2, true, 1, 1, w[4] FROM bw WHERE q % 4 = 3
  UNION ALL SELECT q, 0, 0, false, 1, 2, w[1] FROM bw WHERE q % 4 = 1
  UNION ALL SELECT q, 0, 0, false, 2, 2, w[2] FROM bw WHERE q % 4 = 1
  UNION ALL SELECT q, 0, 1, false, 1, 1, w[3] FROM bw WHERE q % 4 = 1)
"""


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``q, qvec``: the stored vector with the number of each benchmark passage."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec"))
    return b.join(e, "q")


QUERY_VECTORS_SQL = """
qvecs AS (SELECT b.item_id AS q, e.embedding::DOUBLE[] AS qv FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)
"""


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per document source, with a cursor half way through its posts."""
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(
            F.max(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).alias("last_even"),
            F.min("doc_id").alias("first_id"),
            F.count("*").alias("n"),
            F.sum("n_chars").alias("chars"),
        )
        .select(
            F.substring("source", 4, 9).cast("bigint").alias("feed_id"),
            F.col("source").alias("name"),
            (F.col("chars") % 3 != 0).alias("enabled"),
            F.when(F.col("chars") % 4 == 0, 0).otherwise((F.col("chars") % 30).cast("int")).alias("backfill_limit"),
            F.when(F.col("chars") % 5 == 0, 0)
            .otherwise(F.floor((F.coalesce("last_even", F.lit(0)) + F.col("first_id")) / 2))
            .cast("bigint")
            .alias("last_post_id"),
            F.col("first_id").cast("bigint").alias("first_id"),
            (F.col("n") % 7).alias("added"),
            (F.col("n") % 5).alias("duplicates"),
            (F.col("n") % 3).alias("skipped"),
            (F.col("n") % 2).alias("failed"),
            (F.col("chars") % 11).alias("filtered"),
            (F.col("chars") % 13).alias("history_posts"),
            F.lit(False).alias("history_done"),
            minutes_before(F.col("chars") % 90 - 30).alias("next_poll_at"),
        )
    )


FEEDS_SQL = f"""
feeds0 AS (SELECT source, max(doc_id) FILTER (WHERE doc_id % 2 = 0) AS last_even, min(doc_id) AS first_id,
   count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source),
feeds AS (SELECT substr(source, 4)::BIGINT AS feed_id, source AS name, chars % 3 <> 0 AS enabled,
   CASE WHEN chars % 4 = 0 THEN 0 ELSE chars % 30 END AS backfill_limit,
   CASE WHEN chars % 5 = 0 THEN 0 ELSE (coalesce(last_even, 0) + first_id) // 2 END AS last_post_id, first_id,
   n % 7 AS added, n % 5 AS duplicates, n % 3 AS skipped, n % 2 AS failed, chars % 11 AS filtered,
   chars % 13 AS history_posts, false AS history_done,
   TIMESTAMP '{AS_OF}' - to_minutes(chars % 90 - 30) AS next_poll_at FROM feeds0)
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin links: one per feed item, a second one for every third document."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    feed = F.substring("source", 4, 9).cast("bigint")
    first = d.filter(i % 4 == 3).select(
        (i * 2).alias("source_id"),
        i.alias("item_id"),
        F.concat(F.lit("https://feeds.example/"), "source", F.lit("/"), i).alias("url"),
        F.lit("feed").alias("source"),
        feed.alias("feed_id"),
        i.alias("post_id"),
        F.substring("source", 1, 4000).alias("caption"),
        F.when(i % 8 == 3, minutes_before(i * 13 % 5000)).alias("posted_at"),
        minutes_before(i * 31 % 40000).alias("created_at"),
    )
    second = d.filter(i % 3 == 0).select(
        (i * 2 + 1).alias("source_id"),
        i.alias("item_id"),
        F.concat(F.lit("upload:"), F.sha2("text", 256), F.lit(":"), i).alias("url"),
        F.lit("upload").alias("source"),
        F.lit(None).cast("bigint").alias("feed_id"),
        F.lit(None).cast("bigint").alias("post_id"),
        F.lit("").alias("caption"),
        F.lit(None).cast("timestamp").alias("posted_at"),
        minutes_before(i * 37 % 40000).alias("created_at"),
    )
    return first.unionByName(second)


SOURCES_SQL = f"""
sources AS (
  SELECT doc_id * 2 AS source_id, doc_id AS item_id, 'https://feeds.example/' || source || '/' || doc_id AS url,
    'feed' AS source, substr(source, 4)::BIGINT AS feed_id, doc_id AS post_id, source AS caption,
    CASE WHEN doc_id % 8 = 3 THEN TIMESTAMP '{AS_OF}' - to_minutes(doc_id * 13 % 5000) END AS posted_at,
    TIMESTAMP '{AS_OF}' - to_minutes(doc_id * 31 % 40000) AS created_at FROM documents WHERE doc_id % 4 = 3
  UNION ALL
  SELECT doc_id * 2 + 1, doc_id, 'upload:' || sha256(text) || ':' || doc_id, 'upload', NULL, NULL, '', NULL,
    TIMESTAMP '{AS_OF}' - to_minutes(doc_id * 37 % 40000) FROM documents WHERE doc_id % 3 = 0)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with an instant for ``ts``."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
