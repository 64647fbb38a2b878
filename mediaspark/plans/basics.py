"""Queries for scalar functions (B), rules (E) and file facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media, rules, text
from . import bindings as b
from .registry import query

WS = text.WS


@query(
    "normalize_query",
    rf"""SELECT item_id AS q, trim(regexp_replace(lower(substr(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), 1, 200)),
    '{WS}+', ' ', 'g')) AS norm FROM benchmark""",
)
def normalize_query(spark, d):
    return b.table(spark, d, "benchmark").select(F.col("item_id").alias("q"), text.normalize_query("text").alias("norm"))


HEAD_SQL = "concat_ws(' ', i.title, i.template, i.song, array_to_string(coalesce(t.tags, []), ' '), i.p1 || ' ' || i.p2)"
SEARCH_SQL = (
    "concat_ws(chr(10), i.title, i.ocr_text, i.description, i.transcript, i.song, '', i.template, "
    "array_to_string(coalesce(t.tags, []), ' '), '', i.p1 || ' ' || i.p2, i.caption)"
)
TEXTS_SQL = f"""
texts AS (SELECT i.id, i.visible, i.kind, i.ocr_text, {HEAD_SQL} AS head, {SEARCH_SQL} AS search_text
  FROM items i LEFT JOIN tag_lists t ON t.id = i.id)
"""


@query("search_text", f"WITH {b.ITEMS_SQL}, {b.TAGS_SQL}, {TEXTS_SQL} SELECT id, search_text FROM texts")
def search_text(spark, d):
    return b.items(spark, d).select("id", text.search_text().alias("search_text"))


@query("head_text", f"WITH {b.ITEMS_SQL}, {b.TAGS_SQL}, {TEXTS_SQL} SELECT id, head AS head_text FROM texts")
def head_text(spark, d):
    return b.items(spark, d).select("id", text.head_text().alias("head_text"))


@query(
    "embedding_text",
    f"""WITH {b.ITEMS_SQL}, {b.TAGS_SQL}
    SELECT i.id, array_to_string(list_filter([i.title, i.ocr_text, i.description, i.template, i.p1 || ', ' || i.p2, '',
      array_to_string(coalesce(t.tags, []), ', '), substr(i.transcript, 1, 1000), i.song, ''], lambda x: x <> ''), chr(10))
      AS embedding_text
    FROM items i LEFT JOIN tag_lists t ON t.id = i.id""",
)
def embedding_text(spark, d):
    return b.items(spark, d).select("id", text.embedding_text().alias("embedding_text"))


@query(
    "clean_list",
    rf"""WITH raw AS (SELECT doc_id AS id, string_split_regex(text, '[,.]') AS l FROM documents),
    x AS (SELECT id, unnest(l) AS v, generate_subscripts(l, 1) AS p FROM raw),
    y AS (SELECT id, p, trim(trim(regexp_replace(v, '{WS}+', ' ', 'g')), ' #,.;') AS v FROM x),
    z AS (SELECT id, p, v, row_number() OVER (PARTITION BY id, lower(v) ORDER BY p) AS n
          FROM y WHERE v <> '' AND length(v) <= 120),
    r AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY p) AS pos FROM z WHERE n = 1)
    SELECT id, pos, v AS label FROM r WHERE pos <= 40""",
)
def clean_list(spark, d):
    return (
        b.table(spark, d, "documents")
        .select(F.col("doc_id").alias("id"), text.clean_list(F.split("text", "[,.]"), 40).alias("l"))
        .select("id", F.posexplode("l").alias("p", "label"))
        .select("id", (F.col("p") + 1).cast("bigint").alias("pos"), "label")
    )


def answers(spark, d):
    """A model answer per document: plain, fenced, wrapped in talk, or no JSON."""
    i = F.col("doc_id")
    body = F.to_json(
        F.struct(
            F.concat(F.lit(" "), "source", F.lit(" ")).alias("title"),
            F.col("text").alias("text"),
            F.lit("plain").alias("description"),
            F.upper("lang").alias("language"),
            (i % 3 == 0).alias("is_meme"),
            (i % 7 == 0).alias("is_ad"),
            F.array(F.lit("Cat"), F.lit("#cat"), F.col("source")).alias("tags"),
        )
    )
    raw = (
        F.when(i % 4 == 0, body)
        .when(i % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(i % 4 == 2, F.concat(F.lit("Here you are: "), body, F.lit(" Done.")))
        .otherwise(F.concat(F.lit("sorry, "), "source"))
    )
    return b.table(spark, d, "documents").select(i.alias("id"), raw.alias("raw"))


@query(
    "parse_analysis",
    rf"""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 3 THEN 'model response is not a JSON object' ELSE '' END AS error,
      CASE WHEN doc_id % 4 = 3 THEN '' ELSE source END AS title,
      CASE WHEN doc_id % 4 = 3 THEN '' ELSE substr(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), 1, 8000) END AS ocr_text,
      CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'plain' END AS description,
      CASE WHEN doc_id % 4 = 3 THEN '' ELSE lang END AS lang,
      doc_id % 4 = 3 OR doc_id % 3 = 0 AS is_meme, doc_id % 4 <> 3 AND doc_id % 7 = 0 AS is_ad,
      CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'cat|' || source END AS tags
    FROM documents""",
)
def parse_analysis(spark, d):
    p = answers(spark, d).select("id", text.parse_analysis("raw").alias("p"))
    return p.select(
        "id", "p.error", "p.title", "p.ocr_text", "p.description", "p.lang", "p.is_meme", "p.is_ad",
        F.array_join("p.tags", "|").alias("tags"),
    )


def compare_answers(spark, d):
    """A comparison answer per document, some with wild confidences."""
    i = F.col("doc_id")
    conf = (
        F.when(i % 6 == 0, F.lit('"high"'))
        .when(i % 6 == 1, F.lit("2"))
        .otherwise(F.format_string("%.2f", (i % 100) / 100.0))
    )
    raw = F.concat(
        F.lit('{"same": '), F.when(i % 3 == 0, "true").when(i % 3 == 1, "false").otherwise('"true"'),
        F.lit(', "confidence": '), conf, F.lit(', "reason": '),
        F.to_json(F.struct(F.col("text").alias("r"))).substr(F.lit(6), F.lit(1 << 30)),
    )
    # the inner object's closing brace is kept as the end of the answer
    raw = F.concat(F.regexp_replace(raw, r"\}$", ""), F.lit(', "better": '), (i % 4).cast("string"), F.lit("}"))
    return b.table(spark, d, "documents").select(i.alias("id"), raw.alias("raw"))


@query(
    "parse_compare",
    rf"""SELECT doc_id AS id, doc_id % 3 = 0 AS same,
      CASE doc_id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE round((doc_id % 100) / 100.0, 2) END::DOUBLE AS confidence,
      substr(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), 1, 500) AS reason,
      CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 1 END AS better FROM documents""",
)
def parse_compare(spark, d):
    p = compare_answers(spark, d).select("id", text.parse_compare("raw").alias("p"))
    return p.select("id", "p.same", "p.confidence", "p.reason", "p.better")


@query(
    "audio_window_starts",
    """WITH n AS (SELECT event_id, (value * 16000)::BIGINT AS n FROM events),
    s AS (SELECT event_id, n, CASE WHEN n < 8000 THEN [] WHEN n <= 160000 THEN [0]
      ELSE range(0, n - 80000, 160000) END AS l FROM n),
    t AS (SELECT event_id, CASE WHEN len(l) > 12
      THEN list_transform(range(12), lambda i: l[floor(i * (len(l) / 12.0))::INT + 1]) ELSE l END AS l FROM s)
    SELECT event_id, generate_subscripts(l, 1)::BIGINT AS pos, unnest(l)::BIGINT AS start FROM t""",
)
def audio_window_starts(spark, d):
    return (
        b.events(spark, d)
        .select("event_id", text.audio_window_starts(F.round(F.col("value") * 16000).cast("bigint")).alias("l"))
        .select("event_id", F.posexplode("l").alias("p", "start"))
        .select("event_id", (F.col("p") + 1).cast("bigint").alias("pos"), "start")
    )


@query(
    "prompt_text",
    r"""WITH x AS (SELECT doc_id AS id, doc_id % 3 AS m, text, source, n_chars FROM documents)
    SELECT id, concat_ws(chr(10) || chr(10),
      CASE m WHEN 0 THEN 'The item is the attached image.'
        ELSE 'The item is an ' || CASE m WHEN 1 THEN 'animated GIF' ELSE 'video' END || ' of ' ||
             printf('%.1f', n_chars / 1000.0) || ' s. The 2 attached images are its frames in time order (at 0.5s, 2.0s). Describe the whole clip.' END,
      CASE WHEN text <> '' THEN 'Speech transcript (machine made):' || chr(10) || '<<<' || chr(10) || substr(text, 1, 4000) || chr(10) || '>>>' END,
      CASE WHEN m = 2 THEN 'Sounds heard, strongest first: dog; cat' END,
      CASE WHEN m = 2 THEN 'Describe what is heard as well.' END,
      'Caption given by the uploader:' || chr(10) || '<<<' || chr(10) || source || chr(10) || '>>>',
      CASE WHEN id < 1000 THEN 'File name: IMG ' || id || '.jpg' END, 'Return one JSON object.') AS prompt FROM x""",
)
def prompt_text(spark, d):
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    cols = b.table(spark, d, "documents").select(
        i.alias("id"),
        F.when(i % 3 == 0, "image").when(i % 3 == 1, "gif").otherwise("video").alias("kind"),
        F.lit(2).alias("frame_count"),
        F.array(F.lit(0.5), F.lit(2.0)).alias("frame_times"),
        F.col("n_chars").alias("duration_ms"),
        F.col("text").alias("transcript"),
        F.col("source").alias("caption"),
        F.concat(F.lit("IMG "), i, F.lit(".jpg")).alias("original_name"),
        F.lit("").alias("extra"),
        F.when(i % 3 == 2, F.array(F.lit("dog"), F.lit("cat"))).otherwise(none).alias("sounds"),
        F.lit("").alias("song"),
    )
    return cols.select("id", text.prompt_text("Return one JSON object.").alias("prompt"))


@query(
    "clean_name",
    """WITH x AS (SELECT doc_id AS id, regexp_extract(replace(source || '\\' || replace(replace(text, chr(10), ' '), '/', ' '), '\\', '/'),
      '([^/]*)$', 1) AS s FROM documents),
    y AS (SELECT id, s, list_transform(range(0, least(length(s), 255) + 1), lambda n: strlen(substr(s, 1, n))) AS l FROM x)
    SELECT id, substr(s, 1, len(list_filter(l, lambda v: v <= 255)) - 1) AS name FROM y""",
)
def clean_name(spark, d):
    flat = F.regexp_replace(F.regexp_replace("text", "\n", " "), "/", " ")
    return b.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), text.clean_name(F.concat(F.col("source"), F.lit("\\"), flat)).alias("name")
    )


FEED_SQL = f"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '@' || replace(split_part(split_part(url, '/', 3), '.', 1), '-', '_')
    WHEN 1 THEN 'https://t.me/s/' || split_part(split_part(url, '/', 3), '.', 2) || '?x=' || page_id
    WHEN 2 THEN url ELSE ' telegram.me/JoinChat' END AS raw FROM pages),
  v AS (SELECT page_id, regexp_replace(raw, '^[[:space:]]+|[[:space:]]+$', '', 'g') AS s FROM u),
  w AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    s, '^@', ''), '^https?://', ''), '(?i)^(www\\.t\\.me/|t\\.me/|telegram\\.me/|telegram\\.dog/)', ''), '^s/', ''), '(?s)[/?#].*$', '')) AS s FROM v)
  SELECT page_id, CASE WHEN regexp_matches(s, '^[a-z][a-z0-9_]{{3,31}}$') AND s NOT IN {text.FEED_RESERVED!r} THEN s END AS name FROM w"""


@query("normalize_feed_name", FEED_SQL)
def normalize_feed_name(spark, d):
    p = F.col("page_id")
    host = F.split(F.split("url", "/")[2], r"\.")
    raw = (
        F.when(p % 4 == 0, F.concat(F.lit("@"), F.replace(host[0], F.lit("-"), F.lit("_"))))
        .when(p % 4 == 1, F.concat(F.lit("https://t.me/s/"), host[1], F.lit("?x="), p))
        .when(p % 4 == 2, F.col("url"))
        .otherwise(" telegram.me/JoinChat")
    )
    return b.table(spark, d, "pages").select("page_id", text.normalize_feed_name(raw).alias("name"))


# Example heads in hex, put before the text of each document.
HEADS = [
    "FFD8FFE0", "89504E470D0A1A0A", "474946383961", "5249464624000000574542505650", "00000020667479706973",
    "000000146674797071742020", "000000186674797068656963", "1A45DFA39F42868101", "1A45DFA301",
    "524946462400000041564920", "424D", "",
]


@query(
    "sniff_type",
    f"""WITH x AS (SELECT doc_id AS id, {HEADS!r}[CAST(doc_id % 12 + 1 AS INT)] || CASE WHEN doc_id % 12 = 7 THEN '7765626D' ELSE '' END
        || hex(encode(text)) AS h FROM documents),
    y AS (SELECT id, substr(h, 1, 1024) AS h, length(h) // 2 AS n FROM x),
    z AS (SELECT id, CASE
      WHEN n >= 12 AND substr(h, 9, 8) = '66747970' THEN CASE WHEN substr(h, 17, 8) = '71742020' THEN 'video video/quicktime mov'
        WHEN substr(h, 17, 8) IN ('68656963') THEN 'image image/heic heic' ELSE 'video video/mp4 mp4' END
      WHEN h LIKE '1A45DFA3%' THEN CASE WHEN regexp_matches(h, '^(..)*7765626D') THEN 'video video/webm webm' ELSE 'video video/x-matroska mkv' END
      WHEN h LIKE 'FFD8FF%' THEN 'image image/jpeg jpg' WHEN h LIKE '89504E470D0A1A0A%' THEN 'image image/png png'
      WHEN h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'gif image/gif gif'
      WHEN h LIKE '52494646%' AND substr(h, 17, 8) = '57454250' THEN 'image image/webp webp'
      WHEN h LIKE '52494646%' AND substr(h, 17, 8) = '41564920' THEN 'video video/x-msvideo avi'
      WHEN h LIKE '424D%' THEN 'image image/bmp bmp' END AS t FROM y)
    SELECT id, split_part(t, ' ', 1) AS kind, split_part(t, ' ', 2) AS mime, split_part(t, ' ', 3) AS ext FROM z""",
)
def sniff_type(spark, d):
    return contents(spark, d).select("id", media.sniff_type("content").alias("m")).select("id", "m.kind", "m.mime", "m.ext")


def contents(spark, d):
    """File bytes per document: an example head, then its text."""
    i = F.col("doc_id")
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (i % 12 + 1).cast("int"))
    head = F.concat(head, F.when(i % 12 == 7, "7765626D").otherwise(""))
    return b.table(spark, d, "documents").select(
        i.alias("id"), "source", F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content")
    )


@query(
    "content_path",
    """SELECT doc_id AS id, concat_ws('/', 'originals', substr(sha256(text), 1, 2), substr(sha256(text), 3, 2), sha256(text) || '.jpg') AS original,
    concat_ws('/', 'thumbs', substr(sha256(text), 1, 2), substr(sha256(text), 3, 2), sha256(text) || '.webp') AS thumb FROM documents""",
)
def content_path(spark, d):
    return (
        b.table(spark, d, "documents")
        .select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"))
        .select("id", media.original_path("sha", F.lit("jpg")).alias("original"), media.thumb_path("sha").alias("thumb"))
    )


# --- rules -------------------------------------------------------------------

PROMO = ["", "", " #Реклама ", " промокод X1 ", " Sponsored link ", " скидка до 50 % курс ", " buy now, limited offer @other_feed ", " t.me/+Invite "]


def posts(spark, d):
    """Posts: the text of each document, with promotion wording added by id."""
    i = F.col("doc_id")
    add = F.element_at(F.array(*[F.lit(p) for p in PROMO]), (i % 8 + 1).cast("int"))
    links = F.when(i % 5 == 0, F.array(F.lit("https://t.me/some_feed/1"), F.lit("https://shop.example/"))).otherwise(
        F.array().cast("array<string>")
    )
    return b.table(spark, d, "documents").select(
        i.alias("id"), F.concat(add, F.col("text")).alias("text"), links.alias("links"),
        (i % 3).cast("int").alias("buttons"), F.col("source").alias("feed"), (i % 6 != 0).alias("has_media"),
    )


POSTS_SQL = f"""
posts AS (SELECT doc_id AS id, {PROMO!r}[CAST(doc_id % 8 + 1 AS INT)] || text AS text,
  CASE WHEN doc_id % 5 = 0 THEN ['https://t.me/some_feed/1', 'https://shop.example/'] ELSE [] END AS links,
  doc_id % 3 AS buttons, source AS feed, doc_id % 6 <> 0 AS has_media FROM documents)
"""


def re2(pattern: str) -> str:
    """A pattern with Unicode word rules, spelled for an engine with ASCII ones."""
    p = pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\d", "[0-9]").replace(r"\s", WS)
    if p.startswith(r"\b"):
        p = r"(?:^|[^\p{L}\p{N}_])" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + r"(?:$|[^\p{L}\p{N}_])"
    return "(?i)" + p


def _hit(pattern: str) -> str:
    p = pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\d", "[0-9]").replace(r"\s", WS)
    lead = trail = ""
    if p.startswith(r"\b"):
        lead, p = r"(?:^|[^\p{L}\p{N}_])", p[2:]
    if p.endswith(r"\b"):
        trail, p = r"(?:$|[^\p{L}\p{N}_])", p[:-2]
    return f"(?i){lead}({p}){trail}"


STRONG_SQL = (
    "coalesce("
    + ", ".join(
        f"CASE WHEN regexp_matches(lower(text), '{_hit(p)}') THEN 'advertisement: ' || trim(regexp_extract(lower(text), '{_hit(p)}', 1)) END"
        for p in rules.STRONG_AD
    )
    + ", '')"
)
W = r"[\p{L}\p{N}_]"
URL_SQL = r"(?i)(https?://[^\s]+|(?:t\.me|telegram\.me)/[^\s]+)"
PROMO_SQL = f"""
purls AS (SELECT id, list_distinct(list_transform(list_concat(links, regexp_extract_all(text, '{URL_SQL}')),
  lambda u: lower(rtrim(u, '/.,)')))) AS urls FROM posts),
pfor AS (SELECT DISTINCT id, h FROM (
   SELECT id, lower(regexp_extract(u, '(?i)(?:https?://)?(?:t\\.me|telegram\\.me)/(?:s/)?([A-Za-z]{W}{{3,31}})', 1)) AS h
     FROM (SELECT id, unnest(urls) AS u FROM purls)
   UNION ALL SELECT id, lower(regexp_extract(m, '@([A-Za-z]{W}{{3,31}})', 1)) FROM (
     SELECT id, unnest(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_/])@[A-Za-z]{W}{{3,31}}')) AS m FROM posts))
   WHERE h <> ''),
pfc AS (SELECT f.id, count(*) AS n FROM pfor f JOIN posts p ON p.id = f.id WHERE f.h <> lower(p.feed) GROUP BY f.id),
promo AS (SELECT p.id, ({' + '.join(f"regexp_matches(lower(p.text), '{re2(x)}')::INT" for x in rules.WEAK_AD)})
   + 2 * len(list_filter(u.urls, lambda x: regexp_matches(x, '(?i)(t\\.me|telegram\\.me)/(\\+|joinchat/)')
        OR regexp_matches(x, '(?i)(t\\.me|telegram\\.me)/{W}+\\?start=')))
   + coalesce(f.n, 0) + (p.buttons > 0)::INT + (len(u.urls) >= 3)::INT AS score
   FROM posts p JOIN purls u ON u.id = p.id LEFT JOIN pfc f ON f.id = p.id)
"""
LONG_SQL = f"length(regexp_replace(regexp_replace(text, '{URL_SQL}', '', 'g'), '^{WS}+|{WS}+$', '', 'g')) > 700"


@query("strong_ad", f"WITH {POSTS_SQL} SELECT id, {STRONG_SQL} AS reason FROM posts")
def strong_ad(spark, d):
    return posts(spark, d).select("id", rules.strong_ad("text").alias("reason"))


@query("promo_score", f"WITH {POSTS_SQL}, {PROMO_SQL} SELECT id, score::BIGINT AS score FROM promo")
def promo_score(spark, d):
    return posts(spark, d).select("id", rules.promo_score("text", "links", "buttons", "feed").cast("bigint").alias("score"))


@query("long_text", f"WITH {POSTS_SQL} SELECT id, {LONG_SQL} AS is_long FROM posts")
def long_text(spark, d):
    return posts(spark, d).select("id", rules.long_text("text").alias("is_long"))


VERDICT_SQL = f"""
verdicts AS (SELECT id, CASE WHEN NOT has_media THEN '' ELSE coalesce(nullif(s, ''), CASE WHEN score >= 3
  THEN 'advertisement (links and promo wording)' END, CASE WHEN l THEN 'not a meme (long text post)' END, '') END AS verdict
  FROM (SELECT p.*, {STRONG_SQL} AS s, {LONG_SQL} AS l, m.score FROM posts p JOIN promo m ON m.id = p.id))
"""


@query("post_verdict", f"WITH {POSTS_SQL}, {PROMO_SQL}, {VERDICT_SQL} SELECT id, verdict FROM verdicts")
def post_verdict(spark, d):
    return posts(spark, d).select(
        "id", rules.post_verdict("text", "links", "buttons", "feed", "has_media").alias("verdict")
    )


@query(
    "analysis_verdict",
    """SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'advertisement (analysis)' WHEN quality = 0 THEN 'not a meme (analysis)' ELSE '' END AS verdict
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def analysis_verdict(spark, d):
    flags = b.table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("ad"), (F.col("quality") == 1).alias("fit"))
    return (
        b.table(spark, d, "documents")
        .join(flags, "doc_id", "left")
        .select(F.col("doc_id").alias("id"), rules.analysis_verdict("ad", "fit").alias("verdict"))
    )


def _like(words: list[str]) -> str:
    return " OR ".join("contains(m, '" + w.replace("'", "''") + "')" for w in words)


@query(
    "classify_error",
    f"""WITH {b.ITEMS_SQL}, m AS (SELECT id, lower(err || ' ' || ocr_text) AS m FROM items)
    SELECT id, CASE WHEN {_like(rules.LIMIT_MARKERS)} THEN 'limit' WHEN {_like(rules.AUTH_MARKERS)} THEN 'auth'
    WHEN {_like(rules.TRANSIENT_MARKERS)} THEN 'transient' ELSE 'other' END AS error_class FROM m""",
)
def classify_error(spark, d):
    return messages(spark, d).select("id", rules.classify_error("m").alias("error_class"))


def messages(spark, d):
    """Error texts: a failure message followed by the whole text of the document."""
    i = F.col("doc_id")
    err = F.element_at(F.array(*[F.lit(e) for e in b.ERRORS]), (i % 7 + 1).cast("int"))
    return b.table(spark, d, "documents").select(i.alias("id"), F.concat(err, F.lit(" "), "text").alias("m"))


TRANSIENT_SQL = rules.TRANSIENT_PATTERN.replace("'", "''")


@query(
    "transient_error",
    f"WITH {b.ITEMS_SQL} SELECT id, regexp_matches(err || ' ' || ocr_text, '(?i){TRANSIENT_SQL}') AS retryable FROM items",
)
def transient_error(spark, d):
    return messages(spark, d).select("id", rules.transient_error("m").alias("retryable"))


@query(
    "parse_sections",
    rf"""SELECT doc_id AS id, 'about ' || source AS description,
      regexp_replace(regexp_extract(text || chr(10) || '3.', '(?s)^(.*?)(?:VISUAL CHARACTERISTICS|CONTENT CONTEXT|3\.)', 1), '^{WS}+|{WS}+$', '', 'g') AS ocr_text,
      CASE doc_id % 3 WHEN 0 THEN CASE WHEN regexp_matches(text, '\[[^\n]*\]') THEN '["one|two"]' ELSE 'one|two' END WHEN 1 THEN 'red|blue' ELSE source || '|last' END AS tags
    FROM documents""",
)
def parse_sections(spark, d):
    i = F.col("doc_id")
    tail = (
        F.when(i % 3 == 0, F.lit('["one", "two"]'))
        .when(i % 3 == 1, F.lit("- red\n- \"blue\""))
        .otherwise(F.concat("source", F.lit(", last")))
    )
    raw = F.concat(
        F.lit("1. VISUAL DESCRIPTION: about "), "source", F.lit("\nTEXT EXTRACTION: "), "text",
        F.lit("\n3. VISUAL CHARACTERISTICS: none\nSEARCH TAGS: "), tail,
    )
    return (
        b.table(spark, d, "documents")
        .select(i.alias("id"), text.parse_sections(raw).alias("p"))
        .select("id", "p.description", "p.ocr_text", F.array_join("p.tags", "|").alias("tags"))
    )
