"""Queries for listing, full text, fuzzy, vectors, fusion and similarity (C, B4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import visible
from ..operators import fulltext, fuzzy, knn, retrieval, similar
from ..functions.text import ENGLISH_SUFFIX, RUSSIAN_SUFFIX
from . import bindings as b
from .basics import TEXTS_SQL
from .registry import query


def stem_sql(col: str, config: str) -> str:
    if config == "simple":
        return col
    cut = f"regexp_replace({col}, '{ENGLISH_SUFFIX if config == 'english' else RUSSIAN_SUFFIX}', '')"
    return f"CASE WHEN length({cut}) >= 3 THEN {cut} ELSE {col} END"


TOK = r"'[\p{L}\p{N}]+'"
POSTINGS_SQL = f"""
ptok AS (SELECT id, visible, list_concat(regexp_extract_all(lower(head), {TOK}), regexp_extract_all(lower(ocr_text), {TOK})) AS a,
   regexp_extract_all(lower(search_text), {TOK}) AS b FROM texts),
pall AS (SELECT id, visible, 'simple' AS config, 'A' AS cls, unnest(a) AS w, generate_subscripts(a, 1) AS pos FROM ptok
  UNION ALL SELECT id, visible, 'russian', 'B', unnest(b), generate_subscripts(b, 1) + len(a) FROM ptok
  UNION ALL SELECT id, visible, 'english', 'C', unnest(b), generate_subscripts(b, 1) + len(a) + len(b) FROM ptok),
vocab AS (SELECT config, w, CASE config WHEN 'simple' THEN w WHEN 'russian' THEN {stem_sql('w', 'russian')}
  ELSE {stem_sql('w', 'english')} END AS term FROM (SELECT DISTINCT config, w FROM pall)),
postings AS MATERIALIZED (SELECT p.id, p.visible, p.config, p.cls, v.term, p.pos FROM pall p JOIN vocab v USING (config, w))
"""
ALL_TEXT = f"{b.ITEMS_SQL}, {b.TAGS_SQL}, {TEXTS_SQL}"


@query(
    "weighted_postings",
    f"""WITH {ALL_TEXT}, {POSTINGS_SQL} SELECT config, cls AS "class", term, count(DISTINCT id) AS docs, count(*) AS hits,
    sum(pos)::BIGINT AS pos_sum FROM postings GROUP BY ALL""",
)
def weighted_postings(spark, d):
    return fulltext.posting_totals(b.items(spark, d))


@query("visible_filter", f"WITH {b.ITEMS_SQL} SELECT id, kind FROM items WHERE visible AND kind = 'image'")
def visible_filter(spark, d):
    return visible(b.items(spark, d), "image").select("id", "kind")


@query(
    "list_page",
    f"WITH {b.ITEMS_SQL} SELECT id, title FROM items WHERE visible AND kind = 'image' AND id < (SELECT max(id) * 9 // 10 FROM items) ORDER BY id DESC LIMIT 48 OFFSET 10",
)
def list_page(spark, d):
    return retrieval.list_page(b.items(spark, d), kind="image", public=True, before_id=b.cursor(spark, d), offset=10).select("id", "title")


@query(
    "lookup_ordered",
    f"""WITH {b.ITEMS_SQL}, l AS (SELECT item_id AS list_id, unnest([item_id * 7, item_id * 3, item_id * 1000003, item_id]) AS id,
      generate_subscripts([1, 2, 3, 4], 1) - 1 AS pos FROM benchmark)
    SELECT l.list_id, l.pos::BIGINT AS pos, i.id, i.title FROM l JOIN items i ON i.id = l.id""",
)
def lookup_ordered(spark, d):
    i = F.col("item_id")
    lists = b.table(spark, d, "benchmark").select(i.alias("list_id"), F.array(i * 7, i * 3, i * 1000003, i).alias("ids"))
    return retrieval.lookup_ordered(b.items(spark, d), lists).select(
        "list_id", F.col("pos").cast("bigint").alias("pos"), "id", "title"
    )


# the searches as stemmed terms with numbered units
FTS_SQL = f"""
{b.SEARCH_TERMS_SQL},
cfgs AS (SELECT unnest(['simple', 'russian', 'english']) AS config),
cterms AS (SELECT s.*, c.config, CASE c.config WHEN 'simple' THEN term WHEN 'russian' THEN {stem_sql('term', 'russian')}
  ELSE {stem_sql('term', 'english')} END AS t FROM sterms s CROSS JOIN cfgs c),
cnum AS (SELECT *, dense_rank() OVER (PARTITION BY q, config, alt, neg ORDER BY unit) - 1 AS u FROM cterms),
alts AS (SELECT q, config, alt, count(DISTINCT u) AS n FROM cnum WHERE NOT neg GROUP BY ALL),
occ AS (SELECT c.q, p.id, c.config, c.alt, c.neg, c.u, p.pos - c.j AS start FROM postings p
  JOIN cnum c ON c.config = p.config AND c.t = p.term WHERE p.visible
  GROUP BY c.q, p.id, c.config, c.alt, c.neg, c.u, c.len, p.pos - c.j HAVING count(*) = c.len),
fmatch AS (SELECT o.q, o.id, o.config, o.alt, a.n FROM occ o JOIN alts a USING (q, config, alt)
  GROUP BY o.q, o.id, o.config, o.alt, a.n
  HAVING count(DISTINCT CASE WHEN NOT neg THEN u END) = a.n AND count(*) FILTER (WHERE neg) = 0),
good AS (SELECT o.q, o.id, o.config, o.alt, o.u, o.start, m.n FROM occ o JOIN fmatch m USING (q, id, config, alt) WHERE NOT o.neg),
lastpos AS (SELECT g.*, k.u AS ku, max(CASE WHEN g.u = k.u THEN g.start END) OVER (
    PARTITION BY g.q, g.id, g.config, g.alt, k.u ORDER BY g.start, g.u ROWS UNBOUNDED PRECEDING) AS last
  FROM good g JOIN (SELECT unnest(range(20)) AS u) k ON k.u < g.n),
lows AS (SELECT q, id, config, alt, start, u, n, CASE WHEN count(last) = n THEN min(last) END AS low FROM lastpos GROUP BY q, id, config, alt, start, u, n),
covers AS (SELECT *, lag(low) OVER (PARTITION BY q, id, config, alt ORDER BY start, u) AS prev FROM lows),
density AS (SELECT q, id, sum(CASE config WHEN 'simple' THEN 1.0 WHEN 'russian' THEN 0.4 ELSE 0.2 END::DOUBLE
    / (1.0::DOUBLE + greatest(start - low - (n - 1), 0))) AS s
  FROM covers WHERE low IS NOT NULL AND (prev IS NULL OR low > prev) GROUP BY ALL),
frank0 AS (SELECT q, id, round(s / (s + 1), 9) AS score FROM density),
fts AS (SELECT q, id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id DESC) AS r FROM frank0) WHERE r <= 240)
"""


@query("fts_match", f"WITH {ALL_TEXT}, {POSTINGS_SQL}, {FTS_SQL} SELECT DISTINCT q, id, config FROM fmatch")
def fts_match(spark, d):
    return fulltext.fts_match(visible(b.items(spark, d)), b.search_queries(spark, d))


@query("fts_rank", f"WITH {ALL_TEXT}, {POSTINGS_SQL}, {FTS_SQL} SELECT q, id, score, r FROM fts")
def fts_rank(spark, d):
    return fulltext.fts_rank(visible(b.items(spark, d)), b.search_queries(spark, d)).withColumn("r", F.col("r").cast("bigint"))


FUZZY_SQL = rf"""
fq AS (SELECT q, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM sq
  WHERE length(text) BETWEEN 4 AND 40 AND len(string_split(text, ' ')) <= 4),
fqw AS (SELECT q, len(w) AS run, unnest(w) AS word FROM fq),
fqt AS (SELECT DISTINCT q, run, substr('  ' || word || ' ', i::INT, 3) AS g FROM fqw, LATERAL (SELECT unnest(range(1, length(word) + 2)) AS i)),
fqn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY g) - 1 AS bit, count(*) OVER (PARTITION BY q) AS n FROM fqt),
fw AS (SELECT id, unnest(regexp_extract_all(lower(search_text), {TOK})) AS word,
   generate_subscripts(regexp_extract_all(lower(search_text), {TOK}), 1) AS pos FROM texts WHERE visible),
fv AS (SELECT DISTINCT word FROM fw),
fvg AS (SELECT DISTINCT word, substr('  ' || word || ' ', i::INT, 3) AS g FROM fv, LATERAL (SELECT unnest(range(1, length(word) + 2)) AS i)),
fmask AS (SELECT q, word, run, n, bit_or(1::BIGINT << bit) AS mask FROM fqn JOIN fvg USING (g) GROUP BY ALL),
fhit AS (SELECT q, id, pos, run, n, mask FROM fw JOIN fmask USING (word)),
fwin AS (SELECT q, id, n, CASE run
   WHEN 1 THEN mask
   WHEN 2 THEN bit_or(mask) OVER (PARTITION BY q, id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING)
   WHEN 3 THEN bit_or(mask) OVER (PARTITION BY q, id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)
   ELSE bit_or(mask) OVER (PARTITION BY q, id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING) END AS m FROM fhit),
fscore AS (SELECT q, id, round(max(bit_count(m)) / max(n)::DOUBLE, 9) AS score FROM fwin GROUP BY q, id),
fuzzy AS (SELECT q, id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id DESC) AS r
  FROM fscore WHERE score >= 0.35) WHERE r <= 240)
"""


@query("fuzzy_match", f"WITH {ALL_TEXT}, {b.SEARCH_TERMS_SQL}, {FUZZY_SQL} SELECT q, id, score, r FROM fuzzy")
def fuzzy_match(spark, d):
    return fuzzy.fuzzy_match(visible(b.items(spark, d)), b.search_queries(spark, d)).withColumn("r", F.col("r").cast("bigint"))


GATE_SQL = "gated AS (SELECT * FROM fuzzy WHERE q NOT IN (SELECT q FROM fts GROUP BY q HAVING count(*) >= 20))"


@query("fuzzy_gate", f"WITH {ALL_TEXT}, {POSTINGS_SQL}, {FTS_SQL}, {FUZZY_SQL}, {GATE_SQL} SELECT q, id, score, r FROM gated")
def fuzzy_gate(spark, d):
    shown, q = visible(b.items(spark, d)), b.search_queries(spark, d)
    out = fuzzy.fuzzy_gate(fuzzy.fuzzy_match(shown, q), fulltext.fts_rank(shown, q))
    return out.withColumn("r", F.col("r").cast("bigint"))


def knn_sql(name: str, queries: str, items: str, k: int, where: str = "true") -> str:
    """``name(q, id, d, r)``: brute force over (q, qv) and (id, v)."""
    return f"""
{name}0 AS (SELECT a.q, b.id, round(list_cosine_distance(a.qv, b.v), 9) AS d FROM {queries} a CROSS JOIN {items} b WHERE {where}),
{name} AS (SELECT q, id, d, r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id DESC) AS r FROM {name}0) WHERE r <= {k})
"""


SHOWN_VECS = """
sclip AS (SELECT c.id, c.v, i.kind FROM clip c JOIN items i ON i.id = c.id WHERE i.visible),
stext AS (SELECT c.id, c.v FROM tvec c JOIN items i ON i.id = c.id WHERE i.visible)
"""
VEC_BASE = f"{b.ITEMS_SQL}, {b.VECTORS_SQL}, {b.QUERY_VECTORS_SQL}, {SHOWN_VECS}"
# the nearest stored vectors are about 0.49 apart, so limits of this size select
TEXT_MAX, CLIP_MAX = 0.9, 0.95


def out_knn(df, q="q"):
    return df.select(q, "id", F.round("d", 6).alias("d"), F.col("r").cast("bigint").alias("r"))


@query(
    "knn_text",
    f"WITH {VEC_BASE}, {knn_sql('nn', 'qvecs', 'stext', 240)} SELECT q, id, round(d, 6) AS d, r FROM nn WHERE d < {TEXT_MAX}",
)
def knn_text(spark, d):
    shown = visible(b.items_with_vectors(spark, d)).select("id", F.col("text_vec").alias("vec"))
    return out_knn(knn.knn_below(b.query_vectors(spark, d), shown, 240, TEXT_MAX))


@query(
    "knn_image",
    f"WITH {VEC_BASE}, {knn_sql('nn', 'qvecs', 'sclip', 240)} SELECT q, id, round(d, 6) AS d, r FROM nn WHERE d < {CLIP_MAX}",
)
def knn_image(spark, d):
    shown = visible(b.items_with_vectors(spark, d)).select("id", F.col("clip_vec").alias("vec"))
    return out_knn(knn.knn_below(b.query_vectors(spark, d), shown, 240, CLIP_MAX))


FUSE_SQL = f"""
{knn_sql('tv', 'qvecs', 'stext', 240)}, {knn_sql('cv', 'qvecs', 'sclip', 240)},
weighted AS (SELECT q, id, r, 1.3::DOUBLE AS w FROM fts UNION ALL SELECT q, id, r, 1.0 FROM gated
  UNION ALL SELECT q, id, r, 0.9 FROM tv WHERE d < {TEXT_MAX} UNION ALL SELECT q, id, r, 0.9 FROM cv WHERE d < {CLIP_MAX}),
fused0 AS (SELECT q, id, round(sum(w / (60.0::DOUBLE + r)), 9) AS score FROM weighted GROUP BY q, id),
fused AS (SELECT * FROM (SELECT f.q, f.id, f.score, row_number() OVER (PARTITION BY f.q ORDER BY f.score DESC, f.id DESC) AS r
   FROM fused0 f JOIN items i ON i.id = f.id WHERE i.visible) WHERE r <= 240)
"""
HYBRID_SQL = f"""{ALL_TEXT}, {POSTINGS_SQL}, {FTS_SQL}, {FUZZY_SQL}, {GATE_SQL}, {b.VECTORS_SQL}, {b.QUERY_VECTORS_SQL},
  {SHOWN_VECS}, {FUSE_SQL}"""


@query(
    "rrf_fuse",
    f"""WITH {VEC_BASE}, {knn_sql('tv', 'qvecs', 'stext', 240)}, {knn_sql('cv', 'qvecs', 'sclip', 240)},
    x AS (SELECT q, id, round(sum(0.9::DOUBLE / (60.0::DOUBLE + r)), 9) AS score FROM (SELECT q, id, r FROM tv UNION ALL SELECT q, id, r FROM cv) GROUP BY q, id),
    y AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id DESC) AS r FROM x)
    SELECT q, id, score, r FROM y WHERE r <= 240""",
)
def rrf_fuse(spark, d):
    items = b.items_with_vectors(spark, d)
    shown, q = visible(items), b.query_vectors(spark, d)
    lists = {
        name: knn.knn(q, shown.select("id", F.col(name).alias("vec")), 240) for name in ("text_vec", "clip_vec")
    }
    return retrieval.rrf_fuse(lists, items).select("q", "id", "score", F.col("r").cast("bigint").alias("r"))


@query(
    "hybrid_search",
    f"""WITH {HYBRID_SQL}, t AS (SELECT q, count(*) AS total FROM fused GROUP BY q)
    SELECT f.q, f.id, f.score, f.r, t.total, f.q IN (SELECT q FROM qvecs) AS semantic
    FROM fused f JOIN t ON t.q = f.q WHERE f.r BETWEEN 6 AND 25""",
)
def hybrid_search(spark, d):
    vecs = b.query_vectors(spark, d)
    return retrieval.hybrid_search(
        b.items_with_vectors(spark, d), b.search_queries(spark, d), vecs, vecs, text_max=TEXT_MAX, clip_max=CLIP_MAX, offset=5
    ).select("q", "id", "score", F.col("r").cast("bigint").alias("r"), "total", "semantic")


@query(
    "search_by_vector",
    f"""WITH {VEC_BASE}, {knn_sql('nn', 'qvecs', 'sclip', 30, "b.kind = 'image' AND b.id <> a.q")}
    SELECT q, id, round(d, 6) AS d, r FROM nn WHERE r > 10""",
)
def search_by_vector(spark, d):
    q = b.query_vectors(spark, d).withColumn("exclude", F.col("q"))
    return out_knn(retrieval.search_by_vector(b.items_with_vectors(spark, d), q, "image", 20, 10))


SELF_SQL = "selfq AS (SELECT c.id AS q, c.v AS qv FROM clip c JOIN items i ON i.id = c.id)"
LOOK_MAX = 0.75


@query(
    "look_alike",
    f"""WITH {VEC_BASE}, {SELF_SQL}, {knn_sql('nn', 'selfq', 'sclip', 12, 'b.id <> a.q')}
    SELECT q, id, round(d, 6) AS d, r FROM nn WHERE d <= {LOOK_MAX}""",
)
def look_alike(spark, d):
    return out_knn(retrieval.look_alike(b.items_with_vectors(spark, d), 12, LOOK_MAX))


@query(
    "tag_stats",
    f"WITH {b.ITEMS_SQL}, {b.TAGS_SQL} SELECT t.tag, count(*) AS n FROM item_tags t JOIN items i ON i.id = t.id WHERE i.visible GROUP BY t.tag",
)
def tag_stats(spark, d):
    return similar.tag_stats(b.items(spark, d))


TAG_SQL = f"""
stats AS (SELECT t.tag, count(*) AS n FROM item_tags t JOIN items i ON i.id = t.id WHERE i.visible GROUP BY t.tag),
tot AS (SELECT greatest(count(*)::DOUBLE, 1.0) AS total FROM items WHERE visible),
own AS (SELECT id, tag, n, w FROM (SELECT t.id, t.tag, s.n, ln(tot.total / s.n) AS w,
    row_number() OVER (PARTITION BY t.id ORDER BY s.n, t.tag) AS k
  FROM item_tags t JOIN stats s ON s.tag = t.tag, tot WHERE s.n > 1 AND s.n <= tot.total * 0.03) WHERE k <= 12)
"""


@query("tag_idf", f"WITH {b.ITEMS_SQL}, {b.TAGS_SQL}, {TAG_SQL} SELECT id, tag, n, round(w, 9) AS w FROM own")
def tag_idf(spark, d):
    items = b.items(spark, d)
    return similar.tag_idf(items, similar.tag_stats(items)).withColumn("w", F.round("w", 9))


SIM_TAGS_SQL = """
stag AS (SELECT id, other, s, r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other DESC) AS r FROM (
  SELECT o.id, t.id AS other, round(sum(o.w), 9) AS s FROM own o JOIN item_tags t ON t.tag = o.tag JOIN items i ON i.id = t.id
  WHERE i.visible AND t.id <> o.id GROUP BY o.id, t.id)) WHERE r <= 144)
"""


@query("sim_tags", f"WITH {b.ITEMS_SQL}, {b.TAGS_SQL}, {TAG_SQL}, {SIM_TAGS_SQL} SELECT id, other, s, r FROM stag")
def sim_tags(spark, d):
    items = b.items(spark, d)
    return similar.sim_tags(items, similar.tag_stats(items)).withColumn("r", F.col("r").cast("bigint"))


SIM_KIN_SQL = """
kin0 AS (SELECT a.id, o.id AS other, (CASE WHEN lower(a.template) = lower(o.template) THEN 2 ELSE 0 END)
    + len(list_intersect(list_distinct([a.p1, a.p2]), list_distinct([o.p1, o.p2]))) AS s
  FROM items a JOIN items o ON a.id <> o.id AND o.visible),
skin AS (SELECT id, other, s, r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other DESC) AS r FROM kin0 WHERE s > 0) WHERE r <= 144)
"""


@query("sim_template_people", f"WITH {b.ITEMS_SQL}, {SIM_KIN_SQL} SELECT id, other, s, r FROM skin")
def sim_template_people(spark, d):
    return similar.sim_template_people(b.items(spark, d)).select(
        "id", "other", F.col("s").cast("bigint").alias("s"), F.col("r").cast("bigint").alias("r")
    )


SIM_VEC_SQL = f"""
selfc AS (SELECT c.id AS q, c.v AS qv FROM clip c JOIN items i ON i.id = c.id),
selft AS (SELECT c.id AS q, c.v AS qv FROM tvec c JOIN items i ON i.id = c.id),
{knn_sql('svc', 'selfc', 'sclip', 144)}, {knn_sql('svt', 'selft', 'stext', 144)}
"""


@query(
    "sim_vectors",
    f"""WITH {VEC_BASE}, {SIM_VEC_SQL} SELECT 'clip' AS vec, q AS id, id AS other, round(d, 6) AS d, r FROM svc
    UNION ALL SELECT 'text', q, id, round(d, 6), r FROM svt""",
)
def sim_vectors(spark, d):
    items = b.items_with_vectors(spark, d)
    parts = [
        similar.sim_vectors(items, col).select(
            F.lit(name).alias("vec"), "id", "other", F.round("d", 6).alias("d"), F.col("r").cast("bigint").alias("r")
        )
        for name, col in (("clip", "clip_vec"), ("text", "text_vec"))
    ]
    return parts[0].unionByName(parts[1])


SAME, LOOK = 0.6, 0.8
SIMILAR_SQL = f"""
sall AS (SELECT q AS id, id AS other, r, 1.0::DOUBLE AS w FROM svt UNION ALL SELECT id, other, r, 1.3 FROM stag
  UNION ALL SELECT id, other, r, 1.2 FROM skin
  UNION ALL SELECT q, id, r, CASE WHEN d < {SAME} THEN 4.0 WHEN d <= {LOOK} THEN 2.4 ELSE 0.6 END FROM svc),
sfused AS (SELECT s.id, s.other, round(sum(s.w / (30.0::DOUBLE + s.r)), 9) AS score FROM sall s JOIN items i ON i.id = s.other AND i.visible
  WHERE s.id <> s.other AND (s.id IN (SELECT id FROM clip) OR s.id IN (SELECT id FROM tvec)) GROUP BY s.id, s.other),
kinship AS (SELECT id, other, score, r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other DESC) AS r FROM sfused) WHERE r <= 36)
"""


@query(
    "similar_items",
    f"""WITH {b.ITEMS_SQL}, {b.TAGS_SQL}, {b.VECTORS_SQL}, {b.QUERY_VECTORS_SQL}, {SHOWN_VECS}, {TAG_SQL}, {SIM_TAGS_SQL}, {SIM_KIN_SQL},
    {SIM_VEC_SQL}, {SIMILAR_SQL} SELECT id, other, score, r FROM kinship""",
)
def similar_items(spark, d):
    items = b.items_with_vectors(spark, d)
    return similar.similar_items(items, similar.tag_stats(items), same=SAME, look_max=LOOK).withColumn(
        "r", F.col("r").cast("bigint")
    )


def stored(spark, d):
    """Stored neighbour lists: ids around each document, computed at different times."""
    i = F.col("doc_id")
    return b.table(spark, d, "documents").filter(i % 3 != 0).select(
        i.alias("id"),
        F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(20).cast("bigint")), lambda x: x * 7 + i).alias("ids"),
        b.minutes_before(i * 97 % 40000).alias("computed_at"),
    )


STORED_SQL = f"""stored AS (SELECT doc_id AS id, list_transform(range(1, 21), lambda x: x * 7 + doc_id) AS ids,
  TIMESTAMP '{b.AS_OF}' - to_minutes(doc_id * 97 % 40000) AS computed_at FROM documents WHERE doc_id % 3 <> 0)"""


@query(
    "similar_todo",
    f"""WITH {b.ITEMS_SQL}, {STORED_SQL} SELECT id FROM items WHERE visible AND id NOT IN (
    SELECT id FROM stored WHERE computed_at > TIMESTAMP '{b.AS_OF}' - INTERVAL 14 DAY) ORDER BY id DESC LIMIT 200""",
)
def similar_todo(spark, d):
    return similar.similar_todo(b.items(spark, d), stored(spark, d), b.as_of())


@query(
    "similar_read",
    f"""WITH {b.ITEMS_SQL}, {STORED_SQL}, x AS (SELECT id, unnest(ids[1:12]) AS other, generate_subscripts(ids[1:12], 1) - 1 AS pos FROM stored)
    SELECT x.id, x.pos::BIGINT AS pos, x.other FROM x JOIN items i ON i.id = x.other WHERE i.visible""",
)
def similar_read(spark, d):
    return similar.similar_read(stored(spark, d), b.items(spark, d)).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "sources_of",
    f"""WITH {b.SOURCES_SQL}, {b.FEEDS_SQL} SELECT s.item_id, s.source_id, s.url, s.source, coalesce(f.name, '') AS feed,
    coalesce(s.post_id, 0) AS post_id, s.caption, epoch_us(coalesce(s.posted_at, s.created_at)) AS ordered_us
    FROM sources s LEFT JOIN feeds f ON f.feed_id = s.feed_id""",
)
def sources_of(spark, d):
    out = retrieval.sources_of(b.sources(spark, d), b.feeds(spark, d))
    return out.select("item_id", "source_id", "url", "source", "feed", "post_id", "caption", b.micros("ordered_at").alias("ordered_us"))


@query(
    "inline_page",
    f"""WITH {VEC_BASE}, {knn_sql('nn', 'qvecs', 'sclip', 240)},
    x AS (SELECT q, id, r, id % 5 = 2 AS ready, (r - 1) // 50 AS page FROM nn WHERE r <= 200),
    y AS (SELECT *, count(*) FILTER (WHERE ready) OVER (PARTITION BY q ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
    z AS (SELECT *, first_value(before) OVER (PARTITION BY q, page ORDER BY r) AS pstart FROM y)
    SELECT q, id, r, CASE WHEN ready THEN 'sent' ELSE 'missing' END AS state FROM z WHERE pstart < 30 AND (NOT ready OR before < 30)""",
)
def inline_page(spark, d):
    shown = visible(b.items_with_vectors(spark, d)).select("id", F.col("clip_vec").alias("vec"))
    hits = knn.knn(b.query_vectors(spark, d), shown, 240)
    ready = b.table(spark, d, "documents").filter("doc_id % 5 = 2").select(F.col("doc_id").alias("id"))
    return retrieval.inline_page(hits, ready).withColumn("r", F.col("r").cast("bigint"))


@query(
    "result_cache_key",
    r"""WITH log AS (SELECT conv_id * 1000 + turn AS q, CASE WHEN conv_id % 2 = 0 THEN 'image' ELSE '' END AS kind,
      trim(regexp_replace(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 200), '\s+', ' ', 'g')) AS text FROM conversations)
    SELECT '1:' || substr(sha256(kind || chr(0) || lower(text)), 1, 32) AS cache_key, min(q) AS q, count(*) AS asked FROM log GROUP BY 1""",
)
def result_cache_key(spark, d):
    log = b.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("q"),
        F.when(F.col("conv_id") % 2 == 0, "image").otherwise("").alias("kind"),
        F.concat(F.lit("  "), "text", F.lit("\n ")).alias("text"),
    )
    return retrieval.once_per_key(log)
