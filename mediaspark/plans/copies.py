"""Queries for near-duplicate detection, merging and review (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.media import hamming, ones, usable_hash
from ..operators import duplicates, merging
from ..operators.duplicates import Visual
from ..session import cut_lineage
from . import bindings as b
from .registry import query
from .search import knn_sql

HI_SQL = f"""{b.ITEMS_SQL}, {b.HASH_SQL},
hi AS MATERIALIZED (SELECT i.id, i.kind = 'video' AS video, i.status, i.locked, i.hidden, i.analyzed_at, h.bits, h.x, h.ones,
  coalesce(h.ones BETWEEN 24 AND 232, false) AS usable FROM items i LEFT JOIN hw h ON h.id = i.id)"""


def links_sql(name: str, rows: str) -> str:
    return f"""
{name}g AS MATERIALIZED (SELECT video, bits, x, min(id) AS rep FROM {rows} WHERE usable GROUP BY video, bits, x),
{name} AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b, bit_count(xor(a.x, b.x))::BIGINT AS dist FROM {name}g a JOIN {name}g b
    ON a.video = b.video AND a.rep < b.rep AND bit_count(xor(a.x, b.x)) <= 12
  UNION ALL SELECT g.rep, h.id, 0 FROM {rows} h JOIN {name}g g ON g.video = h.video AND g.bits = h.bits WHERE h.usable AND g.rep < h.id)
"""


@query("gradient_hash", f"WITH {b.HASH_SQL} SELECT id, bits FROM hashes")
def gradient_hash(spark, d):
    return b.hash_bits(spark, d)


@query("usable_hash", f"WITH {b.HASH_SQL} SELECT id, ones::BIGINT AS ones, ones BETWEEN 24 AND 232 AS usable FROM hw")
def usable(spark, d):
    return b.hashes(spark, d).select("id", ones("phash").cast("bigint").alias("ones"), usable_hash("phash").alias("usable"))


@query(
    "hamming",
    f"WITH {b.HASH_SQL} SELECT a.id, bit_count(xor(a.x, b.x))::BIGINT AS dist FROM hw a JOIN hw b ON b.id = a.id + 1",
)
def hamming_next(spark, d):
    h = b.hashes(spark, d)
    nxt = h.select((F.col("id") - 1).alias("id"), F.col("phash").alias("other"))
    return h.join(nxt, "id").select("id", hamming("phash", "other").cast("bigint").alias("dist"))


@query("hamming_pairs", f"WITH {HI_SQL}, {links_sql('links', 'hi')} SELECT a, b, dist FROM links")
def hamming_pairs(spark, d):
    return duplicates.hamming_pairs(b.items_with_hashes(spark, d)).select("a", "b", F.col("dist").cast("bigint").alias("dist"))


@query(
    "nearest_hash",
    f"""WITH {HI_SQL}, n AS (SELECT a.id, b.id AS near, bit_count(xor(a.x, b.x))::BIGINT AS dist,
      row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.x, b.x)), b.id) AS k
    FROM hi a JOIN hi b ON a.usable AND a.id <> b.id AND a.video = b.video AND b.x IS NOT NULL AND b.status <> 'failed'
      AND (b.id < a.id OR b.analyzed_at IS NOT NULL) AND bit_count(xor(a.x, b.x)) <= 12)
    SELECT id, near, dist FROM n WHERE k = 1""",
)
def nearest_hash(spark, d):
    return duplicates.nearest_hash(b.items_with_hashes(spark, d)).withColumn("dist", F.col("dist").cast("bigint"))


# thresholds that find pairs among the given vectors, whose nearest are about 0.5 apart
V = Visual(sure_sim=0.3, ask_sim=0.25, ask_no_text_sim=0.25)
VISUAL_SQL = f"""{b.VECTORS_SQL},
dq AS (SELECT c.id AS q, c.v AS qv FROM clip c JOIN items i ON i.id = c.id WHERE i.kind <> 'video' AND i.status = 'done'),
dall AS (SELECT c.id, c.v FROM clip c JOIN items i ON i.id = c.id), {knn_sql('dn', 'dq', 'dall', 12)},
vp AS (SELECT n.q AS a, n.id AS b, round(1 - n.d, 9) AS sim FROM dn n JOIN items a ON a.id = n.q JOIN items b ON b.id = n.id
  WHERE n.q <> n.id AND a.kind = b.kind AND b.status = 'done' AND round(1 - n.d, 9) >= {V.floor}),
vw AS (SELECT p.*, regexp_extract_all(lower(x.ocr_text), '[\\p{{L}}\\p{{N}}_]+') AS wa, regexp_extract_all(lower(y.ocr_text), '[\\p{{L}}\\p{{N}}_]+') AS wb
  FROM vp p JOIN items x ON x.id = p.a JOIN items y ON y.id = p.b),
vn AS (SELECT *, (len(wa) = 0)::INT + (len(wb) = 0)::INT AS bare FROM vw),
vj AS (SELECT a, b, sim, bare <> 1 AND sim >= {V.sure_sim} AS sure, 'looks ' || floor(sim * 100 + 1e-9)::INT || '% alike, ' ||
    CASE bare WHEN 2 THEN 'no text' WHEN 1 THEN 'text on one only' ELSE 'text 100% shared' END AS label,
  (1 - sim) / greatest(1 - {V.sure_sim}::DOUBLE, 1e-6) AS weak FROM vn
  WHERE CASE bare WHEN 2 THEN sim >= {V.ask_no_text_sim} WHEN 1 THEN sim >= {V.sure_sim} ELSE wa = wb AND sim >= {V.ask_sim} END)
"""


def judged(spark, d):
    """Judged picture pairs, with the whole texts.

    The SQL knows a shared text by equal word lists: in these tables no other
    pair of alike pictures shares half of its words (the limit for asking).
    """
    items = b.items_with_vectors(spark, d)
    return cut_lineage(duplicates.judged_pairs(duplicates.visual_pairs(items, V.floor), items, V))


@query("visual_pairs", f"WITH {b.ITEMS_SQL}, {VISUAL_SQL} SELECT a, b, round(sim, 6) AS sim FROM vp")
def visual_pairs(spark, d):
    return duplicates.visual_pairs(b.items_with_vectors(spark, d), V.floor).withColumn("sim", F.round("sim", 6))


@query("text_diff")
def text_diff(spark, d):
    items = b.items_with_hashes(spark, d)
    return duplicates.with_text_diff(duplicates.hamming_pairs(items), items)


@query(
    "judge_pair",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 - l_discount AS sim, l_quantity::INT % 40 AS n_a, l_partkey % 40 AS n_b,
      (l_suppkey % 11) / 10.0 AS cover, l_linenumber % 3 AS replaced FROM lineitem),
    y AS (SELECT *, 'looks ' || floor(sim * 100 + 1e-9)::INT || '% alike, ' AS looks FROM x),
    z AS (SELECT *, CASE WHEN n_a = 0 AND n_b = 0 THEN CASE WHEN sim >= 0.97 THEN 'sure|' || looks || 'no text' WHEN sim >= 0.93 THEN 'ask|' || looks || 'no text' END
      WHEN n_a = 0 OR n_b = 0 THEN CASE WHEN sim >= 0.97 THEN 'ask|' || looks || 'text on one only' END
      WHEN sim >= 0.97 AND cover >= 0.9 AND replaced <= least(n_a, n_b) // 15 THEN 'sure|' || looks || 'text ' || floor(cover * 100 + 1e-9)::INT || '% shared'
      WHEN sim >= 0.9 AND cover >= 0.5 THEN 'ask|' || looks || 'text ' || floor(cover * 100 + 1e-9)::INT || '% shared' END AS v FROM y)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, split_part(v, '|', 1) = 'sure' AS sure, split_part(v, '|', 2) AS label,
      round((1 - sim) / greatest(1 - 0.97::DOUBLE, 1e-6), 6) AS weak FROM z WHERE v IS NOT NULL""",
)
def judge_pair(spark, d):
    x = b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (1 - F.col("l_discount")).alias("sim"),
        (F.col("l_quantity").cast("int") % 40).alias("n_a"),
        (F.col("l_partkey") % 40).alias("n_b"),
        ((F.col("l_suppkey") % 11) / 10.0).alias("cover"),
        (F.col("l_linenumber") % 3).alias("replaced"),
    )
    return (
        x.withColumn("v", duplicates.judge_pair())
        .filter("v is not null")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v.sure", "v.label", F.round("v.weak", 6).alias("weak"))
    )


KEEP_SQL = """
vk AS (SELECT a AS id, b AS keeper, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b DESC) AS k FROM vj WHERE sure AND b < a) WHERE k = 1)
"""


@query(
    "find_keeper",
    f"""WITH {b.ITEMS_SQL}, {VISUAL_SQL}, {KEEP_SQL} SELECT 'merge' AS action, id AS a, keeper AS b FROM vk
    UNION ALL SELECT 'ask', a, b FROM vj WHERE NOT sure AND a NOT IN (SELECT id FROM vk)""",
)
def find_keeper(spark, d):
    keepers, ask = duplicates.find_keeper(judged(spark, d))
    return keepers.select(F.lit("merge").alias("action"), F.col("id").alias("a"), F.col("keeper").alias("b")).unionByName(
        ask.select(F.lit("ask").alias("action"), "a", "b")
    )


def pairs(spark, d):
    """The stored pair table: neighbours in the document list, judged by id."""
    i = F.col("doc_id")
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("", "same", "different", "error")]), (i % 4 + 1).cast("int"))
    return b.table(spark, d, "documents").select(
        i.alias("a"), (i + 7).alias("b"), (F.col("n_chars") % 1000 / 1000.0).alias("sim"), F.lit("old").alias("label"),
        verdict.alias("verdict"), F.when(i % 5 != 0, b.minutes_before(i * 11 % 3000)).alias("checked_at"),
    )


PAIRS_SQL = f"""
pairs AS (SELECT doc_id AS a, doc_id + 7 AS b, (n_chars % 1000) / 1000.0 AS sim, 'old' AS label,
  ['', 'same', 'different', 'error'][CAST(doc_id % 4 + 1 AS INT)] AS verdict,
  CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '{b.AS_OF}' - to_minutes(doc_id * 11 % 3000) END AS checked_at FROM documents)
"""


@query(
    "candidate_upsert",
    f"""WITH {b.ITEMS_SQL}, {VISUAL_SQL}, {PAIRS_SQL}, kept AS (SELECT a, b, sim, label, verdict FROM pairs WHERE verdict <> ''),
    best AS (SELECT least(a, b) AS x, greatest(a, b) AS y, max(sim) AS sim, arg_max(label, sim) AS label FROM vj WHERE NOT sure GROUP BY 1, 2)
    SELECT a, b, round(sim, 6)::DOUBLE AS sim, label, verdict FROM kept
    UNION ALL SELECT x, y, round(sim, 6), label, '' FROM best WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.a = x AND k.b = y)""",
)
def candidate_upsert(spark, d):
    new = judged(spark, d).filter("not sure")
    return duplicates.candidate_upsert(pairs(spark, d), new, fresh=True).withColumn("sim", F.round("sim", 6))


COMP_SQL = """
cedges AS MATERIALIZED (SELECT a, b FROM cedge UNION SELECT b, a FROM cedge),
reach AS (SELECT DISTINCT a AS id, a AS comp FROM cedges UNION SELECT e.b, r.comp FROM reach r JOIN cedges e ON e.a = r.id),
comps AS MATERIALIZED (SELECT id, min(comp) AS comp FROM reach GROUP BY id)
"""
ALIVE_SQL = f"""{HI_SQL}, alive AS MATERIALIZED (SELECT * FROM hi WHERE status <> 'failed'), {links_sql('links', 'alive')}"""


@query(
    "components",
    f"WITH RECURSIVE {HI_SQL}, {links_sql('links', 'hi')}, cedge AS MATERIALIZED (SELECT a, b FROM links), {COMP_SQL} SELECT id, comp FROM comps",
)
def components(spark, d):
    return duplicates.components(duplicates.hamming_pairs(b.items_with_hashes(spark, d)))


KEEPER_SQL = """
keepers AS (SELECT comp, keeper FROM (SELECT c.comp, c.id AS keeper, row_number() OVER (PARTITION BY c.comp
    ORDER BY NOT i.locked, i.hidden, i.status <> 'done', i.id) AS k FROM comps c JOIN hi i ON i.id = c.id) WHERE k = 1)
"""


@query(
    "choose_keeper",
    f"""WITH RECURSIVE {HI_SQL}, {links_sql('links', 'hi')}, cedge AS MATERIALIZED (SELECT a, b FROM links), {COMP_SQL}, {KEEPER_SQL}
    SELECT comp, keeper FROM keepers""",
)
def choose_keeper(spark, d):
    items = b.items_with_hashes(spark, d)
    facts = items.select("id", "locked", "hidden", "status")
    return duplicates.choose_keeper(duplicates.components(duplicates.hamming_pairs(items)).join(facts, "id"))


GROUPS_SQL = f"""{ALIVE_SQL}, {VISUAL_SQL},
slink AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(weak) AS weak, arg_min(label, weak) AS label FROM vj
  WHERE sure AND a IN (SELECT id FROM alive) AND b IN (SELECT id FROM alive) GROUP BY 1, 2),
cedge AS MATERIALIZED (SELECT a, b FROM links UNION SELECT a, b FROM slink), {COMP_SQL}, {KEEPER_SQL},
near AS (SELECT k.keeper, m.id AS dup, CASE WHEN m.usable AND h.usable AND m.video = h.video THEN bit_count(xor(m.x, h.x)) END AS dist
  FROM comps c JOIN hi m ON m.id = c.id JOIN keepers k ON k.comp = c.comp JOIN hi h ON h.id = k.keeper WHERE NOT m.locked AND m.id <> k.keeper),
groups AS (SELECT n.keeper, n.dup, CASE WHEN n.dist <= 12 THEN n.dist || ' bits apart' ELSE s.label END AS why,
   CASE WHEN n.dist <= 12 THEN n.dist / 12.0::DOUBLE ELSE s.weak END AS weak
  FROM near n LEFT JOIN slink s ON s.a = least(n.keeper, n.dup) AND s.b = greatest(n.keeper, n.dup) WHERE n.dist <= 12 OR s.a IS NOT NULL)
"""


@query("group_duplicates", f"WITH RECURSIVE {GROUPS_SQL} SELECT keeper, dup, why, round(weak, 6) AS weak FROM groups")
def group_duplicates(spark, d):
    return groups(spark, d).withColumn("weak", F.round("weak", 6))


def groups(spark, d):
    return duplicates.group_duplicates(b.items_with_hashes(spark, d), judged(spark, d))


@query(
    "merge_duplicates",
    f"""WITH RECURSIVE {GROUPS_SQL}, {b.SOURCES_SQL},
    plan AS (SELECT keeper, dup FROM groups), facts AS (SELECT p.keeper, p.dup, i.source, i.caption,
      CASE WHEN i.source_ref <> '' THEN i.source_ref ELSE i.source || ':' || i.sha256 END AS url FROM plan p JOIN items i ON i.id = p.dup),
    trace AS (SELECT url, arg_min(keeper, dup) AS keeper, arg_min(source, dup) AS source FROM facts WHERE url NOT IN (SELECT url FROM sources) GROUP BY url),
    fill AS (SELECT keeper, arg_min(caption, dup) AS caption FROM facts WHERE caption <> '' GROUP BY keeper)
    SELECT 'item' AS part, i.id, CASE WHEN i.caption = '' THEN coalesce(f.caption, '') ELSE i.caption END AS value
      FROM items i LEFT JOIN fill f ON f.keeper = i.id WHERE i.id NOT IN (SELECT dup FROM plan)
    UNION ALL SELECT 'link', coalesce(p.keeper, s.item_id), s.url FROM sources s LEFT JOIN plan p ON p.dup = s.item_id
    UNION ALL SELECT 'link', keeper, url FROM trace""",
)
def merge_duplicates(spark, d):
    items = b.items(spark, d)
    wanted = groups(spark, d).select("keeper", "dup", F.col("dup").alias("ord"))
    kept, links = merging.merge_duplicates(items, b.sources(spark, d), merging.merge_plan(items, wanted))
    return kept.select(F.lit("item").alias("part"), "id", F.col("caption").alias("value")).unionByName(
        links.select(F.lit("link").alias("part"), F.col("item_id").alias("id"), F.col("url").alias("value"))
    )


@query(
    "dedupe_report",
    f"""WITH RECURSIVE {GROUPS_SQL}
    SELECT 'scanned' AS metric, '' AS key, count(*) AS value FROM items WHERE status <> 'failed'
    UNION ALL SELECT 'groups', '', count(DISTINCT keeper) FROM groups UNION ALL SELECT 'to_remove', '', count(*) FROM groups
    UNION ALL SELECT 'visual', '', count(*) FROM groups WHERE why NOT LIKE '%bits apart'
    UNION ALL SELECT 'ask', '', count(*) FROM (SELECT DISTINCT least(a, b), greatest(a, b) FROM vj WHERE NOT sure)
    UNION ALL SELECT 'looks', regexp_extract(why, '^looks ([0-9]+)%', 1), count(*) FROM groups WHERE why LIKE 'looks%' GROUP BY 2
    UNION ALL SELECT 'sample', keeper || ' ' || why, dup FROM (SELECT DISTINCT keeper, dup, why FROM (
      (SELECT keeper, dup, why FROM groups ORDER BY weak DESC, keeper, dup LIMIT 24) UNION ALL (SELECT keeper, dup, why FROM groups ORDER BY keeper, dup LIMIT 12)))""",
)
def dedupe_report(spark, d):
    j = judged(spark, d)
    return merging.dedupe_report(b.items(spark, d), duplicates.group_duplicates(b.items_with_hashes(spark, d), j), j)


@query(
    "review_batch",
    f"""WITH {PAIRS_SQL} SELECT a, b, sim::DOUBLE AS sim FROM pairs WHERE verdict IN ('', 'error') AND b IN (SELECT doc_id FROM documents)
    ORDER BY sim DESC, a, b LIMIT 8""",
)
def review_batch(spark, d):
    return merging.review_batch(pairs(spark, d), b.items(spark, d))


@query(
    "apply_verdicts",
    f"""WITH {b.ITEMS_SQL}, x AS (SELECT d.doc_id AS a, d.doc_id + 7 AS b, d.doc_id % 3 = 0 AS same, (d.doc_id % 100) / 100.0 AS confidence,
      d.source AS reason, 1 + d.doc_id % 2 AS better, i.locked AS la, i.hidden AS ha, j.locked AS lb, j.hidden AS hb
      FROM documents d JOIN items i ON i.id = d.doc_id JOIN items j ON j.id = d.doc_id + 7),
    y AS (SELECT *, CASE WHEN better = 1 THEN (lb AND NOT la) OR (ha AND NOT hb) ELSE NOT ((la AND NOT lb) OR (hb AND NOT ha)) END AS second,
      same AND confidence >= 0.8 AS yes FROM x)
    SELECT a, b, CASE WHEN yes THEN 'same' ELSE 'different' END AS verdict,
      printf('%.2f', confidence::DOUBLE) || ' · ' || reason || CASE WHEN yes THEN ' · keeps #' || CASE WHEN second THEN b ELSE a END ELSE '' END AS reason,
      CASE WHEN second THEN b ELSE a END AS keeper, CASE WHEN second THEN a ELSE b END AS dup, yes AND NOT CASE WHEN second THEN la ELSE lb END AS "merge" FROM y""",
)
def apply_verdicts(spark, d):
    i = F.col("doc_id")
    answers = b.table(spark, d, "documents").select(
        i.alias("a"), (i + 7).alias("b"), (i % 3 == 0).alias("same"), ((i % 100) / 100.0).alias("confidence"),
        F.col("source").alias("reason"), (1 + i % 2).alias("better"),
    )
    return merging.apply_verdicts(pairs(spark, d).select("a", "b"), answers, b.items(spark, d))


@query(
    "review_queue",
    f"""WITH {PAIRS_SQL} SELECT 'todo' AS part, NULL::BIGINT AS a, NULL::BIGINT AS b, count(*) FILTER (WHERE verdict = '') AS n FROM pairs
    UNION ALL SELECT 'different', NULL, NULL, count(*) FILTER (WHERE verdict = 'different') FROM pairs
    UNION ALL SELECT 'same', NULL, NULL, count(*) FILTER (WHERE verdict = 'same') FROM pairs
    UNION ALL SELECT 'errors', NULL, NULL, count(*) FILTER (WHERE verdict = 'error') FROM pairs
    UNION ALL (SELECT 'next', a, b, NULL FROM pairs WHERE verdict = '' ORDER BY sim DESC, a, b LIMIT 6)
    UNION ALL (SELECT 'next', a, b, NULL FROM pairs WHERE verdict = '' ORDER BY sim, a, b LIMIT 6)
    UNION ALL (SELECT 'recent', a, b, NULL FROM pairs WHERE verdict <> '' ORDER BY checked_at DESC NULLS LAST, a, b LIMIT 12)""",
)
def review_queue(spark, d):
    return merging.review_queue(pairs(spark, d))
