"""Mixing sources to target weights (2), with DataFrame functions only.

The words of every source, document after document, are cut into blocks of a
fixed length (``longest`` words; a source of fewer than 1,000 such blocks takes
blocks of a thousandth of its size, so that whole blocks can meet its target).
The mix is a row of slots, one block each, in output shards of ``shard_slots``.
Every source gets the slots its target asks for and they are spread over the
shards by one pseudorandom permutation of all slots: the counts of a shard are
a multinomial draw under the condition that the totals meet the targets, which
a free draw would miss by several percent on small sources.  The k-th slot of
a source takes block ``permutation(k mod blocks)`` of it, so each pass over a
source takes every block once, and blocks are joined by that index.

Permutations are "swap or not" shuffles: every round pairs x with (key - x)
mod n and swaps by a pseudorandom bit of the larger of the two.  They are
bijections of any range and need only integer arithmetic.

Prefix sums inside a source run over hashed buckets of bounded size, so no
source, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .names import all_of, unused

PRIME = 2147483647
STEP = 48271
ROUNDS = 40
CAP = 3
WEIGHTS = (5, 2, 1)
LONGEST = 256
SHARD_SLOTS = 1024
BUCKET = 8192
SEGMENT = 4096
WORD = r"[^\x20\x09-\x0D]++"


def permuted(x: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """The place of ``x`` under a pseudorandom permutation of 0..n-1 (bigints; products stay below 2^62)."""

    def swap(at: Column, r: Column) -> Column:
        a = ((r + seed * 131) * STEP + 11) % PRIME
        b = (a * STEP + 7) % PRIME
        key = ((a * STEP) % PRIME * 65536 + b % 65536) % n
        other = (key - at + n) % n
        high = F.greatest(at, other)
        bit = ((high % PRIME * a + b) % PRIME) % 2
        return F.when(bit == 1, other).otherwise(at)

    return F.reduce(F.sequence(F.lit(1).cast("bigint"), F.lit(rounds).cast("bigint")), x, swap)


def sized(docs: DataFrame) -> DataFrame:
    """``_row, doc_id, source, size`` of every row; a null text has size 0."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    return cut_lineage(rows).withColumn("_row", F.monotonically_increasing_id())


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, longest: int = LONGEST) -> DataFrame:
    """One row per source: its number ``s`` in code point order (null last), size, target and block plan.

    A source is capped if its share of what the sources before it (by cap per
    weight) leave over would exceed its cap; the others share the rest by
    weight.  All sums are over the sources, of which there is one row each.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    own = own.withColumn("s", (F.row_number().over(order) - 1).cast("bigint")).withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    own = (
        own.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("total_w", F.sum("w").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("left_w", F.col("total_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("capped", F.col("left") * F.col("w") > F.col("most") * F.col("left_w"))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0)))
        .withColumn("rest_w", F.col("total_w") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(everything), F.lit(0)))
    )
    share = (F.col("w") * F.col("rest")).cast("double") / F.col("rest_w").cast("double")
    own = own.withColumn("target", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(share))
    own = own.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(longest), F.expr("source_size div 1000"))).cast("bigint"))
    own = own.withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    slots = F.floor(F.col("blocks") * F.col("target") / F.col("source_size") + 0.5)
    own = own.withColumn("slots", F.when(F.col("blocks") > 0, F.least(slots, F.col("blocks") * cap)).otherwise(0).cast("bigint"))
    own = own.withColumn("base", F.coalesce(F.sum("slots").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("all_slots", F.sum("slots").over(everything))
    return own.select("s", "source", "source_size", "rows", "target", "block", "blocks", "slots", "base", "all_slots")


def slot_table(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``shard, place, s, pass, index``: the block of its source that every slot of the mix takes."""
    pieces = sources.filter("slots > 0").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(slots - 1) div {SEGMENT}"))))
    spark = sources.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pieces = pieces.repartition(tasks, "s", "_piece")  # a large source is many pieces; a stated number is not merged again
    low = F.col("_piece") * SEGMENT
    slots = pieces.withColumn("k", F.explode(F.sequence(low, F.least(low + SEGMENT, F.col("slots")) - 1)))
    at = permuted(F.col("base") + F.col("k"), F.col("all_slots"), F.lit(0).cast("bigint"))
    index = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("s") + 1)
    return slots.select(
        "s", "k", F.expr("k div blocks").alias("pass"), index.alias("index"), at.alias("_at")
    ).select("s", "pass", "index", F.expr(f"_at div {shard_slots}").alias("shard"), (F.col("_at") % shard_slots).alias("place"))


def block_parts(sizes: DataFrame, sources: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``s, index, _row, words``: how many words of each block come from each document."""
    mixed = F.pmod(F.coalesce("doc_id", "size"), F.lit(PRIME)) * STEP % PRIME
    rows = (
        sizes.filter("size > 0")
        .join(sources.select("s", F.col("source").alias("_source"), "block", "rows"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_h", mixed)
        .withColumn("_bucket", F.col("_h") % F.expr(f"(rows + {bucket - 1}) div {bucket}"))
        .select("s", "block", "_bucket", "_h", "doc_id", "size", "_row")
    )
    inside = Window.partitionBy("s", "_bucket").orderBy("_h", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per bucket: a source of 10^10 documents has about 10^6
    starts = rows.groupBy("s", "_bucket").agg(F.sum("size").alias("_own")).select("s", "_bucket", F.coalesce(F.sum("_own").over(ahead), F.lit(0)).alias("_start"))
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["s", "_bucket"])
    placed = placed.withColumn("_from", F.col("_start") + F.col("_in")).withColumn("_to", F.col("_from") + F.col("size"))
    split = placed.withColumn("index", F.explode(F.sequence(F.expr("_from div block"), F.expr("(_to - 1) div block"))))
    words = F.least("_to", (F.col("index") + 1) * F.col("block")) - F.greatest("_from", F.col("index") * F.col("block"))
    return split.select("s", "index", "_row", words.alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, longest: int = LONGEST, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_shard`` of every row of ``docs``.

    ``taken`` counts the words of the document in the mix with repeats,
    ``first_shard`` is the first output shard that has any (null if none).
    Null texts have size 0; null sources are one source; null and repeated ids
    are kept row by row; other columns are ignored.  Reruns agree.
    """
    sizes = sized(docs)
    return _judged(sizes, weights, cap, longest, shard_slots).drop("_row")


def _judged(sizes: DataFrame, weights: tuple[int, ...], cap: int, longest: int, shard_slots: int) -> DataFrame:
    sources = cut_lineage(source_targets(sizes, weights, cap, longest))
    drawn = slot_table(sources, shard_slots).groupBy("s", "index").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
    taken = (
        block_parts(sizes, sources)
        .join(drawn.hint("merge"), ["s", "index"])
        .groupBy("_row")
        .agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    )
    own = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return (
        sizes.join(own, F.col("source").eqNullSafe(F.col("_source")))
        .join(taken.hint("merge"), "_row", "left")
        .select("_row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_shard")
    )


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, longest: int = LONGEST, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``docs`` in the proportions of the mix: each row as often as the mix takes its words, in whole documents.

    A row comes floor(taken / size) times, and once more with the chance of the
    remainder (by a hash of the row, so reruns agree): never above ``cap``.
    Rows without words are not taken.  All columns are kept.  ``docs`` must be
    readable again in the same order (a table).
    """
    names = docs.columns
    judged = _judged(sized(docs), weights, cap, longest, shard_slots).filter("taken > 0")
    draw = F.pmod(F.xxhash64("_row", F.lit(29)), F.lit(1_000_003)) / 1_000_003
    times = F.expr("taken div size").cast("int") + F.when(draw < (F.col("taken") % F.col("size")) / F.col("size"), 1).otherwise(0)
    row, count, copy = (unused(names, n) for n in ("_row", "_times", "_copy"))
    drawn = judged.select(F.col("_row").alias(row), times.alias(count)).filter(F.col(count) > 0)
    rows = docs.withColumn(row, F.monotonically_increasing_id()).join(drawn, row)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count)))).select(*all_of(names))


ORACLE = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         row_number() OVER () AS r FROM documents),
own AS (SELECT source, sum(size)::BIGINT AS source_size, count(*)::BIGINT AS n FROM sizes GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM own),
weighed AS (SELECT *, [5, 2, 1][s % 3 + 1]::BIGINT AS w, source_size * {CAP} AS most FROM numbered),
summed AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS total_w,
         coalesce(sum(most) OVER b, 0)::BIGINT AS gone, coalesce(sum(w) OVER b, 0)::BIGINT AS gone_w
  FROM weighed WINDOW b AS (ORDER BY most / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
caps AS (SELECT *, (total - gone) * w > most * (total_w - gone_w) AS capped FROM summed),
rests AS (
  SELECT *, total - coalesce(sum(most) FILTER (capped) OVER (), 0)::BIGINT AS rest,
         total_w - coalesce(sum(w) FILTER (capped) OVER (), 0)::BIGINT AS rest_w FROM caps),
targets AS (
  SELECT *, CASE WHEN capped THEN most::DOUBLE ELSE (w * rest)::DOUBLE / rest_w::DOUBLE END AS target,
         greatest(1, least({LONGEST}, source_size // 1000))::BIGINT AS block FROM rests),
blocked AS (SELECT *, (source_size + block - 1) // block AS blocks FROM targets),
slotted AS (
  SELECT *, CASE WHEN blocks > 0 THEN least(floor(blocks * target / source_size + 0.5), blocks * {CAP}) ELSE 0 END::BIGINT AS slots FROM blocked),
sources AS (
  SELECT *, (coalesce(sum(slots) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS base,
         (sum(slots) OVER ())::BIGINT AS all_slots FROM slotted),
slot AS (SELECT s, base, all_slots, blocks, unnest(range(slots)) AS k FROM sources),

drawn AS (
  SELECT s,
    list_reduce([k % blocks] || range(1, {ROUNDS + 1}), lambda x, r: PERMUTE(x, r, blocks, s + 1)) AS idx,
    list_reduce([base + k] || range(1, {ROUNDS + 1}), lambda x, r: PERMUTE(x, r, all_slots, 0)) // {SHARD_SLOTS} AS shard
  FROM slot),
times AS (SELECT s, idx, count(*) AS times, min(shard) AS shard FROM drawn GROUP BY s, idx),
hashed AS (
  SELECT z.*, t.s, t.block, t.n, ((coalesce(doc_id, size) % {PRIME} + {PRIME}) % {PRIME}) * {STEP} % {PRIME} AS h
  FROM sizes z JOIN sources t ON z.source IS NOT DISTINCT FROM t.source WHERE size > 0),
placed AS (
  SELECT *, (coalesce(sum(size) OVER (PARTITION BY s ORDER BY h % ((n + {BUCKET - 1}) // {BUCKET}), h, doc_id, size, r
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lo FROM hashed),
parts AS (SELECT *, unnest(range(lo // block, (lo + size - 1) // block + 1)) AS idx FROM placed),
taken AS (
  SELECT r, sum((least(lo + size, (p.idx + 1) * block) - greatest(lo, p.idx * block)) * times)::BIGINT AS taken, min(shard) AS first_shard
  FROM parts p JOIN times t ON p.s = t.s AND p.idx = t.idx GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_shard
FROM sizes z JOIN sources t ON z.source IS NOT DISTINCT FROM t.source LEFT JOIN taken USING (r)
"""


def _permute(x: str, r: str, n: str, seed: str) -> str:
    a = f"((({r} + ({seed}) * 131) * {STEP} + 11) % {PRIME})"
    b = f"(({a} * {STEP} + 7) % {PRIME})"
    key = f"((({a} * {STEP}) % {PRIME} * 65536 + {b} % 65536) % {n})"
    other = f"(({key} - {x} + {n}) % {n})"
    return f"(CASE WHEN ((greatest({x}, {other}) % {PRIME} * {a} + {b}) % {PRIME}) % 2 = 1 THEN {other} ELSE {x} END)"


ORACLE = ORACLE.replace("PERMUTE(x, r, blocks, s + 1)", _permute("x", "r", "blocks", "s + 1")).replace(
    "PERMUTE(x, r, all_slots, 0)", _permute("x", "r", "all_slots", "0")
)
