"""Listing, rank fusion and hybrid search over a batch of searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_query
from ..model import is_visible, visible
from ..scale import broadcast_if_small, top_k
from ..session import cut_lineage
from . import fulltext, fuzzy
from .knn import knn, knn_below, without_self

CANDIDATES = 240
WEIGHTS = {"text": 1.3, "fuzzy": 1.0, "text_vec": 0.9, "clip_vec": 0.9}


def list_page(
    items: DataFrame,
    status: str = "",
    kind: str = "",
    public: bool = False,
    before_id: int = 0,
    limit: int = 48,
    offset: int = 0,
) -> DataFrame:
    """Newest first, with optional filters and a keyset cursor."""
    out = items
    if public:
        out = out.filter(is_visible())
    if status == "hidden":
        out = out.filter("hidden")
    elif status:
        out = out.filter(F.col("status") == status)
    if kind:
        out = out.filter(F.col("kind") == kind)
    if before_id > 0:
        out = out.filter(F.col("id") < before_id)
    out = out.orderBy(F.desc("id"))
    if offset:
        out = out.offset(offset)
    return out.limit(limit if limit > 0 else 48)


def lookup_ordered(items: DataFrame, lists: DataFrame, ids: str = "ids") -> DataFrame:
    """Rows of id lists with their place ``pos``; unknown ids drop out."""
    wanted = lists.select("list_id", F.posexplode(ids).alias("pos", "id"))
    return items.join(broadcast_if_small(wanted), "id")


def rrf(lists: dict[str, DataFrame], weights: dict[str, Column | float], base: float, keys: list[str]) -> DataFrame:
    """Sum of ``weight / (base + rank)`` over several ranked lists."""
    parts = [
        df.select(*keys, (F.lit(weights[name]) / (F.lit(base) + F.col("r"))).alias("part"))
        for name, df in lists.items()
    ]
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy(*keys).agg(F.round(F.sum("part"), 9).alias("score"))


def rrf_fuse(lists: dict[str, DataFrame], items: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """``q, id, score, r`` of the fused lists, visible items only."""
    fused = rrf(lists, WEIGHTS, 60.0, ["q", "id"])
    shown = fused.join(visible(items).select("id"), "id", "left_semi")
    return top_k(shown, ["q"], [F.desc("score"), F.desc("id")], limit, "r")


def hybrid_search(
    items: DataFrame,
    queries: DataFrame,
    text_vecs: DataFrame | None = None,
    clip_vecs: DataFrame | None = None,
    kind: str = "",
    text_max: float = 2.0,
    clip_max: float = 2.0,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """C11: a page of hits for every search of a batch, in one job.

    ``queries`` is ``q, text``; the vector tables are ``q, qvec`` and may lack
    searches, which are then lexical only (``semantic`` is false).
    """
    shown = visible(items, kind)
    # at most 240 rows per search, needed by the fusion and by the fuzzy gate
    exact = cut_lineage(fulltext.fts_rank(shown, queries))
    lists = {"text": exact, "fuzzy": fuzzy.fuzzy_gate(fuzzy.fuzzy_match(shown, queries), exact)}
    known = None
    for name, vecs, most in (("text_vec", text_vecs, text_max), ("clip_vec", clip_vecs, clip_max)):
        if vecs is not None:
            lists[name] = knn_below(vecs, shown.select("id", F.col(name).alias("vec")), CANDIDATES, most)
            have = vecs.select("q")
            known = have if known is None else known.union(have)
    hits = rrf_fuse(lists, items)
    hits = hits.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("q")))
    page = hits.filter((F.col("r") > offset) & (F.col("r") <= offset + limit))
    if known is None:
        return page.withColumn("semantic", F.lit(False))
    known = broadcast_if_small(known.distinct().withColumn("semantic", F.lit(True)))
    return page.join(known, "q", "left").na.fill(False, ["semantic"])


def search_by_vector(
    items: DataFrame, queries: DataFrame, kind: str = "", limit: int = 20, offset: int = 0
) -> DataFrame:
    """Nearest pictures of a vector, leaving out one id per query (``exclude``)."""
    shown = visible(items, kind).select("id", F.col("clip_vec").alias("vec"))
    k = limit + offset
    skip = broadcast_if_small(queries.select("q", "exclude"))
    found = knn(queries, shown, k + 1).join(skip, "q")
    return without_self(found, k, "exclude").drop("exclude").filter(F.col("r") > offset)


def look_alike(items: DataFrame, limit: int = 12, maximum: float = 0.35) -> DataFrame:
    """For every item with a picture vector, its nearest visible others."""
    vecs = items.select("id", F.col("clip_vec").alias("vec"), is_visible().alias("shown"))
    own = vecs.select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    found = knn(own, vecs.filter("shown").select("id", "vec"), limit + 1)
    return without_self(found, limit).filter(F.col("d") <= maximum)


def sources_of(sources: DataFrame, feeds: DataFrame) -> DataFrame:
    """Links of each item with the feed name, in order of time.

    The order is one range sort over (item, time, id), so the links of a
    popular item may span several partitions.
    """
    named = sources.join(feeds.select("feed_id", "name"), "feed_id", "left")
    return named.select(
        "item_id", F.coalesce("posted_at", "created_at").alias("ordered_at"), "source_id", "url", "source",
        F.coalesce("name", F.lit("")).alias("feed"), F.coalesce("post_id", F.lit(0)).alias("post_id"),
        "caption", "posted_at",
    ).orderBy("item_id", "ordered_at", "source_id")


def inline_page(hits: DataFrame, delivered: DataFrame, scan: int = 50, pages: int = 4, size: int = 30) -> DataFrame:
    """Hits with a delivery id, filled to ``size`` from whole scanned pages.

    Returns ``q, id, r, state``: ``sent`` results in order, ``missing`` ids of
    every page that was read, to be uploaded.
    """
    looked = hits.filter(F.col("r") <= scan * pages).join(
        delivered.select("id", F.lit(True).alias("ready")).distinct(), "id", "left"
    )
    running = Window.partitionBy("q").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    looked = looked.withColumn("before", F.coalesce(F.sum(F.coalesce("ready", F.lit(False)).cast("int")).over(running), F.lit(0)))
    page = F.floor((F.col("r") - 1) / scan)
    looked = looked.withColumn("page_start", F.first("before").over(Window.partitionBy("q", page).orderBy("r")))
    read = looked.filter(F.col("page_start") < size)
    return (
        read.withColumn(
            "state",
            F.when(F.col("ready") & (F.col("before") < size), "sent").when(F.col("ready").isNull(), "missing"),
        )
        .filter("state is not null")
        .select("q", "id", "r", "state")
    )


def result_cache_key(version: int, kind: str | Column, text: str | Column) -> Column:
    """Searches with an equal key share one result."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    norm = normalize_query(text)
    return F.concat_ws(":", F.lit(str(version)), F.substring(F.sha2(F.concat(k, F.lit("\x00"), norm), 256), 1, 32))


def once_per_key(log: DataFrame, version: int = 1) -> DataFrame:
    """The searches of a log that must be computed, with how often each is asked."""
    keyed = log.select("*", result_cache_key(version, F.col("kind"), "text").alias("cache_key"))
    return keyed.groupBy("cache_key").agg(F.min("q").alias("q"), F.count(F.lit(1)).alias("asked"))
