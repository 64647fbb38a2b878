"""Near-duplicate detection by perceptual hash and by picture vector."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.media import HASH_BITS, MIN_ONES, hamming, ones, usable_hash
from ..scale import fits, hot_keys, salted_lookup, tiled_cogroup, top_k
from ..session import cut_lineage
from .diffing import matched_words
from .knn import knn

DISTANCE = 12
HOT_BUCKET = 2000
TILE = 4096
NEIGHBOURS = 12


def is_video() -> Column:
    return F.col("kind") == "video"


def _bits(words: str, a: int, b: int) -> Column:
    """Bits ``a`` to ``b`` (at most 63) of a hash of 64-bit words as one number."""
    i, j, w = a // 64, (b - 1) // 64, F.col(words)
    low = F.shiftrightunsigned(w[j], 64 * (j + 1) - b)
    return (low if i == j else F.shiftleft(w[i], b - 64 * j).bitwiseOR(low)).bitwiseAND(F.lit((1 << (b - a)) - 1))


def _bands(rows: DataFrame, distance: int) -> DataFrame:
    """One row per band of the hash, with the band's number and bits as ``key``.

    256 bits are cut into ``distance + 1`` bands (13 of 19 or 20 bits for
    distance 12).  Two hashes within the distance are equal in at least one
    band, so nothing is missed, and a hash makes as many rows as it has bands.
    """
    count = max(min(distance, HASH_BITS - 1) + 1, 5)
    edges = [HASH_BITS * i // count for i in range(count + 1)]
    keys = [_bits("phash", a, b).bitwiseOR(F.shiftleft(F.lit(i).cast("bigint"), 56)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    return rows.select("*", F.explode(F.array(*keys)).alias("key"))


def near_hashes(hashes: DataFrame, distance: int = DISTANCE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``video, a, b, dist``: pairs ``a < b`` of different hashes within ``distance``.

    ``hashes`` has one row ``rep, video, phash`` per distinct hash, so copies
    never multiply.
    """
    return near_between(hashes, hashes, distance, hot_bucket, ordered=True)


def near_between(
    left: DataFrame, right: DataFrame, distance: int, hot_bucket: int = HOT_BUCKET, ordered: bool = False
) -> DataFrame:
    """Pairs of a left and a right hash within ``distance``; crowded buckets go tile by tile."""
    keys = ["video", "key"]
    lb = _bands(left.select("video", F.col("rep").alias("a"), "phash"), distance)
    rb = _bands(right.select("video", F.col("rep").alias("b"), "phash"), distance)
    hot = hot_keys(rb, keys, hot_bucket).select(*keys)
    crowded = not fits(hot, 0)
    calm_l, calm_r = lb, rb
    if crowded:
        calm_l, calm_r = lb.join(hot, keys, "left_anti"), rb.join(hot, keys, "left_anti")
    # merged, since a side looks small enough to broadcast before its bands are made
    pairs = calm_l.withColumnRenamed("phash", "ha").join(calm_r.withColumnRenamed("phash", "hb").hint("merge"), keys)
    if ordered:
        pairs = pairs.filter("a < b")
    pairs = pairs.select("video", "a", "b", hamming("ha", "hb").alias("dist")).filter(F.col("dist") <= distance)
    if crowded:

        def tile(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                none = pd.DataFrame({"video": [], "a": [], "b": [], "dist": []})
                return none.astype({"video": bool, "a": "int64", "b": "int64", "dist": "int32"})
            xs = np.stack(x["phash"].to_numpy()).view(np.uint64)
            ys = np.stack(y["phash"].to_numpy()).view(np.uint64)
            d = np.zeros((len(xs), len(ys)), dtype=np.int32)
            for w in range(4):
                d += np.bitwise_count(xs[:, w, None] ^ ys[None, :, w])
            a, b = x["a"].to_numpy(), y["b"].to_numpy()
            near = d <= distance
            if ordered:
                near &= a[:, None] < b[None, :]
            i, j = np.nonzero(near)
            return pd.DataFrame({"video": x["video"].iloc[0], "a": a[i], "b": b[j], "dist": d[i, j]})

        busy_l, busy_r = lb.join(hot, keys, "left_semi"), rb.join(hot, keys, "left_semi")
        far = tiled_cogroup(busy_l, busy_r, keys, "a", "b", tile, "video boolean, a bigint, b bigint, dist int", TILE)
        pairs = pairs.unionByName(far)
    return pairs.distinct()


def hash_groups(items: DataFrame) -> DataFrame:
    """``video, phash, rep``: distinct usable hashes with the smallest id that has each."""
    return (
        items.filter(usable_hash("phash"))
        .groupBy(is_video().alias("video"), "phash")
        .agg(F.min("id").alias("rep"))
    )


def hamming_pairs(items: DataFrame, distance: int = DISTANCE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """D3: ``a, b, dist``: links that span everything within ``distance``.

    Copies with an equal hash link to the smallest id of their group (distance
    0); groups link where their hashes are near.  This has the same connected
    groups as listing every pair, in a size that grows with the rows.
    """
    groups = cut_lineage(hash_groups(items))
    near = near_hashes(groups, distance, hot_bucket).select("a", "b", "dist")
    rows = items.filter(usable_hash("phash")).select("id", is_video().alias("video"), "phash")
    copies = (
        salted_lookup(rows, groups, ["video", "phash"], "inner")
        .filter(F.col("rep") < F.col("id"))
        .select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("dist"))
    )
    return near.unionByName(copies)


def nearest_hash(items: DataFrame, distance: int = DISTANCE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``id, near, dist``: the closest earlier or analysed item of the same videoness.

    Works on distinct hashes: of each only its smallest ids matter, so an item
    looks at a handful of numbers per distance whatever the number of copies.
    """
    rows = items.select(
        "id", is_video().alias("video"), "phash", "status", F.col("analyzed_at").isNotNull().alias("known")
    )
    # another hash within the distance of a usable one is itself nearly usable
    rows = rows.filter(ones("phash").between(MIN_ONES - distance, HASH_BITS - MIN_ONES + distance))
    alive = F.col("status") != "failed"
    groups = rows.groupBy("video", "phash").agg(
        F.min("id").alias("rep"),
        F.min(F.when(alive, F.col("id"))).alias("first"),
        F.min(F.when(alive & F.col("known"), F.col("id"))).alias("known1"),
    )
    # the second smallest analysed id, for when the first is the item itself
    second = (
        salted_lookup(rows.filter(alive & F.col("known")), groups.select("video", "phash", "known1"), ["video", "phash"], "inner")
        .filter(F.col("id") > F.col("known1"))
        .groupBy("video", "phash")
        .agg(F.min("id").alias("known2"))
    )
    groups = groups.join(second, ["video", "phash"], "left")
    groups = cut_lineage(groups)
    near = near_hashes(groups.select("rep", "video", "phash"), distance, hot_bucket).select("a", "b", "dist")
    both = (
        near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
        .unionByName(groups.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("dist")))
    )
    facts = groups.select(F.col("rep").alias("b"), "first", "known1", "known2")
    both = cut_lineage(both.join(facts, "b"))
    per_distance = (
        both.groupBy("a", "dist")
        .agg(
            F.min("first").alias("first"),
        )
    )
    # two smallest analysed ids per distance
    two = (
        both.select("a", "dist", F.explode(F.array_compact(F.array("known1", "known2"))).alias("k"))
        .distinct()
    )
    two = top_k(two, ["a", "dist"], [F.asc("k")], 2).groupBy("a", "dist").agg(F.min("k").alias("k1"), F.max("k").alias("k2"))
    offers = (
        per_distance.select("a", "dist", "first")
        .join(two, ["a", "dist"], "left")
        .groupBy("a")
        .agg(F.sort_array(F.collect_list(F.struct("dist", "first", "k1", "k2"))).alias("offers"))
    )
    lookup = groups.select("video", "phash", F.col("rep").alias("a")).join(offers, "a").drop("a")
    asking = rows.filter(usable_hash("phash")).select("id", "video", "phash")
    found = salted_lookup(asking, lookup, ["video", "phash"], "inner")

    def pick(o: Column) -> Column:
        earlier = F.when(o["first"] < F.col("id"), o["first"])
        known = F.when(o["k1"] != F.col("id"), o["k1"]).when(o["k2"] != F.col("id"), o["k2"])
        return F.struct(o["dist"].alias("dist"), F.least(earlier, known).alias("near"))

    best = F.get(F.filter(F.transform("offers", pick), lambda x: x["near"].isNotNull()), F.lit(0))
    return found.select("id", best.alias("best")).filter("best is not null").select("id", "best.near", "best.dist")


# --- pictures ---------------------------------------------------------------


@dataclass(frozen=True)
class Visual:
    """Thresholds for pairs found by picture vector."""

    sure_sim: float = 0.97
    ask_sim: float = 0.9
    ask_no_text_sim: float = 0.93
    same_text: float = 0.9
    ask_text: float = 0.5

    @property
    def floor(self) -> float:
        return min(self.sure_sim, self.ask_sim, self.ask_no_text_sim)


def visual_pairs(items: DataFrame, floor: float, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``a, b, sim``: similar pictures among the nearest of each still item.

    The neighbours are taken over all rows with a vector, the item itself
    included, and only then filtered.
    """
    still = items.filter((F.col("kind") != "video") & (F.col("status") == "done"))
    own = still.select(F.col("id").alias("q"), F.col("clip_vec").alias("qvec"))
    found = knn(own, items.select("id", F.col("clip_vec").alias("vec")), neighbours)
    left = still.select(F.col("id").alias("q"), F.col("kind").alias("qkind"))
    right = items.filter(F.col("status") == "done").select("id", "kind")
    return (
        found.filter("q <> id")
        .withColumn("sim", F.round(1 - F.col("d"), 9))
        .filter(F.col("sim") >= floor)
        .join(left, "q")
        .join(right, "id")
        .filter("kind = qkind")
        .select(F.col("q").alias("a"), F.col("id").alias("b"), "sim")
    )


WORD = re.compile(r"\w+")


DIFF = T.StructType([T.StructField(n, T.IntegerType()) for n in ("n_a", "n_b", "same", "replaced")])


@F.pandas_udf(DIFF)
def _diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    # a text stands in many pairs: its words are found once a batch
    place: dict[str, int] = {}
    for text in [*a, *b]:
        place.setdefault(text or "", len(place))
    words = [WORD.findall(text.lower()) for text in place]
    ends = np.cumsum([len(w) for w in words])
    numbers = pa.array([w for own in words for w in own], pa.large_string()).dictionary_encode().indices
    lists = np.split(numbers.to_numpy().astype(np.int64), ends[:-1])
    left, right = [lists[place[x or ""]] for x in a], [lists[place[y or ""]] for y in b]
    found = matched_words(zip(left, right, strict=True), len(left))
    return pd.DataFrame({"n_a": [len(x) for x in left], "n_b": [len(y) for y in right], "same": found[:, 0], "replaced": found[:, 1]})


def text_diff(a: str | Column, b: str | Column) -> Column:
    """Word counts, matched words and replaced words of two texts."""
    return _diff(a, b)


def with_text_diff(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """D5 for pairs ``a, b``: adds ``n_a, n_b, same, replaced, cover, whole``."""
    text = items.select(F.col("id").alias("a"), F.col("ocr_text").alias("a_text"))
    other = items.select(F.col("id").alias("b"), F.col("ocr_text").alias("b_text"))
    both = pairs.join(text, "a").join(other, "b")
    d = text_diff("a_text", "b_text")
    out = both.withColumn("d", d).select(*pairs.columns, "d.n_a", "d.n_b", "d.same", "d.replaced")
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return out.withColumn("cover", F.when(low > 0, F.col("same") / low)).withColumn(
        "whole", F.when(high > 0, F.col("same") / high)
    )


def percent(x: Column) -> Column:
    return F.floor(x * 100 + 1e-9).cast("string")


def judge_pair(v: Visual = Visual()) -> Column:
    """``sure, label, weak`` from ``sim, n_a, n_b, cover, replaced``; NULL = unrelated."""
    sim, n_a, n_b, cover = F.col("sim"), F.col("n_a"), F.col("n_b"), F.col("cover")
    weak = (1 - sim) / max(1 - v.sure_sim, 1e-6)
    looks = F.concat(F.lit("looks "), percent(sim), F.lit("% alike, "))

    def verdict(sure: bool, label: Column) -> Column:
        return F.struct(F.lit(sure).alias("sure"), label.alias("label"), weak.alias("weak"))

    bare = F.concat(looks, F.lit("no text"))
    half = F.concat(looks, F.lit("text on one only"))
    shared = F.concat(looks, F.lit("text "), percent(cover), F.lit("% shared"))
    few_swaps = F.col("replaced") <= F.floor(F.least(n_a, n_b) / 15)
    return (
        F.when(
            (n_a == 0) & (n_b == 0),
            F.when(sim >= v.sure_sim, verdict(True, bare)).when(sim >= v.ask_no_text_sim, verdict(False, bare)),
        )
        .when((n_a == 0) | (n_b == 0), F.when(sim >= v.sure_sim, verdict(False, half)))
        .when((sim >= v.sure_sim) & (cover >= v.same_text) & few_swaps, verdict(True, shared))
        .when((sim >= v.ask_sim) & (cover >= v.ask_text), verdict(False, shared))
    )


def judged_pairs(pairs: DataFrame, items: DataFrame, v: Visual = Visual()) -> DataFrame:
    """``a, b, sim, sure, label, weak`` of the pairs that are sure or worth asking."""
    return (
        with_text_diff(pairs, items)
        .withColumn("v", judge_pair(v))
        .filter("v is not null")
        .select("a", "b", "sim", "v.sure", "v.label", "v.weak")
    )


def find_keeper(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, keeper, sim``) of items with a sure earlier copy, and the pairs left to ask."""
    sure = judged.filter(F.col("sure") & (F.col("b") < F.col("a")))
    keepers = top_k(sure, ["a"], [F.desc("sim"), F.desc("b")], 1).select(
        F.col("a").alias("id"), F.col("b").alias("keeper"), "sim"
    )
    ask = judged.filter(~F.col("sure")).join(keepers.select(F.col("id").alias("a")), "a", "left_anti")
    return keepers, ask


def candidate_upsert(existing: DataFrame, pairs: DataFrame, fresh: bool = False) -> DataFrame:
    """The pair table with new pairs added once, smaller id first, at their best similarity."""
    kept = existing.filter("verdict <> ''") if fresh else existing
    best = (
        pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.max(F.struct("sim", "label")).alias("top"))
        .select("a", "b", "top.sim", "top.label")
    )
    new = best.join(kept.select("a", "b"), ["a", "b"], "left_anti").withColumn("verdict", F.lit(""))
    return kept.select("a", "b", "sim", "label", "verdict").unionByName(new)


def components(edges: DataFrame) -> DataFrame:
    """``id, comp``: connected groups, named by their smallest id.

    Every round each node takes the smallest label among its neighbours and
    then the label of that label, so long chains halve.  Rounds are cut off in
    the shared checkpoint folder.
    """
    pairs = edges.select(F.col("a").cast("bigint").alias("u"), F.col("b").cast("bigint").alias("v"))
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.select(F.col("u").alias("id")).distinct().withColumn("comp", F.col("id"))
    while True:  # labels only fall, and a long chain halves, so this ends
        named = labels.select(F.col("id").alias("u"), "comp")
        offers = salted_lookup(both, named, ["u"], "inner", spread="v").select(F.col("v").alias("id"), "comp")
        lower = offers.unionByName(labels.select("id", "comp")).groupBy("id").agg(F.min("comp").alias("comp"))
        jump = lower.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        step = salted_lookup(lower, jump, ["comp"], "left").select("id", F.coalesce("root", "comp").alias("comp"))
        changed = step.join(labels.withColumnRenamed("comp", "old"), "id")
        step = cut_lineage(changed.select("id", "comp", (F.col("comp") != F.col("old")).alias("moved")))
        labels = step.select("id", "comp")
        if step.filter("moved").isEmpty():
            return labels


def choose_keeper(members: DataFrame) -> DataFrame:
    """``comp, keeper``: locked first, then shown, then done, then the lowest id."""
    rank = F.struct(~F.col("locked"), F.col("hidden"), F.col("status") != "done", F.col("id").alias("id"))
    return members.groupBy("comp").agg(F.min(rank).alias("k")).select("comp", F.col("k.id").alias("keeper"))


def group_duplicates(
    items: DataFrame, judged: DataFrame | None = None, distance: int = DISTANCE, hot_bucket: int = HOT_BUCKET
) -> DataFrame:
    """``keeper, dup, why, weak``: copies that are directly close to their keeper.

    Groups connect through hashes and sure picture pairs, but a member is
    reported only when it is itself within the distance of the keeper or has a
    sure pair with it.  Locked members are never reported.
    """
    rows = items.filter(F.col("status") != "failed")
    edges = hamming_pairs(rows, distance, hot_bucket).select("a", "b")
    links = None
    if judged is not None:
        known = rows.select("id")
        sure = judged.filter("sure").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label", "weak"
        )
        sure = sure.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(
            known.withColumnRenamed("id", "b"), "b", "left_semi"
        )
        links = sure.groupBy("a", "b").agg(F.min(F.struct("weak", "label")).alias("link"))
        edges = edges.unionByName(links.select("a", "b"))
    facts = rows.select("id", is_video().alias("video"), "phash", "locked", "hidden", "status")
    members = components(edges).join(facts, "id")
    keepers = choose_keeper(members)
    kept = keepers.join(
        facts.select(F.col("id").alias("keeper"), F.col("video").alias("kvideo"), F.col("phash").alias("khash")), "keeper"
    )
    near = salted_lookup(members, kept, ["comp"], "inner").filter(~F.col("locked") & (F.col("id") != F.col("keeper")))
    same = usable_hash("phash") & usable_hash("khash") & (F.col("video") == F.col("kvideo"))
    near = near.withColumn("dist", F.when(same, hamming("phash", "khash")))
    by_hash = F.when(
        F.col("dist") <= distance,
        F.struct((F.col("dist") / max(distance, 1)).alias("weak"),
                 F.concat(F.col("dist").cast("string"), F.lit(" bits apart")).alias("label")),
    )
    if links is None:
        near = near.withColumn("hit", by_hash)
    else:
        near = (
            near.withColumn("a", F.least("id", "keeper"))
            .withColumn("b", F.greatest("id", "keeper"))
            .join(links, ["a", "b"], "left")
            .withColumn("hit", F.coalesce(by_hash, F.col("link")))
        )
    return near.filter("hit is not null").select(
        "keeper", F.col("id").alias("dup"), F.col("hit.label").alias("why"), F.col("hit.weak").alias("weak")
    )
