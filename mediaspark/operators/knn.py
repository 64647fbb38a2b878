"""Exact nearest neighbours by cosine distance in two rounds, one plan for any number of queries.

A pivot tree of bounded size places every item: cells hold leaves, a leaf holds
the items nearest to its pivot.  Unit vectors have the chord
``|x - y| = sqrt(2 * distance)``, so by the triangle inequality a query knows
how close the items of a leaf can be.

Round one sends a query to the cells of the leaves around it that hold ``k``
items; the ``k``-th distance found there bounds its neighbours.  Round two
sends it to the other cells that have a leaf within that bound, if there are
any.  Inside a cell the leaves around the query are scored first; of the rest
only items whose lower bound (chords to the pivot, place along a few common
directions and distance from them) is within the bound are scored.

Where the tree would not spare most pairs, since the vectors have no
structure, blocks of queries read all items instead, as a stream: a product in
single precision sorts out nearly all pairs, the rest is scored as usual, and
only the best ``k`` of a query leave its block.

Only cells that a query visits are shuffled.  Of more than ``k`` equal vectors
only the ``k`` highest ids can be among the nearest, so the rest stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import broadcast_if_small, top_k
from ..session import cut_lineage

SAMPLE = 8192
LEAVES, LEAF_ROWS = 4096, 64
CELLS, CELL_ROWS = 1024, 4096
TILE_ROWS = 8192
CELLS_AT_ONCE = 1 << 20  # of a table of chords, rows by leaves or queries by items
VISITORS = 20_000
DIRECTIONS = 16
PLACES = 9
#: rounding of a distance and of a chord
SLACK, CHORD_SLACK = 4e-9, 1e-6
SWEPT, PROBES = 0.25, 64  # share of the items that some probes would meet, from which blocks of queries read all items
QUERIES, LEAST_QUERIES, QUERY_ROWS, ITEM_ROWS = 16_384, 256, 1024, 4096  # of a block of queries, and of queries and items that meet at once
FAR = 3.0  # over any cosine distance
SCHEMA = "q bigint, id bigint, d double"


def unit(rows) -> np.ndarray:
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1
    return m / n


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Places of ``n`` rows, each as far as can be from those before it."""
    picked = [0]
    gap = _chord(sample, sample[:1])[:, 0]
    while len(picked) < n:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, _chord(sample, sample[picked[-1:]])[:, 0])
    return np.array(picked)


@dataclass
class PivotTree:
    """Leaf pivots, the cell of each leaf, and directions that spread the pivots most."""

    leaves: np.ndarray
    cell_of: np.ndarray
    axes: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, leaves: int, cells: int) -> PivotTree:
        pivots = sample[_spread_out(sample, min(leaves, len(sample)))]
        axes = np.linalg.svd(pivots, full_matrices=False)[2][:DIRECTIONS]
        return cls(pivots, _chord(pivots, pivots[:cells]).argmin(axis=1), axes.T)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest leaf of every vector and the chord to its pivot."""
        leaf, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        step = max(1, CELLS_AT_ONCE // len(self.leaves))
        for at in range(0, len(x), step):
            to = _chord(x[at : at + step], self.leaves)
            leaf[at : at + step] = own = to.argmin(axis=1)
            far[at : at + step] = to[np.arange(len(to)), own]
        return leaf, far

    def sketch(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places along the directions, and the length of the rest."""
        y = x @ self.axes
        return y, np.sqrt(np.maximum(0.0, (x * x).sum(axis=1) - (y * y).sum(axis=1)))


@dataclass
class Leaves:
    """The leaves that hold items: number, rows, least and greatest chord to the pivot."""

    leaf: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def closest(self, tree: PivotTree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chords of every query to every pivot, and how close the items of its leaf can be."""
        to = _chord(x, tree.leaves[self.leaf])
        return to, np.maximum(0.0, np.maximum(to - self.high, self.low - to) - CHORD_SLACK)

    def around(self, to: np.ndarray, k: int) -> np.ndarray:
        """Mask of the leaves around each query that hold ``k`` items together."""
        order = np.argsort(to, axis=1)
        held = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        mask = np.zeros(to.shape, bool)
        np.put_along_axis(mask, order, held < k, axis=1)
        return mask


def _best_of(qi: np.ndarray, ci: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` pairs of each query from pairs of places, ties by id descending, and which of them are the k-th."""
    order = np.lexsort((-ids[ci], d, qi))
    qi, ci, d = qi[order], ci[order], d[order]
    first = np.flatnonzero(np.diff(qi, prepend=-1))
    rank = np.arange(len(qi)) - np.repeat(first, np.diff(first, append=len(qi)))
    keep = rank < k
    return qi[keep], ci[keep], d[keep]


class Tile:
    """Items of one cell, sorted by leaf, scored against blocks of queries."""

    def __init__(self, tree: PivotTree, ids: np.ndarray, x: np.ndarray, leaf: np.ndarray, far: np.ndarray, k: int, scored: Accumulator | None = None):
        order = np.argsort(leaf, kind="stable")
        self.tree, self.ids, self.x, self.far, self.k, self.scored = tree, ids[order], x[order], far[order], k, scored
        own, first, rows = np.unique(leaf[order], return_index=True, return_counts=True)
        self.at = np.repeat(np.arange(len(own)), rows)
        self.leaves = Leaves(own, rows, np.minimum.reduceat(self.far, first), np.maximum.reduceat(self.far, first))
        self.y, self.rest = tree.sketch(self.x)

    def exact(self, q: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
        n = len(qi)
        if self.scored is not None:
            self.scored.add(n)
        if 5 * n > len(q) * len(self.x):  # one product is the shorter way to most pairs
            return np.round(1.0 - q @ self.x.T, PLACES)[qi, ci]
        parts = [np.round(1.0 - np.einsum("ij,ij->i", q[qi[i : i + 65536]], self.x[ci[i : i + 65536]]), PLACES) for i in range(0, n, 65536)]
        return np.concatenate([np.zeros(0), *parts])

    def search(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries and items, and distances: the best ``k`` items of each query within its bound."""
        to, near = self.leaves.closest(self.tree, q)
        # the leaves around each query first: their k-th distance is a bound, too
        mask = (self.leaves.around(to, self.k) & (near**2 <= 2.0 * bound[:, None] + SLACK))[:, self.at]
        qi, ci = np.nonzero(mask)
        d = self.exact(q, qi, ci)
        qi, ci, d = _best_of(qi, ci, d, self.ids, self.k)
        count = np.bincount(qi, minlength=len(q))
        full = np.flatnonzero(count == self.k)
        bound = bound.copy()
        bound[full] = np.minimum(bound[full], d[np.cumsum(count)[full] - 1])
        limit = 2.0 * bound[:, None] + SLACK
        gap = np.maximum(np.abs(to[:, self.at] - self.far) - CHORD_SLACK, 0.0)
        y, rest = self.tree.sketch(q)
        least = (y * y).sum(axis=1)[:, None] + (self.y * self.y).sum(axis=1) - 2.0 * (y @ self.y.T) + (rest[:, None] - self.rest) ** 2
        qj, cj = np.nonzero((gap**2 <= limit) & (least <= limit) & ~mask)
        e = self.exact(q, qj, cj)
        qi, ci, d = (np.concatenate(x) for x in ((qi, qj), (ci, cj), (d, e)))
        good = d <= bound[qi] + SLACK
        return _best_of(qi[good], ci[good], d[good], self.ids, self.k)


class _Sweep:
    """Some queries that meet all items, chunk by chunk, and the best ``k`` of each so far within its bound."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, scored: Accumulator | None) -> None:
        self.q_ids, self.q, self.near, self.bound, self.k, self.scored = ids, q, q.astype(np.float32), bound.copy(), k, scored
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.slack = SLACK + 1.2e-7 * (q.shape[1] + 4)  # a product in single precision is as far off at most

    def add(self, ids: np.ndarray, x: np.ndarray, near: np.ndarray) -> None:
        alike = self.near @ near.T

        def close() -> np.ndarray:
            return alike >= (1.0 - self.bound - self.slack).astype(np.float32)[:, None]

        mask = close()
        if len(ids) > self.k and np.count_nonzero(mask) > 2 * self.k * len(self.q):
            kth = np.partition(alike, -self.k, axis=1)[:, -self.k].astype(np.float64)
            self.bound = np.minimum(self.bound, 1.0 - kth + self.slack)
            mask = close()
        qi, ci = np.nonzero(mask)
        if self.scored is not None:
            self.scored.add(len(qi))
        for at in range(0, len(qi), 65536):
            i, c = qi[at : at + 65536], ci[at : at + 65536]
            d = np.round(1.0 - np.einsum("ij,ij->i", self.q[i], x[c]), PLACES)
            good = d <= self.bound[i] + SLACK
            self.new.append((i[good], ids[c[good]], d[good]))
        if sum(len(x[0]) for x in self.new) > 2 * self.k * len(self.q):
            self.cut()

    def cut(self) -> None:
        qi, ids, d = (np.concatenate(x) for x in zip(self.best, *self.new))
        qi, at, d = _best_of(qi, np.arange(len(qi)), d, ids, self.k)
        self.best, self.new = (qi, ids[at], d), []
        count = np.bincount(qi, minlength=len(self.q))
        full = np.flatnonzero(count == self.k)
        self.bound[full] = np.minimum(self.bound[full], d[np.cumsum(count)[full] - 1])

    def found(self) -> pa.RecordBatch:
        self.cut()
        qi, ids, d = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[qi]), pa.array(ids), pa.array(d)], ["q", "id", "d"])


def _met_share(tree: PivotTree, x: np.ndarray, k: int, n: int) -> float:
    """Share of the items in cells that a query would meet, as some vectors of the sample ``x`` of ``n`` items show."""
    leaf, far = tree.place(x)
    own, at, rows = np.unique(leaf, return_inverse=True, return_counts=True)
    low, high = np.full(len(own), np.inf), np.zeros(len(own))
    np.minimum.at(low, at, far)
    np.maximum.at(high, at, far)
    probes = x[:PROBES]
    place = min(len(x) - 1, -(-k * len(x) // n))
    bound = np.partition(1.0 - probes @ x.T, place, axis=1)[:, place]
    _, near = Leaves(own, rows, low, high).closest(tree, probes)
    may = near**2 <= 2.0 * bound[:, None] + SLACK
    cell = tree.cell_of[own]
    cells = np.unique(cell)
    met = np.stack([may[:, cell == c].any(axis=1) for c in cells], axis=1)
    return float((met @ np.bincount(cell, rows)[cells]).mean() / len(x))


def _apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that a hash deals to ``n`` different partitions."""
    part = F.pmod(F.hash("id"), F.lit(n))
    found = [r.key for r in spark.range(64 * n).groupBy(part.alias("part")).agg(F.min("id").alias("key")).orderBy("part").collect()]
    return found + list(range(64 * n, 65 * n - len(found)))


def grid(spark: SparkSession, searches: int, n: int, search_bytes: int, item_bytes: int, found_bytes: int, least: int, most: int) -> tuple[int, int, list[int]]:
    """Blocks of ``least`` to ``most`` searches, shares of the items, and a number for each pair of them that a hash deals to a task of its own.

    Each block meets all items, as one task or share by share: of the ways to keep all cores busy the one that moves the fewest bytes.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism

    def blocks(shares: int) -> int:
        return max(1, -(-searches // most), min(-(-tasks // shares), -(-searches // least)))

    def moved(shares: int) -> int:
        return blocks(shares) * n * item_bytes + shares * searches * (search_bytes + found_bytes)

    shares = min(range(1, tasks + 1), key=lambda x: (blocks(x) * x < tasks, moved(x)))
    return blocks(shares), shares, _apart(spark, blocks(shares) * shares)


def _swept(asked: DataFrame, items: DataFrame, searches: int, n: int, dims: int, k: int, scored: Accumulator | None) -> DataFrame:
    """``q, id, d``: the best ``k`` of all ``n`` ``items`` (``id, vec``) for ``asked`` (``q, qvec, bound``), within the bound.

    Each block of queries gets a copy of all items, or several tasks get a share of them each, whichever moves less.
    """
    spark = items.sparkSession
    many, shares, keys = grid(spark, searches, n, 4 * dims, 4 * dims, 14 * k, LEAST_QUERIES, QUERIES)
    at = F.array(*[F.lit(x) for x in keys])

    def dealt(df: DataFrame, own: str, number: str, n: int, other: str, m: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64(number), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return df.withColumn("key", F.get(at, (F.col("block") * shares + F.col("share")).cast("int")))

    vec = "array<double>" if asked.schema["qvec"].dataType != items.schema["vec"].dataType else asked.schema["qvec"].dataType.simpleString()
    left = dealt(asked, "block", "q", many, "share", shares).select("key", F.lit(0).alias("side"), F.col("q").alias("id"), F.col("qvec").cast(vec).alias("vec"), "bound")
    right = dealt(items, "share", "id", shares, "block", many).select("key", F.lit(1).alias("side"), "id", F.col("vec").cast(vec).alias("vec"), F.lit(None).cast("double").alias("bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, sweeps = None, [], []
        for whole in batches:
            keys, sides = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            starts = np.flatnonzero((np.diff(keys, prepend=-1) != 0) | (np.diff(sides, prepend=-1) != 0))
            for a, z in zip(starts, [*starts[1:], whole.num_rows]):
                if keys[a] != key:
                    yield from (x.found() for x in sweeps)
                    key, held, sweeps = keys[a], [], []
                part = whole.slice(a, z - a)
                ids, x = part.column(2).to_numpy(), unit(part.column(3).to_pandas())
                if sides[a] == 0:
                    held.append((ids, x, part.column(4).to_numpy()))
                    continue
                if held:
                    own = [np.concatenate(c) for c in zip(*held)]
                    sweeps = [_Sweep(*[c[i : i + QUERY_ROWS] for c in own], k, scored) for i in range(0, len(own[0]), QUERY_ROWS)]
                    held = []
                near = x.astype(np.float32)
                for i in range(0, len(x), ITEM_ROWS):
                    for sweep in sweeps:
                        sweep.add(ids[i : i + ITEM_ROWS], x[i : i + ITEM_ROWS], near[i : i + ITEM_ROWS])
        yield from (x.found() for x in sweeps)

    met = left.unionByName(right).repartition(len(keys), "key").sortWithinPartitions("key", "side")
    return met.mapInArrow(run, SCHEMA)


def _few_copies(items: DataFrame, k: int) -> DataFrame:
    """``items`` without the lower ids of vectors that more than ``k`` rows share."""
    key = F.xxhash64("vec")
    crowd = items.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > k)
    crowd = broadcast_if_small(cut_lineage(crowd.select("_key")))
    keyed = items.withColumn("_key", key)
    calm = keyed.join(crowd, "_key", "left_anti")
    return calm.unionByName(top_k(keyed.join(crowd, "_key", "left_semi"), ["_key", "vec"], [F.desc("id")], k)).drop("_key")


def knn(
    queries: DataFrame, items: DataFrame, k: int, leaf_rows: int = LEAF_ROWS, cell_rows: int = CELL_ROWS, tile_rows: int = TILE_ROWS, scored: Accumulator | None = None
) -> DataFrame:
    """``q, id, d, r``: the ``k`` nearest items of every query vector, ties by id descending.

    ``queries`` has ``q, qvec``, ``items`` has ``id, vec``; rows without a vector take no part.
    ``leaf_rows`` and ``cell_rows`` are the aims while leaves and cells are under their bounds;
    a cell of over ``tile_rows`` items is cut into tiles, one of over ``VISITORS`` queries is read by
    several tasks.  ``scored`` counts the pairs that were scored in all dimensions.
    """
    spark = items.sparkSession
    queries = queries.select(F.col("q").cast("bigint").alias("q"), "qvec").filter("qvec is not null")
    items = _few_copies(items.select(F.col("id").cast("bigint").alias("id"), "vec").filter("vec is not null"), k)
    # a bounded sample, picked by hash so that every run takes the same one
    sample = items.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], SCHEMA + ", r int")
    n = len(sample) if len(sample) < SAMPLE else items.count()
    order = [F.asc("d"), F.desc("id")]
    x = unit([r.vec for r in sample])
    grown = PivotTree.of(x, max(1, min(LEAVES, n // leaf_rows)), max(1, min(CELLS, n // cell_rows)))
    if _met_share(grown, x, k, n) > SWEPT:
        return top_k(_swept(queries.withColumn("bound", F.lit(FAR)), items, queries.count(), n, x.shape[1], k, scored), ["q"], order, k, "r")
    tree = spark.sparkContext.broadcast(grown)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                leaf, far = tree.value.place(unit(pdf["vec"]))
                yield pdf.assign(leaf=leaf, far=far, cell=tree.value.cell_of[leaf])

    kind = items.schema["vec"].dataType.simpleString()
    placed = cut_lineage(items.mapInPandas(assign, f"id bigint, vec {kind}, leaf bigint, far double, cell bigint"))
    # at most LEAVES rows
    stats = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).orderBy("leaf").collect()
    leaves = Leaves(*(np.array([s[i] for s in stats]) for i in range(4)))
    held = np.bincount(tree.value.cell_of[leaves.leaf], weights=leaves.rows).astype(np.int64)
    tiles = -(-held // tile_rows)
    known = spark.sparkContext.broadcast(leaves)

    def reach(batch: pa.RecordBatch, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and the cells that they visit."""
        own, row, col = known.value, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        vecs, bound = batch.column(1).to_pandas(), batch.column(2).to_numpy()
        cell_of = tree.value.cell_of[own.leaf]
        order = np.argsort(cell_of, kind="stable")
        cells, starts = np.unique(cell_of[order], return_index=True)
        step = max(1, min(512, CELLS_AT_ONCE // len(own.leaf)))
        for at in range(0, len(vecs), step):
            to, near = own.closest(tree.value, unit(vecs[at : at + step]))
            mask = np.logical_or.reduceat(own.around(to, k)[:, order], starts, axis=1)
            if not first:
                may = near**2 <= 2.0 * bound[at : at + step, None] + SLACK
                mask = ~mask & np.logical_or.reduceat(may[:, order], starts, axis=1)
            i, j = np.nonzero(mask)
            row.append(i + at)
            col.append(cells[j])
        return np.concatenate(row), np.concatenate(col)

    def found(asked: DataFrame, first: bool) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(held), np.int64)
            for batch in batches:
                if batch.num_rows:
                    total += np.bincount(reach(batch, first)[1], minlength=len(held))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

        # one row per cell that has visitors
        seen = asked.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        parts = np.zeros(len(held), np.int64)
        for s in seen:
            parts[s["cell"]] = -(-s["n"] // VISITORS)

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    row, cell = reach(batch, first)
                    part = batch.column(0).to_numpy()[row] % parts[cell]
                    times = tiles[cell]
                    tile = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    row, cell, part = (np.repeat(x, times) for x in (row, cell, part))
                    yield pa.RecordBatch.from_arrays([pa.array((cell << 40) | (tile << 20) | part), *batch.take(pa.array(row)).columns], ["key", "q", "qvec", "bound"])

        qkind = T.StructType([T.StructField("key", T.LongType()), *asked.schema.fields])
        visits = asked.mapInArrow(visit, qkind)
        plan = spark.createDataFrame([(int(c), int(tiles[c]), int(parts[c])) for c in np.flatnonzero(parts)], "cell bigint, tiles int, parts int")
        dealt = placed.join(F.broadcast(plan), "cell").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select(F.expr("shiftleft(cell, 40) | shiftleft(tile, 20) | part").alias("key"), "id", "vec", "leaf", "far")

        def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"q": [], "id": [], "d": []}).astype({"q": "int64", "id": "int64"})]
            if len(left) and len(right):
                ids, qids = right["id"].to_numpy(), left["q"].to_numpy()
                tile = Tile(tree.value, ids, unit(right["vec"]), right["leaf"].to_numpy(), right["far"].to_numpy(), k, scored)
                step = max(1, min(1024, CELLS_AT_ONCE // len(ids)))
                for at in range(0, len(left), step):
                    part = left.iloc[at : at + step]
                    qi, ci, d = tile.search(unit(part["qvec"]), part["bound"].to_numpy())
                    out.append(pd.DataFrame({"q": qids[at + qi], "id": tile.ids[ci], "d": d}))
            return pd.concat(out)

        return visits.groupBy("key").cogroup(dealt.groupBy("key")).applyInPandas(search, SCHEMA)

    near = cut_lineage(top_k(found(queries.withColumn("bound", F.lit(FAR)), True), ["q"], order, k, "r"))
    bounds = near.filter(F.col("r") == k).select("q", F.col("d").alias("bound"))
    asked = queries.join(bounds, "q", "left").select("q", "qvec", F.coalesce("bound", F.lit(FAR)).alias("bound"))
    return top_k(near.drop("r").unionByName(found(asked, False)), ["q"], order, k, "r")


def knn_below(queries: DataFrame, items: DataFrame, k: int, maximum: float) -> DataFrame:
    """Nearest ``k``, of them those closer than ``maximum``, rank by distance."""
    return knn(queries, items, k).filter(F.col("d") < maximum)


def without_self(found: DataFrame, k: int, exclude: str = "q") -> DataFrame:
    """Drop one id per query from a list of ``k + 1`` and number the rest again."""
    return top_k(
        found.filter(F.col("id") != F.col(exclude)).drop("r"), ["q"], [F.asc("d"), F.desc("id")], k, "r"
    )
