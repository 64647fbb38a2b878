"""Groups of sets that may be similar, compared in tiles of bounded size.

A group of more than ``TILE`` members is cut into tiles by hash and every pair
of its tiles becomes one piece of work, so no task holds more than two tiles
and every pair of members meets exactly once in a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, mix

TILE = 1024


def runs(batches: Iterator[pa.RecordBatch], keys: int, limit: int = 20_000, shift: int = 0) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups, with the places where groups begin and end.

    Groups are rows with equal first ``keys`` columns (bigint), without their lowest ``shift`` bits.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def edges(table: pa.Table) -> np.ndarray:
        n = table.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for k in range(keys):
            v = table.column(k).to_numpy() >> shift
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), n)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= limit:
            table = pa.Table.from_batches(held).combine_chunks()
            at = edges(table)
            if len(at) > 2:
                yield table.slice(0, int(at[-2])), at[:-1]
                held = table.slice(int(at[-2])).to_batches()
                rows = int(at[-1] - at[-2])
            else:
                held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, edges(table)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the connected group of each of ``n`` points under the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    return label


def group_ids(members: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the members of groups of two or more, their group id (a hash of its members) and its size."""
    size = np.bincount(label, minlength=len(label))
    total = np.zeros(len(label), U)
    np.add.at(total, label, mix(members.astype(U) + U(0x51ED2701)))
    at = np.flatnonzero(size[label] > 1)
    return at, mix(total[label[at]] ^ size[label[at]].astype(U)).view(np.int64), size[label[at]]


def outermost(groups: DataFrame) -> DataFrame:
    """``groups`` (``_gid``, ``_size``, ``_class``) without those whose members all share another first group.

    The first group of a member is its largest (then by id); such a group lies
    inside it, and the pairs are compared there.
    """
    first = groups.groupBy("_class").agg(F.min(F.struct((-F.col("_size")).alias("_rank"), F.col("_gid"))).alias("_f"))
    spans = groups.join(first, "_class").groupBy("_gid", "_size").agg(F.min("_f").alias("_lo"), F.max("_f").alias("_hi"))
    inside = (F.col("_lo") == F.col("_hi")) & (F.col("_lo")["_gid"] != F.col("_gid"))
    return groups.join(spans.filter(~inside).select("_gid"), "_gid")


def tiled(groups: DataFrame, member: str, tile: int = TILE) -> DataFrame:
    """``groups`` (with ``_gid``, ``_size``) once per pair of tiles: adds ``_a``, ``_b`` (the pair) and ``_own``."""
    count = F.ceil(F.col("_size") / tile).cast("bigint")
    own = F.when(F.col("_size") <= tile, F.lit(0)).otherwise(F.pmod(F.xxhash64(member, "_gid"), count)).cast("bigint")
    out = groups.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    return out.withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other")).drop("_other")


class Overlaps:
    """Shared tokens of one set with each of a list of sets."""

    def __init__(self, flat: np.ndarray, first: np.ndarray):
        """Tokens end to end (no set is empty) and the n + 1 places where sets begin."""
        distinct, self.ids = np.unique(flat, return_inverse=True)
        self.first, self.mark = first, np.zeros(len(distinct), bool)

    def of(self, i: int, places: slice | None = None, head: int | None = None) -> np.ndarray:
        """With all sets, or with those of a slice of places; of set ``i`` all tokens, or the first ``head``."""
        own = self.ids[self.first[i] : self.first[i + 1]][:head]
        self.mark[own] = True
        a, b = (places.start, places.stop) if places else (0, len(self.first) - 1)
        low = self.first[a]
        out = np.add.reduceat(self.mark[self.ids[low : self.first[b]]], self.first[a:b] - low, dtype=np.int64)
        self.mark[own] = False
        return out
