"""Helpers that keep plans safe when the data is large or skewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 16


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` fits the bound.

    The count stops at ``max_rows + 1`` rows.  A larger side stays unhinted, so
    the join runs as a shuffle join that AQE can split on skew.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def fits(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def salted_lookup(
    big: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    spread: str | Column = "id",
    salts: int = SALTS,
) -> DataFrame:
    """Join many rows to a lookup that is unique on ``on``, whatever the skew.

    One key may own a third of ``big``.  Its rows are spread over ``salts``
    tasks and the (unique) lookup row is repeated once per salt.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    fan = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    return (
        big.withColumn("_salt", salt)
        .join(lookup.withColumn("_salt", F.explode(fan)), [*on, "_salt"], how)
        .drop("_salt")
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key.

    The filter on the rank lets Spark cut each partition to ``k`` rows per key
    before the shuffle, so a hot key never reaches one task whole.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def spread(df: DataFrame) -> DataFrame:
    """Share out the rows of an input that has fewer files than there are cores.

    A large table has many files and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys owning more than ``limit`` rows, with their count ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)


def tiled_cogroup(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, fn, schema: str, tile: int
) -> DataFrame:
    """Cogroup two sides on ``keys`` in tiles of about ``tile`` rows a side.

    A key with many rows on either side is cut into a grid of tiles, so no
    task ever holds more than one tile of each side, and every pair of rows
    with an equal key meets in exactly one tile.
    """

    def parts(df: DataFrame, name: str) -> DataFrame:
        hot = hot_keys(df, keys, tile)
        return hot.select(*keys, F.ceil(F.col("n") / tile).cast("bigint").alias(name))

    grid = parts(left, "_lp").join(parts(right, "_rp"), keys, "full")
    grid = broadcast_if_small(grid.na.fill(1, ["_lp", "_rp"]))
    one = F.lit(1).cast("bigint")

    def side(df: DataFrame, own: str, row_id: str, other: str, own_tile: str, other_tile: str) -> DataFrame:
        split = (
            df.join(grid, keys, "left")
            .withColumn(own_tile, F.pmod(F.xxhash64(row_id, F.lit(own)), F.coalesce(own, one)))
            .withColumn(other_tile, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, one) - 1)))
            .drop(own, other)
        )
        # fresh column identities, so that a table can meet itself
        return split.select(*[F.col(c).alias(c) for c in split.columns])

    lt = side(left, "_lp", left_id, "_rp", "_lt", "_rt")
    rt = side(right, "_rp", right_id, "_lp", "_rt", "_lt")
    group = [*keys, "_lt", "_rt"]
    return lt.groupBy(*group).cogroup(rt.groupBy(*group)).applyInPandas(fn, schema)
