"""Best-fit packing (1): bin completion with bounds, best fit as the incumbent.

Documents become pieces of at most ``capacity`` tokens.  Pieces that fill a
sequence alone are done.  The others are dealt by hash into blocks of about
``BLOCK`` pieces that are solved apart, each in one task: the best-fit
solution is the incumbent; unless it meets the lower bound, the search takes
the largest piece left, tries the undominated fillings of the room beside it,
and cuts every branch whose wasted room already rules out a better solution.
A block wastes less than one sequence over its bound in almost all cases, so
blocks cost about one sequence in a thousand against one packing of all.  The
number of blocks follows from a count, so the work of a task does not grow
with the corpus.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import ChunkEncoder, cut_pieces, with_end

CAPACITY = 2048
BLOCK = 4096
NODES = 1500
WIDTH = 64
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Sequences that ``count[length]`` pieces need at least: the best of the volume bounds over all cut-off lengths."""
    sizes = np.arange(capacity + 1)
    number, volume = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * sizes)))
    half = capacity // 2
    k = np.arange(half + 1)
    large = number[-1] - number[capacity - k + 1]
    middle = number[capacity - k + 1] - number[half + 1]
    room = middle * capacity - (volume[capacity - k + 1] - volume[half + 1])
    small = volume[half + 1] - volume[k]
    return int((large + middle + np.maximum(0, -((room - small) // capacity))).max())


def best_fit(sizes: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Best-fit decreasing over ``sizes`` (descending); open room is kept by residual in an integer bit set."""
    bins = bins if bins is not None else []
    free: dict[int, list[list[int]]] = {}
    rooms = 0
    for s in sizes:
        fit = rooms >> s
        if fit:
            room = s + ((fit & -fit).bit_length() - 1)
            target = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, target = capacity, []
            bins.append(target)
        target.append(s)
        room -= s
        if room:
            free.setdefault(room, []).append(target)
            rooms |= 1 << room
    return bins


def dominated(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """True if the items of ``one`` fit, grouped, into the places of single items of ``other``."""
    rooms = sorted(other)
    for s in one:
        at = next((i for i, r in enumerate(rooms) if r >= s), None)
        if at is None:
            return False
        rooms[at] -= s
        rooms.sort()
    return True


def fillings(keys: list[int], count: dict[int, int], room: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated maximal sets of pieces for ``room``, fullest first.  ``keys``: ascending lengths that are left."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int, top: int) -> None:
        at = bisect_right(keys, min(left, top)) - 1
        fits = False
        tried = 0
        while at >= 0 and len(found) < width and tried < 12:
            s = keys[at]
            if count[s] > chosen.count(s):
                fits = True
                tried += 1
                extend((*chosen, s), left - s, s)
            at -= 1
        if not fits and not any(count[s] > chosen.count(s) for s in keys[: bisect_right(keys, left)]):
            found.append(chosen)

    extend((), room, room)
    found.sort(key=lambda f: (-sum(f), len(f)))
    kept: list[tuple[int, ...]] = []
    for f in found[:width]:
        if not any(dominated(f, g) for g in kept):
            kept.append(f)
    return kept or [()]


def complete(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Pack ``sizes`` into as few bins as the search finds within ``nodes`` nodes."""
    sizes = sorted(sizes, reverse=True)
    best = best_fit(sizes, capacity)
    count = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, int)
    need, total = lower_bound(count, capacity), sum(sizes)
    if len(best) <= need:
        return best
    left = {int(s): int(count[s]) for s in np.flatnonzero(count)}
    keys = sorted(left)
    path: list[tuple[int, ...]] = []
    waste = 0
    stack: list[list[tuple[int, ...]]] = []

    def take(f: tuple[int, ...], sign: int) -> None:
        nonlocal waste
        for s in f:
            left[s] -= sign
            if not left[s] and sign > 0:
                keys.pop(bisect_right(keys, s) - 1)
            elif left[s] == 1 and sign < 0 and (not (i := bisect_right(keys, s)) or keys[i - 1] != s):
                keys.insert(i, s)
        waste += sign * (capacity - sum(f))

    def options() -> list[tuple[int, ...]]:
        top = keys[-1]
        left[top] -= 1
        found = [(top, *f) for f in fillings(keys, left, capacity - top)]
        left[top] += 1
        return found[::-1]

    stack.append(options())
    for step in range(nodes):
        while stack and not stack[-1]:
            stack.pop()
            if path:
                take(path.pop(), -1)
        if not stack:
            break
        f = stack[-1].pop()
        # a better solution may waste this much room in all
        if waste + capacity - sum(f) > (len(best) - 1) * capacity - total:
            continue
        take(f, 1)
        path.append(f)
        if not keys or step % 50 == 49:
            rest = [s for s in reversed(keys) for _ in range(left[s])]
            whole = best_fit(rest, capacity, [list(p) for p in path])
            if len(whole) < len(best):
                best = whole
                if len(best) <= need:
                    break
        stack.append(options() if keys else [])
    return best


def place(lengths: np.ndarray, capacity: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(capacity + 2), "left")
    use = ends[1:].copy()
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, content in enumerate(complete(lengths.tolist(), capacity, nodes)):
        at = 0
        for s in content:
            use[s] -= 1
            i = order[use[s]]
            bins[i], offsets[i] = b, at
            at += s
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, block: int = 256) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document; a null text is the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids, first = with_end(*encoder.encode([t or "" for t in part.column(1).to_pylist()]), end_id)
                raw, out = ids.astype("<u4"), []
                for doc, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    for k, (s, n) in enumerate(cut_pieces(b - a, capacity)):
                        out.append((doc, k, s, n, zlib.crc32(raw[a + s : a + s + n])))
                names = [c.split()[0] for c in PIECES.split(", ")]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, PIECES)


def pack(parts: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, nodes: int = NODES) -> DataFrame:
    """Give every row of ``parts`` (with a ``length`` from 1 to ``capacity``) a ``sequence_id`` and an ``offset``.

    Rows may repeat and other columns may hold nulls; all are carried along.
    """
    parts = parts.drop("sequence_id", "offset")
    names = parts.columns
    plain = [f"c{i}" for i in range(len(names))]  # grouped Arrow functions take no dotted names
    size, row = plain[names.index("length")], "row_"
    parts = cut_lineage(parts.toDF(*plain)).withColumn(row, F.monotonically_increasing_id())
    short = parts.filter(F.col(size) < capacity)
    count = max(1, -(-short.count() // block))
    alone = parts.filter(F.col(size) == capacity).select(*plain, (-1 - F.col(row)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))

    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bins, offsets = place(table.column(size).to_numpy(), capacity, nodes)
        sequence = (table.column("block_")[0].as_py() << 32) + bins
        return table.select(plain).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*plain).schema)
    rest = (
        short.withColumn("block_", F.pmod(F.xxhash64(row), F.lit(count)).cast("bigint"))
        .drop(row)
        .groupBy("block_")
        .applyInArrow(solve, f"{schema}, sequence_id bigint, offset bigint")
    )
    return rest.unionByName(alone).toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, block: int = BLOCK, nodes: int = NODES) -> DataFrame:
    """Pack all documents, overlong ones in pieces: one row per piece with its place.

    Null texts count as empty, null and repeated ids are kept, other columns
    are ignored, an empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity, block, nodes)
