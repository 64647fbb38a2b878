"""Token-id output (5): packed id matrices with segment ends and position resets.

Documents are encoded, closed by an end id and cut without loss into pieces
of at most ``capacity`` ids.  Each task packs blocks of its own pieces by
best-fit decreasing; a segment tree over the open room finds the fullest
sequence that still takes a piece.  Nothing is shuffled: ids go from the scan
to the output, and a block costs at most one half-filled sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import ChunkEncoder, cut_pieces, with_end

CAPACITY = 2048
BLOCK_TOKENS = 2_000_000
SCHEMA = (
    "sequence_id bigint, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, positions binary, "
    "doc_ids array<bigint>, pieces array<int>"
)


class RoomTree:
    """Counts of open sequences by free room; finds the smallest room of at least a given size."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        at = size + self.width
        if not self.count[at]:
            # up to the first right neighbour that holds something, then down its left edge
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.width
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Piece numbers of every sequence."""
    tree = RoomTree(capacity)
    out: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        room, sequence = found if found else (capacity, len(out))
        if not found:
            out.append([])
        out[sequence].append(i)
        if room > size:
            tree.put(room - size, sequence)
    return out


def packed_matrices(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, pad_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per sequence of the packed matrix.

    ``ids`` holds ``capacity`` little-endian unsigned 16-bit ids (padded with
    ``pad_id``), ``cu_seqlens`` the places where segments begin and the end of
    the last, ``positions`` as many unsigned 16-bit places that restart at
    every segment (padding counts on from 0), ``doc_ids`` and ``pieces`` name
    the segments.  Null texts count as empty, null and repeated ids are kept,
    other columns are ignored.
    """
    if capacity > 65536:
        raise ValueError("positions are 16-bit")

    def emit(ids: np.ndarray, parts: list[tuple], base: int) -> pa.RecordBatch:
        lengths = np.array([p[3] for p in parts], np.int64)
        starts = np.array([p[2] for p in parts], np.int64)
        rows = best_fit_decreasing(lengths, capacity)
        columns: list[list] = [[] for _ in range(8)]
        for k, row in enumerate(rows):
            own = lengths[row]
            ends = np.cumsum(own)
            total = int(ends[-1])
            matrix, places = np.full(capacity, pad_id, "<u2"), np.zeros(capacity, "<u2")
            spread = np.repeat(starts[row] - ends + own, own) + np.arange(total)
            matrix[:total] = ids[spread]
            places[:total] = np.arange(total) - np.repeat(ends - own, own)
            places[total:] = np.arange(capacity - total)
            values = (base + k, total, len(row), matrix.tobytes(), [0, *ends.tolist()], places.tobytes(), [parts[i][0] for i in row], [parts[i][1] for i in row])
            for c, v in zip(columns, values, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer)
        if len(encoder.bytes) > 65536:
            raise ValueError("ids are 16-bit")
        base = TaskContext.get().partitionId() << 33
        held, parts, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, first = with_end(*encoder.encode([t or "" for t in part.column(1).to_pylist()]), end_id)
                for doc, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    parts += [(doc, k, size + a + s, n) for k, (s, n) in enumerate(cut_pieces(b - a, capacity))]
                held.append(ids.astype("<u2"))
                size += len(ids)
                if size >= block_tokens:
                    out = emit(np.concatenate(held), parts, base)
                    base += out.num_rows
                    yield from (out.slice(i, 256) for i in range(0, out.num_rows, 256))
                    held, parts, size = [], [], 0
        if parts:
            out = emit(np.concatenate(held), parts, base)
            yield from (out.slice(i, 256) for i in range(0, out.num_rows, 256))

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def segments(packed: DataFrame) -> DataFrame:
    """The inverse: ``doc_id, piece, ids`` (little-endian 16-bit) of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, ends, docs, numbers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                out += [(d, p, ids[2 * a : 2 * b]) for d, p, a, b in zip(docs, numbers, ends[:-1], ends[1:], strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), kinds, strict=True)], ["doc_id", "piece", "ids"])

    return packed.select("ids", "cu_seqlens", "doc_ids", "pieces").mapInArrow(run, "doc_id bigint, piece int, ids binary")
