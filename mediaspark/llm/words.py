"""Numpy helpers shared by the operators: texts in blocks, words and their hashes.

Words are maximal runs of bytes other than space and 0x09-0x0D, unchanged.
All functions work on blocks of whole texts of bounded size, so the memory of
a task does not depend on the number of rows (one very long text is a block of
its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))


def is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, *range(9, 14)]] = True
    return table


def blocks(batches: Iterator[pa.RecordBatch], text: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` text bytes each.

    Yields the slice, its UTF-8 bytes end to end and the n + 1 offsets of the
    texts in them.  Null texts count as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text).cast(pa.large_binary())
        if col.null_count:
            col = col.fill_null(b"")
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


class Words:
    """Words of a block of texts.

    ``start`` and ``end`` are byte places, ``doc`` the row of each word,
    ``first`` the n + 1 places where the words of each row begin and ``hash``
    a 64-bit value of each word's bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        word = ~is_space()[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], word[:-1])) if n else word
        after = np.concatenate((word[1:], [False])) if n else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = self._hashes(data)

    def _hashes(self, data: np.ndarray, base: int = 0x9E3779B97F4A7C15 | 1) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        value = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
        # place by place inside the word: words are short, so few rounds
        length = self.end - self.start
        out = length.astype(U)
        most = int(length.max())
        live = np.arange(len(length))
        for k in range(min(most, 24)):
            live = live[length[live] > k]
            out[live] = (out[live] ^ value[data[self.start[live] + k]]) * U(base)
        for i in live[length[live] > 24]:
            tail = data[self.start[i] + 24 : self.end[i]]
            powers = np.full(len(tail), base, U)
            powers = np.multiply.accumulate(powers)
            out[i] = out[i] ^ mix(np.array([(value[tail] * powers).sum(dtype=U)], U))[0]
        return mix(out)


def windows(words: Words, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words inside one row: hash, row, index of the first word.

    With ``short`` a row of 1 to ``size - 1`` words gives one window of all of them.
    """
    n = len(words.hash)
    counts = np.diff(words.first)
    powers = np.multiply.accumulate(np.full(size, 0xC6A4A7935BD1E995 | 1, U))
    if n >= size:
        total = np.zeros(n - size + 1, U)
        for k in range(size):
            total += words.hash[k : n - size + 1 + k] * powers[size - 1 - k]
        at = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1 :])
        out, doc = mix(total[at]), words.doc[at]
    else:
        at = np.zeros(0, np.int64)
        out, doc = np.zeros(0, U), np.zeros(0, np.int64)
    if short:
        few = np.flatnonzero((counts > 0) & (counts < size))
        if len(few):
            more = np.zeros(len(few), U)
            for k in range(size - 1):
                has = counts[few] > k
                more[has] = more[has] * powers[0] + words.hash[words.first[few[has]] + k]
            more = mix(more ^ salted(counts[few].astype(U), 7))
            order = np.argsort(np.concatenate((doc, few)), kind="stable")
            out, doc = np.concatenate((out, more))[order], np.concatenate((doc, few))[order]
            at = np.concatenate((at, words.first[few]))[order]
    return out, doc, at


def sets(value: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending, and the n + 1 places where rows begin."""
    # a block has under 2^22 rows; 42 bits of the value order it within a row
    order = np.argsort((doc.astype(U) << U(42)) | (value >> U(22)))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(rows + 1))


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the n + 1 places of the rows."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype()), kind))
