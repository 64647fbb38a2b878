"""Substring dedup (8): repeated word windows by level-wise doubling.

Windows of ``size`` words (35) are found over two lengths, 18 and 35: only what
is repeated at one length is extended to twice that length, and what survives
there is removed.  The first level looks at anchors: every window has one
18-word gram of smallest hash in it, equal windows have equal anchors, so a
window whose anchor is not repeated is not repeated.

Rows with equal texts are known beforehand by a hash of the text: the first of
them stands for all as proof and every window of theirs is repeated.

Equal hashes meet in one shuffle.  Before it, a task replaces what it has
itself seen repeated: such rows carry their own proof (a count of 2 under a key
of their own), and the shared key gets one row of evidence, so a passage that
a third of all documents share arrives as a few rows per task.  Windows of the
last level are compared by 96 hash bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import U, Words, blocks, mix, salted, windows

SIZE = 35
SEEN = 500_000


class Repeats:
    """Splits hashes into rows for the shuffle; remembers (bounded) what the task has proved repeated."""

    def __init__(self):
        self.seen = np.zeros(0, U)

    def split(self, value: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and counts of all rows, and the hashes that need a row of evidence.

        ``own``: values that no other row has as a key; a row known to be
        repeated takes its own as the key.
        """
        distinct, back, count = np.unique(value, return_inverse=True, return_counts=True)
        at = np.minimum(np.searchsorted(self.seen, distinct), max(len(self.seen) - 1, 0))
        before = self.seen[at] == distinct if len(self.seen) else np.zeros(len(distinct), bool)
        several = count > 1
        proved = (several | before)[back]
        evidence = distinct[several & ~before]
        self.seen = np.union1d(self.seen, evidence) if len(self.seen) < SEEN else np.sort(evidence)
        return np.where(proved, own, value), np.where(proved, 2, 1), evidence


def selected(words: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``size`` words: index of its first word, of its anchor's first word, and the anchor's hash."""
    value, doc, at = windows(words, gram)
    width = size - gram + 1
    if len(value) < width:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U)
    order = salted(value, 5)
    inside = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
    best = np.lib.stride_tricks.sliding_window_view(order, width).argmin(axis=1)[inside] + inside
    return at[inside], at[best], value[best]


def spread_hash(words: Words, size: int) -> np.ndarray:
    """Hash of the window at every word (0 where there is none)."""
    value, _, at = windows(words, size)
    out = np.zeros(len(words.hash), U)
    out[at] = value
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


def second_hash(words: Words, start: np.ndarray, size: int) -> np.ndarray:
    """31 more bits of each window, from another mix of its words."""
    out = np.zeros(len(start), U)
    for k in range(size):
        out += mix(words.hash[start + k] + U(k + 1))
    return (out >> U(33)).astype(np.int32)


#: flags a place whose window is known to be repeated
PROVED = 1 << 30


def _level(rows: DataFrame, size: int, gram: int, live: bool) -> DataFrame:
    """``_key, _check, _row, _pos``: anchors, or with ``live`` the windows over live anchors.

    A place of ``PROVED`` or more counts twice.  Rows without ``_row`` are
    evidence only; the first of equal texts gives nothing else.
    """
    schema = "_key bigint, _check int, _row bigint, _pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = Repeats()
        for part, data, offsets in blocks(batches, 1):
            words = Words(data, offsets)
            start, anchor, value = selected(words, size, gram)
            ids, twin = part.column(0).to_numpy(), part.column(3).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            if live:
                listed = part.column(4).fill_null([])
                alive = np.zeros(len(words.hash) + 1, bool)
                alive[words.first[np.repeat(np.arange(part.num_rows), np.diff(listed.offsets.to_numpy()))] + listed.flatten().to_numpy()] = True
                start = start[alive[anchor] | twin[words.doc[start]]] if len(start) else start
                value = spread_hash(words, size)[start]
                check = second_hash(words, start, size)
            else:
                start, where = np.unique(anchor, return_index=True)
                value, check = value[where], np.zeros(len(where), np.int32)
            doc = words.doc[start]
            pos = start - words.first[doc]
            own = mix(ids[doc].astype(U) * U(0x9E3779B97F4A7C15) + pos.astype(U))
            whole = twin[doc] if len(doc) else np.zeros(0, bool)
            key, n, evidence = repeats.split(value[~whole], own[~whole])
            of = np.zeros(len(evidence), np.int32)
            if len(evidence):
                order = np.argsort(value, kind="stable")
                of = check[order[np.searchsorted(value[order], evidence)]]
            # proofs: hashes repeated in this task, and all of a text that has copies
            known, which = np.unique(value[whole], return_index=True)
            proof, proof_check = np.concatenate([evidence, known]), np.concatenate([of, check[whole][which]])
            k = len(proof)
            gone = np.concatenate([np.zeros(len(key), bool), np.ones(k, bool)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([_signed(key), _signed(proof)])),
                    pa.array(np.concatenate([check[~whole], proof_check]).astype(np.int32)),
                    pa.array(np.concatenate([ids[doc[~whole]], np.zeros(k, np.int64)]), mask=gone),
                    pa.array((np.concatenate([pos[~whole], np.zeros(k, np.int64)]) + np.concatenate([np.where(n > 1, PROVED, 0), np.full(k, PROVED)])).astype(np.int32)),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    return rows.mapInArrow(run, schema)


def _repeated(rows: DataFrame) -> DataFrame:
    """``_row`` and the places whose keys count at least twice; evidence ends here."""
    total = F.sum(F.when(F.col("_pos") >= PROVED, 2).otherwise(1)).over(Window.partitionBy("_key", "_check"))
    found = rows.withColumn("_total", total).filter((F.col("_total") > 1) & F.col("_row").isNotNull())
    return found.groupBy("_row").agg(F.collect_list((F.col("_pos") % PROVED).cast("int")).alias("_list"))


def _twins(rows: DataFrame) -> DataFrame:
    """``_row, _first`` of the rows whose text has copies; ``_first`` marks the one that stands for them."""
    text = F.coalesce("text", F.lit(""))
    hashed = rows.select("_row", F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_i"))
    groups = hashed.groupBy("_h", "_i").agg(F.min("_row").alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return hashed.join(groups, ["_h", "_i"]).select("_row", (F.col("_row") == F.col("_least")).alias("_first"))


def remove_repeats(docs: DataFrame, size: int = SIZE, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and the kept ``text``) of every row of ``docs``.

    Removed is each word covered by a window whose words also start anywhere
    else, in the same document too, judged on the input.  Null texts have no
    words; rows under ``size`` words lose none; repeated rows repeat each
    other; null ids are kept; other columns are ignored.  ``docs`` must be
    readable again in the same order (a table).
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_row", F.monotonically_increasing_id())
    # one shuffle of the texts by row serves both levels and the result
    base = rows.join(_twins(rows), "_row", "left").select("_row", "text", "doc_id", "_first")
    once = base.filter("_first is null or _first")
    gram = (size + 1) // 2
    live = _repeated(_level(once, size, gram, False))
    found = _repeated(_level(once.join(live, "_row", "left").filter("_first or _list is not null"), size, gram, True))
    joined = base.join(found, "_row", "left")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, 1):
            words = Words(data, offsets)
            counts = np.diff(words.first)
            gone = np.zeros(len(words.hash) + 1, np.int64)
            found = part.column(4).fill_null([])
            row = np.repeat(np.arange(part.num_rows), np.diff(found.offsets.to_numpy()))
            start = words.first[row] + found.flatten().to_numpy()
            np.add.at(gone, start, 1)
            np.add.at(gone, start + size, -1)
            covered = np.cumsum(gone)[:-1] > 0
            copied = ~np.array(part.column(3).is_null()) & (counts >= size)  # every window of a copy is repeated
            covered |= copied[words.doc] if len(covered) else covered
            raw = data.tobytes()
            removed = np.add.reduceat(np.concatenate([covered, [False]]), words.first[:-1], dtype=np.int64) * (counts > 0)
            kept = []
            for i in range(part.num_rows):
                a, b = words.first[i], words.first[i + 1]
                at = np.flatnonzero(~covered[a:b]) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]))
            arrays = [part.column(2), pa.array(counts.astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            if with_text:
                arrays.append(pa.array([k.decode() for k in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    return joined.select("_row", "text", "doc_id", "_first", "_list").mapInArrow(run, schema)
