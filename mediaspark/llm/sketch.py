"""Document fingerprints (7): threshold-scaled sketches of word shingles.

A sketch keeps every 5-word shingle whose hash lies below a fixed fraction of
the hash range.  Sketches of the same fraction can be merged by union, and the
share of one sketch found in another estimates containment however unequal the
documents are.  Texts of fewer than ``WHOLE`` shingles keep all of them (a
fraction of 1); two sketches are compared at the smaller of their fractions, to
which the other is cut by its threshold, so the estimates stay consistent.

A fingerprint is text: the inverse fraction, a colon and the kept hashes as 16
hex digits each, ascending.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, Words, blocks, salted, sets, windows

SHINGLE = 5
INVERSE = 8
WHOLE = 128
BUCKETS = 8192
SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, next_doc_id bigint"
)


class Sketch:
    """Kept hashes (ascending) of one text and the inverse of its fraction."""

    def __init__(self, kept: np.ndarray, inverse: int):
        self.kept, self.inverse = kept, inverse

    def at(self, inverse: int) -> np.ndarray:
        if inverse <= self.inverse:
            return self.kept
        return self.kept[: np.searchsorted(self.kept, U(2**64 // inverse))]

    def merged(self, other: Sketch) -> Sketch:
        inverse = max(self.inverse, other.inverse)
        return Sketch(np.union1d(self.at(inverse), other.at(inverse)), inverse)

    def containment(self, other: Sketch) -> float:
        """Share of this text's shingles found in the other; two texts without any count as alike."""
        inverse = max(self.inverse, other.inverse)
        own, its = self.at(inverse), other.at(inverse)
        if not len(own):
            return 1.0 if not len(self.kept) and not len(other.kept) else 0.0
        if not len(its):
            return 0.0
        at = np.minimum(np.searchsorted(its, own), len(its) - 1)
        return float((its[at] == own).mean())

    def text(self) -> str:
        raw = self.kept.astype(">u8").tobytes().hex()
        return f"{self.inverse}:{raw}"


def sketches(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, inverse: int = INVERSE, whole: int = WHOLE) -> list[Sketch]:
    rows = len(offsets) - 1
    value, doc, _ = windows(Words(data, offsets), shingle, short=True)
    value = salted(value, 71)
    many = np.bincount(doc, minlength=rows) >= whole
    keep = ~many[doc] | (value < U(2**64 // inverse))
    kept, first = sets(value[keep], doc[keep], rows)
    return [Sketch(kept[first[i] : first[i + 1]], inverse if many[i] else 1) for i in range(rows)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, inverse: int = INVERSE, whole: int = WHOLE) -> DataFrame:
    """``doc_id, fingerprint`` of every row; null texts count as empty (``1:``), other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, 1):
            found = [s.text() for s in sketches(data, offsets, shingle, inverse, whole)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def with_neighbours(docs: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """``_bucket, _ghost, doc_id, text``: documents by descending id in buckets, each followed by its successor.

    Bounds are ids of the table (approximate quantiles, at most ``buckets`` of
    them), so the row after the last of a bucket is known to be the one at the
    next bound.  A copy of it (``_ghost`` 1) closes the bucket; the first row of
    all (``_ghost`` 2) closes the last one.
    """
    spark = docs.sparkSession
    key = "coalesce(cast(doc_id as bigint), -9223372036854775808L)"
    base = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(text, '') text", f"{key} _key")
    size = base.agg(F.count(F.lit(1)), F.max("_key")).first()
    count = max(1, min(buckets, size[0] // 512))
    shares = [i / count for i in range(1, count + 1)]
    cuts = base.agg(F.percentile_approx("_key", F.array(*map(F.lit, shares)), max(1000, 20 * count))).first()[0] if size[0] else []
    bounds = sorted({*(cuts or []), *([size[1]] if size[0] else [])}, reverse=True)
    if not bounds:
        return spark.createDataFrame([], "_bucket int, _ghost int, doc_id bigint, text string, _key bigint"), 1
    up = np.array(bounds[::-1], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(2).to_numpy()
            bucket = len(up) - 1 - np.searchsorted(up, keys, "left")
            bound = up[len(up) - 1 - bucket] == keys
            places = [[[int(k), 0]] + ([[int(k) - 1, 1] if k else [len(up) - 1, 2]] if at else []) for k, at in zip(bucket, bound, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.list_(pa.list_(pa.int32())))], ["doc_id", "text", "_key", "_places"])

    placed = base.mapInArrow(place, "doc_id bigint, text string, _key bigint, _places array<array<int>>")
    rows = placed.withColumn("_p", F.explode("_places")).select(F.col("_p")[0].alias("_bucket"), F.col("_p")[1].alias("_ghost"), "doc_id", "text", "_key")
    return rows, len(bounds)


def edited_fingerprints(docs: DataFrame, shingle: int = SHINGLE, inverse: int = INVERSE, whole: int = WHOLE, block: int = 128) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness.

    The last third of a text's code points is replaced by as many from the head
    of the next document by descending doc_id; the last document takes from the
    first.  Null ids come last, rows of one id are ordered by text.  Null texts
    count as empty.  A table of one row is its own successor.

    ``near_edited`` and ``near_next`` are the share of the document's shingles
    found in its edited text and in the next document.
    """
    rows, count = with_neighbours(docs)
    spark = docs.sparkSession
    parts = min(count, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    ordered = rows.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_ghost", F.desc("_key"), "text")

    def flush(pending: list[tuple]) -> pa.RecordBatch:
        texts, ids = [x[1] for x in pending], [x[0] for x in pending]
        following = [x[2] for x in pending]
        edited = [t if not (k := len(t) // 3) else t[: len(t) - k] + n[1][:k] for t, n in zip(texts, following, strict=True)]
        one, two, three = (sketches(*_bytes(x), shingle, inverse, whole) for x in (texts, edited, [n[1] for n in following]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([s.text() for s in one]),
                pa.array([s.text() for s in two]),
                pa.array([a.containment(b) for a, b in zip(one, two, strict=True)], pa.float64()),
                pa.array([a.containment(b) for a, b in zip(one, three, strict=True)], pa.float64()),
                pa.array([n[0] for n in following], pa.int64()),
            ],
            [c.split()[0] for c in SCHEMA.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        last: tuple | None = None  # waits for its successor: bucket, id, text
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                for bucket, ghost, doc, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if last is not None and last[0] == bucket:
                        pending.append((last[1], last[2], (doc, text)))
                        size += 2 * len(last[2])
                    last = None if ghost else (bucket, doc, text)
                    if size > 1_000_000:
                        yield flush(pending)
                        pending, size = [], 0
        if pending:
            yield flush(pending)

    return ordered.drop("_key").mapInArrow(run, SCHEMA)
