"""Media columns (3): chroma fingerprints of recordings and their alignment.

A recording is a binary column of unsigned 8-bit samples.  Overlapping frames
become 12 pitch-class energies; an integral image over frames and pitch classes
gives the sums of any rectangle in four look-ups; sixteen filters compare
rectangles over up to 16 frames, each is quantised to two Gray-coded bits, and
the 32 bits of a place make one integer.

Alignment: the index has every place of every value in the query recordings.
Values that no query holds are dropped before the shuffle by a hashed bit set
of fixed size, the rest meet the index by value, every recording votes for
(query, offset) in a histogram, and every offset of a pair with two votes or
more is verified by the share of wrong bits over the overlap.  Recordings with
equal fingerprints are one class and are matched once; recordings too short
for a code are one class if their samples are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .names import all_of
from .words import blocks

RATE = 8000
FRAME = 256
HOP = 32
WIDEST = 16
SHORTEST = FRAME + (WIDEST - 1) * HOP  # samples of the first code
BLOCK = 400_000
#: shape, first pitch class, pitch classes, frames of the sixteen filters
FILTERS = [(i % 4, (5 * i) % 7, 4 + (3 * i) % 6 // 2 * 2 if i % 4 != 3 else 6, (4, 8, 12, 16)[i // 4]) for i in range(16)]
#: outer thresholds by shape: about the quartiles of the filters on text samples
THRESHOLD = (0.12, 0.08, 0.08, 0.12)
GRAY = np.array([0, 1, 3, 2], np.uint32)
MIN_OVERLAP = 8
MIN_VOTES = 2
FILTER_BITS = 1 << 27
MAX_ERROR = 0.25


def pitch_matrix(low: float = 60.0, high: float = 3800.0) -> np.ndarray:
    """Weights from FFT bins to the 12 pitch classes (A is 0)."""
    f = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(f), 12), np.float32)
    for k in np.flatnonzero((f >= low) & (f <= high)):
        out[k, round(12 * np.log2(f[k] / 440)) % 12] = 1
    return out


def chroma(samples: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised pitch-class energies of the frames that begin at ``start``."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[start].astype(np.float32)
    frames -= frames.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    energy = power.astype(np.float32) @ pitch_matrix()
    return energy / np.maximum(np.sqrt((energy**2).sum(axis=1, keepdims=True)), 1e-6)


def codes(frames: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 32-bit integers of the places ``at``; each place has ``WIDEST`` frames behind it."""
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def area(t: np.ndarray, y: int, w: int, h: int) -> np.ndarray:
        return image[t + w, y + h] - image[t, y + h] - image[t + w, y] + image[t, y]

    out = np.zeros(len(at), np.uint32)
    for k, (shape, y, h, w) in enumerate(FILTERS):
        y = min(y, 12 - h)
        if shape == 0:  # upper against lower pitch classes
            a, b = area(at, y + h // 2, w, h // 2), area(at, y, w, h // 2)
        elif shape == 1:  # later against earlier frames
            a, b = area(at + w // 2, y, w // 2, h), area(at, y, w // 2, h)
        elif shape == 2:  # crossed quarters
            a = area(at, y, w // 2, h // 2) + area(at + w // 2, y + h // 2, w // 2, h // 2)
            b = area(at, y + h // 2, w // 2, h // 2) + area(at + w // 2, y, w // 2, h // 2)
        else:  # the middle third of pitch classes against the rest
            a = area(at, y + h // 3, w, h // 3)
            b = (area(at, y, w, h) - a) / 2
        value = np.log((1 + a) / (1 + b))
        level = np.searchsorted([-THRESHOLD[shape], 0.0, THRESHOLD[shape]], value)
        out |= GRAY[level] << np.uint32(2 * k)
    return out


def fingerprints(recordings: DataFrame, audio: str) -> DataFrame:
    """All columns but ``audio``, with ``n_frames`` and ``codes`` (little-endian unsigned 32-bit integers).

    Null recordings and those too short for ``WIDEST`` frames have no codes.
    """
    kept = [c for c in recordings.columns if c not in (audio, "n_frames", "codes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, 0, BLOCK):
            count = np.maximum(0, (np.diff(offsets) - FRAME) // HOP + 1)
            first = np.concatenate(([0], np.cumsum(count)))
            row = np.repeat(np.arange(len(count)), count)
            place = np.arange(first[-1]) - first[row]
            at = np.flatnonzero(place <= count[row] - WIDEST)
            found = codes(chroma(data, offsets[row] + place * HOP), at) if len(at) else np.zeros(0, np.uint32)
            ends = np.searchsorted(row[at], np.arange(len(count) + 1))
            raw = found.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[1:],
                    pa.array(count.astype(np.int32)),
                    pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                ],
                [*kept, "n_frames", "codes"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in recordings.select(*all_of(kept)).schema)
    return recordings.select(audio, *all_of(kept)).mapInArrow(run, f"{schema}, n_frames int, codes binary")


def _placed(prints: DataFrame, marks: np.ndarray | None = None) -> DataFrame:
    """``_class, value, t``: every code of the recordings, or those that ``marks`` may know."""
    schema = "_class bigint, value bigint, t int"
    known = None if marks is None else prints.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                own = [np.frombuffer(c, "<u4") for c in part.column(1).to_pylist()]
                sizes = np.array([len(c) for c in own])
                row = np.repeat(np.arange(len(own)), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                value = np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64)
                if known is not None:
                    at = np.flatnonzero((known.value[(value % FILTER_BITS) >> 6] >> (value % 64)) & 1)
                    row, place, value = row[at], place[at], value[at]
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[row]), pa.array(value), pa.array(place.astype(np.int32))], ["_class", "value", "t"])

    return prints.select("_class", "codes").mapInArrow(run, schema)


def _marked(index: DataFrame) -> np.ndarray:
    """A hashed bit set of the values of the index: at most 16 MB, whatever their number.

    It only spares the shuffle of values that no query holds; a join follows.
    """
    at = F.shiftright(F.pmod(F.col("value"), F.lit(FILTER_BITS)), 6).cast("int").alias("at")
    bits = index.select(at, F.expr("shiftleft(1L, cast(pmod(value, 64) as int))").alias("bit"))
    found = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out


def bit_errors(own: np.ndarray, query: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlap in codes and the share of wrong bits when place t of the query meets place t + offset."""
    a, b = max(0, offset), min(len(own), len(query) + offset)
    if b <= a:
        return 0, 1.0
    wrong = int(np.bitwise_count(own[a:b] ^ query[a - offset : b - offset]).sum())
    return b - a, wrong / (32 * (b - a))


def _verified(pairs: DataFrame) -> DataFrame:
    """The best offset of every pair that passes: by votes, then the nearest to 0, then the later one."""
    schema = "_class bigint, _query bigint, offset int, votes bigint, overlap int, bit_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(i).to_pylist() for i in range(5))
            for own, query, offered, a, b in zip(*columns, strict=True):
                a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                for o in sorted(offered, key=lambda o: (-o["votes"], abs(o["offset"]), -o["offset"])):
                    n, wrong = bit_errors(a, b, o["offset"])
                    if n >= MIN_OVERLAP and wrong <= MAX_ERROR:
                        out.append((own, query, o["offset"], o["votes"], n, wrong))
                        break
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return pairs.select("_class", "_query", "_offers", "_own", "_codes").mapInArrow(run, schema)


def _aligned(classes: DataFrame) -> DataFrame:
    """``_class, _query, offset, votes, overlap, bit_error``: every pair of a class and another class with a query that aligns."""
    coded = classes.filter("length(codes) > 0")
    asked = coded.filter("_query is not null")
    index = cut_lineage(_placed(asked).select(F.col("_class").alias("_of"), "value", F.col("t").alias("_at")))
    hits = _placed(coded, _marked(index)).join(index, "value").filter("_of <> _class")
    votes = hits.groupBy("_class", "_of", (F.col("t") - F.col("_at")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    offers = votes.filter(F.col("votes") >= MIN_VOTES).groupBy("_class", "_of").agg(F.collect_list(F.struct("votes", "offset")).alias("_offers"))
    pairs = offers.join(coded.select("_class", F.col("codes").alias("_own")), "_class").join(
        asked.select(F.col("_class").alias("_of"), "_query", F.col("codes").alias("_codes")), "_of"
    )
    return _verified(pairs)


def align(recordings: DataFrame, audio: str, every: int = 100) -> DataFrame:
    """Fingerprint all ``recordings`` (``doc_id`` and a binary column) and align them with the queries.

    Queries are the rows whose doc_id is divisible by ``every``.  One row per
    row: ``doc_id, n_frames, n_codes, fingerprint`` (8 hex digits a code),
    ``class_id`` (smallest doc_id with an equal fingerprint), ``query_id``
    (smallest query doc_id of the own class) and the other query class that
    aligns best: ``match_id`` (its smallest query doc_id), ``offset`` in codes,
    ``votes``, ``overlap`` and ``bit_error``; null where no other class aligns
    over ``MIN_OVERLAP`` codes within ``MAX_ERROR``.  ``matches`` has all query
    classes that align, by ``match_id``, each with its best offset.  Rows
    too short for a code share a class if all their samples are equal (a query
    among them is their ``query_id``) and align with no other class; null
    recordings are classes of their own; null ids are no queries; repeated rows
    share a class; other columns are ignored.
    """
    named = recordings.select(F.col("doc_id").cast("bigint").alias("doc_id"), audio).withColumn("_row", F.monotonically_increasing_id())
    named = named.withColumn("_samples", F.when(F.length(audio) < SHORTEST, F.xxhash64(audio, F.lit(6))))
    prints = fingerprints(named, audio)
    own = F.when(F.length("codes") > 0, F.xxhash64("codes")).otherwise(F.coalesce("_samples", F.xxhash64("_row", F.lit(5))))
    prints = cut_lineage(prints.withColumn("_class", own))
    query = F.when(F.col("doc_id") % every == 0, F.col("doc_id"))
    classes = prints.groupBy("_class").agg(F.min("doc_id").alias("class_id"), F.min(query).alias("_query"), F.first("codes").alias("codes"))
    classes = cut_lineage(classes)
    match = F.struct(F.col("_query").alias("match_id"), "offset", "votes", "overlap", "bit_error")
    rank = F.struct("votes", -F.abs("offset"), "offset", -F.col("_query"))
    found = _aligned(classes).groupBy("_class").agg(F.max_by(match, rank).alias("_best"), F.sort_array(F.collect_list(match)).alias("matches"))
    judged = classes.select("_class", "class_id", F.col("_query").alias("query_id")).join(found, "_class", "left")
    return prints.join(judged, "_class").select(
        "doc_id",
        "n_frames",
        F.expr("cast(length(codes) div 4 as int)").alias("n_codes"),
        F.lower(F.hex("codes")).alias("fingerprint"),
        "class_id",
        "query_id",
        "_best.*",
        F.coalesce("matches", F.array().cast("array<struct<match_id: bigint, offset: int, votes: bigint, overlap: int, bit_error: double>>")).alias("matches"),
    )
