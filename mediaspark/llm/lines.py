"""Line dedup (9): exact set-similarity join of lines.

A line counts as the set of its distinct words; lines without a word are never
removed.  A line is removed if an
earlier line (by doc_id, nulls last, then place) has a Jaccard similarity of
4/5 or more with it, whether or not that line is removed itself.

Lines with equal sets are one class, which is all that lines of fewer than
``MIN_JOINED`` distinct words need.  In classes of longer lines, words are ordered by rarity (counts over
the whole corpus in 2^18 hashed buckets: a fixed size, upper bounds of the
counts).  Two similar sets share a word in their prefixes, the first
n - ceil(4n/5) + 1 words, so classes meet by prefix word; the length filter,
the positional filter and a 64-bit parity map (a word turns one bit, so equal
words cancel and sets differ in no fewer words than their maps in bits) cut
what cannot match, and connected remains become groups whose sets are
compared in full.  Equal groups found under several words are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .names import all_of, unused
from .tiles import Overlaps, components, group_ids, outermost, runs, tiled
from .words import U, Words, blocks, mix, salted

MIN_WORDS = 1
MIN_JOINED = 4  # smaller sets are only similar if they are equal; 4 words inside 5 are at 4/5
BUCKETS = 1 << 18
DENSE = 4096
LARGE = 96
MOST = 2**18 - 1
FILTER_BITS = 1 << 27
LINES = 1 << 22
PARTS = 64  # rows that the word counts of a task are sent in


def _ranks(counts: DataFrame) -> np.ndarray:
    """Ranks, rarest first, of the ``BUCKETS`` hashed buckets by their counts, ``_part, _counts`` (2 MB, whatever the corpus)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n.tobytes() for n in total.values()], pa.binary())], ["_part", "_counts"])

    out = np.zeros((PARTS, BUCKETS // PARTS), np.int64)
    found = counts.repartition("_part").mapInArrow(summed, "_part int, _counts binary").toArrow()
    for part, raw in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[part] = np.frombuffer(raw, np.int64)
    ranks = np.empty(BUCKETS, U)
    ranks[np.argsort(out.ravel(), kind="stable")] = np.arange(BUCKETS, dtype=U)
    return ranks


def word_ranks(rows: DataFrame, read: DataFrame | None = None) -> np.ndarray:
    """Ranks of the hashed buckets over all texts of ``rows``, from ``read`` if they have been read."""
    read = _read(rows) if read is None else read
    return _ranks(read.filter("_part is not null").select("_part", "_counts"))


class LineSets:
    """Distinct words of every line of a block of texts, lines of too few words left out.

    ``row`` and ``line`` name the lines, ``first`` has the places where the
    words of a line begin in ``word``; words ascend by the ``rank`` of their bucket (if given) and hash.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rank: np.ndarray | None = None, least: int = MIN_WORDS):
        words = self.words = Words(data, offsets)
        breaks = np.flatnonzero(data == 10)
        line = words.doc + np.searchsorted(breaks, words.start)  # a new number for every line of every text
        head = np.arange(len(offsets) - 1) + np.searchsorted(breaks, offsets[:-1])
        # one sort key: the line (if under 2^22 in a block), the rank of the word's bucket, more bits of the word
        bucket = (words.hash >> U(46)).astype(np.int64)
        by = (rank if rank is not None else np.arange(BUCKETS, dtype=U))[bucket] if len(bucket) else bucket.astype(U)
        inside = (by << U(24)) | ((words.hash >> U(22)) & U(0xFFFFFF))
        many = len(line) and int(line[-1]) >= LINES
        order = np.lexsort((inside, line)) if many else np.argsort((line.astype(U) << U(42)) | inside)
        word, line, doc = words.hash[order], line[order], words.doc[order]
        keep = np.ones(len(word), bool)
        keep[1:] = (word[1:] != word[:-1]) | (line[1:] != line[:-1])
        word, line, doc = word[keep], line[keep], doc[keep]
        size = np.bincount(line, minlength=1)[line] if len(line) else line
        keep = size >= least
        word, line, doc = word[keep], line[keep], doc[keep]
        start = np.ones(len(line), bool)
        start[1:] = line[1:] != line[:-1]
        at = np.flatnonzero(start)
        self.word, self.row = word, doc[at]
        self.line = line[at] - head[doc[at]]
        self.first = np.append(at, len(word))
        self.size = np.diff(self.first)

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first[:-1]) if len(self.row) else np.zeros(0, values.dtype)

    def classes(self) -> np.ndarray:
        """One value per set of words."""
        return mix(self.total(salted(self.word, 3)) ^ salted(self.size.astype(U), 4)).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_row", F.monotonically_increasing_id())


def _read(rows: DataFrame) -> DataFrame:
    """``_class, _doc, _row, _line`` of every line that may be removed; ``_doc`` orders null ids last.

    The texts are only split once for this, so a task's counts of the hashed
    buckets of all words come along, in rows that have ``_part, _counts``.
    """
    schema = "_class bigint, _doc bigint, _row bigint, _line int, _part int, _counts binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part, data, offsets in blocks(batches, 1):
            sets = LineSets(data, offsets)
            total += np.bincount((sets.words.hash >> U(46)).astype(np.int64), minlength=BUCKETS)
            doc = part.column(2).fill_null(2**63 - 1).to_numpy()
            row = part.column(0).to_numpy()
            own = [sets.classes(), doc[sets.row], row[sets.row], sets.line.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in own), *(pa.nulls(len(own[0]), k) for k in kinds[4:])], names)
        parts = total.reshape(PARTS, -1)
        at = np.flatnonzero(parts.any(axis=1))
        sent = [pa.array(at, pa.int32()), pa.array([parts[p].tobytes() for p in at], pa.binary())]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), k) for k in kinds[:4]), *sent], names)

    return rows.select("_row", "text", "doc_id").mapInArrow(run, schema)


def _prefixes(rows: DataFrame, rank: np.ndarray) -> DataFrame:
    """``_key, _class, _map0, _map1``: prefix words of the classes; a task sends an equal line of a block once.

    A key is 32 bits of the word, the size (18 bits) and the place (14 bits);
    what does not fit is set so that the filters let it pass.  The second half
    of the parity map is only used for larger sets, else it is 0 and packs well.
    """
    schema = "_key bigint, _class bigint, _map0 bigint, _map1 bigint"
    known = rows.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for _, data, offsets in blocks(batches, 0):
            sets = LineSets(data, offsets, known.value, MIN_JOINED)
            own = sets.classes()
            bit = salted(sets.word, 6)
            upper = (bit & U(64) != 0) & (np.repeat(sets.size, sets.size) >= LARGE)
            bit = U(1) << (bit & U(63))
            maps = [np.bitwise_xor.reduceat(np.where(part, bit, U(0)), sets.first[:-1]) if len(own) else np.zeros(0, U) for part in (~upper, upper)]
            _, at = np.unique(own, return_index=True)
            at = at[~np.isin(own[at], seen)]
            seen = np.union1d(seen, own[at]) if len(seen) < 500_000 else np.sort(own[at])
            count = sets.size[at] - -(-4 * sets.size[at] // 5) + 1
            spread = np.repeat(at, count)
            place = np.arange(len(spread)) - np.repeat(np.cumsum(count) - count, count)
            word = sets.word[sets.first[spread] + place] >> U(32)
            size = np.minimum(sets.size[spread], MOST)
            place = np.where(size == MOST, 0, np.minimum(place, 2**14 - 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(((word << U(32)) | (size.astype(U) << U(14)) | place.astype(U)).view(np.int64)),
                    pa.array(own[spread]),
                    pa.array(maps[0][spread].view(np.int64)),
                    pa.array(maps[1][spread].view(np.int64)),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    return rows.select("text").mapInArrow(run, schema)


def _candidates(prefixes: DataFrame) -> DataFrame:
    """``_gid, _size, _class``: groups of classes that pass the filters."""
    schema = "_gid bigint, _size bigint, _class bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in runs(batches, 1, shift=32):
            key, own, low, high = (table.column(i).to_numpy() for i in range(4))
            tied = np.flatnonzero(key[1:] == key[:-1])
            if len(tied):  # rows of one key come in any order
                tied = np.union1d(tied, tied + 1)
                order = np.arange(len(key))
                order[tied] = tied[np.lexsort((own[tied], key[tied]))]
                own, low, high = own[order], low[order], high[order]
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
            key, own, low, high = key[keep], own[keep], low[keep].view(U), high[keep].view(U)
            word, n, place = key >> 32, (key >> 14) & MOST, key & (2**14 - 1)
            large = n >= LARGE
            folded = low ^ high
            if not len(word):
                continue
            size = np.diff(np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(word)))
            dense = np.repeat(size > DENSE, size)
            edges_a, edges_b = [], []
            live, lag = np.arange(len(word) - 1), 1
            while len(live):
                live = live[live + lag < len(word)]
                other = live + lag
                ok = (word[live] == word[other]) & (5 * n[live] >= 4 * n[other])
                live, other = live[ok], other[ok]
                both = n[live] + n[other]
                room = 1 + np.minimum(n[live] - 1 - place[live], n[other] - 1 - place[other])
                full = large[live] & large[other]  # else both maps are read as one half
                differ = np.where(
                    full,
                    np.bitwise_count(low[live] ^ low[other]).astype(np.int64) + np.bitwise_count(high[live] ^ high[other]),
                    np.bitwise_count(folded[live] ^ folded[other]),
                )
                fits = (9 * room >= 4 * both) & (9 * differ <= both)
                fits |= dense[live]  # a crowded word: neighbours in length stay together, tiles compare them
                edges_a.append(live[fits])
                edges_b.append(other[fits])
                live = live[~dense[live]]
                lag += 1
            label = components(len(word), np.concatenate(edges_a or [live]), np.concatenate(edges_b or [live]))
            places, gid, count = group_ids(own, label)
            yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(count), pa.array(own[places])], ["_gid", "_size", "_class"])

    shuffled = prefixes.repartition(F.shiftrightunsigned("_key", 32)).sortWithinPartitions("_key")
    return shuffled.mapInArrow(run, schema).distinct()


def _marked(wanted: DataFrame) -> np.ndarray:
    """A hashed bit set of the wanted classes: at most 16 MB, whatever their number.

    It only spares the shuffle of sets that are not wanted; a join follows.
    """
    place = F.pmod(F.col("_class"), F.lit(FILTER_BITS))
    bits = wanted.select(F.shiftright(place, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(pmod(_class, 64) as int))").alias("bit"))
    found = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``_class, _doc, _row, _line, _words`` of the lines that may belong to the wanted classes."""
    schema = "_class bigint, _doc bigint, _row bigint, _line int, _words binary"
    known = rows.sparkSession.sparkContext.broadcast(_marked(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, 1):
            sets = LineSets(data, offsets, least=MIN_JOINED)
            own = sets.classes()
            at = np.flatnonzero((known.value[(own % FILTER_BITS) >> 6] >> (own % 64)) & 1)
            # the first line of a class in a block will do
            _, first = np.unique(own[at], return_index=True)
            doc = part.column(2).fill_null(2**63 - 1).to_numpy()
            order = np.lexsort((sets.line[at], part.column(0).to_numpy()[sets.row[at]], doc[sets.row[at]], own[at]))
            at = at[order][np.unique(own[at][order], return_index=True)[1]] if len(first) < len(at) else at
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own[at]),
                    pa.array(doc[sets.row[at]]),
                    pa.array(part.column(0).to_numpy()[sets.row[at]]),
                    pa.array(sets.line[at].astype(np.int32)),
                    pa.array([sets.word[sets.first[i] : sets.first[i + 1]].tobytes() for i in at], pa.binary()),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    return rows.select("_row", "text", "doc_id").mapInArrow(run, schema)


def _late(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``_class`` of the classes with a similar class that begins earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in runs(batches, 3, 4_000):
            own = table.column("_class").to_numpy()
            tile, side = table.column("_own").to_numpy(), (table.column("_a").to_numpy(), table.column("_b").to_numpy())
            order = np.lexsort((table.column("_line").to_numpy(), table.column("_row").to_numpy(), table.column("_doc").to_numpy()))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = [np.frombuffer(w, U) for w in table.column("_words").to_pylist()]
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                sizes = np.array([len(w) for w in words[a:b]])
                overlaps = Overlaps(np.concatenate(words[a:b]), np.concatenate(([0], np.cumsum(sizes))))
                cross = side[0][a] != side[1][a]
                for i in range(b - a):
                    hits = overlaps.of(i)
                    similar = (9 * hits >= 4 * (sizes + sizes[i])) & (rank[a:b] < rank[a + i])
                    if cross:
                        similar &= tile[a:b] != tile[a + i]
                    if similar.any():
                        out.append(own[a + i])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.array(out, np.int64)))], ["_class"])

    rows = tiled(groups, "_class").join(sets, "_class").repartition("_gid", "_a", "_b").sortWithinPartitions("_gid", "_a", "_b")
    return rows.select("_gid", "_a", "_b", "_own", "_class", "_doc", "_row", "_line", "_words").mapInArrow(run, "_class bigint").distinct()


def _removed(rows: DataFrame) -> DataFrame:
    """``_row, _gone``: the numbers of the lines to remove, for rows that have any."""
    read = cut_lineage(_read(rows))
    lines = read.filter("_part is null").select("_class", "_doc", "_row", "_line")
    prefixes = _prefixes(rows, word_ranks(rows, read))
    groups = cut_lineage(outermost(cut_lineage(_candidates(prefixes))))
    classes = cut_lineage(lines.groupBy("_class").agg(F.min(F.struct("_doc", "_row", "_line")).alias("_first"), F.count(F.lit(1)).alias("_n")))
    wanted = groups.select("_class").distinct()
    firsts = classes.join(wanted, "_class").select("_class", "_first.*")
    late = _late(groups, _sets(rows, wanted).join(firsts, ["_class", "_doc", "_row", "_line"])).withColumn("_late", F.lit(True))
    judged = classes.join(late, "_class", "left").filter("_n > 1 or _late")
    gone = lines.join(judged, "_class").filter(F.coalesce("_late", F.lit(False)) | (F.struct("_doc", "_row", "_line") > F.col("_first")))
    return gone.groupBy("_row").agg(F.sort_array(F.collect_list("_line")).alias("_gone"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` of every row; ``removed`` has line numbers from 0.

    Lines end at 0x0A; a null or empty text has one empty line.  Null and
    repeated ids are kept row by row (rows of one id by their order in the
    table), other columns are ignored.  ``docs`` must be readable again in the
    same order (a table).
    """
    rows = _keyed(docs)
    n = (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    own = rows.select("_row", "doc_id", F.coalesce(n, F.lit(1).cast("bigint")).alias("n_lines"))
    joined = own.join(_removed(rows), "_row", "left")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(gone).cast("bigint").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` (null stays null); no row is dropped."""
    names = docs.columns
    row, gone = unused(names, "_row"), unused(names, "_gone")
    removed = _removed(_keyed(docs)).select(F.col("_row").alias(row), F.col("_gone").alias(gone))
    joined = docs.withColumn(row, F.monotonically_increasing_id()).join(removed, row, "left")
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(*all_of(names))


ORACLE = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS body FROM split),
worded AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))) AS words FROM numbered),
sets AS (SELECT *, dense_rank() OVER (ORDER BY words) AS c FROM worded WHERE len(words) >= 1),
firsts AS (SELECT c, any_value(words) AS words, len(any_value(words)) AS n, min((doc_id, line)) AS pos FROM sets GROUP BY c),
tokens AS (SELECT c, n, pos, unnest(words) AS word FROM firsts),
shared AS (
  SELECT x.c AS late, y.c AS early, any_value(x.n) AS nx, any_value(y.n) AS ny, count(*) AS hits
  FROM tokens x JOIN tokens y ON x.word = y.word AND y.pos < x.pos AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
  GROUP BY x.c, y.c),
late AS (SELECT DISTINCT late AS c FROM shared WHERE 9 * hits >= 4 * (nx + ny)),
gone AS (
  SELECT s.doc_id, s.line FROM sets s JOIN firsts f ON s.c = f.c
  WHERE (s.doc_id, s.line) > f.pos OR s.c IN (SELECT c FROM late)),
listed AS (SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.parts)::BIGINT AS n_lines, coalesce(l.n, 0)::BIGINT AS n_removed, coalesce(l.removed, '') AS removed
FROM split d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""
