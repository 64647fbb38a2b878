"""N-gram Jaccard join (4): chosen paths over word shingles.

A document is the set of its 5-word shingles (a text of 1 to 4 words is one
shingle).  Documents with equal sets are one class and only classes are joined.

Every class samples tokens by hash, the same token for all who have it: about
``STARTS`` of them begin a path each (as many independent runs of the chosen
path recursion at once).  Classes on the same path form a bucket.  A bucket of
more than ``BUCKET`` members is split again (for members with fewer than
``ENOUGH`` other runs, or with all but a fifth of a small set in such buckets;
the others find their partners there): its members extend the path by
about ``BRANCH`` tokens sampled under that path, until buckets are small, or
so alike on average that splitting cannot help, or ``DEPTH`` is reached.  For
a pair at the threshold about 0.8 x STARTS first tokens are shared and each
survives the splits with a chance of at least 0.68, so a pair is missed with a
chance below e^(-11), the target recall.  Buckets are compared in full, large
ones in tiles; none is dropped or capped.

Inside a bucket, members can only be similar if their sizes allow it and the
128-bit maps of their samples differ in few places (five standard deviations
over what a pair of these sizes at the threshold shows, each sample at its own
rate); connected remains become groups.
Groups inside another are dropped, and a pair of classes that shares several
groups counts in the first only, so links are exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import connected
from .names import all_of, unused
from .tiles import Overlaps, components, group_ids, outermost, runs, tiled
from .words import U, Words, blocks, lists, mix, salted, sets, windows

SHINGLE = 5
STARTS = 24
SAMPLE = 48
BRANCH = 2
BUCKET = 256
DEPTH = 3
ENOUGH = 16
ALIKE = 0.5
DENSE = 4096
FILTER_BITS = 1 << 27


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_row", F.monotonically_increasing_id())


def _tokens(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle tokens of a block of texts, ascending in a text, the places where texts begin, and the class of each text."""
    value, doc, _ = windows(Words(data, offsets), shingle, short=True)
    token, first = sets(salted(value, 21), doc, len(ids))
    size = np.diff(first)
    total = np.zeros(len(ids), U)
    np.add.at(total, np.repeat(np.arange(len(ids)), size), salted(token, 22))
    own = mix(total ^ salted(size.astype(U), 23))
    own[size == 0] = salted(ids[size == 0].astype(U), 24)  # rows without words are alone
    return token, first, own


def _sampled(rows: DataFrame, shingle: int) -> DataFrame:
    """``_row, _doc, _class, _n, _sample, _map0, _map1``; samples ascend by their sampling hash."""
    schema = "_row bigint, _doc bigint, _class bigint, _n int, _sample array<bigint>, _map0 bigint, _map1 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, 1):
            ids = part.column(0).to_numpy()
            token, first, own = _tokens(ids, data, offsets, shingle)
            size = np.diff(first)
            row = np.repeat(np.arange(part.num_rows), size)
            # tokens ascend in a row, so a sample is a head of the row
            keep = token < np.array([2**64 - 1 if n <= SAMPLE else 2**64 // int(n) * SAMPLE for n in size.tolist()], U)[row] if len(token) else np.zeros(0, bool)
            chosen, at = token[keep], row[keep]
            bit = salted(chosen, 25) & U(127)
            maps = np.zeros((2, part.num_rows), U)
            for k in range(2):
                of = (bit >> U(6)) == k
                np.bitwise_or.at(maps[k], at[of], U(1) << (bit[of] & U(63)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2).fill_null(2**63 - 1),
                    pa.array(own.view(np.int64)),
                    pa.array(size.astype(np.int32)),
                    lists(chosen.view(np.int64), np.searchsorted(at, np.arange(part.num_rows + 1)), pa.int64()),
                    pa.array(maps[0].view(np.int64)),
                    pa.array(maps[1].view(np.int64)),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    return rows.select("_row", "text", "doc_id").mapInArrow(run, schema)


def _share(value: Column) -> Column:
    """A signed hash as a place in 0..1."""
    return F.shiftrightunsigned(value, 1) / float(2**63)


def _place(token: Column) -> Column:
    """A token, an unsigned value kept as signed, as a place in 0..1."""
    return F.when(token < 0, token / float(2**64) + 1).otherwise(token / float(2**64))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of paths with at least two members, with the member count."""
    size = rows.groupBy("_path").agg(F.count(F.lit(1)).alias("_members")).filter("_members > 1")
    return rows.join(size, "_path")


def _leaves(classes: DataFrame) -> DataFrame:
    """``_path, _class`` of all final buckets."""
    # a token is kept among the starts if its place in the hash range is below STARTS / n
    tokens = classes.filter("_n > 0").select("_class", "_n", F.explode("_sample").alias("_t"))
    rows = tokens.filter((F.col("_n") <= STARTS) | (_place(F.col("_t")) * F.col("_n") < STARTS)).select(F.col("_t").alias("_path"), "_class")
    done = []
    for depth in range(DEPTH + 1):
        rows = cut_lineage(_counted(rows))
        done.append(rows.filter(F.col("_members") <= BUCKET).select("_path", "_class"))
        large = rows.filter(F.col("_members") > BUCKET)
        if depth == 0:
            # runs that end in small buckets already give the recall of most classes; the others follow their large ones
            hot = large.groupBy("_class").agg(F.count(F.lit(1)).alias("_hot"))
            starts = F.when(F.col("_n") <= STARTS, F.col("_n")).otherwise(F.size(F.filter("_sample", lambda t: _place(t) * F.col("_n") < STARTS)))
            few = F.when(F.col("_n") <= STARTS, F.col("_hot") * 5 >= F.col("_n") * 4).otherwise(starts - F.col("_hot") < ENOUGH)
            needy = classes.select("_class", "_n", "_sample").join(hot, "_class").filter(few).select("_class")
            large = cut_lineage(large.join(needy, "_class", "left_semi"))
        if depth == DEPTH or large.isEmpty():
            done.append(large.select("_path", "_class"))
            break
        large = large.join(classes.select("_class", "_sample"), "_class")
        # how often two members have the same least token under the path, about their likeness: a sum over tokens, not over pairs
        probe = large.select("_path", F.array_min(F.transform("_sample", lambda t: F.xxhash64(t, F.col("_path")))).alias("_t"))
        met = probe.groupBy("_path", "_t").agg(F.count(F.lit(1)).alias("_k"))
        alike = met.groupBy("_path").agg((F.sum(F.col("_k") * F.col("_k")) / F.sum("_k") / F.sum("_k")).alias("_alike"))
        large = cut_lineage(large.join(alike, "_path").select("_path", "_class", "_alike"))
        done.append(large.filter(F.col("_alike") >= ALIKE).select("_path", "_class"))
        chosen = F.filter("_sample", lambda t: _share(F.xxhash64(t, F.col("_path"))) * F.size("_sample") < BRANCH)
        large = large.filter(F.col("_alike") < ALIKE).join(classes.select("_class", "_sample"), "_class")
        rows = large.select("_class", "_path", F.explode(chosen).alias("_t")).select(F.xxhash64("_path", "_t").alias("_path"), "_class")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _groups(leaves: DataFrame, classes: DataFrame) -> DataFrame:
    """``_gid, _size, _class``: connected remains of the buckets after the size and map filters."""
    schema = "_gid bigint, _size bigint, _class bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in runs(batches, 1):
            path, n, own, low, high = (table.column(i).to_numpy() for i in range(5))
            n, low, high = n.astype(np.int64), low.view(U), high.view(U)
            size = np.diff(np.append(np.flatnonzero(np.append(True, path[1:] != path[:-1])), len(path)))
            dense = np.repeat(size > DENSE, size)
            a, b = [], []
            live, lag = np.arange(len(path) - 1), 1
            while len(live):
                live = live[live + lag < len(path)]
                other = live + lag
                ok = (path[live] == path[other]) & (5 * n[live] >= 4 * n[other])
                live, other = live[ok], other[ok]
                differ = np.bitwise_count(low[live] ^ low[other]).astype(np.int64) + np.bitwise_count(high[live] ^ high[other])
                # differences of two samples, each at its own rate, of a pair at the threshold; sizes ascend in a path
                fewer, more = n[live], n[other]
                rate = np.minimum(1.0, SAMPLE / more)
                expected = np.minimum(fewer, SAMPLE) + np.minimum(more, SAMPLE) - 8 * (fewer + more) / 9 * rate
                fits = (differ <= expected + 5 * np.sqrt(expected) + 1) | dense[live]
                a.append(live[fits])
                b.append(other[fits])
                live = live[~dense[live]]
                lag += 1
            label = components(len(path), np.concatenate(a or [live]), np.concatenate(b or [live]))
            at, gid, count = group_ids(own, label)
            yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(count), pa.array(own[at])], ["_gid", "_size", "_class"])

    own = classes.select("_class", "_n", "_map0", "_map1")
    rows = leaves.join(own, "_class").select("_path", "_n", "_class", "_map0", "_map1")
    found = rows.repartition("_path").sortWithinPartitions("_path", "_n", "_class").mapInArrow(run, schema).distinct()
    return outermost(cut_lineage(found))


def _marked(wanted: DataFrame) -> np.ndarray:
    """A hashed bit set of the wanted rows: at most 16 MB, whatever their number.

    It only spares the shuffle of sets that are not wanted; a join follows.
    """
    place = F.pmod(F.xxhash64("_row"), F.lit(FILTER_BITS)).alias("place")
    at, bit = F.shiftright("place", 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
    found = wanted.select(place).select(at, bit).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out


def _sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``_class, _row, _tokens`` of the rows that may be wanted: they are left out where the texts are read, so no text is shuffled."""
    known = rows.sparkSession.sparkContext.broadcast(_marked(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = batch.column(2).to_numpy()
                yield batch.filter(pa.array(((known.value[place >> 6] >> (place & 63)) & 1).astype(bool)))

        for part, data, offsets in blocks(asked(), 1):
            token, first, own = _tokens(part.column(0).to_numpy(), data, offsets, shingle)
            found = [token[first[i] : first[i + 1]].tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), part.column(0), pa.array(found, pa.binary())], ["_class", "_row", "_tokens"])

    place = F.pmod(F.xxhash64("_row"), F.lit(FILTER_BITS)).alias("_place")
    return rows.select("_row", "text", place).mapInArrow(run, "_class bigint, _row bigint, _tokens binary")


def _edges(own: np.ndarray, label: np.ndarray, side: np.ndarray, total: np.ndarray) -> list[tuple[int, int, int]]:
    """``_class, _root, _links`` of the members of a pair of tiles with a link.

    The root is the smallest class of the same tile in the connected group, so a
    member mostly keeps it whatever the other tile; one more edge joins the two
    roots.  Edges to one root of both tiles would be as many as members times tiles.
    """
    size = np.bincount(label, minlength=len(label))
    at = np.flatnonzero(size[label] > 1)
    part = 2 * label[at] + side[at]
    order = np.lexsort((own[at], part))
    at, part = at[order], part[order]
    new = np.append(True, part[1:] != part[:-1])[: len(at)]
    head = own[at][np.flatnonzero(new)]
    out = list(zip(own[at].tolist(), head[np.cumsum(new) - 1].tolist(), total[at].tolist(), strict=True))
    of = part[new] >> 1
    both = np.flatnonzero(of[1:] == of[:-1])
    return out + [(a, b, 0) for a, b in zip(head[both + 1].tolist(), head[both].tolist(), strict=True)]


def _links(groups: DataFrame, members: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``_class, _root, _links``: documents linked to a class and an edge to the root of its similar members, per tile pair."""
    schema = "_class bigint, _root bigint, _links bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in runs(batches, 3, 2_000):
            own, gid, tile = (table.column(c).to_numpy() for c in ("_class", "_gid", "_own"))
            left, right, copies = (table.column(c).to_numpy() for c in ("_a", "_b", "_copies"))
            tokens = [np.frombuffer(t, U) for t in table.column("_tokens").to_pylist()]
            listed = [np.array(x, np.int64) for x in table.column("_gids").to_pylist()]
            out: list[tuple[int, int, int]] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                here, m = gid[a], b - a
                # members with the same first group have met there, unless it is this one: sort them side by side
                leader = np.array([x[0] for x in listed[a:b]], np.int64)
                order = np.argsort(leader, kind="stable")
                leader, at = leader[order], order + a
                after = np.searchsorted(leader, leader, "right")
                after = np.where(leader == here, np.arange(m) + 1, after)
                own_tokens, own_groups = [tokens[k] for k in at], [listed[k] for k in at]
                sizes = np.array([len(t) for t in own_tokens])
                overlaps = Overlaps(np.concatenate(own_tokens), np.concatenate(([0], np.cumsum(sizes))))
                shared = Overlaps(np.concatenate(own_groups), np.concatenate(([0], np.cumsum([len(x) for x in own_groups]))))
                cross, weight, side = left[a] != right[a], copies[at], tile[at]
                total = np.zeros(m, np.int64)
                one, two = [], []
                for i in range(m):
                    if after[i] == m:
                        continue
                    others = slice(int(after[i]), m)
                    similar = (num + den) * overlaps.of(i, others) >= num * (sizes[others] + sizes[i])
                    if cross:
                        similar &= side[others] != side[i]
                    found = np.flatnonzero(similar)
                    if not len(found):
                        continue
                    one.append(np.full(len(found), i))
                    two.append(found + others.start)
                    before = int(np.flatnonzero(own_groups[i] == here)[0])
                    if before:  # pairs that share an earlier group were counted there
                        found = found[shared.of(i, others, before)[found] == 0]
                    found = found + others.start
                    total[i] += weight[found].sum()
                    total[found] += weight[i]
                label = components(m, np.concatenate(one or [np.zeros(0, int)]), np.concatenate(two or [np.zeros(0, int)]))
                out += _edges(own[at], label, tile[at] == left[a], total)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], ["_class", "_root", "_links"])

    rows = tiled(groups, "_class").join(members, "_class").repartition("_gid", "_a", "_b").sortWithinPartitions("_gid", "_a", "_b")
    return rows.select("_gid", "_a", "_b", "_own", "_class", "_copies", "_gids", "_tokens").mapInArrow(run, schema)


def similar_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row of ``docs``, with ``_row`` and ``keep``.

    ``n_links`` counts the other rows with a similarity of 4/5 or more (copies
    are links too), ``class_id`` is the smallest doc_id of the connected group
    and ``keep`` marks one row of each group (the first by doc_id, nulls last,
    then row).  Null and empty texts are groups of their own; null ids stay
    null unless another row of the group has one; other columns are ignored.
    ``docs`` must be readable again in the same order (a table).
    """
    rows = _keyed(docs)
    sampled = cut_lineage(_sampled(rows, shingle))
    first = F.min(F.struct("_doc", "_row")).alias("_first")
    once = [F.first(c).alias(c) for c in ("_n", "_sample", "_map0", "_map1")]
    classes = cut_lineage(sampled.groupBy("_class").agg(first, F.count(F.lit(1)).alias("_copies"), *once))
    groups = cut_lineage(_groups(_leaves(classes), classes))
    lists_ = groups.groupBy("_class").agg(F.sort_array(F.collect_list(F.struct(-F.col("_size"), F.col("_gid").alias("g")))).getField("g").alias("_gids"))
    wanted = lists_.join(classes.select("_class", F.col("_first._row").alias("_row"), "_copies"), "_class")
    members = _sets(rows, wanted, shingle).join(wanted, ["_class", "_row"]).drop("_row")
    links = cut_lineage(_links(groups, members))
    counts = links.groupBy("_class").agg(F.sum("_links").alias("_links"))
    named = connected(links.filter("_class <> _root").select(F.col("_class").alias("a"), F.col("_root").alias("b")))
    judged = (
        classes.select("_class", "_first", "_copies")
        .join(counts, "_class", "left")
        .join(named.select(F.col("id").alias("_class"), "comp"), "_class", "left")
        .withColumn("_comp", F.coalesce("comp", "_class"))
    )
    heads = judged.groupBy("_comp").agg(F.min("_first").alias("_head"))
    judged = judged.join(heads, "_comp").select("_class", "_head", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).cast("bigint").alias("n_links"))
    out = sampled.select("_row", "_doc", "_class").join(judged, "_class")
    null = F.lit(2**63 - 1)
    return out.select(
        F.nullif("_doc", null).alias("doc_id"),
        F.nullif("_head._doc", null).alias("class_id"),
        "n_links",
        "_row",
        (F.col("_row") == F.col("_head._row")).alias("keep"),
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of ``docs``, all columns as they are."""
    names = docs.columns
    row = unused(names, "_row")
    kept = similar_documents(docs).filter("keep").select(F.col("_row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").select(*all_of(names))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS hits
  FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 9 * hits >= 4 * (s.n + t.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id,
       (SELECT count(*) FROM links l WHERE l.a = d.doc_id)::BIGINT AS n_links
FROM documents d
"""
