"""Ranked lexical search (11) by two trees: one over the items, one over the documents.

Terms are runs of ASCII letters, digits and all bytes over 0x7F, with A-Z in
lower case.  A first pass over the documents keeps, for the terms of the items
only, each document's term counts and sums up the corpus statistics.  The
second pass searches: every task stacks blocks of documents into a tree whose
nodes hold the largest impact of each term, the items form a tree whose nodes
hold the union of their terms, and the product of two nodes bounds the score
of every pair under them.  A pair of nodes is left as soon as its bound is
under the weakest kth score of the items below; this never loses a result.  A
hashed sixteenth of the documents is searched first and gives the scores that
the rest has to reach.

Items are searched in blocks of bounded size (``ITEMS``, ``ITEM_BYTES``), each
against all documents.  Scores are whole numbers under 2^53 and therefore
exact in the matrix products; a block that could reach that bound is
multiplied in 64-bit integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .words import U, Words, blocks, mix

ITEMS = 2048
ITEM_BYTES = 1_000_000
BLOCK = 4096
LEAF, FAN = 32, 8
ITEM_LEAF = 8
FIRST_PART = 16

VECTORS = "doc_id bigint, n bigint, docs bigint, terms array<int>, times array<int>"
FOUND = "item bigint, doc_id bigint, score bigint"


def term_bytes() -> np.ndarray:
    """Every byte as it stands in a term; bytes outside terms are spaces."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    for a, b in ((0x30, 0x3A), (0x61, 0x7B)):
        table[a:b] = np.arange(a, b)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def term_keys(words: Words) -> np.ndarray:
    """Hash and length of every term in one value."""
    return mix(words.hash ^ (words.end - words.start).astype(U))


def weight(n_docs: int, holders: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * holders + 1))).astype(np.int64)


def impact(times: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one unit of weight gives for a term that stands ``times`` times in a document of ``n`` terms."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


@dataclass
class Items:
    """A block of items: their term numbers, end to end, and the places where items begin."""

    keys: np.ndarray  # sorted keys of all terms; a term's number is its place
    terms: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Items:
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        words = Words(term_bytes()[np.frombuffer(b"".join(raw), np.uint8)], offsets)
        keys, term = np.unique(term_keys(words), return_inverse=True)
        pairs = np.unique(words.doc * (len(keys) + 1) + term)
        item, term = pairs // (len(keys) + 1), pairs % (len(keys) + 1)
        return cls(keys, term, np.searchsorted(item, np.arange(len(texts) + 1)))

    def of_item(self, i: int) -> np.ndarray:
        return self.terms[self.first[i] : self.first[i + 1]]


def vectors(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """Rows ``doc_id, n, terms, times`` of documents that hold a term of ``keys``, and one row with the sums of each task.

    A row of sums has ``docs`` (documents with a term), ``n`` (all terms) and, by term, the documents that hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = term_bytes()
        holders = np.zeros(len(keys), np.int64)
        n_docs = n_terms = 0
        for part, data, offsets in blocks(batches, 1):
            words = Words(table[data], offsets)
            sizes = np.diff(words.first)
            n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + int(sizes.sum())
            if not len(keys):
                continue
            own = term_keys(words)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            known = np.flatnonzero(keys[at] == own)
            pairs, times = np.unique(words.doc[known] * len(keys) + at[known], return_counts=True)
            doc, term = pairs // len(keys), pairs % len(keys)
            holders += np.bincount(term, minlength=len(keys))
            first = np.searchsorted(doc, np.arange(len(sizes) + 1))
            some = np.flatnonzero(np.diff(first))
            edges = pa.array(np.append(first[some], len(doc)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(sizes[some]), pa.nulls(len(some), pa.int64()), *lists], ["doc_id", "n", "docs", "terms", "times"])
        held = np.flatnonzero(holders)
        for k in range(0, max(len(held), 1), 4096):  # documents and terms are told once
            some = held[k : k + 4096]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": [None], "n": [n_terms if k == 0 else 0], "docs": [n_docs if k == 0 else 0], "terms": [some.tolist()], "times": [holders[some].tolist()]},
                pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("docs", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]),
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, VECTORS)


class ItemTree:
    """Items in leaves of about ``ITEM_LEAF`` with common terms; node 0 is the root."""

    def __init__(self, items: Items, worth: np.ndarray):
        self.items, self.worth = items, worth
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        self.terms: list[np.ndarray] = []
        self.grow(np.flatnonzero(np.diff(items.first)))

    def grow(self, members: np.ndarray) -> int:
        node = len(self.members)
        own = [self.items.of_item(i) for i in members]
        self.members.append(members)
        self.children.append([])
        terms = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        self.terms.append(terms)
        if len(members) > ITEM_LEAF:
            # those that share the most weight with one item go to its side
            seed = max(range(len(own)), key=lambda k: int(self.worth[own[k]].sum()))
            mark = np.zeros(len(self.worth), np.int64)
            mark[own[seed]] = self.worth[own[seed]]
            order = np.argsort([-int(mark[t].sum()) for t in own], kind="stable")
            half = len(members) // 2
            self.children[node] = [self.grow(members[order[:half]]), self.grow(members[order[half:]])]
        return node


class DocTree:
    """A block of documents: sparse rows, and the largest impact of each term in every node."""

    def __init__(self, doc_id: np.ndarray, known: np.ndarray, first: np.ndarray, terms: np.ndarray, gain: np.ndarray, worth: np.ndarray):
        # documents whose heaviest term is the same lie together, those of equal impact side by side
        rows = np.repeat(np.arange(len(doc_id)), np.diff(first))
        total = gain * worth[terms]
        top = np.maximum.reduceat(total, first[:-1])
        best = np.full(len(doc_id), len(worth))
        hit = total == top[rows]
        np.minimum.at(best, rows[hit], terms[hit])
        order = np.lexsort((-top, best))
        sizes = np.diff(first)[order]
        self.doc_id, self.known = doc_id[order], known[order]
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(first[:-1][order] - self.first[:-1], sizes) + np.arange(len(terms))
        self.terms, self.gain = terms[at], gain[at]
        n_leaf = -(-len(doc_id) // LEAF)
        leaf = np.repeat(np.arange(len(doc_id)) // LEAF, sizes)
        most = np.zeros((n_leaf, len(worth)), np.int64)
        np.maximum.at(most.reshape(-1), leaf * len(worth) + self.terms, self.gain)
        self.most = [most]
        while len(self.most[-1]) > 1:
            below = self.most[-1]
            self.most.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN)))
        self.held: dict[int, np.ndarray] = {}

    def dense(self, leaf: int) -> np.ndarray:
        """Impacts of the documents of a leaf by term."""
        a, b = leaf * LEAF, min((leaf + 1) * LEAF, len(self.doc_id))
        out = np.zeros((b - a, self.most[0].shape[1]), np.int64)
        lo, hi = self.first[a], self.first[b]
        out[np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1])), self.terms[lo:hi]] = self.gain[lo:hi]
        return out


class Search:
    """The best documents of every item so far, and the search of more blocks."""

    def __init__(self, items: Items, worth: np.ndarray, k: int, reach: np.ndarray):
        """``reach``: scores that a result of each item must have at least (1 without knowledge)."""
        self.tree, self.worth, self.k = ItemTree(items, worth), worth, k
        n = len(items.first) - 1
        self.least = np.maximum(reach, 1)
        self.score = np.zeros((n, k), np.int64)
        self.doc = np.zeros((n, k), np.int64)
        self.known = np.zeros((n, k), bool)
        self.scored = 0
        most = max((int(worth[items.of_item(i)].sum()) for i in range(n)), default=0)
        self.exact = np.float64 if most * 1_000_000 < 2**53 else np.int64

    def add(self, docs: DocTree) -> None:
        top = len(docs.most) - 1
        stack = [(0, top, 0)]
        while stack:
            node, level, at = stack.pop()
            if not len(self.tree.members[node]):
                continue
            # bound of each pair of children: the documents' side is opened first, then the items'
            if level > 0:
                below = np.arange(at * FAN, min((at + 1) * FAN, len(docs.most[level - 1])))
                opened = [(c, level - 1) for c in ([node] if not self.tree.children[node] else self.tree.children[node])]
            elif self.tree.children[node]:
                below, opened = np.array([at]), [(c, 0) for c in self.tree.children[node]]
            else:
                self.leaf(node, docs, at)
                continue
            found = []
            for child, deep in opened:
                terms = self.tree.terms[child]
                bound = docs.most[deep][np.ix_(below, terms)] @ self.worth[terms]
                weakest = self.least[self.tree.members[child]].min()
                found += [(int(b), child, deep, int(x)) for b, x in zip(bound, below, strict=True) if b >= weakest]
            # the most promising pair is opened next
            stack += [(child, deep, x) for _, child, deep, x in sorted(found)]

    def leaf(self, node: int, docs: DocTree, at: int) -> None:
        items, terms = self.tree.members[node], self.tree.terms[node]
        weights = np.zeros((len(terms), len(items)), self.exact)
        for c, i in enumerate(items):
            own = np.searchsorted(terms, self.tree.items.of_item(i))
            weights[own, c] = self.worth[terms[own]]
        may = docs.most[0][at, terms].astype(self.exact) @ weights >= self.least[items]
        if not may.any():
            return
        items, weights = items[may], weights[:, may]
        scores = (docs.dense(at)[:, terms].astype(self.exact) @ weights).astype(np.int64)
        self.scored += scores.size
        lo = at * LEAF
        for c, i in enumerate(items):
            good = np.flatnonzero(scores[:, c] >= self.least[i])
            if len(good):
                self.offer(i, scores[good, c], docs.doc_id[lo + good], docs.known[lo + good])

    def offer(self, i: int, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        score = np.concatenate((self.score[i], score))
        doc, known = np.concatenate((self.doc[i], doc)), np.concatenate((self.known[i], known))
        best = np.lexsort((doc, ~known, -score))[: self.k]
        self.score[i], self.doc[i], self.known[i] = score[best], doc[best], known[best]
        self.least[i] = max(self.least[i], self.score[i, -1])

    def rows(self) -> pa.RecordBatch:
        item, place = np.nonzero(self.score > 0)
        doc = pa.array(self.doc[item, place], mask=~self.known[item, place])
        return pa.RecordBatch.from_arrays([pa.array(item), doc, pa.array(self.score[item, place])], ["item", "doc_id", "score"])


def _search(held: DataFrame, items: Items, worth: np.ndarray, n_docs: int, n_terms: int, k: int, reach: np.ndarray) -> DataFrame:
    """``item, doc_id, score``: at most k rows of every item from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, worth, k, reach.copy())
        waiting: list[pa.RecordBatch] = []

        def work() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            for at in range(0, table.num_rows, BLOCK):
                part = table.slice(at, BLOCK)
                doc = part.column(0).combine_chunks()
                terms, times = part.column(2).combine_chunks(), part.column(3).combine_chunks()
                n = part.column(1).to_numpy()
                sizes = np.diff(terms.offsets.to_numpy())
                first = np.concatenate(([0], np.cumsum(sizes)))
                gain = impact(times.flatten().to_numpy().astype(np.int64), np.repeat(n, sizes), n_docs, n_terms)
                search.add(DocTree(doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), first, terms.flatten().to_numpy().astype(np.int64), gain, worth))
            waiting.clear()

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BLOCK:
                work()
        if waiting:
            work()
        yield search.rows()

    return held.select("doc_id", "n", "terms", "times").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items ordered by id, in blocks of bounded number and size, one block at a time on the driver."""
    rows = items.selectExpr("cast(item_id as bigint) item_id", "coalesce(text, '') text").orderBy("item_id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        more = len(r.text.encode())
        if block and (len(block) >= ITEMS or size + more > ITEM_BYTES):
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += more
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item with a score above 0.

    Null texts have no terms; equal scores go by doc_id, null ids last; every row
    is a document or an item of its own, so repeated rows are ranked each.  Items
    without terms and empty tables give no rows.  Other columns are not used.
    """
    spark = docs.sparkSession
    out = None
    for block in _item_blocks(items):
        texts = Items.of([t for _, t in block])
        path = f"{shared_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
        vectors(docs, texts.keys).write.parquet(path)
        kept = spark.read.schema(VECTORS).parquet(path)
        sums = kept.filter("docs is not null")
        total = sums.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        holders = np.zeros(len(texts.keys), np.int64)
        # bounded by the terms of a block of items
        for r in sums.select(F.explode(F.arrays_zip("terms", "times")).alias("t")).groupBy("t.terms").agg(F.sum("t.times").alias("n")).collect():
            holders[r["terms"]] = r["n"]
        if not total["n"]:
            continue
        worth = weight(total["docs"], holders)
        held = kept.filter("docs is null").select("*", F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_PART)).alias("part"))
        args = (texts, worth, total["docs"], total["n"], k)
        none = np.ones(len(block), np.int64)
        early = _best(_search(held.filter("part = 0"), *args, none), k)
        early_path = f"{path}-first"
        early.select("item", "doc_id", "score").write.parquet(early_path)
        early = spark.read.schema(FOUND).parquet(early_path)
        # one row per item of the block that already has k results
        for r in early.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).collect():
            none[r["item"]] = r["least"]
        late = _search(held.filter("part <> 0"), *args, none)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item bigint, item_id bigint")
        best = _best(early.unionByName(late), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out


ORACLE = r"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
split AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM low),
sized AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM split WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
counted AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), total),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
