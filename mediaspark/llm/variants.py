"""Spelling variants (12): a trie of letter-group counts, searched with a budget of one surplus and one deficit.

A word's counts of ``GROUPS`` letter groups are its path in a trie.  One
inserted, deleted or replaced code point adds at most one to one count and
takes at most one from another, so the near words of a word lie on paths that
spend a surplus of one and a deficit of one at most.

The top of the trie is walked by Spark: four counts at a time a word is sent
to every subtree it can reach, subtrees of over ``SUBTREE`` words are cut four
counts further down, and a subtree with many visitors is read by several
tasks.  Inside a task one subtree is held as numpy arrays and its visitors are
streamed through a depth-first search in pieces of bounded size.  At a leaf
the lengths are known; one of two near words' halves is equal, so a leaf is
looked up by the hash of each half and what is found is verified letter by
letter.  No two words are compared because of their path alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import broadcast_if_small, salted_lookup
from ..session import cut_lineage
from .words import U, mix

#: letters of one level each, the telling ones first; the last level counts all other code points
GROUPS = ("e", "a", "i", "n", "t", "o", "r", "s", "h", "l", "du", "cm", "gw", "bfy", "kpv")
LEVELS = len(GROUPS) + 1
STRIDE = 4
DEPTHS = tuple(range(STRIDE, LEVELS + 1, STRIDE))
SUBTREE = 32_768
VISITORS = 400_000
PIECE = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"([a-zÀ-ÿ]+)"
CUT_EACH = 97


def planted_counts(docs: DataFrame, least_length: int = 5, least: int = 3) -> DataFrame:
    """``word, n`` of the letter runs of whole texts, where a run whose crc32 with its document's id divides by 97 lost one code point.

    Null texts have no runs, a null doc_id is written as nothing.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(1))).alias("run"),
    )
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % CUT_EACH == 0, cut).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


# the top of the trie


def _counts() -> Column:
    """Letter counts of ``word`` by level."""
    known = [F.length("word") - F.length(F.translate("word", g, "")) for g in GROUPS]
    rest = F.length(F.translate("word", "".join(GROUPS), ""))
    return F.array(*[c.cast("int") for c in known], rest.cast("int"))


def _key(counts: Column) -> Column:
    """64 bits of a path; paths of different length are told apart as well."""
    return F.xxhash64(counts)


def _moves() -> Column:
    """All changes of ``STRIDE`` counts within the budget: (changes, surplus spent, deficit spent)."""
    zero = [0] * STRIDE
    out = [(zero, 0, 0)]
    for i in range(STRIDE):
        out.append(([*zero[:i], 1, *zero[i + 1 :]], 1, 0))
        out.append(([*zero[:i], -1, *zero[i + 1 :]], 0, 1))
        out += [([(k == i) - (k == j) for k in range(STRIDE)], 1, 1) for j in range(STRIDE) if j != i]
    return F.array(*[F.struct(F.array(*map(F.lit, d)).alias("d"), F.lit(p).alias("p"), F.lit(m).alias("m")) for d, p, m in out])


def _hot(words: DataFrame, subtree: int) -> list[DataFrame]:
    """Prefixes of over ``subtree`` words at every depth but the last: at most words / subtree of them each."""
    return [
        broadcast_if_small(words.groupBy(_key(F.slice("v", 1, d)).alias("_k")).count().filter(F.col("count") > subtree).select("_k", F.lit(True).alias("_deep")))
        for d in DEPTHS[:-1]
    ]


def _homes(words: DataFrame, hot: list[DataFrame]) -> DataFrame:
    """``words`` with the path ``key`` of the subtree that holds each."""
    out = words.withColumn("key", F.lit(None).cast("bigint"))
    for d, deep in zip(DEPTHS, [*hot, None], strict=True):
        own = _key(F.slice("v", 1, d))
        if deep is None:
            return out.withColumn("key", F.coalesce("key", own))
        out = out.withColumn("_k", F.when(F.col("key").isNull(), own)).join(deep, "_k", "left")
        out = out.withColumn("key", F.coalesce("key", F.when(F.col("_deep").isNull(), F.col("_k")))).drop("_k", "_deep")
    return out


def _visits(words: DataFrame, hot: list[DataFrame], carried: str = "word") -> DataFrame:
    """``carried, key`` of every subtree that a word can reach within the budget."""
    out = words.selectExpr(carried, "v", "1 AS plus", "1 AS minus", "cast(array() AS array<int>) AS path", "cast(null AS bigint) AS key")
    stay = F.filter(_moves(), lambda m: (m["p"] + m["m"]) == 0)
    for k, deep in enumerate([*hot, None]):
        moves = F.filter(_moves(), lambda m: (m["p"] <= F.col("plus")) & (m["m"] <= F.col("minus"))) if k else _moves()
        out = out.withColumn("move", F.explode(F.when(F.col("key").isNull(), moves).otherwise(stay) if k else moves))
        step = F.zip_with(F.slice("v", k * STRIDE + 1, STRIDE), F.col("move")["d"], lambda a, b: a + b)
        out = out.select(carried, "v", (F.col("plus") - F.col("move")["p"]).alias("plus"), (F.col("minus") - F.col("move")["m"]).alias("minus"), F.when(F.col("key").isNull(), F.concat("path", step)).otherwise(F.col("path")).alias("path"), "key")
        out = out.filter(F.array_min("path") >= 0)
        own = _key(F.col("path"))
        if deep is None:
            return out.select(carried, F.coalesce("key", own).alias("key"))
        out = out.withColumn("_k", F.when(F.col("key").isNull(), own)).join(deep, "_k", "left")
        out = out.withColumn("key", F.coalesce("key", F.when(F.col("_deep").isNull(), F.col("_k")))).drop("_k", "_deep")
    return out


# one subtree


class Letters:
    """Words end to end as code points, with hashes of any part of a word."""

    BASE = U(0x9E3779B97F4A7C15)

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.size) - self.size
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        power = np.multiply.accumulate(np.full(int(self.size.max(initial=0)) + 1, self.BASE, U)) * U(0xF1357AEA2E62A9C5)
        inside = np.arange(len(self.points)) - np.repeat(self.first, self.size)
        self.power, value = power, mix(self.points.astype(U) + U(1)) * power[inside]
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(value, dtype=U)))

    def counts(self) -> np.ndarray:
        level = np.full(0x110000, LEVELS - 1, np.int64)
        for k, g in enumerate(GROUPS):
            level[list(map(ord, g))] = k
        word = np.repeat(np.arange(len(self.size)), self.size)
        return np.bincount(word * LEVELS + level[self.points], minlength=len(self.size) * LEVELS).reshape(-1, LEVELS)

    def part(self, i: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of code points a to b of words ``i``, equal for equal parts wherever they stand."""
        at = self.first[i]
        total = self.sums[at + b] - self.sums[at + a]
        return mix(total * _inverse_powers(self.BASE, a))


def _inverse_powers(base: np.uint64, n: np.ndarray) -> np.ndarray:
    one = U(pow(int(base), -1, 2**64))
    table = np.concatenate((np.ones(1, U), np.multiply.accumulate(np.full(int(n.max(initial=0)), one, U))))
    return table[n]


class Subtree:
    """The trie of a block of words."""

    SHIFT = 30

    def __init__(self, words: list[str]):
        self.words, self.letters = words, Letters(words)
        counts = self.letters.counts()
        node = np.zeros(len(words), np.int64)
        self.edges = []
        for level in range(LEVELS):
            edges, node = np.unique((node << self.SHIFT) | counts[:, level], return_inverse=True)
            self.edges.append(edges)
        everyone, size = np.arange(len(words)), self.letters.size
        half = size // 2
        self.by_half = []
        for head in (True, False):
            a, b = (np.zeros_like(half), half) if head else (half, size)
            found = mix(self.letters.part(everyone, a, b) ^ mix(node.astype(U) + U(head)))
            order = np.argsort(found)
            self.by_half.append((found[order], order))

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places (in ``words``, in the subtree) of all pairs that are one code point apart."""
        own = Letters(words)
        counts = own.counts()
        start = np.arange(len(words))
        stack = [(0, start, np.zeros_like(start), np.ones(len(start), np.int8), np.ones(len(start), np.int8))]
        out = [(start[:0], start[:0])]
        while stack:  # the deepest piece first
            level, q, node, plus, minus = stack.pop()
            if len(q) > PIECE:
                stack += [(level, *(x[k : k + PIECE] for x in (q, node, plus, minus))) for k in range(0, len(q), PIECE)]
            elif level == LEVELS:
                out.append(self._leaf(own, q, node))
            else:
                edges, grown = self.edges[level], []
                for d in (0, 1, -1):
                    may = np.arange(len(q)) if d == 0 else np.flatnonzero(plus if d > 0 else minus)
                    goal = (node[may] << self.SHIFT) | (counts[q[may], level] + d)
                    at = np.minimum(np.searchsorted(edges, goal), len(edges) - 1)
                    has = edges[at] == goal  # a count under zero meets no edge of its node: bits of the node change
                    has &= counts[q[may], level] + d >= 0
                    may = may[has]
                    grown.append((q[may], at[has], plus[may] - (d > 0), minus[may] - (d < 0)))
                stack.append((level + 1, *(np.concatenate(x) for x in zip(*grown, strict=True))))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return a, b

    def _leaf(self, own: Letters, q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(q):
            return q, node
        # all words of a leaf have one length
        if not hasattr(self, "leaf_size"):
            counts = self.letters.counts()
            path = np.zeros(len(self.words), np.int64)
            for level in range(LEVELS):
                path = np.searchsorted(self.edges[level], (path << self.SHIFT) | counts[:, level])
            self.leaf_size = np.zeros(len(self.edges[-1]), np.int64)
            self.leaf_size[path] = self.letters.size
        length, goal = own.size[q], self.leaf_size[node]
        half = goal // 2
        pairs = []
        for head in (True, False):
            a, b = (np.zeros_like(half), half) if head else (np.maximum(length - (goal - half), 0), length)
            keys, order = self.by_half[not head]
            want = mix(own.part(q, a, b) ^ mix(node.astype(U) + U(head)))
            lo, hi = np.searchsorted(keys, want), np.searchsorted(keys, want, "right")
            n = hi - lo
            ends = np.cumsum(n)
            at = np.repeat(lo - ends + n, n) + np.arange(int(ends[-1]))
            pairs.append((np.repeat(q, n), order[at]))
        left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
        both = np.unique(left * len(self.words) + right)
        left, right = both // len(self.words), both % len(self.words)
        one = self._one_apart(own, left, right)
        return left[one], right[one]

    def _one_apart(self, own: Letters, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether exactly one code point is inserted, deleted or replaced."""
        index = self.letters
        n, m = own.size[left], index.size[right]
        short = np.minimum(n, m)
        a, b = own.first[left], index.first[right]
        head = np.zeros(len(left), np.int64)
        tail = np.zeros(len(left), np.int64)
        for count, from_start in ((head, True), (tail, False)):
            live = np.arange(len(left))
            k = 0
            while len(live):
                live = live[short[live] > k]
                i, j = (a[live] + k, b[live] + k) if from_start else ((a + n)[live] - 1 - k, (b + m)[live] - 1 - k)
                live = live[own.points[i] == index.points[j]]
                count[live] += 1
                k += 1
        return np.where(n == m, head + tail == n - 1, (np.abs(n - m) == 1) & (head + tail >= short))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, n, word`` sorted by key, those of the subtree (n given) before its visitors (n null)."""
    key, held, counts, tree = None, [], [], None
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            keys, words, n = part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(1).to_pylist()
            i = 0
            while i < len(keys):
                if keys[i] != key:
                    key, held, counts, tree = keys[i], [], [], None
                j = i
                visitor = n[i] is None
                while j < len(keys) and keys[j] == key and (n[j] is None) == visitor:
                    j += 1
                if not visitor:
                    held += words[i:j]
                    counts += n[i:j]
                elif held:
                    tree = tree or Subtree(held)
                    left, right = tree.near(words[i:j])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[i + k] for k in left.tolist()], pa.string()), pa.array([held[k] for k in right.tolist()], pa.string()), pa.array([counts[k] for k in right.tolist()], pa.int64())],
                        ["word", "near", "near_n"],
                    )
                i = j


def near_pairs(words: DataFrame, subtree: int = SUBTREE, visitors: int = VISITORS) -> DataFrame:
    """``word, near, near_n`` for every word and each word one code point away; ``words`` has distinct ``word`` and its ``n``."""
    own = words.select("word", "n", _counts().alias("v"))
    hot = _hot(own, subtree)
    homes, visits = _homes(own, hot).select("word", "n", "key"), _visits(own, hot)
    sizes = homes.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    # words of one path reach the same subtrees
    paths = own.groupBy("v").agg(F.count(F.lit(1)).alias("words"))
    reach = _visits(paths, hot, "words").groupBy("key").agg(F.sum("words").alias("seen"))
    parts = sizes.join(reach, "key").select("key", F.ceil(F.col("held") / subtree).cast("int").alias("tiles"), F.ceil(F.col("seen") / visitors).cast("int").alias("parts"))
    parts = broadcast_if_small(cut_lineage(parts))

    def fan(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own_part(n: str) -> Column:
        return F.pmod(F.xxhash64("word"), F.col(n)).cast("int")

    inside = homes.join(parts, "key").withColumn("tile", own_part("tiles")).withColumn("part", fan("parts"))
    asked = visits.join(parts, "key").withColumn("part", own_part("parts")).withColumn("tile", fan("tiles")).withColumn("n", F.lit(None).cast("bigint"))
    rows = inside.select("key", "tile", "part", "n", "word").unionByName(asked.select("key", "tile", "part", "n", "word"))
    rows = rows.select(F.xxhash64("key", "tile", "part").alias("key"), F.col("n").cast("bigint").alias("n"), "word")
    dealt = rows.repartition("key").sortWithinPartitions("key", F.col("n").asc_nulls_last())
    return dealt.mapInArrow(_search, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: forms are followed to the last, in steps that double."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(salted_lookup(at, step, ["root"], spread="word").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        at = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return at


def group_variants(words: DataFrame, subtree: int = SUBTREE, visitors: int = VISITORS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word.

    ``words`` has ``word`` and ``n``; null words are left out, repeated ones are added up, a null n is 0.
    Two words are near if exactly one code point is inserted, deleted or replaced.  A word's form is
    its near word of largest n (then the smallest word), if that is at least twice its own n; its
    root is the last of the chain of forms, or the word itself.
    """
    whole = words.filter("word is not null").groupBy("word").agg(F.sum(F.coalesce(F.col("n").cast("bigint"), F.lit(0))).alias("n"))
    words = cut_lineage(whole)
    pairs = near_pairs(words, subtree, visitors)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best")["less"] >= 2 * F.col("n")
    forms = cut_lineage(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best")["near"]).alias("form"),
            F.when(is_form, -F.col("best")["less"]).alias("form_n"),
        )
    )
    linked = forms.filter("form is not null")
    return forms.join(_roots(linked), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants_of(docs: DataFrame) -> DataFrame:
    """``group_variants`` of the words of whole texts with planted cuts (see ``planted_counts``).  Nulls, repeated rows and other columns: as there."""
    return group_variants(planted_counts(docs)).select("word", "form", "root", "n", "n_near", "form_n")
