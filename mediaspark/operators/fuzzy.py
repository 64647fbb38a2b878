"""Trigram word similarity (C6) and the rule when it is used.

Own definition: words get two blanks before and one after; the score is the
best share of the search's distinct trigrams found in a run of neighbouring
words of the text no longer than the search has words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_query, search_text, tokens
from ..scale import top_k

THRESHOLD = 0.35
CANDIDATES = 240
SEARCHES = 200_000  # in one pass over the texts
QUERY_BLOCK = 256
BLOCKS_KEPT = 16
WORDS = 60_000  # of texts scored at once
CELLS = 4_000_000  # masks of words x searches at once
SEEDED = 0.1  # share of words that may start a search's runs before all runs are scored


def fuzzy_queries(queries: DataFrame) -> DataFrame:
    """Searches fit for fuzzy matching: 4 to 40 characters, at most four words."""
    norm = normalize_query("text")
    return (
        queries.select("q", norm.alias("norm"))
        .filter(F.char_length("norm").between(4, 40) & (F.size(F.split("norm", " ")) <= 4))
        .select("q", tokens("norm").alias("words"))
        .filter(F.size("words") > 0)
    )


def trigrams(word: str) -> set[str]:
    padded = f"  {word} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def _codes(words: list[str], pad: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all words as numbers, and the word of each; ``pad`` 0 takes the words as they are."""
    padded = [f"  {w} " for w in words] if pad else words
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(padded)), size - 2)
    at = np.arange(len(word)) + 2 * word
    return word, (points[at] << 42) | (points[at + 1] << 21) | points[at + 2]


class _Block:
    """A block of searches as bit masks: bit i of search j is its i-th trigram.

    A search has at most 41 distinct trigrams, so a mask fits 64 bits.
    """

    def __init__(self, rows: list[tuple[int, list[str]]]) -> None:
        self.ids = np.array([q for q, _ in rows])
        self.runs = np.array([len(w) for _, w in rows])
        grams = [sorted(set().union(*map(trigrams, words))) for _, words in rows]
        self.sizes = np.array(list(map(len, grams)))
        self.grams = np.unique(_codes([g for own in grams for g in own], 0)[1])
        row = dict(zip(self.grams.tolist(), range(len(self.grams))))
        # searches and bits of each trigram, trigram by trigram
        held = sorted((row[code], j, i) for j, own in enumerate(grams) for i, code in enumerate(_codes(own, 0)[1].tolist()))
        rows, self.cols, place = np.array(held, np.int64).reshape(-1, 3).T
        self.bits = np.uint64(1) << place.astype(np.uint64)
        self.count = np.bincount(rows, minlength=len(self.grams))
        self.start = np.cumsum(self.count) - self.count

    def masks(self, words: list[str], coded: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Trigrams of each search that each word has: one row per word; ``coded`` are the words' ``_codes``."""
        word, codes = coded or _codes(words)
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        some = self.grams[at] == codes
        held = np.sort(word[some] * len(self.grams) + at[some])
        word, flat = np.divmod(held[np.diff(held, prepend=-1) != 0], len(self.grams))
        reps = self.count[flat]
        place = np.arange(int(reps.sum())) + np.repeat(self.start[flat] - (np.cumsum(reps) - reps), reps)
        out = np.zeros((len(words), len(self.ids)), np.uint64)
        # the bits of a word's trigrams differ, so their sum is their union
        np.add.at(out.reshape(-1), np.repeat(word, reps) * len(self.ids) + self.cols[place], self.bits[place])
        return out

    def found(self, masks: np.ndarray, words: np.ndarray, item: np.ndarray, first: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, searches and best shares of all pairs that reach the search's ``least`` share.

        ``words`` are rows of ``masks``, ``item`` the item of each word, ``first`` where items begin (none is empty).
        A run that holds ``need`` trigrams has a word with its part of them: only runs around such words are
        scored, or all runs for searches with many such words.
        """
        need = np.maximum(1, np.ceil(least * self.sizes - 1e-6).astype(np.int64))
        seed = np.bitwise_count(masks) >= -(-need // self.runs)
        often = np.bincount(words, minlength=len(masks)).astype(np.float32) @ seed.astype(np.float32)
        many = often > SEEDED * len(words)
        share = self.scores(masks, words, item, first, np.flatnonzero(many))
        i, j = np.nonzero(share >= np.where(many, least, 2.0))
        out = [(i, j, share[i, j])]
        for run in np.unique(self.runs[~many]):
            of_run = np.flatnonzero((self.runs == run) & ~many)
            step = max(1, CELLS // max(1, int(often[of_run].max())))
            for k in range(0, len(of_run), step):
                i, j, hit = self._around(masks, words, item, seed, need, int(run), of_run[k : k + step])
                at = np.round(hit / self.sizes[j], 9)
                good = at >= least[j]
                out.append((i[good], j[good], at[good]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _around(self, masks, words, item, seed, need, run: int, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, searches and most trigrams in a run around a seed, where they are as many as needed."""
        word, col = np.nonzero(seed[:, cols])
        count = np.bincount(word, minlength=len(masks))
        reps = count[words]
        at = np.repeat(np.arange(len(words)), reps)
        j = cols[col[np.arange(len(at)) + np.repeat((np.cumsum(count) - count)[words] - (np.cumsum(reps) - reps), reps)]]

        flat = np.append(masks, np.zeros(len(self.ids), np.uint64))

        def mask(shift: int) -> np.ndarray:
            # beyond its item a word's neighbour is the row of no trigrams
            near = np.full(len(words), len(masks))
            to, of = (slice(0, max(0, len(words) - shift)), slice(shift, None)) if shift >= 0 else (slice(-shift, None), slice(0, max(0, len(words) + shift)))
            near[to] = np.where(item[to] == item[of], words[of], len(masks))
            return flat[near[at] * len(self.ids) + j]

        own = [mask(shift) for shift in range(1 - run, run)]
        most = np.zeros(len(at), np.int64)
        for k in range(run):
            most = np.maximum(most, np.bitwise_count(reduce(np.bitwise_or, own[k : k + run])))
        good = most >= need[j]
        pair, most = item[at[good]] * len(self.ids) + j[good], most[good]
        order = np.lexsort((most, pair))
        last = np.flatnonzero(np.diff(pair[order], append=-1))
        pair, most = pair[order][last], most[order][last]
        return pair // len(self.ids), pair % len(self.ids), most

    def scores(self, masks: np.ndarray, words: np.ndarray, item: np.ndarray, first: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Best share of each of ``some`` searches in a run of neighbouring words: one row per item."""
        out = np.zeros((len(first), len(self.ids)))
        step = max(1, CELLS // len(words))
        for run in np.unique(self.runs[some]):
            of_run = some[self.runs[some] == run]
            for k in range(0, len(of_run), step):
                cols = of_run[k : k + step]
                own = masks[:, cols]
                joined = own[words]
                for shift in range(1, min(int(run), len(words))):
                    same = (item[shift:] == item[:-shift])[:, None]
                    joined[:-shift] |= np.where(same, own[words[shift:]], np.uint64(0))
                out[:, cols] = np.maximum.reduceat(np.bitwise_count(joined), first, axis=0) / self.sizes[cols]
        return np.round(out, 9)


class _Least:
    """The share that an item must reach to be among the best of each search of a block, as far as a task has read."""

    def __init__(self, searches: int, threshold: float, best: int | None) -> None:
        self.share, self.best = np.full(searches, threshold), best
        self.held: list[np.ndarray] = [np.zeros(0)] * searches

    def add(self, j: np.ndarray, share: np.ndarray) -> None:
        if self.best is None or not len(j):
            return
        order = np.argsort(j, kind="stable")
        j, share = j[order], share[order]
        first = np.flatnonzero(np.diff(j, prepend=-1))
        for a, z in zip(first, [*first[1:], len(j)]):
            held = np.concatenate([self.held[j[a]], share[a:z]])
            if len(held) >= self.best:
                held = np.partition(held, len(held) - self.best)[len(held) - self.best :]
                self.share[j[a]] = held[0]
            self.held[j[a]] = held


def fuzzy_scores(items: DataFrame, queries: DataFrame, threshold: float = THRESHOLD, best: int | None = None) -> DataFrame:
    """``q, id, score`` of every pair at or above the threshold, or at least of the ``best`` ones of each search.

    The stated searches (40 characters each at most) travel to the texts, up to
    ``SEARCHES`` of them in one pass; a task scores them in blocks.  A batch of
    texts is coded by its distinct words, a word's masks are made once for a
    block, and runs of words are joined and counted for all texts at once.
    Where only the ``best`` items count, a task leaves out items below as many
    that it has read.  Texts are never shuffled.
    """
    texts = items.select("id", tokens(search_text()).alias("words")).filter("size(words) > 0")
    asked: list[tuple[int, list[str]]] = []
    found = []

    def score(rows: list[tuple[int, list[str]]]) -> DataFrame:
        stated = items.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = stated.value
            parts = [every[k : k + QUERY_BLOCK] for k in range(0, len(every), QUERY_BLOCK)]
            kept = [_Block(p) for p in parts[:BLOCKS_KEPT]]
            least = [_Least(len(p), threshold, best) for p in parts]
            for ids, words, vocabulary, first in _pieces(batches):
                item = np.repeat(np.arange(len(first)), np.diff(first, append=len(words)))
                coded = _codes(vocabulary)
                for k, part in enumerate(parts):
                    block = kept[k] if k < len(kept) else _Block(part)
                    i, j, share = block.found(block.masks(vocabulary, coded), words, item, first, least[k].share)
                    least[k].add(j, share)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(block.ids[j]), ids.take(pa.array(i)), pa.array(share)], ["q", "id", "score"])

        return texts.mapInArrow(run, "q bigint, id bigint, score double")

    for r in fuzzy_queries(queries).toLocalIterator():
        asked.append((r.q, list(r.words)))
        if len(asked) == SEARCHES:
            found.append(score(asked))
            asked = []
    if asked:
        found.append(score(asked))
    none = items.sparkSession.createDataFrame([], "q bigint, id bigint, score double")
    return reduce(DataFrame.unionByName, found) if found else none


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[str], np.ndarray]]:
    """Whole items of about ``WORDS`` words: ids, words as numbers, the distinct words, where items begin."""
    for batch in batches:
        offsets = np.asarray(batch.column(1).offsets)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WORDS, "right")) - 1)
            coded = batch.column(1).slice(at, to - at).flatten().dictionary_encode()
            yield batch.column(0).slice(at, to - at), coded.indices.to_numpy(), coded.dictionary.to_pylist(), offsets[at:to] - offsets[at]
            at = to


def fuzzy_match(items: DataFrame, queries: DataFrame, limit: int = CANDIDATES, threshold: float = THRESHOLD) -> DataFrame:
    """``q, id, score, r``: best ``limit`` items per search, ties by id descending."""
    return top_k(fuzzy_scores(items, queries, threshold, limit), ["q"], [F.desc("score"), F.desc("id")], limit, "r")


def fuzzy_gate(fuzzy: DataFrame, exact: DataFrame, minimum: int = 20) -> DataFrame:
    """Keep the fuzzy list only of searches with fewer than ``minimum`` exact hits."""
    enough = exact.groupBy("q").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)
    return fuzzy.join(enough, "q", "left_anti")
