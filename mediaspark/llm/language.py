"""Language ID (6): unigram piece models that sum over all segmentations.

Every language has its own probabilities for the pieces of one fixed public
vocabulary.  The likelihood of a word is the sum over all ways to cut it into
pieces, computed by the forward algorithm; words are independent, so a text
scores the sum of its words' log likelihoods and every distinct word is scored
once per task while it is remembered.  Probabilities are learned by
expectation maximisation over the same lattice, on at most ``per_lang``
labelled documents of each language in expectation (the documented bound of
the training sample); the E step is a Spark job over distinct words.

Words are runs of letters in lower case; runs over ``SEGMENT`` letters are cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .names import all_of

MARK = "▁"
RUN = re.compile(r"[^\W\d_]+")
SEGMENT = 30
PER_LANG = 1000
ROUNDS = 3
UNKNOWN = 1e-7
SPARE = -2 * np.log(UNKNOWN)  # two letters outside the vocabulary are free
KNOWN = 200_000
BASE = np.uint64(0x100000001B3)
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def piece_list(model_path: str) -> list[str]:
    """All lower-case letter pieces of the vocabulary, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = set()
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        body = p.removeprefix(MARK)
        if body.isalpha() and body == body.lower():
            out.add(p)
    return sorted(out)


def segments(word: str) -> list[str]:
    """Parts of at most SEGMENT letters; the first carries the word mark."""
    if not word.isalpha():
        word = "".join(c for c in word if c.isalpha())
    if not word:
        return []
    word = MARK + word
    return [word[i : i + SEGMENT] for i in range(0, len(word), SEGMENT)]


class Lattice:
    """Finds the pieces of many words at once."""

    def __init__(self, pieces: list[str]):
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.longest = max(map(len, pieces), default=1)
        for size in range(1, self.longest + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == size]
            codes = np.array([[ord(c) for c in pieces[i]] for i in own], np.uint64).reshape(len(own), size)
            value = np.zeros(len(own), np.uint64)
            for k in range(size):
                value = value * BASE + codes[:, k]
            order = np.argsort(value)
            self.tables.append((value[order], np.array(own, np.int64)[order]))
        self.unknown = len(pieces)  # the row of a letter that is no piece
        self.absent = len(pieces) + 1  # the row of probability 0

    def arcs(self, words: list[str]) -> list[list[np.ndarray]]:
        """For words of one length: ``arcs[start][size - 1]`` has each word's piece there."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
        out: list[list[np.ndarray]] = []
        for start in range(n):
            value, row = np.zeros(len(words), np.uint64), []
            for size in range(1, min(self.longest, n - start) + 1):
                value = value * BASE + codes[:, start + size - 1]
                keys, ids = self.tables[size - 1]
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                    found = np.where(keys[at] == value, ids[at], self.unknown if size == 1 else self.absent)
                else:
                    found = np.full(len(words), self.unknown if size == 1 else self.absent)
                row.append(found)
            out.append(row)
        return out

    def forward(self, arcs: list[list[np.ndarray]], p: np.ndarray) -> list[np.ndarray]:
        n = len(arcs)
        a = [np.ones((len(arcs[0][0]), p.shape[1]))] + [np.zeros((len(arcs[0][0]), p.shape[1])) for _ in range(n)]
        for start in range(n):
            for k, ids in enumerate(arcs[start]):
                a[start + k + 1] += a[start] * p[ids]
        return a

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of every piece under one language's probabilities."""
        out = np.zeros(len(p))
        column = p[:, None]
        for at in same_length(words):
            group, n = [words[i] for i in at], len(words[at[0]])
            arcs = self.arcs(group)
            a = [x[:, 0] for x in self.forward(arcs, column)]
            b = [np.zeros(len(group)) for _ in range(n)] + [np.ones(len(group))]
            for start in range(n - 1, -1, -1):
                for k, ids in enumerate(arcs[start]):
                    b[start] += p[ids] * b[start + k + 1]
            weight = counts[at] / a[n]
            for start in range(n):
                for k, ids in enumerate(arcs[start]):
                    out += np.bincount(ids, weight * a[start] * p[ids] * b[start + k + 1], len(p))
        return out

    def log_likelihood(self, words: list[str], p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), p.shape[1]))
        for at in same_length(words):
            out[at] = np.log(self.forward(self.arcs([words[i] for i in at]), p)[-1])
        return out


def same_length(words: list[str]) -> Iterator[np.ndarray]:
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield from (at[i : i + 20_000] for i in range(0, len(at), 20_000))


class Model:
    """Languages in order, the piece list and one probability per piece and language."""

    def __init__(self, langs: list[str], pieces: list[str], p: np.ndarray):
        self.langs, self.pieces, self.p = langs, pieces, p


def normalised(counts: np.ndarray, smooth: float = 0.1) -> np.ndarray:
    """Probabilities with the two extra rows: a letter that is no piece, and no piece at all."""
    p = (counts + smooth) / (counts.sum(axis=0) + smooth * len(counts))
    return np.vstack([p, np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))])


def _sample(labelled: DataFrame, per_lang: int | None) -> tuple[list[str], DataFrame]:
    """Languages in order, and about ``per_lang`` rows ``doc_id, text, lang`` of each (None: all)."""
    rows = labelled.dropna(subset=["doc_id", "text", "lang"]).select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if per_lang is None:
        return langs, rows
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_003)) / 1_000_003
    return langs, rows.filter(draw < share[F.col("lang")]) if langs else rows


def fit(labelled: DataFrame, model_path: str, per_lang: int | None = PER_LANG, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from ``doc_id, text, lang`` rows (rows with a null are left out)."""
    langs, sample = _sample(labelled, per_lang)
    pieces = piece_list(model_path)
    if not langs:
        return Model([], pieces, np.zeros((len(pieces) + 2, 0)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tables.setdefault(lang, Counter()).update(RUN.findall(text.lower()))
            out = [(lang, s, n) for lang, t in tables.items() for w, n in t.items() for s in segments(w)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    words = sample.select("lang", "text").mapInArrow(split, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words)
    shared = labelled.sparkSession.sparkContext.broadcast
    p = normalised(np.ones((len(pieces), len(langs))))
    for _ in range(rounds):
        known = shared((langs, pieces, p))

        def expect(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            langs, pieces, p = known.value
            lattice, total = Lattice(pieces), np.zeros((len(pieces) + 2, len(langs)))
            for b in batches:
                lang = np.array(b.column(0).to_pylist())
                text, n = b.column(1).to_pylist(), b.column(2).to_numpy().astype(float)
                for k in np.unique(lang):
                    at, i = np.flatnonzero(lang == k), langs.index(k)
                    total[:, i] += lattice.expected([text[j] for j in at], n[at], p[:, i])
            piece, i = np.nonzero(total[: len(pieces)])
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(i, pa.int32()), pa.array(total[piece, i])], ["piece", "lang", "n"])

        counts = np.zeros((len(pieces), len(langs)))
        # at most pieces x languages rows, whatever the corpus
        for r in words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():
            counts[r[0], r[1]] = r[2]
        p = normalised(counts)
        known.unpersist()
    return Model(langs, pieces, p)


class Scorer:
    """Scores texts; remembers a bounded number of words."""

    def __init__(self, model: Model, known: int = KNOWN):
        self.model, self.lattice, self.most = model, Lattice(model.pieces), known
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)))
        self.letters = np.zeros(0, np.int64)

    def learn(self, tables: list[Counter]) -> None:
        if len(self.row) > self.most:
            self.reset()
        new = [w for w in set().union(*tables) if w not in self.row]
        parts = [segments(w) for w in new]
        flat = [s for x in parts for s in x]
        sizes = np.array([len(x) for x in parts], np.int64)
        own = np.zeros((len(new), len(self.model.langs)))
        if flat:
            np.add.at(own, np.repeat(np.arange(len(new)), sizes), self.lattice.log_likelihood(flat, self.model.p))
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        self.scores = np.vstack([self.scores, own])
        self.letters = np.concatenate([self.letters, [sum(map(str.isalpha, w)) for w in new]]).astype(np.int64)

    def predict(self, table: Counter) -> tuple[str, float, float | None]:
        """Language, its share, and its log likelihood per letter with ``SPARE`` for odd letters (null without a letter)."""
        at = np.fromiter((self.row[w] for w in table), np.int64, len(table))
        if not self.model.langs or not self.letters[at].any():
            return "und", 0.0, None
        times = np.fromiter(table.values(), float, len(table))
        total = times @ self.scores[at]
        best = float(total.max())
        total -= best
        share = np.exp(total) / np.exp(total).sum()
        return self.model.langs[int(total.argmax())], float(share.max()), (best + SPARE) / float(times @ self.letters[at])


def predict(docs: DataFrame, model: Model, block: int = 256, per_letter: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, and ``per_letter`` if asked for (given columns of such names are replaced).

    A text that is null or has no letter is ``und`` with score 0 and a null
    ``per_letter``; ties go to the first language in order.
    """
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("per_letter", T.DoubleType())][: 3 if per_letter else 2]
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in made}]
    known = docs.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.p))
    at = kept.index("text")
    # columns travel under plain names, so any name passes through
    plain = docs.select(*all_of(kept)).toDF(*(f"c{i}" for i in range(len(kept))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*known.value))
        kinds = [pa.string(), pa.float64(), pa.float64()][: len(made)]
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                tables = [Counter(RUN.findall((t or "").lower())) for t in part.column(at).to_pylist()]
                scorer.learn(tables)
                found = [scorer.predict(t) for t in tables]
                new = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(f.name for f in made)])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *made])).toDF(*kept, *(f.name for f in made))


def floors(labelled: DataFrame, model: Model, per_lang: int | None = PER_LANG) -> dict[str, float]:
    """The least likelihood per letter of each language, from about ``per_lang`` of its labelled documents (None: all).

    It lies as far under the lowest thousandth of them as that lies under their middle.
    """
    found = predict(_sample(labelled, per_lang)[1], model, per_letter=True).filter("lang = lang_pred")
    at = found.groupBy("lang").agg(F.percentile_approx("per_letter", [0.001, 0.5], 10_000).alias("p")).collect()
    return {r.lang: 2 * r.p[0] - r.p[1] for r in at}


def known_language(docs: DataFrame, model: Model, least: dict[str, float]) -> DataFrame:
    """Rows whose text is in one of the model's languages: ``docs`` with ``lang_pred``, ``score`` and ``per_letter``.

    Out go texts that are null or have no letter, and those whose likelihood per
    letter is under the floor of the best language (of no floor: none is in).
    """
    floor = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else F.create_map(F.lit(""), F.lit(0.0))
    return predict(docs, model, per_letter=True).filter(F.col("per_letter") >= floor[F.col("lang_pred")])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model_path: str, per_lang: int = PER_LANG, rounds: int = ROUNDS) -> DataFrame:
    """Fit on the labelled documents outside the held-out quarter and predict every row.

    Returns ``doc_id, held_out, lang_pred, score``.  A null doc_id is never
    trained on and not held out; repeated rows are predicted each.
    """
    model = fit(docs.filter(~held_out()), model_path, per_lang, rounds)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(rows, model).drop("text")
