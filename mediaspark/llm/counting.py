"""Token counts (10): pieces counted once per distinct pre-token.

A SentencePiece model never joins text across the start of a run of spaces
when none of its pieces has a space mark behind another character, which is
checked when the model is loaded.  Such runs therefore cut a text into
pre-tokens whose piece counts add up.  A task keeps the counts of the distinct
pre-tokens it has met, looks up those of each document's frequency table and
sums frequency x pieces; ids are never kept.  The table of known pre-tokens is
bounded and starts anew when full, so memory does not grow with the corpus.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
KNOWN = 300_000
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def pre_tokens(text: str) -> Counter:
    """Frequencies of the pre-tokens, each without the mark it starts with."""
    if not text:
        return Counter()
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return Counter(t[1:] if t != MARK else " " for t in RUNS.findall(MARK + text.replace(" ", MARK)))
    return Counter(text.split(" "))


class PieceCounter:
    """Pieces of single pre-tokens, each counted once while it is remembered."""

    def __init__(self, model_path: str, known: int = KNOWN):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.known: dict[str, int] = {}
        self.most = known
        if any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size())):
            raise ValueError("this model has pieces that reach over a space")

    def learn(self, tables: list[Counter]) -> None:
        if len(self.known) > self.most:
            self.known = {}
        new = [t for t in set().union(*tables) if t not in self.known]
        # a lone space stands for a mark alone; two spaces with the implied one would be one too many
        sizes = map(len, self.model.encode(["" if t == " " else t for t in new], num_threads=1))
        self.known.update((t, 1 if t == " " else n) for t, n in zip(new, sizes, strict=True))

    def total(self, table: Counter) -> int:
        known = self.known
        return sum(known[t] * n for t, n in table.items())


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, block: int = 256) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Null texts count as empty (0 tokens), a null doc_id stays null, repeated
    rows are counted each; other columns of ``docs`` are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                texts = [t or "" for t in part.column(1).to_pylist()]
                tables = [pre_tokens(t) for t in texts]
                counter.learn(tables)
                sizes = [counter.total(t) for t in tables]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([n > limit for n in sizes], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(count, SCHEMA)
