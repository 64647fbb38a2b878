"""Ranked search beside brute force and its SQL."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mediaspark.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=50):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    holders = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in counted:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


ITEMS = [(1, "MarbleM MEADOWMAR copperC"), (2, None), (3, ""), (3, "ñandú straße 漢字"), (None, "saddler saddler ribbonmarb"), (5, "xxxx nothing here"), (6, "changed61 10 rivers stonest"), (1, "MarbleM MEADOWMAR copperC")]


def test_odd_rows(spark, docs, nothing):
    mark = lambda t: re.sub(r"(?<=[a-z])(?=\d)", " ", t) if t else t  # noqa: E731  words that documents share
    table = [(r.doc_id, mark(r.text)) for r in docs.select("doc_id", "text").collect()]
    own = spark.createDataFrame([(d, t, "x", "y") for d, t in table], "doc_id long, text string, rank string, item_id string").repartition(3)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, score int")
    for k in (3, 50):
        want = brute(table, ITEMS, k)
        assert len(want) > 4 * k // 3 and rows(ranking.search(own, items, k)) == want
    assert rows(ranking.search(nothing, items)) == [] and rows(ranking.search(own, items.limit(0))) == []


def test_blocks_of_items(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, f"river stone meadow{i}") for i in range(7)] + [(9, "river42 meadow")], "item_id long, text string")
    whole = rows(ranking.search(docs, items, 4))
    monkeypatch.setattr(ranking, "ITEMS", 3)
    assert rows(ranking.search(docs, items, 4)) == whole


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    own = ranking.search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert rows(own) == sorted(duck.execute(ranking.ORACLE).fetchall(), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 30), st.integers(1, 5))
def test_trees_lose_nothing(seed, n, n_items, k):
    """Any order of blocks and any tree gives the k best of each item."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)]
    items = ranking.Items.of([" ".join(rng.choice(words, rng.integers(0, 6))) for _ in range(n_items)])
    v = len(items.keys)
    if not v:
        return
    worth = rng.integers(0, 50, v)
    dense = rng.integers(0, 9, (n, v)) * (rng.random((n, v)) < 0.3)
    dense[np.arange(n), rng.integers(0, v, n)] = 1
    search = ranking.Search(items, worth, k, np.ones(n_items, np.int64))
    for at in range(0, n, 150):
        block = dense[at : at + 150]
        doc, term = np.nonzero(block)
        search.add(ranking.DocTree(np.arange(at, at + len(block)), np.ones(len(block), bool), np.searchsorted(doc, np.arange(len(block) + 1)), term, block[doc, term], worth))
    for i in range(n_items):
        scores = dense[:, items.of_item(i)] @ worth[items.of_item(i)]
        want = sorted((-s, d) for d, s in enumerate(scores.tolist()) if s > 0)[:k]
        assert [(-s, d) for s, d in zip(search.score[i].tolist(), search.doc[i].tolist(), strict=True) if s > 0] == want


def test_bounds_prune():
    """Of documents that come in like groups most pairs are never scored."""
    rng = np.random.default_rng(3)
    items = ranking.Items.of([f"w{i} w{i + 1} w{i + 2}" for i in range(0, 60, 3)])
    v = len(items.keys)
    place = {int(k): i for i, k in enumerate(items.keys)}
    assert len(place) == v
    worth = np.full(v, 10)
    n = 4000
    group = rng.integers(0, 20, n)
    doc = np.repeat(np.arange(n), 3)
    term = items.terms.reshape(-1, 3)[group].reshape(-1)
    search = ranking.Search(items, worth, 5, np.ones(len(items.first) - 1, np.int64))
    search.add(ranking.DocTree(np.arange(n), np.ones(n, bool), 3 * np.arange(n + 1), term, rng.integers(1, 1000, 3 * n), worth))
    assert search.scored < 0.1 * n * 20


def test_long_sums_are_exact():
    items = ranking.Items.of(["a b"])
    assert ranking.Search(items, np.array([2**40, 1]), 1, np.ones(1, np.int64)).exact is np.int64
    assert pytest.approx(ranking.weight(10, np.array([3]))[0]) == math.floor(1000 * math.log(22 / 7))
