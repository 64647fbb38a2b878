"""Spelling variants beside brute force."""

import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from mediaspark.llm import variants

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
SMALL = str.maketrans(variants.UPPER, variants.LOWER)


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_group(counts):
    """Rows by comparing words that agree after one letter is taken out."""
    bucket = defaultdict(set)
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            bucket[key].add(w)
    near = defaultdict(set)
    for group in bucket.values():
        for a in group:
            near[a] |= {b for b in group if one_apart(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form and counts[root] > 0:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(rows, key=str)


def brute_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_rows(spark, docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_group(brute_counts(rows))
    assert len(want) > 100 and collected(variants.variants_of(docs)) == want
    assert variants.variants_of(nothing).count() == 0


def test_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_group(brute_counts([(r.doc_id, r.text) for r in docs.collect()]))
    assert sum(r[1] is not None for r in want) > 20
    assert collected(variants.variants_of(docs)) == want


def test_cut_subtrees(spark):
    """Tiny bounds: subtrees are cut at every depth, leaves are tiled and visitors are dealt to several tasks."""
    words = {a + b + c + d: 1 + (len(a) * 7 + ord(d)) % 40 for a in ("er", "re", "on", "ß") for b in ("on", "no", "er", "") for c in ("stein", "niest", "ab") for d in "abcxyzé"}
    words |= {"x" * 500: 9, "x" * 501: 30, "x" * 499 + "y": 2, "": 4, "q": 9}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert collected(variants.group_variants(table, subtree=5, visitors=7)) == brute_group(words)


def test_nulls_repeats_and_chains(spark):
    rows = [(None, 5), ("aaaaa", 1), ("aaaab", 1), ("aaaab", 1), ("aaabb", 4), ("aabbb", 8), ("zzzzz", None)]
    got = {r[0]: r for r in collected(variants.group_variants(spark.createDataFrame(rows, "word string, n long")))}
    assert set(got) == {"aaaaa", "aaaab", "aaabb", "aabbb", "zzzzz"}
    assert got["aaaaa"][1:] == ("aaaab", "aabbb", 1, 1, 2) and got["zzzzz"] == ("zzzzz", None, "zzzzz", 0, 0, None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé", min_size=0, max_size=7), unique=True, max_size=60))
def test_subtree_finds_all(words):
    if words:
        a, b = variants.Subtree(words).near(words)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if one_apart(x, y)]
