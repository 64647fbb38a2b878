"""Packing, matrices, mixing, audio and the pipeline."""

import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mediaspark.llm import audio, binary, mixing, packing
from mediaspark.llm.tokens import ChunkEncoder, cut_pieces

BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BPE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", "'s", " ", "  ", "\n", "\t", "é", "12", "<|endoftext|>", ".", " ", "½", " \n ", "\0", "漢"]), max_size=14))
def test_chunks_encode_like_the_library(parts):
    text = "".join(parts)
    ids, first = ChunkEncoder(BPE).encode([text, "", text])
    ranks, _ = ChunkEncoder(BPE.replace(".json", ".tiktoken")).encode([text])
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ranks.tolist() == want
    assert ids.tolist() == want * 2 and first.tolist() == [0, len(want), len(want), 2 * len(want)]


def test_pieces_cover_documents():
    for n, c in itertools.product((0, 1, 5, 7, 8, 9, 16, 17, 40), (1, 4, 8)):
        cut = cut_pieces(n, c)
        assert sum(k for _, k in cut) == n and all(s == sum(k for _, k in cut[:i]) for i, (s, _) in enumerate(cut))
        assert all(k == c for _, k in cut[1:]) and cut[0][1] <= c


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_bin_completion_is_optimal_on_small_cases(items):
    bins = packing.complete(items, 30)
    want = fewest(items, 30)
    assert len(bins) == want and sorted(x for b in bins for x in b) == sorted(items) and all(sum(b) <= 30 for b in bins)
    assert packing.lower_bound(np.bincount(items, minlength=31) if items else np.zeros(31, int), 30) <= want


def test_search_beats_best_fit():
    items = [6, 6, 5, 5, 4, 4, 3, 3] * 3 + [7, 7, 2, 2, 1, 1]
    assert len(packing.complete(items, 12)) == -(-sum(items) // 12) <= len(packing.best_fit(sorted(items, reverse=True), 12))
    assert packing.dominated((3, 4), (7,)) and not packing.dominated((5, 4), (6, 3))


def encoded(docs):
    return [(d, [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in docs.select("doc_id", "text").collect()]


def test_packed_documents(docs, nothing):
    got = packing.pack_documents(docs, BPE, capacity=512, block=20).collect()
    ranks = packing.pack_documents(docs, BPE.replace(".json", ".tiktoken"), capacity=512, block=20).collect()
    assert sorted(map(str, (r[:5] for r in ranks))) == sorted(map(str, (r[:5] for r in got)))
    want = Counter()
    for d, ids in encoded(docs):
        for k, (s, n) in enumerate(cut_pieces(len(ids), 512)):
            want[d, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in rows.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 512
    assert len(rows) <= -(-sum(r.length for r in got) // 512) + 3
    assert packing.pack_documents(nothing, BPE).count() == 0


def test_pack_keeps_other_columns(docs):
    parts = docs.selectExpr("doc_id", "_row", "_block", "cast(1 + coalesce(doc_id, 3) % 9 as bigint) length", "'x' `a.b`", "'mine' sequence_id")
    got = packing.pack(parts, capacity=10)
    assert got.columns == ["doc_id", "_row", "_block", "length", "a.b", "sequence_id", "offset"] and got.count() == docs.count() and {r._row for r in got.collect()} == {"clash"}


def test_matrices_round_trip(docs, nothing):
    packed = binary.packed_matrices(docs, BPE, capacity=256, block_tokens=3000)
    parts = {}
    for r in binary.segments(packed).collect():
        parts.setdefault(r.doc_id, []).append((r.piece, r.ids))
    want = {}
    for d, ids in encoded(docs):
        raw = np.array(ids, "<u2").tobytes()
        want.setdefault(d, []).extend((k, raw[2 * s : 2 * (s + n)]) for k, (s, n) in enumerate(cut_pieces(len(ids), 256)))
    assert {d: Counter(p) for d, p in parts.items()} == {d: Counter(p) for d, p in want.items()}
    for r in packed.collect():
        places, ends = np.frombuffer(r.positions, "<u2"), r.cu_seqlens
        assert len(r.ids) == len(r.positions) == 512 and ends[-1] == r.n_tokens and len(ends) == r.n_segments + 1
        for a, b in itertools.pairwise([*ends, 256]):
            assert places[a:b].tolist() == list(range(b - a))
    assert binary.packed_matrices(nothing, BPE).count() == 0


@given(st.lists(st.integers(1, 40), max_size=40))
@settings(max_examples=60, deadline=None)
def test_room_tree_is_best_fit(sizes):
    rows = binary.best_fit_decreasing(np.array(sizes, np.int64), 40)
    free, count = [], 0
    for s in sorted(sizes, reverse=True):
        fit = [f for f in free if f >= s]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - s)
        else:
            free.append(40 - s)
            count += 1
    assert len(rows) == count and sorted(i for r in rows for i in r) == list(range(len(sizes)))


def water(sizes, weights, cap):
    live, target = dict(sizes), {}
    rest, total = sum(sizes.values()), None
    while live:
        total = sum(weights[s] for s in live)
        over = [s for s in live if rest * weights[s] > cap * sizes[s] * total]
        if not over:
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            del live[s]
        rest = sum(sizes.values()) - sum(target.values())
    return target | {s: rest * weights[s] / total for s in live}


def test_mixing_meets_targets(docs, nothing, spark):
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    source = {(d, s) for d, s in docs.select("doc_id", "source").collect()}
    totals = {}
    for r in docs.selectExpr("source", "size(regexp_extract_all(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)) n").collect():
        totals[r.source] = totals.get(r.source, 0) + r.n
    names = sorted((s for s in totals if s is not None), key=lambda s: s) + [None]
    want = water(totals, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 3)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        own = {s for d, s in source if d == r.doc_id}
        if len(own) == 1:
            s = own.pop()
            assert r.source_size == totals[s] and abs(r.target - want[s]) < 1e-6
            taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 20 for s in names)
    assert mixing.mix(nothing).count() == 0
    whole = mixing.repeated(docs)
    assert whole.columns == docs.columns and whole.groupBy("doc_id", "text").count().agg({"count": "max"}).first()[0] <= 6


def test_targets_stop_at_three_times(spark, tmp_path):
    path = str(tmp_path / "caps")
    rows = [(1, "a " * 10, "a"), (2, "b " * 600, "b"), (3, "c " * 600, "c"), (4, None, "d"), (5, "e", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    got = {r.doc_id: r for r in mixing.mix(spark.read.parquet(path)).collect()}
    want = water({"a": 10, "b": 600, "c": 600, "d": 0, None: 1}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, 3)
    assert got[1].target == 30 and got[4].target == 0 and got[5].target == 3 and got[1].taken == 30
    assert abs(got[2].target - want["b"]) < 1e-9 and abs(got[3].target - want["c"]) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1023])
def test_permutations(spark, n):
    from pyspark.sql import functions as F

    got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(3).cast("bigint")).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 100 or sum(a == i for i, a in enumerate(got)) < n // 10)


def test_audio_alignment(spark, docs, nothing, tmp_path):
    rng = np.random.default_rng(4)
    whole = np.cumsum(rng.normal(size=12_000)) * 3 % 256
    other = rng.integers(0, 256, 9_000)
    rows = [(100, whole), (1, whole[32 * 50 :]), (2, whole[8 + 32 * 20 : 9_000]), (3, other), (4, other), (5, other[:200]), (200, other), (6, None), (None, whole[:4_000])]
    path = str(tmp_path / "audio")
    spark.createDataFrame([(d, None if x is None else bytearray(x.astype(np.uint8).tobytes())) for d, x in rows], "doc_id long, audio binary").repartition(2).write.parquet(path)
    got = {r.doc_id: r for r in audio.align(spark.read.parquet(path), "audio").collect()}
    assert (got[1].match_id, got[1].offset, got[1].bit_error) == (100, -50, 0)
    assert got[2].match_id == 100 and got[2].offset == -20 and got[2].bit_error < 0.1
    assert got[3].class_id == got[4].class_id == got[200].class_id == 3 and got[3].match_id is None
    assert got[5].n_codes == got[6].n_codes == 0 and got[5].class_id == 5 and got[6].class_id == 6
    assert got[None].match_id == 100 and got[None].offset == 0
    own = docs.selectExpr("doc_id", "cast(text as binary) audio", "'x' n_frames", "'y' codes")
    assert audio.align(own, "audio").count() == docs.count()
    assert audio.align(nothing.selectExpr("doc_id", "cast(text as binary) audio"), "audio").count() == 0


def test_audio_recall_against_brute_force(spark, docs):
    got = audio.align(docs.selectExpr("doc_id", "cast(text as binary) audio"), "audio", every=20).collect()
    prints = {r.doc_id: np.frombuffer(bytes.fromhex(r.fingerprint), "<u4") for r in got if r.doc_id is not None}
    known = {r.doc_id: r for r in got}
    queries = [d for d in prints if d % 20 == 0 and len(prints[d])]
    there = found = 0
    for d, own in prints.items():
        best = 1.0
        for q in queries:
            if known[q].class_id != known[d].class_id:
                for offset in range(-len(prints[q]) + audio.MIN_OVERLAP, len(own) - audio.MIN_OVERLAP, 1):
                    n, e = audio.bit_errors(own, prints[q], offset)
                    best = min(best, e) if n >= 60 else best
        if best <= 0.1:
            there += 1
            found += known[d].match_id is not None
    assert there > 5 and found >= 0.9 * there


def test_audio_finds_every_query(spark, tmp_path):
    """All queries that share a passage are partners, not only the lowest and the highest id."""
    rng = np.random.default_rng(9)
    shared = np.cumsum(rng.normal(size=8_000)) * 3 % 256
    rows = [(100 * k, np.concatenate((rng.integers(0, 256, 32 * k), shared, rng.integers(0, 256, 320)))) for k in range(1, 7)] + [(1, shared), (2, rng.integers(0, 256, 5_000))]
    path = str(tmp_path / "shared")
    spark.createDataFrame([(d, bytearray(x.astype(np.uint8).tobytes())) for d, x in rows], "doc_id long, audio binary").repartition(3).write.parquet(path)
    got = {r.doc_id: r for r in audio.align(spark.read.parquet(path), "audio").collect()}
    assert [(m.match_id, m.offset) for m in got[1].matches] == [(100 * k, -k) for k in range(1, 7)]
    assert [m.match_id for m in got[300].matches] == [100, 200, 400, 500, 600] and got[300].query_id == 300
    assert got[2].matches == [] and got[2].match_id is None and got[2].query_id is None


def test_audio_recall_per_pair(spark, docs):
    """Every pair with a shared passage, held against brute force over all offsets."""
    got = audio.align(docs.selectExpr("doc_id", "cast(text as binary) audio"), "audio", every=20).collect()
    known = {r.doc_id: r for r in got if r.doc_id is not None}
    prints = {d: np.frombuffer(bytes.fromhex(r.fingerprint), "<u4") for d, r in known.items()}
    there = found = 0
    for d, own in prints.items():
        for q in (q for q in prints if q % 20 == 0 and len(prints[q]) and known[q].class_id != known[d].class_id):
            errors = [audio.bit_errors(own, prints[q], o) for o in range(-len(prints[q]) + audio.MIN_OVERLAP, len(own) - audio.MIN_OVERLAP)]
            if any(n >= 60 and e <= 0.1 for n, e in errors):
                there += 1
                found += known[q].query_id in {m.match_id for m in known[d].matches}
    assert there > 5 and found >= 0.9 * there


def test_short_recordings_meet_their_copies(spark, tmp_path):
    short, brief, none = b"all rights reserved", bytes(range(256)) * 2 + b"x" * 223, b""
    rows = [(100, short), (3, short), (4, short + b"."), (200, brief), (5, brief), (6, brief + b"x"), (7, none), (8, none), (9, None), (10, None)]
    path = str(tmp_path / "short")
    spark.createDataFrame([(d, None if x is None else bytearray(x)) for d, x in rows], "doc_id long, audio binary").repartition(3).write.parquet(path)
    got = {r.doc_id: (r.n_codes, r.class_id, r.query_id) for r in audio.align(spark.read.parquet(path), "audio").collect()}
    assert got[3] == got[100] == (0, 3, 100) and got[4] == (0, 4, None)
    assert got[5] == got[200] == (0, 5, 200) and got[6] == (1, 6, None)
    assert got[7][1] == got[8][1] == 7 and (got[9][1], got[10][1]) == (9, 10)


def test_short_recordings_in_the_recall(spark, docs):
    """Every pair of equal texts of a document and a query, short ones too, shares a class."""
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None and r.text is not None]
    got = {r.doc_id: r for r in audio.align(docs.selectExpr("doc_id", "cast(text as binary) audio"), "audio", every=5).collect() if r.doc_id is not None}
    pairs = [(a, b) for a in rows for b in rows if b.doc_id % 5 == 0 and a.text == b.text]
    assert any(a.doc_id != b.doc_id and len(a.text.encode()) < audio.SHORTEST for a, b in pairs)
    assert all(got[a.doc_id].class_id == got[b.doc_id].class_id and got[a.doc_id].query_id <= b.doc_id for a, b in pairs)
