"""Language ID, fingerprints, substring and line dedup, Jaccard join, counts: brute force on edge cases."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from mediaspark.llm import counting, jaccard, language, lines, sketch, substrings, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def key(row):
    return (row.doc_id is None, row.doc_id or 0)


def test_counts_match_the_library(docs, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((d, len((t or "").encode()), len(model.encode(t or "", num_threads=1))) for d, t in docs.select("doc_id", "text").collect())
    got = counting.count_tokens(docs, PIECES).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert counting.count_tokens(nothing, PIECES).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  ", " a", "a ", "a  b", "▁", "▁▁a b▁", "x\n y", "\n \n", "<s> a</s>b", "a\x00b", "日本 語", "﻿ a", "　a"])
def test_pre_tokens_add_up(text):
    counter = counting.PieceCounter(PIECES)
    table = counting.pre_tokens(text)
    counter.learn([table])
    assert counter.total(table) == len(counter.model.encode(text, num_threads=1))


def test_fingerprints_of_edited_texts(docs, nothing):
    rows = sorted(((d if d is not None else -(2**63), t or "", d) for d, t in docs.select("doc_id", "text").collect()), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for (_, text, doc), (_, other, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 3
        want[doc, after, len(text), hashlib.sha256((text[: len(text) - k] + other[:k]).encode()).hexdigest()] += 1
    got = sketch.edited_fingerprints(docs).collect()
    assert Counter((r.doc_id, r.next_doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = {r.doc_id: r for r in got if r.n_chars > 1500 and r.doc_id != 13}
    assert all(0.5 < r.near_edited < 0.8 for r in long.values() if r.doc_id < 60)
    by_text = {}
    plain = {(r.doc_id, r.fingerprint) for r in sketch.fingerprints(docs).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for r in got}
    for d, t in docs.select("doc_id", "text").collect():
        by_text.setdefault(t or "", set()).update(f for i, f in plain if i == d and d is not None)
    assert all(len(by_text[t]) <= 1 for t in by_text if t.startswith("one"))
    assert sketch.edited_fingerprints(nothing).count() == 0


def test_neighbours_cross_bucket_bounds(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(3000).selectExpr("(id * 7919) % 100003 doc_id", "concat('text ', id) text").write.parquet(path)
    got = {r.doc_id: r.next_doc_id for r in sketch.edited_fingerprints(spark.read.parquet(path)).collect()}
    order = sorted(got, reverse=True)
    assert len(got) == 3000 and all(got[a] == b for a, b in zip(order, order[1:] + order[:1], strict=True))


def test_sketches_estimate_containment():
    words = [f"w{i * i % 7919}" for i in range(6000)]
    whole, part = " ".join(words), " ".join(words[:1500])
    data = [sketch.sketches(*sketch._bytes([t]))[0] for t in (whole, part, "a b c", "")]
    assert data[1].containment(data[0]) > 0.95 and abs(data[0].containment(data[1]) - 0.25) < 0.08
    assert data[0].merged(data[1]).text() == data[0].text()
    assert data[3].containment(data[3]) == 1 and data[2].containment(data[3]) == 0 and data[3].text() == "1:"


def test_language_sums_segmentations():
    pieces = ["a", "ab", "b", "ba"]
    lattice = language.Lattice(pieces)
    p = language.normalised(language.np.array([[4.0], [2.0], [3.0], [1.0]]), 0.0)

    def total(word):
        return 1.0 if not word else sum(p[pieces.index(word[:k]), 0] * total(word[k:]) for k in (1, 2) if k <= len(word) and word[:k] in pieces)

    for word in ("a", "abba", "babab"):
        assert abs(language.np.exp(lattice.log_likelihood([word], p)[0, 0]) - total(word)) < 1e-12
    expected = lattice.expected(["abba"], language.np.array([2.0]), p[:, 0])
    # every segmentation of a word covers all of its letters
    assert abs(sum(expected[i] * len(q) for i, q in enumerate(pieces)) - 8) < 1e-9


def test_language_uses_pieces_of_any_length():
    pieces = sorted(["▁", *"abcdefghijklmnop", "cdefghijk", "▁abcdefghijklmno"])
    lattice = language.Lattice(pieces)
    assert lattice.longest == 16
    flat = language.normalised(language.np.ones((len(pieces), 1)), 0.0)
    raised = flat.copy()
    raised[pieces.index("cdefghijk")] *= 1000
    for word in ("▁abcdefghijkl", "▁acdefghijk"):
        assert lattice.log_likelihood([word], raised)[0, 0] > lattice.log_likelihood([word], flat)[0, 0]
    raised = flat.copy()
    raised[pieces.index("▁abcdefghijklmno")] *= 1000
    assert lattice.log_likelihood(["▁abcdefghijklmnop"], raised)[0, 0] > lattice.log_likelihood(["▁abcdefghijklmnop"], flat)[0, 0]
    assert max(map(len, language.piece_list(PIECES))) == 16


def test_language_rejects_what_was_not_learned(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(table, PIECES, per_lang=80)
    least = language.floors(table, model, per_lang=80)
    assert set(least) == set(model.langs)
    lettered = table.filter("text rlike '[A-Za-zÀ-ÿ]'").count()
    assert language.known_language(table, model, least).count() >= 0.995 * lettered
    other = [
        "Minä olen suomalainen ja puhun kieltä jota harvat ymmärtävät täällä kaukana pohjoisessa maassa",
        "Wszystkie kraje świata mają swoje własne zwyczaje i tradycje kulinarne oraz wspaniałe krajobrazy",
        "Это русский текст о погоде и природе", "qxzv kjwq zzxq vbnm qwrt plkj hgfd wrtz xcvb", "漢字かな混じり文", "1234 ...", "", None,
    ]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(other)], "doc_id long, text string, Lang_Pred string")
    assert language.known_language(rows, model, least).count() == 0
    assert language.known_language(table, model, {}).count() == 0


def test_language_on_held_out_documents(spark, sf, docs, nothing):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    found = language.identify(table, PIECES, per_lang=60).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert len(found) > 20 and right >= 0.95 * len(found)
    model = language.fit(table, PIECES, per_lang=40, rounds=1)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (5, 7, 8))
    assert got[20].lang_pred in model.langs and 0 < got[20].score <= 1 and got[20]._row == "clash"
    assert language.identify(nothing, PIECES).count() == 0


def test_repeated_windows_are_removed(docs, nothing):
    rows = [(d, WORD.findall(t or "")) for d, t in docs.select("doc_id", "text").collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = Counter()
    for d, w in rows:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = substrings.remove_repeats(docs, with_text=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_removed for r in got) > 1000
    assert substrings.remove_repeats(nothing).count() == 0


def test_a_text_that_repeats_itself(spark, tmp_path):
    path = str(tmp_path / "self")
    loop = " ".join(["tick tock"] * 40)
    spark.createDataFrame([(1, loop), (2, "a b"), (3, " ".join(f"u{i}" for i in range(100)))], "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.read.parquet(path)).collect()}
    assert got == {1: (80, 80), 2: (2, 0), 3: (100, 0)}


def brute_lines(rows):
    """Removed line numbers of every row, rows in order."""
    earlier, out = [], []
    for _, text in rows:
        gone = []
        for i, line in enumerate((text or "").split("\n")):
            words = frozenset(WORD.findall(line))
            if len(words) < lines.MIN_WORDS:
                continue
            if any(9 * len(words & e) >= 4 * (len(words) + len(e)) for e in earlier):
                gone.append(i)
            earlier.append(words)
        out.append(gone)
    return out


def test_lines_match_brute_force(docs, nothing):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (key(r), r.text or ""))
    want = Counter((r.doc_id, len((r.text or "").split("\n")), ",".join(map(str, g))) for r, g in zip(rows, brute_lines(rows), strict=True))
    got = lines.repeated_lines(docs).collect()
    assert Counter((r.doc_id, r.n_lines, r.removed) for r in got) == want and any(r.n_removed for r in got)
    kept = lines.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    by_id = {r.doc_id: r for r in kept.collect()}
    assert by_id[5].text is None and by_id[7].text == "" and by_id[12]._row == "clash"
    assert lines.repeated_lines(nothing).count() == 0


def test_near_lines_in_crowds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "DENSE", 8)  # the way for crowded words
    base = [f"word{i}" for i in range(20)]
    texts = [(k, " ".join(base[:k % 20] + [f"new{k}"] + base[k % 20 + 1 :]) + f"\nown{k} line{k} of{k} five{k} words{k}") for k in range(60)]
    path = str(tmp_path / "crowd")
    spark.createDataFrame(texts, "doc_id long, text string").repartition(4).write.parquet(path)
    got = {r.doc_id: r.removed for r in lines.repeated_lines(spark.read.parquet(path)).collect()}
    want = brute_lines(texts)
    assert got == {k: ",".join(map(str, g)) for (k, _), g in zip(texts, want, strict=True)}


def test_short_lines(spark, tmp_path):
    """Lines from one distinct word on are joined; the registered SQL agrees."""
    duckdb = pytest.importorskip("duckdb")
    texts = [(1, "All rights reserved.\n\nyes\na b c d"), (2, "reserved. All rights\n \nyes no"), (3, "yes yes\ne d c b a\n漢字漢字漢字"), (4, "漢字漢字漢字\na b c\na b c x"), (5, "p q r s t\n\n"), (6, "s r q p\nb c d a")]
    path = str(tmp_path / "short")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    got = {r.doc_id: r.removed for r in lines.repeated_lines(docs).collect()}
    assert got == {1: "", 2: "0", 3: "0,1", 4: "0", 5: "", 6: "0,1"}
    assert {r.doc_id: r.text for r in lines.without_repeats(docs).collect()}[2] == " \nyes no"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert {r[0]: r[3] for r in duck.execute(lines.ORACLE).fetchall()} == got


def brute_similar(rows):
    shingles = []
    for i, (_, text) in enumerate(rows):
        w = WORD.findall(text or "")
        shingles.append({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, min(len(w), 1)))})
    links = [{j for j, t in enumerate(shingles) if i != j and s and t and 9 * len(s & t) >= 4 * (len(s) + len(t))} for i, s in enumerate(shingles)]
    root = list(range(len(rows)))
    for i, own in enumerate(links):
        for j in own:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return links, root


def test_similar_documents_match_brute_force(docs, nothing, monkeypatch):
    rows = docs.select("doc_id", "text").collect()
    links, root = brute_similar(rows)
    ids = {}
    for r, g in zip(rows, root, strict=True):
        ids.setdefault(g, []).append(r.doc_id)
    least = {g: min((i for i in v if i is not None), default=None) for g, v in ids.items()}
    want = Counter((r.doc_id, least[g], len(n)) for r, g, n in zip(rows, root, links, strict=True))

    def check():
        got = jaccard.similar_documents(docs).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
        assert sum(r.keep for r in got) == len(set(root))

    check()
    kept = jaccard.without_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    monkeypatch.setattr(jaccard, "BUCKET", 2)  # every bucket is split
    monkeypatch.setattr(jaccard, "ALIKE", 2.0)
    check()
    assert jaccard.similar_documents(nothing).count() == 0


def test_nested_pairs_are_found(spark, tmp_path):
    """Sets of 800 shingles inside sets of 1,000: exactly at the threshold, sampled at two rates."""
    rows = []
    for k in range(120):
        words = [f"w{k}x{i}" for i in range(1004)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[100:904]))]
    path = str(tmp_path / "nested")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(spark.read.parquet(path)).collect()}
    assert got == {d: (d - d % 2, 1) for d, _ in rows}


def test_crowds_of_near_copies_are_not_split(spark):
    """Members of one likeness count as alike whatever their last sampled token is."""
    rows = []
    for k in range(400):
        words = [f"w{i}" for i in range(300 + k % 40)]
        words[(7 * k) % 280] = f"changed{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sampled = jaccard._sampled(jaccard._keyed(docs), 5)
    leaves = jaccard._leaves(sampled)
    # a row for each start that a member shares, and no more by splitting
    assert leaves.count() <= 400 * jaccard.STARTS * 1.5


def test_lines_of_very_long_texts(monkeypatch):
    """More lines than the one sort key has room for: the sets are the same by two keys."""
    text = "a b c\n" + "\n" * 40 + "d e f g\nb a c\n\nd e f g h"
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    whole = lines.LineSets(data, offsets)
    monkeypatch.setattr(lines, "LINES", 5)
    again = lines.LineSets(data, offsets)
    assert whole.line.tolist() == again.line.tolist() == [0, 41, 42, 44]
    assert (whole.classes() == again.classes()).all() and (whole.word == again.word).all()


def test_line_numbers_do_not_wrap():
    blank = "\n" * (1 << 22)
    data = np.frombuffer(("a b c d" + blank + "e f g h" + "\n" + "a b c d").encode(), np.uint8)
    sets = lines.LineSets(data, np.array([0, len(data)]))
    assert sets.line.tolist() == [0, 1 << 22, (1 << 22) + 1] and sets.size.tolist() == [4, 4, 4]
    assert sets.classes()[0] == sets.classes()[2]


def test_wanted_shingle_sets_are_made_where_texts_are_read(spark):
    texts = ["a b c d e f g", "h i j k l m", None, "a b c d e f g", "n o"]
    rows = jaccard._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    classes = {r._row: r for r in jaccard._sampled(rows, 5).collect()}
    wanted = rows.filter("doc_id in (1, 3)").select("_row")
    found = jaccard._sets(rows, wanted, 5)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = {r._row: r for r in found.collect()}
    assert set(got) == {r._row for r in wanted.collect()}
    assert all(r._class == classes[row]._class and len(r._tokens) == 8 * classes[row]._n for row, r in got.items())


def test_parity_maps_bound_the_difference_of_lines(spark):
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[4:] + ["x", "y"])), (3, " ".join(f"v{i}" for i in range(120)))], "doc_id long, text string")
    rows = lines._keyed(docs)
    maps = {r._class: (r._map0 % 2**64, r._map1 % 2**64, (r._key >> 14) & lines.MOST) for r in lines._prefixes(rows, lines.word_ranks(rows)).collect()}
    assert sorted(n for _, _, n in maps.values()) == [58, 60, 120]
    assert all((high == 0) == (n < 96) for _, high, n in maps.values())  # the second half is for larger lines
    (a, _, _), (b, _, _) = (m for m in maps.values() if m[2] < 96)
    assert (a ^ b).bit_count() <= 6
    assert all((low ^ high).bit_count() % 2 == n % 2 for low, high, n in maps.values())  # a word turns one bit


def test_words_are_counted_where_lines_are_read(spark):
    texts = ["a b b\nc a", None, "", "d é a\n\nb"] * 3
    read = lines._read(lines._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)))
    counted = read.filter("_part is not null").select("_part", "_counts")
    assert read.filter("_part is null").count() == 12
    assert counted.count() <= 2 * lines.PARTS  # rows a task sends, whatever the words
    data = np.frombuffer("\n".join(t for t in texts if t).encode(), np.uint8)
    n = np.bincount((words.Words(data, np.array([0, len(data)])).hash >> np.uint64(46)).astype(int), minlength=lines.BUCKETS)
    assert (lines._ranks(counted)[np.argsort(n, kind="stable")] == np.arange(lines.BUCKETS)).all()
    empty = lines._read(lines._keyed(spark.createDataFrame([], "doc_id bigint, text string")))
    assert (lines._ranks(empty.filter("_part is not null").select("_part", "_counts")) == np.arange(lines.BUCKETS)).all()


def test_candidates_come_from_rows_of_a_key_in_any_order(spark):
    # classes 1 to 4 with the same word, size and place, each twice and apart; 5 differs in its map
    rows = [((7 << 32) | (10 << 14), c, 1 if c < 5 else 1023, 0) for c in (3, 1, 5, 4, 2, 4, 1, 5, 2, 3)]
    got = lines._candidates(spark.createDataFrame(rows, "_key bigint, _class bigint, _map0 bigint, _map1 bigint")).collect()
    assert sorted(r._class for r in got) == [1, 2, 3, 4] and {r._size for r in got} == {4} and len({r._gid for r in got}) == 1


def test_edges_of_a_crowded_group_grow_with_its_members():
    rng = np.random.default_rng(3)
    own = rng.permutation(10_000)[:600]
    tile = rng.integers(0, 12, 600)
    edges = set()
    for a, b in itertools.combinations_with_replacement(range(12), 2):
        at = rng.permutation(np.flatnonzero((tile == a) | (tile == b)))
        alone = rng.integers(0, len(at))  # one member has no link in this pair of tiles
        label = np.where(np.arange(len(at)) == alone, alone, (alone == 0) * 1)
        found = jaccard._edges(own[at], label, tile[at] == a, np.where(np.arange(len(at)) == alone, 0, 5))
        assert sum(n for _, _, n in found) == 5 * (len(at) - 1) and own[at[alone]] not in {c for c, _, n in found if n}
        edges |= {(c, r) for c, r, _ in found if c != r}
    assert len(edges) < 600 + 3 * 12 * 12  # with one root for both tiles they were about 600 x 12 / 2
    root = {int(c): int(c) for c in own}
    for _ in range(30):
        for c, r in edges:
            root[c] = root[r] = min(root[c], root[r])
    assert set(root.values()) == {int(own.min())}
