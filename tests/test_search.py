"""Search and similarity against brute force, with the skew paths forced."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediaspark.operators import fulltext, fuzzy, knn, retrieval, similar
from mediaspark.plans import bindings


def brute(q, x, k):
    rows = []
    for qi, qv in q:
        d = [(round(1 - float(np.dot(qv, v) / (np.linalg.norm(qv) * np.linalg.norm(v) or 1)), 9), -i) for i, v in x]
        rows += [(qi, -i, r + 1) for r, (_, i) in enumerate(sorted(d)[:k])]
    return sorted(rows)


def near_frames(spark, q, x):
    return spark.createDataFrame(q, "q bigint, qvec array<double>"), spark.createDataFrame(x, "id bigint, vec array<double>")


@pytest.mark.parametrize("leaf, cell, tile", [(64, 1000, 1000), (5, 40, 7)])
def test_knn(spark, leaf, cell, tile):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 8)) * 3
    x = [(i, (centre[0 if i % 3 == 0 else i % 4] + rng.normal(size=8) * 0.2).tolist()) for i in range(300)]
    for i in (7, 8, 9, *range(100, 130)):
        x[i] = (i, x[6][1])  # exact ties, more than k
    x[20] = (20, [0.0] * 8)
    q = x[:40]
    got = knn.knn(*near_frames(spark, q, x), 9, leaf_rows=leaf, cell_rows=cell, tile_rows=tile).collect()
    assert sorted((r.q, r.id, r.r) for r in got) == brute(q, x, 9)


def test_knn_places_items_in_bounded_blocks(monkeypatch):
    """A batch meets all leaves in blocks; the chords of 10,000 items to 4,096 leaves took 0.6 GB at once."""
    sizes, chord = [], knn._chord
    monkeypatch.setattr(knn, "_chord", lambda a, b: sizes.append(len(a) * len(b)) or chord(a, b))
    x = np.random.default_rng(3).normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaf, far = knn.PivotTree(x[:1500], np.zeros(1500, int), x[:4].T).place(x)
    to = chord(x, x[:1500])
    assert max(sizes) <= 1 << 20 and (leaf == to.argmin(axis=1)).all() and np.allclose(far, to.min(axis=1), atol=1e-6)


def test_knn_of_few_items_and_none(spark):
    x = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)]
    qs, xs = near_frames(spark, [*x, (4, [1.0, 1.0])], x)
    assert sorted((r.q, r.id, r.r) for r in knn.knn(qs, xs, 5).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (4, 1, 2), (4, 2, 1)]
    assert knn.knn(qs, xs.filter("id = 3"), 5).count() == 0 and knn.knn(qs.filter("q = 3"), xs, 5).count() == 0


def test_knn_scores_few_pairs(spark):
    """50,000 vectors in clusters, each a query: under five percent of all pairs are scored."""
    rng = np.random.default_rng(11)
    n = 50_000
    x = rng.normal(size=(250, 32))[rng.integers(0, 250, n)] + 0.15 * rng.normal(size=(n, 32))
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "vec": x.tolist()}), "id bigint, vec array<double>").repartition(8)
    scored = spark.sparkContext.accumulator(0)
    got = knn.knn(rows.selectExpr("id AS q", "vec AS qvec"), rows, 10, scored=scored).toPandas()
    assert 0 < scored.value < 0.05 * n * n
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, n, 5000):
        d = np.round(1 - u @ u[q], 9)
        want = np.lexsort((-np.arange(n), d))[:10]
        own = got[got.q == q].sort_values("r")
        assert np.allclose(own.d, d[want], atol=2e-9) and set(own.id) == set(want)


ITEM = """id bigint, status string, hidden boolean, kind string, title string, template string, song string, tags array<string>,
people array<string>, ocr_text string, description string, transcript string, sounds array<string>, objects array<string>, caption string"""


def item(i, text="", **kw):
    base = dict(
        id=i, status="done", hidden=False, kind="image", title="", template="", song="", tags=[], people=[], ocr_text=text,
        description="", transcript="", sounds=[], objects=[], caption="",
    )
    return base | kw


def frame(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def test_excluded_words_alone(spark):
    docs = frame(spark, [item(1, "salt wind"), item(2, "salt marsh"), item(3, "quiet cove"), item(4, "")])
    q = spark.createDataFrame([(1, "-salt"), (2, '-"salt marsh" -cove'), (3, "cove or -wind"), (4, "salt -wind")], "q bigint, text string")
    found = {}
    for r in fulltext.fts_match(docs, q).filter("config = 'simple'").collect():
        found.setdefault(r.q, set()).add(r.id)
    assert found == {1: {3, 4}, 2: {1, 4}, 3: {2, 3, 4}, 4: {2}}
    ranked = fulltext.fts_rank(docs, q).filter("q = 1").orderBy("r").collect()
    assert [(r.id, r.score) for r in ranked] == [(4, 0.0), (3, 0.0)]


def test_searches_meet_items_by_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "STATED", 2)
    docs = frame(spark, [item(i, f"salt w{i} " + "wind " * (i % 3)) for i in range(30)])
    asked = [(1, "-w1"), (2, "-w2 -wind"), (3, "salt wind w4"), (4, "-salt"), (5, "nowhere salt"), (6, "w5 or salt w7")]
    found = fulltext.fts_match(docs, spark.createDataFrame(asked, "q bigint, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {}
    for r in found.filter("config = 'simple'").collect():
        got.setdefault(r.q, set()).add(r.id)
    whole = set(range(30))
    assert got == {1: whole - {1}, 2: {i for i in whole if i % 3 == 0}, 3: {4}, 6: {5, 7}}


def test_full_text_syntax(spark):
    docs = frame(spark, [item(1, "big cats sleeping"), item(2, "sleeping dog cat"), item(3, "quick brown fox"), item(4, "brown quick fox")])
    q = spark.createDataFrame([(1, "cat sleep"), (2, '"quick brown"'), (3, "dog or brown"), (4, "fox -dog"), (5, "sleeping -dog")], "q bigint, text string")
    got = fulltext.fts_rank(docs, q).collect()
    hits = {k: {r.id for r in got if r.q == k} for k in range(1, 6)}
    assert hits == {1: {1, 2}, 2: {3}, 3: {2, 3, 4}, 4: {3, 4}, 5: {1}}


def test_cover_density_prefers_close_words(spark):
    docs = frame(spark, [item(1, "alpha x x x x omega"), item(2, "alpha omega")])
    q = spark.createDataFrame([(1, "alpha omega")], "q bigint, text string")
    got = {r.id: r.score for r in fulltext.fts_rank(docs, q).collect()}
    s = 1.4 + 0.2  # every configuration has one cover of distance one
    assert got[2] == pytest.approx(s / (s + 1)) and got[1] < got[2]


def test_fuzzy_is_brute_force(spark, monkeypatch):
    """Small blocks of searches, words and cells; texts of no word, of one and of many."""
    for name, n in (("SEARCHES", 5), ("QUERY_BLOCK", 2), ("BLOCKS_KEPT", 1), ("WORDS", 6), ("CELLS", 8)):
        monkeypatch.setattr(fuzzy, name, n)
    rng = np.random.default_rng(8)
    vocabulary = ["distracted", "boyfriend", "distant", "friend", "cat", "catalog", "boy", "strange", "ça", "trend"]
    texts = ["", "cat", *(" ".join(rng.choice(vocabulary, rng.integers(1, 12))) for _ in range(25))]
    asked = ["distractd boyfrend", "cat", "catalg", "strange trend boy cat", "zzzz", "ça va bien", "friend", "boy boy boy", "dist friend", "a b c d e", "stranger"]
    q = spark.createDataFrame(list(enumerate(asked)), "q bigint, text string")
    got = sorted((r.q, r.id, r.score) for r in fuzzy.fuzzy_scores(frame(spark, [item(i, t) for i, t in enumerate(texts)]), q).collect())
    want = []
    for k, text in enumerate(asked):
        words = text.split()
        if not 4 <= len(text) <= 40 or len(words) > 4:
            continue
        grams = set().union(*map(fuzzy.trigrams, words))
        for i, t in enumerate(texts):
            w = t.split()
            share = max((len(grams & set().union(*map(fuzzy.trigrams, w[j : j + len(words)]))) / len(grams) for j in range(len(w))), default=0)
            if round(share, 9) >= 0.35:
                want.append((k, i, round(share, 9)))
    assert len(want) > 20 and got == sorted(want)


def test_fuzzy_finds_misspelling(spark):
    docs = frame(spark, [item(1, "distracted boyfriend looks back"), item(2, "nothing here")])
    q = spark.createDataFrame([(1, "distractd boyfrend"), (2, "abc"), (3, "five words are too many")], "q bigint, text string")
    got = fuzzy.fuzzy_match(docs, q).collect()
    assert [(r.q, r.id) for r in got] == [(1, 1)]
    want = fuzzy.trigrams("distractd") | fuzzy.trigrams("boyfrend")
    have = fuzzy.trigrams("distracted") | fuzzy.trigrams("boyfriend")
    assert got[0].score == pytest.approx(len(want & have) / len(want))


def skewed(spark, n=120):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        tags = {f"t{int(x)}" for x in rng.integers(0, 40, 4)} | ({"hot"} if i % 3 == 0 else set())
        people = [f"p{int(rng.integers(0, 12))}"] + (["star"] if i % 3 == 1 else []) + (["idol"] if i % 6 == 1 else [])
        rows.append(item(i, tags=sorted(tags), people=people, template="Hot" if i % 3 == 0 else f"tp{i % 7}", hidden=i % 11 == 0))
    return rows, frame(spark, rows)


@pytest.mark.parametrize("hot, entries, part", [(5000, 10**6, 512), (8, 10**6, 512), (8, 5, 3), (1, 5, 3)])
def test_sim_tags_is_brute_force(spark, monkeypatch, hot, entries, part):
    """Lists of every size: only lists, lists and common tags, (nearly) only common tags."""
    monkeypatch.setattr(similar, "LIST_ROWS", entries)
    monkeypatch.setattr(similar, "LIST_PART", part)
    rows, df = skewed(spark)
    got = similar.sim_tags(df, similar.tag_stats(df), max_share=0.5, k=7, hot_rows=hot).collect()
    shown = {r["id"]: set(r["tags"]) for r in rows if not r["hidden"]}
    n = Counter(t for tags in shown.values() for t in tags)
    want = []
    for r in rows:
        mine = sorted((n[t], t) for t in set(r["tags"]) if 1 < n[t] <= 0.5 * len(shown))[:12]
        sums = [(round(sum(np.log(len(shown) / c) for c, t in mine if t in tags), 9), o) for o, tags in shown.items() if o != r["id"]]
        best = sorted(((s, o) for s, o in sums if s > 0), key=lambda x: (-x[0], -x[1]))[:7]
        want += [(r["id"], o, i + 1, s) for i, (s, o) in enumerate(best)]
    got = sorted((r["id"], r["other"], r["r"], r["s"]) for r in got)
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=2e-9)


@pytest.mark.parametrize("hot", [5000, 5])
def test_template_people_is_brute_force(spark, hot):
    rows, df = skewed(spark)
    got = sorted((r.id, r.other, r.s, r.r) for r in similar.sim_template_people(df, k=7, hot_rows=hot).collect())
    want = []
    for a in rows:
        scored = []
        for o in rows:
            s = (2 if a["template"] and a["template"].lower() == o["template"].lower() else 0) + len(set(a["people"]) & set(o["people"]))
            if s and o["id"] != a["id"] and not o["hidden"]:
                scored.append((-s, -o["id"]))
        want += [(a["id"], -o, -s, r + 1) for r, (s, o) in enumerate(sorted(scored)[:7])]
    assert got == sorted(want)


def test_template_people_without_pairs_of_popular_people(spark):
    """People with over ``2 * k`` holders are never joined with each other, however few holders count as popular otherwise."""
    df = frame(spark, [item(i, people=["star", f"p{i % 3}"], template="") for i in range(60)])
    found = similar.sim_template_people(df, k=7)
    assert "Join Inner, (person" not in found._jdf.queryExecution().optimizedPlan().toString()
    best = {r.other for r in found.collect() if r.id == 0}
    assert best == set(range(39, 60, 3))


def test_template_people_of_repeated_rows(spark):
    """A partner in two rows counts twice, each row with its own template, and an item is never its own partner."""
    rows = [item(1, people=["a"], template="x"), item(1, people=["a"], template="x"), item(2, people=["a"], template="x"), item(2, people=["a"], template="y"), item(3, people=["a"], template="z")]
    for hot in (5000, 0):
        got = [(r.other, r.s) for r in similar.sim_template_people(frame(spark, rows), k=3, hot_rows=hot).orderBy("id", "r").collect() if r.id == 3]
        assert got == [(2, 1), (2, 1), (1, 1)]


def test_tag_stats_count_repeats(spark):
    df = frame(spark, [item(1, tags=["a", "a", "b"]), item(2, tags=["a"], hidden=True)])
    assert {r.tag: r.n for r in similar.tag_stats(df).collect()} == {"a": 2, "b": 1}


def test_inline_page_reads_whole_pages(spark):
    hits = spark.createDataFrame([(1, i, i) for i in range(1, 101)], "q bigint, id bigint, r int")
    ready = spark.createDataFrame([(i,) for i in range(1, 41)], "id bigint")
    got = retrieval.inline_page(hits, ready).collect()
    assert sorted(r.id for r in got if r.state == "sent") == list(range(1, 31))
    assert sorted(r.id for r in got if r.state == "missing") == list(range(41, 51))


def test_similar_read_cuts_before_hiding(spark):
    _, df = skewed(spark)
    lists = spark.createDataFrame([(1, [11, 2, 22, 3, 4])], "id bigint, ids array<bigint>")
    assert [r.other for r in similar.similar_read(lists, df, 4).orderBy("pos").collect()] == [2, 3]


def test_tags_are_all_words(spark, sf):
    """The binding gives every distinct word of the text; TAGS_SQL, read with all words, has the same rows."""
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    whole = bindings.TAGS_SQL.replace(r"\p{L}{10,}", r"\p{L}+")
    want = dict(duck.execute(f"WITH {whole} SELECT id, tags FROM tag_lists").fetchall())
    got = {r.id: r.tags for r in bindings.items(spark, sf).select("id", "tags").collect()}
    assert {i: t for i, t in got.items() if t} == want and any(len(w) < 4 for t in want.values() for w in t)


def test_fuzzy_scores_only_runs_that_can_count(spark):
    """After ten full hits a task drops lesser ones, and the best list is that of all pairs."""
    texts = ["silver lantern"] * 10 + ["silver lamp", "golden lantern", "silverware lanterns"] * 20 + ["empty road"] * 10
    docs = frame(spark, [item(i, t) for i, t in enumerate(texts)]).coalesce(1)
    q = spark.createDataFrame([(1, "silver lantern")], "q bigint, text string")
    block = fuzzy._Block([(1, ["silver", "lantern"])])
    masks = block.masks(["silver", "lamp", "road"])
    words, first = np.array([0, 1, 2, 2]), np.array([0, 2])
    i, j, share = block.found(masks, words, np.array([0, 0, 1, 1]), first, np.array([0.35]))
    assert list(i) == [0] and list(j) == [0] and 0.35 < share[0] < 1
    assert not len(block.found(masks, words, np.array([0, 0, 1, 1]), first, np.array([1.0]))[0])
    every = sorted((-r.score, -r.id) for r in fuzzy.fuzzy_scores(docs, q).collect())
    got = [(-r.score, -r.id) for r in fuzzy.fuzzy_match(docs, q, limit=5).orderBy("r").collect()]
    assert got == every[:5] and len(every) == 70


def test_posting_totals_count_without_a_shuffle_of_ids(spark):
    texts = [(1, "Runs running RUNS, кота коту"), (2, None), (3, ""), (None, "run runs"), (None, "run runs"), (5, "ways of running 2 x")]

    def check(rows):
        fields = dict.fromkeys(("description", "song", "transcript", "template", "caption"), "")
        df = spark.createDataFrame([(i, t, t and t[:4]) for i, t in rows], "id long, ocr_text string, title string")
        df = df.select("*", *[F.lit(v).alias(k) for k, v in fields.items()])
        df = df.select("*", *[F.split(F.coalesce("ocr_text", F.lit("")), " ").alias(c) for c in ("tags", "people")], *[F.array().cast("array<string>").alias(c) for c in ("sounds", "objects")])
        want = fulltext._stemmed(fulltext.raw_postings(df))
        assert sorted(map(str, fulltext.postings(df).collect())) == sorted(map(str, want.collect()))
        want = want.groupBy("config", "class", "term").agg(
            F.count_distinct("id").alias("docs"), F.count("*").alias("hits"), F.sum(F.col("pos").cast("bigint")).alias("pos_sum")
        )
        got = fulltext.posting_totals(df)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        return got._jdf.queryExecution().executedPlan().toString()

    assert "hashpartitioning(id" not in (plan := check(texts)) and "distinct" not in plan
    check(texts + [(1, "runs kings"), (5, "running")])


def test_sim_tags_of_asking_items(spark):
    rng = np.random.default_rng(3)
    data = [(i, [f"t{int(x)}" for x in rng.zipf(1.6, 9) % 40], "done", False) for i in range(120)]
    df = spark.createDataFrame(data, "id bigint, tags array<string>, status string, hidden boolean")
    stats, asking = similar.tag_stats(df), df.filter("id % 2 = 0").select("id")
    want = similar.sim_tags(df, stats, max_share=0.5, k=7, hot_rows=20).filter("id % 2 = 0 and r <= 4").collect()
    got = similar.sim_tags(df, stats, max_share=0.5, k=4, hot_rows=20, asking=asking).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_full_text_matches_where_words_are_made(spark, monkeypatch):
    """Small blocks against a plain search of the postings; rows of one id are one item, no position is shuffled."""
    for name, n in (("WORDS", 40), ("PAIRS", 6), ("PLACES", 9), ("SEARCHES", 7)):
        monkeypatch.setattr(fulltext, name, n)
    rng = np.random.default_rng(4)
    vocabulary = np.array(["running", "runs", "salt", "salted", "wind", "cove", "кота", "коту", "of", "x"])
    rows = [item(i, " ".join(rng.choice(vocabulary, rng.integers(0, 9)))) for i in range(40)]
    docs = frame(spark, [*rows, item(None, "salt wind")])
    asked = ['"salt wind" cove', "runs wind -cove", '"of salt of" x', "salt salt", 'кота -"of salt"', "running or cove x", '-salt -"wind wind"', "x of salt wind runs", "-", "nowhere"]
    q = spark.createDataFrame([*enumerate(asked), (3, "salt salt")], "q bigint, text string")

    def plain(df):
        places, terms = {}, {}
        for p in fulltext._stemmed(fulltext.raw_postings(df)).filter("id is not null").collect():
            places.setdefault((p.id, p.config), {}).setdefault(p.term, set()).add(p.pos)
        for t in fulltext.query_terms(q).collect():
            terms.setdefault((t.q, t.config, t.alt), []).append(t)
        out = {}
        for (search, config, _), words in terms.items():
            units = {}
            for t in words:
                units.setdefault((t.neg, t.unit), []).append(t)
            for (i, kind), held in places.items():
                if kind != config or all(t.neg for t in words):
                    continue

                def begins(own):
                    own = [t for t in own if not t.neg or t.term in held]
                    starts = [{p - t.j for p in held.get(t.term, ())} for t in own]
                    return set.intersection(*starts) if own and len(own) == own[0].len else set()

                wanted = [begins(own) for (neg, _), own in sorted(units.items()) if not neg]
                if not all(wanted) or any(begins(own) for (neg, _), own in units.items() if neg):
                    continue
                last, low, s = [-1] * len(wanted), -1, 0.0
                for start, u in sorted((p, u) for u, own in enumerate(wanted) for p in own):
                    last[u] = start
                    if min(last) > low:
                        low = min(last)
                        s += 1 / (1 + max(start - low - len(wanted) + 1, 0))
                weight = fulltext.CLASS_WEIGHTS[fulltext.CONFIGS[config]]
                out[search, i] = out.get((search, i), 0.0) + weight * s
        return out

    for df in (docs, docs.unionByName(frame(spark, [item(i, "wind cove x") for i in range(0, 40, 3) for _ in range(2)]))):
        want = plain(df)
        ranked = fulltext.fts_rank(df, q)
        got = {(r.q, r.id): r.score for r in ranked.collect() if r.q != 6}
        assert len(want) > 40 and set(got) == set(want)
        assert all(got[k] == pytest.approx(s / (s + 1), abs=2e-9) for k, s in want.items())
        assert {(r.q, r.id) for r in fulltext.fts_match(df, q).filter("q <> 6").collect()} == set(want)
        plan = fulltext._matches(df, fulltext.query_terms(q))._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and "collect_list" not in plan and ("RepartitionByExpression" in plan) == (df is not docs)


def test_trigrams_are_numbers():
    """All trigrams of a batch of words come from one array instead of one set per word."""
    words = ["cat", "ça", "x", "haha"]
    word, codes = fuzzy._codes(words)
    named = {sum(ord(c) << 21 * (2 - i) for i, c in enumerate(g)): g for w in words for g in fuzzy.trigrams(w)}
    assert [{named[c] for c in codes[word == i]} for i in range(4)] == [fuzzy.trigrams(w) for w in words]


def test_knn_without_structure_reads_items_once(spark, monkeypatch):
    """Vectors that no bound can tell apart: few pairs are scored in full, only the best of a block leave it."""
    rng = np.random.default_rng(2)
    x = [(i, rng.normal(size=24).tolist()) for i in range(900)]
    x[5], x[7] = (5, x[6][1]), (7, None)
    rows = spark.createDataFrame(x, "id bigint, vec array<float>").repartition(4)
    scored = spark.sparkContext.accumulator(0)
    got = knn.knn(rows.selectExpr("id AS q", "vec AS qvec"), rows, 9, leaf_rows=16, cell_rows=64, scored=scored)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().executedPlan().toString()
    held = [(i, np.float32(v).astype(float).tolist()) for i, v in x if v]
    assert sorted((r.q, r.id, r.r) for r in got.collect()) == brute(held, held, 9) and scored.value < 0.05 * 900**2
    for name, n in (("QUERIES", 300), ("LEAST_QUERIES", 40), ("QUERY_ROWS", 64), ("ITEM_ROWS", 50)):
        monkeypatch.setattr(knn, name, n)
    few = rows.filter("id < 70")
    got = knn.knn(few.selectExpr("id AS q", "cast(vec AS array<double>) AS qvec"), rows, 9, leaf_rows=16, cell_rows=64).collect()
    assert sorted((r.q, r.id, r.r) for r in got) == brute([h for h in held if h[0] < 70], held, 9)


def test_hash_deals_numbers_apart(spark):
    keys = knn._apart(spark, 13)
    df = spark.createDataFrame([(k,) for k in keys], "key bigint").repartition(13, "key")
    assert len(keys) == 13 and df.select(F.spark_partition_id()).distinct().count() == 13


@pytest.mark.parametrize("known, common, hot", [(30, 6, 3), (8, 4, 2), (30, 30, 2)])
def test_sim_tags_of_common_tags_leave_a_block_as_best_partners(spark, monkeypatch, known, common, hot):
    """Known and other tags, lists and stream, rows of one id in two rows; no list of a common tag travels to each item."""
    rng = np.random.default_rng(9)
    data = [(i % 110, [f"t{int(x)}" for x in rng.zipf(1.5, 8) % 60], "done", i % 13 == 0) for i in range(120)]
    df = spark.createDataFrame([*data, (None, ["t1"], "done", False)], "id bigint, tags array<string>, status string, hidden boolean")
    for name, n in (("VOCABULARY", known), ("COMMON", common), ("MOST_ASKING", 40), ("LEAST_ASKING", 10), ("OTHERS", 9), ("CELLS", 50)):
        monkeypatch.setattr(similar, name, n)
    stats = similar.tag_stats(df)
    own = similar.tag_idf(df, stats, 0.5).collect()
    shown = [(i, set(t)) for i, t, _, hidden in data if not hidden]
    count = {r.tag: r.n for r in stats.collect()}
    total = len(shown) + 1
    mine = {}
    for i, tags, *_ in data:
        mine.setdefault(i, []).extend((count[t], t) for t in set(tags) if t in count and 1 < count[t] <= 0.5 * total)
    mine = {i: sorted(x)[: similar.OWN_TAGS] for i, x in mine.items()}
    assert sorted((r.id, r.n, r.tag) for r in own if r.id is not None) == sorted((i, *x) for i, own in mine.items() for x in own)
    want = []
    for i, tags in mine.items():
        sums = Counter()
        for o, held in shown:
            for c, t in tags:
                if t in held and o != i:
                    sums[o] += np.log(total / c)
        best = sorted(((round(s, 9), o) for o, s in sums.items()), key=lambda x: (-x[0], -x[1]))[:5]
        want += [(i, r + 1, o, pytest.approx(s, abs=2e-9)) for r, (s, o) in enumerate(best)]
    got = similar.sim_tags(df, stats, max_share=0.5, k=5, hot_rows=hot)
    assert sorted((r.id, r.r, r.other, r.s) for r in got.collect()) == sorted(want, key=lambda x: x[:3])


def test_few_vectors_spare_texts_a_shuffle(spark, sf):
    plan = bindings.items_with_vectors(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("strategy=broadcast") < plan.index("doc_id")
