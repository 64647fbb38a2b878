"""Every stage of the pipeline against a brute-force version of its step, on its own input."""

import re
import zlib
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
from test_text_operators import brute_lines, brute_similar
from tokenizers import Tokenizer

from mediaspark.llm.queries import BYTE_BPE
from mediaspark.llm.tokens import cut_pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_step_by_step(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def step(k):
        name, stage = pipeline.STAGES[k]
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    out = step(0)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    lettered = {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    found = {r.doc_id: r.lang for r in out.collect()}
    assert set(found) <= lettered and len(found) >= 0.98 * len(lettered)
    assert sum(truth[d] == v for d, v in found.items()) >= 0.95 * len(found)

    docs = out
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    want = {}
    for r, gone in zip(rows, brute_lines([(r.doc_id, r.text) for r in rows]), strict=True):
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in set(gone))
        if text.strip(" \t\n\r"):
            want[r.doc_id] = text
    out = step(1)
    assert {r.doc_id: r.text for r in out.collect()} == want and all(r.n_chars == len(r.text) for r in out.collect())

    docs = out
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    _, root = brute_similar([(r.doc_id, r.text) for r in rows])
    out = step(2)
    assert {r.doc_id for r in out.collect()} == {rows[g].doc_id for g in set(root)}

    docs = out
    kept = {r.doc_id: r for r in docs.collect()}
    out = step(3)
    times = Counter(r.doc_id for r in out.collect())
    assert set(times) <= set(kept) and max(times.values()) <= 3 and all(kept[r.doc_id].text == r.text for r in out.collect())
    size = {d: len(WORD.findall(r.text)) for d, r in kept.items()}
    total = sum(size.values())
    assert abs(sum(size[d] * n for d, n in times.items()) - total) < 0.1 * total

    docs = out
    out = step(4).collect()
    library = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(cut_pieces(len(ids), 2048)):
            want[r.doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2


def test_run_and_names(spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_copies", "mix_sources", "best_fit_packing"]
    assert pipeline.ORACLE_SQL is None and pipeline.run(spark, sf).count() > 0


def test_empty_documents(spark, nothing, sf):
    docs = nothing.select(*pipeline.COLUMNS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_language_stage_learns_from_every_document(spark, monkeypatch):
    """Model and floors come from all labelled documents, however many a language has."""
    from mediaspark.llm import language

    seen, whole = [], language._sample

    def watched(labelled, per_lang):
        langs, rows = whole(labelled, per_lang)
        seen.append((labelled.count(), rows.count()))
        return langs, rows

    monkeypatch.setattr(language, "_sample", watched)
    docs = spark.range(2600).selectExpr("id as doc_id", "concat('harbour lights number ', id % 7) as text", "'en' as lang", "'a' as source", "20L as n_chars")
    assert pipeline.language_id(spark, docs, "").count() == 2600
    assert len(seen) == 2 and all(all_ == used > 1500 for all_, used in seen)
