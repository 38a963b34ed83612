"""The pipeline, stage by stage, against brute-force versions on the smallest tables."""

import re
from pathlib import Path

import numpy as np
import pytest
import test_near
import test_texts

import corpus_pipeline
from qualityspark import session
from qualityspark.llm import ngram_join, quality
from qualityspark.llm.common import cut_lineage

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "secret scan", "best-fit packing"]

    def step(name, docs):
        out = cut_lineage(stages[name](spark, docs, FOLDER))
        return out, {r.doc_id: r for r in out.collect()}

    before = {r.doc_id: r for r in docs.collect()}
    net = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    docs, now = step("quality classifier", docs)
    scores = {i: net.score([(r.text or "").encode()])[0] for i, r in before.items()}
    sure = {i for i, s in scores.items() if abs(s - quality.THRESHOLD) > 1e-4}
    assert set(now) & sure == {i for i in sure if scores[i] >= quality.THRESHOLD}
    assert docs.columns == columns and all(now[i] == before[i] for i in now)

    before = now
    docs, now = step("exact dedup", docs)
    assert set(now) == {d for d, _, _, kept, _ in test_texts.brute_digests([(i, r.text) for i, r in before.items()]) if kept}
    assert docs.columns == columns and all(now[i] == before[i] for i in now)

    before = now
    docs, now = step("n-gram Jaccard join", docs)
    assert set(now) == {i for i, (_, c) in test_near.brute_components([(i, r.text) for i, r in before.items()]).items() if c == i}

    before = now
    docs, now = step("secret scan", docs)
    assert docs.columns == columns and set(now) == set(before)
    for i, r in now.items():
        secret = r'(?<=token = ")[0-9a-f]{40}(?=")|(?<=password=)[0-9a-f]{18}|\bAKIA[0-9A-Z]{16}\b'
        assert r.text == re.sub(secret, "[SECRET]", before[i].text) and r.n_chars == len(r.text)

    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(now)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and len(ends) <= -(-sum(ends.values()) // 1024) + 3
    assert np.unique([r.sequence_id for r in packed]).size == len(ends)


def test_documents_without_ids_stay(spark):
    stages = dict(corpus_pipeline.STAGES)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [(7, words(0, 30)), (None, words(0, 30)), (None, words(1, 30)), (None, words(1, 30)), (None, words(1, 30) + " "), (8, words(2, 60)), (None, words(2, 60) + " y")]
    texts += [(None, words(3, 60)), (None, words(3, 60) + " y"), (9, words(4, 20)), (None, words(4, 20) + "  "), (None, words(5, 20)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)
    found = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    exact = cut_lineage(stages["exact dedup"](spark, docs, FOLDER))
    left = [texts[0], texts[4], *texts[5:9], texts[10], *texts[11:]]
    assert found(exact) == sorted(left, key=str) and exact.columns == docs.columns
    near = cut_lineage(stages["n-gram Jaccard join"](spark, exact, FOLDER))
    groups = found(near)
    assert len(groups) == 7 and texts[5] in groups and texts[6] not in groups
    assert sum(t in groups for t in texts[7:9]) == 1 and {texts[0], texts[4], texts[10], texts[11], texts[12]} <= set(groups)
    masked = cut_lineage(stages["secret scan"](spark, near, FOLDER))
    assert found(masked) == groups
    packed = stages["best-fit packing"](spark, masked, FOLDER).collect()
    assert sum(r.piece == 0 for r in packed) == 7 and sum(r.doc_id is None and r.piece == 0 for r in packed) == 5
    judged = stages["quality classifier"](spark, docs, FOLDER)
    net = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert found(judged) == sorted([t for t in texts if net.score([(t[1] or "").encode()])[0] >= quality.THRESHOLD], key=str)


def test_a_file_loaded_twice_is_deduplicated(spark):
    stages = dict(corpus_pipeline.STAGES)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    texts = [(1, words(0)), (1, words(0)), (2, words(0)), (3, words(1)), (3, words(1) + " y"), (None, words(1) + " z"), (3, words(2))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], schema)
    exact = cut_lineage(stages["exact dedup"](spark, docs, FOLDER))
    assert sorted((r.doc_id or 0, r.text) for r in exact.collect()) == sorted((i or 0, t) for i, t in [texts[0], *texts[3:]])
    near = [(r.doc_id, r.text) for r in stages["n-gram Jaccard join"](spark, exact, FOLDER).collect()]
    assert len(near) == 3 and texts[0] in near and texts[6] in near and (texts[3] in near) != (texts[4] in near)


def test_scratch_of_finished_steps_goes(spark, monkeypatch):
    """Counts let go of their shuffle before they are joined; of a stage's scratch only what its result reads is left."""
    steps, counted, release = [], ngram_join._counted, ngram_join.release
    monkeypatch.setattr(ngram_join, "_counted", lambda tokens: (steps.append("counted"), counted(tokens))[1])
    monkeypatch.setattr(ngram_join, "release", lambda spark: (steps.append("release"), release(spark))[1])
    stages = dict(corpus_pipeline.STAGES)
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    texts = [(i, words(i % 5) + " y" * (i % 3), "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    before = len(session._cuts)
    found = {name: stages[name](spark, docs, FOLDER).count() for name in ("exact dedup", "n-gram Jaccard join")}
    assert found == {"exact dedup": 15, "n-gram Jaccard join": 5}
    assert [steps[i + 1] for i, s in enumerate(steps) if s == "counted"] == ["release"] * 2
    # Each stage: its rows with their numbers, and the numbers that stay.
    assert len(session._cuts) - before == 4 and all(session.exists(spark, p) for p in session._cuts[before:])
