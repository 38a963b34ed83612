"""Suffix-array dedup against a table of all strings."""

import random
from collections import Counter

import numpy as np
import pytest

from qualityspark.llm import suffix_dedup as sd


def brute(rows, match):
    texts = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(t[i : i + match] for _, t in texts for i in range(len(t) - match + 1))
    out = []
    for doc_id, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - match + 1):
            if seen[t[i : i + match]] > 1:
                gone[i : i + match] = True
        spans, at = [], 0
        while at < len(t):
            if gone[at]:
                end = at + int(np.argmin(gone[at:]))
                spans.append((at, end))
                at = end
            at += 1
        out.append((doc_id, len(t), spans, bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["doc_id", "n_bytes", "spans", "kept"]
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans or ()], bytes(r.kept)) for r in df.collect()), key=repr)


def corpus(seed, letters="ab☃é", n=80):
    """Passages with changes in them, copies, periodic and very plain texts, short ones."""
    rng = random.Random(seed)
    word = lambda size: "".join(rng.choice(letters + "cdefgh") for _ in range(size))
    passages = [word(rng.randrange(8, 80)) for _ in range(6)]
    rows = [(1, None), (None, ""), (3, "x" * 90), (4, "xy" * 60), (5, "x" * 15), (6, "é" * 40)]
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            low = rng.randrange(len(p))
            parts += [word(rng.randrange(0, 30)), p[low : low + rng.randrange(1, 80)]]
        rows.append((rng.choice([i, i, None]), "".join(parts)))
    return rows + [rng.choice(rows) for _ in range(10)]


@pytest.mark.parametrize(("seed", "match", "anchor", "segment"), [(1, 16, 8, 1 << 18), (2, 24, 8, 64), (3, 24, 24, 40), (4, 32, 16, 1 << 18)])
def test_against_brute_force(spark, documents, seed, match, anchor, segment):
    rows = corpus(seed)
    got = found(sd.deduplicate_passages(documents(rows), match=match, anchor=anchor, segment=segment))
    assert got == brute(rows, match)
    assert any(s for _, _, s, _ in got) and any(k for *_, k in got)


def test_many_buckets(spark, documents, monkeypatch):
    """More buckets than anchors, so that anchors and equal suffixes lie across borders everywhere."""
    rows = corpus(7, letters="a", n=40) + [(1000 + i, f"{i}" * 12 + "a passage that very many of the texts share, once each" + f"{i * 7}" * 9) for i in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    # Without the merging of small partitions, each bucket is a task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(sd.deduplicate_passages(documents(rows), match=24, anchor=8)) == brute(rows, 24)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bytes_of_200(spark, documents):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared, near = text(200), text(199)
    rows = [(1, text(300) + shared + text(50)), (2, shared), (3, text(5) + near + "!"), (4, near + "?"), (5, text(400)), (6, "z" * 200), (7, "z" * 201), (8, text(700000))]
    rows.append((9, rows[-1][1][300000:400000]))
    got = found(sd.deduplicate_passages(documents(rows)))
    assert got == brute(rows, 200)
    assert {d: len(k) for d, _, _, k in got} == {1: 350, 2: 0, 3: 205, 4: 200, 5: 400, 6: 0, 7: 0, 8: 600000, 9: 0}


def test_empty_table_and_bounds(spark, documents):
    assert sd.deduplicate_passages(documents([])).count() == 0
    assert sd.deduplicate_passages(documents([(1, "short"), (1, None)])).count() == 2
    with pytest.raises(ValueError):
        sd.deduplicate_passages(documents([]), match=250)


def test_first_least():
    rng = np.random.default_rng(1)
    for width in (1, 2, 7, 105):
        for n in (0, width - 1, width, 3 * width + 5, 400):
            x = rng.integers(0, 9, n).astype(np.uint64)
            assert sd.first_least(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(n - width + 1)]


def test_multikey_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"\x00\x01\xff") for _ in range(24)) for _ in range(500)]
    words = np.frombuffer(b"".join(strings), ">u8").reshape(-1, 3).astype(np.uint64)
    order, starts = sd.multikey_order([lambda rows, d=d: words[rows, d] for d in range(3)], len(strings))
    ranked = [strings[i] for i in order]
    assert ranked == sorted(strings)
    assert starts[-1].tolist() == [i == 0 or ranked[i] != ranked[i - 1] for i in range(len(ranked))]
