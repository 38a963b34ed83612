"""The Merkle manifest against one built in Python, its proofs folded by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from qualityspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, tree string, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    fields = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def brute_tree(leaves, fanout):
    """(top, proofs): each proof holds the others of its run and its place, from the leaf upwards."""
    proofs, now = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(now) > 1:
        up = []
        for at in range(0, len(now), fanout):
            run = now[at : at + fanout]
            for k, (_, below) in enumerate(run):
                for leaf in below:
                    proofs[leaf].append(([d for j, (d, _) in enumerate(run) if j != k], k))
            up.append((sha(*(d for d, _ in run)), [leaf for _, below in run for leaf in below]))
        now = up
    return now[0][0], proofs


def brute(rows, fanout):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[lang] = (own, *brute_tree([leaf_of(r) for r in own], fanout))
    root, above = brute_tree([trees[x][1] for x in langs], fanout)
    out = []
    for i, lang in enumerate(langs):
        own, top, proofs = trees[lang]
        out += [(r["doc_id"], leaf_of(r), top, root, [list(x[0]) for x in p + above[i]], [x[1] for x in p + above[i]]) for r, p in zip(own, proofs, strict=True)]
    return sorted(out, key=repr)


def corpus(n, langs, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "Zeile\n", "naïve ☃ " * 3, "long " * 5000]) if i % 7 == 0 else f"text {rng.random()}"
        rows.append({"doc_id": rng.choice([None, i, i, i, 3]), "text": text, "lang": rng.choice(langs), "source": rng.choice([None, "web"]), "n_chars": i if i % 5 else None})
    return rows + rows[: n // 3] + rows[: n // 10]


def frame(spark, rows):
    return spark.createDataFrame([(*(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")), "x", "y", "z") for r in rows], SCHEMA)


def manifest_of(docs, **shape):
    rows = docs.select(merkle.tree_key(F.col("lang")).alias("tree"), "doc_id", merkle.leaf_digest(*map(F.col, merkle.FIELDS)).alias("leaf"))
    return merkle.build(rows, **shape)


@pytest.mark.parametrize(
    ("n", "langs", "fanout", "levels"),
    [(1, ["en"], 2, 8), (2, [None], 2, 1), (60, [None, "", "de", "en", "é"], 2, 2), (90, ["en", "en", "en", "fr"], 3, 1), (400, ["en", None], 2, 3), (30, [str(i) for i in range(20)], 2, 8)],
)
def test_proofs(spark, n, langs, fanout, levels):
    rows = corpus(n, langs)
    found = merkle.prove(manifest_of(frame(spark, rows), fanout=fanout, levels=levels))
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.siblings, r.digits) for r in found.collect()], key=repr) == brute(rows, fanout)
    folded = merkle.fold(F.col("leaf"), F.col("siblings"), F.col("digits"), fanout)
    assert found.filter(folded != F.col("root")).count() == 0


def test_some_requests_and_tampering(spark):
    rows = corpus(200, ["de", "en", None], seed=5)
    manifest = manifest_of(frame(spark, rows), levels=2)
    asked = manifest.leaves.filter("doc_id % 10 = 3")
    found = merkle.prove(manifest, asked)
    whole = {(r[0], r[1], str(r[4])) for r in brute(rows, 2)}
    got = found.collect()
    assert len(got) == asked.count() > 10 and {(r.doc_id, r.leaf, str(r.siblings)) for r in got} <= whole
    wrong = merkle.fold(F.sha2("leaf", 256), F.col("siblings"), F.col("digits"))
    assert found.filter(wrong == F.col("root")).count() == 0


def test_store_is_addressed_by_content(spark):
    """Equal pages are stored once, and every record hashes to its key."""
    rows = [{"doc_id": 1, "text": "same", "lang": "en", "source": None, "n_chars": 4}] * 64
    manifest = manifest_of(frame(spark, rows), levels=2)
    assert [layer.count() for layer in manifest.layers] == [1, 1, 1]
    for layer in manifest.layers:
        for page in layer.collect():
            assert page.digest in {r.digest for r in page.records}
            assert all(sha(*r.children) == r.digest for r in page.records)


def test_no_rows(spark):
    empty = frame(spark, [])
    assert merkle.prove(manifest_of(empty)).count() == 0
