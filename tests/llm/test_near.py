"""The n-gram join, its shingles and components against brute force."""

import random
import re

import numpy as np
import pytest

from qualityspark.llm import ngram_join, shingles
from qualityspark.llm.components import components

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0d]+", lowered) if w]


def brute_sets(rows):
    out = {}
    for doc_id, text in rows:
        w = words_of(text)
        out[doc_id] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                comp[rb] = ra
    return {d: (len(sets[d]), root(d)) for d in ids}


def found(df):
    rows = df.collect()
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def corpus(seed):
    """Copies, near copies at every distance, a passage most texts share, short texts, odd ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(40))
    passage = [word() for _ in range(30)]
    base = [word() for _ in range(60)]
    rows, n = [], 0
    for _ in range(90):
        kind = rng.randrange(6)
        if kind == 0:
            text = list(base)
        elif kind == 1:
            text = list(base)
            for _ in range(rng.randrange(1, 5)):
                text[rng.randrange(len(text))] = word()
        elif kind == 2:
            text = passage + [word() for _ in range(rng.randrange(4, 30))]
        elif kind == 3:
            text = base[: rng.randrange(45, 60)] + [word() for _ in range(rng.randrange(3))]
        elif kind == 4:
            text = [rng.choice("pq") for _ in range(rng.randrange(1, 9))]
        else:
            text = [word() for _ in range(rng.randrange(5, 80))]
        rows.append((n * 3 + 1, rng.choice([" ", "\n", "\t "]).join(text)))
        n += 1
    return rows + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, LONG), (1004, LONG.upper()), (1005, LONG + " end"), (2, rows[5][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_brute_force(spark, documents, seed):
    rows = corpus(seed)
    assert found(ngram_join.join_near(documents(rows))) == brute_components(rows)


def test_no_rows_and_repeated_rows(spark, documents):
    assert found(ngram_join.join_near(documents([]))) == {}
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (5, None)]
    assert found(ngram_join.join_near(documents(rows))) == {4: (2, 4), 9: (2, 4), 5: (0, 5)}


def test_other_column_names(spark):
    df = spark.createDataFrame([(1, "x y", "no"), (2, "x y", "no")], "key long, body string, text string")
    assert found(ngram_join.join_near(df, id_col="key", text_col="body")) == {1: (1, 1), 2: (1, 1)}


def test_shingles_of_odd_texts():
    texts = ["", " ", "A", "a", "a b c d", "a b c d e", "e d c b a", "x" * 500, "x" * 501, "a b c d e a b c d e", "Ä Ä Ä Ä Ä", "ä ä ä ä ä"]
    sets = shingles.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 1, 1, 1, 1, 5, 1, 1]
    assert (sets[2] == sets[3]).all()
    assert len({int(s[0]) for s in sets if len(s) == 1}) == 8
    one, two = shingles.signatures(sets)
    assert one[0] == two[0] == 0 and one[2] == one[3] and len(set(one.tolist())) == 10


def test_prefix_bounds():
    n = np.arange(1, 3000)
    assert (ngram_join.required(n) == -(-4 * n // 5)).all()
    assert (ngram_join.early(n) >= 1).all() and (np.diff(ngram_join.early(n)) >= 0).all()


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(3)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(7, i) for i in range(200, 260)] + [(5, 5), (260, 259), (259, 260), (7, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in chain}, **{i: 7 for i in [7, *range(200, 261)]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_are_divided(spark):
    """Adaptive execution splits a hub's edges and a common shingle's sets: the other side of the join is cut first."""
    from pyspark.sql import functions as F

    from qualityspark.llm import components as K
    from qualityspark.llm.common import cut_lineage

    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        # Several files, so that a partition has several map outputs to be divided by.
        hub = spark.range(0, 120000, 1, 24)
        edges = cut_lineage(hub.select(F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id")).alias("u"), F.xxhash64("id").alias("v")))
        tokens = cut_lineage(hub.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id") % 30000).alias("token")))
        for joined in (K._to_least(edges), tokens.join(ngram_join._counted(tokens).hint("merge"), "token")):
            joined.write.format("noop").mode("overwrite").save()
            joined.collect()
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
