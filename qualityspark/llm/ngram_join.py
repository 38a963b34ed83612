"""N-gram Jaccard join: a grouped prefix join over word shingles.

Two texts link when 100 * shared shingles >= 80 * all shingles of both. The
steps, each on what the one before it could not rule out:

1. Texts with the same set are one set from here on.
2. Of each set the smallest hashes are counted over all sets. In any order of
   shingles, two linked sets share the first few of their common ones early, so
   a set with too few shingles that any other set has there links with nothing.
3. Shingles of the sets left are ordered from rare to common. A set with fewer
   than 80 % shared shingles links with nothing; the others keep their prefix,
   in which any linked pair meets.
4. Sets with the same size and prefix are one group. Each group is verified
   against the group that leads most of its prefix lists, and members against
   their group's first: what links is one component, however many copies. Sets
   outside of a list's largest component then try the nearest set in that.
5. Only pairs of sets from different components are left. Lists give those that
   pass size, position and bitmap filters, and every one of them is verified.

So a large group of near copies costs links to leaders, not all its pairs, and
no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.llm.common import cut_lineage, cut_of, release, texts, written
from qualityspark.llm.components import components
from qualityspark.llm.shingles import WORDS, mix, shingle_sets, signatures

#: A link needs ``9 * shared >= 4 * (n + m)``, the same as a similarity of 0.8.
EARLY = 0.1
#: Longs of a set's bitmap.
BITMAP = 8
_TAG = 1 << 16


def required(n):
    """Shingles that a set of ``n`` must share with any set it links with: 80 % of its own."""
    return (4 * n + 4) // 5


def early(n):
    """Common shingles that linked sets have among their first ``n - required(n) + early(n)`` ones."""
    return np.maximum(1, np.ceil(EARLY * n)).astype(np.int64) if isinstance(n, np.ndarray) else max(1, int(np.ceil(EARLY * n)))


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch["text"].cast(pa.binary()).to_pylist()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _by_size(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of at most some bytes of text, but for single rows."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch["text"]).to_pylist()):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def _heads(words: int):
    def run(batches):
        for batch in _by_size(batches):
            sets = shingle_sets(_bytes(batch), words)
            a, b = signatures(sets)
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["id"], n, pa.array(a), pa.array(b)], ["doc_id", "id", "n", "s1", "s2"])

    return run


def _tagged(words: int, part):
    """``doc_id, tag, need, tokens``: ``part`` chooses of a set; the tag holds size and some bits of the set."""

    def run(batches):
        for batch in _by_size(batches):
            sets = shingle_sets(_bytes(batch), words)
            tags = [len(s) * _TAG + int(t) % _TAG for s, t in zip(sets, signatures(sets)[0].tolist(), strict=True)]
            need = [early(required(len(s))) for s in sets]
            arrays = [batch["doc_id"], pa.array(tags, pa.int64()), pa.array(need, pa.int64()), _lists([part(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "tag", "need", "tokens"])

    return run


TAGGED = "doc_id long, tag long, need long, tokens array<long>"


def _sketch(s: np.ndarray) -> np.ndarray:
    return s[: len(s) - required(len(s)) + early(len(s))]


def _prefixes(batches):
    """From a set's shared shingles with their counts: its prefix in order of count, its group's key, its bitmap."""
    for batch in batches:
        rows = []
        shared = batch["shared"]
        counts, tokens = shared.flatten().field("c").to_numpy(), shared.flatten().field("token").to_numpy().view(np.uint64)
        ends = shared.offsets.to_numpy() - shared.offsets[0].as_py()
        for doc_id, tag, start, end in zip(batch["doc_id"].to_pylist(), batch["tag"].to_pylist(), ends[:-1], ends[1:], strict=True):
            n, own = tag // _TAG, tokens[start:end]
            if len(own) < required(n):
                continue
            only = n - len(own)
            prefix = own[np.lexsort((own, counts[start:end]))][: n - required(n) + 1 - only]
            key = hashlib.blake2b(prefix.tobytes() + only.to_bytes(8, "little"), digest_size=16).digest()
            at = mix(own) % np.uint64(64 * BITMAP)
            odd = np.bincount(at.astype(np.int64), minlength=64 * BITMAP).astype(np.uint8) & 1
            bits = np.packbits(odd).view(np.uint64)
            rows.append((doc_id, n, only, *np.frombuffer(key, np.int64).tolist(), prefix, bits))
        names = ["doc", "n", "only", "k1", "k2"]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*columns, _lists([r[5] for r in rows]), _lists([r[6] for r in rows])], [*names, "prefix", "bits"])


NODES = "doc long, n long, only long, k1 long, k2 long, prefix array<long>, bits array<long>"


def _may_link(x: str, y: str) -> Column:
    """Sizes within 80 % of each other, and enough shared shingles on both sides."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    enough = 9 * F.least(n - F.col(f"{x}.only"), m - F.col(f"{y}.only")) >= 4 * (n + m)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & enough


def _in_reach(x: str, y: str) -> Column:
    """Bounds from the place of a common shingle in both orders, and from the bits that differ.

    Shingles that no other set has come first in the order and never match, so
    places count from behind them; an odd number of differing shingles falls on
    each bit that differs.
    """
    n, m, i, j = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.pos", f"{y}.pos"))
    most = F.least(i, j) + 1 + F.least(n - F.col(f"{x}.only") - i - 1, m - F.col(f"{y}.only") - j - 1)
    apart = F.col(f"{x}.only") + F.col(f"{y}.only")
    for k in range(BITMAP):
        apart = apart + F.bit_count(F.col(f"{x}.bits")[k].bitwiseXOR(F.col(f"{y}.bits")[k]))
    return (9 * most >= 4 * (n + m)) & (9 * apart <= n + m)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets link."""
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("tokens").alias(f"{name}_tokens")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.filter(9 * shared >= 4 * (F.size("a_tokens") + F.size("b_tokens"))).select("a", "b")


def _counted(tokens: DataFrame) -> DataFrame:
    """Shingles that more than one set has, cut, so that the rows of a common one can be divided beside them."""
    return cut_lineage(tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"))


def _leaders(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups by size and prefix; pairs of a group's first set with its leader and with its members."""
    groups = nodes.groupBy("n", "k1", "k2").agg(F.min("doc").alias("grp"))
    grouped = cut_lineage(nodes.join(groups.hint("merge"), ["n", "k1", "k2"]))
    firsts = grouped.filter("doc = grp").select("grp", "n", "only", F.explode("prefix").alias("token"))
    # The set with the fewest shingles of its own is the nearest to what a list has in common.
    heads = cut_lineage(firsts.groupBy("token").agg(F.min(F.struct("only", "grp", "n")).alias("y")))
    met = firsts.alias("x").join(heads.hint("merge"), "token").filter("x.grp <> y.grp").filter(_may_link("x", "y"))
    counted = met.groupBy(F.col("x.grp").alias("b"), F.col("y.grp").alias("a")).agg(F.count("*").alias("c"))
    best = counted.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("minus"))).alias("best"))
    to_leader = best.select((-F.col("best.minus")).alias("a"), "b")
    to_first = grouped.filter("doc <> grp").select(F.col("grp").alias("a"), F.col("doc").alias("b"))
    return grouped, to_leader.unionByName(to_first)


def _open_lists(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Sets by prefix shingle with their component, in lists of several components; ``top`` has most of a list's sets."""
    labelled = nodes.join(labels.select(F.col("node").alias("doc"), "component").hint("merge"), "doc", "left")
    entries = labelled.select(
        "doc", F.coalesce("component", "doc").alias("comp"), "n", "only", "bits", F.posexplode("prefix").alias("pos", "token")
    )
    lists = entries.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token")
    lists = lists.agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    open_lists = cut_lineage(lists.select("token", F.col("top.comp").alias("top")))
    return cut_lineage(entries.join(open_lists.hint("merge"), "token"))


def _apart() -> Column:
    return F.col("x.comp") != F.col("y.comp")


def _to_top(entries: DataFrame) -> DataFrame:
    """For each set outside of a list's top component, the nearest of that component's sets: one pair for each two of them."""
    heads = entries.filter("comp = top").groupBy("token").agg(F.min(F.struct("only", "doc", "n", "pos", "bits", "comp")).alias("y"))
    heads = cut_lineage(heads)
    met = entries.alias("x").join(heads.hint("merge"), "token").filter(_apart() & _may_link("x", "y") & _in_reach("x", "y"))
    counted = met.groupBy(F.col("x.doc").alias("b"), F.col("y.comp").alias("comp"), F.col("y.doc").alias("a")).agg(F.count("*").alias("c"))
    best = counted.groupBy("b", "comp").agg(F.max(F.struct("c", (-F.col("a")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("a"), "b").distinct()


def _between(entries: DataFrame) -> DataFrame:
    """All pairs of sets from different components that meet in a prefix and pass all filters.

    A list's top component meets the list's others, never itself.
    """
    x, y = entries.filter("comp <> top").alias("x"), entries.alias("y").hint("merge")
    each_once = (F.col("y.comp") == F.col("y.top")) | (F.col("x.doc") < F.col("y.doc"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & _apart() & each_once & _may_link("x", "y") & _in_reach("x", "y"))
    return met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def _and_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links, written; ``labels`` again if there are none."""
    if links.isEmpty():
        return labels
    stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return cut_lineage(components(stars.unionByName(links)))


def _reached(rows: DataFrame, heads: DataFrame, words: int) -> DataFrame:
    """``n, s1, s2, component`` of the sets that several texts have or that link with others."""
    spark = rows.sparkSession
    sets = heads.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    sets = cut_lineage(sets)
    reps = sets.select(F.col("rep").alias("doc_id")).distinct()

    # Joins on the id of all documents: the kept ids grow with them and are not sent to every task.
    sketches = rows.mapInArrow(_tagged(words, _sketch), TAGGED).join(reps.hint("merge"), "doc_id", "left_semi")
    # Read for the counts and for the hits; the copy goes when both are done.
    with written(sketches) as sketches:
        release(spark)
        tokens = sketches.select("doc_id", "tag", "need", F.explode("tokens").alias("token"))
        counted = _counted(tokens)
        # The counts' shuffle would lie beside the next one's.
        release(spark)
        hits = tokens.join(counted.hint("merge"), "token", "left_semi").groupBy("doc_id", "tag", "need").count()
        near = cut_lineage(hits.filter("count >= need").select("doc_id").distinct())
    release(spark)

    kept = rows.join(near.hint("merge"), "doc_id", "left_semi").mapInArrow(_tagged(words, lambda s: s), TAGGED)
    kept = cut_lineage(kept.select("doc_id", "tag", "tokens"))
    release(spark)
    tokens = kept.select("doc_id", "tag", F.explode("tokens").alias("token"))
    counted = _counted(tokens)
    release(spark)
    shared = tokens.join(counted.hint("merge"), "token")
    # A set: rows that repeat a document give each shingle once.
    shared = shared.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("c", "token")).alias("shared"))
    nodes = cut_lineage(shared.mapInArrow(_prefixes, NODES))
    release(spark)

    grouped, pairs = _leaders(nodes)
    links = cut_lineage(_verified(pairs, kept))
    labels = cut_lineage(components(links))
    for pairs in (_to_top, _between):
        labels = _and_links(labels, cut_lineage(_verified(pairs(_open_lists(grouped, labels)), kept)))
    release(spark)
    reached = sets.join(labels.hint("merge"), sets["rep"] == labels["node"], "left").filter("copies > 1 OR component IS NOT NULL")
    return reached.select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))


def near_components(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """``row, id, n_shingles, component`` of every row: the smallest ``row`` that it reaches by links, null if it links with none.

    ``rows``: a written table ``row, id, text`` whose ``row`` is unique and not
    null. Rows with the same set are linked.
    """
    spark = rows.sparkSession
    rows = rows.withColumnRenamed("row", "doc_id")
    heads = cut_lineage(rows.mapInArrow(_heads(words), "doc_id long, id long, n long, s1 long, s2 long"))
    reached = cut_of(spark, lambda: _reached(rows.select("doc_id", "text"), heads, words))
    # One row per set against all rows, both shuffled, so the rows of a common set can be split.
    out = heads.join(reached.hint("merge"), ["n", "s1", "s2"], "left")
    return out.select(F.col("doc_id").alias("row"), "id", F.col("n").alias("n_shingles"), "component")


def join_near(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near duplicates by word shingles: ``doc_id, n_shingles, component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable by links, itself included.
    Null and empty texts and texts without words have no shingles and link with
    nothing; fewer words than a shingle's are one shingle. Rows that repeat an
    id, or have none, are texts of their own that link like any others; a
    component's id is null only if none of its rows has one. No rows give no rows.
    """
    rows = cut_lineage(texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text"))
    found = cut_lineage(near_components(rows, words).drop("row"))
    linked = found.filter("component IS NOT NULL")
    # One row per component against all linked rows: those of a large one can be split.
    least = cut_lineage(linked.groupBy("component").agg(F.min("id").alias("component_id")))
    both = linked.join(least.hint("merge"), "component").unionByName(found.filter("component IS NULL").withColumn("component_id", F.col("id")))
    return both.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, md5_number(x) AS x FROM (SELECT doc_id, s, unnest(s) AS x FROM sets)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
