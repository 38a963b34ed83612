"""Merkle dataset manifest: a content-addressed store of digest-to-children records, and proofs by descent from its root.

Rows become leaves, the leaves of a tree ascend by id, and runs of ``fanout``
consecutive nodes become their hash until one is left; the trees' tops are the
leaves of one more tree, whose top is the root. Several levels of records make
a page, stored under the digest of its top, so a tree of any size is built and
descended in a logarithm of its size of Spark steps, to the base of a page's
width (``fanout ** levels`` nodes).

A leaf request descends from the root by the digits of its rank, collecting
the children that it does not select. Requests that share a page meet its
records once; each page adds a segment to the path, reversed as it goes from
the leaf upwards.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from qualityspark.llm.common import cut_lineage

FANOUT, LEVELS = 2, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PAGES = "tree string, page long, n long, digest string, depth int, records array<struct<digest:string,children:array<string>>>"
_RECORDS = pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))
_PATH = pa.list_(pa.list_(pa.string()))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 in lowercase hex over each field as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def tree_key(name: Column) -> Column:
    """A tree's name as a text that is never null and sorts null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def _height(n: int, fanout: int) -> int:
    """Levels until ``n`` nodes have become one."""
    height = 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` (a written table with ``tree``) with ``rank``, from 0 within each tree by ``order``, and ``n``, the tree's nodes.

    Range partitions are sorted one by one; what stands before a partition in
    its trees is a sum over one number per partition and tree. ``order`` ends
    with a column that no two rows share, so equal rows can be divided too.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    laid = cut_lineage(laid.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    held = laid.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("held"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = cut_lineage(held.select("tree", "part", "first", before.alias("before"), F.sum("held").over(own).alias("n")))
    rank = F.col("before") + F.col("place") - F.col("first")
    return laid.join(held, ["tree", "part"]).select(*nodes.columns, rank.alias("rank"), "n")


def _pages(fanout: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, depths, stored = [], [], []
            for n, nodes in zip(batch["n"].to_pylist(), batch["nodes"], strict=True):
                now = nodes.values.field("digest").to_pylist()
                depth, records = min(levels, _height(n, fanout)), []
                for _ in range(depth):
                    runs = [now[i : i + fanout] for i in range(0, len(now), fanout)]
                    now = [_hash(run) for run in runs]
                    records += [{"digest": d, "children": run} for d, run in zip(now, runs, strict=True)]
                tops.append(now[0])
                depths.append(depth)
                stored.append(records)
            made = [pa.array(tops, pa.string()), pa.array(depths, pa.int32()), pa.array(stored, _RECORDS)]
            yield pa.RecordBatch.from_arrays([batch["tree"], batch["page"], batch["n"], *made], ["tree", "page", "n", "digest", "depth", "records"])

    return run


def grow(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """Pages of records, lowest layer first, and ``tree, digest`` of each tree's top.

    ``nodes``: a written table ``tree, rank, digest, n``. A tree's last run may
    be shorter, even one node; a tree of one node is its own top. A layer is
    ``digest, depth, records``, one row per digest however often it occurs.
    """
    span = fanout**levels
    layers, most = [], nodes.agg(F.max("n")).first()[0] or 0
    now = nodes.select("tree", "rank", "digest", "n")
    tops = now.filter("n = 1").select("tree", "digest")
    while most > 1:
        page = F.floor(F.col("rank") / span).alias("page")
        filled = now.filter("n > 1").groupBy("tree", page, "n").agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes"))
        pages = cut_lineage(filled.mapInArrow(_pages(fanout, levels), PAGES))
        layers.append(cut_lineage(pages.select("digest", "depth", "records").dropDuplicates(["digest"])))
        now = pages.select("tree", F.col("page").alias("rank"), "digest", F.expr(f"(n + {span - 1}) DIV {span}").alias("n"))
        tops = tops.unionByName(now.filter("n = 1").select("tree", "digest"))
        most = -(-most // span)
    return layers, tops


def _few(batches: Iterator[pa.RecordBatch], most: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    """Batches that ask for at most some nodes, but for single pages."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pa.compute.list_value_length(batch["asked"]).to_pylist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def _descent(fanout: int, payload: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            counts = pa.compute.list_value_length(batch["asked"]).to_pylist()
            each = batch["asked"].flatten()
            ranks = iter(each.field("rank").to_pylist())
            rows, digests, paths, places = [], [], [], []
            pages = zip(counts, *(batch[c].to_pylist() for c in ("digest", "depth", "siblings", "digits")), batch["records"], strict=True)
            for i, (count, top, depth, above, before, records) in enumerate(pages):
                children = dict(zip(records.values.field("digest").to_pylist(), records.values.field("children").to_pylist(), strict=True))
                for rank in itertools.islice(ranks, count):
                    node, segment, digits = top, [], []
                    for level in range(depth - 1, -1, -1):
                        others, digit = children[node], rank // fanout**level % fanout
                        segment.append(others[:digit] + others[digit + 1 :])
                        digits.append(digit)
                        node = others[digit]
                    rows.append(i)
                    digests.append(node)
                    paths.append(segment[::-1] + above)
                    places.append(digits[::-1] + before)
            rows = pa.array(rows, pa.int64())
            arrays = [batch["tree"].take(rows), batch["top"].take(rows), each.field("rank"), pa.array(digests, pa.string())]
            arrays += [pa.array(paths, _PATH), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*arrays, *(each.field(c) for c in payload)], [*_PROVED.names, *payload])

    return run


_PROVED = StructType(
    [
        StructField("tree", StringType()),
        StructField("top", StringType()),
        StructField("rank", LongType()),
        StructField("digest", StringType()),
        StructField("siblings", ArrayType(ArrayType(StringType()))),
        StructField("digits", ArrayType(IntegerType())),
    ]
)


def descend(layers: list[DataFrame], starts: DataFrame, asked: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Proofs of requests, from the tops of their trees.

    ``starts``: ``tree, top`` and the ``siblings`` and ``digits`` that lie above
    it. ``asked``: a written table ``tree, rank, n`` and any others. Returns ``tree,
    top, rank, digest, siblings, digits`` and the others: for each level, from
    the node upwards, the others of its run and its own place among them.
    """
    span = fanout**levels
    payload = [c for c in asked.columns if c not in ("tree", "rank", "n")]
    # What is asked of each page: nodes in the lowest layer, pages above.
    pages, now = [], asked.filter("n > 1").select("tree", F.col("n").alias("left"), F.struct("rank", *payload).alias("one"))
    for _ in layers:
        page = F.floor(F.col("one.rank") / span).alias("page")
        pages.append(cut_lineage(now.groupBy("tree", page, "left").agg(F.collect_list("one").alias("asked"))))
        up = pages[-1].select("tree", F.expr(f"(left + {span - 1}) DIV {span}").alias("left"), F.struct(F.col("page").alias("rank")).alias("one"))
        now = up.filter("left > 1")
    schema = lambda extra: StructType([*_PROVED.fields, *(asked.schema[c] for c in extra)])
    lower = None
    for layer in range(len(layers) - 1, -1, -1):
        # A tree's descent begins in the layer that has a single page of it.
        first = pages[layer].filter(F.col("left") <= span).join(starts, "tree").withColumn("digest", F.col("top"))
        here = first.select("tree", "page", "asked", "top", "digest", "siblings", "digits")
        if lower is not None:
            below = lower.withColumnRenamed("rank", "page").join(pages[layer].select("tree", "page", "asked").hint("merge"), ["tree", "page"])
            here = here.unionByName(below.select(*here.columns))
        # Cut, and stored pages are a plain scan, so pages that many places share can be divided.
        here = cut_lineage(here).join(layers[layer].hint("merge"), "digest")
        own = payload if layer == 0 else []
        lower = here.mapInArrow(_descent(fanout, own), schema(own))
    alone = asked.filter("n = 1").join(starts, "tree").withColumn("digest", F.col("top")).select(*_PROVED.names, *payload)
    return alone if lower is None else lower.unionByName(alone)


def fold(digest: Column, siblings: Column, digits: Column, fanout: int = FANOUT) -> Column:
    """The root that a node and the others of its runs lead to."""

    def up(node: Column, level: Column) -> Column:
        others, digit = level["siblings"], level["digits"]
        left, right = F.slice(others, F.lit(1), digit), F.slice(others, digit + 1, F.lit(fanout))
        return F.sha2(F.concat(F.array_join(left, ""), node, F.array_join(right, "")), 256)

    return F.aggregate(F.arrays_zip(siblings.alias("siblings"), digits.alias("digits")), digest, up)


@dataclass
class Manifest:
    """Leaves, the stored layers of the trees and of the tree above them, and the trees' tops.

    ``leaves``: ``tree, rank, n, leaf``, the id and the columns that came along.
    ``tops``: ``tree, digest, rank, n``, the leaves of the upper tree.
    """

    leaves: DataFrame
    layers: list[DataFrame]
    tops: DataFrame
    upper: list[DataFrame]
    root: DataFrame
    fanout: int
    levels: int


def build(rows: DataFrame, id_col: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """A manifest of ``rows``: ``tree, leaf``, the id and any other columns, which come along with the leaves.

    Leaves ascend by id, a null id first, then by digest; rows that repeat are
    leaves of their own. No rows give a manifest without root.
    """
    each = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    leaves = cut_lineage(ranked(each, id_col, "leaf", "row").drop("row"))
    layers, tops = grow(leaves.select("tree", "rank", F.col("leaf").alias("digest"), "n"), fanout, levels)
    above = cut_lineage(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"))
    tops = cut_lineage(ranked(above, "name"))
    upper, root = grow(tops.select("tree", "rank", "digest", "n"), fanout, levels)
    return Manifest(leaves, layers, tops, upper, cut_lineage(root), fanout, levels)


def prove(manifest: Manifest, asked: DataFrame | None = None) -> DataFrame:
    """Proofs of ``asked``, some rows of ``manifest.leaves`` (all, if not given): ``subroot, root, siblings, digits`` beside them.

    ``siblings`` holds, level by level from the leaf to the root, the others of
    its run from left to right; ``digits`` its own place in each run.
    """
    asked = manifest.leaves if asked is None else cut_lineage(asked)
    root = manifest.root.first()
    nothing = [F.array().cast("array<array<string>>").alias("siblings"), F.array().cast("array<int>").alias("digits")]
    start = manifest.root.select("tree", F.col("digest").alias("top"), *nothing)
    names = descend(manifest.upper, start, manifest.tops.select("tree", "rank", "n", "name"), manifest.fanout, manifest.levels)
    starts = cut_lineage(names.select(F.col("name").alias("tree"), F.col("digest").alias("top"), "siblings", "digits"))
    found = descend(manifest.layers, starts, asked, manifest.fanout, manifest.levels)
    return found.withColumnRenamed("top", "subroot").withColumn("root", F.lit(root and root["digest"])).drop("digest")


OP11_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, row_number() OVER () AS r, d || s || l AS front, n_chars, t,
    CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS tampered
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS d, coalesce(strlen(source) || ':' || source, '-') AS s,
          coalesce(strlen(lang) || ':' || lang, '-') AS l, coalesce(strlen(text) || ':' || text, '-') AS t,
          -- crc32 of the id's decimal digits: each byte, then eight shifts (-1)
          xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
              lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS crc
        FROM documents)),
leaves AS (
  SELECT r, doc_id, lang, sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || t) AS leaf,
    sha256(front || coalesce(strlen(tampered::VARCHAR) || ':' || tampered, '-') || t) AS presented FROM rows),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, rank, n, leaf AS digest FROM ranked
  UNION ALL
  SELECT lang, level + 1, rank // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY rank)) FROM nodes WHERE n > 1 GROUP BY lang, level, rank // 2),
tops AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, rank, n, digest FROM tops
  UNION ALL
  SELECT level + 1, rank // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY rank)) FROM upper WHERE n > 1 GROUP BY level, rank // 2),
climb AS (
  SELECT r, lang, 0 AS level, rank, n, presented AS digest, '' AS proof FROM ranked
  UNION ALL
  SELECT c.r, c.lang, c.level + 1, c.rank // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.rank % 2 = 1 THEN s.digest || c.digest ELSE c.digest || coalesce(s.digest, '') END), c.proof || coalesce(s.digest, '')
  FROM climb c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.rank = xor(c.rank, 1) WHERE c.n > 1),
climb_on AS (
  SELECT c.r, 0 AS level, t.rank, t.n, c.digest, c.proof FROM climb c JOIN tops t ON t.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.r, c.level + 1, c.rank // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.rank % 2 = 1 THEN s.digest || c.digest ELSE c.digest || coalesce(s.digest, '') END), c.proof || coalesce(s.digest, '')
  FROM climb_on c LEFT JOIN upper s ON s.level = c.level AND s.rank = xor(c.rank, 1) WHERE c.n > 1)
SELECT l.doc_id, l.leaf, t.digest AS subroot, u.digest AS root, sha256(c.proof) AS proof_sha256, c.digest AS folded_root, c.digest = u.digest AS verified
FROM leaves l JOIN climb_on c ON c.r = l.r AND c.n = 1 JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN upper u ON u.n = 1
"""
