"""Best-fit packing of token pieces into sequences by minimum bin slack.

Documents become token ids, long ones are cut, and each bin is filled from the
longest length left with the combination that leaves the least slack, found by
a bitset subset-sum over the lengths still available. Only counts by length
matter for that, at most ``size`` numbers, so the plan is made from one small
histogram of all pieces, and a combination is taken as many times as the counts
allow. Pieces then find their place in the plan by their rank within a length.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from qualityspark.llm.common import cut_lineage, texts

SIZE = 1024
#: The vocabulary, and the same one as ranks.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_ID = 2
#: The vocabulary's own special token and its id.
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(vocabulary: str, ranks: str):
    """A function from texts to the ids of the byte-level BPE ``vocabulary``, by its file of ranks as far as that goes.

    The library of ranks is several times faster and gives the same ids, but
    fails on a run of about a million blanks or line ends. Such a text goes
    to the vocabulary itself.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
    whole = functools.cache(lambda: tokenizers.Tokenizer.from_file(public_tokenizers.path(vocabulary)))

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut_points(n: int, size: int) -> list[int]:
    """Where the pieces of ``n`` ids start: whole pieces at the end, the first takes what is left."""
    first = n % size or size
    return [0, *range(first, n, size)]


def _pieces(vocabulary: str, ranks: str, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            rows, kept = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(encode(text), END_ID).astype("<u4")
                starts = cut_points(len(ids), size)
                for piece, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    if with_ids:
                        kept.append(ids[start:end].astype(np.int32))
            columns = [*zip(*rows, strict=True)] or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def token_pieces(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    ranks: str = RANKS,
    size: int = SIZE,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Token pieces of whole documents: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return texts(docs, id_col, text_col).mapInArrow(_pieces(vocabulary, ranks, size, with_ids), schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``, by bitset subset-sum."""
    reached, used = [1], []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        most = min(counts[length], room // length)
        if most < 1:
            continue
        bits, step = reached[-1], 1
        left = most
        while left:  # 1, 2, 4, ... copies and the rest reach every number of copies
            step = min(step, left)
            bits |= (bits << (step * length)) & mask
            left -= step
            step *= 2
        reached.append(bits)
        used.append((length, most))
        if bits >> room:
            break
    total, chosen = reached[-1].bit_length() - 1, {}
    for (length, most), before in zip(reversed(used), reversed(reached[:-1]), strict=True):
        copies = next(c for c in range(most + 1) if total >= c * length and before >> (total - c * length) & 1)
        if copies:
            chosen[length] = copies
            total -= copies * length
    return chosen


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(times, combination) until no piece is left, each bin seeded with the longest one.

    At most one combination per length and number of copies that it can run out
    at, so fewer than ``size * ln(size) + size`` of them at any count of pieces.
    """
    counts, bins = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = fullest({k: v for k, v in counts.items() if v}, size - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[k] // m for k, m in chosen.items())
        for k, m in chosen.items():
            counts[k] -= times * m
            if not counts[k]:
                del counts[k]
        bins.append((times, chosen))
    return bins


def _slots(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, times, first sequence, offset), sorted by rank."""
    slots: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, chosen in bins:
        offset = 0
        for length in sorted(chosen, reverse=True):
            slots.setdefault(length, []).append((taken.get(length, 0), times, sequence, offset))
            taken[length] = taken.get(length, 0) + times * chosen[length]
            offset += length * chosen[length]
        sequence += times
    return {k: np.array(v, np.int64) for k, v in slots.items()}


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            given = dict(zip((f.name for f in batch["given"].type), batch["given"].flatten(), strict=True))
            length, rank = given["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for each in np.unique(length):
                own, rows = slots[int(each)], np.flatnonzero(length == each)
                first, times, start, at = own[np.searchsorted(own[:, 0], rank[rows], "right") - 1].T
                nth = rank[rows] - first
                sequence[rows] = start + nth % times
                offset[rows] = at + nth // times * each
            yield pa.RecordBatch.from_arrays([*given.values(), pa.array(sequence), pa.array(offset)], [*given, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Place pieces (``doc_id, piece, length`` and any others) into sequences of at most ``size``.

    Adds ``sequence_id`` and ``offset``, gapless from 0 in each sequence.
    ``pieces`` must be a written table: its rows are read for counts, for ranks
    and for the result. Lengths lie in 1..size. Equal lengths change places
    freely, so repeated rows need no order. No rows give no rows.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= size:
        raise ValueError(f"lengths must lie in 1..{size}")
    shared = spark.sparkContext.broadcast(_slots(plan_bins(counts, size)))
    # Ranks within a length, over parts of it, as one length may have a third of all rows. The given columns
    # travel in one of their own, so whatever they are called, they meet none of these.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select(F.struct(*(F.col(f"`{c}`") for c in pieces.columns)).alias("given"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).alias("part"))
    before = dealt.groupBy(F.col("given.length").alias("length"), "part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = before.select("length", "part", ahead.alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("given.length", "part").orderBy("given.doc_id", "given.piece"))
    met = dealt.withColumn("length", F.col("given.length")).withColumn("nth", nth).join(before, ["length", "part"])
    ranked = met.select("given", (F.col("ahead") + F.col("nth") - 1).alias("rank"))
    schema = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(_place(shared), schema)


def pack_documents(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    ranks: str = RANKS,
    size: int = SIZE,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise, cut and pack documents: one row per piece.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and
    ``ids``). A document is its ids, then id 2; null text counts as empty, so it
    is one piece of length 1. Only documents of more than ``size`` ids are cut.
    Rows that repeat an id are packed one by one.
    """
    return pack(cut_lineage(token_pieces(docs, vocabulary, ranks, size, with_ids, id_col, text_col)), size)
