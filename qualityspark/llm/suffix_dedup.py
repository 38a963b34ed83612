"""Suffix-array dedup: remove every byte that a repeated string of ``match`` bytes covers.

A string repeats if two suffixes share it as their beginning, and then two
neighbours in the order of suffixes do. Suffixes are range-partitioned by their
leading bytes at sampled splitters, each bucket sorts its own by multikey
quicksort, eight bytes at a time, and neighbours are compared, also those on
both sides of a splitter.

Two things keep this small. Suffixes travel in families: in each string of
``match`` bytes, the run of ``anchor`` bytes with the least hash is its anchor,
so equal strings have equal anchors at equal places; neighbouring suffixes with
one anchor share a row, which is partitioned by what begins at the anchor.
And only families whose anchor occurs twice take part, as no other suffix can
have a partner.

Buckets settle the families whose anchor lies within them. For the first and
the last anchor of a bucket, which may go on in the next one and may be very
common, the suffixes themselves are partitioned again, ties by their place, so
that even equal ones can be divided; of those, the first and the last in each
bucket are compared across its borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.llm.common import cut_lineage, release, texts
from qualityspark.llm.shingles import mix

MATCH, ANCHOR = 200, 96
#: Bytes of a text whose suffixes are handled together; a longer text is several rows.
SEGMENT = 1 << 18
#: Bytes that a bucket holds on average at most, and suffixes that are sorted at once, but for one anchor's.
BUCKET, AT_ONCE = 1 << 23, 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))

SEGMENTS = "row long, doc_id long, start long, n_bytes long, piece binary"
ANCHORS = "row long, start long, keys array<long>, spots array<int>"
FAMILIES = "row long, at long, stop long, lead binary, left binary, n int"
SUFFIXES = "row long, at long, stop long, suffix binary, n int"


def _slabs(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches of at most some bytes in ``column``, but for single rows."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch[column]).to_pylist()):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def _segments(match: int, segment: int):
    """Pieces of ``segment`` bytes, each with the ``match - 1`` bytes behind it."""

    def run(batches):
        for batch in _slabs(batches, "text"):
            rows = []
            for row, doc_id, text in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                for start in range(0, max(len(text), 1), segment):
                    rows.append((row, doc_id, start, len(text), text[start : start + segment + match - 1]))
            columns = [*zip(*rows, strict=True)] or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "doc_id", "start", "n_bytes", "piece"])

    return run


def run_hashes(flat: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes at each place."""
    n = len(flat)
    if n < size:
        return np.empty(0, np.uint64)
    power = np.cumprod(np.full(n, _B))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[flat] * power)])
    back = np.cumprod(np.full(n - size + 1, np.uint64(pow(int(_B), -1, 1 << 64))))
    return mix((total[size:] - total[:-size]) * back)


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive values the place of the first least one."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    blocks = np.concatenate([values, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    place = np.arange(blocks.size).reshape(blocks.shape)
    head = np.minimum.accumulate(blocks, axis=1)
    fresh = np.ones(blocks.shape, bool)
    fresh[:, 1:] = blocks[:, 1:] < head[:, :-1]
    head_at = np.maximum.accumulate(np.where(fresh, place, 0), axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
    tail_at = np.minimum.accumulate(np.where(blocks == tail, place, blocks.size)[:, ::-1], axis=1)[:, ::-1].ravel()
    head, tail = head.ravel()[width - 1 : n], tail.ravel()[: n - width + 1]
    return np.where(tail <= head, tail_at[: n - width + 1], head_at[width - 1 : n])


def _anchors(match: int, anchor: int):
    """Families of each piece: the anchor's hash, and first suffix, anchor and last suffix in one number."""
    width = match - anchor + 1

    def run(batches):
        for batch in _slabs(batches, "piece"):
            size = np.array(pa.compute.binary_length(batch["piece"]).to_pylist(), np.int64)
            flat = np.frombuffer(b"".join(batch["piece"].to_pylist()), np.uint8)
            hashes = run_hashes(flat, anchor)
            at = first_least(hashes, width)
            base = np.cumsum(size) - size
            count = np.maximum(size - (match - 1), 0)
            own = np.repeat(np.arange(len(size)), count)
            suffix = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + base[own]
            chosen = at[suffix]
            fresh = np.ones(len(own), bool)
            fresh[1:] = (chosen[1:] != chosen[:-1]) | (own[1:] != own[:-1])
            first = np.flatnonzero(fresh)
            last = np.concatenate([first[1:], [len(own)]]) - 1 if len(first) else first
            low, piece = suffix[first], own[first]
            spots = ((low - base[piece]) << 14) | ((chosen[first] - low) << 7) | (suffix[last] - low)
            ends = np.searchsorted(piece, np.arange(len(size) + 1)).astype(np.int32)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            keys, spots = hashes[chosen[first]].view(np.int64), spots.astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch["row"], batch["start"], lists(keys), lists(spots)], ["row", "start", "keys", "spots"])

    return run


def _intervals(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that meet made one."""
    merged: list[tuple[int, int]] = []
    for low, high in spans:
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _families(match: int):
    """Families as bytes before and from their anchor; what repeats within a slab is settled here and sent once."""

    def run(batches):
        for batch in _slabs(batches, "piece"):
            seen: dict[tuple[bytes, int], list] = {}
            pieces = zip(batch["row"].to_pylist(), batch["start"].to_pylist(), batch["piece"].to_pylist(), batch["marks"], strict=True)
            for row, start, piece, marks in pieces:
                spots = np.sort(marks.values.to_numpy().view(np.uint32)).tolist()
                for spot in spots:
                    low, to_anchor, more = spot >> 14, spot >> 7 & 127, spot & 127
                    key = (piece[low : low + more + match], to_anchor)
                    seen.setdefault(key, []).append((row, start + low))
            rows, covered = [], {}
            for (family, to_anchor), places in seen.items():
                row, at = places[0] if len(places) == 1 else (None, None)
                rows.append((row, at, None, family[to_anchor:], family[:to_anchor], min(len(places), 2)))
                if len(places) > 1:
                    for row, at in places:
                        covered.setdefault(row, []).append((at, at + len(family)))
            for row, spans in covered.items():
                rows += [(row, low, high, None, None, None) for low, high in _intervals(sorted(spans))]
            columns = [*zip(*rows, strict=True)] or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int32()]
            names = ["row", "at", "stop", "lead", "left", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def multikey_order(words: list, count: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Multikey quicksort of ``count`` strings, word by word, all ties of one depth at once.

    ``words``: for each depth a function from string numbers to their words
    there. Returns the order, and for each depth which strings of the order begin
    a new run of equal ones up to that depth.
    """
    order, fresh, starts = np.arange(count), np.zeros(count, bool), []
    fresh[:1] = True
    for word in words:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        left = np.flatnonzero(tied)
        if len(left):
            run = np.cumsum(fresh)[left]
            value = word(order[left])
            inner = np.lexsort((value, run))
            order[left] = order[left][inner]
            value = value[inner]
            differs = np.ones(len(left), bool)
            differs[1:] = value[1:] != value[:-1]
            fresh[left] |= differs
        starts.append(fresh.copy())
    return order, starts


def _big_words(flat: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number that compares like them; zeros behind the end."""
    padded = np.concatenate([flat, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(flat) + 1, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


class _Bucket:
    """Families of one bucket, and their suffixes as places in one buffer."""

    def __init__(self, match: int, anchor: int, table: pa.Table):
        self.match, self.anchor = match, anchor
        left, lead = table["left"].to_pylist(), table["lead"].to_pylist()
        self.flat = b"".join(x for pair in zip(left, lead, strict=True) for x in pair)
        self.words = _big_words(np.frombuffer(self.flat, np.uint8))
        self.left = np.array([len(x) for x in left], np.int64)
        self.size = self.left + np.array([len(x) for x in lead], np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.n = table["n"].to_numpy().astype(np.int64)
        self.row, self.at = table["row"].to_pylist(), table["at"].to_pylist()

    def _word(self, depth: int):
        """A family's word at a depth, as far as the family reaches."""

        def get(rows):
            held = np.clip(self.size[rows] - 8 * depth, 0, 8).astype(np.uint64)
            value = self.words[np.minimum(self.base[rows] + 8 * depth, len(self.words) - 1)]
            keep = np.where(held == 0, np.uint64(0), ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(held, np.uint64(1)))))
            return value & keep

        return get

    def sort_families(self):
        """Order of the families, starts of equal anchors, starts of equal families."""
        lead = [lambda rows, d=d: self.words[self.base[rows] + self.left[rows] + 8 * d] for d in range(self.anchor // 8)]
        shape = [lambda rows: self.left[rows], lambda rows: self.size[rows]]
        whole = [self._word(d) for d in range(int(self.size.max(initial=0)) // 8 + 1)]
        order, starts = multikey_order([*lead, *shape, *whole], len(self.size))
        return order, starts[self.anchor // 8 - 1], starts[-1]

    def sort_suffixes(self, families: np.ndarray, weight: np.ndarray):
        """Suffixes of distinct families in order: family's place in ``families``, suffix within it, its run, and runs' weights."""
        count = self.size[families] - (self.match - 1)
        own = np.repeat(np.arange(len(families)), count)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        place = self.base[families][own] + inner
        order, starts = multikey_order([lambda rows, d=d: self.words[place[rows] + 8 * d] for d in range(self.match // 8)], len(own))
        run = np.cumsum(starts[-1]) - 1
        return own[order], inner[order], place[order], run, np.bincount(run, weights=weight[own[order]]).astype(np.int64)


def _groups_at_once(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive groups of at most ``most`` in all, but for single groups."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _settle(match: int, anchor: int):
    """One bucket of families: what repeats, and the suffixes of its first and last anchor."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        bucket = _Bucket(match, anchor, pa.Table.from_batches(batches))
        order, new_anchor, new_family = bucket.sort_families()
        first = np.flatnonzero(new_family)
        twin = np.cumsum(new_family) - 1
        weight = np.bincount(twin, weights=bucket.n[order]).astype(np.int64)
        found: list[tuple[int, int, int]] = []
        alone = np.bincount(twin) == 1
        for i in np.flatnonzero((weight[twin] > 1) & (bucket.n[order] == 1)):
            f = order[i]
            found.append((bucket.row[f], bucket.at[f], bucket.at[f] + int(bucket.size[f])))

        # Distinct families by anchor; an anchor matters if one of them is single and has company, or if it may go on elsewhere.
        family, group = order[first], np.cumsum(new_anchor)[first] - 1
        groups = group[-1] + 1
        single = (weight == 1) & alone
        is_open = np.zeros(groups, bool)
        is_open[[0, -1]] = True
        matters = is_open | ((np.bincount(group) > 1) & (np.bincount(group, weights=single) > 0))
        sizes = np.bincount(group, weights=(bucket.size[family] - (match - 1)) * matters[group]).astype(np.int64)
        sent = []
        for low, high in _groups_at_once(sizes, AT_ONCE):
            inside = np.flatnonzero((group >= low) & (group < high) & matters[group])
            if not len(inside):
                continue
            own, inner, place, run_of, total = bucket.sort_suffixes(family[inside], weight[inside])
            hit = (total[run_of] > 1) & single[inside][own]
            hits = np.lexsort((inner[hit], own[hit]))
            own_hit, inner_hit = own[hit][hits], inner[hit][hits]
            begins = np.ones(len(own_hit), bool)
            begins[1:] = (own_hit[1:] != own_hit[:-1]) | (inner_hit[1:] != inner_hit[:-1] + 1)
            at_begin = np.flatnonzero(begins)
            at_end = np.concatenate([at_begin[1:], [len(own_hit)]]) - 1 if len(at_begin) else at_begin
            for a, b in zip(at_begin.tolist(), at_end.tolist(), strict=True):
                f = family[inside[own_hit[a]]]
                found.append((bucket.row[f], bucket.at[f] + int(inner_hit[a]), bucket.at[f] + int(inner_hit[b]) + match))
            opened = np.flatnonzero(np.diff(run_of, prepend=-1) & is_open[group[inside[own]]])
            for i in opened.tolist():
                n, f = int(total[run_of[i]]), family[inside[own[i]]]
                row, at = (bucket.row[f], bucket.at[f] + int(inner[i])) if n == 1 else (None, None)
                sent.append((row, at, None, bucket.flat[place[i] : place[i] + match], min(n, 2)))
        yield from _suffix_batches([(*f, None, None) for f in found] + sent)

    return run


def _suffix_batches(rows: list[tuple], most: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 3 + [pa.binary(), pa.int32()]
    for start in range(0, len(rows), most):
        columns = zip(*rows[start : start + most], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "at", "stop", "suffix", "n"])


def _settle_suffixes(match: int):
    """One bucket of single suffixes: what repeats, and the first and last run for the buckets beside it."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        suffix = table["suffix"].to_pylist()
        words = np.frombuffer(b"".join(suffix), ">u8").reshape(len(suffix), match // 8).astype(np.uint64)
        order, starts = multikey_order([lambda rows, d=d: words[rows, d] for d in range(match // 8)], len(suffix))
        n = table["n"].to_numpy().astype(np.int64)[order]
        run_of = np.cumsum(starts[-1]) - 1
        total = np.bincount(run_of, weights=n).astype(np.int64)
        row, at = table["row"].to_pylist(), table["at"].to_pylist()
        rows = []
        for i in order[(n == 1) & (total[run_of] > 1)].tolist():
            rows.append((row[i], at[i], at[i] + match, None, None))
        for at_run in sorted({0, int(run_of[-1])}):
            i = int(order[np.searchsorted(run_of, at_run)])
            here = (row[i], at[i]) if total[at_run] == 1 else (None, None)
            rows.append((*here, None, suffix[i], int(min(total[at_run], 2))))
        yield from _suffix_batches(rows)

    return run


def _merge(batches):
    for batch in batches:
        spans = [_intervals(sorted((s["at"], s["stop"]) for s in each)) for each in batch["spans"].to_pylist()]
        kind = pa.list_(pa.struct([("at", pa.int64()), ("stop", pa.int64())]))
        arrays = pa.array([[{"at": a, "stop": b} for a, b in each] for each in spans], kind)
        yield pa.RecordBatch.from_arrays([batch["row"], arrays], ["row", "spans"])


def _kept(segment: int):
    """What stays of each piece, which ends where the next one begins."""

    def run(batches):
        for batch in _slabs(batches, "piece"):
            out = []
            for start, piece, spans in zip(batch["start"].to_pylist(), batch["piece"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                parts, at, end = [], start, start + min(len(piece), segment)
                for span in spans or ():
                    if span["stop"] > at and span["at"] < end:
                        parts.append(piece[at - start : max(span["at"], at) - start])
                        at = min(span["stop"], end)
                parts.append(piece[at - start : end - start])
                out.append(b"".join(parts))
            names = ["row", "doc_id", "start", "n_bytes", "spans"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(out, pa.binary())], [*names, "kept"])

    return run


def _joined(batches):
    """Whole texts from the pieces of long ones."""
    for batch in batches:
        kept = [b"".join(p["kept"] for p in sorted(pieces, key=lambda p: p["start"])) for pieces in batch["pieces"].to_pylist()]
        names = ["doc_id", "n_bytes", "spans"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(kept, pa.binary())], [*names, "kept"])


def _buckets(rows: DataFrame, *sizes: str) -> int:
    spark = rows.sparkSession
    size = rows.agg(F.sum(sum((F.length(c) for c in sizes[1:]), F.length(sizes[0])))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))


def repeated_spans(segments: DataFrame, match: int = MATCH, anchor: int = ANCHOR) -> DataFrame:
    """``row, at, stop``: spans of bytes, in any order, that strings of ``match`` bytes with a second place cover."""
    spark = segments.sparkSession
    pieces = segments.select("row", "start", "piece").filter(F.length("piece") >= match)
    anchors = cut_lineage(pieces.mapInArrow(_anchors(match, anchor), ANCHORS))
    each = anchors.select("row", "start", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("spots").alias("spot"))))
    # Cut: one row per anchor that repeats, beside which the rows of a common one can be divided.
    shared = cut_lineage(each.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    marks = cut_lineage(each.join(shared.hint("merge"), "key").groupBy("row", "start").agg(F.collect_list("spot").alias("marks")))
    release(spark)
    families = cut_lineage(pieces.join(marks.hint("merge"), ["row", "start"]).mapInArrow(_families(match), FAMILIES))
    release(spark)

    sent = families.filter("lead IS NOT NULL").select("row", "at", "lead", "left", "n")
    dealt = sent.repartitionByRange(_buckets(sent, "lead", "left"), "lead", "left", "row", "at")
    settled = cut_lineage(dealt.mapInArrow(_settle(match, anchor), SUFFIXES))
    release(spark)
    sent = settled.filter("suffix IS NOT NULL").select("row", "at", "suffix", "n")
    dealt = sent.repartitionByRange(_buckets(sent, "suffix"), "suffix", "row", "at")
    last = cut_lineage(dealt.mapInArrow(_settle_suffixes(match), SUFFIXES))
    release(spark)
    # At most two rows a bucket.
    place = F.when(F.col("n") == 1, F.struct("row", "at"))
    borders = last.filter("suffix IS NOT NULL").groupBy("suffix").agg(F.sum("n").alias("n"), F.collect_list(place).alias("places"))
    across = borders.filter("n > 1").select(F.inline("places")).selectExpr("row", "at", f"at + {match} AS stop")
    done = [x.filter("stop IS NOT NULL").select("row", "at", "stop") for x in (families, settled, last)]
    return done[0].unionByName(done[1]).unionByName(done[2]).unionByName(across)


def deduplicate_passages(docs: DataFrame, match: int = MATCH, anchor: int = ANCHOR, segment: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the bytes of every string of ``match`` bytes that also starts elsewhere.

    Returns ``doc_id, n_bytes, spans, kept``, one row per row: ``spans`` are the
    maximal removed runs of bytes as ``at, stop``, null if there are none, and
    ``kept`` the remaining bytes, which may end within a character. Strings do
    not cross documents; the same document, repeated rows and null ids count
    like any others. Null text counts as empty. No rows give no rows. ``match``
    and ``anchor`` are multiples of eight, less than 128 apart.
    """
    if match % 8 or anchor % 8 or not 0 < anchor <= match < anchor + 128 or segment > SEGMENT:
        raise ValueError("match and anchor must be multiples of eight, less than 128 apart, and segments of 2**18 bytes at most")
    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    segments = cut_lineage(rows.mapInArrow(_segments(match, segment), SEGMENTS))
    spans = repeated_spans(segments, match, anchor).groupBy("row").agg(F.collect_list(F.struct("at", "stop")).alias("spans"))
    merged = cut_lineage(spans.mapInArrow(_merge, "row long, spans array<struct<at:long,stop:long>>"))
    release(docs.sparkSession)
    kept = segments.join(merged.hint("merge"), "row", "left")
    schema = "row long, doc_id long, start long, n_bytes long, spans array<struct<at:long,stop:long>>, kept binary"
    kept = kept.select("row", "doc_id", "start", "n_bytes", "piece", "spans").mapInArrow(_kept(segment), schema)
    whole = kept.filter(F.col("n_bytes") <= segment).select("doc_id", "n_bytes", "spans", "kept")
    parts = kept.filter(F.col("n_bytes") > segment).groupBy("row")
    parts = parts.agg(*(F.first(c).alias(c) for c in ("doc_id", "n_bytes", "spans")), F.collect_list(F.struct("start", "kept")).alias("pieces"))
    return whole.unionByName(parts.drop("row").mapInArrow(_joined, "doc_id long, n_bytes long, spans array<struct<at:long,stop:long>>, kept binary"))


OP13_SQL = """
WITH bytes AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (
  SELECT r, unnest(range(octet_length(b) - 199)) AS p, b FROM bytes WHERE octet_length(b) >= 200),
keyed AS (
  SELECT r, p, md5(b[p + 1:p + 200]) AS k FROM starts),
hits AS (
  SELECT r, p FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1)),
marked AS (
  SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS begins FROM hits),
spans AS (
  SELECT r, s, min(p) AS low, max(p) + 200 AS high FROM (SELECT r, p, sum(begins) OVER (PARTITION BY r ORDER BY p) AS s FROM marked) GROUP BY r, s),
gaps AS (
  SELECT b.r, s.low AS high, coalesce(lag(s.high) OVER (PARTITION BY b.r ORDER BY s.low), 0) AS low FROM bytes b JOIN spans s ON s.r = b.r
  UNION ALL
  SELECT b.r, octet_length(any_value(b.b)), coalesce(max(s.high), 0) FROM bytes b LEFT JOIN spans s ON s.r = b.r GROUP BY b.r),
kept AS (
  SELECT g.r, sha256(unhex(string_agg(CASE WHEN g.high > g.low THEN hex(b.b[g.low + 1:g.high]) ELSE '' END, '' ORDER BY g.low))) AS kept_sha256
  FROM gaps g JOIN bytes b ON b.r = g.r GROUP BY g.r)
SELECT b.doc_id, octet_length(b.b)::BIGINT AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans, kept_sha256
FROM bytes b JOIN kept k ON k.r = b.r LEFT JOIN (SELECT r, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r) s ON s.r = b.r
"""
