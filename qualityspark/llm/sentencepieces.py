"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merges of a BPE model are taken from an agenda, best score first, then leftmost.
Each time the agenda offers a merge, a hash keyed by seed, document, place and
piece decides whether it is skipped; without dropout the ids are the model's
own. No piece spans a space, so a text is a row of chunks, and the agendas of
many chunks are worked off side by side in numpy. Only what no draw decides is
kept: the offers that a chunk meets after given skips.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.llm.common import texts

SPACE = "▁"
#: Stands for a SPACE that the text itself holds; no UTF-8 text has it.
_LITERAL = "\udfff"
#: Bytes of text at once; longest chunk in a matrix; occurrences to draw for at once.
SLAB, WIDE, BLOCK = 1 << 22, 32, 100_000
#: Distinct chunks, and agendas of chunks, to keep within a task before it starts anew.
WORDS, AGENDAS = 300_000, 500_000
#: An agenda that was never asked for, and one that was asked for once.
_NEW, _ONCE = -2, -1
#: Offers of a chunk, from its first on, that a kept agenda may have skipped.
BITS = 62
_NONE = np.iinfo(np.int32).max
_M = (1 << 64) - 1


class Model:
    """Pieces, their order of merging, and bytes for decoding, read from a model file.

    Without ``merges`` it can decode only.
    """

    def __init__(self, name: str, merges: bool = True):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        size = model.get_piece_size()
        self.size, self.wide = size, size + 0x110000
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece spans a space")
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        #: Symbols are ids of pieces, and ``size`` + code point for characters that are none.
        self.symbol = np.arange(0x110000, dtype=np.int32) + size
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(_LITERAL)] = size + ord(SPACE)
        rank = np.full(size, _NONE, np.int32)
        rank[plain] = [order[model.get_score(i)] for i in plain]
        pairs = {}
        for p, i in pieces.items() if merges else ():
            for at in range(1, len(p)):
                left, right = (pieces.get(h, size + ord(h) if len(h) == 1 else None) for h in (p[:at], p[at:]))
                if left is not None and right is not None:
                    pairs[left * self.wide + right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = rank
        #: The piece of each rank, -1 where several pieces share it.
        self.piece_of = np.full(len(scores), -1, np.int32)
        one = np.flatnonzero(np.bincount(rank[plain], minlength=len(scores)) == 1)
        self.piece_of[one] = np.argsort(rank, kind="stable")[np.searchsorted(np.sort(rank, kind="stable"), one)]
        self._pairs: dict = {}
        byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        said = [b""] * size
        for p, i in pieces.items():
            said[i] = p.replace(SPACE, " ").encode()
        for b, i in byte.items():
            said[i] = bytes([b])
        self.said_at = np.concatenate([[0], np.cumsum([len(s) for s in said])])
        self.said = np.frombuffer(b"".join(said), np.uint8)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, or -1."""
        key = left.astype(np.int64) * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], np.int32(-1))

    def pairs(self) -> dict:
        """The merges as a dictionary, made when a chunk first needs it."""
        if not self._pairs:
            self._pairs.update(zip(map(tuple, np.stack(np.divmod(self.keys, self.wide), 1).tolist()), self.merged.tolist(), strict=True))
        return self._pairs

    def ranks(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged >= 0, self.rank[merged], np.int32(_NONE))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def draws(key: np.ndarray, start: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """64 bits for one offer of the agenda: the chunk's key, where the merge starts, the piece it makes."""
    return _mix(key.astype(np.uint64) + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def draw(key: int, start: int, piece: int) -> int:
    """The same for one offer."""
    x = (key + start * 0x9E3779B97F4A7C15 + piece * 0xC2B2AE3D27D4EB4F) & _M
    x = ((x ^ (x >> 31)) * 0x7FB5D329728EA185) & _M
    x = ((x ^ (x >> 27)) * 0x81DADEF4BC2DD44D) & _M
    return x ^ (x >> 33)


def _side_by_side(
    model: Model, symbols: np.ndarray, size: np.ndarray, keys: np.ndarray, skip: int, skips: np.ndarray | None = None, offered: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Work off the agendas of all rows (padded with -1): symbols and how many are left of each row.

    With ``skips`` a row skips the offers whose bits are set there, whatever its
    key, and ``offered`` gets rows, starts and pieces of each round of offers.
    """
    out, left_over = symbols.copy(), size.copy()
    wide = symbols.shape[1]
    if wide < 2:
        return out, left_over
    column = np.arange(wide, dtype=np.intp)
    rows, now, start = np.arange(len(symbols)), symbols.copy(), np.tile(np.arange(wide, dtype=np.int16), (len(symbols), 1))
    offers = np.full(symbols.shape, _NONE, np.int32)
    paired = now[:, 1:] >= 0
    offers[:, :-1][paired] = model.ranks(model.merge(now[:, :-1][paired], now[:, 1:][paired]))
    for nth in itertools.count():
        best = offers.argmin(axis=1)
        open_ = np.flatnonzero(offers[np.arange(len(rows)), best] < _NONE)
        if not len(open_):
            break
        if len(open_) < 0.7 * len(rows):
            done = np.ones(len(rows), bool)
            done[open_] = False
            out[rows[done]] = now[done]
            rows, now, start, offers, best, keys = rows[open_], now[open_], start[open_], offers[open_], best[open_], keys[open_]
            skips = None if skips is None else skips[open_]
            open_ = np.arange(len(rows))
        at = best[open_]
        piece = model.piece_of[offers[open_, at]]
        tied = np.flatnonzero(piece < 0)
        if len(tied):
            piece[tied] = model.merge(now[open_[tied], at[tied]], now[open_[tied], at[tied] + 1])
        if skips is not None:
            offered.append((rows[open_], start[open_, at], piece))
        if skip or skips is not None and nth < BITS:
            skipped = (skips[open_] >> nth & 1 > 0) if skips is not None else draws(keys[open_], start[open_, at], piece) < np.uint64(skip)
            offers[open_[skipped], at[skipped]] = _NONE
            open_, at, piece = open_[~skipped], at[~skipped], piece[~skipped]
            if not len(open_):
                continue
        move = np.minimum(column + (column > at[:, None]), wide - 1)
        own = np.arange(len(open_))
        moved = np.take_along_axis(now[open_], move, 1)
        moved[:, -1] = -1
        moved[own, at] = piece
        found = np.take_along_axis(offers[open_], move, 1)
        found[:, -1] = _NONE
        behind = moved[own, np.minimum(at + 1, wide - 1)]
        behind[at + 1 >= wide] = -1
        has = behind >= 0
        found[own, at] = _NONE
        found[own[has], at[has]] = model.ranks(model.merge(piece[has], behind[has]))
        has = at > 0
        found[own[has], at[has] - 1] = model.ranks(model.merge(moved[own[has], at[has] - 1], piece[has]))
        now[open_], offers[open_] = moved, found
        if skip or skips is not None:
            start[open_] = np.take_along_axis(start[open_], move, 1)
        left_over[rows[open_]] -= 1
    out[rows] = now
    return out, left_over


def one_by_one(model: Model, symbols: list[int], key: int, skip: int) -> list[int]:
    """The same for one chunk of any length, with the agenda as a heap."""
    pairs = model.pairs()
    n, sym = len(symbols), list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(int(model.rank[p]), i, i + 1, sym[i], sym[i + 1], p) for i in range(n - 1) if (p := pairs.get((sym[i], sym[i + 1]))) is not None]
    heapify(agenda)
    while agenda:
        _, i, j, a, b, piece = heappop(agenda)
        if sym[i] != a or sym[j] != b or after[i] != j:
            continue
        if skip and draw(key, i, piece) < skip:
            continue
        sym[i], sym[j], k = piece, -1, after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if (p := pairs.get((piece, sym[k]))) is not None:
                heappush(agenda, (int(model.rank[p]), i, k, piece, sym[k], p))
        h = before[i]
        if h >= 0 and (p := pairs.get((sym[h], piece))) is not None:
            heappush(agenda, (int(model.rank[p]), h, i, sym[h], piece, p))
    return [s for s in sym if s >= 0]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all rows ``starts[i] .. starts[i] + sizes[i]``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Index(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def segment(
    model: Model, words: list[str], keys: np.ndarray, skip: int, skips: np.ndarray | None = None, offered: list | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of chunks, back to back, with each chunk's start and number of ids.

    ``skips`` and ``offered`` are for chunks of up to ``WIDE`` characters.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = model.symbol[points]
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    found: list[np.ndarray] = []
    of: list[np.ndarray] = []
    count = np.zeros(len(words), np.int64)
    low = 0
    for wide in (2, 4, 6, 8, 10, 12, 16, 24, WIDE):
        chosen = np.flatnonzero((size > low) & (size <= wide))
        low = wide
        for part in np.array_split(chosen, max(1, len(chosen) // 20_000)):
            if not len(part):
                continue
            at = first[part][:, None] + np.arange(wide)
            matrix = np.where(np.arange(wide) < size[part][:, None], symbols[np.minimum(at, len(symbols) - 1)], np.int32(-1))
            rounds: list = []
            done, n = _side_by_side(model, matrix, size[part], keys[part], skip, None if skips is None else skips[part], rounds)
            if offered is not None:
                offered += [(part[rows], starts, pieces) for rows, starts, pieces in rounds]
            found.append(done[np.arange(wide) < n[:, None]])
            of.append(part)
            count[part] = n
    for i in np.flatnonzero(size > WIDE):
        ids = one_by_one(model, symbols[first[i] : first[i] + size[i]].tolist(), int(keys[i]), skip)
        found.append(np.array(ids, np.int32))
        of.append(np.array([i]))
        count[i] = len(ids)
    flat = np.concatenate(found) if found else np.empty(0, np.int32)
    order = np.concatenate(of) if of else np.empty(0, np.int64)
    start = np.zeros(len(words), np.int64)
    start[order] = np.cumsum(count[order]) - count[order]
    # Characters that are no piece become the bytes of their UTF-8 form.
    odd = np.flatnonzero(flat >= model.size)
    if len(odd):
        spelled = [model.byte[np.frombuffer(chr(c - model.size).encode(), np.uint8)] for c in flat[odd].tolist()]
        longer = np.ones(len(flat), np.int64)
        longer[odd] = [len(s) for s in spelled]
        grown = np.repeat(flat, longer)
        ends = np.cumsum(longer)
        grown[_ragged(ends[odd] - longer[odd], longer[odd])] = np.concatenate(spelled)
        moved = np.concatenate([[0], ends])
        last = moved[start + count]
        start = moved[start]
        flat, count = grown, last - start
    return flat, start, count


class Seen:
    """Chunks met so far with their agendas, which are the same for all keys.

    An agenda is a chunk and the offers that are skipped of it. It has the offers
    that are met on the way and the ids in the end. Each offer leads to the agenda
    that skips it too, so an occurrence walks from agenda to agenda by its own
    draws. What is asked for only once is worked off with the draws directly.
    """

    def __init__(self):
        self.index = _Index()
        self.root = np.empty(0, np.int32)  # by chunk: the agenda without skips
        self.word, self.skips = np.empty(0, np.int32), np.empty(0, np.int64)  # by agenda
        self.first, self.offers = np.empty(0, np.int64), np.empty(0, np.int64)
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.at, self.piece, self.next = np.empty(0, np.int16), np.empty(0, np.int32), np.empty(0, np.int32)  # by offer
        self.flat = np.empty(0, np.int32)

    def _add(self, model: Model, words: list[str], word: np.ndarray, skips: np.ndarray, dropout: bool) -> np.ndarray:
        """Work off new agendas; their numbers."""
        offered: list = []
        flat, start, count = segment(model, [words[i] for i in word.tolist()], np.zeros(len(word), np.uint64), 0, skips if dropout else None, offered)
        rows, at, piece = (np.concatenate(c) for c in zip(*offered, strict=True)) if offered else (np.empty(0, np.int64),) * 3
        order = np.argsort(rows, kind="stable")
        offers = np.bincount(rows, minlength=len(word)).astype(np.int64)
        new = np.arange(len(self.word), len(self.word) + len(word), dtype=np.int32)
        more = {
            "word": word, "skips": skips, "offers": offers, "first": len(self.at) + np.cumsum(offers) - offers, "start": start + len(self.flat), "count": count,
            "at": at[order], "piece": piece[order], "next": np.full(len(rows), _NEW), "flat": flat,
        }
        for name, values in more.items():
            own = getattr(self, name)
            setattr(self, name, np.concatenate([own, values.astype(own.dtype)]))
        return new

    def _skipped(self, agenda: np.ndarray, asked: np.ndarray, keys: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that skip an offer of their agenda behind the ``asked`` first ones, and which one."""
        rows, offers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low in range(0, len(agenda), BLOCK):
            part = slice(low, low + BLOCK)
            n = self.offers[agenda[part]] - asked[part]
            at = _ragged(self.first[agenda[part]] + asked[part], n)
            who = np.repeat(np.arange(low, low + len(n)), n)
            hit = np.flatnonzero(draws(keys[who], self.at[at], self.piece[at]) < np.uint64(skip))
            hit = hit[np.diff(who[hit], prepend=-1) > 0]
            rows.append(who[hit])
            offers.append(at[hit])
        return np.concatenate(rows), np.concatenate(offers)

    def ids(self, model: Model, word: np.ndarray, keys: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks by place in the index and key, and how many each has."""
        words = list(self.index)
        self.root = np.concatenate([self.root, np.full(len(words) - len(self.root), _NEW, np.int32)])
        new, which, n = np.unique(word, return_inverse=True, return_counts=True)
        open_ = self.root[new] < 0
        if skip:
            long = np.array([len(words[i]) > WIDE for i in new.tolist()], bool)
            once = open_ & (long | (self.root[new] == _NEW) & (n == 1))
            self.root[new[once]] = _ONCE
            open_ &= ~once
        if open_.any():
            self.root[new[open_]] = self._add(model, words, new[open_], np.zeros(int(open_.sum()), np.int64), bool(skip))
        ends = self.root[word]
        live = np.flatnonzero(ends >= 0) if skip else np.empty(0, np.int64)
        asked = np.zeros(len(live), np.int64)
        while len(live):
            agenda = ends[live]
            rows, offers = self._skipped(agenda, asked, keys[live], skip)
            live, agenda = live[rows], agenda[rows]
            asked = offers - self.first[agenda] + 1
            new, which, n = np.unique(offers, return_index=True, return_counts=True)
            nth, own = asked[which] - 1, agenda[which]
            open_ = self.next[new] < 0
            once = open_ & ((nth >= BITS) | (self.next[new] == _NEW) & (n == 1))
            self.next[new[once]] = _ONCE
            open_ &= ~once
            if open_.any():
                skips = self.skips[own[open_]] | np.int64(1) << nth[open_]
                added = self._add(model, words, self.word[own[open_]], skips, True)
                self.next[new[open_]] = added
            ends[live] = self.next[offers]
            kept = ends[live] >= 0
            live, asked = live[kept], asked[kept]
        alone = np.flatnonzero(ends < 0)
        flat, start, count = self.flat, self.start[ends], self.count[ends]
        if len(alone):
            more, start[alone], count[alone] = segment(model, [words[i] for i in word[alone].tolist()], keys[alone], skip)
            start[alone] += len(flat)
            flat = np.concatenate([flat, more])
        return flat[_ragged(start, count)], count


def encode_texts(
    model: Model, texts_: list[str], doc_keys: np.ndarray, seed: int, dropout: float, seen: Seen | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids back to back, and the number of ids of each text. ``seen`` saves work, and changes nothing else."""
    skip = min(int(dropout * 2**64), _M) if dropout > 0 else 0
    seen = seen or Seen()
    index, places, sizes = seen.index, [], []
    for text in texts_:
        marked = (SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)) if text else ""
        chunks = _chunks(marked)
        places.append(np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks)))
        sizes.append(len(chunks))
    size = np.array(sizes, np.int64)
    place = np.concatenate(places) if places else np.empty(0, np.int64)
    if skip:
        own = _mix(doc_keys.astype(np.uint64) ^ np.uint64(seed & _M))
        nth = _ragged(np.zeros(len(size), np.int64), size).astype(np.uint64)
        keys = _mix(np.repeat(own, size) + nth * np.uint64(0x9E3779B97F4A7C15))
    else:
        keys = np.zeros(len(place), np.uint64)
    ids, count = seen.ids(model, place, keys, skip)
    ends = np.concatenate([[0], np.cumsum(count)])
    return ids, np.diff(ends[np.concatenate([[0], np.cumsum(size)])])


def _chunks(marked: str) -> list[str]:
    """Spaces and what follows them, up to the next space."""
    return re.findall(f"{SPACE}+[^{SPACE}]*", marked)


def decode_ids(model: Model, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Texts of rows of ids; the space that encoding puts in front is taken off."""
    at, n = model.said_at[ids], model.said_at[ids + 1] - model.said_at[ids]
    flat = model.said[_ragged(at, n)].tobytes()
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
    return [flat[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _encode(name: str, seed: int, dropout: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Model(name), Seen()
        for batch in batches:
            size, start = 0, 0
            bytes_ = pa.compute.binary_length(batch["text"]).to_pylist()
            for end, n in enumerate(bytes_, 1):
                size += n
                if size < SLAB and end < len(bytes_):
                    continue
                part = batch.slice(start, end - start)
                keys = pa.compute.fill_null(part["doc_id"], -1).to_numpy(zero_copy_only=False)
                if len(seen.index) > WORDS or len(seen.word) > AGENDAS:
                    seen = Seen()
                ids, sizes = encode_texts(model, part["text"].to_pylist(), keys, seed, dropout, seen)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])
                size, start = 0, end

    return run


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", seed: int = 1, dropout: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of whole texts, one row per row.

    The same seed, id and text give the same ids wherever they are computed; each
    offer of each place of a document has a draw of its own;
    with dropout 0 they are the model's own, with 1 no merge is made. Null and
    empty texts have no ids. A space sign (U+2581) in a text is spelled in
    bytes, so that decoding tells it from a space. Null ids count as -1.
    """
    return texts(docs, id_col, text_col).mapInArrow(_encode(model, seed, dropout), "doc_id long, ids array<int>")


def _decode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(name, merges=False)
        for batch in batches:
            lists = batch["ids"]
            sizes = np.diff(lists.offsets.to_numpy())
            for part in np.array_split(np.arange(len(batch)), max(1, int(sizes.sum()) * 8 // SLAB)):
                if len(part):
                    some = lists.slice(part[0], len(part))
                    said = decode_ids(model, some.flatten().to_numpy().astype(np.int64), sizes[part])
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(part[0], len(part)), some, pa.array(said, pa.string())], ["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, ids, text`` from ``doc_id, ids``; null ids count as none, bytes that are no UTF-8 become U+FFFD."""
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decode(model), "doc_id long, ids array<int>, text string")
