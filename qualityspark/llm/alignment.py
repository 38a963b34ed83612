"""Cross-tokenizer alignment: tokens of two tokenizers grouped by the bytes that they share.

A text is given to both tokenizers, and the byte offsets where tokens of both
end cut it into groups. Any range of a text yields a fragment: the tokens up
to its first common end (its open prefix), closed groups, and the tokens behind
its last common end (its open suffix). Two fragments that follow each other
make one: the suffix of the first and the prefix of the second are aligned
anew, everything else stays. This is associative, so the chunks of a very long
text are aligned by tasks of their own and reduced as a tree; closed groups
leave the tree where they arise, and only open ends travel upwards.

Short texts need none of this: nearly every blank is a cut of both tokenizers, so
what lies between two of them is read and aligned once and kept (``Stretches``).

Corpus-wide counts of linked ids are not looked up link by link: each slab of
texts is a block with the pairs of ids that it holds, so a pair meets its count
once per block, and blocks meet their pairs' counts again by merge.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.llm.common import cut_lineage, release, texts

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a chunk, about; longer texts are several. Chunks that one step of the tree puts together.
CHUNK, FAN_IN = 1 << 16, 16
#: Bytes of text in a block, about; characters that a tokenizer is given at once; characters of a generation of words that are kept, about.
SLAB, _BATCH, _KEPT = 1 << 21, 1 << 17, 1 << 23
#: Characters of stretches that are kept measured, about; new stretches that a tokenizer is given as one text.
_MEASURED, _TOGETHER = 1 << 23, 256

#: Cuts that no token of the tokenizer spans: one blank or line end between letters or digits; a blank with something before and behind it.
_CUT_A, _CUT_B = re.compile(r"(?<=[^\W_])[ \n](?=[^\W_])"), re.compile(r"(?s)(?<=[^ ▁]) (?=.)")
#: Cuts of both at once: one blank between characters that no edition of Unicode takes for white space. Stretches that may stand beside one.
_BESIDE = "[!-~\xa1-\u024f]"
_CUT, _PLAIN = re.compile(f"(?<={_BESIDE}) (?={_BESIDE})"), re.compile(f"(?s){_BESIDE}(?:.*{_BESIDE})?\\Z")

CHUNKS = "row long, chunk long, a_text string, b_text string, a_start long, b_start long"
FRAGMENTS = (
    "row long, chunk long, ok boolean, a_start long, b_start long, cut_low long, cut_high long, "
    "head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, closed_a array<int>, closed_b array<int>, closed_at long"
)
BLOCKS = (
    "block long, keys array<long>, starts array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<long>, "
    "groups array<string>, links binary, pairs array<long>, times array<long>"
)
UNITS = "key long, start long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def byte_level_table() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones stand for themselves, others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(c): b for c, b in [*zip(printable, printable, strict=True), *((256 + i, b) for i, b in enumerate(rest))]}


class Side:
    """One tokenizer: ids of texts, and each id's bytes."""

    #: The blank before a text, if the tokenizer does not write it itself.
    blank = ""

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes = token_bytes
        self.length = np.array([len(b) for b in token_bytes], np.int64)
        # Each id as a text with what may stand behind it.
        self.comma, self.bar, self.end = ([f"{i}{mark}" for i in range(len(token_bytes))] for mark in ",|;")
        self.comma, self.bar, self.end = (np.array(x, object) for x in (self.comma, self.bar, self.end))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The library's own ids."""
        raise NotImplementedError

    def spelled(self, text: str) -> bytes:
        """The bytes that the tokens of a text should have."""
        raise NotImplementedError

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def read(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """Ids of each text, and whether they give its bytes back."""
        return [(np.array(ids, np.int64), self.joined(ids) == self.spelled(t)) for t, ids in zip(texts, self.encode(texts), strict=True)]

    def read_stretches(self, groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of stretches with a blank before each, end to end, how many each has, and whether they give its bytes back.

        The stretches of a group are read as one text, cut at the bytes where they end.
        """
        out, alike = [], []
        texts = [self.blank + " ".join(g) for g in groups]
        for group, text, ids in zip(groups, texts, self.encode(texts), strict=True):
            if self.joined(ids) == self.spelled(text):
                ids = np.array(ids, np.int64)
                ends = np.cumsum([len(w.encode()) + 1 for w in group])
                out.append((ids, np.diff(np.searchsorted(np.cumsum(self.length[ids]), ends, "right"), prepend=0)))
                alike.append(np.ones(len(group), bool))
            elif len(group) == 1:
                out.append((_NONE, np.zeros(1, np.int64)))
                alike.append(np.zeros(1, bool))
            else:
                ids, counts, good = self.read_stretches([[w] for w in group])
                out.append((ids, counts))
                alike.append(good)
        ids, counts = (np.concatenate([_NONE, *(x[k] for x in out)]) for k in (0, 1))
        return ids, counts, np.concatenate([np.empty(0, bool), *alike])


class ByteLevel(Side):
    """A byte-level vocabulary. No token lies across two of the words that its pattern gives, and words repeat, so what the
    library gives for one is kept for its next occurrences."""

    blank = " "

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = public_tokenizers.path(vocabulary)
        self.model = Tokenizer.from_file(path)
        # The strings of special tokens are then plain text.
        self.model.encode_special_tokens = True
        # Ids are looked up word by word only in texts whose characters no edition of Unicode has changed.
        self.word, self.other = regex.compile(public_tokenizers.PATTERN), re.compile("[^\t-\r\x20-\x7e\xa1-\u024f]")
        table = byte_level_table()
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        token_bytes = [b""] * (max([*entries.values(), self.model.get_vocab_size() - 1]) + 1)
        for token, i in entries.items():
            token_bytes[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        super().__init__(token_bytes)
        # Words of late, and those before them: what comes again moves on, what does not goes in the end.
        self.kept: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.size = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        out, start, size = [], 0, 0
        # The library keeps some hundred bytes a token until its batch is done.
        for i, text in enumerate(texts, 1):
            size += len(text)
            if size > _BATCH or i == len(texts):
                out += [e.ids for e in self.model.encode_batch_fast(texts[start:i], add_special_tokens=False)]
                start, size = i, 0
        return out

    def words(self, text: str) -> list[str]:
        return [text] if self.other.search(text) else self.word.findall(text)

    def spelled(self, text: str) -> bytes:
        return text.encode()

    def read(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        cut = [self.words(t) for t in texts]
        if self.size > _KEPT:
            self.older, self.kept, self.size = self.kept, {}, 0
        kept, older, fresh, unlike = self.kept, self.older, [], set()
        for word in set().union(*cut).difference(kept):
            if word in older:
                kept[word] = older[word]
                self.size += len(word) + 40
            else:
                fresh.append(word)
        for word, ids in zip(fresh, self.encode(fresh), strict=True):
            kept[word] = ids
            self.size += len(word) + 40
            if self.joined(ids) != self.spelled(word):
                unlike.add(word)
        ids = [np.fromiter(itertools.chain.from_iterable(map(kept.__getitem__, words)), np.int64) for words in cut]
        alike = [unlike.isdisjoint(words) for words in cut]
        # Never kept, so that they are found out again.
        for word in unlike:
            del kept[word]
        return list(zip(ids, alike, strict=True))


class Pieces(Side):
    """A sentencepiece model, which writes a blank before the text itself."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        of_byte = lambda piece: bytes([int(piece[3:5], 16)])
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        super().__init__([of_byte(p) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def spelled(self, text: str) -> bytes:
        return b" " + text.encode()


_NONE = np.empty(0, np.int64)


@functools.cache
def sides(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


@dataclass
class Fragment:
    """Tokens of a range of a text between two places.

    ``cut`` are the first and the last offset where both end, or None. Without a
    cut all tokens are in ``head``. ``closed`` are runs of closed groups as
    (offset, ids of A, ids of B); their bytes are the same.
    """

    a_start: int
    b_start: int
    head: tuple[np.ndarray, np.ndarray]
    cut: tuple[int, int] | None = None
    tail: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)
    closed: list = field(default_factory=list)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What two rising arrays share."""
    return x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x] if len(y) else x[:0]


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in half the bytes, if they fit, which sort faster."""
    return numbers.astype(np.int32) if not len(numbers) or numbers.max() < 1 << 31 else numbers


def fragment(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, a_start: int, b_start: int, begins: bool = False) -> Fragment:
    """The fragment of some consecutive tokens; ``begins`` if both start there by a common end, as a text does."""
    ends_a, ends_b = a_start + np.cumsum(a.length[ids_a]), b_start + np.cumsum(b.length[ids_b])
    common = _common(ends_a, ends_b)
    if not len(common) and not begins:
        return Fragment(a_start, b_start, (ids_a, ids_b))
    low = a_start if begins else int(common[0])
    high = int(common[-1]) if len(common) else low
    i, j = (np.searchsorted(e, (low, high), "right") if not begins else np.array([0, np.searchsorted(e, high, "right")]) for e in (ends_a, ends_b))
    closed = [(low, ids_a[i[0] : i[1]], ids_b[j[0] : j[1]])] if high > low else []
    return Fragment(a_start, b_start, (ids_a[: i[0]], ids_b[: j[0]]), (low, high), (ids_a[i[1] :], ids_b[j[1] :]), closed)


def compose(a: Side, b: Side, x: Fragment, y: Fragment) -> Fragment:
    """The fragment of ``x`` and then ``y``, whose tokens begin where those of ``x`` end; neither is aligned again but for the seam."""
    open_x = x.tail if x.cut else x.head
    begin = (x.cut[1], x.cut[1]) if x.cut else (x.a_start, x.b_start)
    seam = fragment(a, b, *(np.concatenate(p) for p in zip(open_x, y.head, strict=True)), *begin, begins=x.cut is not None)
    # The end of y's head is a common end if y has a cut, so the seam then has no tail.
    head, first = (x.head, x.cut[0]) if x.cut else (seam.head, seam.cut[0] if seam.cut else None)
    tail, last = (y.tail, y.cut[1]) if y.cut else (seam.tail, seam.cut[1] if seam.cut else None)
    if first is None:
        return Fragment(x.a_start, x.b_start, seam.head)
    return Fragment(x.a_start, x.b_start, head, (first, last), tail, [*x.closed, *seam.closed, *y.closed])


@dataclass
class Slab:
    """Runs of closed groups, each covering the same bytes by both sides."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    times: np.ndarray
    #: For each run and pair of it, in order: run times pairs plus the pair's place, and how often.
    entries: np.ndarray
    counts: np.ndarray


def measure(a: Side, b: Side, runs: list[tuple[np.ndarray, np.ndarray]], with_groups: bool = True) -> Slab:
    """Groups and links of runs of closed groups, all runs at once."""
    n_a, n_b = (np.array([len(r[k]) for r in runs], np.int64) for k in (0, 1))
    ids_a, ids_b = (np.concatenate([_NONE, *(r[k] for r in runs)]) for k in (0, 1))
    return _measure(a, b, n_a, n_b, ids_a, ids_b, with_groups)


def _measure(a: Side, b: Side, n_a: np.ndarray, n_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, with_groups: bool) -> Slab:
    """The same of runs end to end, with the number of tokens of each."""
    ends_a, ends_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
    # Runs lie end to end, so no group and no link reaches from one into the next.
    common = _common(ends_a, ends_b)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    run_a = np.repeat(np.arange(len(n_a)), n_a)
    last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
    n_groups = np.bincount(run_a[last_a], minlength=len(n_a))
    first, final = np.searchsorted(ends_b, ends_a - a.length[ids_a], "right"), np.searchsorted(ends_b, ends_a, "left")
    count = final - first + 1
    link_a = np.repeat(np.arange(len(ids_a)), count)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(count) - count, count) + first[link_a]
    n_links = np.bincount(run_a[link_a], minlength=len(n_a))
    code = _narrow(ids_a[link_a] * len(b.length) + ids_b[link_b])
    code, place, times = np.unique(code, return_inverse=True, return_counts=True)
    pairs = (code.astype(np.int64) // len(b.length) << 32) | code % len(b.length)
    entries = np.sort(_narrow(run_a[link_a] * len(pairs) + place))
    first = np.flatnonzero(np.diff(entries, prepend=-1))
    entries, counts = entries[first].astype(np.int64), np.diff(first, append=len(entries))
    groups = []
    if with_groups:
        # A's tokens stand behind all of B's of earlier groups, B's behind all of A's up to their own group.
        upto_a, upto_b = (np.searchsorted(g, np.arange(len(common)), "right") for g in (group_a, group_b))
        text = np.empty(len(ids_a) + len(ids_b), object)
        before_b = np.concatenate([[0], upto_b])[group_a] if len(ids_a) else _NONE
        text[np.arange(len(ids_a)) + before_b] = np.where(last_a, a.bar[ids_a], a.comma[ids_a])
        text[np.arange(len(ids_b)) + upto_a[group_b]] = np.where(last_b, b.end[ids_b], b.comma[ids_b])
        ends, text = np.cumsum(n_a + n_b), text.tolist()
        groups = ["".join(text[e - n : e])[:-1] for e, n in zip(ends.tolist(), (n_a + n_b).tolist(), strict=True)]
    return Slab(n_a, n_b, n_groups, n_links, groups, pairs, times, entries, counts)


class Stretches:
    """Texts from what lies between cuts of both tokenizers. No token, group or link crosses such a cut, and stretches
    repeat, so each is read and aligned once and a text's groups and links are those of its stretches."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.index: dict[str, int] = {}
        self.size = 0
        self.groups: list[bytes] = []
        # Of each stretch: tokens of A and B, groups, links; whether its tokens give its bytes back; whether it came again.
        self.numbers, self.ok, self.again = np.empty((4, 0), np.int64), np.empty(0, bool), np.empty(0, bool)
        # Where its links begin, and the links of all.
        self.begin, self.links = np.zeros(1, np.int64), _NONE

    def _forget(self) -> None:
        """Keep what came again, if that is not too much itself."""
        words = list(itertools.compress(self.index, self.again))
        size = sum(len(w) + 40 for w in words)
        keep = self.again if size < _MEASURED // 2 else np.zeros(len(self.again), bool)
        self.index, self.size = (dict(zip(words, itertools.count())), size) if keep.any() else ({}, 0)
        self.groups = list(itertools.compress(self.groups, keep))
        self.links = self.links[np.repeat(keep, np.diff(self.begin))]
        self.numbers, self.ok = self.numbers[:, keep], self.ok[keep]
        self.begin, self.again = np.concatenate([[0], np.cumsum(self.numbers[3])]), np.zeros(len(self.ok), bool)

    def _learn(self, fresh: list[str]) -> None:
        """Read and align stretches that are not known."""
        plain, odd = [], []
        for word in fresh:
            (plain if _PLAIN.match(word) else odd).append(word)
        together = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)] + [[w] for w in odd]
        (ids_a, n_a, ok_a), (ids_b, n_b, ok_b) = (side.read_stretches(together) for side in (self.a, self.b))
        ok = ok_a & ok_b
        ids_a, ids_b = ids_a[np.repeat(ok, n_a)], ids_b[np.repeat(ok, n_b)]
        made = _measure(self.a, self.b, n_a * ok, n_b * ok, ids_a, ids_b, True)
        self.index.update(zip(itertools.chain(plain, odd), itertools.count(len(self.index))))
        self.size += sum(len(w) + 40 for w in fresh)
        self.groups += [g.encode() for g in made.groups]
        self.numbers = np.concatenate([self.numbers, [made.n_a, made.n_b, made.n_groups, made.n_links]], axis=1)
        self.ok, self.again = np.concatenate([self.ok, ok]), np.concatenate([self.again, np.zeros(len(ok), bool)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(made.n_links)])
        self.links = np.concatenate([self.links, made.pairs[np.repeat(made.entries % max(len(made.pairs), 1), made.counts)]])

    def measure(self, texts: list[str]) -> Slab:
        """What ``measure`` gives of whole texts, with digests for groups."""
        if self.size > _MEASURED:
            self._forget()
        cut = [_CUT.split(t) if t else [] for t in texts]
        before = len(self.index)
        self._learn(list(set().union(*cut).difference(self.index)))
        index, groups, digests, own = self.index, self.groups, [], []
        for words in cut:
            at = list(map(index.__getitem__, words))
            ids = np.array(at, np.int64)
            good = bool(at) and self.ok[ids].all()
            own.append(ids if good else _NONE)
            digests.append(hashlib.sha256(b";".join(map(groups.__getitem__, at))).hexdigest() if good else "")
        n = np.array([len(x) for x in own], np.int64)
        ids, ends = np.concatenate([_NONE, *own]), np.cumsum(n)
        sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(self.numbers[:, ids], axis=1)], axis=1)
        n_a, n_b, n_groups, n_links = sums[:, ends] - sums[:, ends - n]
        place = np.zeros(len(self.links), np.int32)
        used = np.zeros(len(self.ok), bool)
        used[ids] = True
        self.again[:before] |= used[:before]
        used = np.repeat(used, np.diff(self.begin))
        pairs, place[used] = np.unique(self.links[used], return_inverse=True)
        # Each occurrence's links follow each other from where its stretch's begin.
        count = self.numbers[3, ids]
        link = np.arange(count.sum()) + np.repeat(self.begin[ids] - np.cumsum(count) + count, count)
        place = place[link]
        times = np.bincount(place, minlength=len(pairs))
        entries = np.sort(_narrow(np.repeat(np.arange(len(texts)) * len(pairs), n_links) + place))
        first = np.flatnonzero(np.diff(entries, prepend=-1))
        entries, counts = entries[first].astype(np.int64), np.diff(first, append=len(entries))
        return Slab(n_a, n_b, n_groups, n_links, digests, pairs, times, entries, counts)


@functools.cache
def stretches(a: str, b: str) -> Stretches:
    return Stretches(*sides(a, b))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits by planes of bytes, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 4 * n, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def _block_row(number: int, keys: list[int], starts: list[int], slab: Slab) -> pa.RecordBatch:
    steps = _packed(np.diff(slab.entries, prepend=0))
    links = len(steps).to_bytes(8, "little") + steps + _packed(slab.counts)
    values = [number, keys, starts, slab.n_a, slab.n_b, slab.n_groups, slab.n_links, slab.groups, links, slab.pairs, slab.times]
    kinds = [pa.int64(), *(pa.list_(k) for k in (pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.string())), pa.binary(), *[pa.list_(pa.int64())] * 2]
    names = ["block", "keys", "starts", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pairs", "times"]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def _slabs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SLAB`` bytes of text, small ones of a task put together."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_pylist()):
            if size and size + n > SLAB:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(h.num_rows for h in held) else held[0]
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if sum(h.num_rows for h in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _whole(a: str, b: str):
    """Blocks of texts that are aligned in one piece."""

    def run(batches):
        known = stretches(a, b)
        for nth, batch in enumerate(_slabs(batches, "text")):
            texts = batch["text"].to_pylist()
            number = (TaskContext.get().partitionId() << 32 | nth) * 2
            yield _block_row(number, batch["row"].to_pylist(), [0] * len(texts), known.measure(texts))

    return run


def cuts(text: str, size: int, pattern: re.Pattern) -> list[int]:
    """Where chunks of a text begin: the first cut at or behind each multiple of ``size``; chunks without a cut are empty."""
    out = [0]
    for at in range(size, len(text), size):
        found = pattern.search(text, max(at, out[-1])) if out[-1] < len(text) else None
        out.append(found.start() if found else len(text))
    return out


def _chunks(size: int):
    def run(batches):
        for batch in batches:
            for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                sides_of = []
                for pattern in (_CUT_A, _CUT_B):
                    at = cuts(text, size, pattern)
                    parts = [text[x:y] for x, y in zip(at, [*at[1:], len(text)], strict=True)]
                    # The blank before the text is a byte of the first token.
                    begins = np.cumsum([0, 1 + len(parts[0].encode()), *(len(p.encode()) for p in parts[1:-1])])
                    sides_of += [parts, begins.tolist()[: len(parts)]]
                n = len(sides_of[0])
                arrays = [pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int64()), *(pa.array(sides_of[i]) for i in (0, 2, 1, 3))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "chunk", "a_text", "b_text", "a_start", "b_start"])

    return run


def _fragment_rows(rows: list[tuple[int, int, bool, Fragment]]) -> pa.RecordBatch:
    """Fragments, and behind each its closed runs, as rows of ``FRAGMENTS``."""
    out = []
    for row, chunk, ok, f in rows:
        low, high = f.cut or (None, None)
        out.append((row, chunk, ok, f.a_start, f.b_start, low, high, *f.head, *f.tail, None, None, None))
        out += [(row, chunk, *[None] * 9, ids_a, ids_b, at) for at, ids_a, ids_b in f.closed]
    whole_numbers, lists = pa.int64(), pa.list_(pa.int32())
    kinds = [whole_numbers] * 2 + [pa.bool_()] + [whole_numbers] * 4 + [lists] * 6 + [whole_numbers]
    names = [c.split()[0] for c in FRAGMENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*out, strict=True)] or [()] * 14, kinds, strict=True)], names)


def _align_chunks(a: str, b: str):
    def run(batches):
        one, other = sides(a, b)
        for batch in batches:
            for at in range(batch.num_rows):
                row, chunk, a_text, b_text, a_start, b_start = (batch[c][at].as_py() for c in ("row", "chunk", "a_text", "b_text", "a_start", "b_start"))
                # The model writes the blank that a chunk of B begins with, the first one's too.
                a_text, b_text = (" " + a_text, b_text) if chunk == 0 else (a_text, b_text[1:] if b_text else None)
                ids_a, ok_a = one.read([a_text])[0]
                ids_b, ok_b = (_NONE, True) if b_text is None else other.read([b_text])[0]
                ok = ok_a and ok_b
                made = fragment(one, other, ids_a, ids_b, a_start, b_start, begins=chunk == 0) if ok else Fragment(a_start, b_start, (_NONE, _NONE))
                yield _fragment_rows([(row, chunk, ok, made)])

    return run


def _reduce_chunks(a: str, b: str):
    """One step of the tree: the fragments of each group of neighbours become one."""

    def run(batches):
        one, other = sides(a, b)
        ints = lambda x: np.array(x or (), np.int64)
        for batch in batches:
            for row, chunk, parts in zip(batch["row"].to_pylist(), batch["chunk"].to_pylist(), batch["parts"].to_pylist(), strict=True):
                ok = all(p["ok"] for p in parts)
                made = None
                for p in sorted(parts, key=lambda p: p["chunk"]) if ok else ():
                    cut = None if p["cut_low"] is None else (p["cut_low"], p["cut_high"])
                    f = Fragment(p["a_start"], p["b_start"], (ints(p["head_a"]), ints(p["head_b"])), cut, (ints(p["tail_a"]), ints(p["tail_b"])))
                    made = f if made is None else compose(one, other, made, f)
                yield _fragment_rows([(row, chunk, ok, made or Fragment(0, 0, (_NONE, _NONE)))])

    return run


def _measured(a: str, b: str):
    """Blocks of closed runs of long texts."""

    def run(batches):
        one, other = sides(a, b)
        for nth, batch in enumerate(batches):
            runs = [(np.array(x, np.int64), np.array(y, np.int64)) for x, y in zip(batch["closed_a"].to_pylist(), batch["closed_b"].to_pylist(), strict=True)]
            number = (TaskContext.get().partitionId() << 32 | nth) * 2 + 1
            yield _block_row(number, batch["row"].to_pylist(), batch["closed_at"].to_pylist(), measure(one, other, runs))

    return run


def _long_runs(long: DataFrame, a: str, b: str, chunk: int, fan_in: int) -> DataFrame:
    """``row, closed_at, closed_a, closed_b`` of long texts whose tokens give their bytes back."""
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = -(-(long.agg(F.max(F.length("text"))).first()[0] or 0) // chunk)
    chunks = long.select("row", "text").mapInArrow(_chunks(chunk), CHUNKS).repartition(parts, "row", "chunk")
    now = cut_lineage(chunks.mapInArrow(_align_chunks(a, b), FRAGMENTS))
    layers = [now]
    names = ["chunk", "ok", "a_start", "b_start", "cut_low", "cut_high", "head_a", "head_b", "tail_a", "tail_b"]
    while most > 1:
        open_ends = now.filter("ok IS NOT NULL").groupBy("row", F.expr(f"chunk DIV {fan_in}").alias("next")).agg(F.collect_list(F.struct(*names)).alias("parts"))
        now = cut_lineage(open_ends.withColumnRenamed("next", "chunk").mapInArrow(_reduce_chunks(a, b), FRAGMENTS))
        layers.append(now)
        most = -(-most // fan_in)
    # At the end of a text both sides end, so nothing is open any more.
    good = cut_lineage(now.filter("ok").select("row"))
    closed = functools.reduce(DataFrame.unionByName, (x.filter("closed_at IS NOT NULL").select("row", "closed_at", "closed_a", "closed_b") for x in layers))
    return closed.join(good.hint("merge"), "row", "left_semi")


def _units(block: pa.Table, counted: pa.Table) -> pa.Table:
    """Sums over the links of each run of a block, from its pairs' corpus-wide counts."""
    total, best = (np.zeros(counted.num_rows, np.int64) for _ in range(2))
    nth = counted["nth"].to_numpy()
    total[nth], best[nth] = counted["total"].to_numpy(), counted["best"].to_numpy().astype(np.int64)
    links = block["links"][0].as_py()
    size = int.from_bytes(links[:8], "little")
    entries, counts = np.cumsum(_unpacked(links[8 : 8 + size])), _unpacked(links[8 + size :])
    n = len(block["keys"][0])
    run, place = np.divmod(entries, max(len(total), 1))
    sums = [np.zeros(n, np.int64) for _ in range(2)]
    # Entries go run by run; a run without tokens has none.
    begins = np.flatnonzero(np.diff(run, prepend=-1))
    for out, each in zip(sums, (best, total), strict=True):
        out[run[begins]] = np.add.reduceat(each[place] * counts, begins) if len(begins) else 0
    wide = [block[c][0].values.cast(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    arrays = [block["keys"][0].values, block["starts"][0].values, *wide, *map(pa.array, sums), block["groups"][0].values]
    return pa.Table.from_arrays(arrays, [c.split()[0] for c in UNITS.split(", ")])


def align(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, chunk: int = CHUNK, fan_in: int = FAN_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align the tokens of a byte-level vocabulary (A) and of a sentencepiece model (B) over whole texts.

    Returns one row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256``. A link is a pair of tokens that share
    bytes, its count how many links of all texts have its two ids; ``n_best``
    are the links whose count is the highest of their B id, ``count_sum`` the sum
    of counts. A blank stands before each text. Texts that are null or empty, or
    whose tokens do not give their bytes back, have no tokens: zeros, and an
    empty digest. Repeated rows and null ids count like any others; no rows give
    no rows.
    """
    spark = docs.sparkSession
    rows = cut_lineage(texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    is_long = F.length("text") > chunk
    blocks = cut_lineage(rows.filter(~is_long).select("row", "text").mapInArrow(_whole(a, b), BLOCKS))
    long = rows.filter(is_long)
    runs = cut_lineage(_long_runs(long, a, b, chunk, fan_in))
    long_blocks = cut_lineage(runs.mapInArrow(_measured(a, b), BLOCKS))
    blocks = blocks.unionByName(long_blocks)
    release(spark)

    each = blocks.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("c"))))
    totals = cut_lineage(each.groupBy("pair").agg(F.sum("c").alias("total")))
    by_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    highest = totals.groupBy(by_b).agg(F.max("total").alias("highest"))
    ruled = totals.select("pair", "total", by_b).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    ruled = cut_lineage(ruled)
    release(spark)
    asked = blocks.select("block", F.posexplode("pairs").alias("nth", "pair"))
    counted = asked.join(ruled.hint("merge"), "pair").select(F.col("block").alias("of"), "nth", "total", "best")
    units = blocks.drop("pairs", "times").groupBy("block").cogroup(counted.groupBy("of"))
    units = cut_lineage(units.applyInArrow(_units, UNITS))
    release(spark)

    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    short = rows.filter(~is_long).select("row", "doc_id").join(units.withColumnRenamed("key", "row").hint("merge"), "row")
    done = units.join(long.select(F.col("row").alias("key")).hint("merge"), "key", "left_semi").groupBy("key")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "groups"))), lambda x: x["groups"]), ";")
    done = done.agg(*(F.sum(c).alias(c) for c in names), F.sha2(text, 256).alias("groups_sha256"))
    whole = long.select(F.col("row").alias("key"), "doc_id").join(done.hint("merge"), "key", "left")
    whole = whole.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in names), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return short.select("doc_id", *names, F.col("groups").alias("groups_sha256")).unionByName(whole)
