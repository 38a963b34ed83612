"""Alignment of two tokenizers against a plain version, its fragments as a monoid."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from qualityspark.llm import alignment as al

ODD = [
    None,
    "",
    " ",
    "\n",
    "a ▁ b",
    "<|endoftext|> and </s> are text <0x41>",
    "naïve ☃ 雪だるま  two  blanks\n\n\nlines\tand\ttabs ",
    "it's 12345 they'll",
    "\x00\x1f퟿ é é",
    " leading",
    "trailing ",
    "   ",
    "🙂🙂 👩‍👩‍👧",
]


def words(rng, n):
    return "".join(rng.choice("abcdefghij ☃é") * rng.randrange(1, 3) + rng.choice(["ing", "tion", " the", "\n", " ", ". ", ".\n", "  "]) for _ in range(n))


def corpus(seed, n=60):
    rng = random.Random(seed)
    return [*enumerate(ODD), *((100 + i, words(rng, rng.randrange(1, 120))) for i in range(n)), (100, words(rng, 20)), (None, "same words"), (None, "same words")]


def brute(rows):
    a, b = al.sides(al.BYTE_LEVEL, al.PIECES)
    docs, counts = [], Counter()
    for doc_id, text in rows:
        data = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode([" " + (text or "")])[0], b.encode([text or ""])[0]
        if not text or b"".join(a.token_bytes[i] for i in ids_a) != data or b"".join(b.token_bytes[i] for i in ids_b) != data:
            docs.append((doc_id, None))
            continue

        def spans(side, ids):
            out, at = [], 0
            for i in ids:
                out.append((at, at + len(side.token_bytes[i]), i))
                at = out[-1][1]
            return out

        x, y = spans(a, ids_a), spans(b, ids_b)
        links = [(i, j) for s, e, i in x for t, f, j in y if s < f and t < e]
        both = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups = []
        for low, high in zip([0, *both], both, strict=False):
            inside = ["|".join([",".join(str(i) for s, e, i in side if low <= s < high) for side in (x, y)])]
            groups += inside
        counts.update(links)
        docs.append((doc_id, (len(x), len(y), len(groups), links, ";".join(groups))))
    highest = {}
    for (_, j), c in counts.items():
        highest[j] = max(highest.get(j, 0), c)
    out = []
    for doc_id, d in docs:
        if d is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            best, total = sum(counts[p] == highest[p[1]] for p in d[3]), sum(counts[p] for p in d[3])
            out.append((doc_id, *d[:3], len(d[3]), best, total, hashlib.sha256(d[4].encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "chunk", "fan_in"), [(1, 1 << 16, 16), (2, 40, 2), (3, 90, 3), (4, 7, 16)])
def test_against_brute_force(spark, documents, seed, chunk, fan_in):
    rows = corpus(seed)
    found = al.align(documents(rows), chunk=chunk, fan_in=fan_in)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted([tuple(r) for r in found.collect()], key=repr) == brute(rows)


def test_long_text_and_empty_table(spark, documents):
    rows = [(1, words(random.Random(9), 20000)), (2, " " * 5000), (3, "x" * 3000), (4, "雪" * 4000)]
    found = {r.doc_id: tuple(r) for r in al.align(documents(rows), chunk=2000).collect()}
    whole = {r.doc_id: tuple(r) for r in al.align(documents(rows), chunk=1 << 20).collect()}
    assert found == whole and found[1][1] > 20000
    assert al.align(documents([])).count() == 0


def same(x, y):
    flat = lambda f: [f.cut, *(v.tolist() for v in (*f.head, *f.tail)), merged(f.closed)]
    return flat(x) == flat(y)


def merged(closed):
    """Runs of closed groups that follow each other, as one."""
    return [np.concatenate([c[k] for c in sorted(closed, key=lambda c: c[0])]).tolist() if closed else [] for k in (1, 2)]


def test_fragments_are_a_monoid():
    """Any cut of either side's tokens, ragged ones too, and any order of composition gives the whole text's fragment."""
    a, b = al.sides(al.BYTE_LEVEL, al.PIECES)
    rng = random.Random(3)
    for _ in range(150):
        text = words(rng, rng.randrange(1, 25))
        ids_a, ids_b = (np.array(x) for x in (a.encode([" " + text])[0], b.encode([text])[0]))
        n = rng.randrange(2, 7)
        cut_a, cut_b = (sorted(rng.randrange(len(ids) + 1) for _ in range(n - 1)) for ids in (ids_a, ids_b))
        parts, at_a, at_b = [], 0, 0
        for i, j in zip([*cut_a, len(ids_a)], [*cut_b, len(ids_b)], strict=True):
            start = [int(s.length[ids[:k]].sum()) for s, ids, k in ((a, ids_a, at_a), (b, ids_b, at_b))]
            parts.append(al.fragment(a, b, ids_a[at_a:i], ids_b[at_b:j], *start, begins=not parts))
            at_a, at_b = i, j
        whole = al.fragment(a, b, ids_a, ids_b, 0, 0, begins=True)
        assert not len(whole.tail[0]) and not len(whole.tail[1])
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [al.compose(a, b, parts[k], parts[k + 1])]
        assert same(parts[0], whole)


def test_chunks_meet_only_at_cuts():
    """The tokens of the chunks are the text's own."""
    a, b = al.sides(al.BYTE_LEVEL, al.PIECES)
    rng = random.Random(11)
    for _ in range(60):
        text = words(rng, 200)
        for size in (5, 60, 400):
            for side, pattern in ((a, al._CUT_A), (b, al._CUT_B)):
                at = al.cuts(text, size, pattern)
                parts = [text[x:y] for x, y in zip(at, [*at[1:], len(text)], strict=True)]
                if side is a:
                    parts, whole = [" " + parts[0], *parts[1:]], " " + text
                else:
                    parts, whole = [parts[0], *(p[1:] if p else None for p in parts[1:])], text
                ids = [i for p in parts if p is not None for i in side.encode([p])[0]]
                assert ids == side.encode([whole])[0]
                assert side.read([whole])[0][0].tolist() == ids


def test_byte_table():
    table = al.byte_level_table()
    assert sorted(table.values()) == list(range(256)) and table["Ġ"] == 32 and table["Ċ"] == 10


def test_words_have_the_librarys_ids():
    """Word by word as in one piece, for every character of the texts that are read so, in many company."""
    a, b = al.sides(al.BYTE_LEVEL, al.PIECES)
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA0, 0x250)]] + list("\x00\x1c\x85\u2003☃雪٣ǅ")
    for _ in range(400):
        text = "".join(rng.choice(letters if rng.random() < 0.5 else "ab '  \n") for _ in range(60))
        for side in (a, b):
            ids, ok = side.read([text])[0]
            assert ids.tolist() == side.encode([text])[0]
            assert ok == (side.joined(ids.tolist()) == (text.encode() if side is a else b" " + text.encode()))
    small = al._KEPT
    try:
        al._KEPT = 10
        assert [a.read([t])[0][0].tolist() for t in ("one two", "three", "one two")] == a.encode(["one two", "three", "one two"])
    finally:
        al._KEPT = small


def test_stretches_are_read_once(monkeypatch):
    """Texts from stretches as texts in one piece, whatever was kept; a stretch that comes again is not read again."""
    rng = random.Random(17)
    texts = [t or "" for _, t in corpus(17, 40)] + [" two", "two ", "a  b c", "x  y", "é é", "one two one", "\x00 a b"]
    a, b = al.sides(al.BYTE_LEVEL, al.PIECES)

    def plain(texts):
        runs = []
        for t, (ids_a, ok_a), (ids_b, ok_b) in zip(texts, a.read([" " + t for t in texts]), b.read(texts), strict=True):
            runs.append((ids_a, ids_b) if t and ok_a and ok_b else (al._NONE, al._NONE))
        slab = al.measure(a, b, runs)
        slab.groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in slab.groups]
        return slab

    flat = lambda slab: [list(v) for v in vars(slab).values()]
    for kept in (0, 2000, 1 << 23):
        monkeypatch.setattr(al, "_MEASURED", kept)
        known = al.Stretches(a, b)
        for _ in range(8):
            some = rng.choices(texts, k=rng.randrange(0, 30))
            assert flat(known.measure(some)) == flat(plain(some))
    read, side = [], al.Side.read_stretches
    monkeypatch.setattr(al.Side, "read_stretches", lambda self, groups: read.extend(w for g in groups for w in g) or side(self, groups))
    known = al.Stretches(a, b)
    known.measure(["one two three", "two three"])
    known.measure(["three two one four"])
    assert sorted(read) == sorted(["one", "two", "three", "four"] * 2)
