"""SentencePiece codec and packing: the library's own ids, round trips, and invariants of the packing."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from qualityspark.llm import packing as K  # noqa: E402
from qualityspark.llm import sentencepieces as S  # noqa: E402

MODEL = "piece_bpe_32k.model"
ODD = [
    "", " ", "a", " a", "a ", "Hello  world", "\n\t\r", "日本 語 🙂", "▁x", "a▁ ▁b", "▁", "\x00z", "é é é", "x" * 300, "ab" * 40 + " " * 70 + "q",
    "<s> </s> <unk> <0x41>", "don't", "� \U0010ffff", "ß" * 33, " leading and trailing  ",
]


@pytest.fixture(scope="module")
def model():
    return S.Model(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def rows(ids, sizes):
    ends = np.cumsum(sizes)
    return [ids[e - n : e].tolist() for e, n in zip(ends, sizes)]


def test_without_dropout_the_ids_are_the_librarys(model, library):
    plain = [t for t in ODD if S.SPACE not in t]
    assert rows(*S.encode_texts(model, plain, np.arange(len(plain)), 1, 0.0)) == library.encode(plain)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_round_trip(model, library, dropout):
    ids, sizes = S.encode_texts(model, ODD, np.arange(len(ODD)), 5, dropout)
    assert S.decode_ids(model, ids, sizes) == ODD
    assert library.decode(rows(ids, sizes)) == ODD


def test_matrix_and_heap_agree_under_dropout(model):
    rng = random.Random(4)
    words = ["▁" + "".join(rng.choice("etaoinshrdlué▁") for _ in range(rng.randrange(0, 31))) for _ in range(800)]
    words = [w for w in words if "▁" not in w.lstrip("▁")]
    keys = np.array([rng.getrandbits(64) for _ in words], np.uint64)
    flat, start, count = S.segment(model, words, keys, 2**62)
    for w, key, at, n in zip(words, keys, start, count):
        symbols = model.symbol[np.frombuffer(w.encode("utf-32-le"), np.uint32)].tolist()
        assert S.one_by_one(model, symbols, int(key), 2**62) == flat[at : at + n].tolist()


def test_dropout_varies_by_place_and_repeats_by_seed(spark, documents):
    docs = documents([(i, "international communications " * 40) for i in range(4)] + [(9, None), (9, "")])
    one = {r.doc_id: r.ids for r in S.encode(docs).collect()}
    assert one == {r.doc_id: r.ids for r in S.encode(docs.repartition(3)).collect()}
    assert len({tuple(one[i]) for i in range(4)}) == 4 and one[9] == []
    assert one != {r.doc_id: r.ids for r in S.encode(docs, seed=2).collect()}
    back = S.decode(S.encode(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert S.decode(S.encode(documents([]))).count() == 0


def test_each_place_has_draws_of_its_own(model):
    word, n, skip = "internationalization", 6000, int(0.1 * 2**64)
    ids, sizes = S.encode_texts(model, [word] * n, np.arange(n), 3, 0.1)
    ways = [tuple(r) for r in rows(ids, sizes)]
    assert 16 < len(set(ways[:300])) < len(set(ways[:1500])) < len(set(ways))
    # The first offer of the agenda is skipped in a tenth of the documents, other words' offers of the same piece independently.
    seen = S.Seen()
    S.encode_texts(model, [word] * 2, np.arange(2), 3, 0.1, seen)
    agenda = seen.root[0]
    start, piece = seen.at[seen.first[agenda]], seen.piece[seen.first[agenda]]
    keys = S._mix(S._mix(np.arange(n).astype(np.uint64) ^ np.uint64(3)))
    skipped = S.draws(keys, np.full(n, start), np.full(n, piece)) < np.uint64(skip)
    assert 0.08 < skipped.mean() < 0.12
    assert all(S.draw(int(k), int(start), int(piece)) == int(d) for k, d in zip(keys[:50], S.draws(keys[:50], np.full(50, start), np.full(50, piece))))


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_kept_agendas_change_nothing(model, dropout):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlué日") for _ in range(rng.choice([1, 3, 8, 20, 31, 40]))) for _ in range(60)]
    texts = [" ".join(rng.choice(words[:6] if rng.random() < 0.6 else words) for _ in range(30)) for _ in range(200)]
    keys, seen, skip = np.arange(200), S.Seen(), int(dropout * 2**64)
    got = [r for low in range(0, 200, 50) for r in rows(*S.encode_texts(model, texts[low : low + 50], keys[low : low + 50], 7, dropout, seen))]
    assert len(seen.word) > 100
    for key, text, ids in zip(keys, texts, got):
        chunks = S._chunks(S.SPACE + text.replace(" ", S.SPACE))
        own = S._mix(np.array([key], np.uint64) ^ np.uint64(7))
        place = S._mix(own + np.arange(len(chunks)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        assert S.segment(model, chunks, place, skip)[0].tolist() != [] and ids == [
            i for c, k in zip(chunks, place) for i in S.segment(model, [c], np.array([k], np.uint64), skip)[0].tolist()
        ]


def test_fullest_is_the_best_sum():
    rng = random.Random(5)
    for _ in range(150):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(0, 60)
        chosen = K.fullest(counts, room)
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts.values())) if (s := sum(k * m for k, m in zip(counts, c))) <= room)
        assert sum(k * m for k, m in chosen.items()) == best and all(m <= counts[k] for k, m in chosen.items())


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    counts = Counter(rng.choice([1024, 1, rng.randrange(1, 1025), rng.randrange(1, 200)]) for _ in range(5000))
    bins = K.plan_bins(dict(counts))
    placed = Counter()
    for times, chosen in bins:
        assert sum(k * m for k, m in chosen.items()) <= 1024
        placed.update({k: times * m for k, m in chosen.items()})
    assert placed == counts
    assert sum(t for t, _ in bins) <= -(-sum(k * n for k, n in counts.items()) // 1024) + 2
    assert K.plan_bins({}) == []


def test_packed_documents(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "Ärger", "of\n", "x1", "12 345"]) for _ in range(rng.choice([1, 3, 40, 1000, 1023, 1024, 5000]))) for _ in range(60)]
    rows = [*enumerate(["", None, "<|endoftext|> a", "a" * 3000, "  \n\n  ", *texts])]
    got = K.pack_documents(documents(rows), with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum((r.ids for r in pieces), []) == ids
        assert len(pieces) == -(-len(ids) // 1024) and all(r.length == 1024 for r in pieces[1:])
        at = 0
        for r in pieces:
            assert (r.start, r.length, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
            at += r.length
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert K.pack_documents(documents([])).count() == 0


def test_repeated_documents_are_packed_one_by_one(spark, documents):
    got = K.pack_documents(documents([(1, "a b c")] * 700)).collect()
    assert len(got) == 700 and len({(r.sequence_id, r.offset) for r in got}) == 700
    assert len({r.sequence_id for r in got}) == -(-700 * got[0].length // 1024)


def test_two_million_blanks(spark, documents):
    """Runs beyond what the library of ranks can take have the vocabulary's own ids."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(K.VOCABULARY))
    rows = [(1, "a" + " " * 2_000_000 + "b"), (2, "\n" * 1_100_000), (3, "plain <|endoftext|> text")]
    got = K.token_pieces(documents(rows), with_ids=True).orderBy("doc_id", "piece").collect()
    for doc_id, text in rows:
        ids = [i for r in got if r.doc_id == doc_id for i in r.ids]
        assert ids == [*whole.encode(text, add_special_tokens=False).ids, K.END_ID]


def test_pieces_with_clashing_names(spark):
    rows = [(i, 0, 5 + i % 3, "x", i, i, "y", i) for i in range(20)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, part string, nth long, ahead long, rank string, n long")
    got = K.pack(pieces, 16).collect()
    assert len(got) == 20 and all((r.part, r.nth, r.ahead, r.rank, r.n) == ("x", r.doc_id, r.doc_id, "y", r.doc_id) for r in got)
    assert all(r.offset + r.length <= 16 for r in got)
