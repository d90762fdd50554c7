"""The mixer along texts: its code, its counts, and that it is a distribution that sees order."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from colweave.llm import context_mixing, language_model

TEXT = ("the cat sat on the mat . the dog sat on the log . a cat and a dog met on the mat . " * 30).split()
NAMES = sorted(set(TEXT))


def pieces(*texts):
    return [p for t in texts for p in context_mixing.pieces_of(np.array(t, np.int64), np.array(t, np.int64))]


@pytest.fixture(scope="module")
def codes():
    counts = Counter(TEXT)
    return context_mixing.Codes.of([counts[w] for w in NAMES] + [1])


@pytest.fixture(scope="module")
def mixer(codes):
    tables = np.zeros((2, 2 << 14), np.uint32)
    text = pieces([NAMES.index(w) for w in TEXT])
    context_mixing.add_bits(tables, context_mixing.lay_out_bits(codes, text))
    mixer = context_mixing.Mixer(codes, tables.astype(np.uint16))
    for _ in range(5):
        mixer.read(text, np.ones(1, bool), learn=True)
    return mixer


def test_codes_are_prefix_free(codes):
    of = lambda k: tuple(codes.bit[codes.start[k] : codes.start[k] + codes.length[k]])
    words = [of(k) for k in range(len(codes.length))]
    assert math.isclose(sum(2.0 ** -len(w) for w in words), 1)
    assert not any(a == b[: len(a)] for a in words for b in words if a is not b)
    assert len(context_mixing.Codes.of([5]).node) == 0


def test_counts_in_a_text_by_hand(codes):
    draw = random.Random(0)
    texts = [[draw.randrange(len(NAMES) + 1) for _ in range(n)] for n in (1, 90, 300, 1)]
    bits = context_mixing.lay_out_bits(codes, pieces(*texts))
    got = np.array(context_mixing.in_text(bits.one, bits)).T.tolist()
    whole, before = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    rows = list(zip(bits.piece.tolist(), bits.one.tolist(), bits.bit.tolist(), strict=True))
    for p, key, bit in rows:
        whole[p, key][bit] += 1
    for (p, key, bit), row in zip(rows, got, strict=True):
        assert row == [*before[p, key], *whole[p, key]]
        before[p, key][bit] += 1


@pytest.mark.parametrize("size", [0, 5, 63, 64, 200])
def test_next_words_share_probability_one(mixer, size):
    start = [NAMES.index(w) for w in TEXT[:size]]
    every = pieces(*([*start, k] for k in range(len(NAMES) + 1)))
    logs = mixer.read(every, np.zeros(len(every), bool))
    before = mixer.read(pieces(start), np.zeros(1, bool))[0] if start else 0.0
    assert math.isclose(np.exp(logs - before).sum(), 1, rel_tol=1e-4)


def test_texts_are_read_by_themselves(mixer):
    draw = random.Random(1)
    texts = [[draw.randrange(len(NAMES)) for _ in range(n)] for n in (3, 500, 70, 64, 1)]
    alone = [mixer.read(pieces(t), np.zeros(1, bool))[0] for t in texts]
    assert np.allclose(mixer.read(pieces(*texts), np.zeros(5, bool)), alone, rtol=1e-4)


def test_a_text_is_left_out_of_its_own_counts(codes):
    text = pieces([NAMES.index(w) for w in dict.fromkeys(TEXT)])
    tables = np.zeros((2, 2 << 14), np.uint32)
    none = context_mixing.Mixer(codes, tables.astype(np.uint16)).read(text, np.zeros(1, bool))
    context_mixing.add_bits(tables, context_mixing.lay_out_bits(codes, text))
    mixer = context_mixing.Mixer(codes, tables.astype(np.uint16))
    assert np.allclose(mixer.read(text, np.ones(1, bool)), none)
    assert mixer.read(text, np.zeros(1, bool)) > none


def test_turns_learn_one_after_the_other(codes):
    draw = random.Random(3)
    texts = [[draw.randrange(len(NAMES)) for _ in range(n)] for n in (1500, 6000, 3, 900, 8300, 70, 400)]
    text, tables = pieces(*texts), np.zeros((2, 2 << 14), np.uint16)
    one, many = (context_mixing.Mixer(codes, tables) for _ in range(2))
    parts = list(context_mixing.in_turns(text))
    assert len(parts) == 3 and [p for part in parts for p in part] == text
    apart = np.concatenate([many.read(p, np.zeros(len(p), bool), learn=True) for p in parts])
    assert np.allclose(one.read(text, np.zeros(len(text), bool), learn=True), apart, rtol=1e-4)
    assert np.allclose(one.cells, many.cells, atol=1e-4)


def test_words_of_many_texts_are_told_apart_at_once():
    texts = ["", "  a B\x0bc\n", "x\x0c\r\ty  ", " \t ", "\x1c\x85\u00c9 q\u00a0r \u0130 A", "a a", "b"]
    for some in (texts, texts[4:5], [""], ["c"]):
        tokens = language_model.Tokens.of(pa.array(some, pa.string()))
        names = [n.encode() for n in tokens.names.to_pylist()]
        assert len(set(names)) == len(names)
        whole = [language_model.split_words(t) + [b""] for t in some]
        got = [[names[k] for k in tokens.at[a:b]] for a, b in zip(tokens.first[:-1], tokens.first[1:], strict=True)]
        assert got == whole
        words = language_model.Words(["a", "", "q"])
        code, context = words.numbered(tokens)
        flat = [w for own in whole for w in own]
        assert code.tolist() == [{b"a": 0, b"": 1, b"q": 2}.get(w, 3) for w in flat]
        assert context.tolist() == [c if c < 3 else language_model.OTHERS + zlib.crc32(w) for c, w in zip(code, flat, strict=True)]


def test_rows_are_read_some_bytes_at_a_time(monkeypatch):
    monkeypatch.setattr(language_model, "READ_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (25, 3, 3, 3, 3, 0, 40, 1)], "row": list(range(8))})
    parts = list(language_model.some_texts(iter([batch, batch.slice(0, 0)])))
    assert [r for p in parts for r in p["row"].to_pylist()] == list(range(8))
    assert len(parts) == 3
    assert all(sum(map(len, p["text"].to_pylist()[1:])) <= 10 for p in parts)


def test_equal_stretches_of_spellings_are_worked_out_once():
    words = [b"abcab", b"abcab", b"bcabc", b"q"] * 50
    (stretch,) = language_model.lay_out(words)
    once, among, often = language_model.distinct(stretch)
    assert len(once.byte) == len({(bytes(stretch.contexts[:, k]), b) for k, b in enumerate(stretch.byte)}) < 20
    assert (once.byte[among] == stretch.byte).all() and (once.contexts[:, among] == stretch.contexts).all()
    assert often.sum() == len(stretch.byte)
    counts = np.zeros((len(language_model.ORDERS), 2**language_model.SLOT_BITS, 2), np.int64)
    for slots, bit, _ in language_model.bits_of(stretch):
        for k, own in enumerate(slots):
            np.add.at(counts[k], (own, bit), 1)
    assert (language_model.spelling_counts(words) == counts).all()


def test_long_texts_in_pieces():
    size = context_mixing.PIECE
    words = np.arange(2 * size + 9) % 7
    cut = list(context_mixing.pieces_of(words, words))
    assert [len(p[0]) for p in cut] == [size, size, 9]
    assert cut[1][1][0] == next(context_mixing.pieces_of(words[size - 1 :], words[size - 1 :]))[1][1]


def test_order_of_words_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    draw = random.Random(2)
    held = [(r["doc_id"], r["text"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    least = 1 + max(i for i, _ in held)
    free = (k for k in range(10 * least, 10**9) if zlib.crc32(str(k).encode()) % 7 == 2)
    moved, pairs = [], {}
    for i, text in held:
        words = (text or "").split()
        if len(words) > 50:
            draw.shuffle(words)
            new = next(free)
            moved.append((new, " ".join(words)))
            pairs[i] = new
    both = docs.union(spark.createDataFrame(moved, docs.schema))
    score = {r["doc_id"]: r["score"] for r in language_model.score_texts(both).collect()}
    lower = sum(score[new] < score[i] for i, new in pairs.items())
    assert lower > 0.95 * len(pairs)
    assert sum(score[new] for new in pairs.values()) < 1.05 * sum(score[i] for i in pairs)
