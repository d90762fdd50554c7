"""Alignment against brute force: byte ranges compared pair by pair with untouched tokenizers."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colweave.llm import token_alignment
from colweave.llm.queries import op13_token_alignment, piece_file, tokenizer_file


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(tokenizer_file())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_file())


def byte_alphabet():
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printed}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}


ALPHABET = byte_alphabet()


def tokens_of(text, sides):
    """(id, start, end) of both sides; None without tokens."""
    if not text:
        return None
    a, b = sides
    found = []
    for ids, piece in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda k: bytes(ALPHABET[c] for c in a.id_to_token(k))),
        (b.encode(text), lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()),
    ):
        at, placed, joined = 0, [], b""
        for k in ids:
            placed.append((k, at, at + len(piece(k))))
            at += len(piece(k))
            joined += piece(k)
        if joined != (" " + text).encode():
            return None
        found.append(placed)
    return found


def brute_force(texts, sides):
    known = [tokens_of(text, sides) for text in texts]
    links = []
    for found in known:
        own, low = [], 0
        for i, s, e in found[0] if found else ():
            while found[1][low][2] <= s:
                low += 1
            for j, u, v in found[1][low:]:
                if u >= e:
                    break
                if max(s, u) < min(e, v):
                    own.append((i, j))
        links.append(own)
    count = Counter(pair for own in links for pair in set(own))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    rows = []
    for found, own in zip(known, links, strict=True):
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        shared = {e for _, _, e in found[0]} & {e for _, _, e in found[1]}
        listing, low = [], 0
        for end in sorted(shared):
            listing.append("|".join(",".join(str(k) for k, s, e in side if low <= s and e <= end) for side in found) if len(texts) < 100 else "")
            low = end
        digest = hashlib.sha256(";".join(listing).encode()).hexdigest() if len(texts) < 100 else None
        rows.append((len(found[0]), len(found[1]), len(shared), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), digest))
    return rows, count, Counter(pair for own in links for pair in own)


EDGES = [
    None, "", " ", "  two  spaces  ", "plain words", "plain words", "a <|endoftext|> b <s> </s> <0x41>", "tab\tnew\nline\r\n",
    "日本語 ünïcödé 👍🏽 text", "ﬁ １ \xa0 ▁ x", "▁", "\x00\x1c odd", "x" * 3_000, "it's the end", "naïve café" * 50, "नमस्ते",
]


def columns_of(row):
    return tuple(row[name] for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


@pytest.mark.parametrize("docs_in_stretch", [1 << 16, 3])
def test_edges_against_brute_force(spark, sides, docs_in_stretch, monkeypatch):
    monkeypatch.setattr(token_alignment, "STRETCH_DOCS", docs_in_stretch)
    rows = [(k, text) for k, text in enumerate(EDGES)] + [(None, "plain words"), (4, "plain words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({name: F.lit("x") for name in ("pair", "stretch", "place", "n", "unit", "first", "n_a")})
    expected, count, links = brute_force([text for _, text in rows], sides)
    got = token_alignment.align(docs, tokenizer_file(), piece_file()).collect()
    of = lambda pairs: Counter((i, v) for i, v in pairs)
    assert of((r["doc_id"], columns_of(r)) for r in got) == of((i, v) for (i, _), v in zip(rows, expected, strict=True))
    written = token_alignment.write_postings(docs, tokenizer_file(), piece_file())
    pairs = token_alignment.pair_counts(written).collect()
    assert {(r["a"], r["b"]): r["n_docs"] for r in pairs} == count
    assert {(r["a"], r["b"]): r["n_links"] for r in pairs} == links
    assert token_alignment.align(docs.limit(0), tokenizer_file(), piece_file()).collect() == []


def test_query_against_brute_force(spark, sides, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected, _, _ = brute_force([r["text"] for r in rows], sides)
    got = {r["doc_id"]: columns_of(r)[:-1] for r in op13_token_alignment(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: values[:-1] for r, values in zip(rows, expected, strict=True)}


def test_containers():
    """Places and bits hold the same documents; planes add up to the links."""
    stretch = token_alignment.Stretch(5)
    draw = np.random.default_rng(0)
    truth = {}
    for place in range(300):
        times = Counter(draw.integers(0, 40, draw.integers(0, 30)).tolist() + [99] * int(draw.integers(1, 9)))
        stretch.documents.append((place, place, 0, 0, 0, 0, ""))
        stretch.pairs.append(np.array(sorted(times), np.int64))
        stretch.times.append(np.array([times[p] for p in sorted(times)], np.int64))
        stretch.held.append((place, len(times)))
        truth.update({(p, place): n for p, n in times.items()})
    found, kinds = Counter(), set()
    for batch in stretch.batches():
        for r in batch.to_pylist():
            if r["pair"] is None:
                continue
            assert r["stretch"] == 5
            kinds.add(r["bits"] is None)
            if r["bits"] is None:
                places = np.frombuffer(r["places"], "<u2")
            else:
                places = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little"))
            assert len(places) == r["n"]
            for place in places.tolist():
                found[r["pair"], place] += r["unit"]
    assert found == truth and kinds == {True, False}


def test_ids_by_rank_are_those_of_the_libraries(sides):
    draw = random.Random(1)
    aligner = token_alignment.Aligner(tokenizer_file(), piece_file())
    assert aligner.a_fast and aligner.b_fast
    for k in range(3_000):
        text = "".join(draw.choice("aeth \n\té ÿŁ\x00<>;\rɏ\x7f1 09xXßя中") for _ in range(draw.randrange(1, 40 if k else 5_000)))
        expected, found = tokens_of(text, sides), aligner.encode(text)
        assert (found is None) == (expected is None)
        if found:
            assert [ids.tolist() for ids in found] == [[k for k, _, _ in side] for side in expected]
