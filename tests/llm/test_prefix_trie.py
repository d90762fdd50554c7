"""The trie against brute force over rebuilt sequences, with many edge cases and with weak fingerprints."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from colweave.llm import prefix_trie
from colweave.llm.prefix_trie import Draw

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    """Every node by its whole sequence of turns. Turns of a conversation must not tie."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    result = {}
    for path, convs in nodes.items():
        subtree = [p for p in nodes if p[: len(path)] == path]
        parents = {p[:-1] for p in nodes if p}
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(path))
        result[min(convs), len(path)] = (
            min(nodes[path[:-1]]) if path else None,
            len(convs),
            sum(p[:-1] == path for p in nodes if p),
            sum(p not in parents for p in subtree),
            sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in subtree if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return result


def result_of(trie):
    rows = trie.collect()
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


def made_up(seed, convs=60):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-20, 200), convs):
        for turn in draw.sample([None, *range(12)], draw.randrange(1, 13)):
            rows.append((c, turn, draw.choice([None, "", "user", "bot"]), draw.choice([None, "", "a", "ab", "ünï", "b"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = made_up(seed)
    assert result_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)


def test_weak_fingerprints_are_found_out(spark):
    rows = made_up(9)
    tried = []

    def draws(attempt):
        tried.append(attempt)
        return Draw((5, 5, 5, 5), (2, 2, 2, 2), 0) if attempt < 2 else Draw.of(attempt)

    found = result_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), draws=draws))
    assert found == brute_force(rows) and tried == [0, 1, 2]


def test_fingerprints_multiply(spark):
    """The value of every stretch follows from running sums, over any layout in partitions."""
    draw = Draw.of(0)
    rows = [(7, k, "r", f"t{k}") for k in range(200)] + [(8, 0, "r", "x")]
    turns = prefix_trie.stored_turns(spark.createDataFrame(rows, SCHEMA), prefix_trie.Turns(), draw.salt)
    got = sorted(prefix_trie.turn_sums(turns, draw).where("c = 7").collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == list(range(1, 201))
    mask = (1 << 31) - 1
    value = [0] * 4
    for r in got:
        h1, h2 = r["h1"] % 2**64, r["h2"] % 2**64
        for k, letter in enumerate((h1 >> 33, h1 & mask, h2 >> 33, h2 & mask)):
            assert r[f"b{k}"] == value[k]
            p = draw.primes[k]
            value[k] = (value[k] + (letter + 1) * pow(draw.bases[k], r["pos"], p)) % p
            assert r[f"s{k}"] == value[k]


def test_edges(spark):
    rows = [
        (None, 1, "user", "no conversation"),
        (5, None, None, None),
        (5, 0, "", ""),
        (6, 0, "user", "x" * 200_000),
        (7, 3, "user", "a"),
        (20, 1, "user", "same"),
        (20, 1, "user", "same"),  # the same row again: a turn of its own
        (23, 1, "user", "same"),
        (23, 2, "user", "same"),
    ]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("c", "pos", "h", "depth", "_mark", "size")})
    expected = brute_force([r if r[0] != 20 else (20, k, *r[2:]) for k, r in enumerate(rows)])
    assert result_of(prefix_trie.prefix_trie(table)) == expected
    assert prefix_trie.prefix_trie(table.limit(0)).collect() == []
    assert prefix_trie.prefix_trie(table.where("conv_id is null")).collect() == []


def test_turnless_conversations_are_members_of_the_root(spark):
    lone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    assert result_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == {
        (lone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())
    }


def test_hot_conversation_and_hot_turn(spark):
    long = [(10, k, "user", f"turn {k % 7}") for k in range(3_000)]
    hot = [(c, k, "user", "hello" if k == 0 else f"own {c}") for c in range(100, 400) for k in range(3)]
    copies = [(c, k, "user", "copy") for c in range(1000, 2000, 5) for k in range(9)]
    rows = long + hot + copies
    found = result_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(8)))
    small = brute_force(hot + copies)
    deep = {key: value for key, value in found.items() if key[0] == 10 and key[1]}
    rest = {key: value for key, value in found.items() if key not in deep and key[1]}
    assert len(deep) == 3_000 and deep[10, 3_000][1:4] == (1, 0, 1)
    # but for the root, the long conversation has a subtree of its own; its id is the smallest
    assert rest == {key: (10 if key[1] == 1 else value[0], *value[1:]) for key, value in small.items() if key[1]}
