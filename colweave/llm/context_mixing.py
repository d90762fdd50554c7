"""Online logistic context mixing along texts, over the bits of a prefix code for words.

Frequent words, and an escape for all others, have a prefix code made from their counts. A text is read
word by word, bit by bit. Each bit is predicted from what the corpus had in hashed contexts (no word,
the word before, the two words before) and from what this text has had so far (no word, the word
before). A logistic mixer, its weights gated by how much the contexts have seen and moved along
the text block by block, combines them, and a table refines the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Words of a text whose bits share a state of its mixer, and after which its own memory starts anew.
BLOCK, PIECE = 64, 2_048
#: Words that are laid out at a time, and those whose texts learn side by side.
FLUSH, TURN = 32_768, 8_192
#: Slots of a context table as a power of two: least and most.
SLOT_BITS = (14, 22)
#: Inputs of the mixer, the constant last.
INPUTS = 6
GATES = 4 * 4 * 3 * 3
KNOTS, STRETCH = 33, 8.0
STEP, OWN_STEP = 0.03, 0.002
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


@dataclass(frozen=True)
class Codes:
    """The code of each symbol as nodes and bits, one after the other, and how often each way was taken."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    ways: np.ndarray  # (nodes, 2)

    @cached_property
    def way(self) -> np.ndarray:
        """Node and bit in one number."""
        return (self.node << 1 | self.bit).astype(np.int32)

    @classmethod
    def of(cls, counts: Sequence[int]) -> Codes:
        """Huffman's code; a single symbol takes no bits."""
        many = len(counts)
        weight, parent, side = list(counts), [0] * (2 * many), [0] * (2 * many)
        heap = [(c, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        ways = []
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            own = len(weight)
            parent[left] = parent[right] = own
            side[right] = 1
            weight.append(a + b)
            ways.append((a, b))
            heapq.heappush(heap, (a + b, own))
        root = len(weight) - 1
        nodes, bits, lengths = [], [], []
        for k in range(many):
            path, at = [], k
            while at != root:
                path.append((parent[at] - many, side[at]))
                at = parent[at]
            lengths.append(len(path))
            nodes += [n for n, _ in reversed(path)]
            bits += [s for _, s in reversed(path)]
        length = np.array(lengths, np.int64)
        return cls(np.cumsum(length) - length, length, np.array(nodes, np.int64), np.array(bits, np.int64), np.array(ways, np.int64).reshape(-1, 2))


@dataclass(frozen=True)
class Bits:
    """The bits of some pieces of texts, block by block over all of them, in each block piece by piece."""

    owner: np.ndarray  # piece of each word
    length: np.ndarray  # bits of each word
    start: np.ndarray  # first bit of each word
    contexts: tuple[np.ndarray, np.ndarray]  # hashed word before and two words before, of each word
    node: np.ndarray
    bit: np.ndarray
    last: np.ndarray  # the bit, plus 2 at the end of a code
    stretches: np.ndarray  # first bit of the words that a piece has in a block, and the end
    texts: np.ndarray  # piece of each stretch
    blocks: np.ndarray  # first stretch of each block, and the end

    @property
    def piece(self) -> np.ndarray:
        return np.repeat(self.owner, self.length)

    @property
    def one(self) -> np.ndarray:
        """Hashed word before, and node."""
        return np.concatenate([keys[0] for *_, keys in self.keys()])

    def keys(self, words: int = 4_096) -> Iterator[tuple[slice, slice, tuple[np.ndarray, np.ndarray]]]:
        """Some words at a time, their bits, and the two hashed contexts and node of each bit."""
        ends = np.append(self.start, len(self.node))
        for low in range(0, len(self.length), words):
            some = slice(low, low + words)
            bits = slice(int(ends[low]), int(ends[min(low + words, len(self.length))]))
            node = self.node[bits].astype(np.uint64)
            node *= _MIX[2]
            keys = tuple(np.repeat(x[some], self.length[some]) for x in self.contexts)
            for key in keys:
                key ^= node
                key *= _MIX[3]
            yield some, bits, keys


def table_bits(tokens: int) -> int:
    """Slots for so many words, as a power of two."""
    return min(max(int(4 * tokens).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])


def pieces_of(symbol: np.ndarray, context: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts a text; each word with the context numbers of the one and the two words before it."""
    before = np.concatenate([np.zeros(2, np.uint64), context.astype(np.uint64) + np.uint64(1)])
    one = before[1:-1] * _MIX[0]
    two = (one ^ (before[:-2] + np.uint64(7))) * _MIX[1]
    for k in range(0, len(symbol), PIECE):
        yield symbol[k : k + PIECE], one[k : k + PIECE], two[k : k + PIECE]


def in_turns(pieces: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Cuts pieces into groups of a little over TURN words."""
    turn, size = [], 0
    for piece in pieces:
        turn.append(piece)
        size += len(piece[0])
        if size > TURN:
            yield turn
            turn, size = [], 0
    if turn:
        yield turn


def lay_out_bits(codes: Codes, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], turns: bool = False) -> Bits:
    """With ``turns`` the blocks of one turn come before those of the next."""
    sizes = [len(p[0]) for p in pieces]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    place = np.concatenate([np.arange(n) // BLOCK for n in sizes])
    if turns:
        of = np.repeat(*zip(*((k, len(turn)) for k, turn in enumerate(in_turns(pieces))), strict=True))
        place += of.take(owner) * (PIECE // BLOCK)
    place = place.astype(np.int16)
    order = np.argsort(place, kind="stable")
    symbol, one, two = (np.concatenate([p[k] for p in pieces]).take(order) for k in range(3))
    owner, place = owner.take(order), place.take(order)
    length = codes.length.take(symbol)
    ends = np.cumsum(length)
    start = ends - length
    at = np.repeat((codes.start.take(symbol) - start).astype(np.int32), length)
    at += np.arange(len(at), dtype=np.int32)
    way = codes.way.take(at, mode="clip") if len(at) else at
    new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(place, prepend=np.int16(-1)) != 0))
    blocks = np.searchsorted(place.take(new), np.arange(int(place.max(initial=-1)) + 2))
    stretches = np.append(start.take(new), len(way))
    bit = (way & 1).astype(np.int8)
    last = bit.copy()
    last[ends[length > 0] - 1] += 2
    return Bits(owner, length, start, (one, two), way >> 1, bit, last, stretches, owner.take(new), blocks)


def in_text(key: np.ndarray, bits: Bits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Zeros and ones under each key of a piece: before a bit, and in the whole piece."""
    before, whole = counts_in_text(key.take(bits.start, mode="clip"), bits)
    return *halves(before), *halves(whole)


def halves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of what counts_in_text gives; a piece has fewer than 2**15 words."""
    return pairs & np.int32(65_535), pairs >> np.int32(16)


def counts_in_text(context: np.ndarray, bits: Bits, wholly: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each bit, the bits at its node in words of its piece that have its word's context: before it,
    and ``wholly`` in the whole piece. Zeros in the lower half of a number, ones in the upper.

    Words are grouped by piece and context, and the groups cut, bit by bit, along the code. A word that
    is alone in its group needs no further look.
    """
    seen = np.zeros(len(bits.bit), np.int32)
    whole = bits.bit * np.int32(65_535 * wholly)
    whole += np.int32(wholly)
    if not len(bits.bit):
        return seen, whole
    key = (context ^ (bits.owner.astype(np.uint64) + np.uint64(1)) * _MIX[1]) * _MIX[0]
    rows = np.sort((key & ~np.uint64(2**23 - 1)) | np.arange(len(key), dtype=np.uint64))
    group = rows >> np.uint64(23)
    opens = np.flatnonzero(np.concatenate([np.ones(1, bool), group[1:] != group[:-1]]))
    at = bits.start.take((rows & np.uint64(2**23 - 1)).view(np.int64)).astype(np.int32)
    goes_on = np.ones(len(opens), bool)
    while True:
        size = np.diff(opens, append=len(at))
        goes_on &= size > 1
        if not goes_on.all():
            at, size = at[np.repeat(goes_on, size)], size[goes_on]
            opens = np.cumsum(size) - size
        if not len(at):
            return seen, whole
        last = bits.last.take(at)
        own = last & np.int8(1)
        before = np.cumsum(own, dtype=np.int32)
        ends = before.take(opens + (size - 1))
        ones = np.diff(ends, prepend=np.int32(0))
        zeros = size.astype(np.int32) - ones
        first = opens.astype(np.int32)
        before -= own
        before -= np.repeat(ends - ones, size)
        to = np.arange(len(at), dtype=np.int32)
        to -= before  # of a zero: the place of its group and the zeros before
        seen[at] = (to - np.repeat(first, size)) | before << np.int32(16)
        if wholly:
            whole[at] = np.repeat(zeros | ones << np.int32(16), size)
        # the next nodes, each with its words in their order; all words of a node end or none does
        before += np.repeat(first + zeros, size)
        np.copyto(to, before, where=own.view(bool))
        moved = np.empty_like(at)
        at += np.int32(1)
        moved[to] = at
        at = moved
        some = np.stack([zeros, ones], axis=1) > 0
        opens = np.stack([opens, opens + zeros], axis=1)[some]
        goes_on = bits.last.take(at.take(opens) - 1) < 2


def add_bits(tables: np.ndarray, bits: Bits) -> None:
    """Counts bits into the (2, slots * 2) tables."""
    shift = np.uint64(64 - (tables.shape[1].bit_length() - 2))
    for _, own, keys in bits.keys():
        for table, key in zip(tables, keys, strict=True):
            key >>= shift
            key <<= np.uint64(1)
            slot = key.view(np.int64)
            slot += bits.bit[own]
            np.add.at(table, slot, np.uint32(1))


def _stretched(zeros: np.ndarray, ones: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Puts the log of the odds into ``out``; gives how much was seen."""
    below = zeros.astype(np.float32)
    below += np.float32(0.15)
    np.add(ones, np.float32(0.15), out=out, dtype=np.float32, casting="same_kind")
    out /= below
    np.log(out, out=out)
    return zeros + ones


def _level(seen: np.ndarray, *steps: int) -> np.ndarray:
    """How many of the steps were reached."""
    level = (seen >= steps[0]).view(np.int8)
    for step in steps[1:]:
        level = level + (seen >= step)
    return level


#: By how much was seen: after one word and two in the corpus, after one and none in the text.
ONE, TWO, OWN_ONE, OWN = (1, 5, 50), (1, 3, 20), (1, 3), (1, 4)


class Mixer:
    """Gated weights and the refining table, over the tables of the corpus."""

    def __init__(self, codes: Codes, tables: np.ndarray):
        self.codes, self.tables = codes, tables
        self.weights = np.full((GATES, INPUTS), 0.3, np.float32)
        self.weights[:, -1] = 0
        self.pulled = np.full((GATES, INPUTS), 1e-3)
        knots = np.linspace(-STRETCH, STRETCH, KNOTS)
        self.refine = np.tile(1 / (1 + np.exp(-knots)), (16, 1))
        self._plain = np.empty(len(codes.ways), np.float32)
        _stretched(*codes.ways.T, self._plain)

    @property
    def cells(self) -> np.ndarray:
        """All that is learned, as one row."""
        return np.concatenate([self.weights.ravel(), self.refine.ravel()])

    def put(self, cells: np.ndarray) -> None:
        cut = self.weights.size
        self.weights = cells[:cut].reshape(GATES, INPUTS).astype(np.float32)
        self.refine = cells[cut:].reshape(16, KNOTS).copy()

    def _inputs(self, bits: Bits, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs but the constant, gate and first cell of the table of each bit; a training text's own bits
        after the same word, and the bit itself after the same two, are taken out of the counts."""
        shift = np.uint64(64 - (self.tables.shape[1].bit_length() - 2))
        pairs = self.tables.view(np.uint32)
        many = len(bits.bit)
        x, gates, rows = np.empty((INPUTS - 1, many), np.float32), np.empty(many, np.int16), np.empty(many, np.int16)
        after, whole = counts_in_text(bits.contexts[0], bits, wholly=bool(trained.any()))
        free, _ = counts_in_text(np.zeros(len(bits.owner), np.uint64), bits, wholly=False)
        for some, own, keys in bits.keys():
            part = x[:, own]
            self._plain.take(bits.node[own], out=part[0], mode="clip")
            bit = bits.bit[own]
            less = halves(whole[own]), (1 - bit, bit)
            taught = trained.take(bits.owner[some])
            if not taught.all():
                mine = np.repeat(taught, bits.length[some])
                less = tuple((zeros * mine, ones * mine) for zeros, ones in less)
            seen = []
            for k, key in enumerate(keys):
                key >>= shift
                pair = pairs[k].take(key.view(np.int64), mode="clip")
                zeros, ones = (pair & np.uint32(65_535)).view(np.int32), (pair >> np.uint32(16)).view(np.int32)
                zeros -= less[k][0]
                ones -= less[k][1]
                np.maximum(zeros, 0, out=zeros)
                np.maximum(ones, 0, out=ones)
                seen.append(_stretched(zeros, ones, part[1 + k]))
            for k, pair in enumerate((free, after)):
                seen.append(_stretched(*halves(pair[own]), part[3 + k]))
            two, again = _level(seen[1], *TWO), _level(seen[3], *OWN_ONE)
            gates[own] = ((_level(seen[0], *ONE) * np.int16(4) + two) * 3 + again) * 3 + _level(seen[2], *OWN)
            rows[own] = (two * np.int16(4) + again) * KNOTS
        return x, gates, rows

    def read(self, pieces: list[tuple], trained: np.ndarray, learn: bool = False) -> np.ndarray:
        """Natural log probability of each piece; ``learn`` moves the shared weights and the table too.

        The weights that a text adds of its own start at none and move after each of its blocks; the shared ones
        move after each block of a turn.
        """
        bits = lay_out_bits(self.codes, pieces, turns=learn)
        total = np.zeros(len(pieces))
        if not len(bits.bit):
            return total
        inputs, gates, rows = self._inputs(bits, trained)
        moved = np.zeros((INPUTS, len(pieces)), np.float32)
        one, half, scale = np.float32(1), np.float32(0.5), np.float32((KNOTS - 1) / (2 * STRETCH))
        weights, flat = np.ascontiguousarray(self.weights.T), self.refine.ravel().astype(np.float32)
        for k, end in zip(bits.blocks[:-1].tolist(), bits.blocks[1:].tolist(), strict=True):
            low, high = int(bits.stretches[k]), int(bits.stretches[end])
            if low == high:
                continue
            x, gate, texts = inputs[:, low:high], gates[low:high].astype(np.int64), bits.texts[k:end]
            firsts, sizes = bits.stretches[k:end] - low, np.diff(bits.stretches[k : end + 1])
            bit = bits.bit[low:high].astype(np.float32)
            z = weights[-1].take(gate, mode="clip")
            z += np.repeat(moved[-1].take(texts), sizes)
            for j in range(INPUTS - 1):
                w = weights[j].take(gate, mode="clip")
                w += np.repeat(moved[j].take(texts), sizes)
                w *= x[j]
                z += w
            np.maximum(z, np.float32(0.01 - STRETCH), out=z)
            np.minimum(z, np.float32(STRETCH - 0.01), out=z)
            p = np.exp(-z)
            p += one
            np.divide(one, p, out=p)
            z += np.float32(STRETCH)
            z *= scale
            knot = z.astype(np.int16)
            z -= knot
            cell = (rows[low:high] + knot).astype(np.int64)
            final = flat.take(cell, mode="clip")
            above = flat[1:].take(cell, mode="clip")
            above -= final
            above *= z
            final += above
            final += p
            final *= half
            np.maximum(final, np.float32(1e-5), out=final)
            np.minimum(final, np.float32(1 - 1e-5), out=final)
            final -= one - bit
            np.abs(final, out=final)
            total[texts] += np.add.reduceat(np.log(final, out=final), firsts, dtype=np.float64)
            error = np.subtract(bit, p, out=p)
            for j in range(INPUTS):
                pull = x[j] * error if j < INPUTS - 1 else error
                moved[j, texts] += np.float32(OWN_STEP) * np.add.reduceat(pull, firsts)
                if learn:
                    slope = np.bincount(gate, pull, GATES)
                    self.pulled[:, j] += slope * slope
                    self.weights[:, j] += STEP * slope / np.sqrt(self.pulled[:, j])
            if learn:
                cell += z > 0.5
                hits = np.bincount(cell, minlength=16 * KNOTS).reshape(16, KNOTS)
                ones = np.bincount(cell, bit, 16 * KNOTS).reshape(16, KNOTS)
                self.refine += (ones - hits * self.refine) / (hits + 200)
                weights, flat = np.ascontiguousarray(self.weights.T), self.refine.ravel().astype(np.float32)
        return total
