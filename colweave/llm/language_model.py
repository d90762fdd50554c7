"""Log probability of texts: hashed contexts mixed bit by bit, along the text and inside new words.

A text is read word by word. Frequent words, and an escape for all others, have a prefix code; its
bits are predicted by hashed contexts and mixed online (``context_mixing``). What an escape stands for
is a rarer word: counts of whole words take over where there are any, discounted, with the mass taken
from them given to the spelling. Among its escapes a text's own rare words become likelier: a Chinese
restaurant process, averaged over several concentrations.

A word is spelled bit by bit. Predictors with hashed contexts of one to five bytes each give a
probability; a logistic mixer with weights chosen by how much the longest contexts have seen combines
them, and a final table refines the result. Mixer and table learn online, word after word, each word
left out of the counts that predict it.

Mixers and tables learn from all training texts and words: each task learns along its own, and what
the tasks have learned is averaged.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .context_mixing import FLUSH, Codes, Mixer, add_bits, in_turns, lay_out_bits, pieces_of, table_bits
from .text import remainder, whole_text

MODULUS, HELD = 7, 2
#: Context lengths in bytes, and slots of each predictor as a power of two.
ORDERS = (1, 2, 3, 4, 5)
SLOT_BITS = 18
#: Slots that travel together when counts are added up.
CHUNK = 4_096
#: Words, at most, the most frequent ones, that have codes, in every task; all others are joined.
FREQUENT = 65_536
#: Context numbers of the other words start here.
OTHERS = 1 << 20
#: Words for each task that fills or learns with a context table, at least, beyond a task a core.
TASK_WORDS = 1 << 25
#: Concentrations of the cache, each with the same prior weight.
ALPHAS = (10.0, 100.0, 1_000.0, 10_000.0, 100_000.0)
STEP_BYTES = 16_384
#: Bytes of spellings that are counted at a time.
COUNT_BYTES = 262_144
#: Bytes of texts whose words are told apart at a time; a longer text by itself.
READ_BYTES = 1 << 21
LN10 = math.log(10)


def in_pieces(batch: pa.RecordBatch, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Bounds what goes to Spark at a time."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def split_words(text: str) -> list[bytes]:
    """Words of a text: A-Z in lower case, split at ASCII white space only."""
    return text.encode().lower().split()


@dataclass(frozen=True)
class Tokens:
    """Words of some texts and the end of each, the empty word, as places among the distinct ones."""

    names: pa.Array
    at: np.ndarray
    first: np.ndarray  # first word of each text, and the end

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        """As split_words does, for all ``texts`` at once."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        encoded = lists.flatten().dictionary_encode()
        names, at = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
        end = pc.index(names, pa.scalar("", names.type)).as_py()
        if end < 0:
            end = len(names)
            names = pa.concat_arrays([names, pa.array([""], names.type)])
        word = at != end  # white space at the sides leaves empty pieces
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(word)])
        size = np.diff(before.take(lists.offsets.to_numpy())) + 1
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        whole = np.full(first[-1], end, np.int64)
        inside = np.ones(len(whole), bool)
        inside[first[1:] - 1] = False
        whole[inside] = at[word]
        return cls(names, whole, first)

    def added(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        return np.add.reduceat(values, self.first[:-1])


def some_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with READ_BYTES of the column text, or a little more, or one text."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // READ_BYTES, prepend=0)).tolist()
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if low < high:
                yield batch.slice(low, high - low)


# --- spelling ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stretch:
    """Bytes of words, each word closed by a space, with their hashed contexts."""

    byte: np.ndarray
    word: np.ndarray
    contexts: np.ndarray  # one row for each order


def lay_out(words: list[bytes], step: int = STEP_BYTES) -> Iterator[Stretch]:
    """Stretches of at most ``step`` bytes; a longer word goes on in the next one."""
    joined = np.frombuffer(b" ".join(words) + b" ", np.uint8) if words else np.zeros(0, np.uint8)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    reach = max(ORDERS)
    padded = np.concatenate([np.zeros(reach, np.uint8), joined])
    for low in range(0, len(joined), step):
        high = min(low + step, len(joined))
        own = place[low:high]
        contexts, h = [], np.zeros(high - low, np.uint64)
        for k in range(1, reach + 1):
            before = np.where(own >= k, padded[reach + low - k : reach + high - k].astype(np.uint64) + 1, 0)
            h = (h + before.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            if k in ORDERS:
                contexts.append(h)
        yield Stretch(joined[low:high], word[low:high], np.array(contexts))


def distinct(stretch: Stretch) -> tuple[Stretch, np.ndarray, np.ndarray]:
    """Each byte in its longest context once, where the bytes of the stretch are among them, and how often."""
    key = (stretch.contexts[-1] ^ (stretch.byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
    _, first, among, often = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return Stretch(stretch.byte.take(first), stretch.word.take(first), stretch.contexts.take(first, axis=1)), among, often


def bits_of(stretch: Stretch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the eight bits, highest first: slots by order, the bits, the bits before in the byte."""
    for bit in range(7, -1, -1):
        partial = (1 << (7 - bit)) | (stretch.byte.astype(np.int64) >> (bit + 1))
        key = partial.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (stretch.contexts ^ key) * np.uint64(0xC2B2AE3D27D4EB4F)
        yield (mixed >> np.uint64(64 - SLOT_BITS)).view(np.int64), (stretch.byte >> bit) & 1, partial


def spelling_counts(words: list[bytes]) -> np.ndarray:
    """Zeros and ones seen in each slot: (orders, slots, 2)."""
    counts = np.zeros((len(ORDERS), 2**SLOT_BITS * 2), np.int64)
    for stretch in lay_out(words, COUNT_BYTES):
        stretch, _, often = distinct(stretch)
        for slots, bit, _ in bits_of(stretch):
            for k in range(len(ORDERS)):
                np.add.at(counts[k], slots[k] * 2 + bit, often)
    return counts.reshape(len(ORDERS), 2**SLOT_BITS, 2)


def _stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)


def _confidence(total: np.ndarray) -> np.ndarray:
    """0 to 3: nothing, little, some or much seen."""
    return np.searchsorted([1, 3, 20], total, "right").astype(np.uint8)


KNOTS = 33  # of the refining table, over stretched probabilities of -8 to 8


class Speller:
    """Probabilities of spellings from the counts, a gated mixer and a refining table."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.table = _stretched(counts[..., 0], counts[..., 1])
        self.seen = _confidence(counts.sum(axis=2))
        self.weights = np.full((16, len(ORDERS) + 1), 1 / len(ORDERS))
        self.weights[:, -1] = 0
        knots = np.linspace(-8, 8, KNOTS)
        self.refine = np.tile(1 / (1 + np.exp(-knots)), (256, 1))

    def for_scoring(self) -> Speller:
        """A copy without the counts, to send to tasks."""
        other = object.__new__(Speller)
        other.__dict__ = self.__dict__ | {"counts": None}
        return other

    @property
    def cells(self) -> np.ndarray:
        """All that is learned, as one row."""
        return np.concatenate([self.weights.ravel(), self.refine.ravel()])

    def put(self, cells: np.ndarray) -> None:
        cut = self.weights.size
        self.weights, self.refine = cells[:cut].reshape(16, -1).copy(), cells[cut:].reshape(256, KNOTS).copy()

    def _combine(self, inputs: np.ndarray, gate: np.ndarray, partial: np.ndarray):
        w = self.weights.T.astype(np.float32)
        z = np.take(w[-1], gate)
        for k, x in enumerate(inputs):
            z += x * np.take(w[k], gate)
        z = np.clip(z, -7.99, 7.99)
        p = 1 / (1 + np.exp(-z))
        at = (z + 8) * (KNOTS - 1) / 16
        low = at.astype(np.int64)
        part = at - low
        cell = partial * KNOTS + low
        flat = self.refine.ravel()
        refined = np.take(flat, cell) * (1 - part) + np.take(flat, cell + 1) * part
        return p, np.clip((p + refined) / 2, 1e-5, 1 - 1e-5), low, part

    def learn(self, words: list[bytes], batch: int = 500, rate: float = 0.02) -> None:
        """Pass over ``words`` online; each is taken out of the counts before it is predicted."""
        pairs = np.minimum(self.counts, 2**31 - 1).astype(np.int32).view(np.int64)[..., 0]
        for k in range(0, len(words), batch):
            for stretch in lay_out(words[k : k + batch]):
                stretch, _, often = distinct(stretch)
                for slots, bit, partial in bits_of(stretch):
                    inputs = np.empty((len(ORDERS), len(bit)), np.float32)
                    conf = []
                    for o in range(len(ORDERS)):
                        zeros, ones = pairs[o].take(slots[o]).view(np.int32).reshape(-1, 2).T
                        zeros, ones = np.maximum(zeros - (1 - bit.view(np.int8)), 0), np.maximum(ones - bit.view(np.int8), 0)
                        inputs[o] = _stretched(zeros.astype(np.float32), ones.astype(np.float32))
                        if o >= len(ORDERS) - 2:
                            total = zeros + ones
                            conf.append((total >= 1).astype(np.int64) + (total >= 3) + (total >= 20))
                    gate = conf[0] * 4 + conf[1]
                    p, _, low, part = self._combine(inputs, gate, partial)
                    error = (bit - p) * often
                    size = np.maximum(np.sqrt(np.bincount(gate, often, 16)), 1)
                    for j in range(len(ORDERS) + 1):
                        pull = inputs[j] * error if j < len(ORDERS) else error
                        self.weights[:, j] += rate * np.bincount(gate, pull, 16) / size / 10
                    nearest = low + (part > 0.5)
                    cell = partial * KNOTS + nearest
                    hits = np.bincount(cell, often, 256 * KNOTS).reshape(256, KNOTS)
                    ones_at = np.bincount(cell, bit * often, 256 * KNOTS).reshape(256, KNOTS)
                    self.refine += (ones_at - hits * self.refine) / (hits + 50)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word, its closing space included."""
        total = np.zeros(len(words))
        for stretch in lay_out(words, COUNT_BYTES):
            word = stretch.word
            stretch, among, _ = distinct(stretch)
            cost = np.zeros(len(stretch.byte))
            for slots, bit, partial in bits_of(stretch):
                inputs = [np.take(self.table[o], slots[o]) for o in range(len(ORDERS))]
                gate = np.take(self.seen[-2], slots[-2]).astype(np.int64) * 4 + np.take(self.seen[-1], slots[-1])
                _, p, _, _ = self._combine(inputs, gate, partial)
                cost += np.log(np.where(bit == 1, p, 1 - p))
            total += np.bincount(word, cost.take(among), len(words))
        return total / LN10


# --- corpus -----------------------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (token, c): the count in training rows, 0 for words of other rows alone; the text end is the
    empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_texts(batches):
            tokens = Tokens.of(batch["text"])
            train = np.repeat(batch["train"].to_numpy(zero_copy_only=False).astype(bool), np.diff(tokens.first))
            uses = np.bincount(tokens.at[train], minlength=len(tokens.names))
            yield from in_pieces(pa.RecordBatch.from_pydict({"token": tokens.names, "c": uses}))

    rows = docs.select(whole_text("text").alias("text"), _trains().alias("train"))
    return rows.mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _trains() -> Column:
    return F.coalesce(remainder("doc_id", MODULUS) != HELD, F.lit(False))


def _added(parts: DataFrame, kind: type) -> DataFrame:
    """Sums of the arrays of ``kind`` in ``counts``, as 64-bit numbers, by chunk."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, kind).astype(np.int64) for x in group["counts"])
        return pd.DataFrame({"chunk": group["chunk"][:1], "counts": [total.tobytes()]})

    return parts.groupBy("chunk").applyInPandas(add, "chunk long, counts binary")


def _chunks(counts: np.ndarray) -> pd.DataFrame:
    pieces = counts.reshape(-1, CHUNK * 2)
    used = np.flatnonzero(pieces.any(axis=1))
    return pd.DataFrame({"chunk": used, "counts": [pieces[k].tobytes() for k in used]})


def _averaged(rows: DataFrame, cells: np.ndarray) -> np.ndarray:
    """What tasks learned, rows (size, cells), by the size of what they learned from."""
    each = rows.select("size", F.posexplode("cells").alias("at", "x"))
    mean = each.groupBy("at").agg((F.sum(F.col("x") * F.col("size")) / F.sum("size")).alias("x")).collect()
    out = cells.copy()
    for row in mean:
        out[row["at"]] = row["x"]
    return out


LEARNED = "size long, cells array<double>"


def fit_speller(words: DataFrame) -> Speller:
    """Count every word of ``words`` into the predictors, and learn the mixer on all of them.

    Counts are added up by chunks of slots, so a task holds one table and no word list; the table of
    fixed size is what reaches the driver.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[list[bytes]]:
        words, size = [], 0
        for batch in batches:
            words += [t.encode() for t in batch["token"]]
            size += int(batch["token"].str.len().sum())
            if size > COUNT_BYTES:
                yield words
                words, size = [], 0
        if words:
            yield words

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = None
        for words in pieces(batches):
            own = spelling_counts(words)
            counts = own if counts is None else counts + own
        if counts is not None:
            yield _chunks(counts)

    learned = words.select("token")
    counts = np.zeros((len(ORDERS) * 2**SLOT_BITS // CHUNK, CHUNK * 2), np.int64)
    for row in _added(learned.mapInPandas(count, "chunk long, counts binary"), np.int64).collect():
        counts[row["chunk"]] = np.frombuffer(row["counts"], np.int64)
    counts = counts.reshape(len(ORDERS), 2**SLOT_BITS, 2)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, size = Speller(counts), 0
        for words in pieces(batches):
            own.learn(sorted(words, key=zlib.crc32))
            size += len(words)
        if size:
            yield pd.DataFrame({"size": [size], "cells": [own.cells]})

    speller = Speller(counts)
    speller.put(_averaged(learned.mapInPandas(learn, LEARNED), speller.cells))
    return speller


class Words:
    """Numbers of the words that have codes; the escape comes after them."""

    def __init__(self, words: list[str]):
        self.names = pa.array(words, pa.string())
        self.escape = len(words)

    def numbered(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Code and context number of each word."""
        code = pc.fill_null(pc.index_in(tokens.names, self.names), self.escape).to_numpy(zero_copy_only=False).astype(np.int64)
        context = code.copy()
        others = np.flatnonzero(code == self.escape)
        context[others] = [OTHERS + zlib.crc32(w) for w in tokens.names.take(pa.array(others)).cast(pa.binary()).to_pylist()]
        return code.take(tokens.at), context.take(tokens.at)


def fit_contexts(texts: DataFrame, words: Words, codes: Codes, tokens: int) -> Mixer:
    """Count the bits of all training texts into the context tables, and learn the mixer along all of them.

    ``texts`` has the column text. The tables have slots by the number of words, up to a size that every
    task can hold; counts stop at 65,535. A task takes at least TASK_WORDS words beyond a task a core, so
    what the tasks send does not outgrow the texts. A text is left out of the counts that predict it.
    """
    bits = table_bits(tokens)
    session = texts.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, -(-tokens // TASK_WORDS))
    rows = texts.select("text").coalesce(tasks)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for tokens in (Tokens.of(batch["text"]) for batch in some_texts(batches)):
            code, context = words.numbered(tokens)
            for low, high in zip(tokens.first[:-1].tolist(), tokens.first[1:].tolist(), strict=True):
                yield from pieces_of(code[low:high], context[low:high])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        group, size = [], 0
        for turn in in_turns(each(batches)):
            group += turn
            size += sum(len(p[0]) for p in turn)
            if size > FLUSH:
                yield group
                group, size = [], 0
        if group:
            yield group

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, 2 << bits), np.uint32)
        for group in pieces(batches):
            add_bits(tables, lay_out_bits(codes, group))
        chunks = _chunks(np.minimum(tables, 65_535).astype(np.uint16))
        yield from in_pieces(pa.RecordBatch.from_pandas(chunks, pa.schema([("chunk", pa.int64()), ("counts", pa.binary())])), 500)

    tables = np.zeros((2 * 2**bits // CHUNK, CHUNK * 2), np.uint16)
    for row in _added(rows.mapInArrow(count, "chunk long, counts binary"), np.uint16).toLocalIterator():
        tables[row["chunk"]] = np.minimum(np.frombuffer(row["counts"], np.int64), 65_535)
    mixer = Mixer(codes, tables.reshape(2, -1))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for group in pieces(batches):
            mixer.read(group, np.ones(len(group), bool), learn=True)
            size += sum(len(p[0]) for p in group)
        if size:
            yield pa.RecordBatch.from_pydict({"size": [size], "cells": [mixer.cells.tolist()]})

    mixer.put(_averaged(rows.mapInArrow(learn, LEARNED), mixer.cells))
    return mixer


@dataclass(frozen=True)
class Totals:
    """Tokens N and distinct tokens V of some training rows, and the discount of their counts."""

    n: int
    v: int
    discount: float

    @classmethod
    def of(cls, n: int, v: int, once: int, twice: int) -> Totals:
        return cls(n, v, min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5)

    @property
    def denominator(self) -> int:
        return self.n + self.v + 1

    @property
    def below(self) -> float:
        """The mass that the level below gets."""
        return (1 + self.discount * self.v) / (self.n + 1)

    def level(self, c: np.ndarray, base: np.ndarray) -> np.ndarray:
        return np.maximum(c - self.discount, 0) / (self.n + 1) + self.below * base


def _tally() -> list[Column]:
    c = F.col("c")
    return [F.coalesce(F.sum(c), F.lit(0)), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2)]


def score_words(words: DataFrame, speller: Speller, totals: Totals) -> DataFrame:
    """Rows (token, c, lp): the log10 probability of each word among those that have no code, before
    any text is read."""
    small = speller.for_scoring()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spelled = 10 ** np.maximum(small.log10([t.encode() for t in batch["token"]]), -300)
            yield batch.assign(lp=np.log10(totals.level(batch["c"].to_numpy(float), spelled)))

    return words.select("token", "c").mapInPandas(run, "token string, c long, lp double")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of gamma for positive x, by Stirling's series at x + 8."""
    y = x + 8
    product = x.copy()
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(product)


def _log_gamma(x: Column) -> Column:
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def _least_count(vocabulary: DataFrame, most: int = FREQUENT) -> int:
    """The least training count that at most ``most`` words reach, to about a tenth."""
    step = F.floor(F.log2("c") * 8)
    steps = vocabulary.where("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least"))
    least = total = 0
    for row in sorted(steps.collect(), reverse=True):  # one for each eighth of a doubling
        total += row["n"]
        if total > most:
            return least or 2**62
        least = row["least"]
    return max(least, 1)


REPEATS = tuple(f"repeat_{k}" for k in range(len(ALPHAS)))


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte.

    Learns from the rows outside the held-out fold (crc32 of the id, modulo 7, is 2) and scores all
    whole texts. base_score is the sum of log10((c + 1) / (N + V + 1)); score the model's. A null text
    is empty: its end alone is scored. Rows with a null id are scored, not learned from, and have
    held_out null. Repeated rows and ids keep their rows. With nothing to learn from every bit of a spelling has
    probability one half. bits_per_byte is over the bytes of the words and one for each end. Other
    columns are not read. No rows give no rows.

    Bits of words that have a code are mixed along the text, with at most PIECE words of it in memory
    at a time; a training text is left out of the contexts that predict it. The other words of each
    text are joined with the word table, so no task holds that table and no word is hot in the join.
    """
    vocabulary = stage(count_words(docs))
    totals = Totals.of(*vocabulary.agg(*_tally()).first())
    least = _least_count(vocabulary)
    top = vocabulary.where(F.col("c") >= least).orderBy(F.desc("c"), "token").toPandas()
    others = vocabulary.where(F.col("c") < least)
    among = Totals.of(*others.agg(*_tally()).first())
    words = Words(top["token"].tolist())
    counts = top["c"].tolist()
    mixer = fit_contexts(
        docs.where(_trains()).select(whole_text("text").alias("text")), words, Codes.of([*counts, totals.n - sum(counts) + 1]), totals.n
    )
    scored = score_words(others, fit_speller(others.where("c > 0")), among)
    top_base = np.log10((np.array([*counts, -1], float) + 1) / totals.denominator, where=np.array([*counts, 0]) > 0, out=np.zeros(len(counts) + 1))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, token string, times long, doc_id {kind}, n_tokens long, n_bytes long, n_rare long, base double, lp double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_texts(batches):
            tokens = Tokens.of(batch["text"])
            code, context = words.numbered(tokens)
            row, rare = batch["row"].to_numpy(), code == words.escape
            length = pc.binary_length(tokens.names.cast(pa.binary())).to_numpy().astype(np.int64) + 1
            texts = {
                "row": batch["row"],
                # a name that is no word, and spread like one
                "token": pa.array([f" {r}" for r in row.tolist()], pa.string()),
                "times": np.zeros(len(row), np.int64),
                "doc_id": batch["doc_id"],
                "n_tokens": np.diff(tokens.first),
                "n_bytes": tokens.added(length.take(tokens.at)),
                "n_rare": tokens.added(rare.astype(np.int64)),
                "base": tokens.added(top_base.take(code)),
                "lp": mixed(tokens, code, context, batch["train"].to_numpy(zero_copy_only=False).astype(bool)) / LN10,
            }
            yield pa.RecordBatch.from_pydict(texts)
            text = np.repeat(np.arange(len(row)), np.diff(tokens.first))[rare]
            key, times = np.unique(text * len(tokens.names) + tokens.at[rare], return_counts=True)
            text, name = np.divmod(key, len(tokens.names))
            empty = {k: pa.nulls(len(key), v.type if isinstance(v, pa.Array) else pa.from_numpy_dtype(v.dtype)) for k, v in texts.items()}
            left = {"row": row.take(text), "token": tokens.names.take(pa.array(name)), "times": times}
            yield from in_pieces(pa.RecordBatch.from_pydict(empty | left))

    def mixed(tokens: Tokens, code: np.ndarray, context: np.ndarray, train: np.ndarray) -> np.ndarray:
        """Natural log probability of the codes of each text, a few pieces at a time."""
        lp, group, size = np.zeros(len(train)), [], 0
        for k, (low, high) in enumerate(zip(tokens.first[:-1].tolist(), tokens.first[1:].tolist(), strict=True)):
            for piece in pieces_of(code[low:high], context[low:high]):
                group.append((k, piece))
                size += len(piece[0])
                if size > FLUSH:
                    add(lp, group, train)
                    group, size = [], 0
        if group:
            add(lp, group, train)
        return lp

    def add(lp: np.ndarray, group: list[tuple], train: np.ndarray) -> None:
        at, pieces = zip(*group, strict=True)
        np.add.at(lp, list(at), mixer.read(list(pieces), train.take(at)))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text("text").alias("text"), _trains().alias("train"))
    parts = rows.mapInArrow(run, schema)
    joined = parts.join(scored.select("token", F.col("c").alias("_c"), F.col("lp").alias("_lp")), "token", "left")
    c, times, share = F.col("_c"), F.col("times"), F.pow(F.lit(10.0), F.col("_lp"))
    or_none = lambda x: F.coalesce(x, F.lit(0.0))
    base = times * F.log10((c + 1) / F.lit(float(totals.denominator)))
    rise = lambda a: F.when(times > 1, (_log_gamma(share * a + times) - _log_gamma(share * a + 1)) / LN10)
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("n_bytes").alias("n_bytes"),
        F.max("n_rare").alias("_size"),
        F.sum(F.when(c > 0, times).otherwise(0)).alias("_known"),
        F.sum(or_none(F.coalesce("base", base))).alias("base_score"),
        F.sum(or_none(F.col("lp"))).alias("_mixed"),
        F.sum(or_none(F.col("_lp"))).alias("_lp"),
        F.count_if(times > 0).alias("_distinct"),
        *(F.sum(or_none(rise(a))).alias(name) for name, a in zip(REPEATS, ALPHAS, strict=True)),
    )
    size = F.col("_size").cast("double")
    of = [
        F.col("_distinct") * math.log10(a) + F.col("_lp") + F.col(name) - (_log_gamma(size + a) - _log_gamma(F.lit(a))) / LN10
        for name, a in zip(REPEATS, ALPHAS, strict=True)
    ]
    final = sums.select("*", F.array(*of).alias("_of"))
    most = F.array_max("_of")
    mean = F.aggregate("_of", F.lit(0.0), lambda total, x: total + F.pow(F.lit(10.0), x - most)) / len(ALPHAS)
    return final.select("*", (F.col("_mixed") + most + F.log10(mean)).alias("score")).select(
        "doc_id",
        (remainder("doc_id", MODULUS) == HELD).alias("held_out"),
        "n_tokens",
        (F.col("n_tokens") - F.col("_size") + F.col("_known")).alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
