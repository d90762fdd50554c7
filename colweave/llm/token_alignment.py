"""Alignment of two tokenizers: which ids cover the same bytes, and in how many documents.

Both tokenizers cut the same bytes, so the ends of all their tokens, merged, cut a text into stretches
that each lie in one token of either side: a stretch is a link. For each pair of linked ids a bitmap
says which documents hold it. Documents are numbered inside stretches of the input, and a bitmap is
kept as one container per stretch, as places or as bits, whichever is smaller. Containers of different
stretches share no document, so the OR of them all is their union and its population count the sum of
theirs. How often a document holds a link beyond the first time is kept in further bitmaps, a plane
for each binary digit.

Counts flow back over the same postings: a pair's count is joined to its containers, and the
containers of a stretch add it up at the places of their documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import stage
from .text import whole_text

#: A stretch ends with the document that brings its texts to so many characters, or its documents to
#: what a place of 16 bits can number.
STRETCH_CHARS = 16_000_000
STRETCH_DOCS = 1 << 16
# Fixed value: the pre-tokenizer of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No token of the other side reaches over the start of a space.
WORDS = " *[^ ]+| +"
#: Rows of an Arrow batch that goes back to Spark.
BATCH_ROWS = 100_000
#: The id of the second tokenizer takes the low bits of a pair.
PAIR_BITS = 32

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()),
        T.StructField("n_links", T.LongType()),
        T.StructField("groups_sha256", T.StringType()),
    ]
)
#: unit: links that a document of the bitmap has by it; first: whether it is the bitmap of documents.
POSTING = T.StructType(
    [
        T.StructField("pair", T.LongType()),
        T.StructField("first", T.BooleanType()),
        T.StructField("unit", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("places", T.BinaryType()),
        T.StructField("bits", T.BinaryType()),
    ]
)
WRITTEN = T.StructType([T.StructField("stretch", T.LongType()), *DOCUMENT.fields, *POSTING.fields])


def byte_ranks(known: dict, shown: dict[str, int]) -> dict[bytes, int] | None:
    """The tokens of a byte-level BPE by rank, where its ids ascend in the order of its merges.

    ``shown`` is the byte that a character of the vocabulary stands for.
    """
    model, form = known["model"], known["pre_tokenizer"] or {}
    plain = (
        (model["type"], form.get("type")) == ("BPE", "ByteLevel")
        and (form.get("use_regex", True), form.get("add_prefix_space")) == (True, False)
        and not any(model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        and not known["normalizer"]
        and not model.get("ignore_merges")
    )
    special = {token["content"] for token in known["added_tokens"]}
    ranks = {token: k for token, k in model["vocab"].items() if token not in special}
    merged = [ranks[left + right] for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    ascending = all(a < b for a, b in zip(merged, merged[1:], strict=False))
    if not (plain and ascending and len(ranks) == len(merged) + 256 and set("".join(ranks)) <= shown.keys()):
        return None
    return {bytes(map(shown.__getitem__, token)): k for token, k in ranks.items()}


def piece_ranks(model, piece_bytes: list[bytes]) -> dict[bytes, int] | None:
    """The pieces of a sentencepiece BPE by rank, for texts of characters of one or two bytes and single spaces.

    Such a model joins the two neighbours whose piece scores best. With single bytes first, then the
    characters of two bytes, then the pieces as they score, bytes are joined to characters before
    anything else and pieces in the same order. None where pieces without two spaces score alike, one
    reaches over the start of a space, or texts are normalised.
    """
    known = [(k, model.id_to_piece(k)) for k in range(model.get_piece_size())]
    plain = [(k, p) for k, p in known if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    for text in ("  a  b  ", "".join(map(chr, range(1, 0x250)))):
        if b"".join(piece_bytes[k] for k in model.encode(text)) != b" " + text.encode():
            return None
    joined = sorted((-model.get_score(k), piece_bytes[k]) for k, p in plain if len(p) > 1 and "▁▁" not in p)
    if len({score for score, _ in joined}) < len(joined) or any(re.search("[^▁]▁", p) for _, p in plain):
        return None
    pairs = [p.encode() for _, p in plain if len(p) == 1 and len(p.encode()) == 2]
    return {token: k for k, token in enumerate([*(bytes([b]) for b in range(256)), *pairs, *(p for _, p in joined)])}


class Aligner:
    """Two tokenizers and the bytes of their tokens.

    Texts of characters up to U+024F are encoded from the ranks of the tokens, all others by the
    libraries that the files are made for; beyond that classes of characters differ by version.
    """

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_file, encoding="utf-8") as f:
            known = json.load(f)
        self.tokenizer = Tokenizer.from_file(a_file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [byte for byte in range(256) if byte not in printed]
        shown = {chr(byte): byte for byte in printed} | {chr(256 + k): byte for k, byte in enumerate(rest)}
        ranks = byte_ranks(known, shown)
        self.a_fast = ranks and tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.unsettled = re.compile("[^\x00-\u024f]")
        names = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        self.a_bytes = [bytes(map(shown.__getitem__, t)) if shown.keys() >= set(t) else t.encode() for t in names]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(k)[3:5], 16)])
            if self.b.is_byte(k)
            else self.b.id_to_piece(k).replace("▁", " ").encode()
            for k in range(self.b.get_piece_size())
        ]
        ranks = piece_ranks(self.b, self.b_bytes)
        self.b_fast = ranks and tiktoken.Encoding("b", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        last = {token: k for k, token in enumerate(self.b_bytes)}  # of a byte and a character the character
        self.b_ids = np.array([last[token] for token in ranks or ()], np.int64)
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # an id in decimal and what follows it: in a list, at the end of the A or B part of a group
        self.shown = [b"%d," % k for k in range(len(self.a_bytes))] + [b"%d|" % k for k in range(len(self.a_bytes))]
        self.shown += [b"%d," % k for k in range(len(self.b_bytes))] + [b"%d;" % k for k in range(len(self.b_bytes))]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both sides for a space and ``text``; None where either does not give its bytes."""
        if not text:
            return None
        text = " " + text
        settled = not self.unsettled.search(text)
        # tokens found by rank are the bytes they stand for; what else is encoded is compared
        if settled and self.b_fast and "  " not in text:
            b = self.b_ids[self.b_fast.encode_ordinary(text)]
        else:
            ids = self.b.encode(text[1:])
            b = np.array(ids, np.int64)
            if b"".join(map(self.b_bytes.__getitem__, ids)) != text.encode():
                return None
        if settled and self.a_fast:
            ids = self.a_fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            if b"".join(map(self.a_bytes.__getitem__, ids)) != text.encode():
                return None
        return np.array(ids, np.int64), b

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int, str]:
        """The pair of every link in order, how many groups there are, and the hash of their listing."""
        ends = np.concatenate([np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])])
        order = np.argsort(ends, kind="stable")  # merges two ascending runs; A comes first where both end
        ends, of_a = ends[order], order < len(a)
        a_upto = np.cumsum(of_a)  # tokens that end here or before
        b_upto = np.arange(1, len(ends) + 1) - a_upto
        shared = np.concatenate([[False], ends[1:] == ends[:-1]])  # the B end of the two
        own = ~shared
        pairs = a[(a_upto - of_a)[own]] << PAIR_BITS | b[(b_upto - ~of_a)[own]]
        group = np.cumsum(shared) - shared
        a_cut, b_cut = a_upto[shared], b_upto[shared]
        b_before = np.concatenate([[0], b_cut])
        codes = np.empty(len(ends), np.int64)
        codes[np.arange(len(a)) + b_before[group[of_a]]] = a
        codes[np.arange(len(b)) + a_cut[group[~of_a]]] = b + 2 * len(self.a_bytes)
        codes[a_cut - 1 + b_before[:-1]] += len(self.a_bytes)
        codes[b_cut - 1 + a_cut] += len(self.b_bytes)
        listing = b"".join(map(self.shown.__getitem__, codes.tolist()))[:-1]
        return pairs, len(a_cut), hashlib.sha256(listing).hexdigest()


def worker_aligner(a_file: str, b_file: str) -> Aligner:
    """The aligner of this process, of a fixed size; it hangs on the library's module and outlives a task."""
    import sentencepiece

    kept = vars(sentencepiece).setdefault("_aligners", {})
    if (a_file, b_file) not in kept:
        kept[a_file, b_file] = Aligner(a_file, b_file)
    return kept[a_file, b_file]


class Stretch:
    """The documents of a stretch, as they come, and the postings of their pairs."""

    def __init__(self, number: int):
        self.number = number
        self.documents: list[tuple] = []
        self.chars = 0
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held: list[tuple[int, int]] = []  # (place, distinct pairs)

    def add(self, doc_id: int | None, text: str, aligner: Aligner) -> None:
        place = len(self.documents)
        self.chars += len(text)
        encoded = aligner.encode(text)
        if encoded is None:
            self.documents.append((doc_id, place, 0, 0, 0, 0, ""))
            return
        pairs, groups, digest = aligner.links(*encoded)
        distinct, times = np.unique(pairs, return_counts=True)
        self.pairs.append(distinct)
        self.times.append(times)
        self.documents.append((doc_id, place, len(encoded[0]), len(encoded[1]), groups, len(pairs), digest))
        self.held.append((place, len(distinct)))

    @property
    def full(self) -> bool:
        return self.chars >= STRETCH_CHARS or len(self.documents) >= STRETCH_DOCS

    def batches(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.documents), BATCH_ROWS):
            part = zip(*self.documents[start : start + BATCH_ROWS], strict=True)
            yield self._batch(dict(zip(DOCUMENT.names, map(list, part), strict=True)))
        if not self.pairs:
            return
        places = np.concatenate([np.full(size, place, "<u2") for place, size in self.held])
        pairs, times = np.concatenate(self.pairs), np.concatenate(self.times) - 1
        order = np.argsort(pairs, kind="stable")
        pairs, places, times = pairs[order], places[order], times[order]
        yield from self._postings(pairs, places, True, 1)
        for k in range(int(times.max()).bit_length()):
            set_ = (times >> k & 1).astype(bool)
            if set_.any():
                yield from self._postings(pairs[set_], places[set_], False, 1 << k)

    def _postings(self, pairs: np.ndarray, places: np.ndarray, first: bool, unit: int) -> Iterator[pa.RecordBatch]:
        """A row per pair; ``pairs`` ascend, and the places of each."""
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(pairs)]]))
        sparse = 2 * sizes <= (len(self.documents) + 7) // 8
        for low in range(0, len(starts), BATCH_ROWS):
            rows = slice(low, low + BATCH_ROWS)
            n, few = sizes[rows], sparse[rows]
            kept = places[starts[rows][0] :][: n.sum()]
            data = kept[np.repeat(few, n)].tobytes()
            offsets = np.concatenate([[0], np.cumsum(2 * n[few])]).astype("<i4")
            listed = pa.Array.from_buffers(pa.binary(), int(few.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            numbers = pairs[starts[rows]]
            yield self._batch({"pair": numbers[few], "first": first, "unit": unit, "n": n[few], "places": listed})
            flags = []
            for k in np.flatnonzero(~few):
                bits = np.zeros(len(self.documents), bool)
                start = starts[low + k]
                bits[places[start : start + n[k]]] = True
                flags.append(np.packbits(bits, bitorder="little").tobytes())
            if flags:
                yield self._batch({"pair": numbers[~few], "first": first, "unit": unit, "n": n[~few], "bits": flags})

    def _batch(self, columns: dict) -> pa.RecordBatch:
        rows = next(len(values) for values in columns.values() if not isinstance(values, (bool, int)))
        arrays = []
        for name, kind in zip(ARROW.names, ARROW.types, strict=True):
            value = self.number if name == "stretch" else columns.get(name)
            if value is None:
                arrays.append(pa.nulls(rows, kind))
            elif isinstance(value, (bool, int)):
                arrays.append(pa.array(np.full(rows, value), kind))
            elif isinstance(value, pa.Array):
                arrays.append(value)
            else:
                arrays.append(pa.array(value, kind))
        return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


# of the Spark types above
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
ARROW = pa.schema([(field.name, _KINDS[field.dataType.simpleString()]) for field in WRITTEN.fields])


def write_postings(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written rows of documents and of postings, told apart by a null ``pair``.

    A task numbers its documents as it reads them. Rows of both kinds are written by one attempt of it, so a
    stretch is whole whatever is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(a_file, b_file)
        number = TaskContext.get().partitionId() << 32
        stretch = Stretch(number)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                stretch.add(doc_id.as_py(), text.as_py(), aligner)
                if stretch.full:
                    yield from stretch.batches()
                    number += 1
                    stretch = Stretch(number)
        yield from stretch.batches()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return stage(rows.mapInArrow(run, WRITTEN))


def pair_counts(written: DataFrame) -> DataFrame:
    """A row per pair of linked ids: pair, a, b, n_docs, n_links, and whether n_docs is the highest of a."""
    postings = written.where("pair is not null")
    counts = stage(
        postings.groupBy("pair")
        .agg(F.sum(F.when(F.col("first"), F.col("n"))).alias("n_docs"), F.sum(F.col("n") * F.col("unit")).alias("n_links"))
        .select(
            "pair",
            F.shiftright("pair", PAIR_BITS).alias("a"),
            F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).alias("b"),
            "n_docs",
            "n_links",
        )
    )
    # a row for each id of a vocabulary, whatever the corpus
    top = counts.groupBy("a").agg(F.max("n_docs").alias("top"))
    return counts.join(F.broadcast(top), "a").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("top")).alias("best"))


def returned_scores(written: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (stretch, place, n_best, count_sum): what the postings of each document add up to."""
    slots = (STRETCH_DOCS + 7) // 8 * 8  # as many as the bits of whole bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, best, total = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if number is not None:
                held = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(held), number), pa.int64()),
                        pa.array(held, pa.int32()),
                        pa.array(best[held], pa.int64()),
                        pa.array(total[held], pa.int64()),
                    ],
                    names=["stretch", "place", "n_best", "count_sum"],
                )

        for batch in batches:
            stretches = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], stretches[1:] != stretches[:-1]]))
            for low, high in zip(cuts, [*cuts[1:], len(stretches)], strict=True):
                if stretches[low] != number:
                    yield from done()
                    number = int(stretches[low])
                    best, total = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
                part = batch.slice(low, high - low)
                unit, docs, top = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
                if part.column(4).null_count < len(part):
                    listed = part.column(4).is_valid().to_numpy(zero_copy_only=False)
                    places = np.frombuffer(b"".join(part.column(4).drop_null().to_pylist()), "<u2")
                    sizes = part.column(5).to_numpy(zero_copy_only=False)[listed]
                    np.add.at(total, places, np.repeat(unit[listed] * docs[listed], sizes))
                    np.add.at(best, places, np.repeat(unit[listed] * top[listed], sizes))
                for k, bits in enumerate(part.column(6).to_pylist()):
                    if bits is not None:
                        flags = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
                        total[: len(flags)] += flags * (unit[k] * docs[k])
                        best[: len(flags)] += flags * (unit[k] * int(top[k]))
        yield from done()

    postings = written.where("pair is not null").select("stretch", "pair", "unit", "n", "places", "bits")
    # never broadcast: the table of pairs grows with the corpus
    met = postings.join(counts.select("pair", "n_docs", "best").hint("merge"), "pair")
    dealt = met.select("stretch", "unit", "n_docs", "best", "places", "n", "bits").repartition("stretch")
    return dealt.sortWithinPartitions("stretch").mapInArrow(run, "stretch long, place int, n_best long, count_sum long")


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_file`` is a byte-level BPE of the tokenizers library, which encodes a space and the text;
    ``b_file`` a sentencepiece model, which adds the space itself. The strings of special tokens in a
    text are plain text. A link is a pair of tokens whose bytes overlap, a group what lies between two
    ends that both sides share. The count of a pair is the number of rows of ``docs`` that hold it;
    ``n_best`` counts the links whose count is the highest of their A id, ties too, and
    ``count_sum`` adds up the counts of all links.

    A null or empty text, and one whose tokens do not give its bytes on both sides, has no tokens: zeros and an empty
    groups_sha256. Rows that share an id or a text are documents of their own; null ids stay. Other
    columns are not read. No rows give no rows.
    """
    written = write_postings(docs, a_file, b_file, id_col, text_col)
    scores = returned_scores(written, pair_counts(written))
    found = written.where("pair is null").select("stretch", *DOCUMENT.names).join(scores, ["stretch", "place"], "left")
    none = F.lit(0).cast("long")
    return found.select(
        *("doc_id", "n_a", "n_b", "n_groups", "n_links"),
        F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"),
        "groups_sha256",
    )
