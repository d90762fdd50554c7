"""Files of token ids, packed in the fewest bits that hold the vocabulary.

A file holds the ids of consecutive documents. Ids are packed in blocks of a fixed number of ids;
each block starts at a byte, and the table of block offsets lets a reader unpack any block alone.

    magic            8 bytes
    blocks           each: BLOCK_IDS ids (the last one: the rest), little-endian bits
    block offsets    u64 for each block, and the end of the last
    document ids     i64 for each document
    has an id        u8 for each document, 0 where the id is null
    document starts  u64 for each document: ids before it in this file; and the end of the last
    trailer          bits, ids in a block, blocks, documents, ids, offset of the block offsets, magic
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import whole_text

MAGIC = b"CWBITS01"
TRAILER = "<6Q8s"
BLOCK_IDS = 65_536
#: Entries of a generation of what a worker has encoded; it keeps the last two.
PIECE_CACHE = 300_000
#: A piece of their own after letters, at the end of a chunk.
MARKS = frozenset(",.;:!?")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    columns = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(columns[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(block: bytes, bits: int, count: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(block, "<u2", count).astype("<u4")
    flags = np.unpackbits(np.frombuffer(block, np.uint8), count=count * bits, bitorder="little")
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flags.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system that this process and the executors reach, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class Kept(dict):
    """Encoded texts in two generations, so that what is used again stays."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        encoded = self.before.get(text)
        if encoded is None:
            encoded = self.encoded(text)
        self[text] = encoded
        return encoded

    def age(self) -> None:
        if len(self) > PIECE_CACHE:
            self.before = dict(self)
            self.clear()


class Pieces(Kept):
    """Ids of pieces, encoded when first asked for."""

    def __init__(self, model):
        super().__init__()
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [byte for byte in range(256) if byte not in printed]
        self.shown = {byte: chr(256 + k) for k, byte in enumerate(rest)}  # byte-level alphabet
        self.tokenize = model.tokenize

    def encoded(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # the space alone is shown otherwise
            byte_form = piece.replace(" ", self.shown[32])
        else:
            byte_form = piece.encode().decode("latin-1").translate(self.shown)
        return array("I", [token.id for token in self.tokenize(byte_form)]).tobytes()


class Chunks(Kept):
    """Ids of what stands between two spaces, the space before it included.

    One of letters alone is a piece, and is kept here only; what it stands in is put together from it.
    """

    def __init__(self, pieces: Pieces, find):
        super().__init__()
        self.pieces, self.find = pieces, find

    def of(self, chunk: str) -> bytes:
        return b"".join(
            [
                self[piece[1:]] if piece[0] == " " and piece[1:].isalpha() else self.pieces[piece]
                for piece in self.find(chunk)
            ]
        )

    def encoded(self, word: str) -> bytes:
        if word.isalpha():
            return self.pieces.encoded(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        if word[-1] in MARKS and word[:-1].isalpha():
            return self[word[:-1]] + self.pieces[word[-1]]
        return self.of(" " + word)


class PieceEncoder:
    """Whole texts to ids with the tokenizers library.

    Byte-level BPE never merges across the pieces of its pre-tokenizer, so a piece is encoded once
    and its ids are kept. The pieces are cut here only where the class of every character is
    settled, up to U+024F; any other text is encoded in one call, and so is one that holds the
    string of an added token.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            known = json.load(f)
        form = known["pre_tokenizer"]
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.added = [token["content"] for token in known.get("added_tokens", [])]
        self.known = Pieces(self.tokenizer.model)
        self.simple = form.get("type") == "ByteLevel" and form["use_regex"] and not form["add_prefix_space"]
        kinds: dict[str, str] = {"L": "", "N": ""}
        for code in range(0x250):
            kind = unicodedata.category(chr(code))[0]
            if kind in kinds:
                kinds[kind] += re.escape(chr(code))
        letters, digits = kinds["L"], kinds["N"]
        self.unsettled = re.compile("[^\x00-ɏ]")
        self.pieces = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+"
        )
        self.chunks = Chunks(self.known, self.pieces.findall)
        self.odd_space = re.compile("[\x1c-\x1f]")  # white space for re, not for the tokenizer

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        whole = not self.simple or self.unsettled.search(text) or self.odd_space.search(text)
        if whole or any(token in text for token in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        # a space between two characters that are none starts a piece
        first, *words = text.split(" ")
        try:
            if first[-1:].isspace():
                raise KeyError(first)
            encoded = self.chunks.of(first) + b"".join(map(self.chunks.__getitem__, words))
        except KeyError:  # white space next to white space: cut the text as a whole
            encoded = self.chunks.of(text)
        self.chunks.age()
        self.known.age()
        return encoded


def worker_encoder(tokenizer_file: str) -> PieceEncoder:
    """The encoder of this process, whose pieces outlive a task.

    It hangs on the library's module: this one may be sent with each task anew.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_piece_encoders", {})
    if tokenizer_file not in kept:
        kept[tokenizer_file] = PieceEncoder(tokenizer_file)
    return kept[tokenizer_file]


def _write_file(target: str, documents: Iterator[tuple[int | None, bytes]], bits: int) -> tuple[int, int]:
    """Write one file under another name and move it into place, so that a repeated task is safe."""
    system, path = file_system(target)
    offsets, ids, given, starts = [len(MAGIC)], [], [], [0]
    waiting = np.zeros(0, "<u4")
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        out.write(MAGIC)

        def put(block: np.ndarray) -> None:
            payload = pack(block, bits)
            out.write(payload)
            offsets.append(offsets[-1] + len(payload))

        held: list[bytes] = []
        held_ids = 0
        for doc_id, encoded in documents:
            ids.append(doc_id or 0)
            given.append(doc_id is not None)
            starts.append(starts[-1] + len(encoded) // 4)
            held.append(encoded)
            held_ids += len(encoded) // 4
            if held_ids >= BLOCK_IDS:
                waiting = np.concatenate([waiting, np.frombuffer(b"".join(held), "<u4")])
                whole = len(waiting) // BLOCK_IDS * BLOCK_IDS
                for k in range(0, whole, BLOCK_IDS):
                    put(waiting[k : k + BLOCK_IDS])
                waiting, held = waiting[whole:], []
                held_ids = len(waiting)
        waiting = np.concatenate([waiting, np.frombuffer(b"".join(held), "<u4")])
        for k in range(0, len(waiting), BLOCK_IDS):
            put(waiting[k : k + BLOCK_IDS])
        out.write(np.array(offsets, "<u8").tobytes())
        out.write(np.array(ids, "<i8").tobytes())
        out.write(np.array(given, np.uint8).tobytes())
        out.write(np.array(starts, "<u8").tobytes())
        out.write(struct.pack(TRAILER, bits, BLOCK_IDS, len(offsets) - 1, len(ids), starts[-1], offsets[-1], MAGIC))
    system.move(part, path)
    return len(ids), starts[-1]


class TokenFile:
    """A file opened for reading: its documents' ids and starts, and any stretch of ids."""

    def __init__(self, target: str):
        system, path = file_system(target)
        self.file = system.open_input_file(path)
        tail = self.file.read_at(struct.calcsize(TRAILER), self.file.size() - struct.calcsize(TRAILER))
        self.bits, self.block_ids, blocks, documents, self.count, table, magic = struct.unpack(TRAILER, tail)
        if magic != MAGIC:
            raise ValueError(f"{target} is not a token file")
        index = self.file.read_at(self.file.size() - struct.calcsize(TRAILER) - table, table)
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(index, kind, count, at)
            at += values.nbytes
            return values

        self.offsets = take("<u8", blocks + 1).astype(np.int64)
        self.ids = take("<i8", documents)
        self.given = take(np.uint8, documents).astype(bool)
        self.starts = take("<u8", documents + 1).astype(np.int64)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end``, from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        begin = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last + 1]) - begin, begin)
        parts = []
        for block in range(first, last + 1):
            count = min(self.block_ids, self.count - block * self.block_ids)
            low, high = int(self.offsets[block]) - begin, int(self.offsets[block + 1]) - begin
            parts.append(unpack(data[low:high], self.bits, count))
        ids = np.concatenate(parts)
        base = first * self.block_ids
        return ids[start - base : end - base]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_file: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    order_by: list[Column] | None = None,
) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the files in ascending id order, or in that
    of ``order_by``.

    Returns one row per file: part, path, n_docs, n_tokens, start (ids in the files before it).
    Documents are dealt out by ranges of the order and each task writes the file of its range, so no
    task holds more than a block of ids and its index. Only this table of files, two numbers for
    each, passes the driver. A null text is empty and has the end id alone; null ids come first;
    rows that share an id stay, next to each other in any order. ``folder`` must be a folder that
    all executors reach. No rows give no files.
    """
    from tokenizers import Tokenizer

    bits = bits_for(max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1))
    end = np.array([end_id], "<u4").tobytes()
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(tokenizer_file)
        part = TaskContext.get().partitionId()
        target = f"{folder}/part-{part:06d}.bits"

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for missing, doc_id, text in zip(batch["missing"], batch["id"], batch["text"], strict=True):
                    yield None if missing else int(doc_id), encoder.encode(text) + end

        written = documents()
        first = next(written, None)
        if first is None:
            return
        n_docs, n_tokens = _write_file(target, _chain(first, written), bits)
        yield pd.DataFrame({"part": [part], "path": [target], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    order = order_by or [F.col(id_col)]  # nulls come first
    by = [f"order_{k}" for k in range(len(order))]
    rows = docs.select(
        F.col(id_col).isNull().alias("missing"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        whole_text(text_col).alias("text"),
        *(c.alias(name) for c, name in zip(order, by, strict=True)),
    )
    files = (
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .mapInPandas(write, "part int, path string, n_docs long, n_tokens long")
        .collect()
    )
    table, start = [], 0
    for row in sorted(files):
        table.append((*row, start))
        start += row["n_tokens"]
    schema = "part int, path string, n_docs long, n_tokens long, start long"
    return docs.sparkSession.createDataFrame(table, schema)


def _chain(first, rest):
    yield first
    yield from rest


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, from the files alone.

    Documents are read in runs of whole blocks; ids_crc32 is over the ids as little-endian unsigned
    32-bit integers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["start"], strict=True):
                file = TokenFile(path)
                k = 0
                while k < len(file.ids):
                    # documents that end within 16 blocks, at least one
                    reach = int(file.starts[k]) + 16 * file.block_ids
                    upto = max(k + 1, int(np.searchsorted(file.starts, reach, "right")) - 1)
                    ids = file.read(int(file.starts[k]), int(file.starts[upto]))
                    bounds = file.starts[k : upto + 1] - file.starts[k]
                    sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    doc_ids = pd.Series(file.ids[k:upto]).astype("Int64").where(file.given[k:upto])
                    yield pd.DataFrame(
                        {
                            "doc_id": doc_ids,
                            "start": base + file.starts[k:upto],
                            "n_tokens": np.diff(bounds),
                            "ids_crc32": np.array(sums, np.int64),
                        }
                    )
                    k = upto
                file.close()

    tasks = files.select("path", "start").repartition(max(1, files.count()))  # a file for each task
    return tasks.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
