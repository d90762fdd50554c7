"""Package documents to one row per nested element.

Only the parse itself is Python: a document is parsed in the task that holds its row, with the
standard library, and Spark does the rest. A document is fed to the parser piece by piece, and what is
done is given out and forgotten: beside the document itself a task holds the open elements, the
outermost open component, and a batch of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..schemas import PACKAGES, PACKAGES_BYTES, conform

# The namespace and tag of a component.
NAMESPACE = "www.microsoft.com/SqlServer/Dts"
TAG = "Executable"

PARSED = (
    "ssis_file_path string, ssis_file_name string, component_index long, "
    "ssis_component string, error string"
)
_ARROW = pa.schema(
    [
        ("ssis_file_path", pa.string()),
        ("ssis_file_name", pa.string()),
        ("component_index", pa.int64()),
        ("ssis_component", pa.string()),
        ("error", pa.string()),
    ]
)
STRETCHES = (
    "ssis_file_path string, ssis_file_name string, component_index long, "
    "n_components int, components array<string>, error string"
)
_ARROW_STRETCHES = pa.schema(
    [
        *list(_ARROW)[:3],
        ("n_components", pa.int32()),
        ("components", pa.list_(pa.field("element", pa.string()))),
        ("error", pa.string()),
    ]
)
_STRETCH_ROWS, _STRETCH_CHARS = 16, 256 << 10
_PIECE = 64 << 10
_BATCH_CHARS = 8 << 20
_BATCH_ROWS = 8 << 10


def parse_packages(packages: DataFrame, tag: str = TAG, namespace: str = NAMESPACE) -> DataFrame:
    """Components of every readable document, and one row with the error of each other.

    The content may be text or, with the encoding that the document declares, bytes. Components come in document order, numbered from 1. The root is none; a nested one has a row
    of its own and is part of the text of those around it.
    """
    name = f"{{{namespace}}}{tag}" if namespace else tag

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            paths, files, contents = batch.columns
            # one document at a time is taken out of the batch
            for path, file, content in zip(paths.to_pylist(), files.to_pylist(), contents):
                for index, text, error in _components(content.as_py(), name):
                    rows.append((path, file, index, text, error))
                    chars += len(text or "")
                    # a batch is closed by its size, inside a document too
                    if chars >= _BATCH_CHARS or len(rows) >= _BATCH_ROWS:
                        yield _to_batch(rows)
                        rows, chars = [], 0
        if rows:
            yield _to_batch(rows)

    return conform(packages, _declared(packages), "packages").mapInArrow(parse, PARSED)


def parse_stretches(packages: DataFrame, tag: str = TAG, namespace: str = NAMESPACE) -> DataFrame:
    """The same with up to ``_STRETCH_ROWS`` components of a document in a row, under the index of the first.

    What is exchanged, sorted and written is then a row for each stretch; ``components_of_stretches`` makes
    the rows of ``parse_packages`` of them, in the same order. A stretch is closed by its size too.
    """
    name = f"{{{namespace}}}{tag}" if namespace else tag

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, texts, chars = [], [], 0  # of each stretch: path, file, first index, error, texts before it
        for batch in batches:
            paths, files, contents = batch.columns
            for path, file, content in zip(paths.to_pylist(), files.to_pylist(), contents):
                full = 0  # texts and characters at which the next stretch begins; at once in a document
                full_chars = 0
                for index, text, error in _components(content.as_py(), name):
                    if len(texts) >= full or chars >= full_chars:
                        if chars >= _BATCH_CHARS or len(texts) >= _BATCH_ROWS or len(starts) >= _BATCH_ROWS:
                            yield _to_stretches(starts, texts)
                            starts, texts, chars = [], [], 0
                        starts.append((path, file, index, error, len(texts)))
                        full, full_chars = len(texts) + _STRETCH_ROWS, chars + _STRETCH_CHARS
                    if error is None:
                        texts.append(text)
                        chars += len(text)
        if starts:
            yield _to_stretches(starts, texts)

    return conform(packages, _declared(packages), "packages").mapInArrow(parse, STRETCHES)


def _to_stretches(starts: list[tuple], texts: list[str]) -> pa.RecordBatch:
    paths, files, firsts, errors, before = zip(*starts)
    offsets = np.array([*before, len(texts)], np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(texts, pa.string()))
    values = [paths, files, firsts, np.diff(offsets), lists.cast(_ARROW_STRETCHES.types[4]), errors]
    columns = [pa.array(v, t) if v is not values[4] else v for v, t in zip(values, _ARROW_STRETCHES.types)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW_STRETCHES)


def _declared(packages: DataFrame) -> T.StructType:
    given = packages.schema["content"].dataType if "content" in packages.columns else None
    return PACKAGES_BYTES if isinstance(given, T.BinaryType) else PACKAGES


# what the parser raises: no XML, an encoding that it does not know, bytes that are not of it
_UNREADABLE = (ElementTree.ParseError, LookupError, ValueError)


def _components(content: str | bytes | None, name: str) -> Iterator[tuple]:
    if content is None:
        yield None, None, "no content"
        return
    try:
        if len(content) <= _PIECE:
            found = ElementTree.fromstring(content).iterfind(f".//{name}")
        else:
            _read_through(content)  # nothing is given out of a document that breaks off
            found = _streamed(content, name)
    except _UNREADABLE as error:
        yield None, None, str(error)
        return
    texts = _Texts(name)  # the names it keeps are those of one document
    within: Iterator[str] = iter(())
    for index, element in enumerate(found, start=1):
        text = next(within, None)
        if text is None:  # the components inside one follow it
            within = texts.of_all(element)
            text = next(within)
        yield index, text, None


# what is written otherwise in a text and in an attribute
_IN_TEXT, _IN_ATTRIBUTE = re.compile("[&<>]"), re.compile('[&<>"\r\n\t]')
_WRITTEN = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
_WRITTEN_ATTRIBUTE = _WRITTEN | str.maketrans({'"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"})


class _Texts(dict):
    """``ElementTree.tostring(element, encoding="unicode")`` for the components of one name, in one pass over
    each outermost one and with what they share kept.

    Prefixes are numbered by component as their namespaces are met. That of the component's own name is
    always the first, so names in it, and those in none, are kept under their texts from component to component.
    A component that has no others is a stretch of the text of the one around it, but for its declarations.
    """

    def __init__(self, name: str):
        self.name = name
        self.prefixes: dict[str, str] = {}
        self.others = 0  # names met that are not kept
        self[name] = self._prefixed(name)
        self.first, self.declared = dict(self.prefixes), self._declarations()

    def __missing__(self, name: str) -> str:
        text = self._prefixed(name)
        if name[:1] != "{" or name[1:].rsplit("}", 1)[0] in self.first:
            self[name] = text
        else:
            self.others += 1
        return text

    def _prefixed(self, name: str) -> str:
        if name[:1] != "{":
            return name
        uri, local = name[1:].rsplit("}", 1)
        prefix = self.prefixes.get(uri)
        if prefix is None:
            prefix = ElementTree._namespace_map.get(uri)
            if prefix is None:
                prefix = f"ns{len(self.prefixes)}"
            if prefix != "xml":
                self.prefixes[uri] = prefix
        return f"{prefix}:{local}" if prefix else local

    def _declarations(self) -> str:
        by_prefix = sorted(self.prefixes.items(), key=lambda item: item[1])
        return "".join(f' xmlns{":" if prefix else ""}{prefix}="{_attribute(uri)}"' for uri, prefix in by_prefix)

    def of(self, component: ElementTree.Element) -> str:
        if len(self.prefixes) > len(self.first):
            self.prefixes = dict(self.first)
        tag = self[component.tag]
        parts: list[str] = []
        self._put(parts, [], component, tag)
        declared = self.declared if len(self.prefixes) == len(self.first) else self._declarations()
        return f"<{tag}{declared}{''.join(parts)}"

    def of_all(self, component: ElementTree.Element) -> Iterator[str]:
        """The texts of a component and of those inside it, in the order of the document."""
        parts: list[str] = []
        before = self.others
        inside: list[list] = []  # component, where its parts begin and end, whether it has other names
        tag = self[component.tag]
        self._put(parts, inside, component, tag)
        start = f"<{tag}{self.declared}"
        yield self.of(component) if self.others > before else start + "".join(parts)
        for element, first, last, others in inside:
            yield self.of(element) if others else start + "".join(parts[first:last])

    def _put(self, parts: list[str], inside: list[list], element: ElementTree.Element, tag: str) -> None:
        """What follows the name of an element in its text, and the text behind it."""
        text, tail, written = element.text, element.tail, ""
        for key, value in element.items():
            written += f' {self[key]}="{value if value.isalnum() else _attribute(value)}"'
        if tail and _IN_TEXT.search(tail):
            tail = tail.translate(_WRITTEN)
        if text or len(element):
            parts.append(written + ">")
            if text:
                parts.append(text.translate(_WRITTEN) if _IN_TEXT.search(text) else text)
            for inner in element:
                name = self[inner.tag]
                parts.append("<" + name)
                if inner.tag == self.name:
                    found = [inner, len(parts), 0, self.others]
                    inside.append(found)
                    self._put(parts, inside, inner, name)
                    found[2:] = len(parts), self.others > found[3]
                else:
                    self._put(parts, inside, inner, name)
            parts.append(f"</{tag}>{tail or ''}")
        else:
            parts.append(f"{written} />{tail or ''}")


def _attribute(value: str) -> str:
    return value.translate(_WRITTEN_ATTRIBUTE) if _IN_ATTRIBUTE.search(value) else value


def _pieces(content: str | bytes) -> Iterator[str | bytes]:
    for start in range(0, len(content), _PIECE):
        yield content[start : start + _PIECE]


class _Nothing:
    """A parser target that keeps nothing."""

    def close(self) -> None:
        pass


def _read_through(content: str | bytes) -> None:
    parser = ElementTree.XMLParser(target=_Nothing())
    for piece in _pieces(content):
        parser.feed(piece)
    parser.close()


def _streamed(content: str | bytes, name: str) -> Iterator[ElementTree.Element]:
    """The components of a document in its order, each with the text that follows it.

    A component is whole at the first event after its end. Those inside it come with it; what is
    done and in no open component is taken out of the tree after each piece.
    """
    parser = ElementTree.XMLPullParser(("start", "end"))
    opened: list[ElementTree.Element] = []
    outermost, ended = None, None  # how many are open around the outermost open component; one just ended

    def events() -> Iterator[tuple]:
        for piece in _pieces(content):
            parser.feed(piece)
            yield from parser.read_events()
            for element in opened if outermost is None else opened[:outermost]:
                del element[:-1]
        parser.close()
        yield from parser.read_events()

    for event, element in events():
        if ended is not None:
            yield from ended.iter(name)
            ended = None
        if event == "start":
            if outermost is None and opened and element.tag == name:
                outermost = len(opened)
            opened.append(element)
        else:
            opened.pop()
            if outermost == len(opened):
                outermost, ended = None, element


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), _ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def explode_components(packages: DataFrame, tag: str = TAG, namespace: str = NAMESPACE) -> DataFrame:
    return components_of(parse_packages(packages, tag, namespace))


def component_rejects(packages: DataFrame, tag: str = TAG, namespace: str = NAMESPACE) -> DataFrame:
    return rejects_of(parse_packages(packages, tag, namespace))


def components_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is null").drop("error")


def components_of_stretches(stretches: DataFrame) -> DataFrame:
    """A row for each component, in the order of the stretches; other columns are carried."""
    names = [n for n in stretches.columns if n not in ("component_index", "n_components", "components", "error")]
    opened = stretches.filter("error is null").select(
        *names, F.col("component_index").alias("_first"), F.posexplode("components").alias("_place", "ssis_component")
    )
    index = (F.col("_first") + F.col("_place")).alias("component_index")
    return opened.select(*names, index, "ssis_component")


def rejects_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is not null").select("ssis_file_path", "ssis_file_name", "error")
