"""HTML pages as sequences of text blocks with their tag paths."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

# Element names by their part in the layout.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol option p pre search "
    "section select summary table tbody td tfoot th thead tr ul button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; what an object or canvas shows where it cannot be
#: drawn is none either.
HIDDEN = "script|style|noscript|template|textarea|svg|object|canvas|iframe"
#: Elements inside a head, with content and without; anything else ends it, a text too.
HEAD_HIDDEN = "title script style noscript template".split()
HEAD_VOID = "meta|link|base|basefont|bgsound"
#: Opening the first closes an open element of the second kind, unless one of the third lies between.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "tr": ("tr", ("table",)),
    "option": ("option", ("select",)),
}
_END = r"(?=[\s/>])"  # of an element's name
# a quote begins a value only after an equals sign; one anywhere else is a character like others
_VALUE = r"=\s*(?:\"[^\"]*\"|'[^']*')"
_REST = rf"(?>{_VALUE}|[^>])*+>"
_COMMENT = r"<!--.*?(?:-->|\Z)"
_IN_HEAD = "|".join(
    [r"\s+", _COMMENT, rf"<(?:{HEAD_VOID}){_END}{_REST}", *(rf"<{e}{_END}{_REST}.*?(?:</{e}\s*>|\Z)" for e in HEAD_HIDDEN)]
)
TOKEN = re.compile(
    rf"{_COMMENT}|<head{_END}{_REST}(?:{_IN_HEAD})*(?:</head\s*>)?"
    rf"|<svg{_END}(?>{_VALUE}|[^>/]|/(?!>))*+/>"  # closed at once
    rf"|<({HIDDEN}){_END}{_REST}.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>{_VALUE}|[^>])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

PATH_SLOTS = 2_048
WORD_SLOTS = 32
NUMBERS = 8
END_MARKS = ".!?:;…。"


@dataclass
class Block:
    path: tuple[int, ...]  # hashed names along the tag path
    text: str
    linked: int  # characters inside links


def _names(tag: str, attributes: str) -> tuple[int, ...]:
    """Hashed names of an element: its tag, and the words of its class, id and role."""
    names = [tag]
    if attributes and "=" in attributes:
        for key, *values in NAMED.findall(attributes):
            value = "".join(values)
            names += [f"{tag}.{value.lower()}", *(f".{part.lower()}" for part in PART.findall(value))]
            names.append(f"{tag}[{key.lower()}]")
    return tuple(zlib.crc32(name.encode()) % PATH_SLOTS for name in names)


def split_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order: character references decoded, white space runs one space.

    Block-level elements and their ends cut; inline elements do not, a line break is white space.
    Comments, scripts, styles and other hidden content are dropped; a head ends where something
    stands that cannot be in it. Broken markup is read on as far as it goes.
    """
    blocks: list[Block] = []
    stack: list[str] = []
    paths: list[tuple[int, ...]] = []  # the names down to each open element, shared where none is new
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked, in_link = 0, 0
    known: dict[tuple[str, str], tuple[int, ...]] = {}

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(paths[-1] if paths else (), text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(names: tuple[str, ...], within: tuple[str, ...]) -> None:
        nonlocal in_link
        if not any(opened[name] for name in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in names:
                in_link -= stack[k:].count("a")
                opened.subtract(stack[k:])
                del stack[k:], paths[k:]
                return
            if stack[k] in within:
                return

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        cuts = tag in BLOCKS
        if cuts:
            flush()
        if m[2] or m[5]:
            close((tag,), ())
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            continue
        if cuts:
            close(("p",), ("div", "section", "article", "table", "td", "li", "blockquote", "main", "aside"))
        if tag in CLOSES:
            own, within = CLOSES[tag]
            close(tuple(own.split()), within)
        attributes = m[4] or m[7] or ""
        if attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        key = (tag, attributes)
        if tag == "a":
            in_link += 1
            key = (tag, "")
        if key not in known:
            known[key] = _names(*key)
        path = paths[-1] if paths else ()
        new = tuple(slot for slot in dict.fromkeys(known[key]) if slot not in path)
        stack.append(tag)
        paths.append(path + new if new else path)
        opened[tag] += 1
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return blocks


def block_vectors(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shares of the words, and numbers of size, links and form, for each block."""
    words = np.zeros((len(blocks), WORD_SLOTS), np.float32)
    numbers = np.zeros((len(blocks), NUMBERS), np.float32)
    crc = zlib.crc32
    for k, block in enumerate(blocks):
        found = block.text.encode().lower().split()
        slots = np.fromiter((crc(w) for w in found), np.int64, len(found)) % WORD_SLOTS
        words[k] = np.bincount(slots, minlength=WORD_SLOTS) / len(found)
        n = len(block.text)
        numbers[k] = (
            np.log1p(len(found)) / 3, block.linked / n, block.text[-1] in END_MARKS, n / len(found) / 10,
            k / len(blocks), 1 / (1 + len(blocks)), "©" in block.text, block.text[:1].isupper(),
        )
    return words, numbers
