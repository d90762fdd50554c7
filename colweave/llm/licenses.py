"""License scans: tags and notices by Aho-Corasick, and/or/with expressions by a shunting-yard parser.

Everything is found in one pass of one automaton over the words of a text: the three base phrases,
the notices, the names of exceptions, and the tags that announce an expression. Words are read from
the whole text, so wrapping and punctuation inside a phrase do not matter. What follows a tag is read
from the text itself, up to the end of its line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import whole_text

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: How far a licence restricts: free, weak copyleft, strong copyleft, use over a network, no free use.
FREE, WEAK, STRONG, NETWORK, LIMITED = range(5)

# Public short identifiers of licences, lower case.
IDENTIFIERS = {
    FREE: "mit mit-0 x11 isc 0bsd bsd bsd-2-clause bsd-3-clause bsd-4-clause apache-1.1 apache-2.0 zlib libpng "
    "bsl-1.0 unlicense wtfpl cc0-1.0 cc-by-3.0 cc-by-4.0 python-2.0 psf-2.0 postgresql ncsa upl-1.0 artistic-2.0",
    WEAK: "lgpl-2.0 lgpl-2.1 lgpl-3.0 lgpl-2.0-only lgpl-2.1-only lgpl-3.0-only lgpl-2.0-or-later lgpl-2.1-or-later "
    "lgpl-3.0-or-later mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cddl-1.1 ms-pl ofl-1.1",
    STRONG: "gpl-2.0 gpl-3.0 gpl-2.0-only gpl-3.0-only gpl-2.0-or-later gpl-3.0-or-later eupl-1.2 cc-by-sa-3.0 "
    "cc-by-sa-4.0 osl-3.0",
    NETWORK: "agpl-3.0 agpl-3.0-only agpl-3.0-or-later sspl-1.0",
    LIMITED: "cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 busl-1.1",
}
# Public identifiers of exceptions.
EXCEPTIONS = "classpath-exception-2.0 gcc-exception-3.1 llvm-exception linux-syscall-note openssl-exception font-exception-2.0"

# The wording of notices in lower case without punctuation, and the label of each.
NOTICES = {
    "mit license": ("mit", FREE),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", FREE),
    "apache license": ("apache", FREE),
    "apache license version 2 0": ("apache-2.0", FREE),
    "bsd license": ("bsd", FREE),
    "redistribution and use in source and binary forms": ("bsd", FREE),
    "isc license": ("isc", FREE),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", FREE),
    "zlib license": ("zlib", FREE),
    "boost software license": ("bsl-1.0", FREE),
    "free and unencumbered software released into the public domain": ("unlicense", FREE),
    "cc0 1 0": ("cc0-1.0", FREE),
    "cc by 4 0": ("cc-by-4.0", FREE),
    "creative commons attribution": ("cc-by", FREE),
    "lesser general public license": ("lgpl", WEAK),
    "library general public license": ("lgpl", WEAK),
    "mozilla public license": ("mpl", WEAK),
    "eclipse public license": ("epl", WEAK),
    "open font license": ("ofl", WEAK),
    "general public license": ("gpl", STRONG),
    "general public license version 2": ("gpl-2.0", STRONG),
    "general public license version 3": ("gpl-3.0", STRONG),
    "cc by sa 4 0": ("cc-by-sa-4.0", STRONG),
    "creative commons attribution sharealike": ("cc-by-sa", STRONG),
    "affero general public license": ("agpl", NETWORK),
    "server side public license": ("sspl", NETWORK),
    "cc by nc 4 0": ("cc-by-nc-4.0", LIMITED),
    "cc by nd 4 0": ("cc-by-nd-4.0", LIMITED),
    "cc by nc sa 4 0": ("cc-by-nc-sa-4.0", LIMITED),
    "cc by nc nd 4 0": ("cc-by-nc-nd-4.0", LIMITED),
    "creative commons attribution noncommercial": ("cc-by-nc", LIMITED),
    "business source license": ("busl", LIMITED),
}
# Exceptions as notices name them, tags, and the words that may stand between two notices.
NAMED_EXCEPTIONS = {
    "classpath exception": "classpath-exception-2.0",
    "runtime library exception": "gcc-exception-3.1",
    "linking exception": "linking-exception",
}
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False}
BETWEEN = frozenset("and or with either both the a an gnu this under terms of at your option its".split())
OFFERED = frozenset("licensed released distributed available under terms".split())

#: How much a finding says that a licence is granted.
BY_TAG, BY_OFFER, BY_MENTION = 0.95, 0.8, 0.4

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
AFTER_TAG = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?[ \t]*")
TOKEN = re.compile(rb"[ \t]*([()]|[0-9a-z.+-]+)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


class Licence(NamedTuple):
    labels: frozenset[str]
    rank: int
    exception: bool = False


@cache
def identifiers() -> dict[str, Licence]:
    known = {name: Licence(frozenset([name]), rank) for rank, names in IDENTIFIERS.items() for name in names.split()}
    return known | {name: Licence(frozenset([name]), FREE, True) for name in EXCEPTIONS.split()}


def operand(token: str) -> Licence | None:
    found = identifiers().get(token) or identifiers().get(token.removesuffix("+"))
    if found is None and token.startswith("licenseref-"):
        found = Licence(frozenset([token]), LIMITED)
    return found


def combine(operator: str, left: Licence, right: Licence) -> Licence | None:
    """Both must hold under ``and``, the freer is taken under ``or``, an exception loosens under ``with``."""
    labels = left.labels | right.labels
    if operator == "with":
        loosened = min(left.rank, WEAK) if left.rank in (STRONG, NETWORK) else left.rank
        return Licence(labels, loosened) if right.exception and not left.exception else None
    if left.exception or right.exception:
        return None
    return Licence(labels, (max if operator == "and" else min)(left.rank, right.rank))


def evaluate(tokens: list[str | Licence]) -> Licence | None:
    """The value of an expression by two stacks; None where it is none.

    A token is a name, a licence already known, an operator or a parenthesis. ``with`` binds most,
    then ``and``, then ``or``.
    """
    values: list[Licence] = []
    waiting: list[str] = []
    wants_value = True

    def reduce() -> bool:
        if len(values) < 2:
            return False
        right, left = values.pop(), values.pop()
        value = combine(waiting.pop(), left, right)
        if value is not None:
            values.append(value)
        return value is not None

    for token in tokens:
        if token in PRECEDENCE:
            if wants_value:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                if not reduce():
                    return None
            waiting.append(token)
            wants_value = True
        elif token == "(":
            if not wants_value:
                return None
            waiting.append(token)
        elif token == ")":
            if wants_value:
                return None
            while waiting and waiting[-1] != "(":
                if not reduce():
                    return None
            if not waiting:
                return None
            waiting.pop()
        else:
            value = operand(token) if isinstance(token, str) else token
            if value is None or not wants_value:
                return None
            values.append(value)
            wants_value = False
    while waiting:
        if waiting[-1] == "(" or not reduce():
            return None
    return values[0] if len(values) == 1 and not values[0].exception else None


def tokens_at(text: bytes, at: int, whole: bool) -> tuple[list[str], int]:
    """The tokens of the longest expression at ``at`` and where it ends; none where there is none.

    With ``whole`` the line may hold nothing else up to the first character that no token has; without
    it a sentence may go on. A full stop after a name ends the expression.
    """
    tokens: list[str] = []
    depth, wants_value, good, end, ended = 0, True, 0, at, False
    while not ended and (found := TOKEN.match(text, at)):
        at = found.end()
        token = found[1].decode("ascii").rstrip(".")
        ended = len(token) < len(found[1])
        if token in PRECEDENCE:
            fits = not wants_value
            wants_value = True
        elif token == "(":
            fits = wants_value
            depth += 1
        elif token == ")":
            depth -= 1
            fits = not wants_value and depth >= 0
        else:
            fits = wants_value and operand(token) is not None
            wants_value = False
        if not fits:
            return ([] if whole else tokens[:good]), end
        tokens.append(token)
        if depth == 0 and not wants_value:
            good, end = len(tokens), at
    return ([] if whole and good < len(tokens) else tokens[:good]), end


@cache
def automaton():
    """All phrases, a space on either side of each."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    phrases = {**dict.fromkeys(NOTICES, "notice"), **dict.fromkeys(NAMED_EXCEPTIONS, "exception"), **dict.fromkeys(TAGS, "tag")}
    for phrase, kind in phrases.items():
        machine.add_word(f" {phrase} ", (phrase, kind, len(phrase.split())))
    machine.make_automaton()
    return machine


class Hit(NamedTuple):
    start: int  # word
    end: int  # word after the last
    phrase: str
    kind: str


def hits_of(words: list[bytes]) -> list[Hit]:
    """Every place of every phrase, in order of the first word; of those that start together the longest first."""
    line = " " + b" ".join(words).decode("latin-1") + " "
    hits, seen, at = [], 0, 0  # ``seen`` spaces stand before ``at``
    for last, (phrase, kind, size) in automaton().iter(line):
        seen += line.count(" ", at, last)
        at = last
        hits.append(Hit(seen - size, seen, phrase, kind))
    return sorted(hits, key=lambda hit: (hit.start, -hit.end))


class Scan(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    expressions: str
    restriction: int | None


def scan(text: str) -> Scan:
    lowered = text.encode().lower()  # of bytes: A-Z only
    words = WORD.findall(lowered)
    hits = hits_of(words)
    base = [hit for hit in hits if hit.phrase in BASE]
    base_labels = {BASE[hit.phrase] for hit in base}
    inside: list[tuple[int, int]] = []
    found = [*_tagged(lowered, hits, inside)]
    found += _noticed(words, hits, inside)
    labels = base_labels.union(*(licence.labels for licence, _, _ in found))
    doubt = 1.0
    for weight, name in {(weight, name) for _, name, weight in found}:
        doubt *= 1.0 - weight
    return Scan(
        len(words),
        len(base),
        min((hit.start for hit in base), default=None),
        max((hit.start for hit in base), default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(labels)),
        1.0 - doubt,
        "; ".join(dict.fromkeys(name for _, name, _ in found)),
        max((licence.rank for licence, _, _ in found), default=None),
    )


Found = tuple[Licence, str, float]


def _tagged(lowered: bytes, hits: list[Hit], inside: list[tuple[int, int]]) -> Iterator[Found]:
    """The expressions after tags, and in ``inside`` the words of each, as first and the one after the last.

    After a plain word as tag the whole rest of the line must be one.
    """
    tags = {hit.end - 1: hit for hit in hits if hit.kind == "tag"}
    if not tags:
        return
    first, stop = None, -1
    for k, word in enumerate(WORD.finditer(lowered)):
        if first is not None and word.start() >= stop:
            inside.append((first, k))
            first = None
        sign = AFTER_TAG.match(lowered, word.end()) if k in tags else None
        if sign:
            tokens, end = tokens_at(lowered, sign.end(), whole=not TAGS[tags[k].phrase])
            value = evaluate(tokens)
            if value is not None:
                yield value, " ".join(t.upper() if t in PRECEDENCE else t for t in tokens), BY_TAG
                first, stop = k + 1, end
    if first is not None:
        inside.append((first, k + 1))


def _noticed(words: list[bytes], hits: list[Hit], inside: list[tuple[int, int]]) -> Iterator[Found]:
    """The notices, those joined by and, or, with as one expression each; not what a tag announced."""
    outer, end, tagged = [], 0, iter([*inside, (len(words) + 1, len(words) + 1)])
    low, high = next(tagged)
    for hit in hits:
        while hit.start >= high:
            low, high = next(tagged)
        if hit.kind != "tag" and hit.end > end and hit.end <= low:  # nor inside a longer one
            outer.append(hit)
            end = hit.end
    run: list[Hit | str] = []
    for hit in outer:
        joint = _joint(words, run[-1], hit) if run else None
        if joint is None:
            yield from _expression(words, run)
            run = [hit]
        else:
            run += [joint, hit]
    yield from _expression(words, run)


def _joint(words: list[bytes], before: Hit, after: Hit) -> str | None:
    """The one operator in the words between two phrases, if these are only words that join."""
    if after.start - before.end > 12:
        return None
    between = [word.decode("latin-1") for word in words[before.end : after.start]]
    joints = [word for word in between if word in PRECEDENCE]
    return joints[0] if len(joints) == 1 and BETWEEN.issuperset(between) else None


def _expression(words: list[bytes], run: list[Hit | str]) -> Iterator[Found]:
    phrases = [part for part in run if isinstance(part, Hit)]
    if not phrases:
        return
    known = {part: _licence(part) for part in phrases}
    value = evaluate([known[part] if isinstance(part, Hit) else part for part in run])
    before = words[max(0, phrases[0].start - 8) : phrases[0].start]
    weight = BY_OFFER if any(word.decode("latin-1") in OFFERED for word in before) else BY_MENTION
    if value is not None:
        yield value, " ".join(min(known[p].labels) if isinstance(p, Hit) else p.upper() for p in run), weight
    else:  # joined in no sensible way: each by itself
        yield from ((known[p], min(known[p].labels), weight) for p in phrases if not known[p].exception)


def _licence(hit: Hit) -> Licence:
    if hit.kind == "exception":
        return Licence(frozenset([NAMED_EXCEPTIONS[hit.phrase]]), FREE, True)
    label, rank = NOTICES[hit.phrase]
    return Licence(frozenset([label]), rank)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, expressions, restriction.

    Words are runs of ASCII letters, digits and any other character beyond ASCII, A-Z lowered. The
    base columns count all places of the base phrases. ``labels`` holds the labels of all base
    phrases, notices and parsed expressions; ``expressions`` these as they were read, each once;
    ``restriction`` the rank of the strictest, 0 to 4, null without any: under ``and`` the stricter
    licence counts, under ``or`` the freer, and an exception loosens what it is ``with``. ``score``
    is 1 minus the product of the doubts that the distinct findings leave: 0 without findings.

    A null text is empty: no words, no labels, score 0. Null ids and rows that share an id or a text
    stay, each with its own result. Other columns of ``docs`` are not read. No rows give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([scan(text) for text in batch["text"]], columns=Scan._fields)
            places = {name: rows[name].astype("Int64") for name in ("first_word", "last_word", "restriction")}
            yield rows.assign(doc_id=batch["doc_id"], **places)[columns]

    columns = ["doc_id", *Scan._fields]
    numbered = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = numbered.schema["doc_id"].dataType.simpleString()
    return numbered.mapInPandas(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, expressions string, restriction int",
    )
