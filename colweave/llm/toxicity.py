"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .fit import SAMPLE_ROWS, constant_score, labelled_sample, lasso_logistic, sigmoid
from .text import remainder, whole_text

THRESHOLD = 0.7
MODULUS, HELD = 3, 1
PENALTY = 0.0005
WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;\n]+")
#: Least and most letters of a stem; precision that a cue needs, and its evidence in nats beyond the
#: log of the number of terms that were tried.
STEM = (4, 7)
PRECISION, EVIDENCE = 0.6, 1.5

# Function words of the grammar in its four languages. Insults and threats are learned.
TARGETS = "you your yours he she they them him her du dich dir ihr euch sie er tu toi vous il elle ils usted ustedes tú te él ella ellos"
NEGATIONS = "not never no isn't aren't don't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún tampoco"
REPORTS = "said says told called wrote claims sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó"

#: Symbols that the machines read: a cue, a word of one of the lists, any other word, the clause end.
SYMBOLS = ("cue", "target", "negation", "report", "word", "end")
#: Words after a negation that it still reaches.
REACH = 3


@dataclass(frozen=True)
class Machine:
    """A deterministic transducer: (state, symbol) to (state, output); what is not listed stays, silently."""

    start: str
    steps: dict[tuple[str, str], tuple[str, str]]

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.steps.get((state, symbol), (state, ""))


def _negation() -> Machine:
    """Says ``denied`` at a cue within REACH words of a negation."""
    steps: dict = {("0", "negation"): (str(REACH), "")}
    for k in range(1, REACH + 1):
        after = str(k - 1)
        steps |= {(str(k), s): (after, "") for s in ("word", "target", "report")}
        steps |= {(str(k), "negation"): (str(REACH), ""), (str(k), "cue"): (after, "denied"), (str(k), "end"): ("0", "")}
    return Machine("0", steps)


MACHINES = (
    # insult or threat: a cue was read in this clause
    Machine("0", {("0", "cue"): ("1", "cue"), ("1", "cue"): ("1", "cue"), ("1", "end"): ("0", "")}),
    Machine("0", {("0", "target"): ("1", ""), ("1", "cue"): ("1", "aimed"), ("1", "end"): ("0", "")}),
    _negation(),
    Machine("0", {("0", "report"): ("1", ""), ("1", "cue"): ("1", "quoted"), ("1", "end"): ("0", "")}),
)


def compose(machines: tuple[Machine, ...]) -> tuple[list[dict[str, tuple[int, str]]], int]:
    """The product of the machines: for each state, symbol to (state, outputs joined by +)."""
    start = tuple(m.start for m in machines)
    number, table, waiting = {start: 0}, [], [start]
    while waiting:
        state = waiting.pop(0)
        row = {}
        for symbol in SYMBOLS:
            moved = [m.step(s, symbol) for m, s in zip(machines, state, strict=True)]
            target = tuple(s for s, _ in moved)
            if target not in number:
                number[target] = len(number)
                waiting.append(target)
            row[symbol] = (number[target], "+".join(out for _, out in moved if out))
        table.append(row)
    return table, 0


#: What a matched cue can come out as, and the weight of each before any label is seen.
PATTERNS = {
    "cue": 2.0, "cue+aimed": 2.5, "cue+denied": 1.0, "cue+quoted": 1.0,
    "cue+aimed+denied": 1.0, "cue+aimed+quoted": 1.0, "cue+denied+quoted": 0.5, "cue+aimed+denied+quoted": 0.5,
    "all, of 100 words": 0.0,
}


@dataclass(frozen=True)
class ToxicModel:
    """Cues (a word, or a stem with * behind it) with their log odds, and the weights of the patterns."""

    cues: dict[str, float]
    intercept: float = 0.0
    weights: dict[str, float] = field(default_factory=lambda: dict(PATTERNS))

    def scores(self, texts: Iterator[str]) -> np.ndarray:
        reader = ClauseReader(self.cues)
        x = np.array([reader.features(text) for text in texts]).reshape(-1, len(PATTERNS))
        return sigmoid(self.intercept + x @ np.array([self.weights[p] for p in PATTERNS]))


class ClauseReader:
    """Runs the composed machine over the clauses of a text that hold a cue."""

    def __init__(self, cues: dict[str, float]):
        self.words = {c: w for c, w in cues.items() if not c.endswith("*")}
        self.stems = {c[:-1]: w for c, w in cues.items() if c.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.lists = {
            word: symbol
            for symbol, listed in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS))
            for word in listed.split()
        }
        self.table, self.start = compose(MACHINES)
        self.order = {p: k for k, p in enumerate(PATTERNS)}
        self.seen: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """Log odds of a cue, 0 for any other word."""
        known = self.seen.get(word)
        if known is None:
            known = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self.lengths)])
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = known
        return known

    def features(self, text: str) -> list[float]:
        """For each pattern the log of one plus the cue weights that came out as it; last, of 100 words."""
        total = [0.0] * len(self.order)
        lower = text.lower()
        weight = self.weight
        words = WORD.findall(lower)
        if any(weight(word) for word in set(words)):
            for clause in CLAUSE_END.split(lower):
                found = WORD.findall(clause)
                cues = [weight(word) for word in found]
                if any(cues):
                    state = self.start
                    for word, cue in zip(found, cues, strict=True):
                        state, out = self.table[state]["cue" if cue else self.lists.get(word, "word")]
                        if out:
                            total[self.order[out]] += cue
            total[-1] = 100 * sum(total) / len(words)
        return [math.log1p(x) for x in total]


def _terms(text: str) -> set[str]:
    found = set(WORD.findall(text.lower()))
    stems = {word[:n] + "*" for word in found for n in range(STEM[0], min(STEM[1], len(word) - 1) + 1)}
    return {word for word in found if len(word) > 2} | stems


def learn_cues(sample: DataFrame) -> dict[str, float]:
    """Words and stems whose texts are labelled toxic far more often than chance gives.

    A term is kept on the evidence n * KL(its share of toxic texts, that of all) and its precision.
    Of a stem and a longer one with nearly the same texts the longer stays; what a kept stem covers
    goes.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, all_texts = Counter(), Counter()
            for text, y in zip(batch["text"], batch["y"], strict=True):
                terms = _terms(text)
                all_texts.update(terms)
                if y:
                    toxic.update(terms)
            keys = list(all_texts)
            yield pd.DataFrame({"term": keys, "n": list(all_texts.values()), "k": [toxic[t] for t in keys]})

    n, k = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < k < n:
        return {}
    base = k / n
    share = F.greatest(F.col("k") / F.col("n"), F.lit(1e-9))
    rest = F.greatest(1 - share, F.lit(1e-9))
    evidence = F.col("n") * (share * F.log(share / base) + rest * F.log(rest / (1 - base)))
    terms = stage(
        sample.select("text", "y")
        .mapInPandas(count, "term string, n long, k long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        .where("n >= 3")
    )
    least = math.log(max(1, terms.count())) + EVIDENCE
    found = terms.where((share >= max(PRECISION, min(0.95, 2 * base))) & (evidence >= least)).collect()
    counts = {row["term"]: (row["k"], row["n"]) for row in found}
    longer = {}
    for term, (hits, _) in counts.items():
        stem = term.rstrip("*")
        for size in range(STEM[0], len(stem) + 1):
            general = stem[:size] + "*"
            if general != term and hits >= 0.95 * counts.get(general, (math.inf, 0))[0]:
                longer[general] = term
    cues = {}
    for term in sorted(counts, key=lambda t: (len(t.rstrip("*")), t)):
        hits, texts = counts[term]
        stem = term.rstrip("*")
        covered = any(stem[:size] + "*" in cues for size in range(STEM[0], len(stem) + 1))
        if term not in longer and not covered:
            cues[term] = math.log((hits + 0.5) / (k + 1) / ((texts - hits + 0.5) / (n - k + 1)))
    return cues


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> ToxicModel:
    """Learn cues and pattern weights from at most ``most`` labelled rows outside the held-out fold.

    Of the texts only the clause features reach the driver. One class alone, or no label, gives a
    constant score.
    """
    sample = labelled_sample(docs, labels, "toxic", MODULUS, HELD, most)
    cues = learn_cues(sample)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = ClauseReader(cues)
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [reader.features(text) for text in batch["text"]]})

    rows = sample.select("text", "y").mapInPandas(features, "y double, x array<double>").toPandas()
    y = rows["y"].to_numpy(float)
    if not len(y) or y.min() == y.max() or not cues:
        score = constant_score(y)
        return ToxicModel({}, math.log(score / (1 - score)))
    x = np.array(rows["x"].tolist())
    intercept, weights = lasso_logistic(x, y, PENALTY, prior=np.array(list(PATTERNS.values())))
    return ToxicModel(cues, intercept, dict(zip(PATTERNS, weights.tolist(), strict=True)))


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Every whole text is read; a clause counts by what the composed machine says of its cues: plain,
    aimed at someone, denied, or quoted. A text without cues, an empty or null one too, has the score
    of no match. A null id is in no fold and has held_out null. Labels, language, source and id are
    not read for the score.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.scores(batch["text"])})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", whole_text("text").alias("text")).mapInPandas(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        (remainder("doc_id", MODULUS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
