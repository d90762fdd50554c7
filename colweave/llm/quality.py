"""Quality of texts by a sparse ensemble of rules over statistics, scored as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fit import SAMPLE_ROWS, constant_score, labelled_sample, lasso_logistic, sigmoid
from .text import remainder, whole_text, words

THRESHOLD = 0.3
MODULUS, HELD = 5, 0
TREES, DEPTH, BINS = 30, 3, 32
PENALTY = 0.0008


def _statistics(text: Column) -> dict[str, Column]:
    """Statistics of the whole text; the columns ``_words`` and ``_lines`` are its words and lines."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    n_words = F.greatest(F.size("_words"), F.lit(1)).cast("double")
    share = lambda pattern, of: F.regexp_count(text, F.lit(pattern)) / of
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_length": n / n_words,
        "distinct_words": F.size(F.array_distinct("_words")) / n_words,
        "distinct_lines": F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1)),
        "words_per_line": F.log1p(n_words / F.greatest(F.size("_lines"), F.lit(1))),
        "upper": share(r"\p{Lu}", n),
        "digits": share(r"\p{N}", n),
        "symbol_words": share(r"[#$%&*!?+=~^@]{2,}", n_words),
        "lone_symbols": share(r"(?<=\s)[^\p{L}\p{N}\s]+(?=\s)", n_words),
        "punctuation": share(r"[.,;:]", n_words),
        "other_symbols": share(r"[^\p{L}\p{N}\s.,;:]", n),
    }


STATISTICS = (
    "log_chars", "word_length", "distinct_words", "distinct_lines", "words_per_line", "upper", "digits",
    "symbol_words", "lone_symbols", "punctuation", "other_symbols",
)


def with_statistics(rows: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` and the statistics, as columns named ``_s_`` and the name."""
    text = F.col("_text")
    split = rows.select(*keep, whole_text(text_col).alias("_text")).select(
        "*", words(text).alias("_words"), F.split(text, "\n", -1).alias("_lines")
    )
    kept = [c for c in split.columns if c not in ("_text", "_words", "_lines")]
    return split.select(*kept, *(c.cast("double").alias(f"_s_{k}") for k, c in _statistics(text).items()))


@dataclass(frozen=True)
class Rule:
    """A conjunction: each part is (statistic, above, bound), above or at most the bound."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, k] > b) == above for k, above, b in self.parts])

    def column(self) -> Column:
        whole = None
        for k, above, bound in self.parts:
            value = F.col(f"_s_{STATISTICS[k]}")
            part = value > bound if above else value <= bound
            whole = part if whole is None else whole & part
        return whole


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...] = ()
    weights: tuple[float, ...] = ()

    def column(self) -> Column:
        """The score, from columns of statistics."""
        z = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _grow(x, bounds, gradient, rows, columns, depth, path, found) -> np.ndarray:
    """Grow a regression tree on the gradient; every node below the root adds its path as a rule."""
    value = np.zeros(len(x))
    value[rows] = gradient[rows].mean()
    best = None
    if depth and len(rows) >= 10:
        g, total = gradient[rows], gradient[rows].sum()
        for k in columns:
            for bound in bounds[k]:
                above = x[rows, k] > bound
                m = int(above.sum())
                if 3 <= m <= len(rows) - 3:
                    s = g[above].sum()
                    gain = s * s / m + (total - s) ** 2 / (len(rows) - m)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, k, bound, above)
    if best is None or best[0] - gradient[rows].sum() ** 2 / len(rows) < 1e-6:
        return value
    _, k, bound, above = best
    for side in (True, False):
        own = (*path, (k, side, float(bound)))
        found.append(Rule(tuple(sorted(own))))
        child = rows[above if side else ~above]
        value[child] = _grow(x, bounds, gradient, child, columns, depth - 1, own, found)[child]
    return value


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 0) -> RuleModel:
    """Rules from boosted trees of random parts of the rows and statistics, weighted by lasso logistic."""
    score = constant_score(y)
    constant = RuleModel(float(np.log(score / (1 - score))))
    if not len(y) or y.min() == y.max():
        return constant
    draw = np.random.default_rng(seed)
    bounds = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    margin, found = np.zeros(len(y)), []
    for _ in range(TREES):
        rows = np.sort(draw.choice(len(y), min(len(y), max(200, min(2_000, len(y) // 2))), replace=False))
        columns = np.sort(draw.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False))
        found_here: list[Rule] = []
        _grow(x, bounds, y - sigmoid(margin), rows, columns, DEPTH, (), found_here)
        found += found_here
        # the step of the whole sample: leaves are the longest paths
        leaves = [r for r in found_here if not any(set(r.parts) < set(o.parts) for o in found_here)]
        for leaf in leaves:
            inside = leaf.holds(x)
            if inside.any():
                margin[inside] += 4 * (y - sigmoid(margin))[inside].mean()
    columns = {}
    for rule in dict.fromkeys(found):
        held = rule.holds(x)
        if 0 < held.sum() < len(y):
            columns.setdefault(held.tobytes(), (len(rule.parts), rule, held))
    kept = list(columns.values())
    if not kept:  # too few rows to tell anything apart
        return constant
    rules = [rule for _, rule, _ in kept]
    matrix = np.column_stack([held for *_, held in kept]).astype(float)
    intercept, weights = lasso_logistic(matrix, y, PENALTY)
    used = [k for k in range(len(rules)) if abs(weights[k]) > 1e-6]
    return RuleModel(intercept, tuple(rules[k] for k in used), tuple(float(weights[k]) for k in used))


def train_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> RuleModel:
    """Learn from at most ``most`` labelled rows outside the held-out fold.

    Only the statistics of those rows reach the driver. One class alone, or no label, gives a
    constant score.
    """
    sample = labelled_sample(docs, labels, "quality", MODULUS, HELD, most)
    stats = with_statistics(sample, "text", [F.col("y").alias("_y"), F.col("id").alias("_id")])
    rows = stats.orderBy("_id").drop("_id").toPandas()
    return fit_rules(rows[[f"_s_{k}" for k in STATISTICS]].to_numpy(float), rows["_y"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Every whole text is scored, an empty or null one by its statistics too. A null id is in no fold
    and has held_out null. Labels, language, source and id are not read for the score.
    """
    stats = with_statistics(docs, "text", [F.col("doc_id").alias("_id")])
    scored = stats.select(F.col("_id").alias("doc_id"), model.column().alias("score"))
    return scored.select(
        "doc_id",
        (remainder("doc_id", MODULUS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of ``docs`` whose text scores at least THRESHOLD, with their columns."""
    stats = with_statistics(docs, "text", [F.struct(*docs.columns).alias("_row")])
    # not a filter: pushed below the statistics, it would work them out again for every rule
    kept = F.explode(F.when(model.column() >= THRESHOLD, F.array("_row"))).alias("_kept")
    return stats.select(kept).select("_kept.*")
