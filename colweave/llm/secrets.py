"""Secrets in texts: plain patterns, and weak parts that count only next to complementary ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .text import whole_text


def _either_case(words: str) -> str:
    """The pattern with each letter in either case, ASCII only in every regex dialect."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The plain kinds, in their order; length is that of ``group``.
_BETWEEN = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"({_either_case('password|passwd|secret|token|api_?key')}){_BETWEEN}([A-Za-z0-9+/_.=-]+)"
BASE = (
    # kind, pattern, group, least length
    ("assign", ASSIGN, 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),  # runs are maximal, so this finds the long ones of [0-9a-f]+
)
#: Weak parts: a kind is the role it plays. A plain ``access`` plays id, a plain ``assign`` secret.
WEAK = (
    ("id", f"((?:{_either_case('client|user|account|key')})[_-]?(?:{_either_case('id|name')})){_BETWEEN}([A-Za-z0-9@._-]+)", 2, 3),
    ("secret", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", 0, 40),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(:[0-9]+)?", 0, 10),
)
ROLE_OF = {"access": "id", "assign": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}
#: Roles that must stand near a weak part for it to be reported.
NEEDS = {"id": ("secret",), "secret": ("id",), "endpoint": ("id", "secret")}
#: Matches that are walked at a time, so that no long array is copied for each of them.
STEPS = 256
#: Code points that may lie between two parts of one credential.
SCOPE = 200


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches, from the lengths of matches and of what lies between."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    value = lambda m: F.regexp_extract(m, pattern, group) if group else m
    steps = F.zip_with(
        matches,
        F.slice(between, 1, F.size(matches)),
        lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), F.length(value(m)).alias("size")),
    )
    nothing = F.from_json(F.lit("[]"), "array<struct<start:int,rank:int,end:int,kind:string,size:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + x["n"]).alias("end"),
            F.lit(kind).alias("kind"), x["size"].alias("size"),
        )
        return F.struct((start + x["n"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    # an element of an array is worked out once, however often the function of it needs it
    once = lambda value, function: F.transform(F.array(value), function)[0]

    def walk(all_steps: Column) -> Column:
        def piece(state: Column, k: Column) -> Column:
            start = F.struct(state["at"], nothing.alias("spans"))
            part = F.aggregate(F.slice(all_steps, k * STEPS + 1, F.lit(STEPS)), start, step)
            return once(part, lambda x: F.struct(x["at"], F.concat(state["parts"], F.array(x["spans"])).alias("parts")))

        pieces = F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / STEPS).cast("int"))
        return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.slice(F.array(nothing), 1, 0).alias("parts")), piece)

    walked = once(steps, walk)
    kept = F.filter(F.flatten(walked["parts"]), lambda s: s["size"] >= least)
    return F.when(text.rlike(pattern), kept).otherwise(nothing)


def _written(spans: Column) -> Column:
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Plain matches are always reported. A weak part (an identifier, a bare 40-character key, an
    endpoint) that no plain match overlaps is reported only where the parts that complete it lie
    within ``scope`` code points: a key and an identifier need each other, an endpoint needs both.
    The parts of all texts meet in one interval join: each is dealt to cells of ``scope`` code points
    of its row, so a task sees the parts of a stretch, not of a document.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind in the order of
    BASE and WEAK. A null text is empty; without spans the text of spans is empty and base_sha256 is
    that of the empty text. Ids are carried, not compared: null and repeated ones keep their rows.
    Other columns are not read. No rows give no rows.
    """
    text = F.col("_text")
    named = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kinds = [(k, *rest) for k, rest in enumerate((*BASE, *WEAK))]
    found = named.select(
        "_id", *(_spans(text, kind, k, pattern, group, least).alias(f"_{k}") for k, (kind, pattern, group, least) in enumerate((*BASE, *WEAK)))
    )
    n = len(BASE)
    base = F.array_sort(F.concat(*(F.col(f"_{k}") for k in range(n))))
    weak = F.concat(*(F.col(f"_{k}") for k in range(n, len(kinds))))
    # staged: the patterns run once, and the row numbers given here stay
    rows = stage(
        found.select(F.monotonically_increasing_id().alias("_row"), "_id", base.alias("_base"), weak.alias("_weak"))
    )
    linked = (
        _linked(rows, scope)
        .groupBy("_row")
        .agg(F.collect_list("part").alias("_linked"))
    )
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("_base", F.coalesce("_linked", F.slice("_base", 1, 0))))
    return rows.join(linked, "_row", "left").select(
        F.col("_id").alias("doc_id"),
        *(count(kind) for kind, *_ in BASE),
        F.sha2(_written(F.col("_base")), 256).alias("base_sha256"),
        _written(every).alias("spans"),
    )


def _linked(rows: DataFrame, scope: int) -> DataFrame:
    """Rows (_row, part): the weak parts outside all plain ones whose complements lie within ``scope``."""
    role = F.create_map(*(F.lit(x) for pair in ROLE_OF.items() for x in pair))
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))).alias("_cell")
    own = rows.where(F.size("_weak") > 0)
    every = own.select("_row", F.explode("_weak").alias("part"))
    plain = own.select("_row", F.explode("_base").alias("other"))
    # what overlaps lies in a cell of both
    inside = every.select("*", cells(F.col("part.start"), F.col("part.end") - 1))
    over = plain.select("*", cells(F.col("other.start"), F.col("other.end") - 1))
    overlap = (F.col("part.start") < F.col("other.end")) & (F.col("other.start") < F.col("part.end"))
    covered = inside.join(over, ["_row", "_cell"]).where(overlap).select("_row", "part").distinct()
    weak = every.join(covered, ["_row", "part"], "left_anti")
    parts = plain.unionByName(weak.withColumnRenamed("part", "other"))
    parts = parts.where(F.col("other.kind").isin(*ROLE_OF)).select(
        "_row",
        F.col("other.start").alias("_start"),
        F.col("other.end").alias("_end"),
        role[F.col("other.kind")].alias("_role"),
    )
    near = weak.select("*", cells(F.col("part.start") - scope, F.col("part.end") + scope))
    placed = parts.select("*", cells(F.col("_start"), F.col("_end")))
    within = (F.col("_start") <= F.col("part.end") + scope) & (F.col("_end") >= F.col("part.start") - scope)
    met = (
        near.join(placed, ["_row", "_cell"])
        .where(within & (F.col("_role") != F.col("part.kind")))
        .groupBy("_row", "part")
        .agg(*(F.max(F.col("_role") == r).alias(f"_has_{r}") for r in ("id", "secret")))
    )
    complete = F.lit(False)
    for kind, needs in NEEDS.items():
        whole = F.lit(True)
        for r in needs:
            whole = whole & F.col(f"_has_{r}")
        complete = complete | ((F.col("part.kind") == kind) & whole)
    return met.where(complete).select("_row", "part")
