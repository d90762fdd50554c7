"""Benchmark items in documents, found through templates whose numbers, names and units are slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .text import NO_SPACE, SPACE, whole_text

WINDOW = 5
#: Share of an item's windows that a document must hold.
COVER = 0.8
#: Windows of the benchmark up to which they are sent to every task (at 64 bytes each, 64 MB);
#: beyond it both sides are shuffled by the hash.
BROADCAST_WINDOWS = 1_000_000

#: Starts a slot; a letter of its type and its value follow. A private character, removed from texts.
MARK = ""
# Words for small numbers, and units that count behind a number.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty fifty hundred thousand million"
UNITS = "mm cm m km mg g kg t ml l s min h kb mb gb kw w v % ° € $ £ percent dollars euros meters metres miles hours minutes days years"


def _marked(text: Column) -> Column:
    """Lower-case words without punctuation; a slot is one word: the mark, its type and its value."""
    name = r"(?<=[\p{L}\p{N},;:] )\p{Lu}\p{Ll}[\p{L}'’-]*"  # a capital inside a sentence
    spaced = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("")), rf"[\x09-\x0D]{SPACE}*|\x20{SPACE}+", " ")
    named = F.regexp_replace(spaced, name, f"{MARK}a$0")
    number = rf"(?<!\p{{L}})[$€£]?\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*|(?<={SPACE})(?:{'|'.join(NUMBER_WORDS.split())})(?={SPACE})"
    folded = F.replace(F.replace(F.lower(named), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))  # as their capitals
    numbered = F.regexp_replace(folded, number, f"{MARK}n$0")
    units = "|".join(sorted((rf"\Q{u}\E" for u in UNITS.split()), key=len, reverse=True))
    measured = F.regexp_replace(numbered, rf"({MARK}n{NO_SPACE}*?\p{{Nd}})\x20?({units})(?![\p{{L}}\p{{N}}])", f"$1 {MARK}u$2")
    return F.regexp_replace(measured, rf"[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D{MARK}%°€$£]+", "")


def _windows(rows: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """A row per window of ``_text``: ``keep``, position, hash of the template, slot values in order.

    A window with slots has one more row, with the hash of its words and no slot values.
    """
    tokens = rows.select(*keep, _marked(F.col("_text")).alias("_marked"))
    plain = F.regexp_replace("_marked", f"{MARK}(.){NO_SPACE}*", f"{MARK}$1")
    split = lambda c: F.filter(F.split(c, SPACE + "+", -1), lambda t: t != "")
    slotted = F.when(
        F.contains("_marked", F.lit(MARK)),
        F.transform(split(F.col("_marked")), lambda t: F.when(t.startswith(MARK), t)),
    )
    words = F.when(F.contains("_marked", F.lit(MARK)), split(F.regexp_replace("_marked", f"{MARK}.", "")))
    tokens = tokens.select(*keep, split(plain).alias("_plain"), slotted.alias("_slots"), words.alias("_words"))

    none = F.array().cast("array<int>")

    def window(n: int, k: Column, of: str, slots: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), k.alias("at"), F.xxhash64(F.slice(of, k, n)).alias("hash"), slots.alias("slots"))

    def of(n: int) -> Column:
        starts = F.when(F.size("_plain") >= n, F.sequence(F.lit(1), F.size("_plain") - n + 1))
        slots = lambda k: F.array_join(F.slice("_slots", k, n), " ")
        held = F.coalesce(F.when(F.col("_words").isNotNull(), F.filter(starts, lambda k: slots(k) != "")), none)
        return F.concat(
            F.transform(F.coalesce(starts, none), lambda k: window(n, k, "_plain", F.coalesce(slots(k), F.lit("")))),
            F.transform(held, lambda k: window(n, k, "_words", F.lit(""))),
        )

    return tokens.select(*keep, F.explode(F.concat(*map(of, lengths)) if len(lengths) > 1 else of(lengths[0])).alias("w"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (item, item_id, whole, n, at, hash, slots): item numbers the rows of the benchmark.

    ``whole`` counts the windows of the item. An item of fewer words than a window is one window.
    """
    size = F.size(F.filter(F.split(_marked(F.col("_text")), SPACE + "+", -1), lambda t: t != ""))
    items = stage(
        benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), whole_text("text").alias("_text"))
        .withColumn("_size", size)
    )  # staged: the numbers stay
    whole = F.greatest(F.col("_size") - window + 1, F.lit(1)).alias("whole")

    def of(rows: DataFrame, first: int) -> DataFrame:
        windows = _windows(rows, ["item", "item_id", "_size"], list(range(1, window + 1)))
        own = windows.where((F.col("w.n") == F.least("_size", F.lit(window))) & (F.col("w.at") >= first))
        at = F.col("w.at") - (first - 1)
        return own.select("item", "item_id", whole, "w.n", at.alias("at"), "w.hash", "w.slots")

    # an item's first word may be a name inside a sentence of the document
    inside = of(items.withColumn("_text", F.concat(F.lit("x "), F.ltrim("_text"))), 2).where("at = 1")
    return stage(of(items, 1).union(inside).distinct())


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER
) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, matched, whole, coverage.

    Case, punctuation and the kind of white space go. Texts become templates, in which numbers, names
    and units turn into typed placeholders. Windows of five words meet in a hash join, as templates
    and as the words that they are. A window counts where its words are the same, which does not
    depend on what is taken for a name, or where the templates are and the slots agree: at one offset of item and document, a value of the item may stand for one value of
    the document only, so a question asked with other numbers is found, and a chance mixture of
    values is not. Windows that hold a value with two readings do not count, unless all their slots
    are those of the item to the letter. An item is held where at least ``cover`` of its windows count. All windows of all
    documents are compared.

    Null texts are empty and hold nothing; an item without words is never found. Rows that share an
    id are told apart by their text; identical rows give identical results, once. Other columns are
    not read. No rows on either side give no rows.
    """
    return _leaks(docs, benchmark, id_col, text_col, cover).select(
        F.col("_id").alias("doc_id"), "item_id", "matched", "whole", (F.col("matched") / F.col("whole")).alias("coverage")
    )


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, cover: float) -> DataFrame:
    items = benchmark_windows(benchmark)
    lengths = sorted(row["n"] for row in items.select("n").distinct().collect()) or [WINDOW]  # 1 to 5
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_form"), text.alias("_text"))
    theirs = items.select(*(F.col(c).alias(f"_{c}") for c in items.columns))
    if items.count() <= BROADCAST_WINDOWS:
        theirs = F.broadcast(theirs)
    hits = stage(
        _windows(rows, ["_id", "_form"], lengths)
        .select("_id", "_form", "w.*")
        .join(theirs, (F.col("hash") == F.col("_hash")) & (F.col("n") == F.col("_n")))
        .select("_id", "_form", "_item", "_item_id", "_whole", "_at", (F.col("at") - F.col("_at")).alias("_offset"),
                F.col("slots").alias("_ours"), "_slots")
        .distinct()
    )
    place = ["_id", "_form", "_item", "_offset"]
    # by offset, the values of the item that stand for two of the document
    pairs = hits.where("_slots != ''").select(
        *place, F.explode(F.arrays_zip(F.split("_slots", " ").alias("a"), F.split("_ours", " ").alias("b"))).alias("_pair")
    )
    torn = (
        pairs.groupBy(*place, "_pair.a")
        .agg((F.min("_pair.b") != F.max("_pair.b")).alias("_torn"))
        .where("_torn")
        .groupBy(*place)
        .agg(F.collect_set("a").alias("_values"))
        .select(*(F.col(c).alias(f"{c}_") for c in place), "_values")
    )
    same = F.lit(True)
    for c in place:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    agrees = (F.col("_slots") == F.col("_ours")) | ~F.arrays_overlap(F.split("_slots", " "), "_values")
    whole = hits.join(torn, same, "left").where(F.col("_values").isNull() | agrees)
    return (
        whole.select("_id", "_form", "_item", "_item_id", "_whole", "_at")
        .distinct()
        .groupBy("_id", "_form", "_item", F.col("_item_id").alias("item_id"), F.col("_whole").alias("whole"))
        .agg(F.count("*").alias("matched"))
        .where(F.col("matched") >= cover * F.col("whole"))
    )


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    held = _leaks(docs, benchmark, id_col, text_col, cover).select("_id", "_form").distinct()
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(whole_text(text_col)).alias("_text")
    )
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_form"))
    return keyed.join(held, same, "left_anti").select("_row.*")
