"""Mixing sources to target weights: blocks of each source placed by a Pfair schedule."""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .text import whole_text

BLOCK_CHARS = 65_536
#: Slots of a period of rounded weights; ``mix`` takes the weights as they are.
QUANTA = 1_000
#: Blocks of a source whose slots go to the tasks as one row.
CHUNK = 4_096
#: Rows of a source that share a stretch of its order, about.
STRETCH_ROWS = 4_096
#: Weights where none are given: shares of the characters to this power.
TEMPER = 0.5


def whole_parts(weights: Mapping[str, float], quanta: int = QUANTA) -> dict[str, int]:
    """Weights as whole parts of about ``quanta``, at least 1 each, by largest remainder."""
    total = sum(weights.values())
    quanta = max(quanta, len(weights))
    exact = {s: quanta * w / total for s, w in weights.items()}
    parts = {s: max(1, math.floor(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], str(s)))[: max(0, quanta - sum(parts.values()))]:
        parts[s] += 1
    return parts


def schedule(shares: Mapping[str, int], blocks: Mapping[str, int] | None = None) -> dict[str, array]:
    """The slots of each source, earliest deadline first among released blocks.

    Of a share w (its part of all), block j (from 0) is released at floor(j / w) and due by
    ceil((j + 1) / w), in whole numbers throughout. The shares fill all slots, so every deadline is
    met and each source stays within one block of its share at any slot. It ends where a source has
    had all of its ``blocks``; without them, after one period.
    """
    total = sum(shares.values())
    names = sorted(shares, key=str)
    slots = {s: array("q") for s in names}
    waiting: list[tuple[int, int]] = [(0, k) for k in range(len(names))]
    ready: list[tuple[int, int]] = []
    for t in itertools.count() if blocks else range(total):
        while waiting and waiting[0][0] <= t:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[names[k]]) + 1) * total // shares[names[k]]), k))
        _, k = heapq.heappop(ready)
        own = slots[names[k]]
        own.append(t)
        if blocks and len(own) == blocks[names[k]]:
            break
        heapq.heappush(waiting, (len(own) * total // shares[names[k]], k))
    return slots


def period(parts: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period, of as many slots as there are parts."""
    return {s: list(slots) for s, slots in schedule(parts).items()}


def exact_shares(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def phases(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[tuple]:
    """Rows (source, first block, end block, first slot, slots of the phase, blocks, slots).

    A phase lasts until a source has no block left; the next one shares the slots among the rest in
    the same proportions. There are at most as many phases as sources.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    used, start, rows = dict.fromkeys(left, 0), 0, []
    while left:
        slots = schedule(exact_shares({s: weights[s] for s in left}), left)
        end = sum(map(len, slots.values()))
        for s, own in slots.items():
            if own:
                rows.append((s, used[s], used[s] + len(own), start, end, len(own), own))
            used[s] += len(own)
            left[s] -= len(own)
            if not left[s]:
                del left[s]
        start += end
    return rows


def slot_table(rows: list[tuple]) -> list[tuple]:
    """Rows (source, n, slots) of the phases' rows: the slots of blocks n CHUNK to (n + 1) CHUNK."""
    slots: dict[str, array] = {}
    for s, _, _, start, _, _, own in rows:
        slots.setdefault(s, array("q")).extend(start + t for t in own)
    return [(s, k // CHUNK, own[k : k + CHUNK].tolist()) for s, own in slots.items() for k in range(0, len(own), CHUNK)]


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    block: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, block, slot, place; reading by slot and place mixes.

    Each source is put in a fixed shuffled order and cut into blocks of ``block`` characters; a
    document belongs to the block in which it starts, and a block inside a long document holds none.
    Blocks get slots by ``schedule`` and ``phases``, from the weights as they are: while all sources
    last, each has had its weighted share of any first slots to within less than one block; once one is used up, the rest share its
    slots in proportion. All rows stay. ``place`` is the number of characters before the document in
    its block.

    ``weights`` gives positive target weights; a source without one gets the smallest of them, and
    None takes the shares of the characters to the power TEMPER. Sources are few: their names, sizes
    and schedule, a number for each block, are all that passes the driver.

    A null source is a source of its own, a null text empty. Repeated rows and ids keep their rows;
    their order among each other is open. With ``keep`` the columns of ``docs`` come as a struct
    ``row`` instead of doc_id and source. No rows give no rows.
    """
    size = F.greatest(F.length(whole_text(text_col)), F.lit(1)).cast("long")
    payload = F.struct(*docs.columns).alias("row") if keep else F.col(id_col).alias("doc_id")
    rows = docs.select(
        payload,
        F.col(source_col).alias("_source"),
        size.alias("_size"),
        F.xxhash64(F.col(id_col).cast("string"), whole_text(text_col)).alias("_key"),
    )
    totals = stage(rows.groupBy("_source").agg(F.sum("_size").alias("_size"), F.count("*").alias("_rows")))
    sizes = {row["_source"]: (row["_size"], row["_rows"]) for row in totals.collect()}
    bits = max(1, math.ceil(math.log2(max([n for _, n in sizes.values()], default=1) / STRETCH_ROWS + 1)))
    if weights is None:
        weights = {s: n**TEMPER for s, (n, _) in sizes.items()}
    least = min(weights.values(), default=1.0)
    weights = {s: weights.get(s, least) for s in sizes}
    table = slot_table(phases({s: -(-n // block) for s, (n, _) in sizes.items()}, weights))

    # characters before each document: by stretches of the order, then inside a stretch
    rows = rows.withColumn("_stretch", F.shiftrightunsigned("_key", 64 - bits))
    stretches = rows.groupBy("_source", "_stretch").agg(F.sum("_size").alias("_all"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    by_source = before(Window.partitionBy("_source").orderBy("_stretch"))
    bases = stage(
        stretches.select(
            F.col("_source").alias("_s"), F.col("_stretch").alias("_t"),
            F.coalesce(F.sum("_all").over(by_source), F.lit(0)).alias("_base"),
        )
    )
    inside = before(Window.partitionBy("_source", "_stretch").orderBy("_key"))
    placed = rows.withColumn("_inner", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_stretch") == F.col("_t"))
    at = F.col("_base") + F.col("_inner")
    blocks = placed.join(bases, same).select(
        *([F.col("row")] if keep else [F.col("doc_id")]),
        "_source",
        F.floor(at / block).cast("long").alias("block"),
        (at % block).alias("place"),
    )
    plan = docs.sparkSession.createDataFrame(table, "_s string, _chunk long, _slots array<long>")
    due = F.col("_source").eqNullSafe(F.col("_s")) & (F.floor(F.col("block") / CHUNK) == F.col("_chunk"))
    slot = F.get("_slots", (F.col("block") % CHUNK).cast("int"))
    scheduled = blocks.join(F.broadcast(plan), due)  # eight bytes a block
    head = ["row"] if keep else ["doc_id", F.col("_source").alias("source")]
    return scheduled.select(*head, "block", slot.alias("slot"), "place")


def mixed_rows(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in mixed order: ranges of slots by partition, sorted inside."""
    order = ["slot", "place"]
    return mix(docs, weights, block, keep=True).repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")
