"""The trie of shared conversation prefixes, by fingerprints that multiply.

The fingerprint of a sequence of turns x1 … xn is its length n and the value x1·B + x2·B² + … + xn·Bⁿ
modulo a prime, in four lanes of 31 bits. Sequences multiply by (u, m)·(v, n) = (u + Bᵐ·v, m + n), so the
value of any stretch of a conversation follows from two running sums, and a rebuilt conversation, a
head of one and a rest of another, gets the fingerprints of all its prefixes from theirs: no rebuilt
text is made, joined or hashed. A turn enters by two 64-bit hashes and is known by them from there on.

That equal fingerprints are equal prefixes is checked, not assumed. Prefixes of one fingerprint must
have one fingerprint before their last turn and refer to the same stored turn, by both hashes; and
stored turns of the same hashes must have the same role and text. By induction along the prefix the
groups are then exact. Where a check fails, everything is drawn anew with other bases and other hashes.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import MARK, PLACE_BITS, lay_out
from ..sources.staging import stage
from .text import whole_text

#: The largest head that a rebuilt conversation takes over, and how many ids share a base.
HEADS = 8
FAMILY = 5
#: Ids of a piece of a list of ids, in a power of two.
PIECE_BITS = 12
KEY = ["depth", "fa", "fb"]
LANES = range(4)


class Draw(NamedTuple):
    """What the fingerprints of one attempt are made of."""

    primes: tuple[int, ...]
    bases: tuple[int, ...]
    salt: int

    @staticmethod
    def of(attempt: int) -> Draw:
        # fixed values: the four largest primes below 2^31
        primes = (2147483647, 2147483629, 2147483587, 2147483579)
        draw = random.Random(attempt)
        return Draw(primes, tuple(draw.randrange(1 << 20, p - 1) for p in primes), attempt)

    def power(self, lane: int, exponent: Column) -> Column:
        """base ^ exponent modulo the prime, by tables of 64 for each six bits of the exponent."""
        p, value = self.primes[lane], F.lit(1).cast("long")
        for k in range(6):
            step = pow(self.bases[lane], 64**k, p)
            table = F.expr("array(" + ",".join(f"{pow(step, e, p)}L" for e in range(64)) + ")")
            digit = F.shiftright(exponent, 6 * k).bitwiseAND(F.lit(63)).cast("int")
            value = value * F.get(table, digit) % p
        return value

    def back(self, lane: int, exponent: Column) -> Column:
        """base ^ -exponent for an exponent up to ``HEADS``."""
        p = self.primes[lane]
        inverse = pow(self.bases[lane], -1, p)
        table = F.expr("array(" + ",".join(f"{pow(inverse, e, p)}L" for e in range(HEADS + 1)) + ")")
        return F.get(table, exponent.cast("int"))


def running(laid: DataFrame, group: str, values: dict[str, Column]) -> DataFrame:
    """``laid`` with the sums of ``values`` over the rows of its group up to and with each row.

    ``laid`` was written by ``stage(lay_out(rows, group, …))``. Sums are taken inside each partition of
    that layout; what earlier partitions hold of a group is added to its rest. A partition goes on
    with at most one group of an earlier one, so that table has at most a row per partition and is
    broadcast. No group, however large, meets in one task.
    """
    part = F.shiftright(F.col(MARK), PLACE_BITS).alias("_part")
    own = {f"_own_{name}": value for name, value in values.items()}
    rows = laid.select("*", part, *(value.alias(name) for name, value in own.items()))
    totals = rows.groupBy(group, "_part").agg(*(F.sum(name).alias(f"_sum{name}") for name in own))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col(group).alias("_of"),
        F.col("_part").alias("_at"),
        *(F.sum(f"_sum{name}").over(earlier).alias(f"_before{name}") for name in own),
        F.row_number().over(Window.partitionBy(group).orderBy("_part")).alias("_nth"),
    ).where("_nth > 1")
    here = Window.partitionBy(group, "_part").orderBy(MARK).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *(F.sum(name).over(here).alias(f"_here{name}") for name in own))
    met = local.join(F.broadcast(carried), (F.col(group) == F.col("_of")) & (F.col("_part") == F.col("_at")), "left")
    sums = [
        (F.coalesce(F.col(f"_before_own_{name}"), F.lit(0)) + F.col(f"_here_own_{name}")).alias(name) for name in values
    ]
    return met.select(*laid.columns, *sums)


class Turns(NamedTuple):
    conv: str = "conv_id"
    turn: str = "turn"
    role: str = "role"
    text: str = "text"


def stored_turns(conversations: DataFrame, names: Turns, salt: int) -> DataFrame:
    """Rows (c, turn, role, text, h1, h2): the turns that belong to a conversation, and their hashes."""
    rows = conversations.select(
        F.col(names.conv).cast("long").alias("c"),
        F.col(names.turn).alias("turn"),
        whole_text(names.role).alias("role"),
        whole_text(names.text).alias("text"),
    ).where(F.col("c").isNotNull())
    return rows.withColumns(
        {"h1": F.xxhash64(F.lit(2 * salt), "role", "text"), "h2": F.xxhash64(F.lit(2 * salt + 1), "text", "role")}
    )


def turn_sums(turns: DataFrame, draw: Draw) -> DataFrame:
    """Rows (c, pos, h1, h2, size, s0 … s3, b0 … b3): running values with a turn and before it."""
    light = turns.select("c", "turn", F.xxhash64("role", "text").alias("tie"), "h1", "h2", F.octet_length("text").alias("size"))
    laid = stage(lay_out(light, "c", "turn", "tie").drop("turn", "tie"))
    placed = running(laid, "c", {"pos": F.lit(1).cast("long")})
    low = F.lit((1 << 31) - 1)
    letters = [F.shiftrightunsigned("h1", 33), F.col("h1").bitwiseAND(low), F.shiftrightunsigned("h2", 33), F.col("h2").bitwiseAND(low)]
    terms = stage(
        placed.select(
            "*",
            *(
                (((letters[k] + 1) % draw.primes[k]) * draw.power(k, F.col("pos")) % draw.primes[k]).alias(f"t{k}")
                for k in LANES
            ),
        )
    )
    summed = running(terms, "c", {f"v{k}": F.col(f"t{k}") for k in LANES})
    return summed.select(
        "c",
        "pos",
        "h1",
        "h2",
        "size",
        *((F.col(f"v{k}") % draw.primes[k]).alias(f"s{k}") for k in LANES),
        *(((F.col(f"v{k}") - F.col(f"t{k}")) % draw.primes[k]).alias(f"b{k}") for k in LANES),
    )


def head_length(c: Column) -> Column:
    """How many turns the conversation ``c`` takes over from its base."""
    return F.crc32(c.cast("string").cast("binary")) % (HEADS + 1)


def rebuilt(sums: DataFrame) -> DataFrame:
    """Rows (c, h, head, hb, length, o0 … o3): the turns taken over, and the own value at the cut.

    ``head`` holds at most ``HEADS`` turns of the base conversation, by their running values.
    """
    h = head_length(F.col("c"))
    turn = F.struct("pos", "h1", "h2", "size", *(f"s{k}" for k in LANES), *(f"b{k}" for k in LANES))
    base = F.col("c") % FAMILY == 0
    convs = stage(
        sums.groupBy("c").agg(
            F.max("pos").alias("n"),
            # at most HEADS of them in a conversation
            F.array_sort(F.collect_list(F.when(base & (F.col("pos") <= HEADS), turn))).alias("first"),
            *(F.coalesce(F.max(F.when(F.col("pos") == h, F.col(f"s{k}"))), F.lit(0)).alias(f"o{k}") for k in LANES),
        )
    )
    bases = convs.where(base).select(F.col("c").alias("b"), F.col("first").alias("taken"))
    own = convs.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("b"), *(f"o{k}" for k in LANES))
    met = own.join(bases, "b", "left")
    head = F.filter("taken", lambda x: x["pos"] <= F.col("h"))  # null without a base
    named = met.select("c", "h", "n", head.alias("head"), *(f"o{k}" for k in LANES))
    hb = F.when(F.col("head").isNull(), 0).otherwise(F.size("head")).cast("long")
    return named.select("*", hb.alias("hb"), (hb + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def members(sums: DataFrame, convs: DataFrame, draw: Draw) -> DataFrame:
    """Rows (c, depth, fa, fb, pa, pb, h1, h2, size, last): every prefix but the root of every rebuilt
    conversation: its fingerprint, that before its last turn, and that turn."""
    both = lambda v: ((v[0] * (1 << 31) + v[1]), (v[2] * (1 << 31) + v[3]))

    def row(depth: Column, after: list[Column], before: list[Column], turn: Callable[[str], Column]) -> list[Column]:
        (fa, fb), (pa, pb) = both(after), both(before)
        return [
            F.col("c"),
            depth.alias("depth"),
            *(v.alias(name) for v, name in zip((fa, fb, pa, pb), ("fa", "fb", "pa", "pb"), strict=True)),
            *(turn(name).alias(name) for name in ("h1", "h2", "size")),
            (depth == F.col("length")).alias("last"),
        ]

    of = lambda name: F.col(f"t.{name}")
    heads = convs.select("c", "length", F.explode("head").alias("t")).select(
        row(of("pos"), [of(f"s{k}") for k in LANES], [of(f"b{k}") for k in LANES], of)
    )
    cut = convs.where(F.col("n") > F.col("h")).select(
        F.col("c"),
        "h",
        "hb",
        "length",
        *(F.col(f"o{k}") for k in LANES),
        *(F.coalesce(F.get("head", F.col("hb").cast("int") - 1)[f"s{k}"], F.lit(0)).alias(f"u{k}") for k in LANES),
    )
    rest = sums.where(F.col("pos") > head_length(F.col("c"))).join(cut, "c")

    def moved(k: int, name: str) -> Column:
        p = draw.primes[k]
        stretch = (F.col(f"{name}{k}") - F.col(f"o{k}") + p) % p
        return (F.col(f"u{k}") + stretch * draw.back(k, F.col("h") - F.col("hb"))) % p

    depth = F.col("hb") + F.col("pos") - F.col("h")
    rests = rest.select(row(depth, [moved(k, "s") for k in LANES], [moved(k, "b") for k in LANES], F.col))
    return heads.unionByName(rests)


def _nodes(member: DataFrame) -> DataFrame:
    """A row per group of one fingerprint, with the least and greatest of what must be one value."""
    checked = ("pa", "pb", "h1", "h2")
    grouped = member.groupBy(*KEY).agg(
        F.min("c").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("size").alias("size"),
        *(F.min(name).alias(name) for name in checked),
        *(F.max(name).alias(f"_max_{name}") for name in checked),
    )
    differ = F.lit(False)
    for name in checked:
        differ = differ | (F.col(name) != F.col(f"_max_{name}"))
    return grouped.select(*KEY, "conv_id", "n_convs", "size", "pa", "pb", differ.alias("mixed"))


def _same_hashes(turns: DataFrame) -> DataFrame:
    """The hashes that stored turns of different role or text share: none, as a rule."""
    texts = turns.groupBy("h1", "h2", "role", "text").agg(F.lit(1).alias("one"))
    return texts.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")


def _id_hashes(ends: DataFrame) -> DataFrame:
    """Rows (depth, fa, fb, ends_sha256) of the ids ``c`` of each node in numeric order.

    Ids are laid out in order over all tasks and joined there to pieces of bounded length; the pieces of
    a node then go through one running hash, which holds none of them.
    """
    laid = stage(lay_out(ends, *KEY, "c"))
    pieces = laid.groupBy(*KEY, F.shiftright(F.col(MARK), PIECE_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for batch in batches:
            done = []
            for *own, ids in zip(*(batch[name].tolist() for name in KEY), batch["ids"], strict=True):
                if own == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256()
                digest.update(ids.encode())
            yield pd.DataFrame(done, columns=columns)
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=columns)

    columns = [*KEY, "ends_sha256"]
    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").drop("piece")
    return ordered.mapInPandas(run, "depth long, fa long, fb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, names: Turns = Turns(), draws: Callable[[int], Draw] = Draw.of) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    A conversation c is rebuilt from the first h turns of conversation c - c % 5, all if it has fewer,
    none if there is no such conversation, and its own turns after its first h; h is crc32 of c in
    decimal, modulo 9. A node is a distinct sequence of first turns, and the root the empty one.
    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256:
    the smallest member, that of the parent (null for the root), members, children, childless nodes
    of the subtree, the sum over the subtree of (members - 1) times the bytes of the last text, and
    the hash of the ids of the members that end there.

    Turns are ordered by ``turn``, null first; those that share it in a conversation by a hash of role and
    text. Rows that are repeated are turns of their own. A null role or text is empty. Rows without
    a conversation id belong to no conversation and are left out; a conversation that keeps no turn is
    a member of the root alone. Other columns are not read. No rows give no rows.
    """
    spark = conversations.sparkSession
    for attempt in count():
        draw = draws(attempt)
        turns = stored_turns(conversations, names, draw.salt)
        if not _same_hashes(turns).isEmpty():
            continue
        sums = stage(turn_sums(turns, draw))
        convs = stage(rebuilt(sums))
        member = stage(members(sums, convs, draw))
        nodes = stage(_nodes(member))
        if nodes.where("mixed").isEmpty():
            break

    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(
        F.count("*").alias("n_children")
    )
    weighed = stage(
        nodes.join(children, KEY, "left").select(
            *KEY,
            "pa",
            "pb",
            "conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("size")).alias("weight"),
        )
    )
    # A node counts for its smallest member, which is a member of all nodes above: what the members
    # of a node count, less what its own smallest member counts above it, is its subtree.
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    counted = stage(weighed.groupBy(F.col("conv_id").alias("c")).agg(F.sum("weight").alias("weights"), F.sum(leaf).alias("leaves")))
    below = member.select("c", *KEY).join(counted, "c").groupBy(*KEY).agg(
        F.sum("weights").alias("weights"), F.sum("leaves").alias("n_leaves")
    )
    laid = stage(lay_out(weighed, "conv_id", "depth"))
    upto = running(laid, "conv_id", {"upto": F.col("weight")})
    nowhere = F.lit(0).cast("long")
    ends = member.where("last").select(*KEY, "c").unionByName(
        convs.where("length = 0").select(*(nowhere.alias(name) for name in KEY), "c")
    )
    hashes = stage(_id_hashes(ends))
    total = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).first()
    sums_of = weighed.agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.sum(leaf).alias("leaves"), F.sum((F.col("depth") == 1).cast("long")).alias("first")
    ).first()
    at_root = hashes.where("depth = 0").select("ends_sha256").first()
    nothing = hashlib.sha256(b"").hexdigest()
    root = (
        total["conv_id"],
        0,
        None,
        total["n_convs"],
        sums_of["first"] or 0,
        sums_of["leaves"] or 1,
        sums_of["weight"],
        at_root[0] if at_root else nothing,
    )
    schema = (
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string"
    )
    top = spark.createDataFrame([root] if total["n_convs"] else [], schema)
    # staged: both sides of the join with the parents are plain exchanges, whose hot keys can be split
    known = stage(upto.join(below, KEY).join(hashes, KEY, "left"))
    parents = weighed.select(
        (F.col("depth") + 1).alias("depth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("conv_id").alias("parent")
    )
    at_top = F.col("depth") == 1
    named = known.where(~at_top).join(parents, ["depth", "pa", "pb"]).unionByName(
        known.where(at_top).withColumn("parent", F.lit(total["conv_id"]).cast("long"))
    )
    return top.unionByName(
        named.select(
            "conv_id",
            F.col("depth").cast("long").alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            F.col("n_leaves").cast("long").alias("n_leaves"),
            (F.col("weights") - F.col("upto") + F.col("weight")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )
