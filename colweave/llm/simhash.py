"""Near duplicates: SimHash fingerprints, searched exactly with vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .text import whole_text

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints that a shard of the shared tree is to hold, and a leaf of the tree inside a shard.
SHARD = 4_096
LEAF = 256
#: The shared tree is laid out by at most about so many fingerprints; they only place its cuts.
SAMPLE = 65_536
#: Stands for a null id: the largest.
NO_ID = 2**63 - 1
#: Bits of every byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: str) -> int:
    """The 64-bit fingerprint: a bit is set where over half of the shingle hashes have it set."""
    import xxhash

    found = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    if len(found) < SHINGLE_WORDS:
        shingles, count = iter([b" ".join(found)]), 1
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(SHINGLE_WORDS)), strict=False))
        count = len(found) - SHINGLE_WORDS + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in shingles), np.uint64, count)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    flags = [np.bincount(columns[:, k], minlength=256) @ _BITS * 2 > count for k in range(8)]
    return int(np.packbits(np.concatenate(flags), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, form, fp) for the rows of ``docs``: a hash of the text, and its 64 bits as a number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.array([simhash(text) for text in batch["text"]], np.uint64)
            yield pd.DataFrame({"id": batch["id"], "form": batch["form"], "fp": bits.view(np.int64)})

    text = whole_text(text_col)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("form"), text.alias("text")
    )
    return rows.mapInPandas(run, "id long, form long, fp long")


def plan_cuts(sample: np.ndarray, depth: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete tree of ``depth`` levels, in heap order.

    Each node takes, of a few fingerprints, the one whose distances to the rest spread most, and
    cuts at their median.
    """
    draw = np.random.default_rng(seed)
    vantage = np.zeros(2**depth - 1, np.uint64)
    radius = np.zeros(2**depth - 1, np.int64)
    held = {0: sample}
    for node in range(2**depth - 1):
        own = held.pop(node)
        candidates = draw.choice(own, min(8, len(own))) if len(own) else draw.integers(0, 2**63, 1, np.uint64)
        probe = own if len(own) <= 1_024 else draw.choice(own, 1_024)
        spread = [np.bitwise_count(probe ^ c).std() if len(probe) else 0 for c in candidates]
        vantage[node] = candidates[int(np.argmax(spread))]
        distance = np.bitwise_count(own ^ vantage[node]).astype(np.int64)
        radius[node] = int(np.median(distance)) if len(own) else 32
        inside = distance <= radius[node]
        if 2 * node + 2 < 2**depth - 1:
            held[2 * node + 1], held[2 * node + 2] = own[inside], own[~inside]
    return vantage, radius


def visit(points: np.ndarray, vantage: np.ndarray, radius: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``points``, shard) for every shard that may hold a point within ``reach`` of the row.

    A branch is left out where the triangle inequality keeps all of it further away. With reach 0 it
    is the one shard that holds the point itself.
    """
    row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    for _ in range(int(math.log2(len(vantage) + 1))):
        distance = np.bitwise_count(points[row] ^ vantage[node]).astype(np.int64)
        inner = distance - reach <= radius[node]
        outer = distance + reach > radius[node]
        row = np.concatenate([row[inner], row[outer]])
        node = np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
    return row, node - len(vantage)


def close_pairs(members: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, member) with query < member and at most ``reach`` differing bits."""
    waiting = [(members, queries, 0)]
    while waiting:
        held, asked, stuck = waiting.pop()
        if not len(held) or not len(asked):
            continue
        if len(held) > LEAF and stuck < 3:
            draw = np.random.default_rng(len(held))
            candidates = draw.choice(held, 5)
            probe = draw.choice(held, 256)
            point = max(candidates, key=lambda c: np.bitwise_count(probe ^ c).std())
            near, far = np.bitwise_count(held ^ point).astype(int), np.bitwise_count(asked ^ point).astype(int)
            cut = int(np.median(near))
            cut -= int(near.max() == cut and near.min() < cut)
            parts = ((near <= cut, far - reach <= cut), (near > cut, far + reach > cut))
            for a, b in parts:
                waiting.append((held[a], asked[b], stuck + 1 if a.sum() > 0.9 * len(held) else 0))
            continue
        step = max(1, 2**20 // len(held))
        for k in range(0, len(asked), step):
            block = asked[k : k + step]
            hit = np.bitwise_count(block[:, None] ^ held[None, :]) <= reach
            q, m = np.nonzero(hit & (block[:, None] < held[None, :]))
            if len(q):
                yield block[q], held[m]


def spanning_links(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that join the same groups as all pairs do, fewer than there are points."""
    parent: dict[int, int] = {}
    links = []

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[rb] = ra
                links.append((a, b))
    return links


def near_links(distinct: DataFrame, reach: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that join the groups of near ones.

    A tree planned on a bounded sample cuts the fingerprints into shards, the more the more there
    are. Every fingerprint is kept in its own shard and asked in each shard that its ball of radius
    ``reach`` meets; a shard is searched exactly by a tree of its own. A pair shows up in the shard
    of its larger fingerprint, so none is missed at a boundary.
    """
    count = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, count) / SHARD)))
    every = max(1, count // SAMPLE)
    chosen = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp")
    sample = np.array([row["fp"] for row in chosen.collect()], np.int64).view(np.uint64)
    cuts = plan_cuts(np.sort(sample), depth)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy(np.int64).view(np.uint64)
            home = np.empty(len(points), np.int64)
            row, shard = visit(points, *cuts, 0)
            home[row] = shard
            row, shard = visit(points, *cuts, reach)
            yield pd.DataFrame(
                {"shard": shard, "fp": points[row].view(np.int64), "home": home[row] == shard}
            )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        points = group["fp"].to_numpy(np.int64).view(np.uint64)
        home = group["home"].to_numpy(bool)
        links = spanning_links(close_pairs(points[home], points, reach))
        return pd.DataFrame(np.array(links, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    dealt = distinct.select("fp").mapInPandas(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def components(nodes: DataFrame, links: DataFrame, by: str = "id") -> DataFrame:
    """Rows (fp, id): the smallest id of the group, for each fingerprint that has a link.

    With ``by`` "key" rows (fp, label), the fingerprint of that id.

    ``nodes`` holds (fp, id). The least (id, fp) spreads over the links, and each round also takes
    over the label of the fingerprint that a label names, so long chains shorten by half. Each round
    is written to the shared folder.
    """
    both = stage(links.union(links.select("b", "a")).toDF("fp", "other").distinct())
    ends = both.select("fp").distinct()
    start = nodes.join(ends, "fp", "left_semi").select("fp", F.struct("id", "fp").alias("label"))
    labels = stage(start)
    while True:
        heard = both.join(labels.select(F.col("fp").alias("other"), "label"), "other").select("fp", "label")
        least = labels.unionByName(heard).groupBy("fp").agg(F.min("label").alias("label"))
        spread = stage(least)
        named = spread.select(F.col("fp").alias("_at"), F.col("label").alias("_label"))
        jumped = stage(
            spread.join(named, F.col("label.fp") == F.col("_at")).select("fp", F.col("_label").alias("label"))
        )
        old = labels.select("fp", F.col("label").alias("_old"))
        changed = jumped.join(old, "fp").where(F.col("label") != F.col("_old"))
        labels = jumped
        if changed.isEmpty():
            return labels.select("fp", F.col("label.id").alias("id") if by == "id" else F.col("label.fp").alias("label"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    """Rows (id, form, fp, least): least is the smallest id of the component."""
    rows = stage(fingerprints(docs, id_col, text_col))
    nodes = stage(rows.groupBy("fp").agg(F.min("id").alias("id")))
    links = stage(near_links(nodes, reach))
    grouped = components(nodes, links).select("fp", F.col("id").alias("_other"))
    # staged: both sides of the join are then plain exchanges, whose hot keys can be split
    named = stage(nodes.join(grouped, "fp", "left").select("fp", F.coalesce("_other", "id").alias("least")))
    return rows.join(named, "fp")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = RADIUS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    Fingerprints link where at most ``reach`` of 64 bits differ; a component is what links reach,
    and its id the smallest id in it. The search is exact: every pair of distinct fingerprints within
    reach is found, and rows that share a fingerprint need no search. A text without words, a null
    one too, has fingerprint zero and is linked like any other. Null ids count as largest; a
    component of null ids has a null id. Rows that share an id stay. Other columns are not read. No
    rows give no rows.
    """
    known = lambda name: F.when(F.col(name) != NO_ID, F.col(name))
    return _grouped(docs, id_col, text_col, reach).select(
        known("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        known("least").alias("component_id"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = RADIUS
) -> DataFrame:
    """The rows of ``docs``, of each component the one with the smallest id.

    Where several rows have that id, one stays. The columns of ``docs`` are kept.
    """
    first = (
        _grouped(docs, id_col, text_col, reach)
        .groupBy("least", "fp")  # the fingerprint spreads a hot component over tasks first
        .agg(F.min(F.struct("id", "form")).alias("_first"))
        .groupBy("least")
        .agg(F.min("_first").alias("_first"))
        .select(F.col("_first.id").alias("_id"), F.col("_first.form").alias("_form"))
    )
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(whole_text(text_col)).alias("_form"),
    )
    return keyed.join(first, ["_id", "_form"], "left_semi").dropDuplicates(["_id", "_form"]).select("_row.*")
