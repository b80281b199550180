"""Filling fixed-capacity containers with texts, by vector best-fit over a histogram of sizes."""

from __future__ import annotations

from collections import defaultdict
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.session import stored

#: Items of one size that are numbered together, about; a more frequent size is numbered in as many salts as that takes.
NUMBERED = 20_000


def plan(histogram: dict[int, int], capacity: int, most_items: int, most_cost: int, rule: str = "norm") -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Containers as ``(first id, how many alike, [(size, items of it in each)])`` for ``histogram``, size -> number of items.

    Each item is a vector of tokens, one document and the attention cost (its tokens squared), as shares of the three
    capacities. The container at hand takes the largest item left, then again and again the item that fits under every
    constraint and leaves the smallest residual norm (``norm``) or has the largest dot product with the residual, weighted
    by what is still to be placed (``dot``). A finished container is repeated as often as the counts allow, so the work
    depends on the number of sizes, at most ``capacity`` + 1, and not on the number of items.
    """
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in sizes], np.int64)
    if len(sizes) and (sizes[-1] > capacity or sizes[-1] ** 2 > most_cost or most_items < 1):
        raise ValueError("an item exceeds the capacities")
    caps = np.array([capacity, most_items, most_cost], float)
    demand = np.stack([sizes, np.ones_like(sizes), sizes**2]).astype(float) / caps[:, None]
    made, first = [], 1
    while left.any():
        k = int(np.flatnonzero(left)[-1])
        used = np.zeros_like(left)
        room = np.ones(3)
        weights = (demand * left).sum(axis=1)
        weights = weights / max(weights.sum(), 1e-12)
        while k >= 0:
            used[k] += 1
            room = room - demand[:, k]
            fits = (left > used) & (demand <= room[:, None] + 1e-12).all(axis=0)
            if not fits.any():
                break
            rest = room[:, None] - demand
            score = -(weights[:, None] * rest**2).sum(axis=0) if rule == "norm" else (weights[:, None] * room[:, None] * demand).sum(axis=0)
            score[~fits] = -np.inf
            k = int(len(score) - 1 - np.argmax(score[::-1]))
        on = np.flatnonzero(used)
        times = int((left[on] // used[on]).min())
        made.append((first, times, [(int(sizes[i]), int(used[i])) for i in on]))
        left -= used * times
        first += times
    return made


def pieces(items: DataFrame, key: str, capacity: int) -> DataFrame:
    """``(key, part_no, token_start, n_tokens)``: an item larger than ``capacity`` is divided into full pieces and a rest, others stay whole."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    return items.select(key, "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("p")).select(
        key,
        (F.col("p") + 1).alias("part_no"),
        (F.col("p") * capacity).cast("int").alias("token_start"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("p") * capacity).cast("int").alias("n_tokens"),
    )


def pack(items: DataFrame, key: str, capacity: int = 2048, most_items: int = 1024, most_cost: int | None = None, rule: str = "norm") -> DataFrame:
    """``(key, part_no, token_start, n_tokens, container_id)``: every item of ``items(key, n_tokens)`` in a container.

    No container exceeds ``capacity`` tokens, ``most_items`` pieces or ``most_cost`` (the sum of squared tokens, by default
    what one full piece has; a lower one binds, and an item is divided if it exceeds it alone). Items of size 0 are placed like others. Repeated keys are items of their own; an empty table
    gives an empty one. Only the histogram of sizes, at most ``capacity`` + 1 numbers, comes to the driver; the items are
    numbered within their size over salts and look their container up in the plan.
    """
    most_cost = capacity**2 if most_cost is None else most_cost
    p = stored(pieces(items, key, min(capacity, isqrt(most_cost))), "pieces")
    p = p.withColumn("salt", F.pmod(F.xxhash64(key, "part_no"), F.lit(p.count() // NUMBERED + 1)).cast("int"))
    counts = p.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.n_tokens: r.n for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    ranks, starts = defaultdict(list), defaultdict(list)
    placed: dict[int, int] = defaultdict(int)
    for first, times, content in plan(histogram, capacity, most_items, most_cost, rule):
        for size, each in content:
            ranks[size].append(placed[size])
            starts[size].append((first, each))
            placed[size] += times * each
    lookup = {s: (np.array(ranks[s], np.int64), np.array(starts[s], np.int64)) for s in ranks}

    from pyspark.sql import Window

    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("n_tokens", "salt").orderBy(key, "part_no")
    ranked = p.withColumn("r", F.row_number().over(within)).join(offsets, ["n_tokens", "salt"])
    ranked = ranked.select(key, "part_no", "token_start", "n_tokens", (F.col("r") - 1 + F.col("before")).cast("bigint").alias("r"))

    def assign(batches):
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            found = np.empty(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                from_rank, content = lookup[int(s)]
                at = np.searchsorted(from_rank, rank[own], side="right") - 1
                found[own] = content[at, 0] + (rank[own] - from_rank[at]) // content[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found)], names=[key, "part_no", "token_start", "n_tokens", "container_id"])

    kind = dict(items.dtypes)[key]
    return ranked.mapInArrow(assign, f"`{key}` {kind}, part_no int, token_start int, n_tokens int, container_id bigint")


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, pieces, tokens, the least containers that could hold them, the unused share of the capacity, and
    the tokens, pieces and cost of the container that has most of each."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n_tokens").cast("bigint") ** 2).cast("bigint").alias("c"))
    total = F.coalesce(F.sum("t"), F.lit(0))
    n = F.count(F.lit(1))
    return per.agg(
        n.alias("containers"), F.coalesce(F.sum("k"), F.lit(0)).alias("pieces"), total.alias("tokens"), F.ceil(total / capacity).alias("least_containers"),
        F.round(F.when(n > 0, 1 - total / (n * capacity)), 6).alias("unused_share"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"),
        F.coalesce(F.max("k"), F.lit(0)).alias("most_pieces"), F.coalesce(F.max("c"), F.lit(0)).alias("highest_cost"),
    )
