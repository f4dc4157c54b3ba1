"""Filling containers of a few permitted capacities with items of varying size.

Variable-capacity best fit, decreasing: items are taken from the largest to the smallest; each goes to the open
container that it fills best.  Where none has room a container is opened, and its capacity is the one that costs least
for a unit of size it can come to hold: the item, and of the room beside it as much as the items still to come can
fill.  So all permitted lengths are chosen from jointly, item by item, against the mix of sizes that is left; at last
each container shrinks to the smallest capacity that holds its contents.  A container of n tokens costs
``OVERHEAD + n + n * n / SQUARE``: a model's work on a sequence grows with its length and, by attention, with the
length squared.

An item is divided only if it alone exceeds the largest capacity: into full containers and one remainder.

Scale: only (id, size) moves. Items are spread at random over groups of about ``GROUP`` items that are packed
independently; each group leaves at most a few containers unfilled, so the loss does not grow with the data, and no
group depends on one key.  Best fit is found in a bit set over the remaining room, so an item costs O(1).

Defined results of odd input: items of size zero or null size get no container; equal items are told apart by id and
part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.runtime import cut

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
SQUARE = 16_384  # length at which attention costs as much as everything else
GROUP = 20_000


def cost_of(capacity: int, overhead: float = OVERHEAD, square: float = SQUARE) -> float:
    return overhead + capacity + capacity * capacity / square


def _openings(sizes: list[int], caps: list[int], overhead: float, square: float) -> Callable[[int, int], int]:
    """The capacity to open for an item of size s when items of ``left`` in all, this one included, are not placed yet.

    Items no larger than the room beside it are all still to come where the room is smaller than the item.
    """
    upto = [0] * (caps[-1] + 2)  # total size of the items of at most that size
    for s in sizes:
        upto[s] += s
    for s in range(1, len(upto)):
        upto[s] += upto[s - 1]
    costs = {c: cost_of(c, overhead, square) for c in caps}

    def opened(s: int, left: int) -> int:
        def each(c: int) -> float:
            room = c - s
            return costs[c] / (s + min(room, upto[room] if room < s else left - s))

        return min((c for c in caps if c >= s), key=lambda c: (each(c), c))

    return opened


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, square: float = SQUARE) -> tuple[list[int], list[int]]:
    """Container of each item and capacity of each container; ``sizes`` from the largest to the smallest.

    What small items are left for one container may be taken by another, so the rule is tried with each of the
    smallest capacities left out in turn, and the cheapest result is kept.
    """
    caps = sorted(capacities)
    tries = (_pack(sizes, caps, least, overhead, square) for least in caps)
    return min(tries, key=lambda x: sum(cost_of(c, overhead, square) for c in x[1]))


def _pack(sizes: list[int], caps: list[int], least: int, overhead: float, square: float) -> tuple[list[int], list[int]]:
    opened = _openings(sizes, [c for c in caps if c >= least], overhead, square)
    room: dict[int, list[int]] = {}
    mask, left = 0, sum(sizes)
    where, used = [], []
    for s in sizes:
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            stack = room[r]
            k = stack.pop()
            if not stack:
                mask ^= 1 << r
        else:
            k, r = len(used), opened(s, left)
            used.append(0)
        used[k] += s
        left -= s
        where.append(k)
        if r > s:
            room.setdefault(r - s, []).append(k)
            mask |= 1 << (r - s)
    smallest = iter(caps)
    final_of, c = [0] * (caps[-1] + 1), next(smallest)
    for u in range(len(final_of)):
        if u > c:
            c = next(smallest)
        final_of[u] = c
    return where, [final_of[u] for u in used]


def pack_items(items: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, square: float = SQUARE) -> DataFrame:
    """(id, part, size, container, capacity) of items (id, size); ``part`` counts the pieces of a divided item from 0."""
    largest = max(capacities)
    sized = items.where("size > 0")
    parts = cut(
        sized.select("id", "size", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((size - 1) div {largest} AS INT)"))).alias("part")).select(
            "id", "part", F.least(F.lit(largest), F.col("size") - F.col("part").cast("long") * largest).cast("int").alias("size")
        )
    )
    groups = max(1, -(-parts.count() // GROUP))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = None
        for b in _whole(batches):
            from pyspark import TaskContext

            task = TaskContext.get().partitionId() if task is None else task
            b = b.sort_values(["size", "id", "part"], ascending=[False, True, True], kind="stable")
            where, final = pack(b["size"].tolist(), capacities, overhead, square)
            b["container"] = [(task << 32) + k for k in where]
            b["capacity"] = [final[k] for k in where]
            yield b

    kind = parts.schema["id"].dataType.simpleString()
    return parts.repartition(groups, F.xxhash64("id", "part")).mapInPandas(run, f"id {kind}, part int, size int, container long, capacity int")


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches of a task, about ``GROUP`` small rows, as one frame."""
    frames = [b for b in batches if len(b)]
    if frames:
        yield pd.concat(frames, ignore_index=True)
