"""Items packed into containers of a fixed capacity (problem 8).

Only the histogram of sizes, at most `capacity` numbers, comes to the driver. There the configuration linear program (how
often to use each way of filling a container) is solved approximately by multiplicative weights: sizes that a knapsack
dynamic program's fills cover too often lose weight, the others gain, and the weights of the greatest lower bound are the
prices of the program. The rounding takes one fill after the other at these prices, each for a whole number of
containers, and prices the next one on what is left; weights of the same kind keep the sizes in step. The last items,
one part in a hundred, are packed by best fit. The plan is a table of runs by size, and every item finds its container
from its rank among the items of its size, which is computed with salts, so that a size held by a third of all items is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import broadcast_if_small, cut

#: Rounds that price the program, fills that the rounding should need, and items of one size in a salt's task.
ROUNDS, FILLS, SALT_ROWS = 48, 500, 500_000
#: What a unit of room counts beside being in step, how much more a large size counts, and the step of the weights.
ROOM, LARGE, STEP = 100.0, 1000.0, 4.0
#: Dearest sizes, which a round prices before all of them, and the part of the room that best fit packs at the end.
PRICED, REST = 64, 0.01


def _split(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(index, copies) bundles by powers of two: any allowed number of each size is a set of bundles."""
    out = []
    for i, (s, n) in enumerate(zip(sizes.tolist(), counts.tolist())):
        left, k = min(n, capacity // s), 1
        while left > 0:
            out.append((i, min(k, left)))
            left -= k
            k *= 2
    return out


def knapsack(sizes: np.ndarray, counts: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size (at most counts) of the greatest worth that fit the capacity."""
    bundles = _split(sizes, counts, capacity)
    best = np.zeros(capacity + 1)
    took = np.zeros((len(bundles), capacity + 1), dtype=bool)
    for b, (i, k) in enumerate(bundles):
        w = int(sizes[i]) * k
        more = best[: capacity + 1 - w] + worth[i] * k
        took[b, w:] = more > best[w:]
        best[w:] = np.maximum(best[w:], more)
    out, room = np.zeros(len(sizes), dtype=np.int64), capacity
    for b in range(len(bundles) - 1, -1, -1):
        if took[b, room]:
            i, k = bundles[b]
            out[i] += k
            room -= int(sizes[i]) * k
    return out


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing over the histogram: equal containers are one group, so the work follows the number of sizes."""
    groups: dict[bytes, int] = {}
    fills: dict[bytes, tuple[np.ndarray, int]] = {}
    by_room: dict[int, set[bytes]] = {}

    def put(fill: np.ndarray, room: int, n: int) -> None:
        key = fill.tobytes()
        groups[key] = groups.get(key, 0) + n
        fills[key] = (fill, room)
        by_room.setdefault(room, set()).add(key)

    for i in range(len(sizes) - 1, -1, -1):
        n, s = int(left[i]), int(sizes[i])
        while n > 0:
            room = min((r for r, own in by_room.items() if r >= s and own), default=None)
            if room is None:
                per = min(capacity // s, n)
                fill = np.zeros(len(sizes), dtype=np.int64)
                fill[i] = per
                put(fill, capacity - per * s, n // per)
                n -= per * (n // per)
                continue
            key = min(by_room[room])
            fill, _ = fills[key]
            per = min(room // s, n)
            many = min(groups[key], n // per)
            groups[key] -= many
            if not groups[key]:
                by_room[room].discard(key)
                del groups[key]
            more = fill.copy()
            more[i] += per
            put(more, room - per * s, many)
            n -= per * many
    return [(fills[k][0], n) for k, n in sorted(groups.items()) if n]


def _classes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sizes of about one part of the capacity (six classes an octave), numbered from 0: the weights are kept by class, so
    that they mean something where most sizes stand for one item."""
    return np.unique(np.floor(6 * np.log2(capacity / sizes)).astype(np.int64), return_inverse=True)[1]


def prices(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """(least number of containers, price of an item of each size) by multiplicative weights on the configuration program.

    Any prices prove that at least their sum over all items / the worth of the best fill containers are needed. Room as
    the price is the start; each round the classes that the best fill holds too much of lose weight. The greatest bound
    wins; room stays the price unless another is a thousandth better.
    """
    of = _classes(sizes, capacity)
    volume = np.bincount(of, (sizes * counts).astype(float))
    least = volume.sum() / capacity
    bound, best = least * (1 + 1e-3), sizes / capacity
    log_weight = np.zeros(len(volume))
    for _ in range(rounds):
        price = sizes / capacity * np.exp(log_weight)[of]
        fill = knapsack(sizes, counts, price, capacity)
        worth = float(price @ fill)
        if price @ counts > bound * worth:
            bound, best, least = float(price @ counts) / worth, price / worth, float(price @ counts) / worth
        log_weight -= 6.0 / rounds * (np.bincount(of, (fill * sizes).astype(float), minlength=len(volume)) * least / volume - 1)
        log_weight = np.clip(log_weight - log_weight.mean(), -6, 6)
    return max(1.0, least), best


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """(copies of each size, how many containers) for all items; sizes rise, 1 to capacity."""
    sizes, counts = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    if not len(sizes):
        return []
    out, left = programmed(sizes, counts, capacity, rounds)
    return out + best_fit(sizes, left, capacity)


def programmed(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """(fills with their numbers of containers, what is left of each size): the program rounded fill by fill.

    A size is worth its price in the program, a little more if its class is behind the share of containers that are full,
    and a large size more than small ones of the same room, as those close gaps later. A fill is used a part of FILLS times
    or as often as its items last. The work follows the number of sizes, not that of the items.
    """
    least, price = prices(sizes, counts, capacity, rounds)
    of = _classes(sizes, capacity)
    volume = np.bincount(of, (sizes * counts).astype(float))
    most, share = max(1.0, least / FILLS), sizes / capacity
    out, used, left = [], 0, counts.copy()
    while (left * sizes).sum() > REST * volume.sum():
        behind = used / least - 1 + np.bincount(of, (left * sizes).astype(float), minlength=len(volume)) / volume
        worth = ROOM * price + share * (np.exp(STEP * np.clip(behind, -2, 2))[of] + LARGE * share)
        rest = np.flatnonzero(left)
        fill = np.zeros_like(left)
        for own in (rest[np.sort(np.lexsort((-left[rest] / counts[rest], -worth[rest] / sizes[rest]))[:PRICED])], rest):
            fill[:] = 0
            fill[own] = knapsack(sizes[own], left[own], worth[own], capacity)
            if len(own) == len(rest) or fill @ sizes == capacity:
                break  # no other fill leaves less room
        n = int(min(most, (left[fill > 0] // fill[fill > 0]).min()))
        out.append((fill, n))
        left = left - fill * n
        used += n
    return out, left


def pack(items: DataFrame, item_id: str, size: str, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """(container_id, item_id, piece, start, size): every item in one container, none above capacity.

    An item larger than the capacity is cut into pieces of the capacity, numbered from 0, and a rest; only such items are
    cut. Items of no size (0, null) take no room and are spread over the containers; without any container theirs is
    null. Repeated rows are items of their own; an empty table gives an empty one.
    """
    whole = items.select(F.col(item_id).alias("item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    last = F.when(F.col("n") > 0, F.floor((F.col("n") - 1) / capacity)).otherwise(0)
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).select(
        "item", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("size")
    )
    pieces = cut(pieces)
    hist = pieces.where("size > 0").groupBy("size").count().orderBy("size").toPandas()  # at most `capacity` rows
    sizes, counts = hist["size"].to_numpy(np.int64), hist["count"].to_numpy(np.int64)
    fills = plan(sizes, counts, capacity, rounds)
    runs, base, used = [], 0, np.zeros(len(sizes), dtype=np.int64)
    for fill, n in fills:
        on = np.flatnonzero(fill)
        runs.append(np.stack([on, used[on], np.full(len(on), base), fill[on]], axis=1))
        used[on] += fill[on] * n
        base += n
    every = np.concatenate(runs) if runs else np.empty((0, 4), dtype=np.int64)
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    ends = np.searchsorted(every[:, 0], np.arange(len(sizes) + 1))
    table = {int(s): tuple(every[lo:hi, 1:].T) for s, lo, hi in zip(sizes, ends[:-1], ends[1:])}
    shared = items.sparkSession.sparkContext.broadcast(table)

    salts = items.sparkSession.createDataFrame([(int(s), int(-(-c // SALT_ROWS))) for s, c in zip(sizes, counts)], "size long, salts int")
    salted = pieces.where("size > 0").join(F.broadcast(salts), "size").withColumn("salt", F.pmod(F.xxhash64("item", "piece"), F.col("salts")))
    order = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("size", "salt").agg(F.count("*").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(order), F.lit(0)))
    before = broadcast_if_small(cut(before.select("size", "salt", "before")), 24)
    within = F.row_number().over(Window.partitionBy("size", "salt").orderBy("item", "piece")) - 1
    ranked = salted.withColumn("within", within).join(before, ["size", "salt"]).withColumn("rank", F.col("before") + F.col("within"))

    @F.pandas_udf("long")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        out, runs = np.zeros(len(size), dtype=np.int64), shared.value
        s, r = size.to_numpy(), rank.to_numpy()
        for v in np.unique(s):
            own = np.flatnonzero(s == v)
            start, first, per = runs[int(v)]
            at = np.searchsorted(start, r[own], side="right") - 1
            out[own] = first[at] + (r[own] - start[at]) // per[at]
        return pd.Series(out)

    packed = ranked.select(container("size", "rank").alias("container_id"), "item", "piece", "start", "size")
    nothing = F.pmod(F.xxhash64("item"), F.lit(base)) if base else F.lit(None).cast("long")
    empty = pieces.where("size = 0").select(nothing.alias("container_id"), "item", "piece", "start", "size")
    return packed.unionByName(empty).withColumnRenamed("item", item_id)
