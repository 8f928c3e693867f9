"""Exact k nearest neighbours by Voronoi cells.

The plan follows the pivot-based join of Lu, Shen, Chen and Ooi (VLDB 2012): a bounded set of pivots splits
the points into cells; the smallest distances in each cell bound every point's k-th neighbour from above;
a cell is visited only if the triangle inequality cannot rule it out. The number of pivots follows that of the
points, so a cell holds about ``CELL_POINTS``; cells and their visitors that are larger than a block are cut, so a crowded
cell becomes many tasks, and a task emits k rows per visitor, never all pairs. Inside a block the points are in a ball tree,
which all visitors of the block descend together: a visitor leaves a ball whose nearest possible point is farther than the
k-th neighbour it has so far, starting from the bound it came with. Equal points are collapsed first and keep their count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tabsight.functions.columns import md5_order
from tabsight.session import pin

#: Points of a cell, by which the number of pivots is chosen within these bounds (they are broadcast).
CELL_POINTS = 256
LEAST_PIVOTS, MOST_PIVOTS = 256, 4096
#: Numbers in all pivots together, and in the sample they are chosen from.
PIVOT_NUMBERS, SAMPLE_NUMBERS = 1 << 21, 1 << 22
BLOCK = 2048
#: Points in a leaf of a ball tree; visitors whose bounds are worked out at once.
LEAF, CHUNK = 48, 512
#: Numbers of a matrix that a task holds at once; more pivots or wider points only cut it into more pieces.
HELD_NUMBERS = 1 << 21
#: Relative room for rounding wherever a bound decides.
ROOM = 1e-9


@dataclass
class Ball:
    """The points ``order[lo:hi]`` of a tree, all within ``radius`` of ``centre``."""

    lo: int
    hi: int
    centre: np.ndarray
    radius: float
    parts: tuple[Ball, ...] = ()


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Ball, np.ndarray]:
    """The root and the order of the points: halves by the median of the coordinate that varies most."""
    order = np.arange(len(points))

    def ball(lo: int, hi: int) -> Ball:
        own = points[order[lo:hi]]
        centre = own.mean(axis=0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        if hi - lo <= leaf or radius == 0:
            return Ball(lo, hi, centre, radius)
        half = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(own[:, own.var(axis=0).argmax()], half)]
        return Ball(lo, hi, centre, radius, (ball(lo, lo + half), ball(lo + half, hi)))

    return ball(0, len(points)), order


def near_pairs(x: np.ndarray, bound: np.ndarray, points: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(visitor, point, distance): for each row of ``x`` the points that can be among its ``k`` nearest, within ``bound``.

    ``own`` is the place of a visitor's own point if that must not count, else -1. Ties at the k-th distance are all there.
    """
    root, order = ball_tree(points)
    sorted_points = points[order]
    squares = (sorted_points**2).sum(axis=1)
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    own = np.where(own >= 0, place[own], -1)
    limit = bound * (1 + ROOM)
    top = np.full((len(x), k), np.inf)
    found: list[tuple[np.ndarray, ...]] = []

    def scan(ball: Ball, who: np.ndarray) -> None:
        b = sorted_points[ball.lo : ball.hi]
        rough = (x[who] ** 2).sum(axis=1)[:, None] + squares[None, ball.lo : ball.hi]
        room = ROOM * rough
        rough = np.maximum(rough - 2 * (x[who] @ b.T), 0)
        mine = own[who] - ball.lo
        inside = np.flatnonzero((mine >= 0) & (mine < len(b)))
        rough[inside, mine[inside]] = np.inf
        best = np.partition(np.concatenate([top[who], np.sqrt(rough + room)], axis=1), k - 1, axis=1)[:, :k]
        top[who] = best
        limit[who] = np.minimum(limit[who], best.max(axis=1) * (1 + ROOM))
        i, j = np.nonzero(np.isfinite(rough) & (rough - room <= limit[who][:, None] ** 2))
        found.append((who[i], j + ball.lo, np.sqrt(((b[j] - x[who[i]]) ** 2).sum(axis=1))))

    def descend(ball: Ball, who: np.ndarray, nearest: np.ndarray) -> None:
        stays = nearest <= limit[who]
        who = who[stays]
        if not len(who):
            return
        if not ball.parts:
            scan(ball, who)
            return
        gaps = [np.maximum(np.sqrt(((x[who] - part.centre) ** 2).sum(axis=1)) - part.radius, 0) * (1 - ROOM) for part in ball.parts]
        for i in np.argsort([g.mean() for g in gaps], kind="stable"):
            descend(ball.parts[i], who, gaps[i])

    for start in range(0, len(x), CHUNK):
        who = np.arange(start, min(start + CHUNK, len(x)))
        descend(root, who, np.zeros(len(who)))
    who, at, distance = (np.concatenate([f[i] for f in found]) if found else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, float)))
    last = distance <= limit[who]
    return who[last], order[at[last]], distance[last]




def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample, each the farthest from those before it, so that no crowd is far from all of them."""
    if len(sample) <= n:
        return sample
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < n:
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return sample[chosen]


def nearest(points: DataFrame, k: int, pivots: int | None = None, block: int = BLOCK, seed: int = 42, report: dict | None = None) -> DataFrame:
    """(key, neighbour, distance, point): the ``k`` nearest other rows of each key, ties by neighbour key.

    ``points`` has ``key`` (any type that can be ordered) and ``x`` (array<double>). ``point`` is the neighbour's vector.
    Copies of a point count as neighbours at distance 0 and are listed as (key, key) rows with ``slots`` copies; each row
    carries ``slots``, the number of rows it stands for, so callers can pick the j-th neighbour. ``report`` gets the numbers of
    distinct points, cells, visits to cells, and pairs of a visitor and a point of a visited cell.
    """
    spark = points.sparkSession
    kind = points.schema["key"].dataType.simpleString()
    distinct = pin(points.groupBy("x").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies")))
    n, dims = distinct.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    dims = max(dims, 1)
    pivots = pivots or max(LEAST_PIVOTS, min(MOST_PIVOTS, n // CELL_POINTS, PIVOT_NUMBERS // dims))
    wanted = min(8 * pivots, max(pivots, SAMPLE_NUMBERS // dims))
    # Cut by a hash first, so that a task does not send a whole sample of its own.
    drawn = distinct.where(F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * min(1.0, 2 * wanted / max(n, 1)))))
    sample = [r["x"] for r in drawn.withColumn("_o", md5_order(["key"], seed)).orderBy("_o").limit(wanted).collect()]
    chosen = spread_out(np.array(sample, dtype=float).reshape(len(sample), -1), pivots)
    shared = spark.sparkContext.broadcast(chosen)

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre = shared.value
        for b in batches:
            b["cell"], b["r"] = nearest_centre(np.vstack(b["x"].to_numpy()), centre)
            yield b

    celled = pin(distinct.mapInPandas(to_cells, f"x array<double>, key {kind}, copies long, cell int, r double"))
    small = Window.partitionBy("cell").orderBy("r", "key")
    closest = celled.withColumn("_i", F.row_number().over(small)).where(F.col("_i") <= k + 1)
    stats = {
        r["cell"]: r for r in celled.groupBy("cell").agg(F.max("r").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    }
    floors: dict[int, list[float]] = {}
    for r in closest.select("cell", "r").collect():  # at most pivots * (k + 1) rows
        floors.setdefault(r["cell"], []).append(r["r"])
    cells = sorted(stats)
    radius = np.array([stats[c]["radius"] for c in cells])
    bound_cell = np.repeat(np.arange(len(cells)), [len(floors[c]) for c in cells])
    bound_r = np.concatenate([np.sort(floors[c]) for c in cells]) if cells else np.empty(0)
    blocks = {c: max(1, -(-stats[c]["n"] // block)) for c in cells}
    plan = spark.sparkContext.broadcast((cells, radius, bound_cell, bound_r))

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rad, bc, br = plan.value
        names, centre = np.array(names), shared.value[names]
        for b in batches:
            for start in range(0, len(b), CHUNK):
                part = b.iloc[start : start + CHUNK]
                x = np.vstack(part["x"].to_numpy())
                d = _distances(x, centre)
                kth = kth_reach(d, bc, br, k)
                row, col = np.nonzero(d - rad[None, :] <= kth[:, None] * (1 + ROOM) + 1e-12)
                piece = max(1, HELD_NUMBERS // max(1, x.shape[1]))
                for at in range(0, len(row), piece):
                    r, c = row[at : at + piece], col[at : at + piece]
                    yield pd.DataFrame({"key": part["key"].to_numpy()[r], "x": _objects(x[r]), "cell": names[c], "kth": kth[r]})

    visits = pin(celled.select("x", "key").mapInPandas(to_visits, f"key {kind}, x array<double>, cell int, kth double"))
    load = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if report is not None:
        report |= {"points": n, "cells": len(cells), "visits": sum(load.values()), "pairs": sum(v * stats[c]["n"] for c, v in load.items())}
    chunks = {c: max(1, -(-load.get(c, 0) // block)) for c in cells}
    sizes = spark.createDataFrame([(c, blocks[c], chunks[c]) for c in cells], "cell int, blocks int, chunks int")
    sizes = F.broadcast(sizes)  # one row per pivot
    data = (
        celled.join(sizes, "cell")
        .withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")))
        .withColumn("v", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("cell", "b", F.col("v").cast("long").alias("v"), "key", "x", "copies")
    )
    asking = (
        visits.join(sizes, "cell")
        .withColumn("v", F.pmod(F.xxhash64("key"), F.col("chunks")))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", F.col("b").cast("long").alias("b"), "v", "key", "x", "kth")
    )

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: pd.Series(dtype=object) for n in ("key", "neighbour", "distance", "point", "slots")})
        left = left.reset_index(drop=True)
        b, bk, copies = np.vstack(right["x"].to_numpy()), right["key"].to_numpy(), right["copies"].to_numpy()
        rank = np.unique(bk, return_inverse=True)[1]
        at = pd.Series(np.arange(len(bk)), index=bk)
        own = at.reindex(left["key"]).fillna(-1).to_numpy().astype(np.int64)
        alone = np.where((own >= 0) & (copies[own] == 1), own, -1)  # a point is its own neighbour only through a copy
        who, point, distance = near_pairs(np.vstack(left["x"].to_numpy()), left["kth"].to_numpy(), b, k, alone)
        order = np.lexsort((rank[point], distance, who))
        who, point, distance = who[order], point[order], distance[order]
        first = np.searchsorted(who, who)
        best = np.arange(len(who)) - first < k
        who, point, distance = who[best], point[best], distance[best]
        slots = copies[point] - (own[who] == point)
        return pd.DataFrame({"key": left["key"].to_numpy()[who], "neighbour": bk[point], "distance": distance, "point": _objects(b[point]), "slots": slots})

    found = (
        asking.groupBy("cell", "b", "v")
        .cogroup(data.groupBy("cell", "b", "v"))
        .applyInPandas(compare, f"key {kind}, neighbour {kind}, distance double, point array<double>, slots long")
    )
    best = Window.partitionBy("key").orderBy("distance", "neighbour")
    upto = F.sum("slots").over(best.rowsBetween(Window.unboundedPreceding, -1))
    ranked = found.withColumn("before", F.coalesce(upto, F.lit(0).cast("long"))).where(F.col("before") < k)
    # every copy of a point has the same neighbours
    owners = points.select(F.col("key").alias("_owner"), "x").join(distinct.select("x", "key"), "x")
    return owners.join(ranked, "key").select(F.col("_owner").alias("key"), "neighbour", "distance", "point", "slots", "before")


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row, and its distance."""
    at, least = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, HELD_NUMBERS // max(1, len(centres)))
    for start in range(0, len(x), step):
        d = _distances(x[start : start + step], centres)
        at[start : start + step], least[start : start + step] = d.argmin(1), d.min(1)
    return at, least


def kth_reach(d: np.ndarray, cell: np.ndarray, r: np.ndarray, k: int) -> np.ndarray:
    """For each row of distances to centres, the ``k``-th (from 0) of the sums of ``d[cell]`` and ``r``; infinite if there are fewer."""
    out = np.full(len(d), np.inf)
    if len(cell) > k:
        step = max(1, HELD_NUMBERS // len(cell))
        for start in range(0, len(d), step):
            out[start : start + step] = np.partition(d[start : start + step, cell] + r[None, :], k, axis=1)[:, k]
    return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in centres], axis=1)


def _objects(rows: np.ndarray) -> pd.Series:
    """Vectors as an object column; an empty list alone would become a number column."""
    return pd.Series(list(rows), dtype=object)
