"""Centroid clustering (Lloyd's rounds over whole-number vectors) with heap-ordered bounds.

**Bounds.** Each vector has an upper bound on the distance to its own centroid and a lower bound on that to any other. While
the gap, lower less upper, is positive, the vector stays. If the centroids move, the gap of a vector of cluster c shrinks by at
most what c moved plus the most that another centroid moved; these amounts add up to the cluster's drift. A vector is
entered with the key gap + drift at that time, so the gap left is key - drift, and no key ever changes while the vector stays:
one heap a cluster, ordered by key, holds the vectors in the order in which their gaps expire.

**A round** raises the drifts, pops from each heap the keys that the drift has reached, scans those vectors exactly against all
centroids, and pushes them with new gaps. All others keep their cluster unseen. A heap is an array in heap order, so popping
walks down from its root and stops at every key that has not expired. Gaps are kept in doubles: a vector expires a small
margin early, which only means a scan too many, and equal distances (gap zero) are always scanned, so the smaller number wins.

**Spark's part.** Vectors are cut into blocks of rows, each with a heap a cluster of its own. The blocks (bucketed by number)
are written once; a round joins them with the state of the round before, bucketed alike, so that no vector is shuffled or
written again, and writes the new state with the sums that entered or left each cluster. Centroids are exact: the driver adds
up those sums, one row a cluster, as whole numbers. Everything else grows with the table and stays distributed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.llm.common import deleted, shared_path, staged

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors in a block, blocks in a bucket.
BLOCK_ROWS, BUCKET_BLOCKS = 2048, 32
#: Largest component whose squared distances fit a long, and whose distances are exact in doubles.
MOST, EXACT = 1 << 27, 1 << 22
#: Share of the largest possible distance by which a gap expires early.
MARGIN = 1e-12


# --- heaps ------------------------------------------------------------------------------------------------------------------


def expired(keys: np.ndarray, limit: float) -> np.ndarray:
    """Places of the keys of a heap that are ``limit`` or less: down from the root, level by level, only past expired keys."""
    found, level = [], np.zeros(1 if len(keys) else 0, np.int64)
    while len(level := level[keys[level] <= limit]):
        found.append(level)
        level = (2 * level[:, None] + [1, 2]).ravel()
        level = level[level < len(keys)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def heap_order(keys: np.ndarray) -> np.ndarray:
    """An order that makes ``keys`` a heap: ascending keys are one."""
    return np.argsort(keys, kind="stable")


@dataclass
class Heaps:
    """The heaps of a block: ``keys`` and ``rows`` of all clusters in a row, cluster c from ``starts[c]`` on."""

    keys: np.ndarray
    rows: np.ndarray
    starts: np.ndarray

    @classmethod
    def empty(cls, clusters: int) -> Heaps:
        return cls(np.empty(0), np.empty(0, np.int32), np.zeros(clusters + 1, np.int32))

    @property
    def clusters(self) -> int:
        return len(self.starts) - 1

    def heap(self, c: int) -> slice:
        return slice(self.starts[c], self.starts[c + 1])

    def labels(self, n: int) -> np.ndarray:
        """The cluster of each of the block's ``n`` rows, -1 where a row is in no heap."""
        out = np.full(n, -1, np.int32)
        out[self.rows] = np.repeat(np.arange(self.clusters, dtype=np.int32), np.diff(self.starts))
        return out

    def popped(self, limits: np.ndarray) -> np.ndarray:
        """Places of all entries whose cluster's limit has reached their key."""
        return np.concatenate([self.starts[c] + expired(self.keys[self.heap(c)], limits[c]) for c in range(self.clusters)])

    def exchanged(self, gone: np.ndarray, rows: np.ndarray, clusters: np.ndarray, keys: np.ndarray) -> Heaps:
        """The heaps without the entries ``gone``, with new ones; heaps that neither lose nor get any stay as they are."""
        stays = np.ones(len(self.keys), bool)
        stays[gone] = False
        touched = np.zeros(self.clusters, bool)
        touched[clusters] = True
        touched[np.searchsorted(self.starts, gone, "right") - 1] = True
        out_keys, out_rows = [], []
        for c in range(self.clusters):
            at = self.heap(c)
            k, r = self.keys[at], self.rows[at]
            if touched[c]:
                new = clusters == c
                k, r = np.concatenate([k[stays[at]], keys[new]]), np.concatenate([r[stays[at]], rows[new].astype(np.int32)])
                order = heap_order(k)
                k, r = k[order], r[order]
            out_keys.append(k)
            out_rows.append(r)
        return Heaps(np.concatenate(out_keys), np.concatenate(out_rows), np.cumsum([0, *map(len, out_keys)]).astype(np.int32))


# --- distances --------------------------------------------------------------------------------------------------------------


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, k) of whole-number vectors: by doubles while all sums stay below 2^53, else by longs."""
    most = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if vectors.shape[1] * (2.0 * most) ** 2 < 1 << 53:
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    x, c = vectors.astype(np.int64), centroids.astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def scanned(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid, the smaller number of equals, and the gap to the second nearest."""
    d = squared_distances(vectors, centroids)
    own = d.argmin(axis=1)
    if d.shape[1] == 1:
        return own, np.full(len(d), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return own, two[:, 1] - two[:, 0]


# --- what a task does with a block --------------------------------------------------------------------------------------------


@dataclass
class Round:
    """What every task needs of a round: the centroids, the drifts so far and the margin."""

    centroids: np.ndarray
    drift: np.ndarray
    margin: float

    def step(self, vectors: np.ndarray, heaps: Heaps | None) -> tuple[Heaps, np.ndarray, np.ndarray, np.ndarray, int]:
        """New heaps; clusters that gained or lost, by how many vectors and by what sums; how many vectors were scanned."""
        k = len(self.centroids)
        if heaps is None:
            gone, rows, old = np.empty(0, np.int64), np.arange(len(vectors)), np.full(len(vectors), -1)
            heaps = Heaps.empty(k)
        else:
            gone = heaps.popped(self.drift + self.margin)
            rows, old = heaps.rows[gone], np.searchsorted(heaps.starts, gone, "right") - 1
        own, gap = scanned(vectors[rows], self.centroids)
        heaps = heaps.exchanged(gone, rows, own, gap + self.drift[own])
        moved = np.flatnonzero(own != old)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, vectors.shape[1]), np.int64)
        x = vectors[rows[moved]].astype(np.int64)
        for at, sign in ((own[moved], 1), (old[moved], -1)):
            np.add.at(counts, at[at >= 0], sign)
            np.add.at(sums, at[at >= 0], sign * x[at >= 0])
        changed = np.unique(np.concatenate([own[moved], old[moved][old[moved] >= 0]]))
        return heaps, changed, counts[changed], sums[changed], len(rows)


def _matrix(raw: bytes, width: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").reshape(-1, dims)


def _blocks(key: str, column: str, dims: int, scale: int, rows: int) -> Callable:
    """mapInArrow: rows to blocks (block long, ids, width int, vectors binary, most long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 32

        def cut(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, number
            while n >= rows or (whole and n):
                table = pa.Table.from_batches(held).combine_chunks()
                part, held = table.slice(0, rows), table.slice(rows).to_batches()
                n -= len(part)
                flat = part.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(flat * scale)
                most = np.abs(x).max()
                if most > MOST:
                    raise ValueError(f"a component of {most / scale:.3g} is too large for squared distances in a long")
                width = 2 if most < 1 << 15 else 4
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(key).combine_chunks())
                columns = [pa.array([number]), ids, pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([int(most)])]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "width", "vectors", "most"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                yield from cut(False)
        yield from cut(True)

    return run


STATE = "block long, keys binary, rows binary, starts binary, scanned long, deltas array<struct<c:int,n:long,s:array<long>>>"


def _advance(now: Round, dims: int) -> Callable:
    """mapInArrow: blocks with the state before (null in the first round) to the state after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                vectors = _matrix(r["vectors"], r["width"], dims)
                before = r["keys"] is not None and Heaps(np.frombuffer(r["keys"]), np.frombuffer(r["rows"], np.int32), np.frombuffer(r["starts"], np.int32))
                heaps, changed, counts, sums, seen = now.step(vectors, before or None)
                deltas = [{"c": int(c), "n": int(n), "s": s.tolist()} for c, n, s in zip(changed, counts, sums)]
                kind = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))
                columns = [pa.array([r["block"]]), *[pa.array([x.tobytes()], pa.binary()) for x in (heaps.keys, heaps.rows, heaps.starts)], pa.array([seen]), pa.array([deltas], kind)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "keys", "rows", "starts", "scanned", "deltas"])

    return run


def _assigned(centroids: np.ndarray, dims: int, key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                vectors = _matrix(one.column("vectors")[0].as_py(), one.column("width")[0].as_py(), dims)
                heaps = Heaps(*[np.frombuffer(one.column(c)[0].as_py(), t) for c, t in (("keys", np.float64), ("rows", np.int32), ("starts", np.int32))])
                label = heaps.labels(len(vectors))
                gap = vectors.astype(np.int64) - centroids[label]
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), pa.array(label), pa.array((gap * gap).sum(axis=1))], [key, "cluster", "distance"])

    return run


# --- Spark --------------------------------------------------------------------------------------------------------------------


class Bucketed:
    """Tables of blocks in the shared folder, bucketed by block number alike, so that they join without a shuffle."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, {}

    def write(self, df: DataFrame, spread: bool) -> DataFrame:
        name, path = f"blocks_{uuid.uuid4().hex}", shared_path(self.spark, "blocks")
        dealt = df.repartition(self.buckets, "block") if spread else df
        dealt.write.bucketBy(self.buckets, "block").sortBy("block").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.names[name] = path
        table = self.spark.table(name)
        table.bucket_name = name
        return table

    def drop(self, *tables: DataFrame) -> None:
        for name in [t.bucket_name for t in tables]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            deleted(self.spark, self.names.pop(name))


def whole_vectors(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    """The rows whose vector has ``dims`` components, none null or non-finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) == dims) & finite)


def seeds(kept: DataFrame, key: str, column: str, clusters: int, seed: int, scale: int) -> np.ndarray:
    """The ``clusters`` vectors whose keys have the smallest sha256 of ``seed:key``; equal keys by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    found = kept.select(order.alias("h"), F.col(column).alias("v")).orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()
    return np.array([np.floor(np.array(r.v, np.float64) * scale) for r in found]).astype(np.int64)


def summed(state: DataFrame, dims: int) -> list:
    """One row a cluster: by how many vectors and by what sums it changed."""
    parts = state.select(F.inline("deltas"))
    wide = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    return parts.groupBy("c").agg(F.sum("n").alias("n"), *wide).collect()


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    column: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    scale: int = SCALE,
    dims: int = DIMS,
    block_rows: int = BLOCK_ROWS,
    trace: list | None = None,
) -> DataFrame:
    """One row a kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components x become floor(scale * x). Vectors of another length, null ones and those with a null or non-finite component
    have no row. Fewer vectors than ``clusters`` make fewer centroids; an empty table gives an empty result. Keys may be null
    or repeated: every row is a vector of its own (null keys seed only if there are too few others). Other columns are not
    read. Components above 2^27 raise an error, since their squared distances do not fit a long. ``trace`` gets the
    number of vectors scanned in each round.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors.select(key, column), column, dims)
    kind = kept.schema[key].dataType.simpleString()
    result = f"{key} {kind}, cluster int, distance long"
    cut = staged(kept.mapInArrow(_blocks(key, column, dims, scale, block_rows), f"block long, ids array<{kind}>, width int, vectors binary, most long"), "blocks")
    size = cut.agg(F.count("*").alias("n"), F.max("most").alias("most")).first()
    if not size.n:
        empty = spark.createDataFrame([], result)
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])

    centroids = seeds(kept, key, column, clusters, seed, scale)
    store = Bucketed(spark, min(max(spark.sparkContext.defaultParallelism, -(-size.n // BUCKET_BLOCKS)), size.n))
    blocks = store.write(cut.drop("most"), True)
    deleted(spark, cut.staged_path)

    k = len(centroids)
    drift, counts, sums = np.zeros(k), [0] * k, [[0] * dims for _ in range(k)]
    state = None
    for number in range(rounds + 1):
        now = Round(centroids, drift, MARGIN * (4 * np.sqrt(dims) * size.most + drift.max() + 1))
        if state is None:
            joined = blocks.select("block", "width", "vectors", *[F.lit(None).cast("binary").alias(c) for c in ("keys", "rows", "starts")])
        else:
            joined = blocks.select("block", "width", "vectors").join(state.select("block", "keys", "rows", "starts"), "block")
        after = store.write(joined.mapInArrow(_advance(now, dims), STATE), False)
        if state is not None:
            store.drop(state)
        state = after
        if trace is not None:
            trace.append(state.agg(F.sum("scanned")).first()[0])
        if number == rounds:
            break
        for r in summed(state, dims):
            counts[r.c] += r.n
            sums[r.c] = [a + int(r[f"s{i}"]) for i, a in enumerate(sums[r.c])]
        new = np.array([[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids.tolist())], np.int64)
        step = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(axis=1))
        others = np.array([np.delete(step, c).max(initial=0) for c in range(k)])
        centroids, drift = new, drift + step + others

    final = staged(blocks.select("block", "ids", "width", "vectors").join(state, "block").mapInArrow(_assigned(centroids, dims, key), result), "clusters")
    store.drop(state, blocks)
    inertia = {r.cluster: r.d for r in final.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    shown = [(c, int(d), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    table = spark.createDataFrame(shown, "cluster int, cluster_inertia long, centroid_sha256 string")  # one row a cluster
    both = final.join(F.broadcast(table), "cluster")
    return both.select(key, "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")
