"""Sharding along a Hilbert curve over document metadata.

Every dimension is reduced to the same small number of bits by cut points that hold equal shares of all rows, the cells are
numbered along the Hilbert curve through the grid, the rows are sorted by that number, and the sorted run is cut into
shards whose row counts differ by one at most (law ``rows``). Near cells are near on the curve, so a shard, and each row
group in it, spans a narrow range of every dimension and a filter on any of them skips most files.

The sort is a range partitioning of narrow rows (ids, sizes and curve numbers, never texts). The sorted slices are staged,
which pins them, so that a row's place in the run is its slice's offset plus its place in the slice; only one count a slice
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import staged

SHARDS = 16
#: Bits of each dimension on the curve; 2^BITS - 1 cut points.
BITS = 5
#: Error of a cut point's rank is at most rows / ACCURACY.
ACCURACY = 10_000
#: Rows of a sorted slice aimed at.
SLICE_ROWS = 1_000_000


def text_order(value: Column) -> Column:
    """A string's first seven bytes as a number that sorts like them; null stays null."""
    start = F.substring(F.encode(value, "UTF-8"), 1, 7)
    return F.conv(F.rpad(F.hex(start), 14, "0"), 16, 10).cast("double")


def cut_points(df: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> dict[str, list[float]]:
    """Distinct values that split all rows into 2^bits equal shares; at most 2^bits - 1 numbers a dimension."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    row = df.agg(*[F.percentile_approx(d, shares, ACCURACY).alias(d) for d in dimensions]).first()
    return {d: sorted(set(row[d] or [])) for d in dimensions}


def hilbert_number(cells: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """The place of each grid cell along the Hilbert curve.

    The curve is built by Gray code and rotations: going from the highest bit to the lowest, a coordinate whose bit is set
    mirrors the first coordinate below that bit, one whose bit is clear swaps the lower bits with the first one; what is left
    is a Gray code, whose decoded and interleaved bits are the number.
    """
    x = [c.astype(np.int64).copy() for c in cells]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            on = (x[i] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    number = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            number = number << 1 | ((c ^ flip) >> bit & 1)
    return number


def curve(df: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> DataFrame:
    """``df`` with the column ``hilbert``. A null goes into cell 0 of its dimension."""
    named = {f"_d{i}": c.cast("double") for i, c in enumerate(dimensions.values())}
    df = df.withColumns(named)
    names = list(named)
    cuts = cut_points(df, names, bits)

    @F.pandas_udf("long")
    def number(cells: pd.DataFrame) -> pd.Series:
        grid = [np.searchsorted(cuts[d], cells[d].fillna(-np.inf), "right") for d in names]
        return pd.Series(hilbert_number(grid, bits))

    return df.withColumn("hilbert", number(F.struct(*names))).drop(*names)


def assign(df: DataFrame, order: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """``df`` with shard and slot: the rows sorted by ``order`` and cut into runs of equal counts, up to one row."""
    spark = df.sparkSession
    rows = df.count()
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SLICE_ROWS))
    ordered = df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    # The number holds the slice in its upper 31 bits and the place in it in the lower 33; staging makes it a fact.
    placed = staged(ordered.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    slice_of = F.shiftright("_at", 33)
    counts = {r[0]: r[1] for r in placed.groupBy(slice_of).count().collect()}
    offsets, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(i, 0)
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    if len(offsets) > 1:
        table = spark.createDataFrame(list(enumerate(offsets)), "_slice int, _offset long")
        # One row a slice, so the size is bounded by the number of partitions.
        placed = placed.withColumn("_slice", slice_of.cast("int")).join(F.broadcast(table), "_slice").drop("_slice")
        place = place + F.col("_offset")
    placed = placed.withColumn("_rank", place)
    # Shard s holds ranks from ceil(s * total / shards) on.
    shard = F.expr(f"cast((_rank * {shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).drop("_at", "_rank", "_offset")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, carry: Sequence[str] = ()) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text, lang, source): doc_id, size, text_crc32, law, shard, slot, hilbert.

    The curve's dimensions are language, source, size and doc_id. Null texts have size 1 and a null checksum, null metadata
    go into the first cell; ties on the curve are ordered by checksum and doc_id, so equal texts with equal metadata are
    neighbours; repeated rows are rows of their own. Other columns are not read but for those to ``carry``, and an empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    narrow = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), "lang", "source", *carry
    )
    narrow = staged(narrow, "metadata")
    dimensions = {
        "lang": text_order(F.col("lang")),
        "source": text_order(F.col("source")),
        "size": F.col("size"),
        "doc_id": F.col("doc_id"),
    }
    return assign(curve(narrow, dimensions), ["hilbert", "text_crc32", "doc_id"], shards)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents as one folder a shard, sorted along the curve, with footers that let readers skip files.

    The folders are named after the column ``hilbert_shard``; columns of the names added here are replaced. Every row is
    written once: rows are numbered and staged first, so repeated and null ids do no harm.
    """
    place = ["hilbert_shard", "hilbert_slot"]
    numbered = staged(docs.drop(*place, "hilbert_row").withColumn("hilbert_row", F.monotonically_increasing_id()), "rows")
    placed = hilbert_shards(numbered, shards, ["hilbert_row"])
    placed = placed.select("hilbert_row", F.col("shard").alias("hilbert_shard"), F.col("slot").alias("hilbert_slot"))
    rows = numbered.join(placed, "hilbert_row").drop("hilbert_row").repartitionByRange(*place).sortWithinPartitions(*place)
    rows.write.partitionBy("hilbert_shard").parquet(path)


def digest(placed: DataFrame) -> DataFrame:
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
