"""Positions, running totals and exact quantiles without a single-task sort.

Three ways, picked by what is known about the input:

* a frame whose estimated size is under a checked bound is ordered by a plain window;
* a random order (md5 of a key) is spread evenly by its own prefix, so the prefix is the bucket and
  only the per-bucket counts (at most ``16**prefix`` per group) are ordered in one place;
* any other order is range-partitioned once and pinned by a checkpoint, after which the slice number is
  data: per-slice totals give offsets and each slice is ordered on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsight.functions.columns import md5_order, named
from tabsight.functions.frames import unpivot_number
from tabsight.session import is_small, pin


#: Rows of a bucket that one task orders.
BUCKET_ROWS = 100_000

#: Ranks of a sketch are right to one in so many rows; more groups than this are not worth a sketch each.
SKETCH_ACCURACY = 10_000
SKETCH_GROUPS = 1000

#: Estimate under which one task orders by md5. Keys are packed far better in files than with their digest in a task.
HASHED_BYTES = 2 * 1024 * 1024


def _order_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def sliced(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partition by ``order`` and record the slice number as a durable column ``_slice``."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pin(df.repartitionByRange(slices, *_order_columns(order)).withColumn("_slice", F.spark_partition_id()))


def running_total(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: dict[str, str | Column],
    by: Sequence[str] = (),
    small: bool | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``sums`` along ``order`` inside each ``by`` group.

    ``order`` should be unique inside a group: pre-aggregate equal values first.
    """
    order_cols = _order_columns(order)
    exprs = {name: (F.col(c) if isinstance(c, str) else c) for name, c in sums.items()}
    if small is None:
        small = is_small(df)
    if small:
        window = Window.partitionBy(*by).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(window).alias(name) for name, c in exprs.items()])
    pinned = sliced(df, [*[F.col(b) for b in by], *order_cols])
    totals = pinned.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in exprs.items()])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col("_slice").alias("_slice_o"),
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in exprs],
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = pinned.select("*", *[F.sum(c).over(inside).alias(f"_l_{name}") for name, c in exprs.items()])
    condition = F.col("_slice") == F.col("_slice_o")
    for b in by:
        condition = condition & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    joined = local.join(offsets, condition, "left")
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in exprs])


def ordinal(
    df: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    name: str = "ordinal",
    small: bool | None = None,
) -> DataFrame:
    """1-based position along ``order`` inside each ``by`` group. ``order`` must end in a unique key."""
    return running_total(df, order, {name: F.lit(1).cast("long")}, by, small)


def hashed_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    seed: int = 42,
    by: Sequence[str] = (),
    name: str = "ordinal",
    prefix: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """1-based position in the md5 order of ``keys`` inside each ``by`` group.

    The md5 is uniform, so a hot group is spread over ``16**prefix`` even buckets; the prefix follows the row count, for
    ``BUCKET_ROWS`` rows a bucket at most. Nothing is pinned: the bucket depends only on the key, so recomputing a lost
    task gives the same answer.
    """
    tagged = df.withColumn("_md5", md5_order(keys, seed))
    if small is None:
        small = is_small(df, HASHED_BYTES)
    if small:
        window = Window.partitionBy(*by).orderBy("_md5")
        return tagged.withColumn(name, F.row_number().over(window).cast("long")).drop("_md5")
    if prefix is None:
        prefix = 3
        rows = df.count()
        while rows > BUCKET_ROWS * 16**prefix:
            prefix += 1
    tagged = tagged.withColumn("_bucket", F.substring("_md5", 1, prefix))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(b).alias(f"_by_{b}") for b in by],
            F.col("_bucket").alias("_bucket_o"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        )
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_md5")
    local = tagged.withColumn("_local", F.row_number().over(inside).cast("long"))
    condition = F.col("_bucket") == F.col("_bucket_o")
    for b in by:
        condition = condition & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    joined = local.join(offsets, condition, "left")
    return joined.select(*df.columns, (F.col("_local") + F.col("_offset")).alias(name))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank", small: bool | None = None) -> DataFrame:
    """Average rank of ties, nulls unranked. Equal values collapse to one row before anything is ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    cumulative = running_total(counts, [value], {"_upto": "_n"}, by, small)
    ranks = cumulative.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col(value).alias("_v"),
        ((F.col("_upto") - F.col("_n") + 1 + F.col("_upto")) / 2.0).alias(name),
    )
    condition = F.col(value) == F.col("_v")
    for b in by:
        condition = condition & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return df.join(ranks, condition, "left").select(*df.columns, name)


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    exact: bool = True,
    small: bool | None = None,
) -> DataFrame:
    """(by..., column, q: array<double>) with linear interpolation, one entry of ``q`` per probability.

    ``exact=False`` uses the mergeable sketch. Exact results of a small input come from one aggregate. Beyond the
    checked size a sketch says between which values a wanted rank lies, and only these are ranked (``_between``); where
    that can't be done, all values collapse to (value, count) rows, are ranked by running counts, and only the rows
    that hold a wanted rank are kept.
    """
    probs = list(probs)
    if small is None and exact:
        small = is_small(df.select(*by, *[named(c) for c in columns]))
    if not exact or small:
        plist = F.array(*[F.lit(float(p)) for p in probs])
        structs = []
        for c in columns:
            x = named(c).cast("double")
            q = F.percentile(x, plist) if exact else F.percentile_approx(x, plist, 10000)
            structs.append(F.struct(F.lit(c).alias("column"), q.alias("q")))
        wide = df.groupBy(*by).agg(F.array(*structs).alias("_rows"))
        return wide.select(*by, F.inline("_rows"))
    group = [*by, "column"]
    long = unpivot_number(df, columns, by)
    found = _between(long, group, probs)
    if found is not None:
        return found
    counts = long.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("_n"))
    return counted_quantiles(counts, group, probs, small=False)


def _same(group: Sequence[str]) -> Column:
    condition = F.lit(True)
    for g in group:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return condition


def _between(long: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame | None:
    """Exact quantiles of (group..., value) by a sketch and a second pass; None if there are too many groups or a sketch missed.

    The sketch's neighbours on both sides of a probability enclose the wanted ranks. The second pass counts what is below
    them and collapses what is between, some rows in ``SKETCH_ACCURACY`` and their copies, so no value outside is hashed,
    shuffled or sorted. The counts tell whether the ranks were enclosed.
    """
    margin = 2.0 / SKETCH_ACCURACY
    edges = F.array(*[F.lit(float(min(1.0, max(0.0, p + side)))) for p in probs for side in (-margin, margin)])
    sketches = pin(long.groupBy(*group).agg(F.percentile_approx("value", edges, SKETCH_ACCURACY).alias("_s"), F.count(F.lit(1)).alias("_total")))
    if sketches.count() > SKETCH_GROUPS:
        return None
    ranges = [
        F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p"), F.col("_s")[2 * i].alias("_from"), F.col("_s")[2 * i + 1].alias("_to"))
        for i, p in enumerate(probs)
    ]
    wanted = sketches.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_total", F.array(*ranges).alias("_ranges"))
    met = long.join(F.broadcast(wanted), _same(group)).select(*group, "value", "_total", F.inline("_ranges"))
    below, above = F.col("value") < F.col("_from"), F.col("value") > F.col("_to")
    entity = [*group, "_i", "_p", "_total"]
    counts = (
        met.where(~above)
        .groupBy(*entity, F.when(~below, F.col("value")).alias("value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # What is below has no value and comes first.
    upto = Window.partitionBy(*group, "_i").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_pos", F.col("_p") * (F.col("_total") - 1))
    low, high = F.floor("_pos") + 1, F.ceil("_pos") + 1
    first = F.col("_upto") - F.col("_n") + 1
    at_low, at_high = (first <= low) & (F.col("_upto") >= low), (first <= high) & (F.col("_upto") >= high)
    picked = ranked.groupBy(*group, "_i", "_pos").agg(
        F.max(F.when(at_low, F.col("value"))).alias("_lo"), F.max(F.when(at_high, F.col("value"))).alias("_hi")
    )
    fraction = F.col("_pos") - F.floor("_pos")
    found = pin(picked.select(*group, "_i", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * fraction).alias("_v")))
    if not found.where(F.col("_v").isNull()).isEmpty() or found.count() != sketches.count() * len(probs):
        return None
    return found.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("q"))


def counted_quantiles(counts: DataFrame, group: Sequence[str], probs: Sequence[float], small: bool | None = None) -> DataFrame:
    """(group..., q: array<double>) of a table (group..., value, _n) in which ``value`` stands for ``_n`` equal values."""
    if small is None:
        small = is_small(counts)
    if small:
        q = F.percentile(F.col("value").cast("double"), F.array(*[F.lit(float(p)) for p in probs]), F.col("_n"))
        return counts.groupBy(*group).agg(q.alias("q"))
    ranked = pin(running_total(counts, ["value"], {"_upto": "_n"}, group, small=False))
    totals = ranked.groupBy(*group).agg(F.max("_upto").alias("_total"))
    wanted = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"),
        "_total",
    ).withColumn("_pos", F.col("_p") * (F.col("_total") - 1))
    low, high = F.floor("_pos") + 1, F.ceil("_pos") + 1
    first = F.col("_upto") - F.col("_n") + 1
    hits = ranked.join(wanted, _same(group)).where((first <= high) & (F.col("_upto") >= low))
    picked = hits.groupBy(*group, "_i", "_pos").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    fraction = F.col("_pos") - F.floor("_pos")
    return (
        picked.select(*group, "_i", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * fraction).alias("_v"))
        .groupBy(*group)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("q"))
    )
