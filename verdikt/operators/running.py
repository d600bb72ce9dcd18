"""Running totals and ranks that survive a hot group.

A window puts each group in one task.  When the largest group is small that is
the cheapest plan, so the group sizes are measured first (a partial aggregate
over the keys only).  Otherwise rows are range-partitioned on (keys, order),
checkpointed so that both passes see the same slices, summed per slice, and the
slice offsets are joined back: no task ever holds more than one slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.session import durable, max_group_rows, shuffle_partitions

SLICE = "_slice"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    if not keys:
        return df.count()
    sizes = df.groupBy(*keys).count()
    return sizes.agg(F.max("count")).first()[0] or 0


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    max_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Add inclusive running totals per group; ``order`` must be a total order.

    ``at_most`` is a known upper bound of a group's rows, such as the row count
    of the table behind it: when it already fits, group sizes are not measured.
    """
    limit = max_group_rows(df.sparkSession) if max_rows is None else max_rows
    if not keys:  # one way at every size: a window over the whole table is one task
        return _sliced_totals(df, [], list(order), totals, limit)
    if (at_most is not None and at_most <= limit) or largest_group(df, keys) <= limit:
        window = (
            Window.partitionBy(*keys)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return df.select("*", *[F.sum(c).over(window).alias(n) for n, c in totals.items()])
    return _sliced_totals(df, list(keys), list(order), totals, limit)


def _sliced_totals(df, keys, order, totals, limit):
    """Totals over range slices of about ``limit`` rows at most, offset by the totals of the slices before."""
    parts = max(shuffle_partitions(df.sparkSession), -(-df.count() // limit))
    staged = df.select("*", *[c.alias(f"_v_{n}") for n, c in totals.items()])
    range_keys = [F.col(k) for k in keys] + order
    sliced = durable(
        staged.repartitionByRange(parts, *range_keys).withColumn(SLICE, F.spark_partition_id())
    )
    slices = sliced.groupBy(*keys, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    before = (
        Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = slices.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(SLICE).alias("_k_slice"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals],
    )
    inside = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in totals])
    match = F.col(SLICE) == F.col("_k_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(offsets, match).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in totals]
    )


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank",
           max_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Distinct 1-based ranks per group under a total order."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, max_rows, at_most)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          name: str = "rank") -> DataFrame:
    """First k rows per group.

    Spark limits every group to k rows on the map side before the shuffle
    (WindowGroupLimit), so a hot group costs k rows per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float],
                    max_rows: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles, one column ``p<percent>`` per point.

    Values are first folded into a histogram; the running count then finds the
    two order statistics around each target position.
    """
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, points, max_rows).drop("_all")
    folded = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    seen = running_totals(folded, keys, [F.col(value).asc()], {"_upto": F.col("_n")}, max_rows)
    totals = folded.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    joined = seen.join(totals, list(keys))
    ends = []
    for i, q in enumerate(points):
        at = F.lit(float(q)) * (F.col("_total") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_upto") > pos) & (F.col("_upto") - F.col("_n") <= pos)
            ends.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{side}_{i}"))
    picked = joined.groupBy(*keys).agg(F.max("_total").alias("_total"), *ends)
    out = []
    for i, q in enumerate(points):
        at = F.lit(float(q)) * (F.col("_total") - 1)
        part = at - F.floor(at)
        low, high = F.col(f"_lo_{i}"), F.col(f"_hi_{i}")
        out.append((low * (1 - part) + high * part).alias(f"p{round(q * 100)}"))
    return picked.select(*keys, F.col("_total").alias("n"), *out)
