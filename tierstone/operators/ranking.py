"""Row numbers and top-n that hold up when one group has a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierstone.session import settle


# rows of one group and slice that a task sorts; of more, ranges of rows are numbered
HOT_ROWS = 1_000_000


def ordinal_by_range(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """row_number() over (by, order), from 1, for groups of any size.

    Rows are dealt to ranges of (by, order), whose bounds Spark takes from samples of all partitions, so a group spreads over as many tasks as
    it needs, also where all its rows share the first sort columns; the order must tell its rows apart. A row's
    number is its place in its range plus the rows of the group in the ranges before.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    # a place counts up within its partition; written, as another run might deal the rows otherwise
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = settle(ranged.withColumns({"_part": F.spark_partition_id(), "_place": place}), "ranged-rows")
    pieces = placed.groupBy(*by, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = pieces.select(*by, "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.join(before, [*by, "_part"]).withColumn(name, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def ordinal(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], slice_by: Column, name: str = "ordinal", hot_rows: int | None = None
) -> DataFrame:
    """row_number() over (by, order), from 1, without putting a whole group in one task.

    slice_by must be non-null and never decrease along order (a day of the sort time,
    a thousand-block of a sequence number). Rows are numbered inside (by, slice);
    the counts of the earlier slices, one small row per slice, are then added. The
    by columns must not be null. With hot_rows, slices of more rows are looked for first and numbered by ranges
    of their rows; that takes a job, and df should be stored.
    """
    sliced = df.withColumn("_slice", slice_by)
    sizes = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    if hot_rows is not None:
        sizes = settle(sizes, "slice-sizes")
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(
        *by, "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    inside = W.partitionBy(*by, "_slice").orderBy(*order)
    hot = None if hot_rows is None else sizes.filter(F.col("_size") > hot_rows).select(*by, "_slice")
    if hot is None or hot.isEmpty():
        numbered = sliced.withColumn("_at", F.row_number().over(inside))
    else:
        cold = sliced.join(hot, [*by, "_slice"], "left_anti").withColumn("_at", F.row_number().over(inside).cast("long"))
        numbered = cold.unionByName(ordinal_by_range(sliced.join(hot, [*by, "_slice"], "left_semi"), [*by, "_slice"], order, "_at"))
    return (
        numbered.join(before, [*by, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop("_slice", "_at", "_before")
    )


def top_n(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str | None = None
) -> DataFrame:
    """The first n rows of each group. Spark limits every group to n rows inside each
    input partition before the shuffle, so a hot group arrives already cut."""
    position = name or "_position"
    ranked = df.withColumn(position, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    kept = ranked.filter(F.col(position) <= n)
    return kept if name else kept.drop(position)


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, by, order, 1)
