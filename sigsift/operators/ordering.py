"""Running totals and consecutive numbers per key, without putting a key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsift.session import pin


SLICE_ROWS = 2_000_000


def with_running(
    frame: DataFrame, key: str, order: Sequence[Column], value: Column, name: str, slices: int | None = None
) -> DataFrame:
    """Adds the sum of ``value`` up to and including each row, per ``key`` in ``order``.

    Rows are range-partitioned by key and order, so a key with a third of all
    rows covers a third of the slices.  Sums run within a slice; the total of the
    key's earlier slices, a few numbers per key, is added.  The sliced rows are
    pinned because slice borders come from a sample and must be the same for the
    totals and for the rows.  Their number grows with the rows, so a slice stays
    small enough to be sorted in one task.  Counting and sampling read ``frame``
    again: pin a frame that is expensive to compute, such as the facts of a scan,
    beforehand.
    """
    slices = slices or max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-frame.count() // SLICE_ROWS))
    sliced = pin(
        frame.withColumn("_value", value.cast("bigint"))
        .repartitionByRange(slices, F.col(key), *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(key, "_slice")
        .agg(F.sum("_value").alias("_total"))
        .select(key, "_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn("_local", F.sum("_value").over(within))
        .join(offsets, [key, "_slice"])
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_local", "_before", "_slice", "_value")
    )


def with_ordinal(frame: DataFrame, key: str, order: Sequence[Column], name: str, slices: int | None = None) -> DataFrame:
    """Adds 1, 2, 3 ... per ``key`` in ``order``."""
    return with_running(frame, key, order, F.lit(1), name, slices)
