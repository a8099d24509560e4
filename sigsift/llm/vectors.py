"""Vectors of whole numbers, and dealing blocks of rows to blocks of queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsift.session import pin

SCALE = 256
#: Whole components stay below this, so that a hundred times the product of a thousand components fits 64 bits.
LIMIT = 2**22


def whole_vectors(table: DataFrame, key: Column, vector: Column, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """(_row, _id, _size, _vector), and _label where one is given, pinned: every component x as floor(scale * x), x as double.

    Rows without an id or a label, whose vector is null or holds null or
    non-finite components, or components of ``LIMIT`` or more once scaled, are
    left out.  ``_row`` tells rows apart that repeat an id.
    """
    rows = table.select(key.alias("_id"), vector.cast("array<double>").alias("_double"), (F.lit(0) if label is None else label).alias("_label"))
    fits = F.forall("_double", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < LIMIT))
    rows = rows.where("_id IS NOT NULL AND _label IS NOT NULL AND _double IS NOT NULL").where(fits)
    numbers = F.transform("_double", lambda x: F.floor(x * scale).cast("int"))
    out = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", F.size("_double").alias("_size"), numbers.alias("_vector"), "_label")
    return pin(out.drop("_label") if label is None else out)


def matrix(column: pd.Series) -> np.ndarray:
    """The vectors of a column, of one size, as rows of whole numbers."""
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products; through doubles where those are exact, which is many times faster."""
    largest = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1]
    if largest < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Positions of the ``count`` largest scores, largest first, ties to smaller ids."""
    if len(scores) > count:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:count]]


def asked(rows: DataFrame, key: str, condition: Column) -> DataFrame:
    """The rows for whose id ``condition``, on a column called ``key``, holds."""
    kept = rows.withColumn(key, F.col("_id")).where(condition)
    return kept.select(*[F.col(c).alias(c) for c in rows.columns])


def dealt(stored: DataFrame, wanted: DataFrame, place: list[str], block: int, part: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Stored rows in blocks and wanted rows in parts, each block to meet each part of its ``place``; and what to group by.

    Both sides are repeated once for each block or part of the other, so that a
    task holds one block and one part, whatever share of the rows one place has.
    """
    blocks = stored.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    parts = wanted.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / part).alias("_parts"))
    numbers = pin(blocks.join(parts, place))
    own = lambda count: F.pmod(F.xxhash64("_row"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = stored.join(numbers, place).withColumn("_of_blocks", own("_blocks")).withColumn("_of_parts", every("_parts"))
    right = wanted.join(numbers, place).withColumn("_of_parts", own("_parts")).withColumn("_of_blocks", every("_blocks"))
    return left.drop("_blocks", "_parts"), right.drop("_blocks", "_parts"), [*place, "_of_blocks", "_of_parts"]
