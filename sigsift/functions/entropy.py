"""Byte histograms and Shannon entropy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    import pandas as pd


def _counts(raw: bytes | None) -> np.ndarray:
    return np.bincount(np.frombuffer(raw or b"", dtype=np.uint8), minlength=256)


# Plain functions get a hundred contents at a time; an Arrow batch holds ten thousand, and its copies beside it.
@F.udf(T.ArrayType(T.LongType()), useArrow=False)
def byte_histogram(content: bytes | None) -> list[int]:
    """Occurrences of each of the 256 byte values; Spark has no built-in byte counter."""
    return _counts(content).tolist()


@F.udf(T.ArrayType(T.LongType()), useArrow=False)
def byte_counts(content: bytes | None) -> list[int]:
    """Occurrences of the byte values that occur, in their order."""
    counts = _counts(content)
    return counts[counts > 0].tolist()


def entropy_of(counts: Column) -> Column:
    """Bits per byte of a histogram or of the counts in it, four decimals; an empty one has 0."""
    def add(acc: Column, c: Column) -> Column:
        return F.struct(
            (acc["n"] + c).alias("n"),
            (acc["s"] + F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)).alias("s"),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("s"))
    return F.aggregate(
        counts,
        zero,
        add,
        lambda acc: F.when(acc["n"] > 0, F.abs(F.round(F.log2(acc["n"].cast("double")) - acc["s"] / acc["n"], 4))).otherwise(0.0),
    )


def summed_histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (group, content) to one row per batch and group: the counts of its byte values; null where no content is."""
    import pandas as pd

    for batch in batches:
        group, content = batch.columns
        totals: dict[object, np.ndarray | None] = {}
        for key, raw in zip(batch[group], batch[content], strict=True):
            total = totals.setdefault(None if pd.isna(key) else key, None)
            if raw is not None:
                counts = _counts(raw)
                totals[None if pd.isna(key) else key] = counts if total is None else total + counts
        yield pd.DataFrame({group: list(totals), "histogram": list(totals.values())})
