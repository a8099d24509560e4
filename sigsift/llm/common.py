"""What the operators of this folder share: reading tables, words, tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """A text, the empty one for null."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of characters other than the space and the five ASCII control spaces."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def groups_of(rows: int, size: int) -> int:
    """How many groups hold ``rows`` rows when each should have about ``size``."""
    return max(1, -(-rows // size))
