"""File tables and directories of files.

Every source yields ``files(scan_id, path, length, content)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsift.config import MAX_BINARY, PHP_EXTENSIONS, ScanConfig
from sigsift.functions import paths

FILE_COLUMNS = ("scan_id", "path", "length", "content")


def from_table(frame: DataFrame, scan_id: Column, path: Column, text: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """Any table with a text column; ``extra`` columns ride along."""
    content = text.cast("binary")
    return frame.select(
        scan_id.cast("string").alias("scan_id"),
        path.cast("string").alias("path"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
        *extra,
    )


def _glob(config: ScanConfig) -> str:
    """Names of files that can be scanned or name their package, whatever their case."""
    endings = dict.fromkeys(config.extensions + PHP_EXTENSIONS)
    either = ["*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings]
    return "{" + ",".join([*either, "readme.txt"]) + "}"


def _read(spark: SparkSession, root: str, one_package: bool, names: str | None) -> DataFrame:
    root = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if names:
        reader = reader.option("pathGlobFilter", names)
    inside = paths.below(F.col("path"), root)
    if one_package:
        scan_id, path = F.lit(root.rsplit("/", 1)[-1]), inside
    else:
        scan_id, path = F.substring_index(inside, "/", 1), F.regexp_replace(inside, "^[^/]*/", "")
    return reader.load(root).select(scan_id.alias("scan_id"), path.alias("path"), "length", "content")


def from_directory(spark: SparkSession, root: str, config: ScanConfig, one_package: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, listing) below ``root``, whose first level holds one folder per package.

    With ``one_package`` the folder itself is the package.  ``files`` opens only
    names that can be scanned or name their package; ``listing`` has all files
    but no content.
    """
    files = _read(spark, root, one_package, _glob(config)).where(F.col("length") <= MAX_BINARY)
    return files, _read(spark, root, one_package, None).drop("content")
