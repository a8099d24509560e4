"""Which files are scanned and which are skipped, decided from path and size alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsift.config import BINARY_EXTENSIONS, MAX_BINARY, ScanConfig
from sigsift.functions import paths
from sigsift.functions import text as tx


#: The reason of files below excluded directories, which are neither scanned nor skipped.
EXCLUDED = "excluded directory"


def _reason(config: ScanConfig) -> Column:
    ext = F.col("extension")
    return (
        F.when(ext.isin(*BINARY_EXTENSIONS), "binary extension")
        .when(~ext.isin(*config.extensions), "extension not included")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") > MAX_BINARY, "file too large to be one value")
        .when(F.col("length") > config.max_bytes, "file too large")
    )


def _named(files: DataFrame) -> DataFrame:
    named = files.withColumn("extension", paths.extension(F.col("path")))
    return named.withColumn("language", paths.language(F.col("extension")))


def inventory(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Files outside excluded directories, with extension, language and skip reason (null: scanned).

    Only ``path`` and ``length`` feed the decision, so content that is not asked
    for later is never read.
    """
    return _named(files.where(~paths.under_any(F.col("path"), config.excluded))).withColumn("reason", _reason(config))


def classified(files: DataFrame, config: ScanConfig) -> DataFrame:
    """All files, those below excluded directories with the reason ``EXCLUDED``."""
    below = paths.under_any(F.col("path"), config.excluded)
    return _named(files).withColumn("reason", F.when(below, F.lit(EXCLUDED)).otherwise(_reason(config)))


def scannable(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Scanned files.  The size test stands first and alone so that a file source can push it down."""
    sized = files.where((F.col("length") > 0) & (F.col("length") <= config.max_bytes))
    return inventory(sized, config).where(F.col("reason").isNull()).drop("reason")


def skipped(files: DataFrame, config: ScanConfig) -> DataFrame:
    return inventory(files, config).where(F.col("reason").isNotNull()).select("scan_id", "path", "reason")


def excluded(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Files below excluded directories: neither scanned nor skipped."""
    return files.where(paths.under_any(F.col("path"), config.excluded)).select("scan_id", "path")


def language_counts(files: DataFrame, config: ScanConfig) -> DataFrame:
    return (
        scannable(files, config)
        .groupBy("language")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )


def size_display(size: Column) -> Column:
    """Size as reports print it."""
    kilo = F.concat(tx.fixed(size / 1024, 1), F.lit(" KB"))
    return F.when(size >= 1024, kilo).otherwise(F.concat(size.cast("string"), F.lit(" B")))
