"""Continuous scans of a landing folder.

A scan is stateless per file, so the batch plan runs on a stream as it is.
State is kept only for running grades (one row per package), for the counts of
each file's last version, for re-delivered content and for findings that wait for
their package's name (both within the watermark), and for windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigsift.config import MAX_ARCHIVE_BYTES, ScanConfig
from sigsift.operators import metadata, summary
from sigsift.plans.scan import explode_findings, scan_files
from sigsift.sources import archives

UPLOADS = ScanConfig(deep=True, max_archive_bytes=MAX_ARCHIVE_BYTES)
FILES_SCHEMA = "scan_id string, path string, length bigint, content binary, arrived timestamp"


def landing_tables(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of parquet tables of files with their arrival time."""
    reader = spark.readStream.schema(FILES_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def landing_archives(spark: SparkSession, folder: str, config: ScanConfig = UPLOADS) -> tuple[DataFrame, DataFrame]:
    """Streams (files, errors) from archives dropped into a folder; a refused archive is an error row.

    Uploads are scanned deeply, and refused above a size, by default: see ``UPLOADS``.
    """
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .load(folder)
    )
    return archives.expand(archives.as_archives(raw, folder), config)


def once(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop a file that arrives again unchanged within ``delay``."""
    return (
        files.withColumn("sha256", F.sha2("content", 256))
        .withWatermark("arrived", delay)
        .dropDuplicatesWithinWatermark(["scan_id", "path", "sha256"])
        .drop("sha256")
    )


def stream_findings(files: DataFrame, config: ScanConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of a stream of files, for an append sink; columns named in ``keep`` stay."""
    return explode_findings(scan_files(files, config, keep=keep), config, keep)


def stream_facts(files: DataFrame, config: ScanConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row of facts per file of a stream, findings included; columns named in ``keep`` stay."""
    return scan_files(files, config, keep=keep)


def findings_of_valid(files: DataFrame, config: ScanConfig, names: DataFrame, delay: str = "1 day") -> DataFrame:
    """Findings of a stream of files of packages that a file of ``names`` names, for an append sink.

    ``names`` is the same stream, read a second time.  A finding waits for its
    package's name, and a name for findings, as long as ``delay``; a finding
    whose package is named later or never is left out.  Each comes out once, however
    many files name the package.
    """
    found = stream_findings(files, config, ("arrived",)).withWatermark("arrived", delay)
    listed = metadata.with_claim(names.where(metadata.may_name_package(F.col("path"))), config)
    named = listed.where("claim.name <> ''").select(F.col("scan_id").alias("_named"), F.col("arrived").alias("_at")).withWatermark("_at", delay)
    near = F.expr(f"_at >= arrived - INTERVAL {delay} AND _at <= arrived + INTERVAL {delay}")
    return found.join(named, (F.col("scan_id") == F.col("_named")) & near, "left_semi")


COUNTED = (*summary.COUNTS.values(), "total", "suppressed", "penalty")


def file_counts(facts: DataFrame) -> DataFrame:
    """(scan_id, path, arrived, *COUNTED) of facts that keep ``arrived``: what a file adds to its package."""
    number = lambda test: F.size(F.filter("findings", test)).cast("bigint")
    active = lambda f: ~f["false_positive"]
    of_level = lambda level: lambda f: active(f) & (f["severity"] == level)
    points = F.aggregate(F.filter("findings", active), F.lit(0).cast("bigint"), lambda acc, f: acc + summary.penalty(f["severity"]))
    counts = {name: number(of_level(level)) for level, name in summary.COUNTS.items()}
    counts |= {"total": number(active), "suppressed": number(lambda f: f["false_positive"]), "penalty": points}
    return facts.select("scan_id", "path", "arrived", *[c.alias(n) for n, c in counts.items()])


def last_counts(counts: DataFrame) -> DataFrame:
    """The counts of each file's last version, for an update sink; what goes out takes the place of what went out before.

    A version that arrives out of order changes nothing; of versions that arrive
    together the one with the higher counts is the last, whatever their order.
    """
    last = counts.groupBy("scan_id", "path").agg(F.max(F.struct("arrived", *COUNTED)).alias("last"))
    return last.select("scan_id", "path", *[F.col(f"last.{c}").alias(c) for c in COUNTED])


def changes(counts: DataFrame) -> DataFrame:
    """What each new version of a file changes in its package's counts, for an update sink.

    The state of a file is its last version's counts; a version that arrives
    later takes the place of the one before, so what goes out is the difference.
    One that arrives out of order changes nothing.  Summed up by package the
    changes are the counts of the last versions.  A call of Python for every file
    takes milliseconds; ``last_counts`` needs none, for sinks that can replace rows.
    """
    state = "arrived timestamp, " + ", ".join(f"{c} bigint" for c in COUNTED)

    def replace(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        new = None
        for batch in batches:
            last = batch.sort_values(["arrived", *COUNTED]).iloc[-1]
            if new is None or tuple(last[["arrived", *COUNTED]]) > tuple(new[["arrived", *COUNTED]]):
                new = last
        old = kept.get if kept.exists else None
        if new is None or (old is not None and pd.Timestamp(old[0]) > new["arrived"]):
            return
        values = [int(new[c]) for c in COUNTED]
        kept.update((new["arrived"].to_pydatetime(), *values))
        before = old[1:] if old is not None else [0] * len(values)
        yield pd.DataFrame([[*key, *(a - b for a, b in zip(values, before, strict=True))]], columns=["scan_id", "path", *COUNTED])

    out = "scan_id string, path string, " + ", ".join(f"{c} bigint" for c in COUNTED)
    return counts.groupBy("scan_id", "path").applyInPandasWithState(replace, out, state, "update", GroupStateTimeout.NoTimeout)


def regraded(changed: DataFrame) -> DataFrame:
    """Counts, score and grade per package from all changes so far, or from the counts of all files."""
    sums = changed.groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in COUNTED])
    scored = sums.withColumn("score", F.greatest(F.lit(0), 100 - F.col("penalty")))
    return scored.withColumn("grade", summary.grade(F.col("score")))


def running_grades(facts: DataFrame) -> DataFrame:
    """Counts, score and grade per package so far, for an update sink; a package without findings scores 100.

    A file that arrives twice counts twice: ``once`` comes first where that happens.
    """
    found = facts.select("scan_id", F.explode_outer("findings").alias("f")).select("scan_id", "f.severity", "f.false_positive")
    counts = summary.severity_counts(found)
    scored = counts.withColumn("score", F.greatest(F.lit(0), 100 - F.col("penalty")))
    return scored.withColumn("grade", summary.grade(F.col("score")))


def running_status(facts: DataFrame) -> DataFrame:
    """Name, scanned files and validity per package so far, for an update sink."""
    best = facts.groupBy("scan_id").agg(
        F.min_by("claim", "claim.rank").alias("best"), F.count_if(F.col("reason").isNull()).alias("files_scanned")
    )
    name = F.nullif("best.name", F.lit(""))
    message = F.when(name.isNull(), metadata.INVALID_PACKAGE).when(F.col("files_scanned") == 0, metadata.NO_FILES)
    return best.select(
        "scan_id", name.alias("plugin_name"), F.col("best.version").alias("plugin_version"), "files_scanned", message.alias("message"),
        F.coalesce(metadata.is_fatal(message), F.lit(False)).alias("fatal"),
    )


def sliding(findings: DataFrame, length: str = "2 hours", every: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Active findings per package in windows of arrival that overlap; one that is later than ``delay`` is left out."""
    active = findings.where(~F.col("false_positive")).withWatermark("arrived", delay)
    counted = active.groupBy(F.window("arrived", length, every), "scan_id").agg(F.count(F.lit(1)).alias("findings"))
    return counted.select("scan_id", F.col("window.start").alias("from_time"), F.col("window.end").alias("to_time"), "findings")


def sessions(findings: DataFrame, gap: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Active findings per package and session: arrivals with less than ``gap`` between them; one later than ``delay`` is left out."""
    active = findings.where(~F.col("false_positive")).withWatermark("arrived", delay)
    counted = active.groupBy(F.session_window("arrived", gap), "scan_id").agg(F.count(F.lit(1)).alias("findings"))
    return counted.select("scan_id", F.col("session_window.start").alias("from_time"), F.col("session_window.end").alias("to_time"), "findings")


def arrivals(files: DataFrame, findings_window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Files per package and window of arrival."""
    return (
        files.withWatermark("arrived", delay)
        .groupBy(F.window("arrived", findings_window), "scan_id")
        .agg(F.count(F.lit(1)).alias("files"))
        .select("scan_id", F.col("window.start").alias("from_time"), "files")
    )
