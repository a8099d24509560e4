"""Package name and version, and the status that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsift.config import ScanConfig
from sigsift.functions import paths
from sigsift.functions import text as tx
from sigsift.operators.inventory import EXCLUDED

# Header formats and messages.
CODE_NAME = r"\.(?:php|inc|module)$"
NAME_LINE = r"(?imdU)^[ \t/*#@]*Plugin Name:\s*(.+?)\s*$"
VERSION_LINE = r"(?imdU)^[ \t/*#@]*(?:Version|Stable tag):\s*(.+?)\s*$"
README_TITLE = r"(?dU)^===\s*([^=\n]+?)\s*===$"
INVALID_PACKAGE = (
    "Invalid WordPress plugin: could not find a valid readme.txt header or PHP Plugin Name header."
)
NO_FILES = "No scannable files found in the target."
INVALID_ARCHIVE = "Invalid ZIP archive: The file is not a valid or readable ZIP."
BAD_TARGET = "Target must be a directory or a valid .zip file."
EXTRACT_FAILED = "Failed to extract ZIP: "
FATAL_STARTS = (
    "Invalid WordPress plugin:", "Invalid ZIP archive:", "Failed to extract ZIP:", "No scannable files found", BAD_TARGET,
)


def is_fatal(message: Column) -> Column:
    test = F.lit(False)
    for start in FATAL_STARTS:
        test = test | F.startswith(message, F.lit(start))
    return test


def _readme_title(head: Column) -> Column:
    lines = F.transform(
        F.split(head, tx.BREAK, -1), lambda line: tx.strip(F.regexp_replace(line, f"^{tx.BOM}+", ""))
    )
    first = F.get(F.filter(lines, lambda line: line != ""), F.lit(0))
    return F.regexp_replace(tx.strip(F.regexp_extract(first, README_TITLE, 1)), f"(?U){tx.SPACE}+", " ")


def may_name_package(path: Column) -> Column:
    name = paths.file_name(path)
    return (name == "readme.txt") | F.lower(name).rlike(CODE_NAME)


def with_claim(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Adds ``claim``: what a file says about its package, null for a file that has no say.

    ``rank`` orders claims: readmes before code, then shallow before deep, then by
    path.
    """
    readme = paths.file_name(F.col("path")) == "readme.txt"
    head = F.when(may_name_package(F.col("path")), tx.decode(F.col("content"), config.header_bytes, config.nul_probe_bytes))
    title = F.when(readme, F.nullif(_readme_title(F.col("head")), F.lit("")))
    named = F.contains(F.lower("head"), F.lit("plugin name:")) & F.col("head").rlike(NAME_LINE)
    rank = F.struct(
        F.when(readme, 0).otherwise(1).alias("kind"), paths.depth(F.col("path")).alias("depth"), F.col("path").alias("path")
    )
    name = F.when(readme, F.col("title")).otherwise(tx.strip(F.regexp_extract("head", NAME_LINE, 1)))
    version = tx.strip(F.regexp_extract("head", VERSION_LINE, 1))
    has_say = F.when(readme, F.col("title").isNotNull()).otherwise(named)
    claim = F.when(has_say, F.struct(rank.alias("rank"), name.alias("name"), version.alias("version")))
    return files.withColumn("head", head).withColumn("title", title).withColumn("claim", claim).drop("head", "title")


def best_claims(claims: DataFrame) -> DataFrame:
    """The winning claim per package from ``(scan_id, claim)``.

    Files without a claim fall away first.  ``min_by`` keeps one claim per package
    and task before the shuffle, so a package with a third of all files costs no
    more than any other.
    """
    return (
        claims.where("claim IS NOT NULL").groupBy("scan_id")
        .agg(F.min_by("claim", "claim.rank").alias("best"))
        .select(
            "scan_id",
            F.col("best.name").alias("plugin_name"),
            F.col("best.version").alias("plugin_version"),
            F.col("best.rank.path").alias("source_path"),
        )
        .where(F.col("plugin_name") != "")
    )


def package_metadata(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Name and version of every package that has a valid header."""
    likely = files.where(~paths.under_any(F.col("path"), config.excluded) & may_name_package(F.col("path")))
    return best_claims(with_claim(likely, config).select("scan_id", "claim"))


def scan_status(facts: DataFrame, target: Column | None = None) -> DataFrame:
    """One row per package: name, version, file counts, message (null when fine) and fatal flag.

    ``facts`` has scan_id, reason and claim of every file.  A package without a
    name of its own has that of ``target``, by default its scan_id.
    """
    listed = F.col("reason").isNotNull() & (F.col("reason") != EXCLUDED)
    counts = facts.groupBy("scan_id").agg(F.count_if(F.col("reason").isNull()).alias("files_found"), F.count_if(listed).alias("files_skipped"))
    joined = counts.join(best_claims(facts.select("scan_id", "claim")), "scan_id", "left")
    message = F.when(F.col("plugin_name").isNull(), INVALID_PACKAGE).when(F.col("files_found") == 0, NO_FILES)
    stated = joined.withColumn("message", message).withColumn("fatal", F.coalesce(is_fatal(F.col("message")), F.lit(False)))
    return stated.withColumn("display_name", display_name(F.col("plugin_name"), F.col("scan_id") if target is None else target))


def display_name(name: Column, target: Column) -> Column:
    """Metadata name, else the archive's stem, else the last part of the target."""
    base = paths.file_name(target)
    stem = F.when(F.lower(base).endswith(".zip"), F.substring(base, F.lit(1), F.length(base) - 4)).otherwise(base)
    return F.coalesce(F.nullif(name, F.lit("")), stem)


def report_slug(name: Column, default: str = "report") -> Column:
    """File-name-safe form of a package name."""
    dashed = F.regexp_replace(F.lower(tx.strip(name)), "[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^[-._]+|[-._]+\\z", ""), F.lit("")), F.lit(default))


def known(version: Column) -> Column:
    return F.coalesce(F.nullif(version, F.lit("")), F.lit("unknown"))
