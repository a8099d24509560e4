"""A scan job: files in, tables out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsift.catalog import check_rules, label, local_frame, risks, rules_frame
from sigsift.config import ScanConfig
from sigsift.functions import text as tx
from sigsift.functions.entropy import byte_counts, entropy_of
from sigsift.operators import chunked, detectors, inventory, matching, metadata, reports, summary
from sigsift.operators.ordering import with_ordinal
from sigsift.session import attach, pin


def scan_files(files: DataFrame, config: ScanConfig, listing: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row of facts per file: inventory, findings as an array, claim about the package.

    Everything is computed in one narrow pass over the content, which is read
    once and never shuffled.  Columns nobody asks for are not computed.  Files
    that are not scanned are rows too, so that all results follow from the facts.
    ``listing`` is the full file list where ``files`` leaves out content that is
    never looked at.  Columns of ``files`` named in ``keep`` stay.
    """
    scanned = F.col("reason").isNull()
    looked_at = F.coalesce(scanned | ((F.col("reason") != inventory.EXCLUDED) & metadata.may_name_package(F.col("path"))), F.lit(False))
    listed = inventory.classified(files, config)
    if listing is None:
        return _facts(listed.withColumn("content", F.when(looked_at, F.col("content"))), config, keep)
    facts = _facts(listed.where(looked_at), config, keep)
    others = inventory.classified(listing, config).where(~looked_at).withColumn("size", F.col("length"))
    absent = [F.col(f.name) if f.name in others.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema]
    return facts.unionByName(others.select(*absent))


def _facts(listed: DataFrame, config: ScanConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    scanned = F.col("reason").isNull()
    wanted = metadata.with_claim(listed, config)
    body = wanted.withColumn("content", F.when(scanned, F.col("content")))
    counted = body.withColumn("entropy", entropy_of(byte_counts(F.col("content"))))
    placed = matching.with_places(counted, config)
    heuristic = detectors.heuristic()
    pointed = (
        detectors.with_signals(placed).withColumn("points", heuristic["score"]).withColumn("signals", heuristic["signals"])
    )
    # lines are cut only where a finding stands among them
    needs_lines = F.lit(config.wide_lines > 0) | (F.size("places") > 0) | (F.coalesce("points", F.lit(0)) >= detectors.HIGH_SCORE)
    scored = pointed.withColumn("file_lines", F.when(needs_lines, tx.line_texts(F.col("text"))))
    parts = [
        matching.catalog_matches(config), detectors.heuristic_matches(config), detectors.entropy_matches(config),
    ]
    return scored.select(
        "scan_id",
        "path",
        "extension",
        "language",
        "reason",
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        F.coalesce(tx.line_count(F.col("text")), F.lit(0)).alias("lines"),
        "entropy",
        F.when(scanned & (F.col("language") == "php"), F.col("points")).alias("score"),
        "signals",
        "claim",
        matching.notes(config).alias("notes"),
        F.concat(*[F.coalesce(p, F.array().cast(matching.MATCH_TYPE)) for p in parts]).alias("findings"),
        *keep,
    )


FILE_INFO = ("scan_id", "path", "extension", "language", "size", "sha256", "lines", "entropy")


def rule_details(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """The rules table plus a row for each detector outside the catalog."""
    rules = rules_frame(spark, config.rules).drop("pattern", "languages", "literals", "fp_patterns", "severity", "severity_label")
    extra = [
        (o, i, title, cwe, confidence, "", impact, "", [], recommendation)
        for o, i, title, cwe, confidence, impact, recommendation in detectors.DETECTOR_ROWS
    ]
    return rules.unionByName(local_frame(spark, extra, rules.schema))


def findings_of_parts(parts: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """The findings of files that come in parts (``sources.parts``), as ``ScanTables.all_findings`` has them for whole files."""
    config = config or ScanConfig()
    named = parts.withColumn("length", F.lit(1))
    wanted = inventory.inventory(named, config).where("reason IS NULL").select("scan_id", "path", "part", "content", "language")
    return explode_findings(chunked.file_findings(wanted, config), config)


def severity_label(severity: Column) -> Column:
    text = F.lit(None).cast("string")
    for level in (2, 3, 4, 5):
        text = F.when(severity == level, label(level)).otherwise(text)
    return text


def explode_findings(scanned: DataFrame, config: ScanConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings as rows, with the attributes of their rules and the columns of ``scanned`` named in ``keep``.

    The rules come from the catalog in the configuration, a few hundred short
    rows whatever the data, hence the broadcast.
    """
    # explode() would let the optimizer infer a filter on the array and push a second copy of
    # the whole computation below it; the outer form does not.
    opened = scanned.select("scan_id", "path", "language", *keep, F.explode_outer("findings").alias("f"))
    rows = opened.where(F.col("f").isNotNull()).select("scan_id", "path", "language", *keep, "f.*")
    details = rule_details(scanned.sparkSession, config)
    return (
        rows.join(F.broadcast(details), "rule_ord")
        .withColumn("severity_label", severity_label(F.col("severity")))
        .withColumn("description", F.coalesce("detail", "description"))
        .drop("detail")
    )


@dataclass
class ScanTables:
    """The tables of a scan.

    All are lazy views of ``facts``, one row per file.  A job that wants several
    of them calls ``pinned`` first: content is then read once for all.
    """

    facts: DataFrame
    config: ScanConfig
    archive_errors: DataFrame | None = None
    kept: bool = False

    def pinned(self) -> "ScanTables":
        """Keep the facts, findings included, as a table in the shared folder."""
        return self if self.kept else ScanTables(pin(self.facts), self.config, self.archive_errors, True)

    @cached_property
    def scanned(self) -> DataFrame:
        return self.facts.where(F.col("reason").isNull())

    @cached_property
    def packages(self) -> DataFrame:
        """Name and version of every valid package."""
        return metadata.best_claims(self.facts.select("scan_id", "claim"))

    @cached_property
    def status(self) -> DataFrame:
        return metadata.scan_status(self.facts)

    @cached_property
    def scans(self) -> DataFrame:
        """Packages that were scanned."""
        return self.status.where(~F.col("fatal")).select("scan_id", "plugin_name", "plugin_version")

    def _of_valid(self, rows: DataFrame, *spread_by: str) -> DataFrame:
        return attach(rows, self.packages.select("scan_id"), "scan_id", list(spread_by), "left_semi")

    @cached_property
    def file_info(self) -> DataFrame:
        return self._of_valid(self.scanned.select(*FILE_INFO), "path")

    @cached_property
    def skipped(self) -> DataFrame:
        """Files that were not scanned, each with the reason; files below excluded directories are not listed."""
        listed = F.col("reason").isNotNull() & (F.col("reason") != inventory.EXCLUDED)
        return self._of_valid(self.facts.where(listed).select("scan_id", "path", "reason"), "path")

    @cached_property
    def all_findings(self) -> DataFrame:
        """Findings of every package, valid or not."""
        return explode_findings(self.facts, self.config)

    @cached_property
    def findings(self) -> DataFrame:
        return self._of_valid(self.all_findings, "path", "rule_ord")

    @cached_property
    def scan_errors(self) -> DataFrame:
        """Package, archive and rule problems; rule problems concern no single package."""
        spark = self.facts.sparkSession
        problems = [(None, None, m, False) for m in (*check_rules(self.config.rules), *risks(self.config.rules))]
        rules = spark.createDataFrame(problems, "scan_id string, path string, message string, fatal boolean")
        errors = self.status.where(F.col("message").isNotNull()).select(
            "scan_id", F.lit(None).cast("string").alias("path"), "message", "fatal"
        ).unionByName(rules)
        if self.config.cuts:
            noted = self.facts.select("scan_id", "path", F.explode_outer("notes").alias("message"), F.lit(False).alias("fatal"))
            errors = errors.unionByName(noted.where(F.col("message").isNotNull()))
        return errors.unionByName(self.archive_errors) if self.archive_errors is not None else errors

    @cached_property
    def grades(self) -> DataFrame:
        return summary.scan_grades(self.scans, self.findings)

    @cached_property
    def reported(self) -> tuple[DataFrame, DataFrame]:
        """What both reports are made of: packages with their totals, findings with their numbers."""
        totals = summary.scan_totals(self.file_info)
        packages = (
            self.grades.join(totals, "scan_id", "left").fillna(0, ["files_scanned", "lines_analyzed"])
            .withColumn("scan_mode", F.lit(self.config.mode)).withColumn("ai_enabled", F.lit(False))
        )
        numbered = with_ordinal(self.findings, "scan_id", summary.order_keys(), "ordinal")
        return packages, numbered.withColumn("ai_analysis", F.lit(None).cast("string"))

    @cached_property
    def json_report(self) -> DataFrame:
        """The pieces of each package's JSON document."""
        return reports.json_report(*self.reported, self.scan_errors.where("NOT fatal"))

    @cached_property
    def markdown_report(self) -> DataFrame:
        """The pieces of each package's Markdown document."""
        return reports.markdown_report(*self.reported, self.file_info, self.scan_errors.where("NOT fatal"))

    def write(self, folder: str, with_reports: bool = True) -> None:
        """Write the result tables, and the reports' pieces, below ``folder`` as parquet; content is read once for all of them."""
        tables = self.pinned()
        for name in ("file_info", "skipped", "findings", "grades", "scan_errors", *(("json_report", "markdown_report") if with_reports else ())):
            getattr(tables, name).write.mode("errorifexists").parquet(f"{folder}/{name}")


def scan(
    files: DataFrame, config: ScanConfig | None = None, listing: DataFrame | None = None, archive_errors: DataFrame | None = None
) -> ScanTables:
    """Scan ``files(scan_id, path, length, content)``.

    ``listing`` is the full file list where ``files`` leaves out content that is
    never scanned; by default ``files`` itself.
    """
    config = config or ScanConfig()
    return ScanTables(scan_files(files, config, listing), config, archive_errors)
