"""JSON and Markdown reports as ordered pieces of bounded size.

A package may have any number of findings, so its report is never gathered
into one value.  Pieces sorted by their keys and joined by line ends are the
document; the writer below lays them out that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsift.catalog import SEVERITY_COLORS
from sigsift.functions import paths
from sigsift.functions import text as tx
from sigsift.operators.metadata import known
from sigsift.session import pin

FINDINGS_PER_PIECE = 500
# Layout of the Markdown report.
MARKDOWN_HEAD = """# Security Report — %s

- **Version:** %s
- **Path:** %s
- **Grade:** %s
- **Scan mode:** %s

## Summary
- Critical: %s
- High: %s
- Medium: %s
- Low: %s
- Total findings: %s
- Files scanned: %s
- Lines analyzed: %s

## Findings"""
MARKDOWN_NOTHING = "\nNo findings were detected.\n"
MARKDOWN_FINDING = """### %s. %s — %s
- Severity: %s
- File: %s:%s:%s
- Confidence: %s
- Description: %s"""
MARKDOWN_FILE = "- `%s` (%s, %s lines, entropy %s)"


def _json(column: Column) -> Column:
    return F.to_json(column, {"ignoreNullFields": "false"})


def json_finding() -> Column:
    return F.struct(
        F.col("rule_id").alias("id"),
        "title",
        F.col("severity_label").alias("severity"),
        F.col("path").alias("file"),
        F.col("line_number").alias("line"),
        F.col("line_content").alias("code"),
        "cwe",
        "description",
        "impact",
        "recommendation",
        "false_positive",
        "ai_analysis",
    )


def json_report(packages: DataFrame, numbered: DataFrame, errors: DataFrame, per_piece: int = FINDINGS_PER_PIECE) -> DataFrame:
    """Pieces ``(scan_id, section, piece, text)`` of one JSON document per package.

    ``packages`` has one row per package with grade and counts, ``numbered`` the
    findings with their ordinal.  Sections: head, findings, end of findings,
    errors, end.
    """
    head = F.struct(
        "plugin_name",
        known(F.col("plugin_version")).alias("plugin_version"),
        F.col("scan_id").alias("plugin_path"),
        "grade",
        "scan_mode",
        "ai_enabled",
        F.struct("total", "critical", "high", "medium", "low", "info").alias("summary"),
        "files_scanned",
    )
    opening = F.regexp_replace(_json(head), r"\}$", ',"findings":[')
    heads = packages.select("scan_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("piece"), opening.alias("text"))
    ends = packages.select(
        "scan_id", F.explode(F.array(F.struct(F.lit(2).alias("section"), F.lit('],"errors":[').alias("text")),
                                     F.struct(F.lit(4).alias("section"), F.lit("]}").alias("text")))).alias("e")
    ).select("scan_id", "e.section", F.lit(0).cast("bigint").alias("piece"), "e.text")
    piece = F.floor((F.col("ordinal") - 1) / per_piece)
    findings = _pieces(numbered.withColumn("piece", piece).withColumn("at", F.col("ordinal")), json_finding(), 1)
    problems = (
        errors.where(F.col("scan_id").isNotNull())
        .groupBy("scan_id", "message").agg(F.count(F.lit(1)).alias("n"))
        .select("scan_id", F.lit(3).alias("section"), F.lit(0).cast("bigint").alias("piece"), "message")
    )
    told = problems.groupBy("scan_id", "section", "piece").agg(F.array_sort(F.collect_set("message")).alias("m"))
    told = told.select("scan_id", "section", "piece", F.regexp_replace(_json(F.col("m")), r"^\[|\]$", "").alias("text"))
    return heads.unionByName(findings).unionByName(ends).unionByName(told)


def _pieces(rows: DataFrame, value: Column, section: int) -> DataFrame:
    """Array elements grouped into pieces; every piece but the first starts with a comma."""
    grouped = (
        rows.select("scan_id", "piece", F.struct("at", _json(value).alias("text")).alias("x"))
        .groupBy("scan_id", "piece")
        .agg(F.array_sort(F.collect_list("x")).alias("xs"))
    )
    joined = F.array_join(F.transform("xs", lambda x: x["text"]), ",")
    return grouped.select(
        "scan_id", F.lit(section).alias("section"), "piece",
        F.when(F.col("piece") > 0, F.concat(F.lit(","), joined)).otherwise(joined).alias("text"),
    )


def _piece(section: int, text: Column, piece: Column | None = None, path: Column | None = None) -> list[Column]:
    """The columns of one piece of a Markdown report."""
    return [
        F.col("scan_id"),
        F.lit(section).alias("section"),
        (F.lit(0) if piece is None else piece).cast("bigint").alias("piece"),
        (F.lit("") if path is None else path).alias("path"),
        text.alias("text"),
    ]


def markdown_report(packages: DataFrame, numbered: DataFrame, file_info: DataFrame, errors: DataFrame) -> DataFrame:
    """Pieces ``(scan_id, section, piece, path, text)``: summary, findings, files, errors."""
    head = F.format_string(
        MARKDOWN_HEAD, "plugin_name", known(F.col("plugin_version")), "scan_id", "grade", "scan_mode", "critical", "high", "medium", "low",
        "total", "files_scanned", "lines_analyzed",
    )
    nothing = F.when(F.col("total") + F.col("suppressed") == 0, F.lit(MARKDOWN_NOTHING)).otherwise("")
    top = packages.select(*_piece(0, F.concat(head, nothing)))
    def optional(name: str, title: str) -> Column:
        return F.when(F.col(name) != "", F.concat(F.lit(f"- {title}: "), F.col(name)))

    code = F.when(
        F.col("line_content") != "",
        F.concat_ws("\n", F.lit("\n```"), F.concat(F.col("context_before"), F.array("line_content"), F.col("context_after")), F.lit("```")),
    )
    facts = F.format_string(
        MARKDOWN_FINDING, "ordinal", "rule_id", "title", "severity_label", "path", "line_number", "match_column", "confidence", "description"
    )
    body = F.concat_ws("\n", facts, optional("impact", "Impact"), optional("recommendation", "Recommendation"), code, F.lit(""))
    found = numbered.select(*_piece(1, body, F.col("ordinal"), F.col("path")))
    titles = packages.where(F.col("files_scanned") > 0).select(*_piece(2, F.lit("## Files Scanned")))
    line = F.format_string(MARKDOWN_FILE, "path", "language", "lines", tx.fixed(F.col("entropy"), 2))
    listed = file_info.select(*_piece(3, line, path=F.col("path")))
    told = errors.where(F.col("scan_id").isNotNull())
    trouble_title = told.select("scan_id").distinct().select(*_piece(4, F.lit("\n## Errors")))
    trouble = told.select(*_piece(5, F.concat(F.lit("- "), F.col("message")), path=F.coalesce("path", F.lit(""))))
    out = top
    for part in (found, titles, listed, trouble_title, trouble):
        out = out.unionByName(part)
    return out


def finding_records(findings: DataFrame) -> DataFrame:
    """Findings as flat records with everything a report shows."""
    colors = F.create_map(*[F.lit(x) for pair in SEVERITY_COLORS.items() for x in pair])
    return findings.select(
        "scan_id", "path", "rule_id", "title", "severity_label", F.col("severity").alias("severity_value"), "line_number", "match_column",
        "line_content", "context_before", "context_after", "description", "impact", "layman_fix", "step_by_step_fix",
        paths.grammar(F.col("path")).alias("language"), "cwe", F.regexp_replace("cwe", "^CWE-", "").alias("cwe_num"), "confidence",
        "recommendation", "false_positive", F.try_element_at(colors, F.col("severity")).alias("severity_color"),
        *[c for c in ("ai_analysis", "ai_confirmed") if c in findings.columns],
    )


def report_id(target: Column, run_time: Column, prefix: str = "R-") -> Column:
    """The number of a report: a prefix and a digest of what was scanned and when."""
    return F.concat(F.lit(prefix), F.upper(F.left(F.sha2(F.concat_ws(":", target, run_time), 256), F.lit(12))))


def _keys(pieces: DataFrame) -> list[str]:
    return [c for c in ("scan_id", "section", "piece", "path") if c in pieces.columns]


def write_reports(pieces: DataFrame, folder: str) -> None:
    """Write the pieces as text, one sub-folder per package, in document order.

    A large package spans several part files whose names sort in that order.  The
    pieces are kept first, for ordering them reads them twice.  For very many
    packages ``write_shelves`` makes fewer folders.
    """
    keys = _keys(pieces)
    (
        pin(pieces).repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("scan_id", F.col("text").alias("value"))
        .write.mode("errorifexists")
        .partitionBy("scan_id")
        .text(folder)
    )


SHELVES = 256


def _shelf(scan_id: Column, shelves: int) -> Column:
    return F.pmod(F.xxhash64(scan_id), F.lit(shelves)).cast("int")


def write_shelves(pieces: DataFrame, folder: str, shelves: int = SHELVES) -> None:
    """Write the reports of any number of packages as two tables: ``pieces``, at most twice as many files as shelves, and ``packages``.

    A package stands on the shelf that its hash names, its pieces in document
    order; a large package covers several files.  ``packages`` is the index: for
    each package its shelf and how many pieces and characters its report has.
    """
    keys = _keys(pieces)
    kept = pin(pieces.withColumn("shelf", _shelf(F.col("scan_id"), shelves)))
    ordered = kept.repartitionByRange(shelves, "shelf", *keys).sortWithinPartitions("shelf", *keys)
    ordered.write.mode("errorifexists").partitionBy("shelf").parquet(f"{folder}/pieces")
    index = kept.groupBy("scan_id", "shelf").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.length("text")).alias("characters"))
    index.repartitionByRange(max(1, shelves // 16), "scan_id").sortWithinPartitions("scan_id").write.mode("errorifexists").parquet(f"{folder}/packages")


def shelved(spark: SparkSession, folder: str, scan_id: str) -> DataFrame:
    """The pieces of one package's report in document order; only its shelf is read."""
    found = spark.read.parquet(f"{folder}/packages").where(F.col("scan_id") == scan_id).select("shelf").first()
    pieces = spark.read.parquet(f"{folder}/pieces")
    mine = pieces.where((F.col("shelf") == (found.shelf if found else -1)) & (F.col("scan_id") == scan_id))
    return mine.orderBy(*_keys(pieces)).select("text")
