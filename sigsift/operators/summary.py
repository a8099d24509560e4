"""Counts, scores, grades, rankings and corpus roll-ups over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsift.catalog import SEVERITY_PENALTY

# Lowest score of each grade, and the score reports show for it.
GRADE_FLOORS = (
    ("A+", 97), ("A", 93), ("A-", 90), ("B+", 87), ("B", 83), ("B-", 80), ("C+", 77), ("C", 73), ("C-", 70),
    ("D+", 67), ("D", 63), ("D-", 60),
)
REPORT_SCORES = {
    "A+": 100, "A": 95, "A-": 90, "B+": 85, "B": 80, "B-": 75, "C+": 70, "C": 65, "C-": 60, "D+": 55, "D": 50,
    "D-": 45, "F": 20,
}
GRADE_COLORS = {"A": "#22c55e", "B": "#3b82f6", "C": "#eab308", "D": "#f97316", "F": "#ef4444"}
# Keys that put findings into report order.
FINDING_ORDER = ("severity", "path", "line_number", "rule_ord", "match_start")
# Findings shown in the overview, token estimate.
TOP_FINDINGS = 20
TOKENS_PER_FINDING, TOKENS_PER_SCAN = 850, 1200


def order_keys() -> list[Column]:
    """Severity from high to low, then path and line, ties in catalog and text order."""
    return [F.col(c).desc() if c == "severity" else F.col(c) for c in FINDING_ORDER]


def penalty(severity: Column) -> Column:
    points = F.lit(0)
    for level, value in SEVERITY_PENALTY.items():
        points = F.when(severity == level, value).otherwise(points)
    return points


def grade(score: Column) -> Column:
    letter = F.lit("F")
    for name, floor in reversed(GRADE_FLOORS):
        letter = F.when(score >= floor, name).otherwise(letter)
    return letter


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def report_score(letter: Column) -> Column:
    return _lookup(REPORT_SCORES, letter)


def grade_color(letter: Column) -> Column:
    return _lookup(GRADE_COLORS, F.left(letter, F.lit(1)))


COUNTS = {5: "critical", 4: "high", 3: "medium", 2: "low"}


def severity_counts(findings: DataFrame) -> DataFrame:
    """Active counts and penalty per package; one partial row per package and task is shuffled."""
    active = ~F.col("false_positive")
    return findings.groupBy("scan_id").agg(
        *[F.count_if(active & (F.col("severity") == level)).alias(name) for level, name in COUNTS.items()],
        F.lit(0).cast("bigint").alias("info"),
        F.count_if(active).alias("total"),
        F.count_if(F.col("false_positive")).alias("suppressed"),
        F.sum(F.when(active, penalty(F.col("severity"))).otherwise(0)).alias("penalty"),
    )


def scan_grades(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Every package of ``scans`` with counts, score and grade; without findings it scores 100."""
    counts = severity_counts(findings)
    names = [c for c in counts.columns if c != "scan_id"]
    joined = scans.join(counts, "scan_id", "left").fillna(0, names)
    return (
        joined.withColumn("score", F.greatest(F.lit(0), 100 - F.col("penalty")))
        .withColumn("grade", grade(F.col("score")))
        .drop("penalty")
        .withColumn("grade_color", grade_color(F.col("grade")))
        .withColumn("report_score", report_score(F.col("grade")))
    )


def scan_totals(file_info: DataFrame) -> DataFrame:
    return file_info.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("files_scanned"), F.sum("lines").alias("lines_analyzed")
    )


def top_findings(findings: DataFrame, n: int = TOP_FINDINGS) -> DataFrame:
    """First n active findings per package and how many follow.

    The rank limit is applied in every task before the shuffle, so at most n rows
    per package and task move; the total comes from its own counting aggregate.
    Both read ``findings``: take them from a pinned scan.
    """
    active = findings.where(~F.col("false_positive"))
    ranked = active.withColumn("rank", F.row_number().over(Window.partitionBy("scan_id").orderBy(*order_keys())))
    totals = active.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        ranked.where(F.col("rank") <= n)
        .join(totals, "scan_id")
        .withColumn("more", F.greatest(F.col("_n") - n, F.lit(0)))
        .drop("_n")
    )


def rule_rollup(findings: DataFrame) -> DataFrame:
    """Active findings by severity and rule with subtotals."""
    return (
        findings.where(~F.col("false_positive"))
        .rollup("severity_label", "rule_id")
        .agg(
            F.count(F.lit(1)).alias("findings"),
            F.countDistinct("scan_id", "path").alias("files"),
            F.countDistinct("scan_id").alias("packages"),
        )
    )


def cwe_summary(findings: DataFrame) -> DataFrame:
    """Active findings by CWE and confidence, with both margins and the grand total."""
    return (
        findings.where(~F.col("false_positive"))
        .cube("cwe", "confidence")
        .agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("rule_id").alias("rules"))
    )


def language_rollup(findings: DataFrame) -> DataFrame:
    return (
        findings.where(~F.col("false_positive"))
        .rollup("language", "severity_label")
        .agg(F.count(F.lit(1)).alias("findings"))
    )


def review_cost(grades: DataFrame, model: str) -> DataFrame:
    """Who reviewed a package and the estimated tokens, from its counts before the review.

    Suppressed findings cost tokens too; a package without active findings is
    not reviewed.
    """
    return grades.select(
        "scan_id",
        (F.col("total") > 0).alias("ai_enabled"),
        F.lit(model).alias("ai_model"),
        ((F.col("total") + F.col("suppressed")) * TOKENS_PER_FINDING + TOKENS_PER_SCAN).alias("ai_tokens"),
    )
