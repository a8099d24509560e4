"""Second opinions on findings: prompts out as a table, responses in as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsift.config import REVIEW_BATCH
from sigsift.functions.text import strip
from sigsift.operators.ordering import with_ordinal
from sigsift.operators.summary import order_keys

# The labels that answers are read by.
HEADER_FORMAT = (
    "FINDING <its number>:\n"
    "VERDICT: TRUE_POSITIVE or FALSE_POSITIVE\n"
    "SEVERITY: one of CRITICAL, HIGH, MEDIUM, LOW, INFO\n"
    "ANALYSIS: your reason, in one line\n\n"
)
BATCH_FORMAT = "Below are %s places that signatures point to. Judge each by its code. Use one block per place, in this form:\n" + HEADER_FORMAT + "%s"
BLOCK_FORMAT = """[FINDING %s] %s %s
level %s, weakness %s, at %s line %s
what the rule says: %s
code, the place marked with ">>>":
%s
>>> %s
%s
[end]
"""
WIDE_FORMAT = """Is this place a real weakness? Judge it by the code around it.

rule: %s %s
level: %s
place: %s line %s
weakness: %s
what the rule says: %s

the place, marked with ">>>":
%s
>>> %s
%s

lines %s to %s of the file:
%s
[end]
"""
NO_CONTEXT = "(nothing)"
BLOCK_START = r"(?iU)FINDING\s+\d+\s*:"
BLOCK_NUMBER = r"(?iU)FINDING\s+(\d+)\s*:"
VERDICT = r"(?iU)VERDICT\s*:\s*(TRUE_POSITIVE|FALSE_POSITIVE)"
ANALYSIS = r"(?isU)ANALYSIS\s*:\s*(.+?)(?:\n|\z)"
NO_ANSWER = "AI analysis unavailable for this finding."
ERROR_START = "AI error: "
WIDE_LINES = 50


def batches(findings: DataFrame, size: int = REVIEW_BATCH) -> DataFrame:
    """Active findings with batch number and position, in report order."""
    numbered = with_ordinal(findings.where(~F.col("false_positive")), "scan_id", order_keys(), "ordinal")
    index = F.col("ordinal") - 1
    return numbered.withColumn("batch_no", F.floor(index / size).cast("int")).withColumn(
        "pos", (index % size + 1).cast("int")
    )


def _text(lines: str) -> Column:
    return F.array_join(lines, "\n")


def prompts(batched: DataFrame) -> DataFrame:
    """One prompt per batch; a group holds one batch, never a package."""
    block = F.format_string(
        BLOCK_FORMAT, "pos", "rule_id", "title", "severity_label", "cwe", "path", "line_number", "description",
        _text("context_before"), "line_content", _text("context_after"),
    )
    blocks = batched.select("scan_id", "batch_no", F.struct("pos", block.alias("text")).alias("b"))
    grouped = blocks.groupBy("scan_id", "batch_no").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    body = F.array_join(F.transform("bs", lambda b: b["text"]), "\n")
    return grouped.select(
        "scan_id", "batch_no", F.size("bs").alias("findings"), F.format_string(BATCH_FORMAT, F.size("bs"), body).alias("prompt")
    )


def wide_prompts(findings: DataFrame) -> DataFrame:
    """One prompt per finding with up to 50 lines either side.

    The findings come from a scan with ``wide_lines=WIDE_LINES``: the lines were
    cut out where the file was read, so files and findings need not meet again.
    """
    def near(lines: str) -> Column:
        return F.when(F.size(lines) > 0, _text(lines)).otherwise(NO_CONTEXT)

    prompt = F.format_string(
        WIDE_FORMAT, "rule_id", "title", "severity_label", "path", "line_number", "cwe", "description", near("context_before"),
        "line_content", near("context_after"), "wide.first_line", "wide.last_line", "wide.text",
    )
    return findings.select(
        "scan_id", "path", "rule_id", "match_start", F.col("wide.first_line").alias("first_line"),
        F.col("wide.last_line").alias("last_line"), prompt.alias("prompt"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Verdicts ``(scan_id, batch_no, pos, verdict, ai_confirmed, ai_analysis)`` from responses.

    A block counts for the number it states, so text before the first block
    shifts nothing.  Of blocks with the same number the first counts; empty
    blocks do not.
    """
    usable = responses.where(F.col("error").isNull())
    cut = usable.select(
        "scan_id",
        "batch_no",
        F.explode_outer(
            F.arrays_zip(
                F.regexp_extract_all("response", F.lit(BLOCK_NUMBER), 1).alias("pos"),
                F.slice(F.split("response", BLOCK_START, -1), F.lit(2), F.size(F.split("response", BLOCK_START, -1))).alias("block"),
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count("response", F.lit(BLOCK_START)))).alias("at"),
            )
        ).alias("b"),
    )
    blocks = cut.select(
        "scan_id", "batch_no", F.try_to_number(F.col("b.pos"), F.lit("999999999")).cast("int").alias("pos"),
        strip(F.col("b.block")).alias("block"), F.col("b.at").alias("at"),
    ).where(F.col("pos").isNotNull() & (F.col("block") != ""))
    first = blocks.groupBy("scan_id", "batch_no", "pos").agg(F.min_by("block", "at").alias("block"))
    verdict = F.nullif(F.upper(F.regexp_extract("block", VERDICT, 1)), F.lit(""))
    told = F.col("block").rlike(ANALYSIS)
    analysis = F.when(told, strip(F.regexp_extract("block", ANALYSIS, 1))).otherwise(F.col("block"))
    return first.select(
        "scan_id", "batch_no", "pos", verdict.alias("verdict"),
        (verdict == "TRUE_POSITIVE").alias("ai_confirmed"), analysis.alias("ai_analysis"),
    )


def apply_verdicts(findings: DataFrame, batched: DataFrame, responses: DataFrame) -> DataFrame:
    """All findings after review.

    A false-positive verdict suppresses; nothing is ever un-suppressed.  A
    failed batch notes its error and changes no flag.  Findings that were
    suppressed before have not been asked about and stay as they are.
    """
    key = ["scan_id", "batch_no"]
    errors = responses.select(*key, F.lit(True).alias("_answered"), "error")
    judged = (
        batched.join(errors, key, "left")
        .join(parse_responses(responses), [*key, "pos"], "left")
        .withColumn(
            "ai_analysis",
            F.when(F.col("error").isNotNull(), F.concat(F.lit(ERROR_START), F.col("error")))
            .when(F.col("_answered"), F.coalesce("ai_analysis", F.lit(NO_ANSWER))),
        )
        .withColumn("false_positive", F.col("false_positive") | F.coalesce(~F.col("ai_confirmed"), F.lit(False)))
    )
    quiet = findings.where(F.col("false_positive")).withColumns(
        {"ai_confirmed": F.lit(None).cast("boolean"), "ai_analysis": F.lit(None).cast("string")}
    )
    columns = [*findings.columns, "ai_confirmed", "ai_analysis"]
    return judged.select(*columns).unionByName(quiet.select(*columns))
