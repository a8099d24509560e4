"""Detectors outside the catalog: the composite heuristic and the entropy check."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsift.catalog import CRITICAL, ENTROPY_ID, HEURISTIC_ID, HIGH, MATCH_FLAGS, MEDIUM
from sigsift.config import ScanConfig
from sigsift.functions import text as tx
from sigsift.operators.matching import MATCH_TYPE, finding, wide_context

HEURISTIC_ORD = 1_000_000
ENTROPY_ORD = 1_000_001


@dataclass(frozen=True)
class Signal:
    name: str
    label: str
    weight: int
    pattern: str
    literals: tuple[str, ...]

    @property
    def jvm_pattern(self) -> str:
        return MATCH_FLAGS + self.pattern


# The heuristic's text signals in reporting order, with labels and weights.
SIGNALS = (
    Signal("decoding", "payload decoding", 2, r"""\b(?:base64_decode|gzinflate|gzuncompress|str_rot13|rawurldecode|hex2bin|pack\s*\(\s*['"]H\*['"])\s*\(""", ("base64_decode", "gzinflate", "gzuncompress", "str_rot13", "rawurldecode", "hex2bin", "pack")),
    Signal("execution", "dynamic execution", 2, r"\b(?:eval|assert|system|exec|passthru|shell_exec|popen|proc_open|call_user_func(?:_array)?)\s*\(", ("eval", "assert", "system", "exec", "passthru", "popen", "proc_open", "call_user_func")),
    Signal("silenced", "error suppression", 1, r"@\s*(?:eval|assert|system|exec|passthru|shell_exec|base64_decode|gzinflate|create_function)\s*\(", ("@",)),
    Signal("blob", "long encoded blob", 2, r"""['"][A-Za-z0-9+/]{140,}={0,2}['"]""", ("'", '"')),
    Signal("chr_chain", "chr() string building", 1, r"(?:chr\s*\(\s*\d+\s*\)\s*\.?\s*){8,}+", ("chr",)),
    Signal("router", "variable-variable routing", 1, r"(?:\$\$\w+|\$\w+\s*=\s*\$\$\w+)\s*=\s*\$_(?:GET|POST|REQUEST|COOKIE)", ("$$",)),
)
# Thresholds of the two detectors.
SIGNAL_ENTROPY = 6.1
LONG_LINE = 500
HIGH_SCORE = 4
CRITICAL_SCORE = 6
DEEP_ENTROPY = 6.0


# The one signal that does not ignore case stays exact.
def _flags(signal: Signal) -> str:
    return "(?dU)" + signal.pattern if signal.name == "blob" else signal.jvm_pattern


@lru_cache(maxsize=1)
def text_signals() -> Column:
    """For php files: first start of each text signal and the long line flag; null for others."""
    starts = [
        F.when(
            F.expr(tx.contains_any("folded", s.literals)), tx.first_start(F.col("text"), _flags(s))
        ).alias(s.name)
        for s in SIGNALS
    ]
    # lengths of lines cost a sixth of a pattern that counts; a break that stays in the line counts
    long_line = F.exists(tx.broken_lines(F.col("text")), lambda line: F.length(line) >= LONG_LINE).alias("long_line")
    return F.when((F.col("language") == "php") & F.col("text").isNotNull(), F.struct(*starts, long_line))


def with_signals(files: DataFrame) -> DataFrame:
    """Adds ``sig``; needs ``text``, ``folded`` and ``language``."""
    return files.withColumn("sig", text_signals())


@lru_cache(maxsize=1)
def heuristic() -> dict[str, Column]:
    """Score, labels and earliest position from ``sig`` and ``entropy``."""
    sig = F.col("sig")
    high = F.coalesce(F.col("entropy") >= SIGNAL_ENTROPY, F.lit(False))
    score = sum((F.when(sig[s.name].isNotNull(), s.weight).otherwise(0) for s in SIGNALS), F.lit(0))
    score = score + F.when(high, 1).otherwise(0) + F.when(sig["long_line"], 1).otherwise(0)
    labels = F.array_compact(
        F.array(
            *[F.when(sig[s.name].isNotNull(), F.lit(s.label)) for s in SIGNALS],
            F.when(high, F.concat(F.lit("high entropy "), tx.fixed(F.col("entropy"), 2))),
            F.when(sig["long_line"], F.lit("very long line payload")),
        )
    )
    first = F.coalesce(F.array_min(F.array(*[sig[s.name] for s in SIGNALS])), F.lit(0))
    return {"score": score.cast("int"), "signals": labels, "first": first}


@lru_cache(maxsize=32)
def heuristic_matches(config: ScanConfig, lines_before: str | None = None) -> Column:
    """The heuristic's finding as an array of at most one; ``lines_before`` names the column with the number of lines in ``file_lines`` before the text."""
    h = heuristic()
    shown = F.col("signals") if config.max_signals is None else F.slice(F.col("signals"), 1, config.max_signals)
    detail = F.concat(
        F.lit("Signs of obfuscation and execution occur together in this file: "),
        F.array_join(shown, ", "),
        F.lit("."),
    )
    spot = tx.spot_at(F.col("text"), h["first"])
    if lines_before:
        spot = F.transform(F.array(spot), lambda s: F.struct(s["start"].alias("start"), (s["line"] + F.col(lines_before)).alias("line"), s["col"].alias("col")))[0]
    row = finding(
        config,
        F.lit(HEURISTIC_ORD),
        F.when(F.col("points") >= CRITICAL_SCORE, CRITICAL).otherwise(HIGH),
        spot,
        F.lit(False),
        detail,
    )
    return F.when(F.col("points") >= HIGH_SCORE, F.array(row)).otherwise(F.array().cast(MATCH_TYPE))


@lru_cache(maxsize=32)
def entropy_matches(config: ScanConfig) -> Column:
    """The entropy finding as an array of at most one; deep scans of php text only."""
    none = F.array().cast(MATCH_TYPE)
    if not config.deep:
        return none
    row = F.struct(
        F.lit(ENTROPY_ORD).alias("rule_ord"),
        F.lit(MEDIUM).alias("severity"),
        F.lit(0).alias("match_start"),
        F.lit(0).alias("line_number"),
        F.lit(0).alias("match_column"),
        F.concat(F.lit("Entropy: "), tx.fixed(F.col("entropy"), 4)).alias("line_content"),
        F.array().cast("array<string>").alias("context_before"),
        F.array().cast("array<string>").alias("context_after"),
        F.lit(False).alias("false_positive"),
        F.concat(
            F.lit("The bytes of this file look encoded: entropy "), tx.fixed(F.col("entropy"), 2), F.lit(" of 8.0.")
        ).alias("detail"),
        wide_context(F.col("file_lines"), F.lit(0), config.wide_lines).alias("wide"),
    )
    wanted = (F.col("language") == "php") & F.col("text").isNotNull() & (F.col("entropy") > DEEP_ENTROPY)
    return F.when(wanted, F.array(row)).otherwise(none)


# Rule-like rows the findings of both detectors refer to.
DETECTOR_ROWS = (
    (HEURISTIC_ORD, HEURISTIC_ID, "Composite malware heuristic triggered", "CWE-506", "medium",
     "Decoding, execution and disguise in one file are typical of backdoors and web shells.",
     "Review the whole file, decode what is hidden, remove it unless its purpose is clear."),
    (ENTROPY_ORD, ENTROPY_ID, "High entropy file (possible obfuscation)", "CWE-506", "medium",
     "", "Review the file by hand."),
)
