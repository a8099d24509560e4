"""Rules against files: which rules hit, where, and in what surroundings.

The whole step is narrow.  A file stays one row from reading to its array of
matches; nothing is shuffled and only match-sized values leave the row.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsift.config import SUPPRESS_LINES, ScanConfig
from sigsift.functions import text as tx
from sigsift.operators import ruleset

MATCH_TYPE = (
    "array<struct<rule_ord:int,severity:int,match_start:int,line_number:int,match_column:int,line_content:string,"
    "context_before:array<string>,context_after:array<string>,false_positive:boolean,detail:string,wide:struct<first_line:int,last_line:int,text:string>>>"
)


PLACES_TYPE = "array<struct<rule_ord:int,at:array<struct<start:int,line:int,col:int>>,cut:boolean>>"


# Column trees are immutable; building these takes thousands of calls, so one per configuration is kept.
@lru_cache(maxsize=32)
def hit_rules(config: ScanConfig) -> Column:
    """Catalog positions of the rules that match ``text``.

    One expression per rule: language, then cheap substring tests on the folded
    text, then the regular expression.  Signatures are constants here, so each
    is compiled once per task and not once per row.  Large sets of rules go
    through the index of their literals.
    """
    rules = ruleset.usable(config)
    if len(rules) >= ruleset.LARGE:
        return ruleset.hit_rules(config)
    tests = []
    for n, rule in rules:
        languages = rule.languages + (("unknown",) if "php" in rule.languages else ())
        spoken = ", ".join(tx.sql_string(x) for x in languages)
        tests.append(
            f"CASE WHEN language IN ({spoken}) THEN CASE WHEN {tx.contains_any('folded', rule.literals)} "
            f"THEN CASE WHEN rlike(text, {tx.sql_string(rule.search_pattern)}) THEN {n} ELSE 0 END ELSE 0 END ELSE 0 END"
        )
    # array_remove() is compiled, array_compact() is not; no rule has position 0
    return F.expr(f"array_remove(cast(array({', '.join(tests)}) AS array<int>), 0)")


def with_text(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Adds ``text`` and its folded copy."""
    decoded = files.withColumn("text", tx.decode(F.col("content"), config.max_text_bytes, config.nul_probe_bytes))
    return decoded.withColumn("folded", tx.fold(F.col("text")))


def with_hits(files: DataFrame, config: ScanConfig) -> DataFrame:
    return with_text(files, config).withColumn("hits", hit_rules(config))


@lru_cache(maxsize=32)
def hit_places(config: ScanConfig) -> Column:
    """Per hit rule the (start, line, col) of its matches, or of its first ``max_matches``, and whether there are more."""
    patterns = tx.constant([r.search_pattern for r in config.rules], "array<string>")
    # the group of a pattern that has the match; where it is not the whole, group 1 has what stands before it
    groups = tx.constant([2 if r.run else 0 for r in config.rules], "array<int>")
    cap = config.max_matches

    def cut(rule_ord: Column) -> Column:
        pattern, group = F.element_at(patterns, rule_ord), F.element_at(groups, rule_ord)
        found = F.regexp_extract_all(F.col("text"), pattern, group)
        pieces = F.when(group == 0, F.split(F.col("text"), pattern, -1 if cap is None else cap + 2)).otherwise(
            F.regexp_extract_all(F.col("text"), pattern, F.lit(1))
        )
        return F.struct(
            rule_ord.alias("rule_ord"), pieces.alias("pieces"), (found if cap is None else F.slice(found, 1, cap + 1)).alias("found"),
        )

    def place(c: Column) -> Column:
        found = c["found"] if cap is None else F.slice(c["found"], 1, cap)
        over = F.lit(False) if cap is None else F.size(c["found"]) > cap
        return F.struct(c["rule_ord"].alias("rule_ord"), tx.spots(c["pieces"], found).alias("at"), over.alias("cut"))

    # naming ``hits`` twice keeps its computation in a projection of its own, which is compiled
    placed = F.when(F.size("hits") > 0, F.transform(F.transform("hits", cut), place))
    return F.coalesce(placed, F.array().cast(PLACES_TYPE))


def with_places(files: DataFrame, config: ScanConfig) -> DataFrame:
    return with_hits(files, config).withColumn("places", hit_places(config))


def notes(config: ScanConfig) -> Column:
    """What the cuts of the configuration have left out of a file, from ``content`` and ``places``."""
    out = [F.array().cast("array<string>")]
    size = F.octet_length("content")
    if config.nul_probe_bytes is not None:
        out.append(F.when(tx.has_nul(F.col("content"), config.nul_probe_bytes), F.array(F.lit("Not scanned: a NUL stands among the first bytes."))))
    if config.max_text_bytes is not None:
        out.append(F.when(size > config.max_text_bytes, F.array(F.lit(f"Scanned in part: the first {config.max_text_bytes} bytes."))))
    if config.header_bytes is not None:
        out.append(F.when(size > config.header_bytes, F.array(F.lit(f"Searched for a package name in part: the first {config.header_bytes} bytes."))))
    if config.max_matches is not None:
        ids = F.lit([r.rule_id for r in config.rules])
        cut = lambda p: F.concat(F.lit(f"Only the first {config.max_matches} matches are kept: "), F.element_at(ids, p["rule_ord"]))
        out.append(F.transform(F.filter("places", lambda p: p["cut"]), cut))
    return F.flatten(F.array(*[F.coalesce(x, out[0]) for x in out]))


def around(lines: Column, spot: Column, k: int) -> dict[str, Column]:
    """Line text and the k lines either side of a spot."""
    line = spot["line"]
    first = F.greatest(F.lit(1), line - k)
    return {
        "line_content": tx.strip_end(F.get(lines, line - 1)),
        "context_before": F.slice(lines, first, line - first),
        "context_after": F.slice(lines, line + 1, F.lit(k)),
    }


def window_text(lines: Column, line: Column, k: int) -> Column:
    first = F.greatest(F.lit(1), line - k)
    return F.array_join(F.slice(lines, first, line + k + 1 - first), "\n")


def wide_context(lines: Column, line: Column, k: int) -> Column:
    """The text from k lines before to k lines after, as line k before is counted from 0."""
    if not k:
        return F.lit(None).cast("struct<first_line:int,last_line:int,text:string>")
    first = F.greatest(F.lit(0), line - k) + 1
    last = F.least(F.size(lines), line + k)
    text = F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
    return F.struct(first.alias("first_line"), last.alias("last_line"), text.alias("text"))


def finding(config: ScanConfig, rule_ord: Column, severity: Column, spot: Column, suppressed: Column, detail: Column) -> Column:
    lines = F.col("file_lines")
    near = around(lines, spot, config.context_lines)
    return F.struct(
        rule_ord.alias("rule_ord"),
        severity.cast("int").alias("severity"),
        spot["start"].alias("match_start"),
        spot["line"].alias("line_number"),
        spot["col"].alias("match_column"),
        near["line_content"].alias("line_content"),
        near["context_before"].alias("context_before"),
        near["context_after"].alias("context_after"),
        suppressed.alias("false_positive"),
        detail.cast("string").alias("detail"),
        wide_context(lines, spot["line"], config.wide_lines).alias("wide"),
    )


@lru_cache(maxsize=32)
def catalog_matches(config: ScanConfig) -> Column:
    """Matches of the catalog rules as an array, from ``places`` and ``file_lines``."""
    severities = tx.constant([r.severity for r in config.rules], "array<int>")
    running = {n for n, _ in ruleset.usable(config)}
    suppressors = tx.constant([r.suppressors if n in running else [] for n, r in enumerate(config.rules, 1)], "array<array<string>>")

    def suppressed(rule_ord: Column, spot: Column) -> Column:
        return F.exists(
            F.element_at(suppressors, rule_ord),
            lambda p: F.rlike(window_text(F.col("file_lines"), spot["line"], SUPPRESS_LINES), p),
        )

    def expand(place: Column) -> Column:
        return F.transform(
            place["at"],
            lambda s: finding(
                config, place["rule_ord"], F.element_at(severities, place["rule_ord"]), s, suppressed(place["rule_ord"], s), F.lit(None)
            ),
        )

    return F.flatten(F.transform("places", expand))
