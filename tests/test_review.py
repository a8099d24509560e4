"""Prompts, response parsing, verdicts."""

import pytest
from pyspark.sql import functions as F

from sigsift.config import ScanConfig
from sigsift.operators import review, summary
from sigsift.plans.scan import scan

RESPONSES = "scan_id string, batch_no int, response string, error string"


def parsed(spark, text):
    rows = review.parse_responses(spark.createDataFrame([("p", 0, text, None)], RESPONSES)).orderBy("pos").collect()
    return [(r.pos, r.ai_confirmed, r.ai_analysis) for r in rows]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("FINDING 1:\nVERDICT: TRUE_POSITIVE\nANALYSIS: bad\nmore\n", [(1, True, "bad")]),
        ("Intro.\nfinding 1 :\nverdict : false_positive\nanalysis:  ok  \n", [(1, False, "ok")]),
        ("FINDING 2:\nVERDICT: TRUE_POSITIVE\nFINDING 1:\nANALYSIS:\n  late line", [(1, None, "late line"), (2, True, "VERDICT: TRUE_POSITIVE")]),
        ("FINDING 1:\n" + "x" * 300, [(1, None, "x" * 300)]),
        ("FINDING 1:\n\nFINDING 2: ANALYSIS: a", [(2, None, "a")]),
        ("FINDING 1: ANALYSIS: a\nFINDING 1: ANALYSIS: b", [(1, None, "a")]),
        ("no block", []),
        ("", []),
    ],
)
def test_parse(spark, text, expected):
    assert parsed(spark, text) == expected


@pytest.fixture
def found(files, package):
    code = "<?php\n" + "\n".join(f"phpinfo(); // {n}" for n in range(7)) + "\n$wpdb->prepare($a);\n$wpdb->query('$b');\n"
    return scan(files({**package, "v.php": code})).pinned()


def test_batches_and_prompts(found):
    batched = review.batches(found.findings)
    rows = {(r.batch_no, r.pos): r for r in batched.collect()}
    active = found.findings.where("NOT false_positive").count()
    assert found.findings.where("false_positive").count() > 0
    assert sorted(rows) == [(n // 5, n % 5 + 1) for n in range(active)]
    first = review.prompts(batched).where("batch_no = 0").first()
    assert first.findings == 5
    assert first.prompt.startswith("Below are 5 places ") and "\nFINDING <its number>:\nVERDICT: " in first.prompt
    assert first.prompt.count("[FINDING ") == 5 and "\n>>> " in first.prompt


def test_verdicts(spark, found):
    batched = review.batches(found.findings)
    answers = [
        ("pkg", 0, "So:\nFINDING 1:\nVERDICT: FALSE_POSITIVE\nANALYSIS: fine\nFINDING 2:\nVERDICT: TRUE_POSITIVE\nANALYSIS: bad", None),
        ("pkg", 1, "FINDING 1:\nVERDICT: FALSE_POSITIVE", "timeout"),
    ]
    judged = review.apply_verdicts(found.findings, batched, spark.createDataFrame(answers, RESPONSES))
    assert judged.count() == found.findings.count()
    key = ["path", "rule_id", "match_start"]
    rows = {(r.batch_no, r.pos): r for r in batched.join(judged.select(*key, "ai_analysis", "ai_confirmed", F.col("false_positive").alias("fp")), key).collect()}
    assert (rows[0, 1].fp, rows[0, 1].ai_confirmed, rows[0, 1].ai_analysis) == (True, False, "fine")
    assert (rows[0, 2].fp, rows[0, 2].ai_confirmed, rows[0, 2].ai_analysis) == (False, True, "bad")
    assert (rows[0, 3].fp, rows[0, 3].ai_analysis) == (False, review.NO_ANSWER)
    assert (rows[1, 1].fp, rows[1, 1].ai_analysis) == (False, "AI error: timeout")
    before = summary.scan_grades(found.scans, found.findings).first()
    after = summary.scan_grades(found.scans, judged).first()
    assert (after.total, after.suppressed) == (before.total - 1, before.suppressed + 1)


def test_nothing_to_review(files, package):
    t = scan(files(package)).pinned()
    assert review.batches(t.findings).count() == 0


def test_wide_context(files, package):
    text = "\n".join([f"line {n}" for n in range(1, 71)] + ["phpinfo();"] + [f"line {n}" for n in range(72, 101)])
    t = scan(files({**package, "w.php": text}), ScanConfig(wide_lines=50))
    row = review.wide_prompts(t.findings).first()
    assert (row.first_line, row.last_line) == (22, 100)
    assert "lines 22 to 100 of the file:\nline 22\n" in row.prompt and row.prompt.endswith("line 100\n[end]\n")


def test_cost(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("b", 0, 3), ("c", 0, 0)], "scan_id string, total bigint, suppressed bigint")
    got = {r.scan_id: (r.ai_enabled, r.ai_model, r.ai_tokens) for r in summary.review_cost(rows, "m").collect()}
    assert got == {"a": (True, "m", 3750), "b": (False, "m", 3750), "c": (False, "m", 1200)}
