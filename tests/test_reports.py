"""Report pieces make whole documents."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from sigsift.operators import metadata, reports, summary
from sigsift.operators.ordering import with_ordinal
from sigsift.plans.scan import scan


@pytest.fixture
def parts(files, package):
    contents = [("a b", p, c) for p, c in {**package, "v.php": "<?php\n" + 'echo "é\\" $x";\nphpinfo();\n' * 9}.items()]
    contents += [("clean", p, c) for p, c in package.items()]
    t = scan(files(contents)).pinned()
    totals = summary.scan_totals(t.file_info)
    packages = t.grades.join(totals, "scan_id", "left").fillna(0).withColumn("scan_mode", F.lit("standard")).withColumn("ai_enabled", F.lit(False))
    numbered = with_ordinal(t.findings, "scan_id", summary.order_keys(), "ordinal").withColumn("ai_analysis", F.lit(None).cast("string"))
    return t, packages, numbered


def document(pieces, scan_id):
    keys = [c for c in ("section", "piece", "path") if c in pieces.columns]
    return "\n".join(r.text for r in pieces.where(F.col("scan_id") == scan_id).orderBy(*keys).collect())


def test_json_document(spark, parts):
    t, packages, numbered = parts
    errors = spark.createDataFrame([("a b", None, "Error scanning x", False)], t.scan_errors.schema)
    pieces = reports.json_report(packages, numbered, errors, per_piece=4)
    assert pieces.where("scan_id = 'a b' AND section = 1").count() == 5
    doc = json.loads(document(pieces, "a b"))
    assert [f["line"] for f in doc["findings"]] == [r.line_number for r in numbered.where("scan_id = 'a b'").orderBy("ordinal").collect()]
    assert doc["findings"][0].keys() == {
        "id", "title", "severity", "file", "line", "code", "cwe", "description", "impact", "recommendation", "false_positive", "ai_analysis",
    }
    assert (doc["errors"], doc["summary"]["total"], doc["files_scanned"]) == (["Error scanning x"], 18, 2)
    clean = json.loads(document(pieces, "clean"))
    assert (clean["findings"], clean["grade"], clean["plugin_version"], clean["errors"]) == ([], "A+", "1.2.3", [])


def test_markdown_document(spark, parts):
    t, packages, numbered = parts
    errors = spark.createDataFrame([("clean", None, "Error scanning x", False)], t.scan_errors.schema)
    pieces = reports.markdown_report(packages, numbered, t.file_info, errors)
    text = document(pieces, "a b")
    assert text.startswith("# Security Report — Test Plugin\n\n- **Version:** 1.2.3\n- **Path:** a b\n")
    assert text.count("\n### ") == 18 and "\n## Files Scanned\n- `test-plugin.php` (php, 5 lines, entropy " in text
    clean = document(pieces, "clean")
    assert "## Findings\nNo findings were detected.\n\n## Files Scanned" in clean and clean.endswith("\n## Errors\n- Error scanning x")


def test_written_reports(spark, parts, tmp_path):
    t, packages, numbered = parts
    pieces = reports.json_report(packages, numbered, t.scan_errors)
    reports.write_reports(pieces, str(tmp_path / "out"))
    folders = sorted((tmp_path / "out").glob("scan_id=*"))
    assert len(folders) == 2
    for folder in folders:
        text = "".join(pathlib.Path(f).read_text() for f in sorted(folder.glob("part-*")))
        json.loads(text)


def test_shelves_of_reports(spark, parts, tmp_path):
    t, packages, numbered = parts
    few = reports.json_report(packages, numbered, t.scan_errors)
    many = few.join(spark.range(150).withColumnRenamed("id", "_n"), F.lit(True)).withColumn("scan_id", F.concat_ws("/", "scan_id", "_n")).drop("_n")
    reports.write_shelves(many, str(tmp_path / "out"), shelves=8)
    assert len(list((tmp_path / "out/pieces").glob("*/*.parquet"))) <= 16 and len(list((tmp_path / "out/packages").glob("*.parquet"))) == 1
    index = spark.read.parquet(str(tmp_path / "out/packages")).collect()
    assert len(index) == 300
    whole = {r.scan_id: "".join(p.text for p in sorted(r.x, key=lambda p: (p.section, p.piece))) for r in few.groupBy("scan_id").agg(F.collect_list(F.struct("section", "piece", "text")).alias("x")).collect()}
    for row in index[:3] + index[-3:]:
        text = "".join(r.text for r in reports.shelved(spark, str(tmp_path / "out"), row.scan_id).collect())
        assert text == whole[row.scan_id.rsplit("/", 1)[0]] and len(text) == row.characters and json.loads(text)
    assert reports.shelved(spark, str(tmp_path / "out"), "nobody").count() == 0


def test_tables_are_written(spark, parts, tmp_path):
    parts[0].write(str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/findings")).count() == 18


@pytest.mark.parametrize("name, slug", [("My Pack! 2", "my-pack-2"), ("--", "report"), (" .A_b- ", "a_b"), ("É", "report"), ("a//b", "a-b")])
def test_slug(spark, name, slug):
    assert spark.range(1).select(metadata.report_slug(F.lit(name))).first()[0] == slug


@pytest.mark.parametrize("name, target, shown", [("N", "/x/y.zip", "N"), ("", "/x/y.ZIP", "y"), (None, "/x/y.b", "y.b")])
def test_display_name(spark, name, target, shown):
    assert spark.range(1).select(metadata.display_name(F.lit(name).cast("string"), F.lit(target))).first()[0] == shown


def test_report_id(spark):
    import hashlib

    want = "R-" + hashlib.sha256(b"/x:2026-01-01").hexdigest()[:12].upper()
    assert spark.range(1).select(reports.report_id(F.lit("/x"), F.lit("2026-01-01"))).first()[0] == want


def test_fatal_messages(spark):
    rows = spark.createDataFrame([(metadata.INVALID_PACKAGE,), (metadata.NO_FILES,), ("Failed to extract ZIP: x",), ("Error scanning x",)], "m string")
    assert [r[0] for r in rows.select(metadata.is_fatal(F.col("m"))).collect()] == [True, True, True, False]
