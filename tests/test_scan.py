"""Whole scans on small packages."""

import re

import pytest
from pyspark.sql import functions as F

from sigsift.catalog import CRITICAL, LOW, RULES, Rule
from sigsift.config import ScanConfig
from sigsift.operators import inventory, metadata, summary
from sigsift.operators.duplicates import duplicate_content, findings_by_content
from sigsift.plans.scan import scan
from sigsift.sources.tables import from_directory
from tests.conftest import HEADER, README

VULNERABLE = "<?php\neval($_GET['x']);\n$wpdb->query(\"SELECT * FROM t WHERE id = \" . $id);\necho $_POST['a'];\n"
NOISE = "".join(chr(0x100 + n * 37 % 1800) for n in range(600))


def ids(frame):
    return {r.rule_id for r in frame.select("rule_id").collect()}


def test_vulnerable_package(files, package):
    t = scan(files({**package, "vuln.php": VULNERABLE}))
    found = ids(t.findings)
    assert {"PHP-RCE-001", "PHP-SQLI-002", "PHP-XSS-001"} <= found
    assert t.scans.collect()[0][1:] == ("Test Plugin", "1.2.3")


def test_threshold_keeps_critical_only(files, package):
    t = scan(files({**package, "vuln.php": VULNERABLE}), ScanConfig(severity_threshold=CRITICAL))
    levels = {r.severity for r in t.findings.collect()}
    assert levels == {CRITICAL}


def test_threshold_leaves_detectors_alone(files, package):
    text = f"<?php\n'{'QUFB' * 80}';\n@$runner(base64_decode('eA=='));\n" + "chr(1)." * 7
    t = scan(files({**package, "h.php": text, "n.php": NOISE}), ScanConfig(severity_threshold=CRITICAL, deep=True))
    rows = {r.rule_id: r for r in t.findings.collect()}
    assert rows["PHP-MALWARE-HEUR-001"].severity == 4
    assert "payload decoding, long encoded blob" in rows["PHP-MALWARE-HEUR-001"].description
    assert (rows["ENTROPY-001"].line_number, rows["ENTROPY-001"].severity_label) == (0, "Medium")


def test_package_without_header(files):
    t = scan(files({"vuln.php": VULNERABLE}))
    assert t.findings.count() == 0 and t.file_info.count() == 0
    errors = t.scan_errors.collect()
    assert [(e.message, e.fatal) for e in errors] == [(metadata.INVALID_PACKAGE, True)]


@pytest.mark.parametrize(
    "contents, expected",
    [
        ({"a.php": HEADER}, ("Test Plugin", "1.2.3")),
        ({"readme.txt": "no header\n", "a.php": HEADER}, ("Test Plugin", "1.2.3")),
        ({"readme.txt": "=== A   B ===\n", "a.php": HEADER}, ("A B", "")),
        ({"x/readme.txt": README.replace("Test", "Deep"), "readme.txt": "\ufeff=== Top ===\nVersion: 9"}, ("Top", "9")),
        ({"b.php": "/* Plugin Name: B */", "a/a.php": HEADER}, ("B */", "")),
        ({"node_modules/readme.txt": README, "z.inc": " * plugin name:  Z \n"}, ("Z", "")),
        ({"README.TXT": README}, None),
        ({"a.php": "\x00\n" + HEADER}, ("Test Plugin", "1.2.3")),
        ({"a.php": " " * 70_000 + "\n" + HEADER}, ("Test Plugin", "1.2.3")),
    ],
)
def test_metadata(files, contents, expected):
    got = [(r.plugin_name, r.plugin_version) for r in metadata.package_metadata(files(contents), ScanConfig()).collect()]
    assert got == ([expected] if expected else [])


def test_skipping(files, package):
    listing = files({**package, "a.png": "x", "b.php": "", "c.php": "x" * 4096, "build/d.php": "x", "e.twig": "x"})
    t = scan(listing, ScanConfig(max_file_kb=1))
    reasons = {r.path: r.reason for r in t.skipped.collect()}
    assert reasons == {
        "a.png": "binary extension", "b.php": "empty file", "c.php": "file too large", "e.twig": "extension not included",
        "readme.txt": "extension not included",
    }
    assert [r.path for r in t.file_info.collect()] == ["test-plugin.php"]


def test_no_scannable_files(files):
    t = scan(files({"readme.txt": README}))
    assert [(r.message, r.fatal) for r in t.status.collect()] == [(metadata.NO_FILES, True)]
    assert t.grades.count() == 0


def test_nul_file_is_listed_without_findings(files, package):
    t = scan(files({**package, "bin.php": b"\x00" + VULNERABLE.encode() + bytes(range(256)) * 8}), ScanConfig(deep=True, nul_probe_bytes=8192))
    info = {r.path: r for r in t.file_info.collect()}
    assert info["bin.php"].lines == 0 and info["bin.php"].entropy > 6
    assert t.findings.where("path = 'bin.php'").count() == 0
    assert [(r.path, r.fatal) for r in t.scan_errors.collect()] == [("bin.php", False)]


def test_match_cap_and_order(files, package):
    listed = files({**package, "m.php": "phpinfo();\n" * 250})
    for most, kept in ((100, 100), (None, 250), (250, 250)):
        t = scan(listed, ScanConfig(max_matches=most))
        lines = [r.line_number for r in t.findings.where("rule_id = 'PHP-INFO-001'").orderBy("match_start").collect()]
        assert lines == list(range(1, kept + 1))
        assert [r.path for r in t.scan_errors.collect()] == ["m.php"] * (kept < 250)


def test_nothing_is_cut_by_default(files):
    contents = {
        "late.php": "<?php\n" + "// x\n" * 30_000 + "/* Plugin Name: Late */\n", "big.php": "<?php\n" + "// x\n" * 1_100_000 + "phpinfo();\n",
        "nul.php": "\x00 eval($x);",
    }
    t = scan(files(contents)).pinned()
    assert [(r.plugin_name, r.files_found) for r in t.status.collect()] == [("Late */", 3)]
    assert {(r.path, r.rule_id, r.line_number) for r in t.findings.collect()} == {("big.php", "PHP-INFO-001", 1_100_002), ("nul.php", "PHP-RCE-001", 1)}
    assert t.skipped.count() == 0 and t.scan_errors.count() == 0


def test_results_follow_from_the_facts(spark, files, package):
    t = scan(files({**package, "v.php": VULNERABLE, "a.png": "x", "build/b.php": "x"})).pinned()
    for name in ("grades", "status", "skipped", "file_info", "findings", "scan_errors"):
        plan = getattr(t, name)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"\bcontent#", plan), name
    assert t.pinned() is t
    assert [(r.files_found, r.files_skipped, r.display_name) for r in t.status.collect()] == [(2, 2, "Test Plugin")]
    unnamed = scan(files({"v.php": "x", "build/b.php": "x"})).status.first()
    assert (unnamed.plugin_name, unnamed.display_name, unnamed.fatal) == (None, "pkg", True)


def test_options_that_replace_the_defaults(files, package):
    listed = files({**package, "build/b.php": "x", "src/s.php": "x", "t.twig": "x"})
    paths = lambda config: {r.path for r in scan(listed, config).file_info.collect()}
    assert paths(ScanConfig(only_exclude_dirs=("src",))) == {"test-plugin.php", "build/b.php"}
    assert paths(ScanConfig(only_ext=("TWIG",))) == {"t.twig"}


def test_multi_line_and_suppression_window(files, package):
    far = "current_user_can('x');\n" + "\n" * 10 + "add_action('admin_x', 'y');"
    near = "current_user_can('x');\n" + "\n" * 9 + "add_action('admin_x', 'y');\n"
    below = "add_action('admin_x', 'y');\n" + "\n" * 9 + "CURRENT_USER_CAN('x');"
    t = scan(files({**package, "e.php": "eval(\n  base64_decode('x')\n);", "far.php": far, "near.php": near, "below.php": below}))
    rows = {r.path: r for r in t.findings.where("rule_id IN ('PHP-AUTH-001', 'PHP-RCE-002')").collect()}
    assert rows["e.php"].line_number == 1
    assert {p: rows[p].false_positive for p in ("far.php", "near.php", "below.php")} == {
        "far.php": False, "near.php": True, "below.php": True,
    }


def test_context(files, package):
    text = "\n".join(["l1  ", "l2", "l3", "l4", "phpinfo();  \t", "l6 ", "l7"])
    t = scan(files({**package, "c.php": text}), ScanConfig(context_lines=2))
    row = t.findings.where("path = 'c.php'").first()
    assert (row.context_before, row.line_content, row.context_after) == (["l3", "l4"], "phpinfo();", ["l6 ", "l7"])
    none = scan(files({**package, "c.php": text}), ScanConfig(context_lines=0)).findings.where("path = 'c.php'").first()
    assert (none.context_before, none.context_after) == ([], [])


def test_unknown_language_gets_php_rules_only(files, package):
    t = scan(files({**package, "a.tpl": "eval($x); document.write(a)"}), ScanConfig(include_ext=("TPL",)))
    assert ids(t.findings.where("path = 'a.tpl'")) == {"PHP-RCE-001"}


def test_user_rules(files, package):
    rule = Rule("OWN-1", "todo", LOW, r"todo\b", cwe="CWE-0", languages=("php", "ts"), fp_patterns=("ignore",))
    t = scan(files({**package, "a.ts": "// TODO x", "b.php": "todo // ignore"}), ScanConfig(rules=RULES + (rule,)))
    rows = {r.path: r.false_positive for r in t.findings.where("rule_id = 'OWN-1'").collect()}
    assert rows == {"a.ts": False, "b.php": True}


def test_config_checks():
    for bad in ({"php_only": True, "js_only": True}, {"max_file_kb": 0}, {"context_lines": -1}, {"severity_threshold": 1}):
        with pytest.raises(ValueError):
            ScanConfig(**bad)
    assert ScanConfig(quick=True).threshold == 4
    assert ScanConfig(php_only=True, include_ext=("x",)).extensions == (".php", ".inc", ".module")


GRADES = {100: "A+", 97: "A+", 96: "A", 93: "A", 92: "A-", 90: "A-", 89: "B+", 87: "B+", 86: "B", 83: "B", 82: "B-", 80: "B-", 79: "C+",
          77: "C+", 76: "C", 73: "C", 72: "C-", 70: "C-", 69: "D+", 67: "D+", 66: "D", 63: "D", 62: "D-", 60: "D-", 59: "F", 0: "F"}


def test_grade_borders(spark):
    rows = spark.createDataFrame(list(GRADES.items()), "score int, want string").withColumn("got", summary.grade(F.col("score")))
    assert rows.where("got <> want").count() == 0


def test_grade_ignores_suppressed(spark):
    scans = spark.createDataFrame([("p", "P", ""), ("clean", "C", "")], "scan_id string, plugin_name string, plugin_version string")
    found = spark.createDataFrame([("p", 5, False), ("p", 2, True)], "scan_id string, severity int, false_positive boolean")
    got = {r.scan_id: (r.total, r.suppressed, r.score, r.grade) for r in summary.scan_grades(scans, found).collect()}
    assert got == {"p": (1, 1, 75, "C"), "clean": (0, 0, 100, "A+")}


def test_pinned_tables_are_the_same(files, package):
    contents = [("a", p, c) for p, c in {**package, "v.php": VULNERABLE}.items()] + [("b", "v.php", VULNERABLE)]
    lazy = scan(files(contents))
    pinned = lazy.pinned()
    for name in ("findings", "file_info", "grades", "skipped", "scan_errors"):
        assert sorted(map(str, getattr(lazy, name).collect())) == sorted(map(str, getattr(pinned, name).collect()))


def test_copies_are_scanned_once(files, package):
    contents = [(s, p, c) for s in ("a", "b", "c") for p, c in {**package, "v.php": VULNERABLE, "w/v.php": VULNERABLE}.items()]
    frame = files(contents)
    columns = ["scan_id", "path", "rule_id", "line_number", "match_column", "false_positive", "line_content"]
    plain = sorted(map(str, scan(frame).all_findings.select(columns).collect()))
    once = sorted(map(str, findings_by_content(frame, ScanConfig()).select(columns).collect()))
    assert plain == once and len(plain) > 0
    groups = {r.copies: r.packages for r in duplicate_content(frame, ScanConfig()).collect()}
    assert groups == {6: 3, 3: 3}


def test_directory_source(spark, tmp_path):
    for name, text in {"p 1/a%20b.PHP": VULNERABLE, "p 1/x+y/readme.txt": README, "p 1/pic.png": "x", "q/z.js": "eval(a)"}.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    config = ScanConfig()
    content, listing = from_directory(spark, str(tmp_path), config)
    assert sorted(r.path for r in content.collect()) == ["a%20b.PHP", "x+y/readme.txt", "z.js"]
    t = scan(content, config, listing)
    assert {r.path for r in t.skipped.collect()} == {"pic.png", "x+y/readme.txt"}
    assert {(r.scan_id, r.path) for r in t.file_info.collect()} == {("p 1", "a%20b.PHP")}
    one, _ = from_directory(spark, str(tmp_path / "q"), config, one_package=True)
    assert [(r.scan_id, r.path) for r in one.collect()] == [("q", "z.js")]


def test_inventory_is_a_partition(files, package):
    frame = files({**package, "a.png": "x", "dist/b.php": "x", "c.js": "y"})
    config = ScanConfig()
    parts = [inventory.scannable(frame, config), inventory.skipped(frame, config), inventory.excluded(frame, config)]
    names = [r.path for p in parts for r in p.select("path").collect()]
    assert sorted(names) == sorted(r.path for r in frame.collect())


def test_findings_are_distinct(spark):
    from sigsift.sources import corpus
    from tests.conftest import SF

    found = scan(corpus.corpus_files(spark, SF), ScanConfig(deep=True)).pinned().all_findings
    assert found.count() == found.dropDuplicates(["scan_id", "path", "rule_id", "line_number", "match_column"]).count()


def test_context_agrees_with_a_range_join(spark):
    """The sliced context equals a join of findings with the lines around them."""
    from sigsift.plans.queries import QUERIES
    from tests.conftest import SF

    found, lines = QUERIES["context_lines"](spark, SF), QUERIES["line_index"](spark, SF)
    near = found.join(lines, ["scan_id", "path"]).where("line_no BETWEEN line_number - 3 AND line_number - 1")
    key = ["scan_id", "path", "rule_id", "line_number", "match_column"]
    joined = near.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    joined = joined.select(*key, F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("before"))
    sliced = found.where("line_number > 1").select(*key, "before")
    assert joined.exceptAll(sliced).count() == 0 and sliced.exceptAll(joined).count() == 0 and sliced.count() > 100
