"""A corpus that grows: new contents are scanned, the others looked up."""

from pyspark.sql import functions as F

from sigsift.catalog import CRITICAL
from sigsift.config import ScanConfig
from sigsift.operators import rescan
from sigsift.plans.scan import scan

CODE = {"a.php": "eval($x);", "b.php": "md5($p);\nphpinfo();", "c.php": "nothing", "a.js": "eval('x')"}


def rows(findings):
    names = sorted(findings.columns)
    return sorted((tuple(r[n] for n in names) for r in findings.collect()), key=str)


def test_grown_corpus(spark, files, tmp_path):
    folder = str(tmp_path / "store")
    config = ScanConfig(deep=True)
    first = files([("p", k, t) for k, t in CODE.items()] + [("q", "copy.php", CODE["a.php"])])
    grown = first.unionByName(files([("r", "d/a.php", CODE["a.php"]), ("r", "new.php", "extract($y);"), ("r", "a.js", CODE["a.php"]), ("r", "new.php", "extract($y);")]))
    stored = lambda: rescan.store(first, folder, config).select("sha256", "language")
    assert stored().count() == 0
    assert rows(rescan.rescan(first, folder, config)) == rows(scan(first, config).all_findings)
    before = set(stored().collect())
    assert len(before) == 4  # copies are one content
    assert rows(rescan.rescan(grown, folder, config)) == rows(scan(grown, config).all_findings)
    after = stored().collect()
    assert len(after) == 6 and before < set(after)  # one new text, and one known as php that is javascript here
    # nothing is new: nothing is written, and the store alone answers
    assert rows(rescan.rescan(grown, folder, config)) == rows(scan(grown, config).all_findings) and stored().count() == 6
    assert rescan.rescan(grown.where(F.lit(False)), folder, config).count() == 0


def test_other_rules_have_results_of_their_own(spark, files, tmp_path):
    folder = str(tmp_path / "store")
    frame = files([("p", k, t) for k, t in CODE.items()])
    for config in (ScanConfig(), ScanConfig(severity_threshold=CRITICAL), ScanConfig(context_lines=0)):
        assert rows(rescan.rescan(frame, folder, config)) == rows(scan(frame, config).all_findings)
    assert rescan.rule_set(ScanConfig()) == rescan.rule_set(ScanConfig(exclude_dirs=("x",))) != rescan.rule_set(ScanConfig(deep=True))
