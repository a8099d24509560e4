"""A stream of files gives what a batch gives."""

import pytest
from pyspark.sql import functions as F

from sigsift.config import ScanConfig
from sigsift.plans import queries
from sigsift.plans.scan import scan
from sigsift.streaming import landing
from tests.conftest import README, SF
from tests.test_archives import CASES

CODE = {"a": "eval($x);\nphpinfo();", "b": "md5($p);", "c": "nothing"}


@pytest.fixture
def landed(spark, files, tmp_path):
    """Two deliveries; the second repeats a file of the first."""
    def drop(contents, when):
        frame = files(contents).withColumn("arrived", F.lit(when).cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    first = [("p", "a.php", CODE["a"]), ("p", "b.php", CODE["b"])]
    drop(first, "2026-01-01 10:00:00")
    drop([("p", "a.php", CODE["a"]), ("q", "c.php", CODE["c"]), ("q", "a.php", CODE["a"])], "2026-01-01 10:05:00")
    return str(tmp_path / "in")


def run(stream, mode, tmp_path):
    name = f"out_{abs(hash(str(tmp_path)))}"
    handle = (
        stream.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    handle.awaitTermination()
    return stream.sparkSession.table(name)


COLUMNS = ["scan_id", "path", "rule_id", "line_number", "match_column"]


def test_stream_equals_batch(spark, landed, tmp_path):
    stream = landing.stream_findings(landing.landing_tables(spark, landed, max_files=1), ScanConfig())
    got = run(stream.select(*COLUMNS), "append", tmp_path)
    want = scan(spark.read.parquet(landed)).all_findings.select(*COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_repeated_delivery_is_scanned_once(spark, landed, tmp_path):
    once = landing.once(landing.landing_tables(spark, landed, max_files=1))
    got = run(landing.stream_findings(once, ScanConfig()).select(*COLUMNS), "append", tmp_path)
    want = scan(spark.read.parquet(landed).dropDuplicates(["scan_id", "path"])).all_findings.select(*COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_running_grades(spark, landed, tmp_path):
    facts = landing.stream_facts(landing.once(landing.landing_tables(spark, landed, max_files=1)), ScanConfig())
    rows = run(landing.running_grades(facts), "update", tmp_path).collect()
    last = {r.scan_id: (r.total, r.score) for r in sorted(rows, key=lambda r: r.total)}
    assert last["p"] == (3, 100 - 25 - 5 - 5) and last["q"] == (2, 100 - 25 - 5)


def test_running_grade_and_status_of_a_clean_package(spark, files, tmp_path):
    contents = [("clean", "readme.txt", README), ("clean", "a.php", "nothing"), ("none", "a.php", "x")]
    files(contents).withColumn("arrived", F.lit("2026-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    facts = landing.stream_facts(landing.landing_tables(spark, str(tmp_path / "in")), ScanConfig())
    grades = run(landing.running_grades(facts), "update", tmp_path / "g").collect()
    assert {r.scan_id: (r.total, r.score, r.grade) for r in grades} == {"clean": (0, 100, "A+"), "none": (0, 100, "A+")}
    status = run(landing.running_status(facts), "update", tmp_path / "s").collect()
    assert {r.scan_id: (r.plugin_name, r.files_scanned, r.fatal) for r in status} == {"clean": ("Test Plugin", 1, False), "none": (None, 1, True)}


def test_arrival_windows(spark, landed, tmp_path):
    rows = run(landing.arrivals(landing.landing_tables(spark, landed)), "update", tmp_path).collect()
    assert {r.scan_id: r.files for r in rows} == {"p": 3, "q": 2}


def test_stream_of_archives(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    (folder / "good.zip").write_bytes(CASES["good.zip"])
    (folder / "up.zip").write_bytes(CASES["up.zip"])
    content, errors = landing.landing_archives(spark, str(folder))
    assert [(r.scan_id, r.fatal) for r in run(errors, "append", tmp_path / "e").collect()] == [("up.zip", True)]
    found = landing.stream_findings(content, landing.UPLOADS)
    assert {(r.scan_id, r.rule_id) for r in run(found.select(*COLUMNS), "append", tmp_path).collect()} == {("good.zip", "PHP-INFO-001")}


def delivered(files, tmp_path, number, contents, when):
    files(contents).withColumn("arrived", F.lit(when).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{number}"))


def test_changed_files_replace_their_counts(spark, files, tmp_path):
    """Three deliveries, one of them out of order: grades follow the last version of each file."""
    deliveries = [
        ([("p", "a.php", CODE["a"]), ("p", "b.php", CODE["b"]), ("q", "a.php", CODE["c"])], "2026-01-01 10:00:00"),
        ([("p", "a.php", "nothing"), ("q", "a.php", CODE["a"]), ("q", "a.php", CODE["a"])], "2026-01-01 11:00:00"),
        ([("p", "a.php", CODE["b"]), ("p", "b.php", "eval($x);")], "2026-01-01 10:30:00"),
    ]
    log = []
    for number, (contents, when) in enumerate(deliveries):
        delivered(files, tmp_path, "", contents, when)
        facts = landing.stream_facts(landing.landing_tables(spark, str(tmp_path / "in")), ScanConfig(), ("arrived",))
        changed = landing.changes(landing.file_counts(facts))
        handle = (
            changed.writeStream.outputMode("update").foreachBatch(lambda batch, _: log.extend(batch.collect()))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        handle.awaitTermination()
    got = {r.scan_id: r for r in landing.regraded(spark.createDataFrame(log, changed.schema)).collect()}
    last = scan(files([("p", "a.php", "nothing"), ("p", "b.php", "eval($x);"), ("q", "a.php", CODE["a"])])).all_findings
    want = {r.scan_id: r for r in landing.summary.severity_counts(last).collect()}
    for name in ("p", "q"):
        assert [got[name][c] for c in landing.COUNTED] == [want[name][c] for c in landing.COUNTED]


def test_last_versions_without_python_state(spark, files, tmp_path):
    """The same three deliveries as rows that replace each other; no file's state is a call of Python."""
    deliveries = [
        ([("p", "a.php", CODE["a"]), ("p", "b.php", CODE["b"]), ("q", "a.php", CODE["c"])], "2026-01-01 10:00:00"),
        ([("p", "a.php", "nothing"), ("q", "a.php", CODE["a"]), ("q", "a.php", CODE["a"])], "2026-01-01 11:00:00"),
        ([("p", "a.php", CODE["b"]), ("p", "b.php", "eval($x);")], "2026-01-01 10:30:00"),
    ]
    kept = {}
    for contents, when in deliveries:
        delivered(files, tmp_path, "", contents, when)
        facts = landing.stream_facts(landing.landing_tables(spark, str(tmp_path / "in")), ScanConfig(), ("arrived",))
        counted = landing.last_counts(landing.file_counts(facts))
        handle = (
            counted.writeStream.outputMode("update").foreachBatch(lambda batch, _: kept.update({(r.scan_id, r.path): r for r in batch.collect()}))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        handle.awaitTermination()
    got = {r.scan_id: r for r in landing.regraded(spark.createDataFrame(list(kept.values()), counted.schema)).collect()}
    last = scan(files([("p", "a.php", "nothing"), ("p", "b.php", "eval($x);"), ("q", "a.php", CODE["a"])])).all_findings
    want = {r.scan_id: r for r in landing.summary.severity_counts(last).collect()}
    for name in ("p", "q"):
        assert [got[name][c] for c in landing.COUNTED] == [want[name][c] for c in landing.COUNTED]


def test_findings_wait_for_the_name(spark, files, tmp_path):
    """Names come before, after and never; two files name one package; a name beyond the delay is no name."""
    code = "eval($x);"
    delivered(files, tmp_path, "", [("early", "readme.txt", README), ("late", "a.php", code), ("never", "a.php", code), ("gone", "a.php", code)], "2026-01-01 10:00:00")
    delivered(files, tmp_path, "", [("early", "a.php", code), ("late", "readme.txt", README), ("late", "x/readme.txt", README)], "2026-01-01 10:20:00")
    delivered(files, tmp_path, "", [("gone", "readme.txt", README), ("early", "b.php", code)], "2026-01-03 10:00:00")
    both = lambda: landing.landing_tables(spark, str(tmp_path / "in"), max_files=1)
    found = landing.findings_of_valid(both(), ScanConfig(), both(), "1 hour")
    got = run(found.select(*COLUMNS), "append", tmp_path).collect()
    assert sorted((r.scan_id, r.path) for r in got) == [("early", "a.php"), ("late", "a.php")]


def test_late_findings_and_windows(spark, files, tmp_path):
    code = "eval($x);"
    for when, path in (("2026-01-01 10:00:00", "a.php"), ("2026-01-01 10:50:00", "b.php"), ("2026-01-01 14:00:00", "c.php"), ("2026-01-01 14:05:00", "e.php"), ("2026-01-01 08:00:00", "late.php"), ("2026-01-02 14:00:00", "d.php")):
        delivered(files, tmp_path, "", [("p", path, code)], when)
    found = landing.stream_findings(landing.landing_tables(spark, str(tmp_path / "in"), max_files=1), ScanConfig(), ("arrived",))
    closed = run(landing.sessions(found, "1 hour", "2 hours"), "append", tmp_path / "a").collect()
    assert [(r.from_time.hour, r.findings) for r in sorted(closed)] == [(10, 2), (14, 2)]  # the late one is left out, the last is still open
    slid = run(landing.sliding(found, "2 hours", "1 hour", "2 hours"), "update", tmp_path / "b").collect()
    last = {}
    for r in slid:
        last[r.from_time.day, r.from_time.hour] = max(r.findings, last.get((r.from_time.day, r.from_time.hour), 0))
    assert last == {(1, 9): 2, (1, 10): 2, (1, 13): 2, (1, 14): 2, (2, 13): 1, (2, 14): 1}


@pytest.mark.parametrize("name", ["stream_findings", "stream_grades", "stream_once", "stream_sessions", "stream_sliding", "stream_status", "stream_valid"])
def test_a_table_in_many_files_is_streamed_like_one_file(spark, tmp_path, name):
    """The same rows as a folder of part files."""
    spark.read.parquet(f"{SF}/documents.parquet").limit(60).repartition(3).write.parquet(str(tmp_path / "many/documents.parquet"))
    (tmp_path / "one").mkdir()
    spark.read.parquet(str(tmp_path / "many/documents.parquet")).toPandas().to_parquet(tmp_path / "one/documents.parquet")
    for folder in ("many", "one"):
        spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(str(tmp_path / folder / "events.parquet"))
    many, one = (sorted(map(str, queries.QUERIES[name](spark, str(tmp_path / folder)).collect())) for folder in ("many", "one"))
    assert many == one and many


def test_a_stream_of_nothing_has_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    counted = landing.arrivals(landing.landing_tables(spark, str(tmp_path / "in")))
    assert queries._run(counted, "update").collect() == []
