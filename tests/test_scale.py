"""Hot keys and plan shapes."""

import re

import pytest
from pyspark.sql import functions as F

from sigsift.operators import summary
from sigsift.operators.ordering import with_ordinal, with_running
from sigsift.plans import scan as scans
from sigsift.plans.queries import QUERIES
from sigsift.plans.scan import explode_findings, scan_files
from sigsift.config import ScanConfig
from sigsift.session import attach
from sigsift.sources import archives, corpus
from tests.conftest import SF


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third and more of the rows under one key."""
    return spark.range(9000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("scan_id"),
        (F.col("id") * 7919 % 9001).alias("at"),
        (F.col("id") % 5).alias("size"),
    )


def test_running_totals_with_a_hot_key(skewed):
    got = with_running(skewed, "scan_id", [F.col("at")], F.col("size"), "total", slices=7)
    rows = sorted((r.scan_id, r.at, r["size"], r.total) for r in got.collect())
    totals, want = {}, []
    for scan_id, at, size, _ in rows:
        totals[scan_id] = totals.get(scan_id, 0) + size
        want.append((scan_id, at, size, totals[scan_id]))
    assert rows == want and len(rows) == 9000


def test_ordinals_with_a_hot_key_use_many_tasks(skewed):
    got = with_ordinal(skewed, "scan_id", [F.col("at").desc()], "n", slices=8)
    hot = [r.n for r in got.where("scan_id = 'hot'").orderBy(F.col("at").desc()).collect()]
    assert hot == list(range(1, len(hot) + 1))
    share = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]
    assert share < 9000 * 0.6


def test_attach_keeps_all_rows_of_a_hot_key(spark, skewed):
    names = skewed.select("scan_id").distinct().withColumn("name", F.upper("scan_id"))
    joined = attach(skewed, names, "scan_id", ["at"])
    assert joined.count() == 9000 and joined.where("name <> upper(scan_id)").count() == 0
    semi = attach(skewed, names.where("scan_id = 'hot'").select("scan_id"), "scan_id", ["at"], "left_semi")
    assert semi.count() == skewed.where("scan_id = 'hot'").count()


def test_scan_is_one_narrow_pass(spark):
    files = corpus.document_files(spark, SF)
    text = plan(explode_findings(scan_files(files, ScanConfig()), ScanConfig()))
    # the only exchanges are the source's own spreading and the broadcast of the rules
    assert text.count("Exchange") - text.count("BroadcastExchange") - text.count("RoundRobin") == 0
    assert text.count("FileScan parquet") == 1 and text.count("ArrowEvalPython") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text


def test_unused_columns_cost_nothing(spark):
    text = plan(scan_files(corpus.document_files(spark, SF), ScanConfig()).select("scan_id", "path", "lines"))
    assert text.count("ArrowEvalPython") == 0
    assert text.count("cryptonight") == 0
    listed = plan(QUERIES["archive_gate"](spark, SF))
    assert "text" not in "".join(re.findall("ReadSchema: .*", listed))


def test_top_findings_limit_before_the_shuffle(spark, skewed):
    found = skewed.select("scan_id", F.lit(False).alias("false_positive"), F.lit(5).alias("severity"), F.lit("p").alias("path"),
                          F.lit(1).alias("line_number"), F.lit(1).alias("rule_ord"), F.col("at").alias("match_start"))
    top = summary.top_findings(found)
    text = plan(top)
    assert text.count("WindowGroupLimit") >= 2
    assert top.where("scan_id = 'hot'").count() == 20


def test_counts_are_partial_before_the_shuffle(spark):
    text = plan(summary.severity_counts(explode_findings(scan_files(corpus.document_files(spark, SF), ScanConfig()), ScanConfig())))
    assert len(re.findall("HashAggregate", text)) == 2


def test_scan_with_a_hot_package(spark):
    """Two thirds of all files in one package: same numbers as a window over the package."""
    from pyspark.sql import Window

    from sigsift.plans.scan import scan

    key = F.when(F.crc32(F.col("path").cast("binary")) % 3 < 2, "hot").otherwise(F.col("scan_id"))
    files = corpus.corpus_files(spark, SF).withColumn("scan_id", key)
    found = scan(files, ScanConfig()).pinned().all_findings
    window = Window.partitionBy("scan_id").orderBy(*summary.order_keys())
    columns = ["scan_id", "path", "rule_id", "match_start", "n"]
    plain = found.withColumn("n", F.row_number().over(window).cast("bigint")).select(*columns)
    spread_out = with_ordinal(found, "scan_id", summary.order_keys(), "n", slices=6).select(*columns)
    assert plain.exceptAll(spread_out).count() == 0 and spread_out.exceptAll(plain).count() == 0
    assert plain.where("scan_id = 'hot'").count() > plain.count() / 2


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    from sigsift.session import work_folder

    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="local-cluster[2,1,1024]")
    with pytest.raises(ValueError):
        work_folder(SimpleNamespace(sparkContext=context, conf=conf))
    assert work_folder(spark) == work_folder(spark)


@pytest.mark.parametrize("name", ["heuristic_scores", "finding_order", "language_rollup", "distinct_scan", "rescan_findings"])
def test_contents_reach_python_a_few_at_a_time(spark, monkeypatch, name):
    """An Arrow batch would hold ten thousand contents."""
    evaluated = []
    monkeypatch.setattr(scans, "_facts", lambda *a, kept=scans._facts, **kw: evaluated.append(kept(*a, **kw)) or evaluated[-1])
    QUERIES[name](spark, SF)
    plans = [plan(frame.select("entropy")) for frame in evaluated]
    assert plans and all("BatchEvalPython" in p and "ArrowEvalPython" not in p for p in plans)


def test_archives_reach_python_a_few_at_a_time(spark, monkeypatch):
    """Directories are read a hundred archives at a time, members of one archive at a time."""
    kept = []
    monkeypatch.setattr(archives, "pin", lambda frame: kept.append(frame) or frame)
    archives.expand(corpus.document_archives(spark, SF))
    text = plan(kept[0])
    assert "BatchEvalPython [list_members" in text and "MapInArrow" in text and "ArrowEvalPython" not in text
