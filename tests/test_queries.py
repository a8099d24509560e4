"""Registered queries against their SQL on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sigsift.plans import oracle
from sigsift.plans.queries import QUERIES
from tests.conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)
# a cross-section; the others run in the driver's own comparison
CHOSEN = (
    "corpus_files", "file_inventory", "text_gate", "line_index", "match_positions", "context_lines", "group_entropy", "heuristic_scores",
    "archive_gate", "scan_grades", "top_findings", "rule_list", "literal_rules", "nothing_scannable", "report_ids", "rescan_findings", "stream_valid", "stream_regrade", "stream_sliding", "stream_sessions", "apply_verdicts", "json_report", "stream_findings",
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def rows(names, values):
    order = sorted(range(len(names)), key=lambda n: names[n])
    return sorted((tuple(r[n] for n in order) for r in values), key=str)


def test_every_query_has_sql():
    assert QUERIES.keys() == oracle.statements().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert len(QUERIES) >= 55


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    got, want = rows(frame.columns, [tuple(r) for r in frame.collect()]), rows(names, result.fetchall())
    assert got == want and got


def test_entry(spark):
    assert entry.entry(spark).count() == 14


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, with_pipeline):
    root = Path(entry.__file__).parent
    shutil.copytree(root / "sigsift", tmp_path / "sigsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * with_pipeline:
        shutil.copy(root / name, tmp_path)
    told = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(QUERIES)), "False"]
