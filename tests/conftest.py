import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("sigsift-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Makes a files table from {path: text or bytes}, or from (scan_id, path, content) rows."""

    def make(contents, scan_id="pkg"):
        rows = contents if isinstance(contents, list) else [(scan_id, p, c) for p, c in contents.items()]
        rows = [(s, p, bytearray(c.encode() if isinstance(c, str) else c)) for s, p, c in rows]
        frame = spark.createDataFrame(rows, "scan_id string, path string, content binary")
        return frame.select("scan_id", "path", F.octet_length("content").cast("bigint").alias("length"), "content")

    return make


README = "\n\n=== Test Plugin ===\nStable tag: 1.2.3\n"
HEADER = "<?php\n/*\n * Plugin Name: Test Plugin\n * Version: 1.2.3\n */\n"


@pytest.fixture
def package():
    return {"readme.txt": README, "test-plugin.php": HEADER}
