"""Lines, decoding, paths and entropy against plain Python."""

import hashlib
import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigsift.config import ScanConfig
from sigsift.functions import paths
from sigsift.functions import text as tx
from sigsift.functions.entropy import byte_histogram, entropy_of
from sigsift.operators import detectors
from sigsift.operators.inventory import size_display

EDGES = [
    "", "\n", "\r\n\r\n", "q\u0085", "z\r\r\n", "a\rb\nc\r\nd\u000be\u000cf\u001cg\u001dh\u001ei\u0085j\u2028k\u2029l", "a\u000b\r\nb", "\u000b\nb",
    "plain", "one\n", "\r", "\n\r", "x\u2028", "a\n\nb", "\U0001f600\n\U0001f600b\r\n",
]


def python_lines(text):
    raw = text.splitlines(keepends=True)
    if not raw:
        return [""], [0]
    starts, at = [], 0
    for line in raw:
        starts.append(at)
        at += len(line)
    return [line.rstrip("\r\n") for line in raw], starts


def spark_lines(spark, texts):
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").withColumn("ls", tx.line_texts(F.col("t")))
    rows = frame.select("n", "ls", tx.line_starts(F.col("t"), F.col("ls")).alias("starts"), tx.line_count(F.col("t")).alias("c")).collect()
    return {r.n: (r.ls, r.starts, r.c) for r in rows}


def check_lines(spark, texts):
    got = spark_lines(spark, texts)
    for n, t in enumerate(texts):
        lines, starts = python_lines(t)
        assert got[n] == (lines, starts, len(lines)), repr(t)


def test_line_edges(spark):
    check_lines(spark, EDGES)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab \r\n\u000b\u001c\u0085\u2028\U0001f600", max_size=40), min_size=20, max_size=60))
def test_lines_like_python(spark, texts):
    check_lines(spark, texts)


def test_running_sums_cross_blocks(spark):
    frame = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("x"))
    got = frame.select(tx.running_sums(F.col("x"))).first()[0]
    assert got == [n * (n - 1) // 2 for n in range(1, 1001)]


def test_decode(spark):
    cases = {
        b"": "", b"caf\xe9 x": "caf� x", "\ufeffa".encode(): "\ufeffa", b"a\x00b": None,
        b"a" * 8192 + b"\x00": "a" * 8192 + "\x00", b"\xe2\x82": "�", "é".encode() * 3: "ééé",
    }
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in enumerate(cases)], "n int, c binary")
    got = {r.n: r.t for r in rows.select("n", tx.decode(F.col("c"), nul_probe=8192).alias("t")).collect()}
    assert [got[n] for n in range(len(cases))] == list(cases.values())
    cut = spark.createDataFrame([(bytearray("aéé".encode()),)], "c binary").select(tx.decode(F.col("c"), 4)).first()[0]
    assert cut == "aé�"


@pytest.mark.parametrize("name", [".php", "a.tar.gz", "x.PHP", "a.", "a/b.c/d", "..php", ".a.php", "a/.git/x.js", "noext", "a b.Ts"])
def test_extension(spark, name):
    got = spark.createDataFrame([(name,)], "p string").select(paths.extension(F.col("p"))).first()[0]
    assert got == os.path.splitext(os.path.basename(name))[1].lower()


def test_directories(spark):
    names = ScanConfig().excluded
    rows = spark.createDataFrame([("build",), ("a/build/x.php",), ("a/builds/x.php",), ("node_modules/x",), ("x/.git",)], "p string")
    got = [r[0] for r in rows.select(paths.under_any(F.col("p"), names)).collect()]
    assert got == [False, True, False, True, False]


def test_entropy(spark):
    noise = b"".join(hashlib.sha256(str(n).encode()).digest() for n in range(20))
    cases = [b"", b"aaaa", b"ab", bytes(range(256)), noise, "été".encode()]

    def python(raw):
        shares = [raw.count(b) / len(raw) for b in set(raw)]
        return round(-sum(p * math.log2(p) for p in shares), 4) + 0.0

    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in enumerate(cases)], "n int, c binary")
    got = {r.n: r.e for r in rows.select("n", entropy_of(byte_histogram("c")).alias("e")).collect()}
    assert [got[n] for n in range(len(cases))] == [python(c) if c else 0.0 for c in cases]


def test_number_formats(spark):
    row = spark.range(1).select(
        size_display(F.lit(1023)), size_display(F.lit(1024)), size_display(F.lit(2048 * 1024)), tx.fixed(F.lit(6.145), 2), tx.fixed(F.lit(0.125), 2)
    ).first()
    assert list(row) == ["1023 B", "1.0 KB", "2048.0 KB", f"{6.145:.2f}", f"{0.125:.2f}"]


def test_strip(spark):
    every = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert sorted(tx.SPACES) == sorted(every)
    long = "a" + " " * 500_000 + "b"
    frame = spark.createDataFrame([(every + "x y" + every,), (long + every,), ("",)], "t string")
    got = [tuple(r) for r in frame.select(tx.strip(F.col("t")), tx.strip_end(F.col("t"))).collect()]
    assert got == [("x y", every + "x y"), (long, long), ("", "")]


def test_long_lines_by_their_lengths(spark):
    """The same as the pattern that counts to five hundred at every break, without it."""
    kept = tx.KEPT_BREAKS
    pattern = f"(?:^|[\r\n{kept}])[^\r\n{kept}]{{499}}[^\r\n]"
    texts = [x + "a" * n + y for n in (0, 498, 499, 500, 501) for x in ("", "b\r\n", " ", "b\x0b") for y in ("", "\n", "\r\n", "\u0085", "\x1c\n", "\U0001f600")]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.lit("php").alias("language"), tx.fold(F.col("text")).alias("folded"))
    out = detectors.with_signals(rows).select("text", F.rlike("text", F.lit(pattern)).alias("want"), F.col("sig.long_line").alias("got"))
    assert "{499}" not in str(detectors.text_signals()._jc)
    found = out.collect()
    assert [r.got for r in found] == [r.want for r in found] and {True, False} == {r.got for r in found}
