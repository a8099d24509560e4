"""Files in parts: findings equal those of whole files, whatever the parts."""

import random

import pytest
from pyspark.sql import functions as F

from sigsift.catalog import Rule
from sigsift.config import ScanConfig
from sigsift.operators import chunked
from sigsift.plans.queries import QUERIES
from sigsift.plans.scan import findings_of_parts, scan
from sigsift.session import Scratch
from sigsift.sources import parts as sources
from sigsift.sources.corpus import SEEDS
from tests.conftest import SF
from tests.test_rules import CASES, PARTS

LINES = [hit for hit, _ in CASES.values()] + [miss for _, miss in CASES.values()] + [
    "$a = 1;", "", "  ", "/* ünï😀 */", "echo 'x'", "$x = `ls`;", "// like 'abc", "foo($a[1]);", "esc_html($a);", "$wpdb->query(", "if (isset($_POST['a'", "echo $b", "$_GET['k", " ", "a\x0bb;",
    "preg_replace('", "wp_ajax_x", "function y() {", "ini_set('a',", "x" * 600 + ";",
]


def texts(seed):
    rng = random.Random(seed)
    out = {}
    for n in range(6):
        lines = [rng.choice(LINES) + rng.choice([";", ";", ";", "", " ;\r", "; \t", ")]'\";"]) for _ in range(rng.choice([3, 40, 400]))]
        out[f"f{n}.{rng.choice(['php', 'php', 'js'])}"] = "\n".join(lines) + rng.choice(["", "\n", ";"])
    out["open.php"] = "echo $wpdb " * 300 + "\n" + "$a;\n" * 50 + "echo `$x;\n" + "$a;\n" * 50
    out["parts.php"] = "".join(rng.choices([*PARTS, ";\n", ";\n", ")\n", "];\n"], k=1500))
    out["seeds.php"] = ";\n".join(SEEDS)
    out["packed.php"] = "".join(chr(rng.randrange(33, 600)) for _ in range(3000)) + ";\n" + "eval(base64_decode($x));\n" * 30
    out["empty.php"] = ""
    return out


def rows(findings):
    names = sorted(findings.columns)
    return sorted((tuple(r[n] for n in names) for r in findings.collect()), key=str)


CONFIG = ScanConfig(deep=True, wide_lines=12)


@pytest.mark.parametrize("seed", [1, 2])
def test_findings_of_any_parts(spark, files, seed):
    frame = files({k: t.encode() + b"\xff\x80\xe2\x82" * (k == "f0.php") for k, t in texts(seed).items()}).cache()
    want = rows(scan(frame, CONFIG).all_findings)
    assert len(want) > 300
    for size in (70, 700, 5_000, 10**6):
        parts = sources.cut(frame.select("scan_id", "path", "content"), size)
        whole = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("x"))
        joined = {r.path: b"".join(bytes(x.content) for x in r.x) for r in whole.collect()}
        assert joined == {r.path: bytes(r.content) for r in frame.collect() if r.content}
        assert rows(findings_of_parts(parts, CONFIG)) == want, size


def test_large_files_are_cut(spark, files):
    text = "".join(f"$a{n} = foo($b['{n}']);\n" + ("echo $_GET['q'];\n" if n % 500 == 0 else "") for n in range(20_000))
    frame = files({"a.php": text}).select("scan_id", "path", "content")
    pieces = chunked.pieces(sources.cut(frame, 20_000).withColumn("language", F.lit("php")), ScanConfig())
    sizes = [r.n for r in pieces.select(F.length("text").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < 45_000 and sum(sizes) == len(text)


def test_lines_of_large_files(spark, tmp_path):
    folder = tmp_path / "pkg"
    folder.mkdir()
    made = texts(3)
    for name, text in made.items():
        (folder / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        read = sources.from_lines(spark, str(tmp_path), "*.php").cache()
        assert read.select("part").distinct().count() > 3
        want = scan(spark.createDataFrame([("pkg", k, bytearray(t.encode())) for k, t in made.items() if k.endswith("php")], "scan_id string, path string, content binary").withColumn("length", F.octet_length("content").cast("bigint")), CONFIG)
        assert rows(findings_of_parts(read, CONFIG)) == rows(want.all_findings)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rules_that_may_cross_a_cut(spark, files):
    own = (Rule("X-1", "any", 5, r"a[\s\S]*b"), Rule("X-2", "text", 5, "a;b", is_regex=False), Rule("X-3", "text", 5, "ab", is_regex=False), Rule("X-4", "named", 5, r"a\d", one_statement=True))
    assert chunked.unfit(own) == ["X-1", "X-2"]
    with pytest.raises(ValueError, match="X-1, X-2"):
        chunked.file_findings(sources.cut(files({"a.php": "x"})).withColumn("language", F.lit("php")), ScanConfig(rules=own))


def test_query_equals_the_plan_of_whole_files(spark):
    assert rows(QUERIES["chunked_findings"](spark, SF)) == rows(QUERIES["all_findings"](spark, SF))


def test_bytes_are_summed_without_a_row_for_each_value(spark, monkeypatch):
    """Histograms of parts add up in 256 sums a file; none is opened into rows."""
    seen = []
    monkeypatch.setattr(chunked, "entropy_of", lambda counts, kept=chunked.entropy_of: seen.append(str(counts._jc)) or kept(counts))
    text = "".join(f"$a{n} = foo($b);\n" for n in range(50))
    files = spark.createDataFrame([("p", "a.php", bytearray(text.encode()))], "scan_id string, path string, content binary")
    findings_of_parts(sources.cut(files, 100), ScanConfig(deep=True)).collect()
    assert len(seen) == 1 and "_255" in seen[0]


def test_lines_at_the_ends_of_a_file_are_not_kept(spark, files, monkeypatch):
    """Nothing of a file in one piece is written twice, and no table of text outlives the next."""
    tables, texts_at_once = {}, []
    pinned = Scratch.pin

    def pin(self, name, frame):
        out = tables[name] = pinned(self, name, frame)
        texts_at_once.append({t for t in self._folders if "text" in tables[t].columns})
        return out

    monkeypatch.setattr(Scratch, "pin", pin)
    long = "".join(f"$a{n} = foo($b);\n" for n in range(400))
    parts = sources.cut(files({"short.php": "eval($_GET['a']);\n$b;\n", "long.php": long}).select("scan_id", "path", "content"), 1000)
    found = findings_of_parts(parts, ScanConfig(deep=True))
    assert len(found.collect()) > 0
    rows = tables["scanned"].orderBy("path", "piece").collect()
    assert [r.first_lines for r in rows if r.piece == 0] == [None, None] and rows[-1].path == "short.php" and rows[-1].last_lines is None
    inner = [r for r in rows if r.path == "long.php"]
    assert len(inner) > 2 and inner[-1].last_lines is None and all(r.first_lines for r in inner[1:]) and all(r.last_lines for r in inner[:-1])
    assert max(map(len, texts_at_once)) == 2 and "_ends" in tables["kept"].columns
