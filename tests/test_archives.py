"""ZIP archives: listing, refusal, expansion."""

import io
import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from sigsift.config import ScanConfig
from sigsift.plans.scan import scan
from sigsift.sources import archives
from tests.conftest import HEADER, README


def zipped(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return buffer.getvalue()


def link(name):
    info = zipfile.ZipInfo(name)
    info.external_attr = (stat.S_IFLNK | 0o777) << 16
    return info


def locked(data):
    """Sets the encryption flag of every entry."""
    raw = bytearray(data)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        start = raw.find(mark)
        while start >= 0:
            raw[start + at] |= 1
            start = raw.find(mark, start + 4)
    return bytes(raw)


def damaged(data):
    raw = bytearray(data)
    raw[raw.find(b"PK\x03\x04") + 40] ^= 0xFF
    return bytes(raw)


GOOD = [("p/", b""), ("p/readme.txt", README), ("p/a.php", HEADER), ("p/./b.php", "old"), ("p/b.php", "phpinfo();")]
CASES = {
    "good.zip": zipped(GOOD),
    "broken.zip": b"this is no archive",
    "plain.txt": b"neither",
    "up.zip": zipped([("a.php", HEADER), ("../evil.php", "x")]),
    "updown.zip": zipped([("x/../../evil.php", "x")]),
    "inside.zip": zipped([("x/../a.php", HEADER)]),
    "abs.zip": zipped([("/etc/x.php", "x"), ("../evil.php", "x")]),
    "link.zip": zipped([("a.php", HEADER), (link("l"), "a.php")]),
    "locked.zip": locked(zipped([("a.php", HEADER)])),
    "damaged.zip": damaged(zipped([("a.php", HEADER * 50)])),
}


@pytest.fixture(scope="module")
def opened(spark):
    frame = spark.createDataFrame([(n, bytearray(c)) for n, c in CASES.items()], "scan_id string, content binary")
    return archives.expand(frame)


def test_errors(opened):
    got = {r.scan_id: r.message for r in opened[1].collect()}
    assert got.pop("damaged.zip").startswith("Failed to extract ZIP: ")
    assert got == {
        "broken.zip": "Invalid ZIP archive: The file is not a valid or readable ZIP.",
        "plain.txt": "Target must be a directory or a valid .zip file.",
        "up.zip": "Failed to extract ZIP: " + archives.TRAVERSAL,
        "updown.zip": "Failed to extract ZIP: " + archives.TRAVERSAL,
        "abs.zip": "Failed to extract ZIP: " + archives.ABSOLUTE,
        "link.zip": "Failed to extract ZIP: " + archives.SYMLINK,
        "locked.zip": "Failed to extract ZIP: " + archives.LOCKED,
    }
    assert opened[1].where("NOT fatal").count() == 0


def test_files(opened):
    got = {(r.scan_id, r.path): bytes(r.content) for r in opened[0].collect()}
    assert set(got) == {("good.zip", "p/readme.txt"), ("good.zip", "p/a.php"), ("good.zip", "p/b.php"), ("inside.zip", "a.php")}
    assert got["good.zip", "p/b.php"] == b"phpinfo();"


def test_scan_of_archives(opened):
    content, errors = opened
    t = scan(content, ScanConfig(), archive_errors=errors)
    assert {r.scan_id for r in t.scans.collect()} == {"good.zip", "inside.zip"}
    assert "PHP-INFO-001" in {r.rule_id for r in t.findings.collect()}
    assert t.scan_errors.count() == errors.count()


def test_folder_of_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(CASES["good.zip"])
    (tmp_path / "b.zip").write_bytes(b"no")
    content, errors = archives.expand(archives.from_archives(spark, str(tmp_path)))
    assert {r.scan_id for r in content.collect()} == {"a.zip"}
    assert [r.scan_id for r in errors.collect()] == ["b.zip"]


def test_same_name_in_two_folders(spark, tmp_path):
    for n, text in (("v1", "phpinfo();"), ("v2", "md5($p);")):
        (tmp_path / n).mkdir()
        (tmp_path / n / "a.zip").write_bytes(zipped([("readme.txt", README), (f"{n}.php", text)]))
    content, _ = archives.expand(archives.from_archives(spark, str(tmp_path)))
    assert {(r.scan_id, r.path) for r in content.collect()} == {
        (f"{n}/a.zip", p) for n in ("v1", "v2") for p in ("readme.txt", f"{n}.php")
    }


def test_limit_of_size_and_nameless_entries(spark):
    big = zipped([("", b"x" * 900), ("a.php", b"x" * 200)])
    frame = spark.createDataFrame([("a.zip", bytearray(big))], "scan_id string, content binary")
    for most, refused in ((1000, 0), (150, 1), (None, 0)):
        assert archives.expand(frame, ScanConfig(max_archive_bytes=most))[1].count() == refused


def test_gate_takes_the_first_fault(spark):
    big = 300 * 1024 * 1024
    rows = [
        ("size", 1, "a", big, 0o644), ("size", 2, "b", big, 0o644), ("size", 3, "../c", 1, 0o644),
        ("path", 1, "", 1, 0o644), ("path", 2, "a/../../b", 1, 0o644), ("path", 3, "/b", big * 2, 0o644),
        ("fine", 1, "a/../b", big, 0o644),
    ]
    frame = spark.createDataFrame(rows, "scan_id string, member_ord int, name string, size bigint, mode int")
    got = {r.scan_id: (r.fault, r.fault_member) for r in archives.gate(frame).collect()}
    assert got == {"size": (archives.TOO_LARGE, 2), "path": (archives.TRAVERSAL, 2), "fine": (None, None)}
    assert archives.gate(frame.where(F.lit(False))).count() == 0
