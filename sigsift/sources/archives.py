"""ZIP archives as a source: list, check, expand.

An archive is one row.  Its directory is read first; only archives that pass
the checks are inflated, next to where they were read: once to test every
member, then member by member, so that memory holds the archive and some MB.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigsift.config import MAX_ARCHIVE_BYTES, ScanConfig
from sigsift.functions import paths
from sigsift.operators import metadata
from sigsift.operators.ordering import with_running
from sigsift.session import pin

# Why an archive is refused.
TOO_LARGE = "ZIP archive expands beyond the maximum safe size."
ABSOLUTE = "ZIP archive contains unsafe absolute paths."
TRAVERSAL = "ZIP archive contains unsafe path traversal entries."
SYMLINK = "ZIP archive contains symbolic links, which are not supported."
LOCKED = "ZIP archive contains encrypted or unsupported entries."
TYPE_BITS, SYMLINK_BITS = 0o170000, 0o120000

MEMBER_TYPE = T.ArrayType(
    T.StructType()
    .add("name", T.StringType())
    .add("size", T.LongType())
    .add("mode", T.IntegerType())
    .add("is_dir", T.BooleanType())
    .add("locked", T.BooleanType())
)
_BATCH_BYTES = 16 * 1024 * 1024
_STEP_BYTES = 1024 * 1024
_METHODS = {zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA}


def from_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of a folder as a candidate archive, named by its path below the folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return as_archives(raw, folder)


def as_archives(raw: DataFrame, root: str) -> DataFrame:
    """Archives of equal file names in different folders stay apart."""
    return raw.select(paths.below(F.col("path"), root).alias("scan_id"), "content")


@F.udf(MEMBER_TYPE, useArrow=False)
def list_members(content: bytes | None) -> list[tuple] | None:
    """The directory of each archive; null for bytes that are not an archive."""
    try:
        infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except (zipfile.BadZipFile, ValueError, OSError):
        return None
    return [
        (i.filename, i.file_size, i.external_attr >> 16, i.is_dir(), bool(i.flag_bits & 1) or i.compress_type not in _METHODS)
        for i in infos
    ]


def leaves_root(name: Column) -> Column:
    """Whether a relative path climbs above where it starts."""
    step = lambda acc, part: (
        F.when(part.isin("", "."), acc).when(part == "..", F.struct((acc["at"] - 1).alias("at"), F.least(acc["low"], acc["at"] - 1).alias("low")))
        .otherwise(F.struct((acc["at"] + 1).alias("at"), acc["low"].alias("low")))
    )
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"))
    return F.aggregate(F.split(name, "/", -1), start, step, lambda acc: acc["low"]) < 0


def member_fault(running: Column, name: Column, mode: Column, most: int | None = MAX_ARCHIVE_BYTES) -> Column:
    """What is wrong with a member, checks in this order; null when nothing is."""
    return (
        F.when(F.lit(False) if most is None else running > most, TOO_LARGE)
        .when(F.startswith(name, F.lit("/")), ABSOLUTE)
        .when(leaves_root(name), TRAVERSAL)
        .when(mode.bitwiseAND(F.lit(TYPE_BITS)) == SYMLINK_BITS, SYMLINK)
    )


def gate(members: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """First fault per archive from a table ``(scan_id, member_ord, name, size, mode)``.

    Members come as rows here, so the running size is a distributed running
    total; the first fault is an aggregate with partial results per task.  By
    default archives that declare more than ``MAX_ARCHIVE_BYTES`` are at fault.
    """
    named = members.where(F.col("name") != "")
    summed = with_running(named, "scan_id", [F.col("member_ord")], F.col("size"), "running")
    most = config.max_archive_bytes if config else MAX_ARCHIVE_BYTES
    checked = summed.withColumn("fault", member_fault(F.col("running"), F.col("name"), F.col("mode"), most))
    first = F.when(F.col("fault").isNotNull(), F.col("member_ord"))
    return checked.groupBy("scan_id").agg(
        F.min_by("fault", first).alias("fault"),
        F.min(first).alias("fault_member"),
        F.count(F.lit(1)).alias("members"),
        F.sum("size").alias("declared_bytes"),
    )


def with_directory(archives: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Adds ``members`` and ``message`` (null: the archive may be expanded).  Entries without a name count for nothing."""
    most = (config or ScanConfig()).max_archive_bytes
    listed = archives.withColumn("members", list_members("content"))
    def step(acc: Column, m: Column) -> Column:
        total = acc["total"] + F.when(m["name"] != "", m["size"]).otherwise(0)
        fault = F.coalesce(
            acc["fault"],
            F.when(m["name"] != "", F.coalesce(member_fault(total, m["name"], m["mode"], most), F.when(m["locked"], LOCKED))),
        )
        return F.struct(total.alias("total"), fault.alias("fault"))

    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(None).cast("string").alias("fault"))
    fault = F.aggregate("members", start, step, lambda acc: acc["fault"])
    broken = F.when(F.endswith(F.lower("scan_id"), F.lit(".zip")), metadata.INVALID_ARCHIVE).otherwise(metadata.BAD_TARGET)
    message = F.when(F.col("members").isNull(), broken).otherwise(F.concat(F.lit(metadata.EXTRACT_FAILED), fault))
    return listed.withColumn("message", message)


def _members(archive: zipfile.ZipFile) -> dict[str, zipfile.ZipInfo]:
    """The entries that become files, by normal path; of equal names the last one stays."""
    return {posixpath.normpath(i.filename): i for i in archive.infolist() if i.filename and not i.is_dir()}


def _test(archive: zipfile.ZipFile) -> None:
    """Reads every file of an archive without keeping it; raises on a damaged one."""
    for info in _members(archive).values():
        with archive.open(info) as member:
            while member.read(_STEP_BYTES):
                pass


_EXPANDED = pa.schema([("scan_id", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("message", pa.string())])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EXPANDED, strict=True)], schema=_EXPANDED)

    for batch in batches:
        # one archive at a time is taken out of the batch
        for scan_id, raw, message in zip(*[batch[c] for c in ("scan_id", "content", "message")], strict=True):
            scan_id, raw, message = scan_id.as_py(), raw.as_py(), message.as_py()
            if message is not None:
                yield table([(scan_id, None, None, None, message)])
                continue
            archive = zipfile.ZipFile(io.BytesIO(raw))
            try:
                _test(archive)
            except Exception as exc:  # a damaged member spoils its archive, not the job
                yield table([(scan_id, None, None, None, f"{metadata.EXTRACT_FAILED}{exc}")])
                continue
            rows, held = [], 0
            for path, info in _members(archive).items():
                data = archive.read(info)
                rows.append((scan_id, path, len(data), data, None))
                held += len(data)
                if held > _BATCH_BYTES:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)


def expand(archives: DataFrame, config: ScanConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of ``archives(scan_id, content)``.

    Archives are opened once: what comes out is written to the shared folder, and
    both tables read it.  On a stream, which a query opens anyway, both are lazy.
    """
    listed = with_directory(archives, config).select("scan_id", F.when(F.col("message").isNull(), F.col("content")).alias("content"), "message")
    opened = listed.mapInArrow(_expand, "scan_id string, path string, length bigint, content binary, message string")
    opened = opened if opened.isStreaming else pin(opened)
    files = opened.where(F.col("message").isNull()).select("scan_id", "path", "length", "content")
    errors = opened.where(F.col("message").isNotNull()).select(
        "scan_id", F.lit(None).cast("string").alias("path"), "message", metadata.is_fatal(F.col("message")).alias("fatal")
    )
    return files, errors
