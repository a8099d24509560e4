"""Files in parts, for files that are too large to be one value or one task.

``parts(scan_id, path, part, content)``: the contents of a file's parts, in the
order of ``part``, are the file.  No part ends within a character or between CR
and LF.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsift.functions import paths
from sigsift.session import pin

PART_BYTES = 64 * 1024 * 1024


def cut(files: DataFrame, size: int = PART_BYTES) -> DataFrame:
    """Parts of about ``size`` bytes of files(scan_id, path, content); other columns ride along.  Empty files have no parts."""
    def moved(at):
        """Behind what is left of a character, or the LF of a CRLF."""
        rest = F.regexp_extract(F.hex(F.substring(F.col("content"), at + 1, F.lit(4))), "^((?:[89AB][0-9A-F])*)", 1)
        inside = F.when(F.length(rest) < 8, F.length(rest) / 2).otherwise(0).cast("int")
        broken = F.substring(F.col("content"), at, F.lit(2)) == F.lit(b"\r\n")
        return F.when((at > 0) & broken, at + 1).otherwise(at + inside)

    length = F.octet_length("content")
    starts = F.transform(F.sequence(F.lit(0), F.floor((length - 1) / size).cast("int")), lambda n: moved((n * size).cast("int")))
    # a part that is all moved into the one before is left out
    starts = F.array_sort(F.array_distinct(F.filter(starts, lambda s: s < length)))
    placed = files.where(length > 0).withColumn("_starts", starts)
    opened = placed.select(*files.columns, "_starts", F.posexplode("_starts").alias("part", "_from"))
    upto = F.coalesce(F.get("_starts", F.col("part") + 1), length)
    return opened.withColumn("content", F.substring(F.col("content"), F.col("_from") + 1, upto - F.col("_from"))).drop("_starts", "_from")


def from_lines(spark: SparkSession, root: str, names: str, one_package: bool = False) -> DataFrame:
    """Parts of the files below ``root`` whose names fit the glob ``names``, read in splits, whatever their size.

    A split is ``spark.sql.files.maxPartitionBytes``, so one file covers many
    tasks.  Files are split at line feeds; a stretch without any is one line and
    has to fit a value.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).option("lineSep", "\n").text(root)
        .select("_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))
    )

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task reads the lines of a split in order, so its batches are numbered as they come
        number = 0
        for batch in batches:
            split = (batch["file_path"] != batch["file_path"].shift()) | (batch["file_block_start"] != batch["file_block_start"].shift())
            for _, part in batch.groupby(split.cumsum(), sort=False):
                first = part.iloc[0]
                content = b"\n".join(part["value"]) + b"\n"
                yield pd.DataFrame([(first.file_path, first.file_size, first.file_block_start, number, content)], columns=["file", "size", "start", "number", "content"])
                number += 1

    read = lines.mapInPandas(joined, "file string, size long, start long, number long, content binary")
    root = root.rstrip("/")
    inside = paths.below(F.col("file"), root)
    scan_id, path = (F.lit(root.rsplit("/", 1)[-1]), inside) if one_package else (F.substring_index(inside, "/", 1), F.regexp_replace(inside, "^[^/]*/", ""))
    kept = pin(read.select(scan_id.alias("scan_id"), path.alias("path"), F.struct("start", "number").alias("part"), "content", F.col("size").alias("_size")))
    # a file without a line feed at its end has got one; only such files' last parts are in the joined table
    longer = F.sum(F.octet_length("content")) > F.first("_size")
    ends = kept.groupBy("scan_id", "path").agg(F.max("part").alias("part"), longer.alias("_longer")).where("_longer")
    content = F.when(F.col("_longer"), F.substring(F.col("content"), F.lit(1), F.octet_length("content") - 1)).otherwise(F.col("content"))
    return kept.join(ends, ["scan_id", "path", "part"], "left").select("scan_id", "path", "part", content.alias("content"))
