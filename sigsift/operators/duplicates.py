"""Equal content in many places: groups of copies, and scanning each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsift.config import ScanConfig
from sigsift.functions.entropy import summed_histograms
from sigsift.operators import inventory

#: So many copies of one content are joined to its findings in one block.
COPIES = 10_000


def duplicate_content(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Contents that occur more than once among the scanned files."""
    keyed = inventory.scannable(files, config).select("scan_id", "path", "length", F.sha2("content", 256).alias("sha256"))
    return (
        keyed.groupBy("sha256")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.countDistinct("scan_id").alias("packages"),
            F.min(F.struct("scan_id", "path")).alias("first"),
            F.sum("length").alias("bytes"),
        )
        .where(F.col("copies") > 1)
        .select("sha256", "copies", "packages", "bytes", F.col("first.scan_id").alias("first_scan"), F.col("first.path").alias("first_path"))
    )


def group_entropy(files: DataFrame, group: str) -> DataFrame:
    """Entropy of all bytes of a group; histograms add up, so no group is ever put together.

    Each batch of files gives one row per group, before anything is opened or shuffled.
    """
    kind = files.schema[group].dataType.simpleString()
    batched = files.select(group, "content").mapInPandas(summed_histograms, f"`{group}` {kind}, histogram array<bigint>")
    counted = batched.select(group, F.posexplode_outer("histogram").alias("byte", "n"))
    summed = counted.where(F.col("n") > 0).groupBy(group, "byte").agg(F.sum("n").alias("n"))
    n = F.col("n")
    total = F.sum("n")
    return summed.groupBy(group).agg(
        total.alias("bytes"),
        F.count(F.lit(1)).alias("byte_values"),
        F.abs(F.round(F.log2(total.cast("double")) - F.sum(n * F.log2(n.cast("double"))) / total, 4)).alias("entropy"),
    )


def findings_by_content(files: DataFrame, config: ScanConfig) -> DataFrame:
    """The findings of ``scan`` for corpora full of copies: each content is scanned once.

    One file per content and language is kept; copies within a task fall away
    before the shuffle, so a content with a third of all copies costs one row per
    task.  Findings go back to the copies; those of a content with many copies
    are dealt out in blocks of ``COPIES``, and only its findings are repeated.
    """
    from sigsift.plans.scan import explode_findings, scan_files

    keyed = inventory.scannable(files, config).withColumn("sha256", F.sha2("content", 256))
    key = ["sha256", "language"]
    one = keyed.select(
        *key, "extension", F.lit("").alias("scan_id"), F.concat(F.lit("x"), "extension").alias("path"), "length", "content"
    ).dropDuplicates(key)
    scanned = scan_files(one, config)
    found = explode_findings(scanned.withColumn("path", F.col("sha256")), config).withColumnRenamed("path", "sha256").drop("scan_id")
    return at_places(found, keyed.select(*key, "scan_id", "path"), key).drop("sha256")


def at_places(found: DataFrame, places: DataFrame, key: list[str]) -> DataFrame:
    """Findings of contents as findings of the files that have them; ``places`` has the key, scan_id and path."""
    many = places.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / COPIES).alias("_blocks")).where("_blocks > 1")
    blocks = F.coalesce("_blocks", F.lit(1).cast("bigint"))
    dealt = places.join(many, key, "left").withColumn("_block", F.pmod(F.xxhash64("scan_id", "path"), blocks)).drop("_blocks")
    copies = found.join(many, key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).drop("_blocks")
    return dealt.join(copies, [*key, "_block"]).drop("_block")
