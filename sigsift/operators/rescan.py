"""Scans of a corpus that grows: what was scanned before with the same rules is looked up.

The store is a table of results by content digest and language, in a folder for
each set of rules and in sub-folders by the digest's first letters.  A run reads
all files once for their digests, which are all that moves, and a second time
only to scan one file of each content that the store has not; the results are
appended and all files' findings are taken from the store.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sigsift.config import ScanConfig
from sigsift.operators import duplicates, inventory, matching
from sigsift.session import pin

KEY = ["sha256", "language"]
STORED = f"sha256 string, language string, findings {matching.MATCH_TYPE}, shelf string"
#: Letters of the digest that name a sub-folder: 256 of them.
SHELF = 2


def rule_set(config: ScanConfig) -> str:
    """A digest of everything that shapes the findings of a content; which files are scanned is no part of it."""
    shaping = (
        config.threshold, config.max_text_bytes, config.nul_probe_bytes, config.max_matches, config.max_signals, config.deep, config.context_lines, config.wide_lines,
        [(r.rule_id, r.severity, r.search_pattern, r.literals, r.languages, r.suppressors) for r in config.rules],
    )
    return hashlib.sha256(repr(shaping).encode()).hexdigest()


def store(files: DataFrame, folder: str, config: ScanConfig) -> DataFrame:
    """The results (sha256, language, findings) that ``folder`` has for the rules of ``config``."""
    spark = files.sparkSession
    try:
        return spark.read.schema(STORED).parquet(f"{folder}/rules={rule_set(config)[:16]}")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], STORED)
        raise


def rescan(files: DataFrame, folder: str, config: ScanConfig | None = None) -> DataFrame:
    """The findings of all ``files``, as ``ScanTables.all_findings`` has them; only contents new to the store are scanned.

    One run at a time may write to a folder.
    """
    from sigsift.plans.scan import explode_findings, scan_files

    config = config or ScanConfig()
    keyed = inventory.scannable(files, config)
    places = pin(keyed.select("scan_id", "path", "language", F.sha2("content", 256).alias("sha256")))
    known = store(files, folder, config).select(*KEY)
    fresh = places.join(known, KEY, "left_anti").groupBy(*KEY).agg(F.min(F.struct("scan_id", "path")).alias("at"))
    chosen = pin(fresh.select("at.scan_id", "at.path", *KEY))
    if not chosen.isEmpty():
        # the digest is known by the file's place, so only results are joined and no content
        scanned = scan_files(files.join(chosen.select("scan_id", "path"), ["scan_id", "path"], "left_semi"), config).select("scan_id", "path", "findings")
        results = chosen.join(scanned, ["scan_id", "path"]).dropDuplicates(KEY).select(*KEY, "findings", F.left("sha256", F.lit(SHELF)).alias("shelf"))
        results.write.mode("append").partitionBy("shelf").parquet(f"{folder}/rules={rule_set(config)[:16]}")
    # only contents with findings go back to their files
    stored = store(files, folder, config).where(F.size("findings") > 0)
    found = explode_findings(stored.select(F.lit("").alias("scan_id"), F.col("sha256").alias("path"), "language", "findings"), config)
    return duplicates.at_places(found.withColumnRenamed("path", "sha256").drop("scan_id"), places, KEY).drop("sha256")
