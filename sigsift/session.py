"""Session helpers: pinning a result, spreading work, joins that survive a hot key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the one in ``spark.checkpoint.dir``.

    Everything a session writes lies in one folder there, ``work_folder``, which
    its owner deletes when the results are no longer read.  Only a local session
    may go without the setting: executors elsewhere don't see a temporary folder
    of this machine.
    """
    return f"{work_folder(spark)}/{uuid.uuid4()}"


def work_folder(spark: SparkSession) -> str:
    """The folder below ``spark.checkpoint.dir`` that holds all intermediate tables of this session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sigsift-"))
    return context.getCheckpointDir()


def pin(frame: DataFrame, folder: str | None = None) -> DataFrame:
    """Compute once and cut the lineage: write a table to the shared folder and read it from there.

    What follows reads the columns it needs, so a lost executor costs a reread
    and not another scan.  Unlike ``checkpoint()`` this computes the rows once
    and keeps them by column.
    """
    folder = folder or shared_folder(frame.sparkSession)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is computed within leaves no shuffle files: they go when it ends, not when the driver collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


class Scratch:
    """Pinned tables of an iteration, by name: a new table replaces the last one of its name, whose files go.

    Only tables that no frame still to be computed reads may be replaced or
    dropped.  The new one is written before the old one goes, so a lost executor
    finds what it needs.  Shuffle files go as soon as a table is written.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folders: dict[str, str] = {}
        self._tables: dict[str, str] = {}

    def pin(self, name: str, frame: DataFrame) -> DataFrame:
        folder = shared_folder(self._spark)
        with shuffles_released(self._spark):
            out = pin(frame, folder)
        self.drop(name)
        self._folders[name] = folder
        return out

    def pin_in_turn(self, name: str, frames: Iterable[DataFrame]) -> DataFrame:
        """One pinned table of frames that are computed one after the other; shuffle files of each go before the next begins."""
        folder = shared_folder(self._spark)
        for frame in frames:
            with shuffles_released(self._spark):
                frame.write.mode("append").parquet(folder)
        self.drop(name)
        self._folders[name] = folder
        return self._spark.read.schema(frame.schema).parquet(folder)

    def pin_in_buckets(self, name: str, frame: DataFrame, key: str | tuple[str, ...], buckets: int) -> DataFrame:
        """A pinned table in buckets by a hash of ``key``: joins on it read the table where it lies and don't shuffle it."""
        folder = shared_folder(self._spark)
        named = f"sigsift_{name}_{uuid.uuid4().hex}"
        with shuffles_released(self._spark):
            frame.write.format("parquet").option("path", folder).bucketBy(buckets, *([key] if isinstance(key, str) else key)).saveAsTable(named)
        self.drop(name)
        self._folders[name], self._tables[name] = folder, named
        return self._spark.table(named)

    def drop(self, *names: str) -> None:
        for name in names:
            named = self._tables.pop(name, None)
            if named is not None:
                self._spark.sql(f"DROP TABLE {named}")
            folder = self._folders.pop(name, None)
            if folder is not None:
                path = self._spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


SALTS = 32


def attach(facts: DataFrame, attributes: DataFrame, key: str, spread_by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join narrow rows to one attribute row per key, whatever share one key has.

    The attribute side, one row per key, is repeated once per salt; the fact
    side is dealt out over the salts by a hash of ``spread_by``.  A key with a
    third of all rows thus lands in ``salts`` tasks.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = attributes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
