"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by pseudo-rotations, signs and fast Hadamard transforms, and
belongs to the signed axis it is nearest to.  Each table has rotations of its own
and a bucket for each axis, or for each combination of axes.  A query looks
into the buckets of its nearest axes in every table, and what it finds is
compared exactly, in double precision on the original vectors.

Nearness is the inner product.  Vectors are hashed by direction and kept apart
in bands of like length, so that a long vector is not missed for its angle.
Copies of one vector are indexed by their smallest ids only, one more than the
neighbours asked for: no other copy can be among them.  Rows that repeat both the
id and the vector are one.

Rotations are random, so the chance that probing finds a vector depends on its
angle alone.  A band is searched whole for a query that found too few, or whose
last neighbour is so weak that a vector of the band could beat it at an angle at
which probing is likely to miss.

A bucket is dealt out in blocks of rows and of queries, so a third of all
vectors in one bucket cover as many tasks as they fill blocks.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part.  An empty table has no result, and a query
without another vector has no row.  Rows that repeat an id with another vector are
candidates of their own, and none is its own id's neighbour.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsift.session import pin

TABLES = 8
PROBES = 16
AXES = 1
BLOCK = 1024
BAND = 1.25
SEED = 11
NEARLY = 1e-9
#: The chance of being found at which probing is trusted, and the pairs of vectors it is measured on.
TRUST = 0.9
TRIALS = 400


def _hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of every row; a power of two long."""
    count, size = rows.shape
    step = 1
    while step < size:
        pairs = rows.reshape(count, size // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(count, size)
        step *= 2
    return rows / np.sqrt(size)


def _turned(rows: np.ndarray, table: int, axis: int) -> np.ndarray:
    """Rows in the pseudo-rotation of a table and axis, as nearness to the axes: those with a plus, then those with a minus."""
    size = 1 << max(0, int(rows.shape[1] - 1).bit_length())
    padded = np.zeros((len(rows), size))
    padded[:, : rows.shape[1]] = rows
    signs = np.random.default_rng([SEED, table, axis]).choice([-1.0, 1.0], (3, size))
    for s in signs:
        padded = _hadamard(padded * s)
    return np.concatenate([padded, -padded], axis=1)


def _buckets(rows: np.ndarray, tables: int, axes: int, probes: int) -> np.ndarray:
    """(row, table, probe): the nearest buckets of every row, nearest first."""
    out = np.empty((len(rows), tables, probes), np.int64)
    for table in range(tables):
        number, loss = np.zeros((len(rows), 1), np.int64), np.zeros((len(rows), 1))
        for axis in range(axes):
            near = _turned(rows, table, axis)
            width = near.shape[1]
            best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            missed = near.max(axis=1, keepdims=True) - np.take_along_axis(near, best, axis=1)
            loss = (loss[:, :, None] + (missed**2)[:, None, :]).reshape(len(rows), -1)
            number = (number[:, :, None] * width + best[:, None, :]).reshape(len(rows), -1)
            order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            loss, number = np.take_along_axis(loss, order, axis=1), np.take_along_axis(number, order, axis=1)
        out[:, table, :] = number[:, np.minimum(np.arange(probes), number.shape[1] - 1)]
    return out


def trusted(size: int, tables: int, probes: int, axes: int) -> float:
    """The least cosine, to a hundredth, at which probing finds a vector with the chance ``TRUST``; -1 if it finds any."""
    rng = np.random.default_rng([SEED, size])
    one, other = rng.normal(size=(2, TRIALS, size))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), NEARLY)
    probed = _buckets(one, tables, axes, probes)

    def found(cosine: float) -> bool:
        own = _buckets(cosine * one + np.sqrt(1 - cosine * cosine) * other, tables, axes, 1)
        return (probed == own).any(axis=2).any(axis=1).mean() >= TRUST

    if found(-1.0):
        return -1.0
    low, high = -100, 100
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if found(middle / 100) else (middle, high)
    return high / 100


def _coded(vectors: DataFrame, tables: int, axes: int, probes: int) -> DataFrame:
    """Adds _at, one row for each table and bucket: struct(table, bucket, band)."""
    @F.pandas_udf("array<array<long>>")
    def code(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        rows = np.stack(column.to_numpy()).astype(np.float64)
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        return pd.Series([[list(dict.fromkeys(t)) for t in row] for row in _buckets(rows, tables, axes, probes).tolist()])

    opened = vectors.withColumn("_codes", code("_vector")).select("_id", "_vector", "_band", F.posexplode("_codes").alias("_table", "_in"))
    return opened.select("_id", "_vector", "_band", "_table", F.explode("_in").alias("_bucket"))


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(_id, _vector, _norm, _band) of the vectors that take part."""
    rows = table.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_vector")).where("_id IS NOT NULL AND size(_vector) > 0")
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("_vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.where(finite).withColumn("_norm", norm).where("_norm > 0")
    length = rows.groupBy(F.size("_vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("_vector") == (length["n"] if length else 0))
    return rows.select("_id", "_vector", "_norm", F.round(F.log("_norm") / np.log(BAND)).cast("int").alias("_band"))


def _compared(stored: DataFrame, asked: DataFrame, place: list[str], count: int, block: int) -> DataFrame:
    """(query_id, _less, _id): for every row of ``asked`` the nearest ``count`` of a block of ``stored`` with the same place; _less is -score."""
    bands = stored.groupBy(*place).agg(F.count(F.lit(1)).alias("_rows"))
    wanted = asked.groupBy(*place).agg(F.count(F.lit(1)).alias("_asked"))
    sizes = pin(bands.join(wanted, place).select(*place, F.ceil(F.col("_rows") / block).alias("_parts"), F.ceil(F.col("_asked") / block).alias("_rounds")))
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = stored.join(sizes, place).withColumn("_part", F.pmod(F.xxhash64("_id", "_vector"), F.col("_parts"))).withColumn("_round", other("_rounds"))
    right = asked.join(sizes, place).withColumn("_round", F.pmod(F.xxhash64("_id"), F.col("_rounds"))).withColumn("_part", other("_parts"))
    group = [*place, "_part", "_round"]

    def search(stored: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(stored) or not len(wanted):
            return pd.DataFrame({"query_id": [], "_ids": [], "_scores": []})
        ids, asking = stored["_id"].to_numpy(), wanted["_id"].to_numpy()
        base, ask = np.stack(stored["_vector"].to_numpy()), np.stack(wanted["_vector"].to_numpy())
        product = ask @ base.T
        product[asking[:, None] == ids[None, :]] = -np.inf
        found, scores = [], []
        last = len(ids) - min(count, len(ids))
        least = np.partition(product, last, axis=1)[:, last] if last else np.full(len(ask), -np.inf)
        for n in range(len(ask)):
            near = np.flatnonzero((product[n] >= least[n] - NEARLY) & (product[n] > -np.inf))
            # summed in one order whatever the block, so that copies score alike
            exact = (base[near] * ask[n]).sum(axis=1)
            order = np.lexsort((ids[near], -exact))[:count]
            found.append(ids[near][order])
            scores.append(exact[order])
        return pd.DataFrame({"query_id": asking, "_ids": found, "_scores": scores})

    sparse = left.select(*group, "_id", "_vector").groupBy(*group).cogroup(right.select(*group, "_id", "_vector").groupBy(*group))
    kind = stored.schema["_id"].dataType.simpleString()
    part = sparse.applyInPandas(search, f"query_id {kind}, _ids array<{kind}>, _scores array<double>")
    return part.select("query_id", F.inline(F.arrays_zip("_ids", "_scores"))).select("query_id", (-F.col("_scores")).alias("_less"), F.col("_ids").alias("_id"))


def _merged(found: DataFrame, count: int) -> DataFrame:
    """(query_id, _less, _id, rank): the nearest ``count`` of all that was found for a query, each once; no list holds what all blocks found."""
    once = found.groupBy("query_id", "_id", "_less").agg(F.lit(1).alias("_once"))
    order = Window.partitionBy("query_id").orderBy("_less", "_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).drop("_once")


def nearest(
    table: DataFrame, queries: Column, count: int = 20, key: str = "vec_id", vector: str = "embedding",
    tables: int = TABLES, probes: int = PROBES, axes: int = AXES, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row for which ``queries``, a condition on the key, holds."""
    rows = pin(usable(table, key, vector))
    # an id counts once among the copies of a vector: a query's own copies take no place of another's
    copies = Window.partitionBy("_vector").orderBy("_id")
    ids = rows.dropDuplicates(["_id", "_vector"])
    stored = pin(ids.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= count + 1).drop("_copy"))
    index = pin(_coded(stored, tables, axes, 1))
    wanted = rows.withColumn(key, F.col("_id")).where(queries).select(rows["_id"], rows["_vector"], rows["_norm"], rows["_band"])
    filled = index.select("_band", "_table", "_bucket").distinct()
    asked = pin(_coded(wanted, tables, axes, probes).drop("_band").join(filled, ["_table", "_bucket"]))
    found = pin(_merged(_compared(index, asked, ["_band", "_table", "_bucket"], count, block), count))

    first = stored.first()
    least = trusted(len(first["_vector"]), tables, probes, axes) if first else -1.0
    lengths = stored.groupBy("_band").agg(F.max("_norm").alias("_longest"))
    # a query that met nothing but itself has no row here and is unsure of every band
    last = found.groupBy(F.col("query_id").alias("_of")).agg(F.count(F.lit(1)).alias("_n"), (-F.max("_less")).alias("_last"))
    doubtful = F.col("_n").isNull() | (F.col("_n") < count) | (F.col("_last") < least * F.col("_norm") * F.col("_longest"))
    unsure = wanted.join(last, F.col("_id") == F.col("_of"), "left").drop("_band").crossJoin(lengths).where(doubtful)
    whole = _compared(stored, pin(unsure.select("_id", "_vector", "_band")), ["_band"], count, block)
    merged = _merged(found.drop("rank").unionByName(whole), count)
    return merged.select("query_id", "rank", F.col("_id").alias("vec_id"), (-F.col("_less")).alias("score"))
