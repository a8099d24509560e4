"""Hard negatives: rows of another label whose score lies in a window below that of an anchor's positives.

Rows are laid out along a Hilbert curve through the components that vary most, in
blocks, and written as Parquet.  A zone map has the least and the largest value
of each component, and of the label, in each block.  The score of an anchor with
any row of a block then lies between two sums, by interval arithmetic: each
component of the anchor times the end of the interval that makes it smallest, or
largest.  An anchor reads a block only if that range meets one of its windows,
and if the block may hold the label, or another one.

Both searches go the same way: an anchor reads the block it lies in, where its
near rows are likely; what is found there raises the lower ends of its windows,
and it then reads the blocks that may still hold better rows.  Positives are one
window without ends; negatives have a window for each positive.  Bounds decide
what is read, never what is found: results are exact for any data.  Where
intervals are wide in every component, as with directions spread evenly in many
dimensions, most blocks must be read.

Blocks that many anchors read are repeated for parts of them; a slice of the
curve is cut by rows, so copies of a vector fill as many blocks as they need.

Rows without an id or a label, and vectors that are null, hold null or
non-finite components, or components of ``vectors.LIMIT`` or more once scaled,
take no part.  Vectors are compared with those of their size.  Rows that repeat
an id are rows of their own, each anchor asks for itself, and none is a positive
or negative of its own id.  An empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsift.llm.vectors import SCALE, asked, best, dealt, matrix, products, whole_vectors
from sigsift.session import pin, shared_folder

BLOCK = 4096
PART = 512
ZONES = 1024
AXES = 8
BITS = 7
SLICE_ROWS = 500_000
PLACE = ["_slice", "_size", "_block"]
ENDS = 2**62


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place of each point, coordinates below 2 ** bits, on the Hilbert curve through all axes."""
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    side = 1 << (bits - 1)
    while side > 1:
        below = side - 1
        for n in range(axes):
            high = (x[n] & side) > 0
            swapped = np.where(high, 0, (x[0] ^ x[n]) & below)
            x[0] ^= np.where(high, below, swapped)
            x[n] ^= swapped
        side >>= 1
    for n in range(1, axes):
        x[n] ^= x[n - 1]
    flip = np.zeros_like(x[0])
    side = 1 << (bits - 1)
    while side > 1:
        flip ^= np.where((x[-1] & side) > 0, side - 1, 0)
        side >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for n in range(axes):
            out = out << 1 | (x[n] >> bit & 1)
    return out


def _spread(rows: DataFrame, axes: int) -> DataFrame:
    """(_size, _axes): for each size of vectors the components that vary most, each with its place and ends."""
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, vectors in batch.groupby("_size")["_vector"]:
                if size:
                    v = matrix(vectors)
                    part = {"_dim": range(size), "low": v.min(axis=0), "high": v.max(axis=0), "one": v.sum(axis=0).astype(float), "two": (v * 1.0 * v).sum(axis=0)}
                    yield pd.DataFrame({"_size": size, "n": len(v)} | part)

    parts = rows.select("_size", "_vector").mapInPandas(moments, "_size int, n long, _dim int, low long, high long, one double, two double")
    sums = parts.groupBy("_size", "_dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    varied = sums.withColumn("less", F.pow(F.col("one") / F.col("n"), 2) - F.col("two") / F.col("n"))
    each = F.slice(F.array_sort(F.collect_list(F.struct("less", "_dim", "low", "high"))), 1, axes)
    return varied.groupBy("_size").agg(each.alias("_axes"))


def laid_out(rows: DataFrame, block: int = BLOCK, axes: int = AXES, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The rows in blocks along the curve, written as Parquet, and the zone map.

    Rows get _slice and _block.  Zones are (_slice, _size, _block, _low, _high,
    _label_low, _label_high).
    """
    @F.pandas_udf("long")
    def place(points: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack(points.to_numpy()), bits) if len(points) else [], dtype="int64")

    def scaled(a: Column) -> Column:
        return F.floor((F.get("_vector", a["_dim"]) - a["low"]) * float(2**bits) / (a["high"] - a["low"] + 1)).cast("int")

    spread = rows.join(_spread(rows, axes), "_size", "left")
    points = F.slice(F.concat(F.coalesce(F.transform("_axes", scaled), F.array().cast("array<int>")), F.array_repeat(F.lit(0), axes)), 1, axes)
    curved = spread.select(*rows.columns, place(points).alias("_curve"))
    slices = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE_ROWS))
    order = ("_size", "_curve", "_id", "_row")
    cut = pin(curved.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()))
    number = F.row_number().over(Window.partitionBy("_slice", "_size").orderBy(*order[1:])) - 1
    placed = cut.withColumn("_block", F.floor(number / block).cast("int")).drop("_curve")
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    # row groups of about a block; the window leaves each slice's rows in their order along the curve
    placed.write.option("parquet.block.size", 1 << 20).parquet(folder)
    blocks = spark.read.schema(placed.schema).parquet(folder)

    def zones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, part in batch.groupby(PLACE):
                v = matrix(part["_vector"])
                out.append((*at, v.min(axis=0), v.max(axis=0), part["_label"].min(), part["_label"].max()))
            yield pd.DataFrame(out, columns=[*PLACE, "_low", "_high", "_label_low", "_label_high"])

    kind = rows.schema["_label"].dataType.simpleString()
    parts = blocks.select(*PLACE, "_vector", "_label").mapInPandas(
        zones, f"_slice int, _size int, _block int, _low array<long>, _high array<long>, _label_low {kind}, _label_high {kind}"
    )
    # a block lies in one or two batches, so few lists meet here
    def over(name: str, choose) -> Column:
        lists = F.collect_list(name)
        return F.aggregate(lists, F.get(lists, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: choose(x, y))).alias(name)

    zoned = parts.groupBy(*PLACE).agg(over("_low", F.least), over("_high", F.greatest), F.min("_label_low").alias("_label_low"), F.max("_label_high").alias("_label_high"))
    return blocks, pin(zoned.withColumn("_row", F.monotonically_increasing_id()))


def _needed(zones: DataFrame, anchors: DataFrame, same: bool) -> DataFrame:
    """(_row, _slice, _size, _block): the blocks, but for its own, that may hold a row for a window of the anchor.

    ``anchors`` has _lows and _highs, the ends of the windows.
    """
    stored, wanted, group = dealt(zones.withColumnRenamed("_slice", "_in").withColumnRenamed("_block", "_at"), anchors, ["_size"], ZONES, PART)

    def choose(zones: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(zones) and len(anchors):
            low, high = matrix(zones["_low"]), matrix(zones["_high"])
            vectors = matrix(anchors["_vector"])
            up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
            most, least = products(up, high) + products(down, low), products(up, low) + products(down, high)
            first, last = zones["_label_low"].to_numpy(), zones["_label_high"].to_numpy()
            places = [zones[c].to_numpy() for c in ("_in", "_size", "_at")]
            for n, (row, label, lows, highs, within, at) in enumerate(zip(*(anchors[c] for c in ("_row", "_label", "_lows", "_highs", "_slice", "_block")), strict=True)):
                meets = np.zeros(len(zones), bool)
                for a, b in zip(lows, highs, strict=True):
                    meets |= (most[n] >= a) & (least[n] <= b) & (a <= b)
                meets &= (first <= label) & (label <= last) if same else (first != label) | (last != label)
                meets &= (places[0] != within) | (places[2] != at)
                found.append(pd.DataFrame({"_row": row} | {c: p[meets] for c, p in zip(PLACE, places, strict=True)}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("_row", *PLACE)})

    return stored.groupBy(*group).cogroup(wanted.groupBy(*group)).applyInPandas(choose, "_row long, _slice int, _size int, _block int")


def _found(blocks: DataFrame, anchors: DataFrame, same: bool, count: int) -> DataFrame:
    """(_asking, _window, _score, _id): the best rows of each anchor's window in the block that its row names."""
    read = blocks.join(anchors.select(*PLACE).distinct(), PLACE, "left_semi")
    stored, wanted, group = dealt(read, anchors, PLACE, 2**40, PART)
    kind = blocks.schema["_id"].dataType.simpleString()

    def search(stored: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(stored) and len(anchors):
            ids, labels = stored["_id"].to_numpy(), stored["_label"].to_numpy()
            scores = products(matrix(anchors["_vector"]), matrix(stored["_vector"]))
            for n, (row, own, label, lows, highs) in enumerate(zip(*(anchors[c] for c in ("_row", "_id", "_label", "_lows", "_highs")), strict=True)):
                fits = ((labels == label) == same) & (ids != own)
                for window, (a, b) in enumerate(zip(lows, highs, strict=True)):
                    near = np.flatnonzero(fits & (scores[n] >= a) & (scores[n] <= b))
                    near = near[best(scores[n][near], ids[near], count)]
                    found += [(row, window, scores[n][m], ids[m]) for m in near]
        return pd.DataFrame(found, columns=["_asking", "_window", "_score", "_id"])

    return stored.groupBy(*group).cogroup(wanted.groupBy(*group)).applyInPandas(search, f"_asking long, _window int, _score long, _id {kind}")


def _best(found: DataFrame, count: int) -> DataFrame:
    """Adds _rank: the ``count`` best of each anchor's window."""
    order = Window.partitionBy("_asking", "_window").orderBy(F.desc("_score"), "_id")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= count)


def searched(blocks: DataFrame, zones: DataFrame, anchors: DataFrame, same: bool, count: int) -> DataFrame:
    """(_asking, _window, _score, _id, _rank): for each window of each anchor its ``count`` best rows of the same label, or of others."""
    here = pin(_best(_found(blocks, anchors, same, count), count))
    full = here.where(F.col("_rank") == count).groupBy("_asking").agg(F.map_from_entries(F.collect_list(F.struct("_window", "_score"))).alias("_reached"))
    raised = anchors.join(full, F.col("_row") == F.col("_asking"), "left").withColumn(
        "_lows", F.transform("_lows", lambda low, n: F.greatest(low, F.coalesce(F.try_element_at("_reached", n.cast("int")), low)))
    ).drop("_asking", "_reached")
    raised = pin(raised)
    needed = pin(_needed(zones, raised, same))
    reading = needed.join(raised.drop(*PLACE), "_row")
    return _best(here.drop("_rank").unionByName(_found(blocks, reading, same, count)), count)


def mined(
    table: DataFrame, queries: Column, label: Column, key: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 3,
    least: int = 50, most: int = 95, scale: int = SCALE, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row whose key meets ``queries``.

    A negative's score is at least ``least`` and at most ``most`` hundredths of
    the positive's.
    """
    rows = whole_vectors(table, F.col(key), F.col(vector), label, scale)
    blocks, zones = laid_out(rows, block)
    anchors = pin(asked(blocks, key, queries))
    open_ends = anchors.withColumns({"_lows": F.array(F.lit(-ENDS)), "_highs": F.array(F.lit(ENDS))})
    alike = pin(searched(blocks, zones, open_ends, True, positives).drop("_window"))
    score = F.col("_score")
    low, high = F.expr(f"({least} * _score + 99 - pmod({least} * _score + 99, 100)) div 100"), F.expr(f"({most} * _score - pmod({most} * _score, 100)) div 100")
    windows = alike.groupBy("_asking").agg(F.array_sort(F.collect_list(F.struct("_rank", low.alias("low"), high.alias("high")))).alias("_w"))
    aimed = anchors.join(windows, F.col("_row") == F.col("_asking"))
    aimed = pin(aimed.withColumns({"_lows": F.col("_w.low"), "_highs": F.col("_w.high")}).drop("_asking", "_w"))
    unlike = searched(blocks, zones, aimed, False, negatives)
    paired = alike.select("_asking", (F.col("_rank") - 1).alias("_window"), F.col("_id").alias("positive_id"), score.alias("positive_score"))
    named = unlike.withColumnRenamed("_id", "negative_id").withColumnRenamed("_score", "negative_score").join(paired, ["_asking", "_window"])
    out = named.join(anchors.select(F.col("_row").alias("_asking"), F.col("_id").alias("anchor_id")), "_asking")
    return out.select("anchor_id", "positive_id", F.col("_rank").alias("rank"), "negative_id", "positive_score", "negative_score")
