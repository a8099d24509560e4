"""Best-fit packing of tokenised documents into sequences of one length, by hierarchical residual packing.

Groups of pieces are packed best-fit on their own.  Nearly full bins are done;
the others become items, and groups of these are packed in the next round, until
one group holds them all or a round merges next to nothing.  A group has a
bounded number of items whatever the input, and only narrow rows move.

Documents may come in an order that matters, as the course of training does.
Then groups are slices of neighbouring pieces, underfull bins are packed again
with those of the slices next to theirs, and sequences have the number of their
earliest piece.  Tables have no order but that of their files, so the place of a
row is its file and its row in there.

Null and empty texts are documents of the end token alone.  Repeated rows are
documents of their own.  Columns that are not named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigsift.llm.common import groups_of
from sigsift.llm.tokens import encoder, slices
from sigsift.operators.ordering import with_ordinal
from sigsift.session import pin

CAPACITY = 1024
END = 2
GROUP = 8192
#: Pieces in a slice of an order that is kept.
SLICE = 1024
SLACK = 4
PROGRESS = 0.02

PLACED = "_uid long, _bin long, _off long, _fill long"


def pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False
) -> DataFrame:
    """(key, _uid, piece, start, length, ids_crc32[, ids]): token ids and an end token, cut where a document is longer than a sequence.

    Of a cut document the first piece takes what is over, the others are full.
    ``tokenizer`` is a file of the ``tokenizers`` library; its content, of fixed
    size, goes along with the job.  ``_uid`` is a number of its own for each piece.
    """
    with open(tokenizer, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(content.value)
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at, count in slices(batch.column(1)):
                part = batch.slice(at, count)
                rows: list[tuple] = []
                of: list[int] = []
                kept: list[np.ndarray] = []
                for n, ids in enumerate(code.batch(part.column(1))):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    start, length = 0, (len(ids) - 1) % capacity + 1
                    for piece in range(-(-len(ids) // capacity)):
                        own = ids[start : start + length]
                        of.append(n)
                        rows.append((number + len(rows), piece, start, length, zlib.crc32(own.tobytes())))
                        if keep_ids:
                            kept.append(own)
                        start, length = start + length, capacity
                number += len(rows)
                columns = [part.column(0).take(pa.array(of, pa.int32()))]
                columns += [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = [key, "_uid", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array([k.astype(np.int64) for k in kept], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [docs.schema[key], *T._parse_datatype_string("_uid long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids).fields]
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(cut, T.StructType(fields))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's fill for every item, items taken as they come.

    Open bins are stacked by their room; a bit for each room that has a bin finds
    the least one that fits.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    rooms = 0
    for n, length in enumerate(lengths.tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            number, room = len(fills), capacity
            fills.append(0)
        bins[n], offsets[n] = number, fills[number]
        fills[number] += length
        left = room - length
        if left:
            stacks[left].append(number)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)[bins] if fills else offsets


def _round(items: DataFrame, count: int, capacity: int, group: int, number: int, ordered: bool) -> DataFrame:
    """Items (_uid, _length) packed best-fit, largest first, in groups of about ``group``; a bin has the number of its first item.

    ``ordered``: groups are ``group`` items in the order of their numbers, and a bin has the least number in it.
    """
    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_length", "_uid"], ascending=[False, True], kind="stable")
        uid = rows["_uid"].to_numpy()
        bins, offsets, fills = best_fit(rows["_length"].to_numpy(), capacity)
        heads = uid[offsets == 0]
        if ordered:
            np.minimum.at(heads, bins, uid)
        return pd.DataFrame({"_uid": uid, "_bin": heads[bins], "_off": offsets, "_fill": fills})

    if ordered:
        placed = with_ordinal(items.select("_uid", "_length", F.lit(0).alias("_one")), "_one", [F.col("_uid")], "_n")
        dealt = placed.select("_uid", "_length", F.floor((F.col("_n") - 1) / group).alias("_group"))
    else:
        groups = groups_of(count, group)
        dealt = items.select("_uid", "_length").withColumn("_group", F.pmod(F.xxhash64("_uid", F.lit(number)), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(place, PLACED)


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, slack: int = SLACK, ordered: bool = False) -> DataFrame:
    """(_uid, sequence_id, offset) for items (_uid, length); each item no longer than a sequence, each ``_uid`` once.

    ``items`` is read several times: pin what is expensive.  ``ordered`` keeps
    items of neighbouring numbers together and numbers sequences in their order.
    """
    full = F.col("_fill") >= capacity - slack
    narrow = items.select("_uid", F.col("length").cast("long").alias("_length"))
    alone = F.col("_length") >= capacity - slack
    done = narrow.where(alone).select("_uid", F.col("_uid").alias("_bin"), F.lit(0).cast("long").alias("_off"), F.col("_length").alias("_fill"))
    rest, levels = narrow.where(~alone), []
    count = rest.count()
    while count:
        placed = pin(_round(rest, count, capacity, group, len(levels), ordered))
        levels.append(placed)
        rest = placed.where((F.col("_off") == 0) & ~full).select(F.col("_bin").alias("_uid"), F.col("_fill").alias("_length"))
        before, count = count, rest.count()
        if groups_of(before, group) == 1 or count > (1 - PROGRESS) * before:
            break
    final = None
    for placed in reversed(levels[1:]):  # where the bins of each level ended up, from the last level down
        final = _within(placed, final) if final is not None else placed.select("_uid", "_bin", "_off")
    out = done.select("_uid", "_bin", "_off")
    if levels:
        first = levels[0].select("_uid", "_bin", "_off")
        out = out.unionByName(_within(first, final) if final is not None else first)
    return out.select("_uid", F.col("_bin").alias("sequence_id"), F.col("_off").alias("offset"))


def _within(placed: DataFrame, final: DataFrame) -> DataFrame:
    """Items of one level with the bins and offsets that their bins got later."""
    later = final.select(F.col("_uid").alias("_of"), F.col("_bin").alias("_to"), F.col("_off").alias("_at"))
    joined = placed.join(later, placed["_bin"] == later["_of"], "left")
    return joined.select(
        "_uid", F.coalesce("_to", "_bin").alias("_bin"), (F.col("_off") + F.coalesce("_at", F.lit(0))).alias("_off")
    )


def _placed(docs: DataFrame) -> DataFrame:
    """Adds _place, comparable: the file and row of a document where it is read from files, else its number in the frame."""
    try:
        return docs.withColumn("_place", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    except AnalysisException:
        return docs.withColumn("_place", F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")))


def packed(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False,
    ordered: bool = False, group: int | None = None,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece of every document and its place.

    ``ordered``: sequences follow the order of the documents.
    """
    if not ordered:
        made = pin(pieces(docs, tokenizer, key, text, capacity, keep_ids=keep_ids))
        return made.join(pack(made, capacity, group or GROUP), "_uid").drop("_uid")
    rows = _placed(docs).select(F.struct(F.col(key).alias("key"), F.col("_place")).alias("_doc"), F.col(text).alias("_body"))
    cut = pin(pieces(rows, tokenizer, "_doc", "_body", capacity, keep_ids=keep_ids).withColumn("_one", F.lit(0)))
    order = [F.col("_doc._place"), F.col("piece")]
    numbers = with_ordinal(cut.select("_one", "_doc", "piece", "_uid", "length"), "_one", order, "_n")
    made = pin(numbers.select(F.col("_uid").alias("_of"), F.col("_n").alias("_uid"), "length"))
    places = pack(made, capacity, group or SLICE, ordered=True).join(made.select("_uid", "_of"), "_uid").drop("_uid")
    joined = cut.join(places, cut["_uid"] == places["_of"])
    return joined.select(
        F.col("_doc.key").alias(key), "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset"
    )
