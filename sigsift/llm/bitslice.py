"""The exact nearest rows by inner product, from a bit-sliced index.

A block of rows is held by slices: for each attribute (a component of the
vector, counted from its least value in the block) and each bit of it one bitmap
over the rows.  The score of all rows of a block is a sum of shifted slices, one
for every bit that is set in a component of the query, added as bitmaps column
by column.  A negative component takes the slices inverted.

Attributes are quantised first: only the ``SLICES`` upper slices of each are
added.  The sum is then too small by a known amount at most.  The top rows are
selected in the sum's slices, from the most significant one downward; rows whose
sum lies within that amount of the last of them are the boundary, and they and
the top rows are scored exactly.  So no row that belongs to the result is missed,
whatever the data; the bits left out only make the boundary wider.

Blocks and parts of queries are dealt out over tasks; each returns the best rows
of its block for its queries, and the best of all blocks are taken per query.

Rows without an id, and vectors that are null, hold null or non-finite
components, or components of ``vectors.LIMIT`` or more once scaled, take no part.
Vectors are compared with those of their size; an empty vector scores 0.  Rows
that repeat an id are candidates of their own, each asks for itself, and none is
a candidate of its own id.  An empty table has no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsift.llm.vectors import SCALE, asked, best, dealt, matrix, products, whole_vectors
from sigsift.session import pin

BLOCK = 16_384
PART = 512
SLICES = 6
WORD = 64
ALL = np.uint64(2**64 - 1)


def _bitmap(rows: np.ndarray, words: int) -> np.ndarray:
    """Truth values as a bitmap, row 0 in the lowest bit of the first word."""
    packed = np.packbits(rows, axis=-1, bitorder="little")
    out = np.zeros((*packed.shape[:-1], words * 8), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view("<u8").astype(np.uint64)


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    """The rows whose bits are set."""
    return np.flatnonzero(np.unpackbits(bitmap.astype("<u8").view(np.uint8), bitorder="little"))


class SlicedBlock:
    """The slices of a block of vectors: ``table`` has a bitmap each, ``first`` each attribute's first, ``bits`` its number of slices."""

    def __init__(self, vectors: np.ndarray):
        self.count, self.width = vectors.shape
        self.words = -(-self.count // WORD)
        above = vectors - vectors.min(axis=0)
        self.bits = np.array([int(x).bit_length() for x in above.max(axis=0)], np.int64)
        self.first = np.cumsum(self.bits) - self.bits
        self.table = np.zeros((int(self.bits.sum()), self.words), np.uint64)
        for d, bits in enumerate(self.bits):
            for b in range(bits):
                self.table[self.first[d] + b] = _bitmap((above[:, d] >> b) & 1 == 1, self.words)

    def sums(self, query: np.ndarray, slices: int) -> tuple[np.ndarray, int]:
        """Slices of the quantised sum, lowest first, and by how much it is too small at most.

        The sum is the score but for a number that is the same for all rows: the
        attributes count from their least values, or from their largest ones
        where the query's component is negative.
        """
        weight = np.abs(query)
        dropped = np.maximum(0, self.bits - slices)
        slack = int((weight * ((1 << dropped) - 1)).sum())
        of, shift = np.nonzero(weight[:, None] >> np.arange(int(weight.max(initial=0)).bit_length()) & 1)
        number = (self.bits - dropped)[of]
        bit = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number - dropped[of], number)
        picked = np.repeat(self.first[of], number) + bit
        inverted = np.where(np.repeat(query[of] < 0, number), ALL, np.uint64(0))
        column = bit + np.repeat(shift, number)
        order = np.argsort(column, kind="stable")
        at = np.searchsorted(column[order], np.arange(int(column.max(initial=-1)) + 2))
        out = []
        carried = np.zeros((0, self.words), np.uint64)
        while len(out) < len(at) - 1 or len(carried):
            now = order[at[len(out)] : at[len(out) + 1]] if len(out) < len(at) - 1 else order[:0]
            bits, carried = _added(np.concatenate([carried, self.table[picked[now]] ^ inverted[now, None]]))
            out.append(bits)
        return np.array(out).reshape(len(out), self.words), slack


def _added(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of one column added up: the column's slice of the sum, and what is carried to the next column."""
    carried = []
    while len(bits) > 2:
        third = len(bits) // 3
        a, b, c = bits[:third], bits[third : 2 * third], bits[2 * third : 3 * third]
        odd = a ^ b
        carried.append((a & b) | (odd & c))
        bits = np.concatenate([odd ^ c, bits[3 * third :]])
    if len(bits) == 2:
        carried.append((bits[0] & bits[1])[None])
        bits = bits[:1] ^ bits[1:]
    one = bits[0] if len(bits) else np.zeros(bits.shape[1], np.uint64)
    return one, np.concatenate(carried) if carried else np.zeros((0, len(one)), np.uint64)


def _ones(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(sums: np.ndarray, slack: int, valid: np.ndarray, count: int) -> np.ndarray:
    """A bitmap of the rows of ``valid`` that may be among the ``count`` with the largest scores.

    From the most significant slice downward: rows with the slice's bit set come
    before the others that are still even with them.  What the last of the top
    rows has in each slice is its sum; every row within ``slack`` of it stays.
    """
    if _ones(valid) <= count:
        return valid
    above, even, least = np.zeros_like(valid), valid, 0
    for at in range(len(sums) - 1, -1, -1):
        ahead = even & sums[at]
        if _ones(above) + _ones(ahead) >= count:
            even = ahead
            least |= 1 << at
        else:
            above, even = above | ahead, even & ~sums[at]
    least = max(0, least - slack)
    larger, even = np.zeros_like(valid), valid
    for at in range(len(sums) - 1, -1, -1):
        if least >> at & 1:
            even = even & sums[at]
        else:
            larger, even = larger | (even & sums[at]), even & ~sums[at]
    return larger | even


def nearest(
    table: DataFrame, queries: Column, count: int = 5, key: str = "vec_id", vector: str = "embedding",
    scale: int = SCALE, block: int = BLOCK, part: int = PART, slices: int = SLICES,
) -> DataFrame:
    """(query_id, rank, vec_id, score, boundary): the rows with the largest scores for every row whose key meets ``queries``.

    ``boundary`` is how many rows of all blocks were scored exactly for the query.
    """
    rows = whole_vectors(table, F.col(key), F.col(vector), scale=scale)
    stored, wanted, group = dealt(rows, asked(rows, key, queries), ["_size"], block, part)
    kind = rows.schema["_id"].dataType.simpleString()

    def search(stored: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(stored) and len(wanted):
            ids, vectors = stored["_id"].to_numpy(), matrix(stored["_vector"])
            index = SlicedBlock(vectors)
            everyone = _bitmap(np.ones(len(ids), bool), index.words)
            own = {}
            for n, i in enumerate(ids):
                own.setdefault(i, []).append(n)
            for row, asking, query in zip(wanted["_row"], wanted["_id"], matrix(wanted["_vector"]), strict=True):
                valid = everyone.copy()
                for n in own.get(asking, ()):
                    valid[n // WORD] &= ~(np.uint64(1) << np.uint64(n % WORD))
                sums, slack = index.sums(query, slices)
                near = _rows_of(top_rows(sums, slack, valid, count))
                scores = products(query[None], vectors[near])[0] if len(near) else np.zeros(0, np.int64)
                top = best(scores, ids[near], count)
                found.append((row, asking, ids[near][top], scores[top], len(near)))
        return pd.DataFrame(found, columns=["_asking", "query_id", "_ids", "_scores", "_near"])

    sparse = stored.groupBy(*group).cogroup(wanted.groupBy(*group))
    # kept, for the best rows and the counts both read them
    parts = pin(sparse.applyInPandas(search, f"_asking long, query_id {kind}, _ids array<{kind}>, _scores array<long>, _near long"))
    opened = parts.select("_asking", "query_id", "_near", F.inline_outer(F.arrays_zip("_ids", "_scores")))
    order = Window.partitionBy("_asking").orderBy(F.desc_nulls_last("_scores"), "_ids")
    top = opened.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).where(F.col("_ids").isNotNull())
    scored = parts.groupBy("_asking").agg(F.sum("_near").alias("boundary"))
    return top.join(scored, "_asking").select("query_id", "rank", F.col("_ids").alias("vec_id"), F.col("_scores").alias("score"), "boundary")
