"""A count-min sketch of digests that tells which of them occur once.

An estimate is never below the true count, so an estimate of one proves that a
digest has a single row.  The sketch has two rows of counters; of each counter
one bit is kept, whether it is more than one.  Counters grow with the number of
digests up to ``COUNTERS``, which bounds what the driver holds and broadcasts: two
bits a counter, 128 MiB.  Beyond that bound estimates are larger than need be,
and fewer digests are known to be single.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsift.session import shuffles_released

#: The most counters of a row, counters for each digest, and how many make a chunk.
COUNTERS = 2**29
ROOMY = 4
CHUNK = 2**16
#: Digests that a task counts at a time, and rows of a chunk that are added up at a time.
HELD = 2**21
FEW = 64


def counters_for(digests: int) -> int:
    return 1 << min(max(6, (ROOMY * digests).bit_length()), COUNTERS.bit_length() - 1)


def _places(n0: np.ndarray, n1: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each digest in both rows."""
    last = np.uint64(counters - 1)
    return n0.view(np.uint64) & last, n1.view(np.uint64) & last


def sketch(digests: DataFrame, counters: int) -> list[np.ndarray]:
    """Both rows of bits, for digests of two long columns whose lower bits are even; ``counters`` is a power of two.

    Tasks send the places that they have counted, twice where more than once, two
    bytes a place, in chunks; a chunk is added up row by row.
    """
    chunk = min(CHUNK, counters)

    def send(n0: np.ndarray, n1: np.ndarray) -> Iterator[pd.DataFrame]:
        for line, places in enumerate(_places(n0, n1, counters)):
            place, times = np.unique(places, return_counts=True)
            place = np.repeat(place, np.minimum(times, 2))
            number = place // np.uint64(chunk)
            starts = np.flatnonzero(number[1:] != number[:-1]) + 1
            low = [x.astype("<u2").tobytes() for x in np.split(place % np.uint64(chunk), starts)]
            yield pd.DataFrame({"_line": line, "_chunk": number[np.concatenate([[0], starts])].astype(np.int64), "_places": low})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            if len(batch):
                held.append([batch[c].to_numpy() for c in batch.columns])
                rows += len(batch)
            if rows >= HELD:
                yield from send(*map(np.concatenate, zip(*held, strict=True)))
                held, rows = [], 0
        if held:
            yield from send(*map(np.concatenate, zip(*held, strict=True)))

    def bits(seen: np.ndarray) -> bytes:
        return zlib.compress(np.packbits(seen > 1, bitorder="little").tobytes(), 1)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a chunk's rows come one after the other; they are counted as soon as they are a few
        at, seen, held = None, np.zeros(chunk, np.int64), []
        for batch in batches:
            done = []
            for line, number, places in zip(batch["_line"], batch["_chunk"], batch["_places"], strict=True):
                if at != (line, number) or len(held) >= FEW:
                    seen += np.bincount(np.concatenate(held), minlength=chunk) if held else 0
                    held = []
                if at != (line, number):
                    if at is not None:
                        done.append((*at, bits(seen)))
                    at, seen = (line, number), np.zeros(chunk, np.int64)
                held.append(np.frombuffer(places, "<u2"))
            yield pd.DataFrame(done, columns=["_line", "_chunk", "_bits"])
        if at is not None:
            yield pd.DataFrame([(*at, bits(seen + np.bincount(np.concatenate(held), minlength=chunk)))], columns=["_line", "_chunk", "_bits"])

    sent = digests.mapInPandas(count, "_line int, _chunk int, _places binary")
    ordered = sent.repartition("_line", "_chunk").sortWithinPartitions("_line", "_chunk")
    out = [np.zeros(max(1, counters // 8), np.uint8) for _ in range(2)]
    with shuffles_released(digests.sparkSession):
        chunks = ordered.mapInPandas(add_up, "_line int, _chunk int, _bits binary").collect()
    for r in chunks:
        found = np.frombuffer(zlib.decompress(r._bits), np.uint8)
        out[r._line][r._chunk * (chunk // 8) : r._chunk * (chunk // 8) + len(found)] = found
    return out


def single(kept: Broadcast) -> Callable:
    """A function of the two digest columns: the sketch, which is broadcast, says that there is one row."""
    counters = len(kept.value[0]) * 8

    @F.pandas_udf("boolean")
    def once(n0: pd.Series, n1: pd.Series) -> pd.Series:
        more = np.ones(len(n0), bool)
        for row, places in zip(kept.value, _places(n0.to_numpy(), n1.to_numpy(), counters), strict=True):
            more &= (row[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1) == 1
        return pd.Series(~more)

    return once
