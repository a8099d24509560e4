"""Mixing sources to target weights that change over the course of training.

Each source has a target, a number of words, and a schedule of its weight over
the course.  The integral of the schedule is the source's demand; a document's
place in its source's order, inverted through the demand, is its position in
training.  Documents sorted by position are the mix.

A source's order is that of the MD5 of its documents' ids.  Its words are summed
in slices of that order, so a source with a third of all rows covers many tasks.

Null texts have no words.  Rows without a source form a source of their own, the
last.  Repeated rows each count.  Where no text has a word nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsift.llm.common import DOCUMENT, whole, words
from sigsift.session import pin

SHARE = 1.5
CAP = 2
#: Weights of the sources in code point order, repeated, and how each weight runs over the course: at its start and its end.
WEIGHTS = (3, 1, 2)
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
SLICE_ROWS = 20_000


def _key(source: Column) -> Column:
    """Never null, in code point order, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(_key, _source_size, _rows, _rank, _target) for rows (_key, _size).

    The sources share ``share`` times all words by weight; a target stops at
    ``cap`` times the source's size, and what it leaves over is shared again
    among the others, until none is above.  One row per source is all that is sorted.
    """
    summed = sizes.groupBy("_key").agg(F.sum("_size").alias("_source_size"), F.count(F.lit(1)).alias("_rows"))
    rank = F.row_number().over(Window.orderBy("_key")) - 1
    weight = F.element_at(F.lit(list(WEIGHTS)), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    sources = pin(summed.withColumn("_rank", rank).withColumn("_weight", weight.cast("double")))
    most = F.col("_source_size") * F.lit(cap)
    budget = share * (sources.agg(F.sum("_source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:  # ends: a source that is at its cap stays there
        above = F.col("_weight") * F.lit(level) > most
        held, n, open_weight = sources.agg(F.sum(F.when(above, most)), F.count_if(above), F.sum(F.when(~above, F.col("_weight")))).first()
        if n == stopped or not open_weight:
            break
        stopped, level = n, (budget - (held or 0)) / open_weight
    target = F.when(F.col("_weight") * F.lit(level) > most, most.cast("double")).otherwise(F.col("_weight") * F.lit(level))
    return sources.withColumn("_target", target).drop("_weight")


def _position(demand: Column, rank: Column) -> Column:
    """Where in the course, from 0 to 1, a share of the source's demand has been met.

    The weight runs in a straight line from a to b, so demand is a x + (b - a) x^2 / 2
    over (a + b) / 2; the equation is solved for x.
    """
    out = F.lit(None).cast("double")
    for n, (a, b) in enumerate(SCHEDULES):
        y = demand * ((a + b) / 2)
        x = y / a if a == b else (F.sqrt(y * (2 * (b - a)) + a * a) - a) / (b - a)
        out = F.when(rank % len(SCHEDULES) == n, x).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def _sized(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(
        F.struct(*keep).alias("_row"), _key(F.col("source").cast("string")).alias("_key"),
        F.size(words(whole(F.col("text")))).cast("long").alias("_size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"), F.col("doc_id").alias("_doc"),
    )


def _sliced(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the source's figures and _slice, the part of the source's order that a row is in."""
    place = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / 2**32
    return rows.join(sources, "_key").withColumn("_slice", F.floor(place * F.ceil(F.col("_rows") / SLICE_ROWS)).cast("long"))


def allocate(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The ``keep`` columns, as a struct _row, with _size, _source_size, _target, _taken and _copies, an array of (words, position).

    A copy is one pass over a document.  The passes of a source are laid end to
    end and cut at its target, rounded to a word: at most one document of each
    source is taken in part, by its first words.
    """
    sizes = pin(_sized(docs, ("doc_id",)).drop("_row"))
    sources = targets(sizes, share, cap)
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        _sliced(sizes, sources).groupBy("_key", "_slice").agg(F.sum("_size").alias("_words"))
        .select("_key", "_slice", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    )
    rows = sizes.withColumn("_row", F.struct(F.col("_doc").alias("doc_id"))) if keep == ("doc_id",) else _sized(docs, keep)
    within = Window.partitionBy("_key", "_slice").orderBy("_order", "_doc", "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = _sliced(rows, sources).withColumn("_upto", F.sum("_size").over(within)).join(offsets, ["_key", "_slice"])
    start = F.col("_before") + F.col("_upto") - F.col("_size")
    limit = F.floor(F.col("_target") + 0.5)
    copies, taken = [], F.lit(0).cast("long")
    for n in range(cap):
        begin = F.col("_source_size") * n + start
        count = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), limit - begin))
        copies.append(F.struct(count.alias("words"), _position((begin + count / 2) / F.nullif("_target", F.lit(0.0)), F.col("_rank")).alias("position")))
        taken = taken + count
    return placed.select(
        "_row", "_size", "_source_size", "_target", taken.alias("_taken"), F.filter(F.array(*copies), lambda c: c["words"] > 0).alias("_copies")
    )


def mixed(docs: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The columns of documents, a row for each pass over a document, in the order of training.

    The output is sorted over its partitions and in them.  A document taken in part has its first words only.
    """
    planned = allocate(docs.select(*DOCUMENT), DOCUMENT, share, cap)
    opened = planned.select("_row", "_size", F.explode("_copies").alias("_copy"))
    words_wanted = F.concat(F.lit(r"(?s)^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("_copy.words").cast("string"), F.lit("}+"))
    first = F.call_function("regexp_extract", F.col("_row.text"), words_wanted, F.lit(0))
    text = F.when(F.col("_copy.words") < F.col("_size"), first).otherwise(F.col("_row.text"))
    ordered = opened.select("_row", text.alias("_text"), F.col("_copy.position").alias("_position"))
    return (
        ordered.repartitionByRange("_position").sortWithinPartitions("_position", "_row.doc_id")
        .select("_row.doc_id", F.col("_text").alias("text"), "_row.lang", "_row.source", F.length("_text").cast("long").alias("n_chars"))
    )
