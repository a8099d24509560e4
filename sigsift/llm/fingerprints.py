"""Fingerprints of whole texts: every word shingle whose hash lies below a fixed fraction of all hashes.

Sketches of any two texts compare, however unequal their lengths, and the
sketch of a union is the union of sketches.  All of it is built-in functions.

A text of fewer words than a shingle has one shingle, all of its words; a text
without words, or null, has an empty sketch.  A digest of the words goes along,
so that texts too short to have kept a shingle still compare as equal or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsift.llm.common import lower_ascii, whole, words

WORDS = 5
FRACTION = 0.25
LOWEST = -(2**63)


def threshold(fraction: float) -> int:
    """The hash below which the given fraction of all 64-bit hashes lies."""
    return min(2**63 - 1, LOWEST + int(fraction * 2**64))


def _sketched(frame: DataFrame, text: str, name: str, size: int, fraction: float) -> DataFrame:
    """Adds ``name``: struct(digest, hashes), hashes in ascending order."""
    w, limit = f"_words_{name}", threshold(fraction)
    frame = frame.withColumn(w, words(lower_ascii(whole(F.col(text)))))
    starts = F.sequence(F.lit(0), F.size(w) - size)
    each = F.transform(starts, lambda n: F.xxhash64(*[F.get(F.col(w), n + k) for k in range(size)]))
    shingles = F.when(F.size(w) >= size, each).when(F.size(w) > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<bigint>"))
    kept = F.sort_array(F.array_distinct(F.filter(shingles, lambda h: h < limit)))
    return frame.withColumn(name, F.struct(F.xxhash64(F.col(w)).alias("digest"), kept.alias("hashes"))).drop(w)


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """(key, sketch): the sketch of every row."""
    frame = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return _sketched(frame, "_text", "_sketch", size, fraction).select(F.col("_key").alias(key), F.col("_sketch").alias("sketch"))


def written(sketch: Column) -> Column:
    """A sketch as text: its digest and its hashes in hexadecimal."""
    return F.concat_ws(":", F.lower(F.hex(sketch["digest"])), F.array_join(F.transform(sketch["hashes"], lambda h: F.lower(F.hex(h))), "."))


def _shares(a: Column, b: Column, whole_size) -> Column:
    both = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    of = whole_size(F.size(a["hashes"]), F.size(b["hashes"]), both)
    return F.when(a["digest"] == b["digest"], 1.0).when(of > 0, both / of).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles in all shingles of two texts."""
    return _shares(a, b, lambda x, y, both: x + y - both)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of common shingles in the shingles of the shorter text."""
    return _shares(a, b, lambda x, y, both: F.least(x, y))


def _cuts(keys: DataFrame, slices: int) -> list[int]:
    """At most ``slices`` keys that cut the table in like parts, the smallest key first.

    A quantile sketch reads the keys alone; its size and that of the result depend
    on the number of slices, not on the number of rows.
    """
    asked = [n / slices for n in range(1, slices)] or [0.5]
    least, others = keys.agg(F.min("_key"), F.percentile_approx("_key", asked, max(10_000, 10 * slices))).first()
    return sorted({x for x in [least, *(others or [])] if x is not None})


def _place(key: Column, cuts: list[int]) -> tuple[Column, Column]:
    """The slice of a key, from 1, and whether the key is the slice's first; two short searches, however many cuts."""
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[n : n + step] for n in range(0, len(cuts), step)]
    block = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda c: c <= key))
    within = F.get(F.array(*[F.lit(b) for b in blocks]), block - 1)
    inside = F.size(F.filter(within, lambda c: c <= key))
    return (block - 1) * step + inside, F.get(within, inside - 1) == key


def with_edits(docs: DataFrame, size: int = WORDS, fraction: float = FRACTION, slices: int | None = None) -> DataFrame:
    """Every text, the same text edited, and how alike it is to that and to the following text.

    The edited text has its last quarter of code points replaced by the first as
    many of the next document in order of ``doc_id``; after the last comes the
    first.  Rows with one id follow each other in order of their texts, rows
    without an id come first.  A table of one row follows itself; one of none has no result.

    Texts move once: to slices of neighbouring ids.  A cut is the id of a document,
    so the document that follows a slice is known while reading and is sent to
    both slices; no window reaches over more than one slice, and a slice spills.
    """
    spark = docs.sparkSession
    slices = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(
        F.col("doc_id").alias("_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("_key"), whole(F.col("text")).alias("_text")
    )
    cuts = _cuts(source.select("_key"), slices) or [LOWEST]
    number, opens = _place(F.col("_key"), cuts)
    here = F.struct(F.col("_slice").alias("slice"), F.lit(0).alias("after"))
    back = F.struct(F.when(F.col("_slice") == 1, len(cuts)).otherwise(F.col("_slice") - 1).alias("slice"), F.lit(1).alias("after"))
    placed = (
        source.withColumn("_slice", number).withColumn("_opens", opens)
        .withColumn("_to", F.explode(F.when(F.col("_opens"), F.array(here, back)).otherwise(F.array(here))))
        .select("_id", "_key", "_text", F.col("_to.slice").alias("_slice"), F.col("_to.after").alias("_after"))
        .repartition("_slice")
    )
    following = Window.partitionBy("_slice").orderBy("_after", "_key", "_text")
    paired = (
        _sketched(placed, "_text", "_sketch", size, fraction)
        .withColumn("_next", F.lead("_text").over(following)).withColumn("_next_sketch", F.lead("_sketch").over(following))
        .where("_after = 0")
        .withColumn("_n", F.length("_text")).withColumn("_q", F.floor(F.col("_n") / 4).cast("int"))
        .withColumn("_edited", F.concat(F.left("_text", F.col("_n") - F.col("_q")), F.left("_next", F.col("_q"))))
    )
    both = _sketched(paired, "_edited", "_edited_sketch", size, fraction)
    return both.select(
        F.col("_id").alias("doc_id"), F.col("_n").cast("bigint").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        F.col("_sketch").alias("sketch"), F.col("_edited_sketch").alias("edited_sketch"),
        likeness(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_next_sketch")).alias("near_next"),
        containment(F.col("_sketch"), F.col("_edited_sketch")).alias("held_edited"),
    )
