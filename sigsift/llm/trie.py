"""A trie of conversation prefixes, with a node for each distinct beginning of a conversation.

A prefix is named by a digest that adds up: each turn's hash, with its place
hashed in, is added to four sums of 32 bits, so a prefix's digest is a running
total and its parent's is that total without the last turn.  Totals run over
slices of rows, so a conversation with a third of all turns covers many tasks.
Texts are hashed where they are read and never move.

A count-min sketch screens the digests.  An estimate is never below the true
count, so an estimate of one proves that a prefix has a single member: such nodes
are complete where they stand, for all that follows them is in the same
conversation.  Only prefixes that may be shared are shuffled and grouped exactly.
What is broadcast of the sketch is bounded (``countmin``); beyond that bound more
prefixes go to the exact grouping, and results don't change.

What a node sums over its subtree is placed on one member each: a node's value
on its smallest member, a leaf on the smallest conversation that ends there.
Then a node's sum is that of its members' later turns, and no level waits for the
one below.  The hash over the conversations that end at a node is the one thing
that must read them in order: ids are joined up within slices first, so a node
that a third of all conversations end at is a piece a slice, and its pieces are
fed to the hash one after the other.

Turns are in the order of their numbers, those without one first, ties by role
and the hash of the text; rows that agree in all of them are turns of their own.
Null roles and texts count as empty.  Rows without a conversation id take no
part.  An empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsift.llm import countmin
from sigsift.llm.common import whole
from sigsift.llm.countmin import sketch
from sigsift.session import pin

#: A conversation starts with the first turns, below ``OPENING`` of them, of the one whose id is the next lower multiple of ``FAMILY``.
FAMILY = 100
OPENING = 6
SLICE_ROWS = 1_000_000
SUMS = ("_s0", "_s1", "_s2", "_s3")
NODE = ("_n0", "_n1")
PARENT = ("_p0", "_p1")
LOW = (1 << 32) - 1


def _sliced(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in slices by ``order``, and in order within them, pinned with their _slice."""
    slices = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE_ROWS))
    return pin(rows.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()).sortWithinPartitions(*order))


def _running(rows: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds running totals within a conversation, over its slices, and the totals of the conversation as ``<name>_all``."""
    rows = rows.withColumns({f"{n}_": v for n, v in values.items()})
    per = rows.groupBy("conv_id", "_slice").agg(*[F.sum(f"{n}_").alias(f"{n}_in") for n in values])
    whole_of = Window.partitionBy("conv_id")
    earlier = whole_of.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"{n}_in").over(earlier), F.lit(0)).alias(f"{n}_before") for n in values]
    offsets = per.select("conv_id", "_slice", *before, *[F.sum(f"{n}_in").over(whole_of).alias(f"{n}_all") for n in values])
    within = Window.partitionBy("conv_id", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"{n}_": F.sum(f"{n}_").over(within) for n in values}).join(offsets, ["conv_id", "_slice"])
    return local.withColumns({n: F.col(f"{n}_") + F.col(f"{n}_before") for n in values}).drop(*[f"{n}{x}" for n in values for x in ("_", "_before")])


def numbered(table: DataFrame) -> DataFrame:
    """(conv_id, _slice, _pos, _t0, _t1, _chars): each turn's place in its conversation, from 1, two hashes and the length of its text."""
    role, text = whole(F.col("role")), whole(F.col("text"))
    turns = table.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"),
        F.xxhash64(role, text).alias("_t0"), F.xxhash64(F.lit(1), text, role).alias("_t1"), F.length(text).cast("long").alias("_chars"),
    )
    order = ["_turn", "_role", "_t0"]
    counted = _running(_sliced(turns, "conv_id", *order), order, {"_pos": F.lit(1)})
    return pin(counted.select("conv_id", "_slice", "_pos", "_t0", "_t1", "_chars"))


def _opening(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % OPENING


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, _length) and their turns (conv_id, _slice, _depth, _t0, _t1, _chars) after each got its opening."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own")).withColumn("_h", _opening(F.col("conv_id")))
    convs = pin(own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % FAMILY))
    bases = convs.where("conv_id = _base").select(F.col("conv_id").alias("_base"), F.col("_own").alias("_there"))
    opened = convs.join(bases, "_base", "left").withColumn("_first", F.least("_h", F.coalesce("_there", F.lit(0))))
    opened = pin(opened.withColumn("_length", F.col("_first") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).drop("_own", "_there"))
    # at most FAMILY conversations take at most OPENING - 1 turns of a base
    first = turns.where(F.col("_pos") < OPENING).where(F.col("conv_id") % FAMILY == 0).withColumnRenamed("conv_id", "_base").drop("_slice")
    taken = opened.join(first, "_base").where(F.col("_pos") <= F.col("_first"))
    kept = turns.join(opened.select("conv_id", "_h", "_first"), "conv_id").where(F.col("_pos") > F.col("_h"))
    columns = ("_t0", "_t1", "_chars")
    rows = taken.select("conv_id", F.lit(-1).alias("_slice"), F.col("_pos").alias("_depth"), *columns).unionByName(
        kept.select("conv_id", "_slice", (F.col("_pos") - F.col("_h") + F.col("_first")).alias("_depth"), *columns)
    )
    return opened.select("conv_id", "_length"), rows


def _named(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(depth, *sums), F.xxhash64(F.lit(2), *reversed(sums), depth)]


def prefixes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, _slice, _depth, _length, _chars, _n0, _n1, _p0, _p1): every prefix of every conversation, its node and the node above.

    The empty prefix, at depth 0, has no node above it.
    """
    place = F.col("_depth").cast("long")
    own = {s: F.xxhash64(F.lit(n), place, "_t0", "_t1").bitwiseAND(F.lit(LOW)) for n, s in enumerate(SUMS)}
    summed = _running(rows, ["_depth"], own).withColumns({f"{s}_own": v for s, v in own.items()})
    above = [F.col(s) - F.col(f"{s}_own") for s in SUMS]
    named = [*_named(place, [F.col(s) for s in SUMS]), *_named(place - 1, above)]
    turns = summed.select("conv_id", "_slice", place.alias("_depth"), "_chars", *[c.alias(n) for c, n in zip(named, (*NODE, *PARENT), strict=True)])
    zero = [F.lit(0).cast("long")] * len(SUMS)
    empty = convs.select(
        "conv_id", F.lit(-1).alias("_slice"), F.lit(0).cast("long").alias("_depth"), F.lit(0).cast("long").alias("_chars"),
        *[c.alias(n) for c, n in zip(_named(F.lit(0).cast("long"), zero), NODE, strict=True)],
        *[F.lit(None).cast("long").alias(n) for n in PARENT],
    )
    return pin(turns.unionByName(empty).join(convs, "conv_id"))


def screened(rows: DataFrame, counters: int) -> DataFrame:
    """Adds _single, the estimate of the prefix is one, so it has one member; and _single_above, the same of the prefix above, itself at the root."""
    single = countmin.single(rows.sparkSession.sparkContext.broadcast(sketch(rows.select(*NODE), counters)))
    above = [F.coalesce(p, n) for p, n in zip(PARENT, NODE, strict=True)]
    return rows.withColumns({"_single": single(*NODE), "_single_above": single(*above)})


def _hashed_in_order(ends: DataFrame) -> DataFrame:
    """(*NODE, ends_sha256): the hash of the ids of each node's conversations, ascending, with commas between."""
    cut = _sliced(ends, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n0, n1, ids = (batch[c].to_numpy() for c in (*NODE, "conv_id"))
            starts = np.flatnonzero((n0[1:] != n0[:-1]) | (n1[1:] != n1[:-1])) + 1
            first = np.concatenate([[0], starts]).astype(int)[: len(ids)]
            joined = [",".join(map(str, x.tolist())) for x in np.split(ids, starts)][: len(ids)]
            yield pd.DataFrame({"_n0": n0[first], "_n1": n1[first], "_from": ids[first], "_ids": joined})

    def feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            done = []
            for n0, n1, ids in zip(batch[NODE[0]], batch[NODE[1]], batch["_ids"], strict=True):
                if at != (n0, n1):
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (n0, n1), hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    pieces = cut.select(*NODE, "conv_id").mapInPandas(join, "_n0 long, _n1 long, _from long, _ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "_from").mapInPandas(feed, "_n0 long, _n1 long, ends_sha256 string")


def built(table: DataFrame, screen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``screen`` may take the place of the sketch; it adds _single, which must not be
    true of a prefix with two members, and _single_above.
    """
    rows = prefixes(*rebuilt(numbered(table)))
    if screen is None:
        rows = screened(rows, countmin.counters_for(rows.count()))
    else:
        rows = screen(rows)
    rows = pin(rows)
    alone, shared = rows.where("_single"), rows.where("NOT _single")
    nothing = hashlib.sha256(b"").hexdigest()

    # nodes that may be shared, exactly; children that are proven to be single add to what hangs below
    nodes = shared.groupBy(*NODE, "_depth", *PARENT, "_chars").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = pin(nodes)
    first_alone = alone.where("NOT _single_above")
    below = nodes.select(*PARENT).unionByName(first_alone.select(*PARENT)).where("_p0 IS NOT NULL")
    children = below.groupBy(F.col("_p0").alias("_n0"), F.col("_p1").alias("_n1")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = pin(nodes.join(children, list(NODE), "left").fillna(0, ["n_children"]))

    # each conversation's end at a node that may be shared counts as a leaf on the smallest member of a childless node only
    heads = nodes.select(*NODE, F.col("conv_id").alias("_head"), "n_convs", "n_children")
    ended = shared.where("_depth = _length").select("conv_id", *NODE)
    no_leaf = ended.join(heads, list(NODE)).where("n_children > 0 OR conv_id <> _head").select("conv_id", F.lit(0).alias("_leaf"))
    valued = shared.join(heads.drop("n_children"), list(NODE)).withColumn(
        "_value", F.when(F.col("conv_id") == F.col("_head"), (F.col("n_convs") - 1) * F.col("_chars")).otherwise(0)
    )
    later = _running(valued.drop("_head", "n_convs"), ["_depth"], {"_sum": F.col("_value")})
    onward = later.join(no_leaf, "conv_id", "left").select(
        *NODE, (F.col("_sum_all") - F.col("_sum") + F.col("_value")).alias("_saved"), F.coalesce("_leaf", F.lit(1)).alias("_leaf")
    )
    sums = onward.groupBy(*NODE).agg(F.sum("_leaf").cast("long").alias("n_leaves"), F.sum("_saved").cast("long").alias("saved_tokens"))
    ends = _hashed_in_order(ended)

    above = nodes.select(F.col("_n0").alias("_p0"), F.col("_n1").alias("_p1"), F.col("conv_id").alias("_above"))
    full = nodes.join(sums, list(NODE)).join(ends, list(NODE), "left").join(above, list(PARENT), "left")
    # where the node above is not among them it is proven to be single, and of the same conversation
    parent = F.when(F.col("_depth") > 0, F.coalesce("_above", "conv_id")).alias("parent_conv_id")
    out = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    grouped = full.select("conv_id", F.col("_depth").alias("depth"), parent, *[F.col(c).cast("long").alias(c) for c in out], F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    last = F.col("_depth") == F.col("_length")
    tails = first_alone.join(above, list(PARENT), "left").unionByName(alone.where("_single_above").withColumn("_above", F.lit(None).cast("long")))
    ended_alone = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(nothing))
    counts = (F.lit(1), F.when(last, 0).otherwise(1), F.lit(1), F.lit(0))
    emitted = tails.select(
        "conv_id", F.col("_depth").alias("depth"), parent, *[x.cast("long").alias(c) for x, c in zip(counts, out, strict=True)], ended_alone.alias("ends_sha256")
    )
    return grouped.unionByName(emitted)
