"""Near-duplicate documents by the Jaccard similarity of their word shingles: a parity-sketch join.

Every shingle flips one bit of a sketch.  Two sketches differ in at most as many
bits as their sets differ in shingles, and a similarity of t allows sets of a and
b shingles to differ in (1 - t) / (1 + t) * (a + b).  With more words of 64 bits
in the sketch than that, linked sets share some of the words.  Sketches are laid
out for bands of sizes; a set is sketched for its own band and, where a larger
partner may lie there, for the next.  Of each sketch the words that fewest sets
have are kept, enough of them that a shared one is among those of both sets.  So a
set that was much changed keeps the words that are its own, and the words that
unrelated or distant sets have in common are mostly left out.

Sets that share a sketch word are candidates.  A second sketch of fixed size tells
most of those apart that are no link: two sets whose sketches differ in more bits
than a link allows are no pair.  Folded to a quarter it goes with the words and is
compared in the join itself; whole it is kept once for each set.  The others are
verified on the whole sets.  At first every set is compared to one other only, the
one that most of its words agree on.  Then all sets of a word are compared to a
few of them, and what has come together in one component is compared no more; the
number compared to grows until every pair of a word is either settled or joined
by others.  So a group of thousands of copies costs its size and not its square,
copies that are not quite alike enough make no pairs, and no link between
components is lost.

Disk is kept to a small multiple of the sets, however many words they share: words
are gone through in shares, one after the other, each with the components that the
shares before it have left, and pairs are verified in turns that read about as many
hashes as all sets have.

Sets are held by 64-bit hashes of their shingles.  Documents with one set are
one node.  A set so small that only an equal one could be linked with it has no
words to join by.  Null texts, and texts without words, have empty sets and no
links.  Repeated rows have one set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsift.llm import countmin
from sigsift.llm.common import DOCUMENT, groups_of, lower_ascii, whole, words
from sigsift.session import Scratch, pin

SIZE = 5
SIMILARITY = 0.8
BAND_RATIO = 1.4
FEW = 32
BITS = 64
SHINGLES = 500_000
CHECK_WORDS = 16
CHECKS = tuple(f"_s{n}" for n in range(CHECK_WORDS))
AT_ONCE = tuple(f"_f{n}" for n in range(4))
#: Rows (key, node) that are gone through at once: so many, or one for so many hashes of all sets if that is more.
SHARE_ROWS = 2**21
SHARE_HASHES = 24

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(flat: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the word shingles of many documents, sorted by document and hash, and where each document's begin.

    ``flat`` has the hashes of all words, ``ends`` where each document's words
    begin, and the end.  A document of fewer words has one shingle of all of them.
    """
    counts = np.diff(ends)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    of = np.repeat(np.arange(len(counts)), number)
    at = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number) + np.repeat(ends[:-1], number)
    length = np.minimum(counts, size)[of]
    value = length.astype(np.uint64)
    for n in range(size):
        inside = n < length
        word = np.where(inside, flat[np.minimum(at + n, max(0, len(flat) - 1))] if len(flat) else np.uint64(0), np.uint64(0))
        value = np.where(inside, _mixed(value * _MIX + word), value)
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    of, value = of[fresh], value[fresh]
    return value, np.searchsorted(of, np.arange(len(counts) + 1))


def _edge(band: int) -> int:
    """The least size in a band."""
    return int(np.ceil(BAND_RATIO**band))


def _differ(a: int, b: int, tenths: int) -> int:
    """The most shingles that linked sets of these sizes differ in."""
    return (1000 - tenths) * (a + b) // (1000 + tenths)


def _only_equal(size: int, tenths: int) -> bool:
    """Whether a set of this size has no link but to equal sets: none a shingle larger or smaller, and none with one exchanged."""
    return size * 1000 // tenths == size and -(-size * tenths // 1000) == size and _differ(size, size, tenths) < 2


def _keys(value: np.ndarray, tenths: int) -> list[tuple[np.ndarray, int]]:
    """The sketch words of a set in all bands that matter, each with its band and place hashed in, and how many of them to keep.

    Linked sets differ in fewer words than are kept.  In any order of all words
    the first one that they share is therefore among the first that each keeps.
    """
    size = len(value)
    if _only_equal(size, tenths):
        return []
    band = int(np.floor(np.log(size) / np.log(BAND_RATIO) + 1e-9))
    while _edge(band + 1) <= size:
        band += 1
    out = []
    for layout in (band, band + 1):
        low, high = _edge(layout), _edge(layout + 1) - 1
        largest = min(size * 1000 // tenths, high)  # of a partner in this layout
        if layout > band and largest < low:
            break
        parts = _differ(high, high, tenths) + 1
        mixed = _mixed(value ^ np.uint64(layout))
        sketch = np.zeros(parts, np.uint64)
        place = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        np.bitwise_xor.at(sketch, place, np.uint64(1) << (mixed & np.uint64(BITS - 1)))
        named = _mixed(sketch + _MIX * (np.arange(parts, dtype=np.uint64) + np.uint64(1) + (np.uint64(layout) << np.uint64(32))))
        out.append((named, min(parts, _differ(size, largest, tenths) + 1)))
    return out


def _check(value: np.ndarray) -> np.ndarray:
    """The sketch of fixed size that pairs are checked by."""
    mixed = _mixed(value + _MIX)
    out = np.zeros(CHECK_WORDS, np.uint64)
    np.bitwise_xor.at(out, ((mixed >> np.uint64(32)) % np.uint64(CHECK_WORDS)).astype(np.int64), np.uint64(1) << (mixed & np.uint64(BITS - 1)))
    return out


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, _text_hash, _words): every row's id and the hashes of its text and words."""
    hashed = F.transform(words(lower_ascii(whole(F.col(text)))), lambda w: F.xxhash64(w))
    return docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_text_hash"), hashed.alias("_words"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``SHINGLES`` words with the word hashes and where each row's begin."""
    lists = batch.column(batch.schema.get_field_index("_words"))
    ends = np.asarray(lists.offsets).astype(np.int64)
    flat = np.asarray(lists.values).view(np.uint64)
    start = 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SHINGLES, "right")) - 1)
        yield batch.slice(start, stop - start), flat[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        start = stop


def _digest(hashes: np.ndarray) -> int:
    """The number of a node: a set's 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _described(docs: DataFrame, key: str, text: str, size: int, tenths: int) -> DataFrame:
    """(_id, _text_hash, _n, _node, _keys, _kept, _checks): number of shingles, digest of the set (null for the empty one), sketch words to join by.

    ``_keys`` has a list of words for each band, ``_kept`` how many of each to
    keep, ``_checks`` the words to check by.
    """
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, flat, ends in _runs(batch):
                value, at = _shingles(flat, ends, size)
                sets = [value[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                keys = [_keys(s, tenths) if len(s) else [] for s in sets]
                words_of = [[w.view(np.int64) for w, _ in k] for k in keys]
                kept = [[n for _, n in k] for k in keys]
                nodes = [_digest(s) if len(s) else None for s in sets]
                checks = [_check(s).view(np.int64) for s in sets]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(np.diff(at), pa.int64()), pa.array(nodes, pa.int64()), pa.array(words_of, pa.list_(longs)),
                        pa.array(kept, pa.list_(pa.int32())), pa.array(checks, longs),
                    ],
                    ["_id", "_text_hash", "_n", "_node", "_keys", "_kept", "_checks"],
                )

    hashed = _hashed(docs, key, text)
    kind = hashed.schema["_id"].dataType.simpleString()
    return hashed.mapInArrow(describe, f"_id {kind}, _text_hash long, _n long, _node long, _keys array<array<long>>, _kept array<int>, _checks array<long>")


def _place(text_hash: str, key: str) -> Column:
    """What a document's set is stored by: a hash of its text and id, so copies without an id are spread no worse than others."""
    return F.xxhash64(text_hash, key)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(_place, _node, _hashes) for documents (_place, _text)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, flat, ends in _runs(batch):
                value, at = _shingles(flat, ends, size)
                nodes = [_digest(value[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.int64()), lists], ["_place", "_node", "_hashes"])

    return _hashed(docs, "_place", "_text").mapInArrow(make, "_place long, _node long, _hashes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """(_a, _b, _from, _to, _linked): whether the sets of each pair of nodes are similar enough; _from and _to stay as they are.

    ``sets`` lies in buckets by _place.  Pairs go to the buckets of their sets, first
    of one and then of the other, so what is shuffled is pairs and the sets in them.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(4), batch.column(5)
            lo, ro = np.asarray(left.offsets), np.asarray(right.offsets)
            lv, rv = np.asarray(left.values), np.asarray(right.values)
            good = np.zeros(batch.num_rows, bool)
            for n in range(batch.num_rows):
                a, b = lv[lo[n] : lo[n + 1]], rv[ro[n] : ro[n + 1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                good[n] = 1000 * both >= tenths * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in range(4)), pa.array(good)], ["_a", "_b", "_from", "_to", "_linked"])

    joined = pairs
    for node, place in (("_a", "_pa"), ("_b", "_pb")):
        joined = joined.join(sets.select(F.col("_node").alias(node), F.col("_place").alias(place)), node)
    for place, held in (("_pa", "_ha"), ("_pb", "_hb")):
        joined = joined.join(sets.select(F.col("_place").alias(place), F.col("_hashes").alias(held)), place)
    joined = joined.select("_a", "_b", "_from", "_to", "_ha", "_hb")
    return joined.mapInArrow(judge, "_a long, _b long, _from long, _to long, _linked boolean")


def _connected(members: DataFrame, checks: DataFrame, sets: DataFrame, tenths: int, scratch: Scratch) -> DataFrame:
    """(_node, _component) by all links between ``members`` (_key, _node) of one key.

    Keys are gone through in shares.  A later share begins with the components
    and the failed pairs of the earlier ones, so what they have joined is compared
    no more.  ``members`` of ``scratch`` go once the last share has read them.
    """
    rows, hashes = members.count(), checks.agg(F.sum("_n")).first()[0] or 0
    shares = _shares(rows, hashes)
    state = scratch.pin("state", members.select("_node").distinct().withColumn("_component", F.col("_node")))
    unlinked = None
    for share in range(shares):
        own = members.where(F.pmod("_key", F.lit(shares)) == share)
        last = ("members",) if share == shares - 1 else ()
        state, unlinked = _settled(own, state, unlinked, checks, sets, tenths, hashes, scratch, last)
    scratch.drop("unlinked", "labels")
    return state


def _settled(
    members: DataFrame, state: DataFrame, unlinked: DataFrame | None, checks: DataFrame, sets: DataFrame, tenths: int, hashes: int, scratch: Scratch, read: tuple[str, ...],
) -> tuple[DataFrame, DataFrame | None]:
    """``state`` (_node, _component) and ``unlinked`` pairs after all links between ``members`` of one key.

    A key has centres: all members of a small one, some of a larger one.  A round
    of the first kind compares each node to one centre, the one that most of its
    keys name; one of the second kind to all centres of its keys, which are
    settled then.  So is, after any round, a key whose members are known to be
    connected.  Rounds of both kinds take turns, with more centres from turn to
    turn, until all that were open have been compared.  What passes between
    rounds is links between components, not between nodes.  The tables ``read``
    of ``scratch`` go once the first round has read them.  ``hashes`` is how many
    a turn of verifying reads.
    """
    own = checks.select("_node", "_n", *CHECKS)
    theirs = checks.select(F.col("_node").alias("_centre"), F.col("_n").alias("_m"), *[F.col(c).alias(f"{c}c") for c in CHECKS])

    def near_enough(names: tuple[str, ...]) -> Column:
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}c"))) for c in names), F.lit(0))
        return apart * (1000 + tenths) <= (F.col("_n") + F.col("_m")) * (1000 - tenths)

    left = members.join(state.withColumnRenamed("_component", "_label"), "_node").select("_key", "_node", "_label", "_n", *AT_ONCE)
    for turn in count(0 if unlinked is None else 1):
        size, single = FEW ** (max(0, turn - 1) // 2), turn == 0 or turn % 2 == 1
        keys = left.groupBy("_key").agg(F.count(F.lit(1)).alias("_members"), F.min("_label").alias("_low"), F.max("_label").alias("_high"))
        left = scratch.pin("left", left.join(keys.where("_low <> _high").select("_key", "_members"), "_key"))
        scratch.drop(*read)
        if left.isEmpty():
            break
        slot = F.when(F.col("_members") <= size, F.col("_node")).otherwise(F.pmod(F.xxhash64("_node"), F.lit(size)))
        heads = left.groupBy("_key", slot.alias("_slot")).agg(F.min(F.struct("_node", "_label", "_n", *AT_ONCE)).alias("_head"))
        named = heads.select(
            F.col("_key").alias("_of"), F.col("_head._node").alias("_centre"), F.col("_head._label").alias("_other"), F.col("_head._n").alias("_m"),
            *[F.col(f"_head.{c}").alias(f"{c}c") for c in AT_ONCE],
        )
        centres = scratch.pin("centres", named)  # what finding them has shuffled goes before they are met
        met = left.join(centres, (F.col("_key") == F.col("_of")) & (F.col("_label") != F.col("_other")) & near_enough(AT_ONCE))
        pair = (F.least("_node", "_centre").alias("_a"), F.greatest("_node", "_centre").alias("_b"))
        offered = met.groupBy("_node", "_label", "_centre", "_other").agg(F.count(F.lit(1)).alias("_agree"))
        if unlinked is not None:
            offered = offered.withColumns({"_a": pair[0], "_b": pair[1]}).join(unlinked, ["_a", "_b"], "left_anti").drop("_a", "_b")
        near = scratch.pin("offered", offered).join(own, "_node").join(theirs, "_centre").where(near_enough(CHECKS))
        if single:
            best = near.groupBy("_node", "_label").agg(F.min(F.struct((-F.col("_agree")).alias("less"), "_centre", "_other", "_n", "_m")).alias("_best"))
            near = best.select("_node", "_label", "_best._centre", "_best._other", "_best._n", "_best._m")
        apart = F.least("_label", "_other").alias("_from"), F.greatest("_label", "_other").alias("_to"), (F.col("_n") + F.col("_m")).alias("_size")
        pairs = scratch.pin("pairs", near.select(*pair, *apart).distinct())
        scratch.drop("offered")
        turns = groups_of(pairs.agg(F.sum("_size")).first()[0] or 0, max(1, hashes))
        of_turn = F.pmod(F.xxhash64("_a", "_b"), F.lit(turns))
        found = scratch.pin_in_turn("found", (_verified(pairs.where(of_turn == n).drop("_size"), sets, tenths) for n in range(turns)))
        scratch.drop("pairs")
        if not single or found.isEmpty():  # where no node had a centre to be compared to, all centres are settled as well
            left = left.join(centres.select(F.col("_of").alias("_key"), F.col("_centre").alias("_node")), ["_key", "_node"], "left_anti")
        failed = found.where("NOT _linked").select("_a", "_b")
        unlinked = scratch.pin("unlinked", failed if unlinked is None else unlinked.unionByName(failed))
        links = found.where("_linked").select(F.col("_from").alias("_a"), F.col("_to").alias("_b"))
        if not links.isEmpty():
            renamed = components(links, scratch).select(F.col("_node").alias("_old"), F.col("_component").alias("_new"))
            again = state.join(renamed, F.col("_component") == F.col("_old"), "left")
            state = scratch.pin("state", again.select("_node", F.coalesce("_new", "_component").alias("_component")))
            left = left.join(renamed, F.col("_label") == F.col("_old"), "left")
            left = left.select("_key", "_node", F.coalesce("_new", "_label").alias("_label"), "_n", *AT_ONCE)
        else:
            left = left.drop("_members")
    scratch.drop("left", "centres", "found")
    return state, unlinked


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(_node, _component): the smallest node reachable by links (_a, _b), for the nodes that have links.

    Each round hands the least component among the neighbours on to a whole
    component and then follows it once, so the number of rounds grows with the
    logarithm of the longest chain.  Pairs of numbers move; every round is
    written to the shared folder, where the table called ``labels`` has the last.
    """
    scratch = scratch or Scratch(links.sparkSession)
    both = scratch.pin("both", links.select("_a", "_b").unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).where("_a <> _b").distinct())
    state = scratch.pin("labels", both.groupBy(F.col("_a").alias("_node")).agg(F.least(F.min("_b"), F.min("_a")).alias("_component")))
    while True:
        near = both.join(state.select(F.col("_node").alias("_b"), F.col("_component").alias("_other")), "_b")
        least = near.groupBy(F.col("_a").alias("_node")).agg(F.min("_other").alias("_least"))
        hooked = state.join(least, "_node").select("_node", F.least("_component", "_least").alias("_new"), F.col("_component").alias("_old"))
        roots = hooked.groupBy(F.col("_old").alias("_root")).agg(F.min("_new").alias("_to"))
        moved = hooked.join(roots, F.col("_old") == F.col("_root")).select("_node", F.col("_to").alias("_new"), "_old")
        jump = roots.select(F.col("_root").alias("_at"), F.col("_to").alias("_further"))
        following = moved.join(jump, F.col("_new") == F.col("_at"), "left")
        state = scratch.pin("labels", following.select("_node", F.coalesce("_further", "_new").alias("_component"), "_old"))
        if state.where("_component <> _old").isEmpty():
            scratch.drop("both")
            return state.drop("_old")
        state = state.drop("_old")


def _folded(number: int) -> Column:
    """A word of the check sketch folded to as many words as ``AT_ONCE`` has: a sketch of all shingles in fewer bits."""
    out = F.get("_checks", F.lit(number))
    for n in range(number + len(AT_ONCE), CHECK_WORDS, len(AT_ONCE)):
        out = out.bitwiseXOR(F.get("_checks", F.lit(n)))
    return out


def _shares(rows: int, hashes: int) -> int:
    """How many shares rows (key, node) are gone through in, so that a share takes a fraction of the disk that the sets do."""
    return groups_of(rows, max(SHARE_ROWS, hashes // SHARE_HASHES))


def _members(nodes: DataFrame, narrow: DataFrame, scratch: Scratch) -> DataFrame:
    """(_key, _node, _n, *AT_ONCE): of each band's words of a node those to keep, the ones that fewest nodes have, but for words of a single node.

    ``nodes`` (_node, _keys) is ``standing`` of ``scratch``, which goes once the
    words that may be shared are a table; ``narrow`` has the other facts of nodes.
    """
    folded = [_folded(n).alias(c) for n, c in enumerate(AT_ONCE)]
    bands = narrow.select("_node", "_n", *folded, F.posexplode(F.arrays_zip("_parts", "_kept")).alias("_band", "_of"))
    facts = bands.select("_node", "_band", F.col("_of._parts").alias("_parts"), F.col("_of._kept").alias("_kept"), "_n", *AT_ONCE)
    # most words are of one node: a sketch proves it for nearly all of them, and they are not shuffled
    both = (F.col("_key"), F.shiftrightunsigned("_key", 32))
    every = nodes.select(F.explode(F.flatten("_keys")).alias("_key")).select(both[0].alias("_n0"), both[1].alias("_n1"))
    counters = countmin.counters_for(nodes.agg(F.sum(F.size(F.flatten("_keys")))).first()[0] or 0)
    bits = nodes.sparkSession.sparkContext.broadcast(countmin.sketch(every, counters))
    single = countmin.single(bits)
    banded = nodes.select("_node", F.posexplode("_keys").alias("_band", "_of"))
    one = scratch.pin("one", banded.select("_node", "_band", F.explode("_of").alias("_key")).where(~single(*both)))
    bits.destroy()
    scratch.drop("standing")
    shares = _shares(one.count(), narrow.agg(F.sum("_n")).first()[0] or 0)
    counted = [one.where(F.pmod("_key", F.lit(shares)) == n).groupBy("_key").agg(F.count(F.lit(1)).alias("_have")).where("_have > 1") for n in range(shares)]
    shared = scratch.pin_in_turn("shared", counted)
    # words of one node come first and are no candidates; what is left of the number to keep goes to the others
    of = Window.partitionBy("_node", "_band")

    def kept(share: Column) -> DataFrame:
        common = one.where(share).join(shared, "_key")
        ranked = common.withColumn("_rank", F.row_number().over(of.orderBy("_have", "_key"))).withColumn("_common", F.count(F.lit(1)).over(of))
        few = ranked.join(facts.where(share), ["_node", "_band"]).where(F.col("_rank") <= F.col("_kept") - (F.col("_parts") - F.col("_common")))
        return few.select("_key", "_node", "_n", *AT_ONCE)

    members = scratch.pin_in_turn("members", [kept(F.pmod("_node", F.lit(shares)) == n) for n in range(shares)])
    scratch.drop("one", "shared")
    return members


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, n_shingles, component_id): every row's number of shingles and the smallest id that links reach from it."""
    tenths = round(similarity * 1000)
    scratch = Scratch(docs.sparkSession)
    wide = scratch.pin("wide", _described(docs, key, text, size, tenths).withColumn("_row", F.monotonically_increasing_id()))
    rows = pin(wide.drop("_keys", "_kept", "_checks"))
    filled = rows.where("_node IS NOT NULL")
    # one row of each set stands for it: of the smallest id, of none only where no row has one
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_text_hash").alias("hash"), F.col("_row").alias("row"))).alias("_best")
    heads = pin(filled.groupBy("_node").agg(best).select("_node", F.col("_best.id").alias("_head"), F.col("_best.hash").alias("_head_hash"), F.col("_best.row").alias("_first_row")))
    # the others are left out by their numbers, so that lists of words are not shuffled to find them
    others = scratch.pin("others", filled.join(heads, "_node").where("_row <> _first_row").select("_row"))
    standing = scratch.pin("standing", wide.where("_node IS NOT NULL").join(others, "_row", "left_anti").select("_node", "_n", "_keys", "_kept", "_checks"))
    scratch.drop("wide", "others")
    narrow = scratch.pin("narrow", standing.select("_node", "_n", F.transform("_keys", F.size).alias("_parts"), "_kept", "_checks"))
    members = _members(standing.select("_node", "_keys"), narrow, scratch)
    nodes = members.select("_node").distinct()
    shown = narrow.select("_node", "_n", *[F.get("_checks", F.lit(n)).alias(c) for n, c in enumerate(CHECKS)])
    checks = scratch.pin("checks", shown.join(nodes, "_node", "left_semi"))
    scratch.drop("narrow")
    # texts are found by hash and id, so rows without an id are spread as well; they move once, to the bucket of their set
    wanted = heads.join(nodes, "_node", "left_semi").select(_place("_head_hash", "_head").alias("_place"))
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.select(_place("_hash", "_id").alias("_place"), "_text").repartition(buckets, "_place")
    texts = texts.join(wanted, "_place", "left_semi").dropDuplicates(["_place"])
    sets = scratch.pin_in_buckets("sets", _sets(texts, size), "_place", buckets)
    state = _connected(members, checks, sets, tenths, scratch)
    scratch.drop("checks", "sets")
    linked = heads.join(state, "_node", "left").select("_node", "_head", F.coalesce("_component", "_node").alias("_component"))
    least = linked.groupBy("_component").agg(F.min("_head").alias("_first"))
    of = linked.join(least, "_component").select(F.col("_node").alias("_of"), "_first")
    joined = rows.join(of, F.col("_node") == F.col("_of"), "left")
    return joined.select(F.col("_id").alias(key), F.col("_n").alias("n_shingles"), F.coalesce("_first", "_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The columns of documents; of each group of near duplicates the document with the smallest id, once.

    Documents without words, and those without an id, all stay.
    """
    docs = docs.select(*DOCUMENT)
    found = near_duplicates(docs, size=size, similarity=similarity)
    kept = found.where("component_id = doc_id").groupBy(F.col("doc_id").alias("_kept")).agg(F.max("n_shingles").alias("_n"))
    numbered = docs.join(pin(kept), F.col("doc_id") == F.col("_kept"))
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("n_chars", "lang", "source")
    once = numbered.where("_n > 0").withColumn("_copy", F.row_number().over(again)).where("_copy = 1")
    parts = (once, numbered.where("_n = 0"), docs.where("doc_id IS NULL"))
    return parts[0].select(*DOCUMENT).unionByName(parts[1].select(*DOCUMENT)).unionByName(parts[2])
