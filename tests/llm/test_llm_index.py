"""The bit-sliced index and the miner of hard negatives against plain searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigsift.llm import bitslice, hardneg, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string, _row int, _id int, _block int"
CLASH = ("x", "x", 1, 2, 3)
NAN, INF = float("nan"), float("inf")


def whole(vector):
    return np.floor(256 * np.float32(vector).astype(np.float64)).astype(np.int64)


def odd_rows(seed, copies=40):
    """Rows with every oddity: (vec_id, embedding, label)."""
    rng = np.random.default_rng(seed)
    rows = [(n, rng.normal(size=6).tolist(), int(rng.integers(3))) for n in range(120)]
    rows += [(200 + n, [1.0, 0.5, 0.0, 0.0, 0.0, -0.25], n % 2) for n in range(copies)]  # copies tie
    rows += [(n, rows[n][1], rows[n][2]) for n in (0, 50, 51)] + [(10, [0.1] * 6, 1)]  # repeated ids
    rows += [(300, None, 1), (301, [None] * 6, 1), (302, [NAN] * 6, 1), (303, [INF] * 6, 1), (None, [1.0] * 6, 1), (350, [0.5] * 6, None)]
    rows += [(400 + n, rng.normal(size=3).tolist(), n % 2) for n in range(4)] + [(450, [], 0), (451, [], 0), (452, [0.0] * 6, 0), (453, [-900.0] + [0.0] * 5, 2)]
    return rows


def usable(rows):
    return [(k, whole(v), y) for k, v, y in rows if k is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(parts)


def plain_top(rows, count):
    out = []
    for k, q, _ in rows:
        if k % 50 == 0:
            near = sorted((-int(q @ v), m) for m, v, _ in rows if m != k and len(v) == len(q))[:count]
            out += [(k, n, m, -s) for n, (s, m) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "part", "slices"), [(1 << 14, 512, 6), (50, 2, 3), (7, 1, 1), (64, 3, 30)])
def test_top_rows_equal_a_plain_search(spark, block, part, slices):
    rows = odd_rows(block)
    got = bitslice.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, block=block, part=part, slices=slices).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain_top(usable(rows), 5)


def test_sliced_sums_and_selection():
    rng = np.random.default_rng(1)
    for width, spread in ((1, 3), (5, 1000), (64, 60)):
        table = rng.integers(-spread, spread, (777, width))
        index = bitslice.SlicedBlock(table)
        for query in (*table[:5], np.zeros(width, np.int64), np.full(width, -spread)):
            exact = table @ query
            for slices in (1, 4, 40):
                sums, slack = index.sums(query, slices)
                got = np.zeros(777, np.int64)
                for at, slice_ in enumerate(sums):
                    set_rows = bitslice._rows_of(slice_)
                    got[set_rows[set_rows < 777]] += 1 << at  # rows beyond the last hold what the inverted slices have there
                off = exact - got
                assert off.max() - off.min() <= slack
                valid = bitslice._bitmap(rng.random(777) < 0.5, index.words)
                rows = bitslice._rows_of(valid)
                kept = set(bitslice._rows_of(bitslice.top_rows(sums, slack, valid, 9)))
                least = sorted(exact[rows])[-9]
                assert {r for r in rows if exact[r] >= least} <= kept <= set(rows)
        if width == 64:
            assert len(bitslice._rows_of(bitslice.top_rows(*index.sums(table[0], 40), bitslice._bitmap(np.ones(777, bool), index.words), 5))) < 10


def plain_negatives(rows):
    out = []
    for k, q, y in rows:
        if k % 50:
            continue
        near = sorted((-int(q @ v), m, l) for m, v, l in rows if m != k and len(v) == len(q))
        for p, positive in [(-s, m) for s, m, l in near if l == y][:5]:
            fits = [(-s, m) for s, m, l in near if l != y and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(k, positive, n, m, p, s) for n, (s, m) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 20, 3])
def test_negatives_equal_a_plain_search(spark, block):
    rows = odd_rows(block, copies=90)
    got = hardneg.mined(frame(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"), block=block).collect()
    want = plain_negatives([r for r in usable(rows) if r[2] is not None])
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == want and want


def test_hilbert_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        place = hardneg.hilbert(points, bits)
        assert sorted(place) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_leave_far_blocks_out(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6)) * 4
    rows = [(n, (centres[n % 12] + 0.05 * rng.normal(size=6)).tolist(), n % 5) for n in range(1200)]
    table = vectors.whole_vectors(frame(spark, rows), F.col("vec_id"), F.col("embedding"), F.col("label"))
    blocks, zones = hardneg.laid_out(table, 25)
    assert zones.agg(F.count(F.lit(1))).first()[0] >= 48 and blocks.count() == 1200
    anchors = vectors.asked(blocks, "vec_id", F.col("vec_id") % 50 == 0).withColumns({"_lows": F.array(F.lit(4 * 10**6)), "_highs": F.array(F.lit(2**60))})
    read = hardneg._needed(zones, anchors, True).count()
    assert 0 < read < 0.5 * 24 * zones.count()
    # a block that the bounds leave out has no row in the window
    kept = {(r._row, r._slice, r._block) for r in hardneg._needed(zones, anchors, True).collect()}
    stored = [(r._slice, r._block, r._label, np.array(r._vector)) for r in blocks.collect()]
    for a in anchors.collect():
        for at, n, label, v in stored:
            if label == a._label and np.array(a._vector) @ v >= 4 * 10**6:
                assert (a._row, at, n) in kept or (at, n) == (a._slice, a._block)


def test_few_or_no_rows(spark):
    none = frame(spark, [(0, [1.0], 0)], 1).where("false")
    for rows, top, negatives in ((none, 0, 0), (frame(spark, [(0, [1.0], 0)], 1), 0, 0), (frame(spark, [(0, [1.0], 0), (1, [2.0], 0), (2, [1.5], 1)], 1), 2, 1)):
        assert bitslice.nearest(rows, F.col("vec_id") % 50 == 0).count() == top
        assert hardneg.mined(rows, F.col("vec_id") % 50 == 0, F.col("label")).count() == negatives
