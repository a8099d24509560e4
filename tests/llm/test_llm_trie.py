"""The trie of conversation prefixes against a plain one."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigsift.llm import trie
from sigsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append(((turn is not None, turn or 0), role or "", text or ""))
    told = {c: [x[1:] for x in sorted(v)] for c, v in told.items()}
    convs = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = tuple(told.get(int(c / 100) * 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, who in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in who if convs[c] == node).encode()).hexdigest()
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(children[node]), leaves[node], saved[node], ends))
    return sorted(out, key=str)


def odd_rows():
    rng = np.random.default_rng(2)
    rows = [(c, t, ["user", "assistant", None][t % 3], f"text {rng.integers(2)} é😀"[: rng.integers(3, 9)]) for c in range(130) for t in range(rng.integers(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(4)] + [(340, t, "user", f"same {t}") for t in range(9)]
    rows += [(500 + c, t, "user", f"long {t}") for c in range(3) for t in range(300)]
    rows += [(600, None, "user", "no turn"), (600, None, None, None), (601, 0, "user", ""), (601, 1, None, None), (602, 5, "user", "x" * 50_000), (None, 1, "user", "nobody")]
    rows += [(700, 3, "user", "tie"), (700, 3, "user", "tie"), (700, 3, "assistant", "tie"), (-250, 1, "user", "below"), (-200, 1, "user", "base"), (1234567890123, 0, "user", "far")]
    return rows


def frame(spark, rows):
    kept = "conv_id long, turn long, role string, text string"
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], kept + ", _slice int, _depth int, n_convs string").repartition(5)


def collected(nodes):
    return sorted((tuple(r) for r in nodes.select(*OUT).collect()), key=str)


def by_estimate(counters):
    """A screen with so few counters that estimates are too large, none of them too small."""
    return lambda rows: trie.screened(rows, counters)


def no_screen(rows):
    return rows.withColumns({"_single": F.lit(False), "_single_above": F.lit(False)})


@pytest.mark.parametrize("screen", [None, by_estimate(64), by_estimate(2048), no_screen])
def test_nodes_equal_a_plain_trie(spark, screen):
    rows = odd_rows()
    assert collected(trie.built(frame(spark, rows), screen)) == plain(rows)


def test_what_the_screen_leaves_over(spark):
    rows = trie.prefixes(*trie.rebuilt(trie.numbered(frame(spark, odd_rows()))))
    times = {(r._n0, r._n1): r["count"] for r in rows.groupBy("_n0", "_n1").count().collect()}
    for counters in (64, 1 << 16):
        bits = trie.sketch(rows.select("_n0", "_n1"), counters)
        assert [len(b) * 8 for b in bits] == [counters] * 2
        single = {(r._n0, r._n1) for r in trie.screened(rows, counters).where("_single").collect()}
        assert all(times[n] == 1 for n in single)
    assert len(single) > 0.9 * sum(n == 1 for n in times.values())


def test_no_rows(spark):
    none = frame(spark, odd_rows()).where("false")
    assert trie.built(none).count() == 0
    assert collected(trie.built(frame(spark, [(0, 1, "user", "one")]))) == plain([(0, 1, "user", "one")])


def test_query_equals_a_plain_trie(spark):
    got = QUERIES["op11_prefix_trie"](spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got.columns == OUT and collected(got) == plain(rows)
