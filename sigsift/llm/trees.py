"""Reading the trees that Spark's learners grow."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True, order=True)
class Test:
    """``feature <= limit``, or above it where ``above``."""

    feature: int
    above: bool
    limit: float


_LINE = re.compile(r"^( *)(?:(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)|Predict: .*|Tree \d+ .*)$")


def paths(description: str) -> set[tuple[Test, ...]]:
    """The conjunctions that lead to the nodes of a forest, each once.

    ``description`` is a model's ``toDebugString``.  Of tests of one feature in
    one direction the tightest stays.
    """
    out: set[tuple[Test, ...]] = set()
    stack: list[tuple[int, Test]] = []
    for line in description.splitlines():
        found = _LINE.match(line)
        if not found:
            continue
        depth = len(found[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if found[2]:
            stack.append((depth, Test(int(found[2]), found[3] == ">", float(found[4]))))
            tightest: dict[tuple[int, bool], Test] = {}
            for _, test in stack:
                old = tightest.get((test.feature, test.above))
                if old is None or (test.limit > old.limit) == test.above:
                    tightest[test.feature, test.above] = test
            out.add(tuple(sorted(tightest.values())))
    return out
